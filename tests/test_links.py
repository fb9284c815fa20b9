from datetime import datetime

from core_samples import at
from pyspark.sql import functions as F
from traceloom.operators import correlate as C
from traceloom.operators import cross_source as S
from traceloom.operators import events as E
from traceloom.operators import findings as R
from traceloom.operators import fleet as FL
from traceloom.operators import ledger as L

DOWNLOAD = "investigation_id string, endpoint_id string, url string, target_path string, downloaded_at timestamp"
RUN = {"kind": "EXECUTION_EVIDENCE", "ran": True, "source": "kernel audit log"}


def downloads(spark, when, target="/home/u/Downloads/tool"):
    return spark.createDataFrame([("i", "h", "https://x.example/tool", target, at(when))], DOWNLOAD)


def test_rules_read_images_written_once(make_events, make_artifacts):
    events = make_events([{**RUN, "image": "/tmp/a"}, {**RUN, "image": "/opt/b"}, {**RUN, "image": "/opt/c"}])
    found = C.artifact_findings(events, make_artifacts([
        {"path": "/tmp/a"}, {"path": "/opt/b", "status": "MISSING"}, {"path": "/opt/c"}]))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["subject"], r["category"]) for r in found.collect()) == [
        ("/opt/b", "execution_artifact_missing"), ("/opt/c", "execution_artifact_matched"),
        ("/tmp/a", "execution_artifact_matched"), ("/tmp/a", "unusual_execution_location")]


def test_download_then_run(spark, make_events, make_artifacts):
    events = make_events([{**RUN, "image": "/home/u/Downloads/tool", "ts": "2024-01-01T10:05:00"}])
    links = S.link_downloads(downloads(spark, "2024-01-01T10:00:00"), make_artifacts(
        [{"path": "/home/u/Downloads/tool"}]), events)
    rows = S.download_findings(links).collect()
    assert [r["category"] for r in rows] == ["download_executed"]
    assert [c["kind"] for c in rows[0]["evidence_references"]] == [
        "browser_download", "artifact", "execution_event"]
    assert rows[0]["priority"] == "PRIORITY_1" and "5 minutes" in rows[0]["explanation"]


def test_far_apart_is_not_a_sequence(spark, make_events, make_artifacts):
    events = make_events([{**RUN, "image": "/home/u/Downloads/tool", "ts": "2024-01-19T10:00:00"}])
    none = make_artifacts([{"path": "/elsewhere"}])
    assert S.link_downloads(downloads(spark, "2024-01-01T10:00:00"), none, events).count() == 0
    undated = make_events([{**RUN, "image": "/home/u/Downloads/tool"}])
    assert S.link_downloads(downloads(spark, "2024-01-01T10:00:00"), none, undated).count() == 1


def test_windows_spellings_join(make_events, make_artifacts):
    events = make_events([{**RUN, "image": "C:\\Vendor\\agent.exe"}])
    links = C.link_events_artifacts(events, make_artifacts([{"path": "C:/Vendor/agent.exe"}]))
    assert links.collect()[0]["artifact_present"] is True


def test_findings_once_per_path(make_events, make_artifacts):
    events = make_events([{**RUN, "image": "/tmp/x", "ts": f"2024-01-01T00:0{n}:00"} for n in range(3)])
    found, _, links = C.correlate(events, make_artifacts([{"path": "/tmp/x"}]))
    rows = {r["category"]: r for r in found.collect()}
    assert set(rows) == {"unusual_execution_location", "execution_artifact_matched"}
    assert rows["unusual_execution_location"]["reference"] == "F-0001"
    assert rows["unusual_execution_location"]["priority"] == "PRIORITY_1" and links.count() == 3
    assert R.finding_evidence(found).count() == 4


def test_copies_on_media(spark, make_events, make_artifacts):
    arts = make_artifacts([{"path": "/home/u/a.zip", "hash": "d1"},
                           {"path": "/media/u/usb/a.zip", "hash": "d1"},
                           {"path": "/media/u/usb2/b", "hash": "d2"}])
    mounts = spark.createDataFrame([("i", "h", "/dev/sdb1", "/media/u/usb")],
                                   "investigation_id string, endpoint_id string, device string, mount_point string")
    copies = S.media_copies(mounts, arts).collect()
    assert [(c["target"], c["source"], c["pairs"]) for c in copies] == [
        ("/media/u/usb/a.zip", "/home/u/a.zip", 1)]
    row = S.removable_media_findings(mounts, make_events([{"command": "ls /media/u/usb/a.zip"}]),
                                     arts).collect()[0]
    assert row["severity"] == "high" and row["corroborated"]


def test_copies_match_brute_force(spark, make_artifacts):
    rows = [{"path": f"/media/m{n % 3}/d{n % 2}/f{n}", "hash": f"h{n % 4}"} for n in range(24)]
    rows += [{"path": f"/home/f{n}", "hash": f"h{n % 5}"} for n in range(10)]
    points = ["/media/m0", "/media/m1", "/media/m1/d1", "/media"]
    mounts = spark.createDataFrame([("h", p) for p in points], "endpoint_id string, mount_point string")
    got = {(r["mount_point"], r["hash"]): (r["pairs"], r["target"], r["source"])
           for r in S.media_copies(mounts, make_artifacts(rows)).collect()}
    want = {}
    for point in points:
        for digest in {r["hash"] for r in rows}:
            inside = [r["path"] for r in rows if r["hash"] == digest and r["path"].startswith(point + "/")]
            out = [r["path"] for r in rows if r["hash"] == digest and not r["path"].startswith(point + "/")]
            if inside and out:
                want[point, digest] = (len(inside) * len(out), min(inside), min(out))
    assert got == want


def observables(spark, tables):
    schemas = {"connections": "endpoint_id string, remote_address string",
               "drivers": "endpoint_id string, name string, sha256 string, risk_status string",
               "downloads": "endpoint_id string, target_path string, url string",
               "devices": "endpoint_id string, serial string, vendor string, product string, removable string"}
    return FL.fleet_observables({k: spark.createDataFrame(v, schemas[k]) for k, v in tables.items()})


def fleet(spark, tables, hosts=("a", "b")):
    ends = spark.createDataFrame([(h,) for h in hosts], "endpoint_id string")
    return FL.fleet_correlation(observables(spark, tables), ends).collect()


def test_fleet_addresses(spark):
    assert len(fleet(spark, {"connections": [("a", "203.0.113.9:443"), ("b", "203.0.113.9:80")]})) == 1
    assert fleet(spark, {"connections": [("a", "203.0.113.9:443"), ("a", "203.0.113.9:80")]}) == []
    assert fleet(spark, {"connections": [(h, a) for h in "ab" for a in (
        "127.0.0.1:1", "169.254.0.4:1", "224.0.0.1:1")]}) == []
    both = fleet(spark, {"connections": [("a", "2001:db8::1:443"), ("b", "2001:db8::1:444")]})
    assert [r["key"] for r in both] == ["2001:db8::1"]


def test_fleet_drivers(spark):
    rows = [(h, "loop", None, "UNKNOWN") for h in "ab"]
    assert fleet(spark, {"drivers": rows}) == []
    assert len(fleet(spark, {"drivers": rows}, hosts="abc")) == 1
    ends = spark.createDataFrame([("a",), ("b",)], "endpoint_id string")
    gone = FL.suppressed_observables(observables(spark, {"drivers": rows}), ends).collect()
    assert [(r["kind"], r["suppressed"]) for r in gone] == [("driver", 1)]
    abused = [(h, "rtcore64.sys", None, "MATCHED") for h in "ab"]
    assert fleet(spark, {"drivers": abused})[0]["notable"] is True


def test_fleet_serials_and_downloads(spark):
    bad = [(h, s, "v", "p", "removable") for h in "ab" for s in ("0000:00:14.0", "00000000", "abc")]
    assert fleet(spark, {"devices": bad}) == []
    good = [(h, "AB12CD34", "v", "p", "removable") for h in "ab"]
    assert fleet(spark, {"devices": good})[0]["key"] == "v p [AB12CD34]"
    assert fleet(spark, {"downloads": [("a", "/d/report.pdf", "https://x.example/r"),
                                       ("b", "/d/report.pdf", "https://y.example/r")]}) == []


def test_drivers_against_a_list(spark):
    drivers = spark.createDataFrame([
        ("i", "h", "RTCore64.sys", "windows_driver", "p", None), ("i", "h", "msr", "kernel_module", None, None),
        ("i", "h", "x.sys", "windows_driver", "p", "AA"), ("i", "h", "y", "kernel_module", None, "bb")],
        "investigation_id string, endpoint_id string, name string, kind string, path string, sha256 string")
    ref = spark.createDataFrame([("1", "c", "rtcore64.sys", None), ("1", "c", "msr.sys", None),
                                 ("2", "c", None, "aa")],
                                "id string, category string, name string, sha256 string")
    got = {r["name"]: (r["risk_status"], r["matched_on"]) for r in C.verify_drivers(drivers, ref).collect()}
    assert got == {"RTCore64.sys": ("MATCHED", "filename"), "msr": ("UNKNOWN", None),
                   "x.sys": ("MATCHED", "sha256"), "y": ("NOT_MATCHED", None)}
    assert C.verify_drivers(drivers, None).select("risk_status").distinct().collect()[0][0] == "UNKNOWN"


def test_memory_orphans(spark):
    rows = spark.createDataFrame([("m", 4, 0, "System"), ("m", 10, 4, "a"), ("m", 11, 99, "evil"),
                                  ("m", 12, 77, "explorer.exe"), ("m", 13, None, "b")],
                                 "image string, pid bigint, parent_pid bigint, process_name string")
    assert [r["process_name"] for r in C.memory_orphans(rows).collect()] == ["evil"]


def test_limitations(spark, make_events, make_artifacts):
    sources = spark.createDataFrame([("i", "a", "NOT_ENABLED", "off"), ("i", "b", "PERMISSION_DENIED", "no")],
                                    "investigation_id string, name string, status string, detail string")
    rows = C.telemetry_limitations(sources).collect()
    assert sorted(r["category"] for r in rows) == [
        "no_historical_telemetry", "telemetry_unavailable", "telemetry_unavailable"]
    flags = spark.createDataFrame([("i", True, False, False)],
                                  "investigation_id string, execution_truncated boolean, artifacts_truncated boolean, processes_truncated boolean")
    got = C.completeness_limitations(flags, make_events([{"command": "x"}]), make_artifacts(
        [{"path": "/x", "status": "PERMISSION_DENIED"}])).collect()
    assert sorted(r["category"] for r in got) == ["collection_truncated", "permission_gap", "undated_evidence"]


def test_hash_history(spark):
    rows = [("h", "/a", "SHA256", "x", datetime(2024, 1, n)) for n in (1, 2)]
    rows += [("h", "/a", "SHA256", "y", datetime(2024, 1, 3)), ("h", "/a", "MD5", "y", datetime(2024, 1, 4))]
    df = spark.createDataFrame(rows, "endpoint_id string, path string, algorithm string, hash string, ts timestamp")
    got = [r["status"] for r in L.hash_history(df).orderBy("ts").collect()]
    assert got == ["first_recorded", "unchanged", "altered", "algorithm_mismatch"]


def test_one_host_in_two_cases(spark, make_events, make_artifacts):
    """What one case collected says nothing about another's copy of the same host."""
    run = {"kind": "EXECUTION_EVIDENCE", "ran": True, "image": "/tmp/x", "record": "r1"}
    events = make_events([{**run, "inv": "A", "id": "e1"}, {**run, "inv": "B", "id": "e2"}])
    arts = make_artifacts([{"inv": "A", "path": "/tmp/x"}, {"inv": "B", "path": "/tmp/x", "status": "MISSING"}])
    assert E.dedupe_events(events).count() == 2
    assert E.unique_artifacts(arts).count() == 2
    assert [r["investigation_id"] for r in C.missing_artifacts(events, arts).collect()] == ["B"]
    there = {r["investigation_id"]: r["artifact_present"] for r in C.link_events_artifacts(events, arts).collect()}
    assert there == {"A": True, "B": False}
    merged = C.merge_artifacts(arts.withColumn("truncated", F.lit(False)), arts.withColumn("truncated", F.lit(True)))
    assert [(r["investigation_id"], r["truncated"]) for r in merged.orderBy("investigation_id").collect()] == [
        ("A", True), ("B", True)]
