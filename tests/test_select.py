import pytest

from traceloom.operators import predicates as P
from traceloom.operators import recognize as G
from traceloom.operators import search as Q
from traceloom.operators import search_index as I
from traceloom.operators import activity as A
from traceloom.operators import timeline as M
from traceloom.operators.scoring import classify_events


def is_(field, operator, value):
    return {"type": "comparison", "field": field, "operator": operator, "value": value}


def test_predicates(make_events):
    df = make_events([{"command": "Curl x", "user": "Ann"}, {"image": "/usr/bin/curl"}, {"command": "ls"}])
    ids = lambda p: sorted(r["event_id"][-1] for r in P.select_where(df, [p]).collect())
    assert ids(is_("COMMAND", "CONTAINS", "curl")) == ["0"]
    assert ids(is_("COMMAND", "MATCHES", "^CURL")) == []
    assert ids(is_("PATH", "ENDS", "CURL")) == ["1"]
    assert ids(is_("USER", "ONEOF", ["ann", "bob"])) == ["0"]
    assert ids({"type": "not", "operand": is_("USER", "EQUALS", "ann")}) == ["1", "2"]
    assert ids({"type": "not", "operand": is_("URL", "CONTAINS", "x")}) == ["0", "1", "2"]
    both = {"type": "and", "operands": [is_("COMMAND", "STARTS", "c"), is_("USER", "EQUALS", "ANN")]}
    assert ids(both) == ["0"] and P.select_where(df, []).count() == 3
    assert P.explain([both]) == ["(COMMAND STARTS c AND USER EQUALS ANN)"]


@pytest.mark.parametrize("bad", [is_("NOPE", "EQUALS", "x"), is_("USER", "LIKE", "x"), is_("USER", "ONEOF", []),
                                 is_("USER", "EQUALS", ["x"]), is_("USER", "MATCHES", "("), {"type": "xor"}])
def test_bad_predicates_fail_early(make_events, bad):
    with pytest.raises(P.PredicateError):
        P.select_where(make_events([{"command": "x"}]), [bad])


def test_predicate_reaches_the_scan(spark, make_events, tmp_path):
    make_events([{"command": "x", "user": "ann"}]).write.parquet(str(tmp_path / "e"))
    df = P.select_where(spark.read.parquet(str(tmp_path / "e")), [is_("USER", "EQUALS", "ann")])
    plan = df.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:string,user:string>" in plan


def test_search_names_fields(make_events, make_artifacts):
    scored = classify_events(make_events([{"command": "flutter build", "user": "ann"}, {"command": "ls"}]))
    tables = {"activity": A.activity_groups(scored), "activity_records": A.activity_records(scored),
              "artifact": make_artifacts([{"path": "/home/u/flutter/bin/x"}])}
    rows = {r["kind"]: r["matched_fields"] for r in Q.search_evidence(tables, "Flutter").collect()}
    assert rows["activity"][0] == "command" and rows["artifact"] == ["path"]
    assert [r["matched_fields"] for r in Q.search_evidence(tables, "ann", ["activity"]).collect()] == [["user"]]
    with pytest.raises(ValueError):
        Q.search_evidence(tables, "x")
    picked = Q.select_surfaces(tables, [is_("USER", "EQUALS", "ANN")]).collect()
    assert [r["label"] for r in picked] == ["flutter build"]


def test_search_index_finds_what_a_scan_finds(spark, make_events, make_artifacts, tmp_path):
    scored = classify_events(make_events(
        [{"command": "flutter build", "user": "ann"}, {"command": "ls -la /srv", "image": "/usr/bin/ls"},
         {"command": "ls -la /srv", "user": "Annabel"}, {"command": "École 😀😀x"}]))
    def row(schema, *values):
        return spark.createDataFrame([values], schema)
    tables = {
        "activity": A.activity_groups(scored), "activity_records": A.activity_records(scored),
        "artifact": make_artifacts([{"path": "/home/u/flutter/bin/x"}, {"path": "/srv/ann"}]),
        "finding": row("reference string, title string, explanation string", "F1", "Flutter", None),
        "thread": row("thread_id string, title string, commands array<string>", "t", "x", ["ls", "flutter build"]),
        "lead": row("lead_id string, title string, commands array<string>", "L1", "Ann", []),
        "browser download": row("url string, target_path string, title string", "http://x/ann", "/srv/y", "ANNOTATED"),
        "browser history": row("url string, title string, profile string", "http://y", None, "ann"),
        "network": row("remote_address string, process_name string", "10.0.0.1:443", "ls"),
        "evidence source": row("id string, original_path string, endpoint_id string", "E", "/srv/flutter", "h"),
        "endpoint": row("endpoint_id string, name string", "h", "srv-ann")}
    root = str(tmp_path / "index")
    I.write_search_index(tables, root)
    order = ["kind", "id", "label", "matched_fields", "investigation_id"]
    for term in ("ann", "flutter", "SRV", "ls", "ÉCOLE", "😀😀x", "lutter b", "nothing", "443", "nna"):
        want, got = (sorted(map(str, found.select(*order).collect())) for found in (
            Q.search_evidence(tables, term), I.search_index(spark, root, term)))
        assert got == want, term
    assert {r["kind"] for r in I.search_index(spark, root, "ann", ["lead", "endpoint"]).collect()} == {"lead", "endpoint"}
    plan = I.candidate_texts(spark, root, "ann")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:60]
    with pytest.raises(ValueError):
        I.search_index(spark, root, "x")


def test_timeline_keeps_undated(make_events):
    events = make_events([{"command": "a", "ts": "2024-01-02T00:00:00"}, {"command": "b"},
                          {"command": "c", "ts": "2024-01-01T00:00:00"}])
    rows = M.in_time_order(M.build_timeline(events)).collect()
    assert [r["title"] for r in rows] == ["c", "a", "b"] and rows[2]["ts"] is None
    assert [r["title"] for r in M.in_time_order(M.build_timeline(events, newest=2)).collect()] == ["c", "a"]


def test_recognition_layers(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)     # noqa: E731
    paths = make([("h", p) for p in ("/usr/bin//curl", "/snap/code/1/code", "/home/u/flutter/bin/dart",
                                     "/home/v/flutter/bin/dart", "/usr/bin/code", "/tmp/python3",
                                     "/usr/bin/odd", "/srv/x")], "endpoint_id string, path string")
    out = G.recognize(
        paths, package_paths=make([("h", "/usr/bin/curl", "curl"), ("h", "/usr/share/code/code", "code")],
                                  "endpoint_id string, path string, package string"),
        packages=make([("h", "curl", "8.5", "web", "fetch")],
                      "endpoint_id string, package string, version string, section string, description string"),
        snaps=make([("h", "code", "VS Code", "1.9", "/snap/code/meta")],
                   "endpoint_id string, name string, title string, version string, meta_path string"),
        vendors=[{"name": "Flutter SDK", "path_contains": "/flutter/", "marker": "v.json",
                  "version_json_key": "frameworkVersion", "confidence": "HIGH"}],
        inventory=make([("h", "/home/u/flutter/v.json", '{"frameworkVersion": "3.2"}')],
                       "endpoint_id string, path string, text string"),
        links=make([("h", "/usr/bin/code", "/usr/share/code/code")],
                   "endpoint_id string, path string, target string"))
    rows = {r["path"]: r for r in out.collect()}
    assert rows["/usr/bin/curl"]["version"] == "8.5" and rows["/snap/code/1/code"]["recognized_name"] == "VS Code"
    assert rows["/home/u/flutter/bin/dart"]["version"] == "3.2"
    assert not rows["/home/v/flutter/bin/dart"]["recognized"]
    assert rows["/usr/bin/code"]["resolved_from"] == "/usr/bin/code"
    assert rows["/tmp/python3"]["confidence"] == "NONE" and rows["/srv/x"]["basis_codes"] == []
    assert rows["/usr/bin/odd"]["basis_codes"] == ["trusted_system_location"]
    assert not rows["/usr/bin/odd"]["recognized"]
