"""What briefs look up: citing findings, threads, sessions of a user, mounts over a path, triage of the naming activity."""

from traceloom.operators import activity as A
from traceloom.operators import correlate as C
from traceloom.operators import findings as R
from traceloom.operators import narrative as N
from traceloom.operators import threads as H
from traceloom.operators.events import assign_event_references
from traceloom.operators.scoring import classify_events

RUN = {"kind": "EXECUTION_EVIDENCE", "ran": True, "source": "kernel audit log"}


def tables(spark, make_events, make_artifacts):
    events = make_events([
        {**RUN, "image": "/media/usb/tool", "user": "ann"},
        {"kind": "SESSION_EVENT", "user": "ann", "name": "session_open", "ts": "2024-01-01T08:00:00", "record": "s1"},
        {"command": "pip install findmail", "record": "/h:1", "user": "bob"},
        {"command": "findmail a@example.com", "record": "/h:2", "user": "bob"}]).drop("reference")
    arts = make_artifacts([{"path": "/media/usb/tool", "status": "MISSING"}, {"path": "/home/other"}])
    scored = classify_events(assign_event_references(events), arts)
    groups, records = A.rank_groups(A.activity_groups(scored)), A.activity_records(scored)
    found, _, _ = C.correlate(scored, arts)
    threads, members = H.threads(groups, records)
    mounts = spark.createDataFrame([("i", "h", "/dev/sdb1", "/media/usb"), ("j", "h", "/dev/sdc1", "/media/usb")],
                                   "investigation_id string, endpoint_id string, device string, mount_point string")
    return {"groups": groups, "records": records, "artifacts": arts, "findings": found, "mounts": mounts,
            "finding_evidence": R.finding_evidence(found), "threads": threads, "thread_members": members}


def sections(row):
    return {s["title"]: list(s["lines"]) for s in row["sections"]}


def test_lookups(spark, make_events, make_artifacts):
    given = tables(spark, make_events, make_artifacts)
    rows = {r["label"]: r for r in N.briefs(given, "activity").collect()}
    tool = sections(rows["/media/usb/tool"])
    assert tool["Removable media"] == ["/media/usb  /dev/sdb1"]
    assert tool["Sessions of these users"][0].startswith("ann had 1 session record(s)")
    assert any("tool" in line for line in tool["Findings that cite it"])
    assert tool["Thread"] == ["part of no thread"]
    used = sections(rows["findmail a@example.com"])
    assert used["Thread"] == ["THREAD-001  Tool installation and subsequent use"]
    assert used["Sessions of these users"] == ["no session recorded"]
    assert used["Removable media"] == ["under no listed mount"]


def test_artifacts_take_triage_from_what_names_them(spark, make_events, make_artifacts):
    given = tables(spark, make_events, make_artifacts)
    rows = {r["label"]: r for r in N.briefs(given, "artifact").collect()}
    named, other = rows["/media/usb/tool"], rows["/home/other"]
    assert named["priority"] and named["category"] and named["presentation"]
    assert other["priority"] is None and other["category"] is None
    assert sections(named)["Removable media"] == ["/media/usb  /dev/sdb1"]
    assert sections(other)["Findings that cite it"] == ["no finding cites it"]


def test_sections_without_their_tables_are_left_out(spark, make_events, make_artifacts):
    given = tables(spark, make_events, make_artifacts)
    few = {k: given[k] for k in ("groups", "records", "artifacts")}
    assert "Thread" not in sections(N.briefs(few, "activity").collect()[0])
    assert "Removable media" not in sections(N.briefs(few, "artifact").collect()[0])
