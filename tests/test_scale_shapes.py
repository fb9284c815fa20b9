"""Ordered operators against brute force, with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from core_samples import at
from traceloom.operators import ordering as O
from traceloom.operators.events import assign_event_references, dedupe_events
from traceloom.operators.threads import connected


def skewed(spark, n=3000):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.randrange(500), i,
             rng.choice([None, rng.randrange(99)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, t int, id int, v int").repartition(7)


def test_numbering(spark):
    rows, df = skewed(spark)
    got = {(r["g"], r["id"]): r["n"] for r in O.number_rows(
        df, ["g"], [F.col("t"), F.col("id")], "n").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[g, r[2]] = n
    assert got == want


def test_hot_group_is_split(spark):
    _, df = skewed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = O.slices(df, ["g"], [F.col("t"), F.col("id")]).filter("g = 'hot'")
        assert hot.select("_part").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_previous_and_last(spark):
    rows, df = skewed(spark)
    order = [F.col("t"), F.col("id")]
    previous = {r["id"]: r["p"] for r in O.previous_value(df, ["g"], order, F.col("id"), "p").collect()}
    latest = {r["id"]: r["p"] for r in O.last_value_so_far(df, ["g"], order, F.col("v"), "p").collect()}
    for g in {r[0] for r in rows}:
        before, held = None, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            held = r[3] if r[3] is not None else held
            assert previous[r[2]] == before and latest[r[2]] == held
            before = r[2]


def test_partition_count_does_not_matter(spark, make_events):
    rows = [{"command": f"c{n % 7}", "record": f"r{n % 40}", "ts": f"2024-01-01T00:00:{n % 60:02d}"
             if n % 5 else None, "inv": "a" if n % 3 else "b"} for n in range(200)]
    events = make_events(rows).drop("reference")
    results = []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted((r["event_id"], r["reference"]) for r in assign_event_references(
            dedupe_events(events)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] and len({r for _, r in results[0]}) <= len(results[0])


def test_dedupe_counts_copies(make_events):
    rows = [{"command": "a", "record": "same", "ts": t} for t in (None, "2024-01-02T00:00:00",
                                                                 "2024-01-01T00:00:00")]
    got = dedupe_events(make_events(rows)).collect()
    assert len(got) == 1 and got[0]["copies"] == 3 and got[0]["ts"].day == 1
    assert at("2024-01-01T00:00:00").day == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{a:04d}", f"n{a + 1:04d}") for a in range(0, 300) if a % 50 != 49]
    edges += [("hub", f"leaf{n}") for n in range(100)]
    edges += [(f"x{rng.randrange(60)}", f"y{rng.randrange(60)}") for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for n in parent}
    df = spark.createDataFrame([("i", a, b) for a, b in edges], "investigation_id string, a string, b string")
    assert {r["node"]: r["root"] for r in connected(df).collect()} == want
