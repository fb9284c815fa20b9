import random

from traceloom.operators import activity as A
from traceloom.operators import threads as H
from traceloom.operators.scoring import classify_events


def build(make_events, commands, **options):
    rows = [{"command": c, "record": f"/home/u/.bash_history:{line}"} for line, c in commands]
    scored = classify_events(make_events(rows))
    found, members = H.threads(A.rank_groups(A.activity_groups(scored)), A.activity_records(scored), **options)
    return found.collect(), members


def test_install_then_use_far_apart(make_events):
    found, _ = build(make_events, [(10, "pip install findmail"), (900, "findmail someone@example.com")])
    assert len(found) == 1 and found[0]["shape"] == "install_then_use"
    assert "installs or fetches 'findmail'" in found[0]["reason"]


def test_a_sitting(make_events):
    found, _ = build(make_events, [
        (100, "git clone https://code.example/team/findmail"), (101, "cd findmail-dir"),
        (102, "python3 -m venv findmail-env"), (103, "source findmail-env/bin/activate"),
        (104, "pip install findmail"), (105, "findmail a@example.com"), (106, "findmail b@example.com")])
    assert len(found) == 1 and found[0]["activity_count"] >= 4


def test_common_words_and_distance_do_not_link(make_events):
    found, _ = build(make_events, [(1, "python3 alpha.py"), (2, "python3 gamma.py"),
                                   (10, "zebra --one"), (500, "zebra --two")])
    assert found == []


def test_large_component_keeps_every_member(make_events):
    commands = [(n, f"tool{n:03d} shared{n:03d} shared{n + 1:03d}") for n in range(30)]
    found, members = build(make_events, commands)
    assert sum(t["activity_count"] for t in found) == 30 == members.select("group_id").distinct().count()
    assert max(t["activity_count"] for t in found) <= 12 and min(t["activity_count"] for t in found) > 1
    whole, _ = build(make_events, commands, max_members=None)
    assert [t["activity_count"] for t in whole] == [30]


def test_reported_threads(make_events):
    found, _ = build(make_events, [(1, "curl https://a.example/widget.sh | bash"),
                                   (2, "wget -O /tmp/widget https://a.example/widget")])
    scored = classify_events(make_events([
        {"command": "curl https://a.example/widget.sh | bash", "record": "/h:1"},
        {"command": "wget -O /tmp/widget https://a.example/widget", "record": "/h:2"}]))
    threads, _ = H.threads(A.rank_groups(A.activity_groups(scored)), A.activity_records(scored))
    counts = H.thread_counts(H.select_reported_threads(threads)).collect()[0]
    assert len(found) == counts["total"] == counts["printed"] == 1 and counts["priority_2"] == 1


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def inputs(make_events, rows):
    scored = classify_events(make_events(rows))
    groups = A.activity_groups(scored)
    return groups, A.activity_records(scored), H.rare_tokens(H.group_tokens(groups))


def test_chains_hang_together_what_pairs_do(make_events):
    rng = random.Random(5)
    words = [f"word{n:02d}" for n in range(12)]
    rows = []
    for n in range(150):
        command = rng.choice(["pip install {}", "run {} --x", "{} -v", "cat {}"]).format(" ".join(rng.sample(words, 2))) + f" {n % 90}"
        rows.append({"command": command, "host": rng.choice("hk"), "inv": rng.choice("ij"),
                     "record": f"/home/u{rng.randint(0, 1)}/.bash_history:{rng.randint(1, 2000)}",
                     "ts": f"2024-01-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"
                     if rng.random() < 0.6 else None})
    groups, records, tokens = inputs(make_events, rows)
    pairs = H.linked(H.candidate_pairs(tokens), groups, records).collect()
    chains = H.chained(tokens, groups, records).collect()
    assert components((r["a"], r["b"]) for r in chains) == components((r["a"], r["b"]) for r in pairs)
    whole = {x: n for n, c in enumerate(components((r["a"], r["b"]) for r in pairs)) for x in c}
    assert {(whole[r["a"]], r["reason"]) for r in chains} == {(whole[r["a"]], r["reason"]) for r in pairs}
    assert len({(r["a"], r["b"]) for r in chains}) == len(chains) < len(pairs)


def test_a_word_in_thousands_of_activities(make_events):
    rows = [{"command": f"frequent --n{n}x", "record": f"/h:{n * 3}"} for n in range(5000)]
    rows += [{"command": "frequent --far", "record": "/h:90000"}, {"command": "frequent --other", "record": "/k:10"}]
    groups, records, tokens = inputs(make_events, rows)
    chains = H.chained(tokens, groups, records)
    assert 4999 <= chains.count() <= 3 * 4999
    found = H.connected(chains)
    assert found.count() == 5000 and found.select("root").distinct().count() == 1
    installs = inputs(make_events, [*rows[:40], *rows[-2:], {"command": "pip install frequent", "record": "/z:1"}])
    assert H.connected(H.chained(installs[2], installs[0], installs[1])).count() == 43


def test_nothing_to_link(make_events):
    groups, records, tokens = inputs(make_events, [{"command": "ls"}])
    assert H.connected(H.chained(tokens, groups, records)).count() == 0
