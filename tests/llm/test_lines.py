"""Line dedup and quality rules against brute force."""

from collections import Counter, defaultdict

from traceloom.llm.line_dedup import drop_shared_lines
from traceloom.llm.quality_rules import apply_rules, measures

WS = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def _brute(rows, min_chars=40, min_docs=5):
    """rows: (id, text), no id is smaller than any other. Rows in any order."""
    holders = defaultdict(set)
    for own, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= min_chars:
                holders[_key(line)].add(own if own is not None else float("-inf"))
    gone = {k: max(h) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for own, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(_key(x), own if own is not None else float("-inf"))
                == (own if own is not None else float("-inf"))]
        out.append((own, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def _found(df):
    return Counter((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"]) for r in df.collect())


def test_line_dedup_as_brute_force(few_docs):
    assert _found(drop_shared_lines(few_docs)) == _brute(_rows(few_docs))


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    line = "  A line that is long enough to be counted, ÄÖ and all"
    more = [(n, f"{n}\n{line}\n{line.upper() if n % 2 else line}\r\nend", "en", "s", 1, "x") for n in range(20, 26)]
    docs = odd_docs.unionByName(spark.createDataFrame([*more, (None, line, "en", "s", 1, "x")], odd_docs.schema))
    found = drop_shared_lines(docs)
    assert _found(found) == _brute(_rows(docs))
    assert set(found.columns) == {*docs.columns, "_n_lines", "_n_dropped"}
    assert drop_shared_lines(no_docs).count() == 0


def test_measures_by_hand():
    text = "a b c d e f g h a b c d e f g h\nx #$\n\nx #$\n \n"
    assert measures(text) == (20, 22, 4, 1, 16)
    assert measures("") == (0, 0, 0, 0, 0)
    assert measures("w " * 9) == (9, 9, 0, 0, 9)


def _windows(text, span=8):
    words = [w for w in text.translate({ord(c): " " for c in WS}).split(" ") if w]
    seen = Counter(tuple(words[i:i + span]) for i in range(len(words) - span + 1))
    covered = {j for i in range(len(words) - span + 1) if seen[tuple(words[i:i + span])] > 1
               for j in range(i, i + span)}
    return len(words), len(covered)


def test_rules_base_as_brute_force(few_docs):
    texts = dict(_rows(few_docs))
    for r in apply_rules(few_docs).collect():
        n, repeated = _windows(texts[r["doc_id"]])
        lines = [x for x in texts[r["doc_id"]].split("\n") if x.strip(WS)]
        assert (r["n_words"], r["n_repeat_words"]) == (n, repeated)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert not (r["kept"] and r["base_failed"])


def test_rules_reject_depleted_documents_only(spark, odd_docs, no_docs):
    menu = "\n".join(" ".join(f"{w}{i}" for w in ("menu", "entry", "site", "page", "of")) for i in range(8))
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(n, f"{menu}\ntail {n} of it", "en", "site", 1, "x") for n in range(30)]                # depleted
    rows += [(100 + n, f"{menu}\n{body} {n} {body[::-1]}", "en", "site", 1, "x") for n in range(30)]  # keep a body
    rows += [(200 + n, f"{menu} {body}", "en", "copies", 1, "x") for n in range(30)]               # copies of one text
    rows += [(300 + n, f"{menu}\ntail {n} of it", "en", f"host{n}", 1, "x") for n in range(30)]    # each on its host
    found = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, odd_docs.schema)).collect()}
    assert [n for n in range(30) if found[n]["kept"]] == [0]        # the first holder keeps its lines
    assert all(found[n]["kept"] for n in range(100, 130))
    assert all(found[n]["kept"] for n in range(200, 230))
    assert all(found[n]["kept"] for n in range(300, 330))
    assert len(apply_rules(odd_docs).collect()) == odd_docs.count()
    assert apply_rules(no_docs).count() == 0


def test_repeated_rows_lose_their_lines_once(spark, odd_docs):
    menu = "\n".join(" ".join(f"{w}{i}" for w in ("menu", "entry", "site", "page", "of")) for i in range(8))
    rows = [(n, f"{menu}\ntail {n} of it", "en", "site", 1, "x") for n in range(30)]
    half = menu + "\n" + " ".join(f"own{i}" for i in range(45))                     # about half of it is the menu
    once = [(500, half, "en", "site", 1, "x")]
    other = [(None, half + " more", *once[0][2:])]
    for more in (once * 2, once * 5, [(None, *once[0][1:])] * 3 + other * 3,
                 once + [(500, half, "en", "other", 1, "x")] + [(n, f"{menu}\ntail {n} of it", "en", "other", 1, "x")
                                                              for n in range(30, 60)]):
        docs = spark.createDataFrame(rows + more, odd_docs.schema)
        found = [r for r in apply_rules(docs).collect() if r["doc_id"] == more[0][0]]
        assert len(found) == sum(r[0] == more[0][0] for r in more)
        assert max(r["lost_chars"] for r in found) == len(menu) - menu.count("\n")
        assert all(r["kept"] for r in found)


def test_limit_does_not_rise_with_the_host(spark, odd_docs):
    menu = "\n".join(" ".join(f"{w}{i}" for w in ("menu", "entry", "site", "page", "of")) for i in range(8))
    rows = [(n, f"{menu}\ntail {n} of it", "en", "site", 1, "x") for n in range(12)]
    rows += [(1000 + n, " ".join(f"w{n}x{i}" for i in range(25)), "en", "site", 1, "x") for n in range(400)]
    rows += [(2000 + n, f"{menu}\nend {n // 6} of it", "en", "few", 1, "x") for n in range(12)]      # two texts
    found = {r["doc_id"]: r for r in apply_rules(spark.createDataFrame(rows, odd_docs.schema)).collect()}
    assert [n for n in range(12) if found[n]["kept"]] == [0]
    assert all(found[n]["kept"] for n in range(1000, 1400))
    assert [n - 2000 for n in range(2000, 2012) if found[n]["kept"]] == [0, 1, 2, 3, 4, 5]           # and copies of it
