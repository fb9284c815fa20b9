"""Secrets in text: assignments, access keys, long hex runs, and strings of high local entropy.

The first three are patterns. The method adds candidate strings: a window slides over each, and the Shannon entropy
of its characters follows from counts of which only two change by a step, those of the character that leaves and of
the one that enters. What entropy is enough depends on the window's character class; strings on an allow list are
suppressed. DataFrame functions only.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: The patterns of the base kinds, and from how many characters a match counts.
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{12,}"          # a run that is too short holds no longer one, so the length can stand here
HEX = "[0-9a-f]{32,}"
MIN_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the method, the window, and the bits a window of each class must reach.
WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}"
BITS = {"hex": 3.0, "mixed": 3.7, "letters": 3.9}
#: What windows must not touch to count: placeholders and alphabets.
ALLOWED_INSIDE = "(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|lorem|0123456789|abcdefgh"
#: Stretches that are identifiers as a whole are no secrets, nor are words and short numbers joined by signs (words in one
#: case, or capitalised). A piece between signs is no such word where this is found. No pattern repeats a group.
IDENTIFIER = "^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
NO_WORD = "[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"
MASK = "[SECRET]"
#: Sums of c log2 c are held as integers of this many to a bit, so that they are exact.
SCALE = 1_000_000
_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
#: What stands for a character of a base span while candidates are looked for; no candidate holds it.
_TAKEN = "\x01"
#: Items of a block where something runs along an array or a text.
_ITEMS, _CHARS = 128, 4096


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, least: int, op) -> Column:
    """What ``op`` makes of the items before each item, and of ``least``: block by block, then inside the blocks.

    Appending to an array copies it; blocks keep what is copied in proportion to the power 1.5 of the items.
    """
    start = F.lit(least).cast("long")

    def along(items, begin):
        return F.aggregate(items, F.array(begin), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x))))

    def in_blocks(items):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / _ITEMS).cast("int") - 1, F.lit(0))),
                           lambda b: F.slice(items, b * _ITEMS + 1, _ITEMS))

    def joined(blocks):
        begins = along(F.transform(blocks, lambda block: F.aggregate(block, start, op)), start)
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), lambda block, begin: F.slice(
            along(block, begin), 1, F.size(block))))

    return _let(values, lambda items: _let(in_blocks(items), joined))


def _steps(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost matches that do not overlap: what stands before each, the match, and one of its groups."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("found"),
                         value.alias("value"))
    return F.when(F.rlike(text, F.lit(pattern)), steps)


def _spans(steps: Column, kind: int, counts: int = 0) -> Column:
    """Spans of :func:`_steps` in code points: lengths before and between the matches add up to places."""
    sizes = F.transform(steps, lambda x: F.char_length(x["gap"]) + F.char_length(x["found"]).cast("long"))
    spans = F.zip_with(steps, _running(sizes, 0, lambda a, b: a + b), lambda x, at: F.struct(
        (at + F.char_length(x["gap"])).alias("start"), F.lit(kind).alias("kind"),
        (at + F.char_length(x["gap"]) + F.char_length(x["found"])).alias("end"), x["value"].alias("value")))
    if counts:
        spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= counts)
    return F.when(F.size(steps) > 0, spans).otherwise(F.array()).cast(_SPAN)


def _taken(text: Column, steps: Column, counts: int = 0) -> Column:
    """``text`` with the characters of its matches replaced, one for one."""
    sign = F.lit(_TAKEN)

    def part(x):
        away = F.repeat(sign, F.char_length(x["found"]))
        if counts:
            away = F.when(F.char_length(x["value"]) >= counts, away).otherwise(x["found"])
        return F.concat(x["gap"], away)

    sizes = F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["gap"]) + F.char_length(x["found"]))
    rest = F.substring(text, (sizes + 1).cast("int"), F.char_length(text))
    return F.when(F.size(steps) > 0, F.concat(F.array_join(F.transform(steps, part), ""), rest)).otherwise(text)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHARS), F.lit(0))


def _all_taken(texts: list[Column]) -> Column:
    """Texts of one length as one, in which a character is taken where it is in any of them."""
    def merged(parts):
        same = (parts["a"] == parts["b"]) & (parts["b"] == parts["c"])
        cells = F.arrays_zip(*[F.split(parts[k], "").alias(k) for k in "abc"])
        return F.when(same, parts["a"]).otherwise(F.array_join(F.transform(cells, lambda c: F.when(
            (c["a"] == _TAKEN) | (c["b"] == _TAKEN) | (c["c"] == _TAKEN), F.lit(_TAKEN)).otherwise(c["a"])), ""))

    def whole(a, b, c):
        blocks = F.arrays_zip(_blocks(a).alias("a"), _blocks(b).alias("b"), _blocks(c).alias("c"))
        return F.when((a == b) & (b == c), a).otherwise(F.array_join(F.transform(blocks, merged), ""))

    return _let(texts[0], lambda a: _let(texts[1], lambda b: _let(texts[2], lambda c: whole(a, b, c))))


def _c_log_c(window: int) -> Column:
    """``c * log2(c)`` for counts 0 to ``window``, scaled to integers."""
    return F.array(*[F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 1)])


def high_entropy(value: Column, window: int = WINDOW, bits: dict[str, float] | None = None) -> Column:
    """Whether some window of ``window`` characters reaches the entropy that its class asks for.

    The entropy is log2(window) - (sum of c log2 c over characters) / window. Classes: ``hex`` (hex digits, a digit
    and a letter among them), ``mixed`` (a digit and a letter), ``letters`` (no digit, both cases).
    """
    bits = bits or BITS
    most = {k: round(SCALE * window * (math.log2(window) - b)) for k, b in bits.items()}
    table = _c_log_c(window)

    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    def is_digit(c):
        return flag(c.between(48, 57))

    def is_hex(c):
        return flag(c.between(48, 57) | c.between(97, 102) | c.between(65, 70))

    def is_lower(c):
        return flag(c.between(97, 122))

    def is_upper(c):
        return flag(c.between(65, 90))

    marks = {"digits": is_digit, "hexes": is_hex, "lowers": is_lower, "uppers": is_upper}
    begin = F.struct(F.lit(0).cast("long").alias("sum"), *[F.lit(0).alias(m) for m in marks],
                     F.lit(False).alias("hit"), F.array().cast("array<int>").alias("inside"))

    def times(symbols, c):
        return F.size(F.filter(symbols, lambda x: x == c))

    def step(state, c):
        full = F.size(state["inside"]) >= window
        out = F.element_at(state["inside"], 1)
        c_out = times(state["inside"], out)
        rest = F.when(full, F.slice(state["inside"], 2, window)).otherwise(state["inside"])
        c_in = times(rest, c)
        left = F.when(full, F.element_at(table, c_out + 1) - F.element_at(table, c_out)).otherwise(F.lit(0))
        total = state["sum"] - left + F.element_at(table, c_in + 2) - F.element_at(table, c_in + 1)
        now = {m: state[m] + f(c) - F.when(full, f(out)).otherwise(0) for m, f in marks.items()}
        letters = now["lowers"] + now["uppers"]
        mixed = (now["digits"] > 0) & (letters > 0)
        enough = (F.when((now["hexes"] == window) & mixed, total <= most["hex"]).when(mixed, total <= most["mixed"])
                  .otherwise((now["digits"] == 0) & (now["lowers"] > 0) & (now["uppers"] > 0)
                             & (total <= most["letters"])))
        complete = F.size(rest) == window - 1
        return F.struct(total.alias("sum"), *[now[m].alias(m) for m in marks],
                        (state["hit"] | (complete & enough)).alias("hit"),
                        F.concat(rest, F.array(c)).alias("inside"))

    # pieces that each hold the windows which begin in so many characters
    pieces = F.regexp_extract_all(value, F.lit("(?=(.{1,%d})).{1,%d}" % (_CHARS + window - 1, _CHARS)), F.lit(1))

    def hit(piece):
        codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c))
        return F.aggregate(codes, begin, step, lambda s: s["hit"])

    return F.when(F.char_length(value) >= window, F.exists(pieces, hit)).otherwise(False)


def find_secrets(docs: DataFrame, window: int = WINDOW, bits: dict[str, float] | None = None,
                 identifier: str = IDENTIFIER, text: str = "text", allowed_inside: str = ALLOWED_INSIDE) -> DataFrame:
    """All columns of ``docs`` and ``_spans``: ``array<struct<start, kind, end, value>>`` by start, then kind.

    ``kind`` is a place in ``KINDS``. Candidates are what lies beside base spans, and each adds itself if a window of
    it that touches no word of ``allowed_inside`` has the entropy. A null or empty text has no spans; rows that repeat
    are scanned alike; an empty table gives an empty result. Extra columns pass; names that begin with ``_sec_`` are
    reserved. Work grows with the length of a text, and with the power 1.5 of its spans at most.
    """
    counts, whole = (MIN_ASSIGNED, 0, 0), whole_text(text)
    steps = [_steps(whole, ASSIGN, 2), _steps(whole, ACCESS), _steps(whole, HEX)]
    scanned = docs.withColumns({f"_sec_{k}": x for k, x in enumerate(steps)})
    own = [F.col(f"_sec_{k}") for k in range(3)]
    none = F.coalesce(*own).isNull()
    free = F.when(none, whole).otherwise(_all_taken([_taken(whole, x, n) for x, n in zip(own, counts)]))
    scanned = scanned.withColumn("_sec_free", free)
    scanned = scanned.withColumn("_sec_more", _steps(F.col("_sec_free"), CANDIDATE % window)).drop("_sec_free")

    def secret(value):
        def open_part(part):
            return (~F.rlike(part, F.lit(identifier)) & F.rlike(part, F.lit(NO_WORD)) & high_entropy(part, window, bits))

        return ~F.rlike(value, F.lit(identifier)) & F.rlike(value, F.lit(NO_WORD)) & F.exists(
            F.split(value, allowed_inside, -1), open_part)

    base = F.concat(*[_spans(x, k, n) for k, (x, n) in enumerate(zip(own, counts))])
    base = F.when(none, F.array().cast(_SPAN)).otherwise(base)
    added = F.filter(_spans(F.col("_sec_more"), 3), lambda s: secret(s["value"]))
    added = F.when(F.size("_sec_more") > 0, added).otherwise(F.array().cast(_SPAN))
    return scanned.withColumn("_spans", F.array_sort(F.concat(base, added))).drop(
        "_sec_0", "_sec_1", "_sec_2", "_sec_more")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each span, or row of spans that overlap, replaced by ``mask``."""
    ends = F.transform(spans, lambda s: s["end"])

    def replaced(blocks):
        def between(start, end):
            """Characters ``start`` to ``end``, from the blocks that hold them."""
            first = F.floor(start / _CHARS)
            held = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor(end / _CHARS) - first + 1).cast("int")), "")
            return F.substring(held, (start - first * _CHARS + 1).cast("int"), (end - start).cast("int"))

        return F.zip_with(spans, _running(ends, 0, lambda a, b: F.greatest(a, b)), lambda s, at: F.when(
            s["start"] >= at, F.concat(between(at, s["start"]), F.lit(mask))).otherwise(""))

    tail = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(_let(_blocks(text), replaced), ""), tail)).otherwise(text)


def op9_secrets(spark, sf_dir):
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["kind"] < 3)

    def count(kind):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("_spans")).alias("spans"))
