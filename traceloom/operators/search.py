"""Search and selection over every evidence table, saying which field matched."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .activity import label
from .events import union_sources
from .ordering import first_rows
from .predicates import comparisons, predicate_column, select_where, validate_predicate

MIN_TERM = 2

# surface -> (shown field name, column or array column) in the order they are reported
SURFACES = {
    "artifact": (("path", "path"), ("filename", "filename"), ("sha256", "hash"),
                 ("evidence id", "reference"), ("recognized software", "recognized_name"),
                 ("source", "source"), ("endpoint", "endpoint_id")),
    "finding": (("title", "title"), ("explanation", "explanation"), ("category", "category"),
                ("evidence id", "reference"), ("triage", "triage")),
    "thread": (("title", "title"), ("why", "reason"), ("command", "commands"),
               ("shared term", "shared_terms"), ("thread", "thread_id")),
    "lead": (("title", "title"), ("command", "commands"), ("lead", "lead_id")),
    "browser download": (("url", "url"), ("download path", "target_path"), ("title", "title"),
                         ("profile", "profile")),
    "browser history": (("url", "url"), ("title", "title"), ("profile", "profile")),
    "network": (("remote address", "remote_address"), ("process name", "process_name"),
                ("status", "status")),
    "evidence source": (("reference", "reference"), ("path", "original_path"),
                        ("sha256", "sha256"), ("evidence id", "id"),
                        ("description", "description"), ("endpoint", "endpoint_id")),
    "endpoint": (("endpoint", "name"), ("hostname", "hostname"), ("endpoint id", "endpoint_id")),
}
IDENTITY = {
    "artifact": ("reference", "path"), "finding": ("reference", "title"),
    "thread": ("thread_id", "title"), "lead": ("lead_id", "title"),
    "browser download": ("url", "target_path"), "browser history": ("url", "title"),
    "network": ("remote_address", "process_name"), "evidence source": ("id", "original_path"),
    "endpoint": ("endpoint_id", "name"),
}


def _column(df, name):
    kind = dict(df.dtypes)[name]
    return F.array_join(name, " ") if kind.startswith("array") else F.col(name).cast("string")


def _hits(df, kind, needle):
    matched = F.array_compact(F.array(*[
        F.when(F.lower(_column(df, c)).contains(needle), F.lit(shown))
        for shown, c in SURFACES[kind] if c in df.columns]))
    key, text = IDENTITY[kind]
    have = [c for c in (key, text) if c in df.columns]
    scope = F.col("investigation_id") if "investigation_id" in df.columns else F.lit(None)
    shown = F.coalesce(*[F.col(c).cast("string") for c in reversed(have)])
    return df.select(scope.cast("string").alias("investigation_id"), F.lit(kind).alias("kind"),
                     F.col(have[0]).cast("string").alias("id"), shown.alias("label"),
                     matched.alias("matched_fields")).filter(F.size("matched_fields") > 0)


def _activity_hits(groups, records, needle):
    has = lambda c: F.coalesce(F.lower(c).contains(needle), F.lit(False))      # noqa: E731
    per_record = [("user", "user"), ("evidence id", "reference")]
    look = records.select("group_id", *[
        (has(c) if c in records.columns else F.lit(False)).alias(f"_r{i}")
        for i, (_, c) in enumerate(per_record)])
    found = look.filter(F.col("_r0") | F.col("_r1")).groupBy("group_id").agg(
        F.bool_or("_r0").alias("_r0"), F.bool_or("_r1").alias("_r1"))
    joined = groups.join(found, "group_id", "left")
    fields = [("command", F.col("full_command_line")),
              ("normalized command", F.col("normalized_command")),
              ("executable", F.col("executable")), ("process name", F.col("process_name")),
              ("evidence kind", F.col("evidence_kind")),
              ("classification", F.col("classification.category")),
              ("presentation", F.col("classification.presentation")),
              ("priority", F.col("classification.priority")),
              ("source", F.array_join("sources", " ")), ("endpoint", F.col("endpoint_id"))]
    tests = [F.when(has(c), F.lit(n)) for n, c in fields[:-1]]
    tests += [F.when(F.col(f"_r{i}"), F.lit(n)) for i, (n, _) in enumerate(per_record)]
    tests.append(F.when(has(fields[-1][1]), F.lit("endpoint")))
    key = F.coalesce("reference", "group_id") if "reference" in groups.columns else F.col("group_id")
    return joined.select(
        "investigation_id", F.lit("activity").alias("kind"), key.alias("id"),
        F.coalesce(label(), F.lit("activity record")).alias("label"),
        F.array_compact(F.array(*tests)).alias("matched_fields")).filter(
            F.size("matched_fields") > 0)


def search_evidence(tables: dict[str, DataFrame], term: str, kinds=None, *,
                    per_kind: int | None = None) -> DataFrame:
    """Every record that mentions the term: ``kind, id, label, matched_fields``.

    ``tables`` maps surface names to tables; ``activity`` needs ``activity_records``
    next to it. Optional ``per_kind`` is a page size.
    """
    needle = (term or "").strip().lower()
    if len(needle) < MIN_TERM:
        raise ValueError(f"a search term needs at least {MIN_TERM} characters")
    wanted = set(kinds) if kinds else None
    parts = []
    for kind, df in tables.items():
        if kind == "activity_records" or (wanted and kind not in wanted):
            continue
        parts.append(_activity_hits(df, tables["activity_records"], needle)
                     if kind == "activity" else _hits(df, kind, needle))
    if not parts:
        raise ValueError("no table to search")
    found = union_sources(*parts)
    if per_kind is None:
        return found
    return cap_per_kind(found, per_kind)


def cap_per_kind(found: DataFrame, n: int) -> DataFrame:
    """A page of ``n`` per kind; ``truncated`` says whether the kind had more."""
    sizes = found.groupBy("kind").agg((F.count("*") > n).alias("truncated"))
    return first_rows(found, ["kind"], [F.col("id"), F.col("label"), F.col("investigation_id")],
                      n).join(sizes, "kind")


def search_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("hits"))


def select_activity(groups: DataFrame, records: DataFrame, predicates) -> DataFrame:
    """Activities selected by predicates over their own fields or any of their records'."""
    for predicate in predicates or ():
        validate_predicate(predicate)
        tests = list(comparisons(predicate))
        flags = records.select("group_id", *[predicate_column(records, t).alias(f"_p{i}")
                                             for i, t in enumerate(tests)])
        any_hit = reduce(lambda a, b: a | b, [F.col(f"_p{i}") for i in range(len(tests))])
        held = flags.filter(any_hit).groupBy("group_id").agg(
            *[F.bool_or(f"_p{i}").alias(f"_p{i}") for i in range(len(tests))])
        counter = iter(range(len(tests)))

        def tree(node, base):
            if node["type"] == "comparison":
                at = next(counter)
                return predicate_column(base, node) | F.coalesce(F.col(f"_p{at}"), F.lit(False))
            if node["type"] == "not":
                return ~tree(node["operand"], base)
            parts = [tree(operand, base) for operand in node["operands"]]
            return reduce((lambda a, b: a & b) if node["type"] == "and" else (lambda a, b: a | b),
                          parts)
        joined = groups.join(held, "group_id", "left")
        groups = joined.filter(tree(predicate, groups)).select(*groups.columns)
    return groups


def select_surfaces(tables: dict[str, DataFrame], predicates) -> DataFrame:
    """What the predicates select on each surface: ``kind, id, label``. Nothing is removed.

    Without a predicate no filter was applied, so nothing counts as selected.
    """
    parts = []
    for kind, df in tables.items():
        if kind == "activity_records":
            continue
        if kind == "activity":
            kept = select_activity(df, tables["activity_records"], predicates)
            key = (F.coalesce("reference", "group_id") if "reference" in kept.columns
                   else F.col("group_id"))
            parts.append(kept.select("investigation_id", F.lit(kind).alias("kind"),
                                     key.alias("id"), label().alias("label")))
            continue
        key, text = (c if c in df.columns else IDENTITY[kind][1] for c in IDENTITY[kind])
        kept = select_where(df, predicates)
        scope = F.col("investigation_id") if "investigation_id" in df.columns else F.lit(None)
        parts.append(kept.select(scope.cast("string").alias("investigation_id"),
                                 F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"),
                                 F.coalesce(F.col(text), F.col(key)).cast("string").alias("label")))
    found = union_sources(*parts)
    return found if predicates else found.filter(F.lit(False))
