"""The finding shape, its numbering and its statistics."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .events import union_sources
from .ordering import number_rows
from .events import padded

REFERENCE = "struct<kind:string,id:string,source:string,path:string,hash:string,detail:string>"
FINDING_COLUMNS = ("investigation_id", "endpoint_id", "category", "severity", "title",
                   "explanation", "confidence", "classification", "triage", "corroborated",
                   "priority", "priority_rank", "category_rank", "recommended_action", "unknowns",
                   "why", "evidence_references", "subject", "ts")


def cite(kind, identifier, *, source=None, path=None, hash=None, detail=None) -> Column:
    def text(value):
        return (value if isinstance(value, Column) else F.lit(value)).cast("string")
    return F.struct(text(kind).alias("kind"), text(identifier).alias("id"),
                    text(source).alias("source"), text(path).alias("path"),
                    text(hash).alias("hash"), text(detail).alias("detail")).cast(REFERENCE)


def finding(df: DataFrame, category, severity, title, explanation, *, confidence, classification,
            references, triage=V.NEEDS_REVIEW, corroborated=False, why=None, action=None,
            unknowns=(), subject="") -> DataFrame:
    """Project rows into findings. Column or plain values are both accepted.

    ``references`` is a list of :func:`cite` Columns; null entries are left out.
    ``subject`` is what a finding is about, used to order findings of one rule.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)        # noqa: E731
    cited = (F.array_compact(F.array(*references)) if isinstance(references, (list, tuple))
             else references)
    have = [c for c in ("investigation_id", "endpoint_id") if c in df.columns]
    staged = df.select(
        *have, lit(category).alias("category"), lit(severity).alias("severity"),
        lit(title).cast("string").alias("title"), lit(explanation).cast("string").alias(
            "explanation"), lit(confidence).alias("confidence"),
        lit(classification).alias("classification"), lit(triage).alias("triage"),
        F.coalesce(lit(corroborated), F.lit(False)).alias("corroborated"),
        lit(action).cast("string").alias("recommended_action"),
        F.array(*[lit(u) for u in unknowns]).cast("array<string>").alias("unknowns"),
        lit(why if why is not None else explanation).cast("string").alias("why"),
        cited.cast(f"array<{REFERENCE}>").alias("evidence_references"),
        lit(subject).cast("string").alias("subject"), F.lit(None).cast("timestamp").alias("ts"))
    kinds = F.transform("evidence_references", lambda r: r["kind"])
    ranked = staged.withColumn("priority", X.finding_priority("triage", kinds, "corroborated"))
    ranked = ranked.withColumn("priority_rank", X.priority_rank("priority")).withColumn(
        "category_rank", X.category_rank("triage"))
    for scope in ("investigation_id", "endpoint_id"):
        if scope not in have:
            ranked = ranked.withColumn(scope, F.lit(None).cast("string"))
    return ranked.select(*FINDING_COLUMNS)


def all_findings(*groups: DataFrame) -> DataFrame:
    """Findings of every rule in one table, numbered ``F-0001`` on per investigation.

    The first table is ordered by urgency, the others follow in the order given.
    """
    tagged = [g.withColumn("_group", F.lit(i)) for i, g in enumerate(groups)]
    everything = union_sources(*tagged)
    urgent = F.when(F.col("_group") == 0, F.col("priority_rank")).otherwise(0)
    order = [F.col("_group"), urgent,
             F.when(F.col("_group") == 0, F.col("category_rank")).otherwise(0),
             F.col("category"), F.col("endpoint_id"), F.col("subject"), F.col("title")]
    numbered = number_rows(everything, ["investigation_id"], order, "_n")
    return numbered.withColumn("reference", padded(F.lit("F"), F.col("_n"))).drop("_n", "_group")


def finding_statistics(findings: DataFrame) -> DataFrame:
    """Counts by severity, category, triage and priority, per investigation."""
    facets = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (
        ("severity", "severity"), ("category", "category"), ("triage", "triage"),
        ("priority", "priority"))])
    return findings.select("investigation_id", F.inline(facets)).groupBy(
        "investigation_id", "facet", "value").agg(F.count("*").alias("findings"))


def finding_evidence(findings: DataFrame) -> DataFrame:
    """One row per (finding, cited reference)."""
    return findings.select("investigation_id", "endpoint_id",
                           F.col("reference").alias("finding"), F.inline("evidence_references"))


def findings_with_citations(findings: DataFrame, cited: DataFrame, *, shown=50) -> DataFrame:
    """Each finding with its cited evidence in order; none cited gives an empty array.

    ``shown`` bounds the array on the finding row; ``citations`` counts all of them.
    """
    from .ordering import first_rows
    keys = ["investigation_id", "finding"]
    counts = cited.groupBy(*keys).agg(F.count("*").alias("citations"))
    few = first_rows(cited, keys, [F.col("kind"), F.col("id")], shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("kind", "id"))).alias("evidence"))
    ready = findings.withColumn("finding", F.col("reference"))
    return (ready.join(counts, keys, "left").join(few, keys, "left")
            .withColumn("citations", F.coalesce("citations", F.lit(0)))
            .withColumn("evidence", F.coalesce("evidence", F.array().cast(
                "array<struct<kind:string,id:string>>"))).drop("finding"))
