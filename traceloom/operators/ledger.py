"""Digest history per file, registrations, and checks of what is there now."""

from pyspark.sql import DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .ordering import first_rows, previous_value


def _tie(df):
    return [F.col(c) for c in ("seq", "hash", "algorithm", "size_bytes") if c in df.columns]


def hash_history(observations: DataFrame) -> DataFrame:
    """Each observation with the one before it at the same path, and what changed."""
    keys = ["endpoint_id", "path"]
    before = previous_value(
        observations, keys, [F.col("ts"), *_tie(observations)],
        F.struct("hash", "algorithm", "ts"), "_before")
    return before.withColumn("status", X.compare_hash(
        F.col("_before.hash"), F.col("_before.algorithm"), "hash", "algorithm")).withColumn(
        "previous_hash", F.col("_before.hash")).withColumn(
        "previous_ts", F.col("_before.ts")).drop("_before")


def trim_history(observations: DataFrame, *, keep: int) -> DataFrame:
    """The newest ``keep`` observations per path; map tasks drop the rest before the shuffle."""
    order = [F.col("ts").desc(), *[c.desc() for c in _tie(observations)]]
    return first_rows(observations, ["endpoint_id", "path"], order, keep)


def latest_hash(observations: DataFrame) -> DataFrame:
    """The last observation per path, by partial aggregate."""
    best = F.max_by(F.struct("hash", "algorithm", "ts"), F.struct("ts", *_tie(observations)))
    return observations.groupBy("endpoint_id", "path").agg(best.alias("_b")).select(
        "endpoint_id", "path", "_b.*")


def supersedes(registrations: DataFrame) -> DataFrame:
    """Per registration, the latest earlier one with the same digest."""
    held = registrations.filter("sha256 IS NOT NULL")
    linked = previous_value(held, ["sha256"], [F.col("registered_at"), F.col("id")],
                            F.col("id"), "supersedes")
    rest = registrations.filter("sha256 IS NULL").withColumn(
        "supersedes", F.lit(None).cast(dict(linked.dtypes)["supersedes"]))
    return linked.unionByName(rest)


def latest_per(df: DataFrame, keys, newest_first) -> DataFrame:
    """Last row per key (``newest_first`` are plain Columns, compared descending, nulls lowest)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(newest_first)])
                 ).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def verify_evidence(registered: DataFrame, observed: DataFrame) -> DataFrame:
    """Registered digests against digests observed now.

    ``observed(path, sha256, readable)`` has a row per file that is still there.
    """
    now = observed.groupBy("path").agg(F.max("sha256").alias("observed_sha256"),
                                       F.max("readable").alias("_readable"))
    joined = registered.join(now, "path", "left")
    return joined.withColumn("verification_state", F.when(
        F.col("_readable").isNull(), V.MISSING).when(~F.col("_readable"), V.UNVERIFIED).when(
        F.col("sha256").isNull() | (F.col("sha256") == F.col("observed_sha256")), V.VERIFIED)
        .otherwise(V.MISMATCH)).drop("_readable")


def verified_sources_only(verified: DataFrame):
    """``(usable, refused)``: refused rows keep the reason."""
    bad = F.col("verification_state").isin(V.MISMATCH, V.MISSING)
    refused = verified.filter(bad).withColumn("reason", F.when(
        F.col("verification_state") == V.MISSING, "no longer at its recorded path").otherwise(
        "no longer matches its registered digest"))
    return verified.filter(~bad), refused


def verify_package(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Each name in a manifest or on disk: verified, mismatched, missing or unlisted."""
    expected = manifest.select("name", F.col("sha256").alias("_want"))
    found = observed.select("name", F.col("sha256").alias("_got"))
    return expected.join(found, "name", "full_outer").select(
        "name", F.when(F.col("_want").isNull(), "unlisted").when(
            F.col("_got").isNull(), "missing").when(
            F.col("_want") != F.col("_got"), "mismatched").otherwise("verified").alias("state"))


def package_verdict(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count_if(F.col("state").isin("verified", "mismatched")).alias("files_checked"),
        F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "mismatched").alias("mismatched")).withColumn(
            "verified", (F.col("missing") == 0) & (F.col("mismatched") == 0))


def assessment_vs_machine(assessments: DataFrame, classifications: DataFrame) -> DataFrame:
    """Each assessment with the machine classification that stood when it was made.

    ``classifications(investigation_id, subject_type, subject_id, ts, category, priority)``.
    Both are put on one line per subject and the latest classification is carried
    forward, so a subject with many of both is never joined pair by pair.
    """
    from .ordering import last_value_so_far
    keys = ["investigation_id", "subject_type", "subject_id"]
    made = assessments.select(*keys, F.col("created_at").alias("_at"), F.lit(1).alias("_kind"),
                              F.struct(*assessments.columns).alias("_a"),
                              F.lit(None).cast("struct<category:string,priority:string>")
                              .alias("_c"), F.col("id").cast("string").alias("_id"))
    stood = classifications.select(
        *keys, F.col("ts").alias("_at"), F.lit(0).alias("_kind"),
        F.lit(None).cast(made.schema["_a"].dataType).alias("_a"),
        F.struct("category", "priority").alias("_c"),
        F.concat_ws("|", "category", "priority").alias("_id"))
    line = last_value_so_far(made.unionByName(stood), keys,
                             [F.col("_at"), F.col("_kind"), F.col("_id")], F.col("_c"), "_then")
    return line.filter("_kind = 1").select(
        "_a.*", F.col("_then.category").alias("machine_classification"),
        F.col("_then.priority").alias("machine_priority"))


# --- case bookkeeping -------------------------------------------------------------
def list_latest(df: DataFrame, order="created_at", *, limit: int | None = None, tie="id", **equals) -> DataFrame:
    """Newest first, narrowed by equality keys; ``limit`` keeps a page."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    ordered = df.orderBy(F.col(order).desc(), F.col(tie).desc())
    return ordered if limit is None else ordered.limit(limit)


def filter_list(investigations: DataFrame, term="", status=None) -> DataFrame:
    """Investigations whose title, device or id contains the term."""
    rows = investigations
    if term:
        safe = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        rows = rows.filter(F.col("title").ilike(f"%{safe}%") | F.col("device").ilike(f"%{safe}%")
                           | F.col("id").ilike(f"%{safe}%"))
    return rows.filter(F.col("status") == status) if status else rows


def executions_with_reports(executions: DataFrame, reports: DataFrame) -> DataFrame:
    """Each execution with its report or null, newest first where executions have a time."""
    held = reports.select(F.col("execution_id").alias("id"), F.col("id").alias("report_id"),
                          F.col("status").alias("report_status"))
    joined = executions.join(held, "id", "left")
    if "created_at" not in executions.columns:
        return joined
    return joined.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())


def completion_status(steps: DataFrame) -> DataFrame:
    """Per investigation: cancelled, partially_completed or completed."""
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))           # noqa: E731
    return steps.groupBy("investigation_id").agg(
        F.when(has("cancelled"), "cancelled").when(
            has("failed") | has("incomplete"), "partially_completed").otherwise(
            "completed").alias("status"))


def collector_versions(steps: DataFrame, executions: DataFrame) -> DataFrame:
    """Per collector, the version its evidence recorded; the execution log fills gaps."""
    seen = steps.filter("version IS NOT NULL").groupBy("collector").agg(
        F.max_by("version", F.struct("ts", "version")).alias("_recorded"))
    logged = executions.filter("version IS NOT NULL").groupBy("collector").agg(
        F.min_by("version", F.struct("ts", "version")).alias("_logged"))
    return seen.join(logged, "collector", "full_outer").select(
        "collector", F.coalesce("_recorded", "_logged").alias("version"))


def case_counts(investigations: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    ids = investigations.select("investigation_id", "case_id")
    for name, table in (("evidence", evidence), ("findings", findings)):
        counts = table.groupBy("investigation_id").agg(F.count("*").alias(name))
        ids = ids.join(counts, "investigation_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0)))
    return ids

