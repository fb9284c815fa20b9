"""An index of trigrams over every searched surface, written once and read by its postings.

Rows say what a hit shows; places say in which field of which row a text stands; texts are distinct, so a value that a
third of all rows share (a host, a user) is indexed once. Postings hold the distinct trigrams of each text, laid out by
gram: a search reads the files of its term's grams alone, keeps the texts that have them all, and tests those exactly.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from .activity import label
from .events import union_sources
from .search import IDENTITY, MIN_TERM, SURFACES, _column, cap_per_kind

GRAM, BUCKETS = 3, 64
#: What an activity is found by, in the order it is reported: its own columns, then its records', then its host.
_ACTIVITY = (("command", "full_command_line"), ("normalized command", "normalized_command"), ("executable", "executable"),
             ("process name", "process_name"), ("evidence kind", "evidence_kind"),
             ("classification", "classification.category"), ("presentation", "classification.presentation"),
             ("priority", "classification.priority"), ("source", "sources"))
_RECORDS = (("user", "user"), ("evidence id", "reference"))


def _fields(df: DataFrame, columns, first: int = 0):
    """Filled fields as ``(at, field, text)``; ``at`` is the place in the order of reporting."""
    def text(c):
        return F.array_join(c, " ") if c == "sources" else (F.col(c) if "." in c else _column(df, c))

    return F.filter(F.array(*[
        F.struct(F.lit(first + i).alias("at"), F.lit(name).alias("field"), F.lower(text(c)).alias("text"))
        for i, (name, c) in enumerate(columns) if c.split(".")[0] in df.columns]), lambda f: f["text"].isNotNull())


def _rows(df: DataFrame, kind: str) -> DataFrame:
    """``(kind, row, investigation_id, id, label, fields)`` of a surface."""
    scope = F.col("investigation_id") if "investigation_id" in df.columns else F.lit(None)
    if kind == "activity":
        key = F.coalesce("reference", "group_id") if "reference" in df.columns else F.col("group_id")
        row, shown = F.col("group_id"), F.coalesce(label(), F.lit("activity record"))
        fields = F.concat(_fields(df, _ACTIVITY), _fields(df, [("endpoint", "endpoint_id")], 99))
    else:
        have = [c for c in IDENTITY[kind] if c in df.columns]
        row, key = F.uuid(), F.col(have[0])
        shown = F.coalesce(*[F.col(c).cast("string") for c in reversed(have)])
        fields = _fields(df, SURFACES[kind])
    return df.select(F.lit(kind).alias("kind"), row.alias("row"), scope.cast("string").alias("investigation_id"),
                     key.cast("string").alias("id"), shown.alias("label"), fields.alias("fields"))


def grams(text) -> F.Column:
    """The distinct runs of three characters of a text; a shorter text has none."""
    last = F.char_length(text) - (GRAM - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(
            F.array().cast("array<string>"))


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_search_index(tables: dict[str, DataFrame], path: str) -> None:
    """Index the surfaces of :func:`search_evidence`; ``activity`` needs ``activity_records`` next to it."""
    root, parts = path.rstrip("/"), [_rows(df, kind) for kind, df in tables.items() if kind != "activity_records"]
    if not parts:
        raise ValueError("no table to index")
    spark = parts[0].sparkSession
    union_sources(*parts).write.partitionBy("kind").parquet(f"{root}/rows")
    places = spark.read.parquet(f"{root}/rows").select("kind", "row", F.explode("fields").alias("f")).select(
        "kind", "row", "f.*")
    if "activity" in tables:
        records = tables["activity_records"]
        places = places.unionByName(records.select(
            F.lit("activity").alias("kind"), F.col("group_id").alias("row"),
            F.explode(_fields(records, _RECORDS, len(_ACTIVITY))).alias("f")).select("kind", "row", "f.*").distinct())
    # 128 bits name a text; the places of one text lie together, so that files can be told apart by its name
    places.withColumn("h", F.unhex(F.md5("text"))).write.parquet(f"{root}/named")
    named = spark.read.parquet(f"{root}/named")
    named.drop("text").hint("rebalance", "h").sortWithinPartitions("h").write.parquet(f"{root}/places")
    named.groupBy("h").agg(F.first("text").alias("text")).sortWithinPartitions("h").write.parquet(f"{root}/texts")
    texts = spark.read.parquet(f"{root}/texts")
    (texts.select("h", F.explode(grams(F.col("text"))).alias("gram")).withColumn("bucket", _bucket("gram"))
     .hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
     .write.partitionBy("bucket").parquet(f"{root}/postings"))


def candidate_texts(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """``(h)`` of the texts that have every trigram of the term, from the postings of these alone.

    All texts if the term is shorter than a trigram.
    """
    root = path.rstrip("/")
    own = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    if not own:
        return spark.read.parquet(f"{root}/texts").select("h")
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in own], "g string").select(_bucket("g")).collect()]
    postings = spark.read.schema("h binary, gram string, bucket int").parquet(f"{root}/postings")
    return (postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(own))
            .groupBy("h").count().filter(F.col("count") == len(own)).select("h"))


def search_index(spark: SparkSession, path: str, term: str, kinds=None, *, per_kind: int | None = None) -> DataFrame:
    """What :func:`search_evidence` finds over the tables the index was written from."""
    needle, root = (term or "").strip().lower(), path.rstrip("/")
    if len(needle) < MIN_TERM:
        raise ValueError(f"a search term needs at least {MIN_TERM} characters")
    rows, places = spark.read.parquet(f"{root}/rows").drop("fields"), spark.read.parquet(f"{root}/places")
    if kinds:
        rows, places = (df.filter(F.col("kind").isin(list(kinds))) for df in (rows, places))
    holding = spark.read.parquet(f"{root}/texts").join(candidate_texts(spark, root, needle), "h").filter(
        F.col("text").contains(needle)).select("h")
    fields = places.join(holding, "h").groupBy("kind", "row").agg(
        F.array_sort(F.collect_set(F.struct("at", "field"))).alias("found"))         # as many as a surface has fields
    hits = rows.join(fields, ["kind", "row"]).select(
        "investigation_id", "kind", "id", "label", F.col("found.field").alias("matched_fields"))
    return hits if per_kind is None else cap_per_kind(hits, per_kind)
