"""Stored tables replayed as streams that are run to their end, stopped and taken up again."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import STREAMING, new_folder, written


def streaming_session(spark: SparkSession, settings: dict[str, str] | None = None) -> SparkSession:
    """A session on the same context with settings of its own, for streams with keyed state."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    for key, value in (STREAMING | (settings or {})).items():
        own.conf.set(key, value)
    return own


def replay(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]],
           build: Callable[[dict[str, DataFrame]], DataFrame], *, runs: int = 3,
           closing: dict[str, DataFrame] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """What ``build(streams)`` tells of ``tables``, ``{name: (table, its column of time)}``, as a table.

    The time that all tables span is cut into ``runs`` equal parts, oldest first. For each part its rows are added to the
    folders the streams read (rows without a time come first), and the query runs until they are read and all timers
    that the watermark reaches have fired; the next run goes on from its state. ``closing`` rows come in a last run. ``settings`` are the
    stream's own.
    """
    own, out, progress = streaming_session(spark, settings), new_folder(spark, "stream"), new_folder(spark, "progress")
    rows = {name: written(df) for name, (df, _) in tables.items()}
    moments = {name: F.col(column).cast("timestamp") for name, (_, column) in tables.items()}
    folders = {name: new_folder(spark, f"replay-{name}") for name in tables}
    spans = [rows[n].agg(F.unix_micros(F.min(m)), F.unix_micros(F.max(m))).first() for n, m in moments.items()]
    low, high = (f((x for x in ends if x is not None), default=0) for f, ends in zip((min, max), zip(*spans)))
    edges = [low + (high - low) * n // runs for n in range(1, runs)]

    def run() -> None:
        streams = {name: own.readStream.schema(rows[name].schema).parquet(folders[name]) for name in tables}
        query = (build(streams).writeStream.format("parquet").option("checkpointLocation", progress)
                 .outputMode("append").trigger(availableNow=True).start(out))
        query.awaitTermination()

    for before, until in zip([None, *edges], [*edges, None]):
        for name, moment in moments.items():
            at, kept = F.unix_micros(moment), F.lit(True)
            if before is not None:
                kept = kept & (at > before)
            if until is not None:
                kept = kept & (at <= until)
            if before is None:
                kept = kept | at.isNull()
            rows[name].filter(kept).write.mode("append").parquet(folders[name])
        run()
    if closing:
        for name, last in closing.items():
            last.write.mode("append").parquet(folders[name])
        run()
    schema = build({name: own.readStream.schema(rows[name].schema).parquet(folders[name]) for name in tables}).schema
    return spark.read.schema(schema).parquet(out)
