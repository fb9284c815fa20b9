"""Session settings and where lineage is cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Methods above this size are not compiled by HotSpot; Spark then runs operators one by one.
TUNING = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


#: What streams with keyed state need.
STREAMING = {"spark.sql.streaming.stateStore.providerClass":
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def tune(spark: SparkSession) -> None:
    """Settings the operators rely on (UTC) or run better with, on a session made elsewhere."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table that is one small file; larger tables pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build_session(app="traceloom", master=None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **TUNING, **STREAMING,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="traceloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str = "folder") -> str:
    """The path of a folder of its own, not made yet, where all executors can read and write."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the checkpoint folder and cut its lineage."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options) -> DataFrame:
    """As :func:`checkpoint`, through a parquet table; ``options`` are the writer's.

    For loops: a checkpointed plan keeps the constraints the optimizer inferred,
    and those double with every round that joins a result with itself.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "table")
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
