"""The same observable on more than one host, and endpoint bookkeeping."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import functions as X
from .. import vocab as V
from .events import union_sources
from .ordering import first_rows


def filter_addresses(address) -> Column:
    address = F.col(address) if isinstance(address, str) else address
    keep = (F.coalesce(address, F.lit("")) != "") & ~address.isin(
        list(V.UNINTERESTING_ADDRESSES))
    for prefix in V.UNINTERESTING_PREFIXES:
        keep = keep & ~address.startswith(prefix)
    return F.coalesce(keep, F.lit(False))


def filter_device_serials(serial, removable) -> Column:
    serial = F.trim(F.col(serial) if isinstance(serial, str) else serial)
    removable = F.col(removable) if isinstance(removable, str) else removable
    return F.coalesce((F.length(serial) >= V.MIN_SERIAL_LENGTH)
                      & ~F.lower(serial).isin(list(V.PLACEHOLDER_SERIALS))
                      & ~serial.contains(":") & ~serial.rlike(r"^0+\z")
                      & (removable == "removable"), F.lit(False))


def _observable(df, kind, key, detail, abused=None) -> DataFrame:
    return df.select("endpoint_id", F.lit(kind).alias("kind"), key.alias("key"),
                     (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
                     (abused if abused is not None else F.lit(False)).alias("known_abused"))


def fleet_observables(results: dict[str, DataFrame], extra=()) -> DataFrame:
    """``(endpoint_id, kind, key, detail, known_abused)`` from per-source tables.

    ``results`` may hold ``connections(remote_address)``, ``drivers(name, risk_status)``,
    ``downloads(target_path, url)``, ``devices(serial, vendor, product, removable)`` and
    ``artifacts(hash, path)``; ``extra`` adds tables already in the output shape.
    """
    parts = list(extra)
    if "connections" in results:
        rows = results["connections"].withColumn("_host", X.remote_host("remote_address"))
        parts.append(_observable(rows.filter(filter_addresses("_host")), "remote_address",
                                 F.col("_host"), F.col("remote_address")))
    if "drivers" in results:
        rows = results["drivers"].filter(F.coalesce("name", F.lit("")) != "")
        parts.append(_observable(rows, "driver", F.col("name"), F.col("sha256"), F.coalesce(
            F.col("risk_status") == V.MATCHED, F.lit(False))))
    if "downloads" in results:
        rows = results["downloads"].withColumn("_key", X.download_key("target_path", "url"))
        parts.append(_observable(rows.filter("_key IS NOT NULL"), "download", F.col("_key"),
                                 F.col("url")))
    if "devices" in results:
        rows = results["devices"].filter(filter_device_serials("serial", "removable"))
        known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
        parts.append(_observable(rows, "usb_device", F.concat(
            known("vendor"), F.lit(" "), known("product"), F.lit(" ["), F.trim("serial"),
            F.lit("]")), F.trim("serial")))
    if "artifacts" in results:
        rows = results["artifacts"].filter(F.coalesce("hash", F.lit("")) != "")
        parts.append(_observable(rows, "file_hash", F.col("hash"), F.col("path")))
    return union_sources(*parts)


def observable_endpoints(observables: DataFrame) -> DataFrame:
    """Distinct (kind, key, endpoint) with how often it was seen: the whole membership."""
    return observables.groupBy("kind", "key", "endpoint_id").agg(
        F.count("*").alias("observations"), F.bool_or("known_abused").alias("known_abused"))


def fleet_correlation(observables: DataFrame, endpoints: DataFrame, *, min_endpoints=2,
                      top_per_kind: int | None = None) -> DataFrame:
    """Keys seen on several hosts. Drivers on every host are left out unless known-abused.

    ``endpoints`` lists the hosts that contributed. Hosts of a key are in
    :func:`observable_endpoints`; a row here only counts them.
    """
    total = endpoints.select(F.countDistinct("endpoint_id")).scalar()
    shared = observable_endpoints(observables).groupBy("kind", "key").agg(
        F.count("*").alias("endpoint_count"), F.sum("observations").alias("observations"),
        F.bool_or("known_abused").alias("notable")).filter(
            F.col("endpoint_count") >= min_endpoints)
    rated = shared.select(
        "kind", "key", "endpoint_count", "observations",
        F.round(F.col("endpoint_count") / F.greatest(total, F.lit(1)), 3).alias("prevalence"),
        (F.col("endpoint_count") == total).alias("ubiquitous"), "notable")
    kept = rated.filter(~_standard_build())
    if top_per_kind is None:
        return kept
    return first_rows(kept, ["kind"], [F.col("notable").desc(), F.col("prevalence"),
                                       F.col("key")], top_per_kind)


def _standard_build() -> Column:
    return (F.col("kind") == "driver") & F.col("ubiquitous") & ~F.col("notable")


def suppressed_observables(observables: DataFrame, endpoints: DataFrame) -> DataFrame:
    """How many keys per kind were left out as the fleet's standard build."""
    total = endpoints.select(F.countDistinct("endpoint_id")).scalar()
    return observable_endpoints(observables).groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.bool_or("known_abused").alias("notable")).withColumn(
            "ubiquitous", (F.col("n") == total) & (F.col("n") >= 2)).filter(
                _standard_build()).groupBy("kind").agg(F.count("*").alias("suppressed"))


def endpoint_names(rows: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Adds ``endpoint``: the display name, else the id."""
    names = endpoints.select("endpoint_id", F.col("name").alias("_name"))
    return rows.join(names, "endpoint_id", "left").withColumn(
        "endpoint", F.coalesce(F.nullif("_name", F.lit("")), "endpoint_id")).drop("_name")


def endpoint_task_counts(tasks: DataFrame) -> DataFrame:
    statuses = [V.QUEUED, V.DISPATCHED, V.SUCCEEDED, V.FAILED, V.ABANDONED]
    return tasks.groupBy("endpoint_id").pivot("status", statuses).count().na.fill(0, statuses)


def sweep_tasks(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks after a sweep; ``swept`` says which ones changed."""
    moment = F.lit(as_of).cast("timestamp")
    after = X.swept_task_state("status", "dispatched_at", "attempts", "max_attempts", moment)
    return tasks.withColumn("new_status", after).withColumn(
        "swept", F.col("new_status") != F.col("status")).withColumn(
        "available_at", F.when(F.col("swept") & (F.col("new_status") == V.QUEUED),
                               moment + F.make_dt_interval(secs=F.lit(V.RETRY_DELAYS[0]))))


def endpoint_health(endpoints: DataFrame, as_of) -> DataFrame:
    return endpoints.withColumn("state", X.endpoint_health(
        "status", "last_seen", F.lit(as_of).cast("timestamp")))
