"""Browser history and downloads from exported profile tables."""

from pyspark.sql import DataFrame, functions as F

from .. import functions as X
from .lines import scope


def _inside(df, column, window):
    """The window keeps undated rows."""
    return df if window is None else df.filter(
        F.col(column).isNull() | (F.col(column) >= F.lit(window[0])))


def firefox_history(visits: DataFrame, places: DataFrame, *, window=None) -> DataFrame:
    at = scope(visits)
    rows = visits.select(*at, F.col("place_id"), "visit_date").join(
        places.select(*at, F.col("id").alias("place_id"), "url", "title", "visit_count"),
        [*at, "place_id"]).select(*at, "url", "title", "visit_count",
                                  X.firefox_time_to_ts("visit_date").alias("visited_at"))
    return _inside(rows, "visited_at", window)


def chromium_history(visits: DataFrame, urls: DataFrame, *, window=None) -> DataFrame:
    at = scope(visits)
    rows = visits.select(*at, F.col("url").alias("url_id"), "visit_time").join(
        urls.select(*at, F.col("id").alias("url_id"), "url", "title", "visit_count"),
        [*at, "url_id"]).select(*at, "url", "title", "visit_count",
                                X.chrome_time_to_ts("visit_time").alias("visited_at"))
    return _inside(rows, "visited_at", window)


def firefox_downloads(annos: DataFrame, places: DataFrame, attributes: DataFrame, *,
                      window=None) -> DataFrame:
    at = scope(annos)
    wanted = attributes.filter(F.col("name") == "downloads/destinationFileURI").select(
        *at, F.col("id").alias("anno_attribute_id"))
    rows = annos.join(wanted, [*at, "anno_attribute_id"], "left_semi").join(
        places.select(*at, F.col("id").alias("place_id"), "url", "last_visit_date"),
        [*at, "place_id"]).select(
            *at, "url", F.nullif(F.replace(F.col("content"), F.lit("file://"), F.lit("")),
                                 F.lit("")).alias("target_path"),
            X.firefox_time_to_ts("last_visit_date").alias("downloaded_at"))
    return _inside(rows, "downloaded_at", window)


def chromium_downloads(downloads: DataFrame, chains: DataFrame, *, window=None) -> DataFrame:
    at = scope(downloads)
    first = chains.filter("chain_index = 0").select(*at, "id", "url")
    rows = downloads.join(first, [*at, "id"], "left").select(
        *at, "url", "target_path", F.col("received_bytes").alias("size_bytes"),
        X.chrome_time_to_ts("start_time").alias("downloaded_at"))
    return _inside(rows, "downloaded_at", window)


def newest_first(rows: DataFrame, column, *, limit=None) -> DataFrame:
    """The listing order of a profile; ``limit`` is its optional page size."""
    ordered = rows.orderBy(F.col(column).desc_nulls_last(), F.col("url"))
    return ordered.limit(limit) if limit else ordered
