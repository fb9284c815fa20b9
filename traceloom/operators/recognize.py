"""What a path is, from package, snap and installation-layout tables, never from its name."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab as V
from .events import union_sources

RESULT = ("recognized", "recognized_name", "category", "description", "version", "confidence",
          "basis_codes", "source", "resolved_from", "limitations")


def fold_path(path) -> Column:
    """Forward slashes, no repeats anywhere (the spelling package lists use)."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")


def _text(value=None) -> Column:
    return F.lit(value).cast("string")


def match_packages(paths: DataFrame, package_paths: DataFrame, packages: DataFrame) -> DataFrame:
    """Exact path in the package list, with the package's details when known."""
    owned = package_paths.groupBy("endpoint_id", F.col("path").alias("candidate")).agg(
        F.min("package").alias("package"))
    details = packages.groupBy("endpoint_id", "package").agg(
        F.max_by(F.struct("version", "section", "description"), "version").alias("_d"))
    hit = paths.join(owned, ["endpoint_id", "candidate"]).join(
        details, ["endpoint_id", "package"], "left")
    return hit.select(
        "endpoint_id", "path", "candidate", F.lit(1).alias("layer"),
        F.col("package").alias("recognized_name"),
        F.coalesce("_d.section", F.lit("operating system package")).alias("category"),
        F.col("_d.description").alias("description"), F.col("_d.version").alias("version"),
        F.lit("HIGH").alias("confidence"), F.lit("package_manager_ownership").alias("basis"),
        F.concat_ws(" ", F.lit("dpkg package"), "package", "_d.version").alias("source"))


def match_snaps(paths: DataFrame, snaps: DataFrame, *, root=V.SNAP_ROOT) -> DataFrame:
    """First segment below the snap root names an installed snap."""
    inside = paths.withColumn("name", F.when(
        F.startswith("candidate", F.lit(root + "/")),
        F.substring_index(F.expr(f"substring(candidate, {len(root) + 2})"), "/", 1)))
    known = snaps.select("endpoint_id", "name", F.coalesce("title", "name").alias("title"),
                         "version", "meta_path")
    return inside.filter("name IS NOT NULL").join(known, ["endpoint_id", "name"]).select(
        "endpoint_id", "path", "candidate", F.lit(2).alias("layer"),
        F.col("title").alias("recognized_name"), F.lit("snap package").alias("category"),
        _text().alias("description"), "version", F.lit("HIGH").alias("confidence"),
        F.lit("snap_metadata").alias("basis"),
        F.concat(F.lit("snap metadata at "), "meta_path").alias("source"))


def match_vendors(paths: DataFrame, vendors: list[dict], inventory: DataFrame) -> DataFrame:
    """The first layout whose fragment is in the path and whose marker file exists.

    ``vendors`` is the short descriptor list, so ``contains`` runs as one
    expression per row; only the marker check is a join.
    """
    fields = "array<struct<ord:int,name:string,category:string,confidence:string,root:string," \
             "marker:string,key:string,pattern:string>>"
    options = []
    for at, v in enumerate(vendors):
        fragment = v.get("path_contains")
        if not fragment:
            continue
        root = F.rtrim(F.substring(
            F.col("candidate"), F.lit(1),
            F.instr("candidate", fragment) + F.lit(len(fragment) - 1)), F.lit("/"))
        marker = (F.concat(root, F.lit("/" + v["marker"])) if v.get("marker") else _text())
        options.append(F.when(F.col("candidate").contains(fragment), F.struct(
            F.lit(at).alias("ord"), F.lit(v["name"]).alias("name"),
            F.lit(v.get("category", "application")).alias("category"),
            F.lit(v.get("confidence", "MODERATE")).alias("confidence"), root.alias("root"),
            marker.alias("marker"), _text(v.get("version_json_key")).alias("key"),
            _text(v.get("version_regex")).alias("pattern"))))
    found = F.array_compact(F.array(*options)) if options else F.array()
    rows = paths.withColumn("v", F.explode(found.cast(fields)))
    text = F.col("text") if "text" in inventory.columns else _text()
    files = inventory.select("endpoint_id", F.col("path").alias("_marker"),
                             text.alias("_text")).groupBy("endpoint_id", "_marker").agg(
                                 F.max("_text").alias("_text"), F.lit(True).alias("_there"))
    joined = rows.withColumn("_marker", F.col("v.marker")).join(
        files, ["endpoint_id", "_marker"], "left").filter(
            F.col("v.marker").isNull() | F.col("_there"))
    first_line = F.regexp_extract(F.trim("_text"), r"^[^\r\n]*", 0)
    version = (F.when(F.col("v.key").isNotNull(), F.call_function(
        "get_json_object", F.col("_text"), F.concat(F.lit("$."), F.col("v.key"))))
        .when(F.col("v.pattern").isNotNull(), F.call_function(
            "regexp_extract", F.col("_text"), F.col("v.pattern"), F.lit(1)))
        .otherwise(first_line))
    return joined.select(
        "endpoint_id", "path", "candidate", F.lit(3).alias("layer"),
        F.col("v.name").alias("recognized_name"), F.col("v.category").alias("category"),
        _text().alias("description"), F.nullif(version, F.lit("")).alias("version"),
        F.col("v.confidence").alias("confidence"), F.lit("vendor_layout").alias("basis"),
        F.concat(F.col("v.name"), F.lit(" installation at "), F.col("v.root")).alias("source"),
        F.col("v.ord").alias("ord"))


def recognize(paths: DataFrame, *, package_paths: DataFrame, packages: DataFrame,
              snaps: DataFrame | None = None, vendors: list[dict] = (),
              inventory: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One result per distinct (host, path): package, snap, layout, link target, location.

    ``links(endpoint_id, path, target)`` lets a second pass answer for a link's
    target. Distinct paths are taken first, so hot images cost one lookup.
    """
    wanted = paths.select("endpoint_id", fold_path("path").alias("path")).filter(
        F.coalesce("path", F.lit("")) != "").distinct()
    candidates = wanted.withColumn("candidate", F.col("path")).withColumn("hop", F.lit(0))
    if links is not None:
        targets = links.select("endpoint_id", fold_path("path").alias("path"),
                               fold_path("target").alias("candidate")).filter(
                                   "path <> candidate").groupBy("endpoint_id", "path").agg(
                                       F.min("candidate").alias("candidate"))
        candidates = candidates.unionByName(
            wanted.join(targets, ["endpoint_id", "path"]).withColumn("hop", F.lit(1)))
    look = candidates.select("endpoint_id", "path", "candidate")
    hits = [match_packages(look, package_paths, packages)]
    if snaps is not None:
        hits.append(match_snaps(look, snaps))
    if vendors and inventory is not None:
        hits.append(match_vendors(look, list(vendors), inventory))
    found = union_sources(*hits)
    if "ord" not in found.columns:
        found = found.withColumn("ord", F.lit(None).cast("int"))
    found = found.withColumn("hop", (F.col("path") != F.col("candidate")).cast("int"))
    best = found.groupBy("endpoint_id", "path").agg(F.min_by(
        F.struct("recognized_name", "category", "description", "version", "confidence", "basis",
                 "source", "candidate", "hop"),
        F.struct("hop", "layer", F.coalesce("ord", F.lit(0)).alias("o"), "candidate")).alias("b"))
    joined = wanted.join(best, ["endpoint_id", "path"], "left")
    hit = F.col("b").isNotNull()
    writable = F.lit(False)
    for prefix in V.WORLD_WRITABLE_PREFIXES:
        writable = writable | F.startswith("path", F.lit(prefix))
    managed = F.lit(False)
    for prefix in V.MANAGED_LOCATIONS:
        managed = managed | F.startswith("path", F.lit(prefix))
    placed = ~hit & ~writable & managed
    return joined.select(
        "endpoint_id", "path", hit.alias("recognized"), "b.recognized_name",
        F.when(placed, "unattributed file in an OS-managed location").otherwise(
            F.col("b.category")).alias("category"), "b.description", "b.version",
        F.when(hit, F.col("b.confidence")).when(placed, "LOW").otherwise("NONE").alias(
            "confidence"),
        F.when(hit, F.array("b.basis")).when(placed, F.array(F.lit("trusted_system_location")))
        .otherwise(F.array().cast("array<string>")).alias("basis_codes"),
        F.when(placed, "filesystem location").otherwise(F.col("b.source")).alias("source"),
        F.when(F.col("b.hop") == 1, F.col("path")).alias("resolved_from"),
        F.array(F.when(hit, "what the tables record, not what the bytes are now")
                .when(writable, "unaccounted for, in a world-writable place")
                .when(placed, "says where the file is, not what it is")
                .otherwise("nothing accounts for this path")).alias("limitations"))


def attach_recognition(rows: DataFrame, results: DataFrame, path="executable") -> DataFrame:
    """Adds the ``recognition`` struct to events (by image, never by name) or artifacts."""
    look = results.select("endpoint_id", F.col("path").alias("_folded"),
                          F.struct(*RESULT).alias("recognition"))
    return rows.withColumn("_folded", fold_path(path)).join(
        look, ["endpoint_id", "_folded"], "left").drop("_folded")


def recognized_software(recognized: DataFrame) -> DataFrame:
    """Count per recognized name and confidence."""
    return recognized.filter(F.coalesce("recognition.recognized", F.lit(False))).groupBy(
        "investigation_id", F.col("recognition.recognized_name").alias("name"),
        F.col("recognition.confidence").alias("confidence")).agg(F.count("*").alias("occurrences"))
