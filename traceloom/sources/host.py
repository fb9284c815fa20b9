"""Devices, mounts, network, drivers, services, memory, processes and files of a host."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import functions as X
from .. import vocab as V
from ..operators.events import text_map
from ..operators.ordering import last_value_so_far, number_rows
from .lines import scope, sliced, words

# --- USB -------------------------------------------------------------------------
DEVICE_ATTRIBUTES = {"idVendor": "vendor_id", "idProduct": "product_id",
                     "manufacturer": "vendor", "product": "product", "serial": "serial",
                     "removable": "removable", "version": "usb_version", "bMaxPower": "max_power"}
_IDENTITY = r"(?i)New USB device found, idVendor=([0-9a-f]{4}), idProduct=([0-9a-f]{4})"
_CONNECT = r"(?i)\bnew (?:high|full|low|super)[- ]speed USB device number ([0-9]+) using"
_DISCONNECT = r"(?i)\bUSB disconnect, device number ([0-9]+)"


def usb_devices(attributes: DataFrame) -> DataFrame:
    """``attributes(endpoint_id, device, attr, value)`` to one row per device with both ids."""
    at = scope(attributes)
    wide = attributes.filter(F.trim("value") != "").groupBy(*at, "device").pivot(
        "attr", list(DEVICE_ATTRIBUTES)).agg(F.first(F.trim("value"), ignorenulls=True))
    return wide.filter("idVendor IS NOT NULL AND idProduct IS NOT NULL").select(
        *at, "device", *[F.col(k).alias(v) for k, v in DEVICE_ATTRIBUTES.items()],
        F.lit(V.CURRENT_OBSERVATION).alias("classification"))


def usb_events(lines: DataFrame) -> DataFrame:
    """Kernel log lines to connections and disconnections.

    Name lines that follow a connection belong to it; each line takes the latest
    event at or before it, carried across slices of a long log.
    """
    at = [*scope(lines), *[c for c in ("file",) if c in lines.columns]]
    parsed = lines.withColumn("j", F.from_json("value", "MESSAGE string, `__REALTIME_TIMESTAMP` string"))
    rows = sliced(parsed.select(
        *at, "line_no", F.col("j.MESSAGE").alias("message"),
        F.timestamp_micros(F.col("j.__REALTIME_TIMESTAMP").try_cast("bigint")).alias("ts")).filter(
            "message IS NOT NULL AND ts IS NOT NULL"), at)
    take = lambda p, n=1: F.nullif(F.regexp_extract("message", p, n), F.lit(""))
    rows = rows.select("*", take(_IDENTITY).alias("vendor_id"),
                       take(_IDENTITY, 2).alias("product_id"),
                       take(_DISCONNECT).alias("device_number"),
                       take(_CONNECT).alias("_number"))
    action = F.when(F.col("_number").isNotNull(), F.lit(None).cast("string")).when(
        F.col("vendor_id").isNotNull(), "connected").when(
        F.col("device_number").isNotNull(), "disconnected")
    rows = rows.withColumn("action", action)
    carried = last_value_so_far(rows, at, [], F.when(
        F.col("action").isNotNull(), F.struct("line_no", "action")), "_event", sliced=True)
    naming = F.col("action").isNull() & F.col("_number").isNull() & (
        F.col("_event.action") == "connected")

    def named(label):
        return F.when(naming, F.nullif(F.trim(F.regexp_extract(
            "message", rf"(?i){label}: (.+?)(?:,|$)", 1)), F.lit("")))
    tagged = carried.withColumn("_p", named("Product")).withColumn(
        "_v", named("Manufacturer")).withColumn("_s", named("SerialNumber"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    own = F.col("action").isNotNull()
    pick = lambda c: F.max(F.when(own, F.col(c)))                    # noqa: E731
    return tagged.filter("_event IS NOT NULL").groupBy(
        *at, F.col("_event.line_no").alias("event_line"), F.col("_event.action").alias("action")
    ).agg(pick("ts").alias("ts"), pick("vendor_id").alias("vendor_id"),
          pick("product_id").alias("product_id"),
          F.max(F.when(own & (F.col("action") == "disconnected"), F.col("device_number"))).alias(
              "device_number"),
          latest("_p").alias("product"), latest("_v").alias("vendor"), latest("_s").alias("serial"))


def mounts(lines: DataFrame) -> DataFrame:
    """Mount table rows that look like removable media."""
    rows = lines.withColumn("w", words()).filter(F.size("w") >= 4).select(
        *scope(lines), F.col("w")[0].alias("device"), F.col("w")[1].alias("mount_point"),
        F.col("w")[2].alias("filesystem"), F.col("w")[3].alias("options"))
    placed = reduce(lambda a, b: a | b, [F.startswith("mount_point", F.lit(p))
                                         for p in V.REMOVABLE_ROOTS])
    return rows.filter(placed | (F.startswith("device", F.lit("/dev/sd"))
                                 & ~F.col("mount_point").isin("/", "/boot")))


# --- network -----------------------------------------------------------------------
def routes(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("w", words()).filter(F.size("w") >= 8).select(
        *scope(lines), F.col("w")[0].alias("interface"),
        X.hex_le_to_ipv4(F.col("w")[1]).alias("destination"),
        X.hex_le_to_ipv4(F.col("w")[2]).alias("gateway"),
        X.hex_le_to_ipv4(F.col("w")[7]).alias("mask"), F.col("w")[6].try_cast("int").alias("metric"))
    return rows.na.drop(subset=["destination", "gateway", "mask", "metric"])


def resolver(lines: DataFrame) -> DataFrame:
    """Name servers and search domains of each host, in file order."""
    rows = lines.withColumn("w", words()).filter(F.size("w") >= 2)
    at = scope(lines)
    kind = F.col("w")[0]
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(c)),
                                              lambda s: s["v"]))
    server = F.when(kind == "nameserver", F.struct("line_no", F.array(F.col("w")[1]).alias("v")))
    domain = F.when(kind.isin("search", "domain"), F.struct(
        "line_no", F.slice("w", 2, F.size("w")).alias("v")))
    return rows.filter(kind.isin("nameserver", "search", "domain")).groupBy(*at).agg(
        ordered(server).alias("nameservers"), ordered(domain).alias("search_domains"))


def normalize_interfaces(addresses: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per interface with its addresses as an array."""
    at = [*scope(addresses), "name"]
    listed = addresses.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(
        "family", "address", "netmask", "broadcast"))).alias("addresses"))
    return listed.join(stats.select(*at, "is_up", "mtu", F.nullif(
        "speed_mbps", F.lit(0)).alias("speed_mbps")), at, "left")


def normalize_connections(sockets: DataFrame) -> DataFrame:
    """Socket rows to ``ip:port`` text; ``listening`` splits the two listings."""
    join = lambda ip, port: F.when(F.col(ip).isNotNull(), F.concat_ws(
        ":", ip, F.col(port).cast("string")))
    return sockets.select(
        *scope(sockets), "family", "kind", join("local_ip", "local_port").alias("local_address"),
        join("remote_ip", "remote_port").alias("remote_address"), "remote_port", "status", "pid",
        F.nullif("process_name", F.lit("")).alias("process_name"),
        (F.col("status") == "LISTEN").alias("listening"),
        F.lit(V.CURRENT_OBSERVATION).alias("classification"))


def network_statistics(connections: DataFrame) -> DataFrame:
    open_ = ~F.col("listening")
    return connections.groupBy("endpoint_id").agg(
        F.count_if("listening").alias("listening_count"),
        F.count_if(open_).alias("connection_count"),
        F.count_if(open_ & F.col("process_name").isNotNull()).alias("connections_with_process"),
        F.count_if(F.col("pid").isNotNull() & F.col("process_name").isNull()).alias(
            "owner_unknown"))


# --- drivers and services ------------------------------------------------------------
def kernel_modules(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("w", words()).filter(F.size("w") >= 4)
    users = F.col("w")[3]
    return rows.select(
        *scope(lines), F.col("w")[0].alias("name"), F.lit("kernel_module").alias("kind"),
        F.when(F.col("w")[1].rlike("^[0-9]+$"), F.col("w")[1].try_cast("bigint")).alias(
            "size_bytes"),
        F.when(users != "-", F.trim(users, F.lit(","))).alias("used_by"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("sha256"))


def driver_statistics(verified: DataFrame) -> DataFrame:
    return verified.groupBy("endpoint_id").agg(
        F.count("*").alias("drivers_inventoried"),
        *[F.count_if(F.col("risk_status") == s).alias(n) for s, n in (
            (V.MATCHED, "matched"), (V.NOT_MATCHED, "not_matched"), (V.UNKNOWN, "unknown"))])


def service_units(documents: DataFrame) -> DataFrame:
    """``documents(endpoint_id, value)``: a JSON array of unit rows each."""
    schema = "array<struct<unit:string,load:string,active:string,sub:string,description:string>>"
    return documents.select(*scope(documents), F.inline(F.from_json("value", schema)))


def cron_jobs(lines: DataFrame) -> DataFrame:
    """Schedule lines: a shortcut, a number or a star first; comments and settings are not."""
    text = F.trim("value")
    return lines.withColumn("_t", text).filter(
        F.col("_t").rlike(r"^(@|[0-9*])")).select(
            *scope(lines), F.col("file").alias("schedule_file"), F.col("line_no").alias("line"),
            F.col("_t").alias("entry"))


def service_statistics(units: DataFrame, jobs: DataFrame) -> DataFrame:
    active = units.groupBy("endpoint_id").agg(
        F.count("*").alias("units"), F.count_if(F.col("active") == "active").alias("active"))
    planned = jobs.groupBy("endpoint_id").agg(F.count("*").alias("scheduled_jobs"))
    return active.join(planned, "endpoint_id", "full_outer").na.fill(0)


# --- memory ---------------------------------------------------------------------------
def _first_of(row: Column, *keys) -> Column:
    return F.coalesce(*[F.try_element_at(row, F.lit(k)) for k in keys])


def _first_filled(row: Column, *keys) -> Column:
    return F.coalesce(*[F.nullif(F.nullif(F.try_element_at(row, F.lit(k)), F.lit("")), F.lit("0"))
                        for k in keys])


def normalize_memory(rows: DataFrame, kind="processes") -> DataFrame:
    """``rows(image, platform, value JSON)`` from any tool into one schema.

    A parent pid of 0 is a value, not an absence.
    """
    at = [c for c in ("investigation_id", "endpoint_id", "image", "platform", "provenance")
          if c in rows.columns]
    row = F.col("r")
    ready = rows.withColumn("r", F.from_json("value", "map<string,string>")).filter(
        "r IS NOT NULL AND size(r) > 0")
    number = lambda c: c.try_cast("bigint")                          # noqa: E731
    shapes = {
        "processes": [
            _first_filled(row, "ImageFileName", "COMM", "Name", "name", "process_name").alias(
                "process_name"),
            number(_first_of(row, "PID", "pid")).alias("pid"),
            number(_first_of(row, "PPID", "ppid", "parent_pid")).alias("parent_pid"),
            _first_of(row, "UID").alias("user"),
            _first_filled(row, "CREATE TIME", "start_time").alias("started_at"),
            _first_filled(row, "Path", "path", "EXE", "Exe", "CommandLine").alias("executable"),
            number(_first_filled(row, "THREADS", "Threads")).alias("threads"),
            _first_filled(row, "OFFSET (V)", "Offset(V)", "Offset").alias("offset")],
        "modules": [
            _first_filled(row, "Name", "name", "Module").alias("name"),
            _first_filled(row, "Path", "path", "File").alias("path"),
            number(_first_filled(row, "Size", "size")).alias("size_bytes"),
            _first_filled(row, "Offset", "Offset(V)").alias("offset"),
            _first_of(row, "Base").alias("base")],
        "mappings": [
            number(_first_of(row, "PID", "pid")).alias("pid"),
            _first_filled(row, "Start", "Start VPN", "Offset").alias("start"),
            _first_filled(row, "End", "End VPN").alias("end"),
            _first_filled(row, "Flags", "Protection", "Permissions").alias("permissions"),
            _first_filled(row, "File Path", "FileName", "Path").alias("path")],
    }
    return ready.select(*at, *shapes[kind], F.lit(V.HISTORICAL_EVIDENCE).alias("classification"))


# --- processes -------------------------------------------------------------------------
def normalize_process_snapshot(snapshot: DataFrame, *, include_command_lines=False,
                               max_processes: int | None = None) -> DataFrame:
    """Process rows with reasons for what is absent; ``truncated`` when a bound was set and hit."""
    given = F.col("command_line") if include_command_lines else F.lit(None).cast("string")
    masked = X.redact_command_line(given)
    denied = F.coalesce("access_denied", F.lit(False))
    gaps = {c: F.when(denied, "permission_denied").when(F.col(c).isNull(), "unavailable")
            for c in ("name", "executable", "parent_pid", "started_at")}
    gaps["command_line"] = F.when(denied, "permission_denied").when(
        F.lit(not include_command_lines), "skipped: arguments may contain credentials")
    gaps["command_line_secrets"] = F.when(masked["was_redacted"], "masked before storage")
    rows = snapshot.select(
        *scope(snapshot), "pid", "name", "executable", "parent_pid", "started_at",
        masked["text"].alias("command_line"),
        F.when(F.lower("name").isin(list(V.INTERPRETERS)), F.col("name")).alias("interpreter"),
        text_map(gaps).alias("unavailable"), F.lit(V.CURRENT_OBSERVATION).alias("classification"))
    if max_processes is None:
        return rows.withColumn("truncated", F.lit(False))
    ranked = number_rows(rows, ["endpoint_id"], [F.col("pid")], "_n")
    present = rows.groupBy("endpoint_id").agg((F.count("*") > max_processes).alias("truncated"))
    return ranked.filter(F.col("_n") <= max_processes).drop("_n").join(present, "endpoint_id")


def process_statistics(processes: DataFrame) -> DataFrame:
    return processes.groupBy("endpoint_id").agg(
        F.count("*").alias("processes_recorded"), F.max("pid").alias("highest_pid_recorded"),
        F.count_if(F.map_contains_key("unavailable", "command_line_secrets")).alias(
            "command_lines_redacted"),
        F.count_if(F.try_element_at("unavailable", F.lit("name")) == "permission_denied").alias(
            "permission_denied"))


# --- files ------------------------------------------------------------------------------
def read_file_inventory(spark: SparkSession, path) -> DataFrame:
    """Path, size and time of collected files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", r"endpoint=([^/]+)", 1).alias("endpoint_id"),
        F.coalesce(F.nullif(F.regexp_extract("path", r"endpoint=[^/]+(/.*)\z", 1), F.lit("")),
                   "path").alias("path"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"))


def file_inventory(files: DataFrame) -> DataFrame:
    """Name, kind and naming indicators for an inventory of paths."""
    kind = F.col("type") if "type" in files.columns else F.lit("file")
    return files.withColumn("name", X.path_basename("path")).withColumn("type", kind).withColumn(
        "indicators", X.filename_indicators("name"))


def search_files(files: DataFrame, needle: str) -> DataFrame:
    if not (needle or "").strip():
        raise ValueError("a file search needs a term")
    return files.filter(F.lower("name").contains(needle.strip().lower()))


def list_directory(files: DataFrame, directory: str, *, limit: int | None = None) -> DataFrame:
    """What lies in a directory: folders first, then by lower-case name; with ``limit`` its first page."""
    held = files.filter(X.path_dirname("path") == directory.rstrip("/")).orderBy(
        (F.col("type") != "directory"), F.lower("name"), "path")
    return held if limit is None else held.limit(limit)


def file_digests(spark: SparkSession, path, *, algorithm="SHA256") -> DataFrame:
    """Digest, size, container format and structural check of each collected file.

    For files of up to 2 GB, as their markers are looked at; :func:`.ranges.read_file_digests` digests any size.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path", F.col("length").alias("size_bytes"), F.lit(algorithm.upper()).alias("algorithm"),
        X.content_digest("content", algorithm).alias("hash"),
        X.container_format("content").alias("container"),
        X.structural_check("content", X.path_extension(X.path_basename("path"))).alias(
            "integrity"))

