"""Numbers, times, digests, addresses and bytes."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .paths import _col

__all__ = ["parse_timestamp", "filetime_to_ts", "chrome_time_to_ts", "firefox_time_to_ts",
           "epoch_seconds_to_ts", "rot13", "parse_int_any_base", "account_name",
           "extract_sha256", "url_origin", "download_key", "hex_le_to_ipv4", "little_endian",
           "gap_hours", "compare_hash", "validate_digest", "content_digest", "container_format",
           "structural_check", "resolve_window", "in_window", "remote_host", "remote_port"]

_ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
_FILETIME_OFFSET = 11644473600000000      # microseconds from 1601 to 1970
_LATEST = 253402300799999999              # last microsecond of year 9999


def parse_timestamp(text) -> Column:
    """ISO text in any of the spellings sources use; null when it is not a time."""
    return F.try_to_timestamp(F.trim(_col(text)))


def _micros(value: Column) -> Column:
    return F.when((value <= _LATEST) & (value >= -_LATEST), F.timestamp_micros(value))


def filetime_to_ts(value) -> Column:
    """100-nanosecond ticks since 1601; zero and out-of-range give null."""
    value = _col(value).cast("bigint")
    return F.when(value != 0, _micros(F.call_function("div", value, F.lit(10))
                                      - F.lit(_FILETIME_OFFSET)))


def chrome_time_to_ts(value) -> Column:
    value = _col(value).cast("bigint")
    return F.when(value != 0, _micros(value - F.lit(_FILETIME_OFFSET)))


def firefox_time_to_ts(value) -> Column:
    value = _col(value).cast("bigint")
    return F.when(value != 0, _micros(value))


def epoch_seconds_to_ts(value) -> Column:
    return F.timestamp_seconds(_col(value).cast("bigint"))


def rot13(text) -> Column:
    return F.translate(_col(text), _ROT_FROM, _ROT_TO)


def parse_int_any_base(text) -> Column:
    """``0x4d2`` and ``1234`` alike; anything else is null."""
    text = F.lower(F.trim(_col(text)))
    digits = F.regexp_extract(text, r"^0x([0-9a-f]{1,15})\z", 1)
    return (F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))
            .when(text.rlike(r"^[+-]?(0|[1-9][0-9]{0,17})\z"), text.try_cast("bigint")))


def account_name(domain, user) -> Column:
    domain, user = F.nullif(_col(domain), F.lit("")), F.nullif(_col(user), F.lit(""))
    return F.when(user.isNotNull(), F.concat_ws("\\", domain, user))


def extract_sha256(hashes) -> Column:
    found = F.lower(F.trim(F.regexp_extract(_col(hashes), r"(?i)(?:^|,)\s*SHA256\s*=([^,]*)", 1)))
    return F.when(found != "", found)


def url_origin(url) -> Column:
    """The part after the first ``//`` up to the next ``/``; null when there is no ``//``."""
    url = _col(url)
    return F.when(url.contains("//"), F.regexp_extract(url, r"(?s)^.*?//([^/]*)", 1))


def download_key(target_path, url) -> Column:
    url = _col(url)
    target = F.coalesce(F.nullif(_col(target_path), F.lit("")), F.nullif(url, F.lit("")))
    return F.concat(F.substring_index(target, "/", -1), F.lit(" from "),
                    F.coalesce(url_origin(url), F.lit("unknown origin")))


def hex_le_to_ipv4(text) -> Column:
    text = _col(text)
    return F.when(text.rlike(r"^[0-9A-Fa-f]{8}\z"), F.concat_ws(".", *[
        F.conv(F.substring(text, at, 2), 16, 10) for at in (7, 5, 3, 1)]))


def little_endian(data, offset: int, width: int) -> Column:
    """An unsigned little-endian integer at a zero-based byte offset (up to seven bytes exact)."""
    data = _col(data)
    joined = F.concat(*[F.hex(F.substring(data, offset + at, 1)) for at in range(width, 0, -1)])
    return F.conv(joined, 16, 10).try_cast("bigint")


def remote_host(address) -> Column:
    """The host half of ``host:port``. The last colon splits, so IPv6 survives."""
    address = _col(address)
    return F.when(address.rlike(r":[0-9]+\z"), F.regexp_replace(address, r":[0-9]+\z", "")
                  ).otherwise(address)


def remote_port(address) -> Column:
    return F.nullif(F.regexp_extract(_col(address), r":([0-9]+)\z", 1), F.lit("")).try_cast("int")


def gap_hours(first, second) -> Column:
    return (F.unix_micros(_col(second)) - F.unix_micros(_col(first))) / F.lit(3600000000.0)


def compare_hash(previous_hash, previous_algorithm, current_hash, current_algorithm) -> Column:
    before, now = _col(previous_hash), _col(current_hash)
    return (F.when(before.isNull(), "first_recorded")
            .when(F.upper(_col(previous_algorithm)) != F.upper(_col(current_algorithm)),
                  "algorithm_mismatch")
            .when(F.lower(before) == F.lower(now), "unchanged").otherwise("altered"))


def validate_digest(algorithm, digest, size_bytes, timestamp_text) -> Column:
    """True when every field of a hash observation is usable."""
    lengths = F.create_map(*[F.lit(v) for pair in V.DIGEST_LENGTHS.items() for v in pair])
    expected = F.try_element_at(lengths, F.upper(_col(algorithm)))
    digest, stamp = _col(digest), _col(timestamp_text)
    return F.coalesce(
        (F.length(digest) == expected) & digest.rlike(r"^[0-9a-fA-F]+\z")
        & (_col(size_bytes) >= 0)
        & stamp.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\z") & parse_timestamp(stamp).isNotNull(),
        F.lit(False))


def content_digest(content, algorithm="SHA256") -> Column:
    content = _col(content)
    makers = {"SHA256": lambda c: F.sha2(c, 256), "SHA512": lambda c: F.sha2(c, 512),
              "SHA1": F.sha1, "MD5": F.md5}
    if algorithm.upper() not in makers:
        raise ValueError(f"algorithm must be one of {', '.join(sorted(makers))}")
    return makers[algorithm.upper()](content)


def container_format(content) -> Column:
    """The image container a header names, else ``raw``."""
    header = F.hex(F.substring(_col(content), 1, 16))
    chosen = F.lit("raw")
    for signature, name in reversed(V.CONTAINER_SIGNATURES):
        chosen = F.when(header.startswith(signature), F.lit(name)).otherwise(chosen)
    return F.when(header.isNull(), "unknown").otherwise(chosen)


def structural_check(content, extension) -> Column:
    """``struct<status, detail>`` from head and tail markers of JPEG, PNG and PDF files."""
    content, ext = _col(content), F.lower(_col(extension))
    size = F.octet_length(content)
    head = F.hex(F.substring(content, 1, 8))

    def tail(width):
        start = F.greatest(size - width + 1, F.lit(1))
        return F.hex(content.substr(start, F.lit(width)))

    def on_byte(text, wanted):       # position of a byte string in hex text, on a byte boundary
        return text.rlike("^(?:..)*" + wanted)

    jpeg_end = F.regexp_replace(tail(1024), r"(?:00)+\z", "")
    # Trailing zero bytes are padding; an odd split cannot occur because pairs are whole bytes.
    jpeg_ok = jpeg_end.rlike(r"^(?:..)*FFD9\z")

    def say(status, detail):
        return F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))

    def verdict(head_ok, tail_ok, kind):
        return (F.when(~head_ok, say("critical", f"{kind} start marker missing"))
                .when(~tail_ok, say("warning", f"{kind} end marker missing"))
                .otherwise(say("ok", f"{kind} markers present")))

    return (F.when(size == 0, say("warning", "empty file"))
            .when(ext.isin(".jpg", ".jpeg"), verdict(head.startswith("FFD8FF"), jpeg_ok, "JPEG"))
            .when(ext == ".png", verdict(head.startswith("89504E470D0A1A0A"),
                                         on_byte(tail(1024), "49454E44"), "PNG"))
            .when(ext == ".pdf", verdict(head.startswith("255044462D"),
                                         on_byte(tail(2048), "2525454F46"), "PDF"))
            .otherwise(say("unknown", "no check for this type")))


def resolve_window(hours=None, *, end: datetime | None = None) -> tuple[datetime, datetime]:
    """Start and end of a bounded history window; raises ``ValueError`` outside the bounds."""
    end = end or datetime.now(timezone.utc)
    try:
        span = float(V.WINDOW_DEFAULT_HOURS if hours is None else hours)
    except (TypeError, ValueError) as error:
        raise ValueError("window hours must be a number") from error
    if not 0 < span <= V.WINDOW_MAX_HOURS:
        raise ValueError(f"window hours must be above 0 and at most {V.WINDOW_MAX_HOURS}")
    return end - timedelta(hours=span), end


def in_window(ts, window) -> Column:
    """Both ends count; an undated record is never inside. ``window=None`` keeps everything."""
    if window is None:
        return F.lit(True)
    start, end = (F.lit(moment) for moment in window)
    return F.coalesce(_col(ts).between(start, end), F.lit(False))
