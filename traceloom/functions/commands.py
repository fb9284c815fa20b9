"""Command text: masking, a reduced form for matching, tokens, and what was recorded."""

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import vocab as V
from .paths import _col

__all__ = ["mask_secrets", "redact_command_line", "normalize_for_search", "describe_command",
           "command_unavailable_reason", "paths_named_by_event", "distinctive_tokens",
           "history_line", "history_file", "first_word", "installs_something"]


def mask_secrets(text) -> Column:
    """The text with values that look like credentials masked; null when empty.

    Either pattern needs one of a few words, so text without any of them is not searched.
    """
    text = _col(text)
    small = F.lower(text)
    once = F.regexp_replace(text, V.SECRET_ARGUMENT, "$1$2" + V.REDACTION)
    twice = F.regexp_replace(once, V.SECRET_ENVIRONMENT, "$1$2" + V.REDACTION)
    named = reduce(lambda a, b: a | b, [F.contains(small, F.lit(word)) for word in V.SECRET_WORDS])
    return F.when(text != "", F.when(named, twice).otherwise(text))


def redact_command_line(text) -> Column:
    """``struct<text, was_redacted>``."""
    text = _col(text)
    masked = mask_secrets(text)
    return F.struct(masked.alias("text"),
                    F.coalesce(masked != text, F.lit(False)).alias("was_redacted"))


def _last_parts(text: Column) -> Column:
    """Paths of two parts or more as their last part. A doubled slash ends one path and begins another."""
    parts = F.transform(F.split(text, V.BETWEEN_SLASHES, -1), lambda p: F.regexp_replace(p, V.DEEP_PATH, "$1"))
    return F.when(F.contains(text, F.lit("//")), F.array_join(parts, "")).otherwise(
        F.regexp_replace(text, V.DEEP_PATH, "$1"))


def normalize_for_search(command) -> Column:
    """URL, then deep path, then redirection, then quotes, then blanks. Order matters.

    Every text is reduced once: ``nullif`` names its argument, which ``when`` would compute again for its value.
    """
    text = _col(command)
    reduced = F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, V.ANY_URL, "URL")).otherwise(text)
    reduced = _last_parts(reduced)
    reduced = F.regexp_replace(reduced, V.REDIRECT, " redirect ")
    reduced = F.translate(reduced, "\"'", "  ")
    reduced = F.trim(F.regexp_replace(reduced, V.WS + "+", " "))
    return F.nullif(reduced, F.lit(""))


def strip_blanks(text) -> Column:
    """The text without blanks at its ends, which are looked at first: few texts are searched for runs of them."""
    text = _col(text)
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(V.WS), F.regexp_replace(text, f"^{V.WS}+|{V.WS}+\\z", "")).otherwise(text)


def describe_command(command_line, executable, process_name, source, *, status=None,
                     strength=None) -> Column:
    """What the strongest available command information is; arguments are never made up."""
    line, image = _col(command_line), F.coalesce(_col(executable), _col(process_name))
    text = strip_blanks(line)
    full = F.when(text != "", text)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)     # noqa: E731
    given = as_col(strength)
    return F.struct(
        full.alias("full_command_line"),
        normalize_for_search(F.coalesce(full, image)).alias("normalized_command"),
        F.when(full.isNotNull() | image.isNotNull(), _col(source)).alias("command_source"),
        F.when(full.isNotNull(), F.coalesce(as_col(status), F.lit(V.EXACT)))
        .when(image.isNotNull(), V.EXECUTABLE_ONLY)
        .otherwise(V.NOT_AVAILABLE).alias("command_reconstruction_status"),
        F.when(full.isNotNull(), F.coalesce(given, F.lit(V.STRONG)))
        .otherwise(F.coalesce(given, F.when(image.isNotNull(), V.WEAK)))
        .alias("command_evidence_strength"))


def command_unavailable_reason(status, source) -> Column:
    status, source = _col(status), _col(source)
    return (F.when(status == V.EXECUTABLE_ONLY,
                   F.concat(source, F.lit(" names the program but not its arguments")))
            .when(status == V.NOT_AVAILABLE,
                  F.concat(source, F.lit(" names neither a command nor a program path"))))


def first_word(text) -> Column:
    return F.regexp_extract(_col(text), f"^{V.WS}*({V.NWS}+)", 1)


def paths_named_by_event(executable, full_command_line, command_line) -> Column:
    """Every blank-separated word that begins with ``/``, across the three text fields."""
    words = F.split(F.concat_ws(" ", _col(executable), _col(full_command_line),
                                _col(command_line)), V.WS + "+")
    return F.filter(words, lambda w: w.startswith("/") & (F.length(w) > 1))


def distinctive_tokens(command, executable, process_name) -> Column:
    """The distinct words that could tie two activities together (unordered set)."""
    command = F.coalesce(_col(command), F.lit(""))
    image = F.coalesce(_col(executable), _col(process_name), F.lit(""))
    hosts = F.when(F.contains(command, F.lit("://")), F.transform(
        F.regexp_extract_all(command, F.lit(V.URL_HOST), F.lit(1)), F.lower)).otherwise(
            F.array().cast("array<string>"))
    # Options are matched whole, so that nothing inside them is, and left out.
    words = F.filter(F.array_distinct(F.regexp_extract_all(command, F.lit(V.OPTION + "|" + V.TOKEN), F.lit(0))),
                     lambda w: ~w.startswith("-"))
    found = F.array_distinct(F.concat(words, F.regexp_extract_all(
        F.substring_index(image, "/", -1), F.lit(V.TOKEN), F.lit(0))))
    common = list(V.COMMON_WORDS)

    def telling(t):
        return (F.length(t) >= V.TOKEN_MIN_LENGTH) & ~t.isin(common) & ~t.rlike(r"^[0-9]+\z")

    whole = F.filter(F.transform(found, lambda t: F.btrim(F.lower(t), F.lit("._-"))), telling)
    each = F.transform(whole, lambda t: F.array_append(F.filter(
        F.split(F.translate(t, "_.", "--"), "-"), telling), t))
    return F.array_distinct(F.concat(hosts, F.flatten(each)))


def history_line(record_id) -> Column:
    """The line number a history record id ends in, or null."""
    return F.try_to_number(
        F.nullif(F.regexp_extract(_col(record_id), V.HISTORY_POSITION, 1), F.lit("")),
        F.lit("999999999999999999")).cast("bigint")


def history_file(record_id) -> Column:
    record_id = _col(record_id)
    return F.when(record_id.rlike(V.HISTORY_POSITION),
                  F.regexp_replace(record_id, V.HISTORY_POSITION, ""))


def installs_something(command) -> Column:
    return F.coalesce(_col(command).rlike(V.INSTALL_VERB), F.lit(False))
