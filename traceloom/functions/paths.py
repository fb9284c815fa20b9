"""Paths as text from a record: nothing here looks at a file system."""

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import vocab as V

__all__ = ["normalize_path", "is_absolute", "path_basename", "path_dirname", "same_path",
           "path_extension", "path_ancestors", "in_system_location", "transient_location",
           "notable_location", "in_notable_location", "is_interpreter", "interpreter_for", "filename_indicators"]


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normalize_path(path) -> Column:
    """One spelling per path: forward slashes, no repeats after the second character."""
    folded = F.regexp_replace(_forward(_col(path)), r"(?s)(?<=..)/{2,}", "/")
    return F.coalesce(F.regexp_replace(folded, r"(?s)(?<=.)/+\z", ""), F.lit(""))


def is_absolute(path) -> Column:
    path = _col(path)
    return F.coalesce(path.startswith("/") | path.startswith("\\\\")
                      | path.rlike(r"^[A-Za-z]:[\\/]"), F.lit(False))


def path_basename(path) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def path_dirname(path) -> Column:
    text = normalize_path(path)
    head = F.regexp_replace(text, r"/[^/]*\z", "")
    return (F.when(~text.contains("/"), F.lit(""))
            .when(head == "", F.lit("/")).otherwise(head))


def same_path(left, right) -> Column:
    left, right = _col(left), _col(right)
    return (F.coalesce(left, F.lit("")) != "") & (F.coalesce(right, F.lit("")) != "") & (
        normalize_path(left) == normalize_path(right))


def path_extension(name) -> Column:
    """Lower-case suffix with its dot; null without one. Leading dots are not a suffix."""
    found = F.regexp_extract(_col(name), r"[^.].*(\.[^.]*)\z|\z", 1)
    return F.when(found != "", F.lower(found))


def path_ancestors(path) -> Column:
    """Every directory above a path, as an array: ``/a/b/c`` gives ``/a`` and ``/a/b``."""
    parts = F.split(_col(path), "/")
    count = F.size(parts)
    return F.when(count > 2, F.transform(
        F.sequence(F.lit(2), count - 1),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(
            F.array().cast("array<string>"))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def in_system_location(path, *, lowered=None, forward=None) -> Column:
    lowered = F.lower(_col(path)) if lowered is None else lowered
    forward = _forward(lowered) if forward is None else forward
    return F.coalesce(_any([forward.startswith(p) for p in V.SYSTEM_DIRECTORIES]
                           + [lowered.startswith(p) for p in V.WINDOWS_SYSTEM_DIRECTORIES]),
                      F.lit(False))


def _longest_fragment(path, patterns, shown, forward=None) -> Column:
    """The longest listed fragment a path contains, as ``shown(pattern)``.

    A caller that already holds the lower-case forward-slash spelling passes it
    as ``forward``, so that it is computed once rather than once per pattern.
    """
    forward = _forward(F.lower(_col(path))) if forward is None else forward
    chosen = F.lit(None).cast("string")
    ordered = sorted(patterns, key=lambda p: -len(p))
    for pattern in reversed(ordered):
        chosen = F.when(forward.contains(pattern.replace("\\", "/")),
                        F.lit(shown(pattern))).otherwise(chosen)
    return chosen


def transient_location(path, *, forward=None) -> Column:
    return _longest_fragment(path, V.TRANSIENT_DIRECTORIES,
                             lambda p: p.replace("\\", "/").strip("/"), forward)


def notable_location(path) -> Column:
    return _longest_fragment(path, V.NOTABLE_LOCATIONS, lambda p: p.strip("\\/"))


def in_notable_location(path) -> Column:
    """Whether :func:`notable_location` would name a place; one pattern, cheap to filter on."""
    fragments = "|".join("(?:" + p.replace("\\", "/").replace("$", r"\$").replace(".", r"\.") + ")"
                         for p in V.NOTABLE_LOCATIONS)
    return F.coalesce(_forward(F.lower(_col(path))).rlike(fragments), F.lit(False))


def is_interpreter(path, name) -> Column:
    path, name = _col(path), _col(name)
    return (F.coalesce(name.rlike(V.INTERPRETER_NAME), F.lit(False))
            | F.coalesce(path.rlike(V.INTERPRETER_NAME), F.lit(False)))


def interpreter_for(name, executable) -> Column:
    """The original spelling of a name that is exactly a known runtime, else null."""
    name = _col(name)
    base = F.regexp_extract(_col(executable), r"([^/\\]*)\z", 1)
    known = list(V.INTERPRETERS)
    return (F.when(F.lower(name).isin(known), name)
            .when(F.lower(base).isin(known), base))


_INDICATOR = "struct<level:string,label:string,detail:string>"


def _indicator(level, label, detail) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)     # noqa: E731
    return F.struct(F.lit(level).alias("level"), as_col(label).alias("label"),
                    as_col(detail).alias("detail"))


def filename_indicators(filename) -> Column:
    """Neutral naming observations: notable suffix, document-then-program suffix, dotfile."""
    lower = F.lower(_col(filename))
    parts = F.split(lower, r"\.")
    count = F.size(parts)
    last = F.concat(F.lit("."), F.element_at(parts, -1))
    ext = F.when(count >= 2, last).otherwise(F.lit(""))
    second = F.concat(F.lit("."), F.try_element_at(parts, F.lit(-2)))
    notable = ext.isin(list(V.NOTABLE_EXTENSIONS))
    meaning = F.lit(None).cast("string")
    for suffix, text in V.NOTABLE_EXTENSIONS.items():
        meaning = F.when(ext == suffix, F.lit(text)).otherwise(meaning)
    return F.array_compact(F.array(
        F.when(notable, _indicator("info", F.concat(F.lit("Notable extension ("), ext, F.lit(")")),
                                   meaning)),
        F.when((count >= 3) & notable & second.isin(list(V.SPOOFED_EXTENSIONS)),
               _indicator("warning", "Possible extension spoofing",
                          F.concat(second, F.lit(" is followed by "), ext))),
        F.when(lower.startswith(".") & (F.length(lower) > 1),
               _indicator("info", "Hidden file", "The name begins with a dot")),
    )).cast(f"array<{_INDICATOR}>")
