"""Scalar functions of endpoints, diffs, paths and frames, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP's methods, weights of confidence, and spans where an end is missing.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD", "TRACE")
CONFIDENCE = {"high": 1.0, "medium": 0.7, "low": 0.3}
WINDOW_LINES = 3
DEFAULT_SPAN = 50


def endpoint_id(methods: Column, path: Column) -> Column:
    """Sorted methods joined by commas, a space, the path."""
    return F.concat_ws(" ", F.array_join(F.array_sort(methods), ","), path)


def known_methods(methods: Column) -> Column:
    """Methods in upper case, without those that HTTP doesn't know."""
    return F.filter(F.transform(methods, F.upper), lambda m: m.isin(*METHODS))


def impact_end(start: Column, end: Column) -> Column:
    """Last line of a handler when changes are checked: without one, ``DEFAULT_SPAN`` lines on."""
    return F.coalesce(F.nullif(end, F.lit(0)), start + DEFAULT_SPAN)


def lookup_end(start: Column, end: Column) -> Column:
    """Last line of a handler when line ranges are looked up: without one, its first."""
    return F.coalesce(F.nullif(end, F.lit(0)), start)


def symbol_end(start: Column, end: Column) -> Column:
    """Last line of a symbol: only a missing one is estimated, 0 is kept."""
    return F.coalesce(end, start + DEFAULT_SPAN)


def span_end(start: Column, source_lines: Column) -> Column:
    """Last line of a definition that has so many source lines; null if the source is unknown."""
    return F.when(source_lines.isNotNull(), start + source_lines - 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_python(path: Column) -> Column:
    """The suffix is .py; a file that is only called .py has none."""
    return path.rlike(r"[^/]\.py$")


def strip_prefix(path: Column, prefix: str, compat: bool = False) -> Column:
    """A diff's path without its ``a/`` or ``b/``; with ``compat`` without any leading such characters."""
    return F.ltrim(path, F.lit(prefix)) if compat else F.regexp_replace(path, "^" + prefix, "")


def change_type(source: Column, target: Column) -> Column:
    """From the two names in a file's header, prefixes removed."""
    return F.when(source == "/dev/null", "added").when(target == "/dev/null", "deleted").when(source != target, "renamed").otherwise("modified")


def runs(lines: Column) -> Column:
    """Of a sorted array of distinct numbers the runs of consecutive ones, as an array of (first, last)."""
    first = F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, F.greatest(i - 1, F.lit(0))) != x - 1))
    last = F.filter(lines, lambda x, i: (i == F.size(lines) - 1) | (F.get(lines, F.least(i + 1, F.size(lines) - 1)) != x + 1))
    return F.arrays_zip(first.alias("first"), last.alias("last"))


def module_name(path: Column) -> Column:
    """Dotted module of a path relative to the parent of the source root."""
    bare = F.regexp_replace(F.regexp_replace(path, r"/__init__\.py$", ""), r"\.py$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def is_hidden(path: Column) -> Column:
    """Some part starts with a dot or is a byte-code cache."""
    return F.exists(F.split(path, "/"), lambda x: x.startswith(".") | (x == "__pycache__"))


def weight(confidence: Column) -> Column:
    out = F.lit(0.0)
    for name, w in CONFIDENCE.items():
        out = F.when(confidence == name, w).otherwise(out)
    return out


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(len(CONFIDENCE))
    for i, name in enumerate(CONFIDENCE):
        out = F.when(confidence == name, i).otherwise(out)
    return out


# The texts of reasons, frames and tracebacks in what follows, which reports have to match.


DIRECT, DEPENDENCY = "Handler function directly modified in ", "Type analysis shows dependency on "


def direct_reason(path: Column) -> Column:
    return F.concat(F.lit(DIRECT), path)


def dependency_reason(path: Column, lines: Column) -> Column:
    return F.concat(F.lit(DEPENDENCY), path, lines_said(lines))


def lines_said(lines: Column) -> Column:
    """Names the first five of the sorted lines, and dots if there are more; null without lines."""
    shown = F.array_join(F.transform(F.slice(lines, 1, 5), lambda x: x.cast("string")), ", ")
    return F.concat(F.lit(" (lines ["), shown, F.lit("]"), F.when(F.size(lines) > 5, "...").otherwise(""), F.lit(")"))


def chain_start(module: Column) -> Column:
    """What a chain of dependencies starts with: the handler's module, if it is known."""
    return F.coalesce(F.nullif(module, F.lit("")), F.lit("unknown"))


def range_of(context: Column) -> tuple[Column, Column]:
    """First and last line of a ``[lines a-b]`` prefix; null without one."""
    at = lambda i: F.nullif(F.regexp_extract(context, r"^\[lines (\d+)-(\d+)\]", i), F.lit("")).cast("int")
    return at(1), at(2)


def frame_text(file: Column, line: Column, function: Column, context: Column) -> Column:
    """One frame as a traceback shows it, the context indented by four."""
    first, last = range_of(context)
    where = F.when(first.isNotNull(), F.concat(F.lit("lines "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(
        F.concat(F.lit("line "), line.cast("string"))
    )
    head = F.concat(F.lit('  File "'), file, F.lit('", '), where, F.lit(", in "), function)
    body = F.array_join(F.transform(F.split(F.trim(context), "\n"), lambda x: F.concat(F.lit("\n    "), x)), "")
    return F.concat(head, F.when(F.coalesce(context, F.lit("")) != "", body).otherwise(""))


def traceback_text(frames: Column) -> Column:
    """All frames below a heading; empty without frames. A frame has file_path, line_number, function_name, code_context."""
    lines = F.transform(frames, lambda x: frame_text(x["file_path"], x["line_number"], x["function_name"], x["code_context"]))
    text = F.array_join(F.concat(F.array(F.lit("Traceback (dependency chain):")), lines), "\n")
    return F.when(F.size(frames) > 0, text).otherwise("")


def frame_label(file: Column, start: Column, end: Column, function: Column) -> Column:
    """Short label with the file's base name; a range only if it ends after it starts."""
    where = F.when(end > start, F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(
        F.concat(F.lit("line "), start.cast("string"))
    )
    return F.concat(F.lit('File "'), basename(file), F.lit('", '), where, F.lit(", in "), function)
