"""Unified diffs as tables: lines, files, hunks, changed lines and errors.

A diff arrives as one row and is parsed within that row, in one pass over its
lines, so that nothing is shuffled or sorted for it. Files, hunks and lines are
arrays of the parsed row and become rows of their own last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rippletrace.functions import columns as C

KEYS = ["repo", "change_id"]
HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_GIT = re.compile(r'diff --git (?:"?(a/.+?)"? "?(b/.+?)"?|"?(\S+)"? "?(\S+)"?)\Z')
_BINARY = re.compile(r"Binary files (.+) and (.+) differ\Z")
NOWHERE = "/dev/null"

FILE = "struct<file_idx:int,source_name:string,target_name:string,added:bigint,removed:bigint>"
SPAN = "struct<hunk:int,file_idx:int,source_start:int,source_length:int,target_start:int,target_length:int>"
LINE = "struct<n:int,file_idx:int,hunk:int,side:string,line_no:int>"
PARSED = f"error string, files array<{FILE}>, hunks array<{SPAN}>, lines array<{LINE}>"


class _Files:
    """The files of a diff, as their headers come.

    A file is opened by git's own header or by its two names; names that follow
    a header of git belong to the same file. Without any names, as for files
    that were only renamed, are binary or have no content, git's header and what
    it says below about renames, new and deleted files is all there is.
    """

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.source: str | None = None
        self.bare = False  # whether the last file has had no names of its own yet

    def open(self, source: str | None, target: str | None, bare: bool) -> None:
        self.rows.append([len(self.rows), source, target, 0, 0])
        self.bare = bare

    def header(self, line: str) -> None:
        start = line[:4]
        if start == "--- ":
            self.source = line[4:].partition("\t")[0]
        elif start == "+++ ":
            name = line[4:].partition("\t")[0]
            if self.bare:
                self.rows[-1][1:3], self.bare = [self.source, name], False
            else:
                self.open(self.source, name, False)
        elif line.startswith("diff --git ") and (m := _GIT.match(line)):
            self.open(m[1] or m[3], m[2] or m[4], True)
        elif self.bare and line.startswith("new file mode"):
            self.rows[-1][1] = NOWHERE
        elif self.bare and line.startswith("deleted file mode"):
            self.rows[-1][2] = NOWHERE
        elif self.bare and line.startswith("rename from "):
            self.rows[-1][1] = "a/" + line[12:]
        elif self.bare and line.startswith("rename to "):
            self.rows[-1][2] = "b/" + line[10:]
        elif not self.bare and (m := _BINARY.match(line)):
            self.open(m[1], m[2], False)


# Names of a file and a hunk of the usual shape: context, removed lines, added lines, context.
_PLAIN = re.compile(rf"(?:--- ([^\n\t]*)[^\n]*\n\+\+\+ ([^\n\t]*)[^\n]*\n)?{HUNK.pattern}[^\n]*\n((?: [^\n]*\n)*)((?:-[^\n]*\n)*?)((?:\+[^\n]*\n)*)((?: [^\n]*\n)*)(?=--- |@@|\Z)")


def parse_plain(text: str) -> tuple[None, list, list, dict] | None:
    """As ``parse_diff`` without listed lines, if all of the text is files with names and hunks of the usual shape; else nothing.

    Lines are counted as a whole. A hunk whose lines are as many as it says on
    both sides uses them up with its last one, and so ends where they end.
    """
    files, hunks, numbers, at = [], [], {}, 0
    for m in _PLAIN.finditer(text):
        source_name, target_name, source, source_length, target, target_length, before, minus, plus, after = m.groups()
        if m.start() != at or (source_name is None and not files):
            return None
        at = m.end()
        source, target = int(source), int(target)
        source_length, target_length = int(source_length or 1), int(target_length or 1)
        n, removed, added = before.count("\n"), minus.count("\n"), plus.count("\n")
        same = n + after.count("\n")
        if same + removed != source_length or same + added != target_length:
            return None
        if source_name is not None:
            files.append([len(files), source_name, target_name, 0, 0])
        file = files[-1]
        file[3] += added
        file[4] += removed
        hunks.append((len(hunks) + 1, file[0], source, source_length, target, target_length))
        if removed or added:
            found = numbers.setdefault(file[0], set())
            found.update(range(source + n, source + n + removed), range(target + n, target + n + added))
    return (None, [tuple(f) for f in files], hunks, numbers) if at == len(text) else None


def parse_diff(text: str | None, listed: bool = True) -> tuple[str | None, list, list, list | dict]:
    """(error, files, hunks, lines) of one diff, as in ``PARSED``.

    A line is inside its hunk as long as the lines before it have not used up
    both declared lengths; what follows, such as the next file's header, is
    outside. A hunk that isn't as long as it says or holds a foreign line makes
    an error, and then there are no files. Unless ``listed``, lines are only a
    set of distinct numbers for each file that has any, in the files' order.
    """
    if not listed and text and (found := parse_plain(text if text.endswith("\n") else text + "\n")):
        return found
    files, hunks, lines, numbers, number = _Files(), [], [], {}, 0
    rows = (text or "").removesuffix("\n").split("\n")
    at, end = 0, len(rows)
    while at < end:
        line = rows[at]
        at += 1
        m = HUNK.match(line) if line[:1] == "@" else None
        if not m:
            files.header(line)
            continue
        number += 1
        file = len(files.rows) - 1
        source, source_left, target, target_left = [int(x) if x else 1 for x in m.groups()]
        hunks.append((number, file, source, source_left, target, target_left))
        added = removed = 0
        touched = numbers.get(file, set())
        while (source_left > 0 or target_left > 0) and at < end:
            sign = rows[at][:1]
            if sign == "+":
                if listed:
                    lines.append((at, file, number, "added", target))
                else:
                    touched.add(target)
                target += 1
                target_left -= 1
                added += 1
            elif sign == "-":
                if listed:
                    lines.append((at, file, number, "removed", source))
                else:
                    touched.add(source)
                source += 1
                source_left -= 1
                removed += 1
            elif sign == " " or sign == "":
                source += 1
                source_left -= 1
                target += 1
                target_left -= 1
            elif sign != "\\":
                break
            at += 1
        if source_left or target_left:
            return f"Failed to parse diff: hunk {number}", [], [], [] if listed else {}
        if file >= 0:
            files.rows[file][3] += added
            files.rows[file][4] += removed
            if touched:
                numbers[file] = touched
    return None, [tuple(r) for r in files.rows], hunks, lines if listed else numbers


def text_of_lines(diff_text: str | None, lines: list) -> list[list]:
    """[file_idx, side, texts] for each file and side that has ``lines``, in their order: their texts."""
    text, found = (diff_text or "").split("\n"), {}
    for n, file, _, side, _ in lines:
        found.setdefault((file, side), []).append(text[n])
    return [(*k, v) for k, v in found.items()]


def numbers_of(lines: list) -> dict[int, set]:
    """The distinct numbers of listed ``lines`` by file."""
    found: dict[int, set] = {}
    for _, file, _, _, line_no in lines:
        if file >= 0:
            found.setdefault(file, set()).add(line_no)
    return found


TOUCHED = "array<struct<file_idx:int,source_name:string,target_name:string,lines:array<int>>>"


def touched_of(parsed: list[tuple], kind: pa.DataType) -> pa.Array:
    """For each of ``parsed``, whose lines aren't listed, its files with lines: file_idx, source_name, target_name and their distinct numbers in order.

    The nested array is made of flat ones, which is several times faster than a tuple for each file.
    """
    starts, at, files, ends, numbers = [0], [], [], [0], []
    for _, known, _, lines in parsed:
        for file, found in lines.items():
            at.append(file)
            files.append(known[file])
            numbers += sorted(found)
            ends.append(len(numbers))
        starts.append(len(at))
    of, int32 = kind.value_type, pa.int32()
    columns = [pa.array(at, int32), *[pa.array([f[i] for f in files], pa.string()) for i in (1, 2)], pa.ListArray.from_arrays(pa.array(ends, int32), pa.array(numbers, int32), of.field("lines").type)]
    return pa.ListArray.from_arrays(pa.array(starts, int32), pa.StructArray.from_arrays([c.cast(of.field(i).type) for i, c in enumerate(columns)], fields=list(of)), kind)


def parse_diffs(diffs: DataFrame, *columns: str) -> DataFrame:
    """(repo, change_id, error, files, hunks, lines): each of ``diffs`` (repo, change_id, diff_text) parsed, in one row.

    Of ``columns``, if some are named, only these are made. Two more can be:
    touched, the distinct lines of each file, and texts, the changed lines of
    each file and side as texts.
    """
    more = {"touched": TOUCHED, "texts": "array<struct<file_idx:int,side:string,texts:array<string>>>"}
    plain = StructType.fromDDL(f"{PARSED}, {', '.join(f'{c} {kind}' for c, kind in more.items())}")
    columns = columns or tuple(c for c in plain.names if c not in more)
    listed = not set(columns).isdisjoint(("lines", "texts"))
    schema = StructType([diffs.schema[k] for k in KEYS] + [plain[c] for c in columns])
    types = to_arrow_schema(schema)

    def made(column: str, texts: list, parsed: list[tuple], kind: pa.DataType) -> pa.Array:
        if column == "touched":
            return touched_of([(e, files, hunks, numbers_of(lines)) for e, files, hunks, lines in parsed] if listed else parsed, kind)
        if column == "texts":
            return pa.array([text_of_lines(t, p[3]) for t, p in zip(texts, parsed)], kind)
        place = plain.names.index(column)
        return pa.array([p[place] for p in parsed], kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("diff_text").to_pylist()
                parsed = [parse_diff(t, listed) for t in texts]
                arrays = [part.column(k) for k in KEYS] + [made(c, texts, parsed, types.field(i).type) for i, c in enumerate(columns, len(KEYS))]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return diffs.select(*KEYS, "diff_text").mapInArrow(work, schema)


def diff_errors(parsed: DataFrame) -> DataFrame:
    """(repo, change_id, error) of the changes that can't be parsed."""
    return parsed.where(F.col("error").isNotNull()).select(*KEYS, "error")


def diff_files(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """One row per file: path, source_path (of renames), change_type, added, removed, is_python."""
    files = parsed.select(*KEYS, F.inline("files"))
    source, target = (C.strip_prefix(F.col(f"{x}_name"), f"{p}/", compat) for x, p in (("source", "a"), ("target", "b")))
    kind = F.when(F.col("source_name") == NOWHERE, "added").when(F.col("target_name") == NOWHERE, "deleted").when(source != target, "renamed")
    files = files.withColumn("change_type", kind.otherwise("modified"))
    files = files.withColumn("path", F.when(F.col("change_type") == "deleted", source).otherwise(target))
    return files.select(
        *KEYS,
        "file_idx",
        "path",
        F.when(F.col("change_type") == "renamed", source).alias("source_path"),
        "change_type",
        "added",
        "removed",
        C.is_python(F.col("path")).alias("is_python"),
    )


def diff_hunks(parsed: DataFrame) -> DataFrame:
    """One row per hunk: file_idx, hunk (running number), source_start, source_length, target_start, target_length."""
    return parsed.select(*KEYS, F.inline("hunks"))


def changed_lines(parsed: DataFrame) -> DataFrame:
    """(repo, change_id, n, file_idx, hunk, side, line_no): added lines by target numbers, removed ones by source numbers.

    n is the line's place in the diff, from 0.
    """
    return parsed.select(*KEYS, F.inline("lines"))


def changed_in_python(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct (repo, change_id, file_idx, path, line_no) of changed lines in Python files, without a shuffle.

    File and lines are matched within the row: a file's place is its number.
    """
    source, target = (C.strip_prefix(F.col(f"file.{x}_name"), f"{p}/", compat) for x, p in (("source", "a"), ("target", "b")))
    path = F.when((F.col("file.source_name") != NOWHERE) & (F.col("file.target_name") == NOWHERE), source).otherwise(target)
    pairs = F.array_distinct(F.transform("lines", lambda x: F.struct(x["file_idx"].alias("file_idx"), x["line_no"].alias("line_no"))))
    rows = parsed.select(*KEYS, "files", F.inline(pairs)).where("file_idx >= 0").withColumn("file", F.get("files", F.col("file_idx")))
    return rows.select(*KEYS, "file_idx", path.alias("path"), "line_no").where(C.is_python(F.col("path")))


def touched_in_python(parsed: DataFrame, compat: bool = False) -> DataFrame:
    """(repo, change_id, file_idx, path, lines): the sorted distinct changed lines of each Python file that has any, without a shuffle.

    ``parsed`` has the column touched.
    """
    rows = parsed.select(*KEYS, F.inline("touched"))
    source, target = (C.strip_prefix(F.col(f"{x}_name"), f"{p}/", compat) for x, p in (("source", "a"), ("target", "b")))
    path = F.when((F.col("source_name") != NOWHERE) & (F.col("target_name") == NOWHERE), source).otherwise(target)
    return rows.select(*KEYS, "file_idx", path.alias("path"), "lines").where(C.is_python(F.col("path")))


def text_lines(parsed: DataFrame) -> DataFrame:
    """(repo, change_id, file_idx, side, texts): the added and the removed lines of each file as they stand in the diff; ``parsed`` has the column texts."""
    return parsed.select(*KEYS, F.inline("texts"))


def context_in_diffs(parsed: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """``context_lines`` of the changed lines of ``parsed``, within the row of each diff."""
    near = lambda x: F.when(
        x["line_no"] + around >= 1,
        F.transform(F.sequence(F.greatest(F.lit(1), x["line_no"] - around), x["line_no"] + around), lambda n: F.shiftleft(x["file_idx"].cast("long"), 32) + n),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = parsed.select(*KEYS, F.explode(F.array_distinct(F.flatten(F.transform("lines", near)))).alias("_at"))
    return rows.select(*KEYS, F.shiftright("_at", 32).cast("int").alias("file_idx"), F.col("_at").bitwiseAND((1 << 32) - 1).cast("int").alias("line_no"))


def runs_in_diffs(parsed: DataFrame) -> DataFrame:
    """(repo, change_id, file_idx, first, last): ``line_runs`` of each file's changed lines, within the row of each diff; ``parsed`` has the column touched."""
    files = parsed.select(*KEYS, F.inline("touched"))
    return files.select(*KEYS, "file_idx", F.inline(C.runs(F.col("lines"))))


def affected_ranges(parsed: DataFrame) -> DataFrame:
    """(…, file_idx, hunk, first, last) per hunk: the target side, for deleted files the source side, nothing for renames.

    last is start plus length, one past the last line.
    """
    rows = parsed.select(*KEYS, "files", F.inline("hunks")).where("file_idx >= 0").withColumn("file", F.get("files", F.col("file_idx")))
    source, target = (C.strip_prefix(F.col(f"file.{x}_name"), f"{p}/") for x, p in (("source", "a"), ("target", "b")))
    added, deleted = F.col("file.source_name") == NOWHERE, F.col("file.target_name") == NOWHERE
    rows = rows.where(added | deleted | (source == target))
    side = lambda x: F.when(deleted & ~added, F.col(f"source_{x}")).otherwise(F.col(f"target_{x}"))
    return rows.select(*KEYS, "file_idx", "hunk", side("start").alias("first"), (side("start") + side("length")).alias("last"))


def context_lines(changed: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """The set of changed lines and of those up to ``around`` lines away, from line 1 on, as single lines."""
    lines = F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_no") - around), F.col("line_no") + around))
    return changed.where(F.col("line_no") + around >= 1).select(*KEYS, "file_idx", lines.alias("line_no")).distinct()


def line_runs(lines: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """Consecutive lines of ``keys`` as (first, last): the set of lines, cut where one is missing."""
    distinct = lines.select(*keys, line).distinct()
    island = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    runs = distinct.withColumn("_island", island).groupBy(*keys, "_island")
    return runs.agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("_island")
