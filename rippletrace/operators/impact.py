"""Which endpoints a change affects: direct hits, dependency hits, first hit wins, threshold.

Inputs: ``changed`` (repo, change_id, file_idx, path, and line_no for each line
or the sorted lines of each file); ``endpoints`` as
in ``operators.endpoints``; ``references`` (repo, endpoint_id, ref_ord,
file_path, start_line, end_line), ranges of lines that an endpoint depends on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rippletrace.functions import columns as C
from rippletrace.operators.endpoints import registry_files
from rippletrace.operators.paths import class_of, endings, first_of_classes, first_reference, keys_of_files, keys_of_paths, match_handler_file
from rippletrace.sources.tables import FRAME, numbered, save_step

CHANGE = ["repo", "change_id"]
FILE = [*CHANGE, "file_idx"]
#: Lines meet ranges in bins of 2 to this power of lines.
BIN_BITS = 6


def meet(lines: DataFrame, ranges: DataFrame, keys: list[str], low: Column, high: Column, line: str = "line_no") -> DataFrame:
    """``lines`` joined with those of ``ranges`` of the same ``keys`` whose columns ``low`` to ``high`` hold the ``line``.

    Both sides meet in bins of lines, so that a line is compared only with
    ranges that come near it, however many its file has. A range is written once
    for each bin that it touches, a line once.
    """
    spread = F.explode(F.sequence(F.shiftright(low.cast("long"), BIN_BITS), F.shiftright(high.cast("long"), BIN_BITS)))
    ranges = ranges.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("_bin", spread)
    met = lines.withColumn("_bin", F.shiftright(F.col(line).cast("long"), BIN_BITS)).join(ranges, [*keys, "_bin"])
    return met.where(F.col(line).between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high")


def disjoint_segments(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, start_line, end_line, sym_ord, symbol_name): of each line the symbol with the smallest sym_ord that holds it, as ranges that don't overlap.

    One sweep over the symbols of a key in order of their lines; a task holds
    those that are open at a line, not a whole key.
    """
    rows = symbols.select(*keys, F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("sym_ord").cast("long").alias("sym_ord"), "symbol_name")
    rows = rows.where("start_line <= end_line and sym_ord is not null")
    types = to_arrow_schema(rows.schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groupby(records(batches), lambda r: r[: len(keys)]):
            for segment in sweep(r[len(keys) :] for r in group):
                out.append((*key, *segment))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "start_line", "sym_ord").mapInArrow(work, rows.schema)


def sweep(ranges: Iterator[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int, str]]:
    """Disjoint (start, end, order, name) of ``ranges`` in order of their starts: where several overlap, that with the smallest order and name."""
    held: list[tuple[int, str, int]] = []  # those that are open: order, name, end
    at, last = None, None  # up to where the lines are done; the segment that may still grow
    for start, end, order, name in ranges:
        while held and at < start:
            o, n, e = held[0]
            if e < at:
                heapq.heappop(held)
                continue
            stop = min(e, start - 1)
            if last and last[1] == at - 1 and last[2:] == (o, n):
                last = (last[0], stop, o, n)
            else:
                if last:
                    yield last
                last = (at, stop, o, n)
            at = stop + 1
        at = start
        heapq.heappush(held, (order, name, end))
    while held:
        o, n, e = heapq.heappop(held)
        if e >= at:
            if last and last[1] == at - 1 and last[2:] == (o, n):
                last = (last[0], e, o, n)
            else:
                if last:
                    yield last
                last = (at, e, o, n)
            at = e + 1
    if last:
        yield last


def direct_hits(changed: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(…, file_idx, path, endpoint_id, reg_order): handlers that a changed line lies in; confidence high.

    A diff file is a row for each bin of its lines, and meets the handlers in
    the file that its path stands for whose lines touch the bin.
    """
    changed = touched(changed)
    files = match_handler_file(changed, registry_files(endpoints, ["repo"]), ["repo"])
    handlers = endpoints.select("repo", "file_path", "endpoint_id", "reg_order", F.col("start_line").alias("_low"), C.impact_end(F.col("start_line"), F.col("end_line")).alias("_high"))
    bins = F.sequence(F.shiftright(F.col("_low").cast("long"), BIN_BITS), F.shiftright(F.col("_high").cast("long"), BIN_BITS))
    handlers = files.join(handlers.where("_low <= _high"), ["repo", "file_path"]).withColumn("_bin", F.explode(bins)).drop("file_path")
    met = in_bins(changed.select(*FILE, "path", "lines")).join(handlers, ["repo", "path", "_bin"])
    met = met.where(F.exists("part", lambda x: x.between(F.col("_low"), F.col("_high"))))
    return met.groupBy(*FILE, "path", "endpoint_id").agg(F.min("reg_order").alias("reg_order"))


def touched(changed: DataFrame) -> DataFrame:
    """``changed`` as one row per diff file, (…, file_idx, path, lines, name, bare, ask), if it isn't that already.

    ``ask`` stands for all that decides which references a diff file meets: the
    repository, the class of its path and its lines. Files with the same are
    looked up once.
    """
    if "ask" in changed.columns:
        return changed
    if "lines" not in changed.columns:
        changed = changed.groupBy(*FILE, "path").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))
    rows = changed.select(*FILE, "path", "lines", *class_of(F.col("path")))
    text = F.concat_ws("\n", F.array_join("lines", ","), F.col("bare").cast("string"), F.octet_length("repo").cast("string"), "repo", "name")
    return rows.withColumn("ask", F.unhex(F.substring(F.sha2(text, 256), 1, 32)))


def save_touched(changed: DataFrame) -> DataFrame:
    """``touched`` as a step table, which holds no more of it than what the rest is made of."""
    return touched(save_step(touched(changed).select(*FILE, "path", "lines"), "changed"))


def in_referenced(changed: DataFrame, references: DataFrame) -> DataFrame:
    """The rows of ``changed`` whose paths may match a file of ``references``: others meet nothing there.

    A path matches by its base name, or, if it is nothing else, by the end of
    one. Where a referenced file has no slash, paths also match by their own
    ends, and all rows stay.
    """
    files = references.select("repo", "file_path").distinct()
    if not files.where(~F.col("file_path").contains("/")).isEmpty():
        return changed
    names = files.select("repo", C.basename(F.col("file_path")).alias("_name")).distinct()
    ends = names.select("repo", F.explode(endings(F.col("_name"))).alias("_name")).distinct()
    known = save_step(names.withColumn("_bare", F.lit(False)).unionByName(ends.withColumn("_bare", F.lit(True))), "known-names")
    name, bare = class_of(F.col("path"))
    return changed.withColumns({"_name": name, "_bare": bare}).join(known, ["repo", "_name", "_bare"], "left_semi").select(*changed.columns)


def in_bins(asks: DataFrame) -> DataFrame:
    """A row for each bin of lines that ``lines`` touches: _bin and part, its lines; one pass over the sorted lines."""
    line = lambda i: F.shiftright(F.get("lines", i).cast("long"), BIN_BITS)
    n = F.size("lines")
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: (i == 0) | (line(i) != line(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(places, lambda i: (i == n - 1) | (line(i) != line(F.least(i + 1, n - 1))))
    cut = lambda z: F.struct(line(z["s"]).alias("_bin"), F.slice("lines", z["s"] + 1, z["e"] - z["s"] + 1).alias("part"))
    parts = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), cut)
    return asks.where(n > 0).select(*[c for c in asks.columns if c != "lines"], F.inline(parts))


def asked_ranges(files: DataFrame, references: DataFrame, around: int) -> DataFrame:
    """(ask, endpoint_id, part, start_line, end_line): ranges that lie at most ``around`` lines from one of the lines ``part`` of an ask.

    ``files`` is as ``touched`` makes it. Of an endpoint's files only the first
    referenced that matches counts. A row is there for each bin of lines.
    """
    of = ["repo", "name", "bare"]
    chosen = first_of_classes(files, references, ["repo"]).drop("ref_ord")
    ranges = references.select("repo", "endpoint_id", "file_path", "start_line", "end_line").where("end_line >= 1").distinct()
    ranges = chosen.join(ranges, ["repo", "endpoint_id", "file_path"]).drop("file_path").withColumns({"_low": F.col("start_line") - around, "_high": F.col("end_line") + around})
    bins = F.sequence(F.shiftright(F.col("_low").cast("long"), BIN_BITS), F.shiftright(F.col("_high").cast("long"), BIN_BITS))
    ranges = ranges.where("_low <= _high").withColumn("_bin", F.explode(bins))
    asks = in_bins(files.select("ask", *of, "lines").distinct())
    met = asks.join(ranges, [*of, "_bin"]).where(F.exists("part", lambda x: x.between(F.col("_low"), F.col("_high"))))
    return met.select("ask", "endpoint_id", "part", "start_line", "end_line")


def asked_endpoints(files: DataFrame, references: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """Distinct (ask, endpoint_id) of which lines and references are near each other."""
    return asked_ranges(files, references, around).select("ask", "endpoint_id").distinct()


def asked_hits(files: DataFrame, references: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """(ask, endpoint_id, lines): what is displayed, as in ``display_lines``, of each hit; null for a hit without such lines."""
    met = asked_ranges(files, references, around)
    start, end = F.col("start_line"), F.col("end_line")
    exact = F.filter("part", lambda x: x.between(start, end))
    first, last = lambda x: F.greatest(F.lit(1), x - around, start), lambda x: F.least(x + around, end)
    near = F.flatten(F.transform(F.filter("part", lambda x: first(x) <= last(x)), lambda x: F.sequence(first(x), last(x))))
    lines = met.groupBy("ask", "endpoint_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(n) for c, n in ((exact, "exact"), (near, "all"))])
    shown = F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("all"))
    return lines.select("ask", "endpoint_id", F.when(F.size(shown) > 0, F.sort_array(shown)).alias("lines"))


def asked_lines(files: DataFrame, references: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """(ask, endpoint_id, lines): what is displayed, as in ``display_lines``."""
    return asked_hits(files, references, around).where("lines is not null")


def for_files(files: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` for each diff file that asks for it: the last step, after which nothing has to be shuffled.

    What is asked is written before that, so that what was shuffled for it is gone by then.
    """
    return files.select(*FILE, "path", "ask").join(save_step(asked, "asked"), "ask").drop("ask")


def dependency_hits(changed: DataFrame, references: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """(…, file_idx, path, endpoint_id): a changed line is at most ``around`` lines from one that the endpoint references.

    Only the first referenced file that matches the path is looked at. Ranges
    are compared as ranges; no line is written out for that.
    """
    files = touched(changed)
    return for_files(files, asked_endpoints(files, references, around))


def referenced_lines(changed: DataFrame, references: DataFrame) -> DataFrame:
    """(…, file_idx, path, endpoint_id, line_no): the changed lines that the endpoint references."""
    files = touched(changed)
    rows = for_files(files, asked_lines(files, references, 0))
    return rows.select(*FILE, "path", "endpoint_id", F.explode("lines").alias("line_no"))


def display_lines(changed: DataFrame, references: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """(…, file_idx, path, endpoint_id, lines): the changed lines that are referenced, or else those around them that are; sorted."""
    files = touched(changed)
    return for_files(files, asked_lines(files, references, around))


def display_groups(changed: DataFrame, references: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """``line_groups`` of ``display_lines``, found before they are repeated for each diff file."""
    files = touched(changed)
    asked = asked_lines(files, references, around)
    return for_files(files, asked.select("ask", "endpoint_id", F.inline(C.runs(F.col("lines")))))


#: Lists of what an ask hits are cut into pieces of so many endpoints; a piece is repeated for so many files in one task.
PIECE, DEALT = 1024, 2048


@dataclass
class Hits:
    """The hits of changes, without a row for each.

    What the file of a change that hits most depends on is a list that it shares
    with all files of the same ask. Only what the change's other files and its
    direct hits say is there row by row.

    ``listed`` (ask, repo, pos, endpoint_id, reg_order, lines, detail): what each
    ask hits, in order. ``largest`` (…, file_idx, path, ask, n, before, gone): of
    each change the file that hits most, how many, how many other hits of the
    change come before them, and the places (pos) of those that an earlier hit
    hides. ``kept``: the other hits as ``all_hits`` has them, with lines and
    detail, and is_before, whether they come before those of the largest file.
    """

    listed: DataFrame
    largest: DataFrame
    kept: DataFrame

    def pieces(self, size: int = PIECE) -> DataFrame:
        """(…, file_idx, path, before, row): for each change the list of ``size`` hits after the other of its largest file, as an array.

        Elements have rank and the columns of ``listed``. Lists are repeated for
        the files that ask for them last, and nothing has to be shuffled then.
        """
        spark_partitions = int(self.largest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = self.largest.groupBy("ask").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts"))
        row = F.struct("pos", "endpoint_id", "reg_order", "lines", "detail")
        lists = self.listed.withColumn("piece", F.floor(F.col("pos") / size).cast("int")).groupBy("ask", "piece").agg(F.array_sort(F.collect_list(row)).alias("row"))
        dealt = save_step(lists.join(parts, "ask"), "lists")
        lists = dealt.select("ask", "piece", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row")
        wanted = self.largest.join(parts, "ask").withColumn("part", F.pmod(F.xxhash64(*CHANGE), F.col("parts")).cast("int")).drop("parts")
        wanted = wanted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))))
        start = F.col("piece") * size
        inside = F.filter("gone", lambda p: p.between(start, start + size - 1))
        wanted = wanted.select(*FILE, "path", "ask", "part", "piece", (F.col("before") + start - F.size(F.filter("gone", lambda p: p < start))).alias("before"), inside.alias("gone"))
        of = ["ask", "piece", "part"]
        met = wanted.repartition(spark_partitions, *of).join(lists.repartition(spark_partitions, *of), of)
        places = F.array_except(F.sequence(F.lit(0), F.size("row") - 1), F.transform("gone", lambda p: (p - F.col("piece") * size).cast("int")))
        left = F.when(F.size("gone") == 0, F.col("row")).otherwise(F.transform(places, lambda i: F.get("row", i)))
        return met.select(*FILE, "path", "before", left.alias("row"))

    def rows(self) -> DataFrame:
        """One row per change and endpoint, as ``all_hits`` has it, with lines and detail."""
        listed = self.pieces().select(*FILE, "path", "before", F.posexplode("row").alias("at", "e"))
        medium = F.lit("medium")
        listed = listed.select(
            *CHANGE, "e.endpoint_id", "file_idx", C.confidence_rank(medium).alias("confidence_rank"), "e.reg_order", "path", medium.alias("confidence"),
            (F.col("before") + F.col("at") + 1).cast("int").alias("rank"), "e.lines", "e.detail",
        )
        return self.kept.drop("is_before").unionByName(listed)

    def counts(self) -> DataFrame:
        """(…, hits, high), as ``hit_counts`` has them."""
        kept = self.kept.groupBy(*CHANGE).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("confidence") == "high").alias("high"))
        listed = self.largest.select(*CHANGE, (F.col("n") - F.size("gone")).alias("listed"))
        n = lambda c: F.coalesce(c, F.lit(0))
        return kept.join(listed, CHANGE, "full").select(*CHANGE, (n("kept") + n("listed")).alias("hits"), n("high").alias("high"))

    def told(self, changes: DataFrame, parts: Column, path: Column, between: str) -> DataFrame:
        """``changes`` with the texts of their hits: kept, an array of (rank, confidence, is_before, text) in order, and listed, the texts of the ``n_listed`` hits of the largest file, joined by ``between``; null for none.

        ``parts`` makes of a hit's confidence, lines and detail what its text
        has around each place of the path, and ``path`` writes the path. The
        parts are made once for each ask. A list is one row here, since all of
        it stands in the text of each change that asks for it. It meets the
        changes last: texts of lists are not shuffled once they are repeated.
        """
        spark_partitions = int(self.largest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        joined = lambda texts, by: F.call_function("array_join", texts, by)
        text = joined(parts, path)
        kept = self.kept.groupBy(*CHANGE).agg(F.array_sort(F.collect_list(F.struct("rank", "confidence", "is_before", text.alias("text")))).alias("kept"))
        dealt = self.largest.groupBy("ask").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts"))
        item = F.struct("pos", parts.alias("item"))
        lists = self.listed.withColumn("confidence", F.lit("medium")).groupBy("ask").agg(F.array_sort(F.collect_list(item)).alias("row"))
        lists = save_step(lists.join(dealt, "ask"), "lists")
        lists = lists.select("ask", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row")
        spread = F.xxhash64(*CHANGE)
        files = self.largest.join(dealt, "ask").select(*CHANGE, "path", "ask", "n", "gone", F.pmod(spread, F.col("parts")).cast("int").alias("part"))
        # Changes that hit nothing meet no list, and are dealt to all tasks.
        wanted = changes.join(kept, CHANGE, "left").join(files, CHANGE, "left").withColumn("part", F.coalesce("part", F.pmod(spread, F.lit(1 << 20)).cast("int")))
        of = ["ask", "part"]
        met = wanted.repartition(spark_partitions, *of).join(lists.repartition(spark_partitions, *of), of, "left")
        places = F.array_except(F.sequence(F.lit(0), F.size("row") - 1), "gone")
        left = F.when(F.size("gone") == 0, F.col("row")).otherwise(F.transform(places, lambda i: F.get("row", i)))
        n_left = F.coalesce(F.col("n") - F.size("gone"), F.lit(0))
        listed = F.when(n_left > 0, F.array_join(F.transform(left, lambda x: joined(x["item"], path)), between))
        none = F.array().cast(kept.schema["kept"].dataType)
        return met.select(*changes.columns, F.coalesce("kept", none).alias("kept"), n_left.alias("n_listed"), listed.alias("listed"))


def ranked_hits(changed: DataFrame, endpoints: DataFrame, references: DataFrame, details: DataFrame | None = None) -> Hits:
    """The hits of ``all_hits``. ``details`` (repo, endpoint_id, detail) is what shall be known of endpoints in each hit.

    A file_idx stands for one path of its change, as in a diff.
    """
    files = touched(changed)
    ids = endpoints.groupBy("repo", "endpoint_id").agg(F.min("reg_order").alias("reg_order"))
    ids = ids.join(details, ["repo", "endpoint_id"]) if details else ids.withColumn("detail", F.lit(None).cast("int"))
    # Rows that grow with a square hold the number of an endpoint (at), in the order in which hits are listed, and not what is known of it.
    ids = save_step(numbered(ids, ["repo"], ["reg_order", "endpoint_id"], "at", "endpoints"), "known-endpoints")
    known = save_step(references.join(ids, ["repo", "endpoint_id"], "left_semi"), "known-references")
    asking = save_touched(in_referenced(files, known))
    listed = save_step(asked_hits(asking, known), "asked")
    asks = asking.join(listed.select("ask").distinct(), "ask", "left_semi").select("repo", "ask").distinct()
    listed = listed.join(asks, "ask").join(ids, ["repo", "endpoint_id"])
    place = F.row_number().over(Window.partitionBy("ask").orderBy("at")) - 1
    listed = save_step(listed.select("ask", "repo", place.alias("pos"), "at", "endpoint_id", "reg_order", "lines", "detail"), "listed")

    # Of a change's files with the same ask the first is all that counts.
    of = asking.groupBy(*CHANGE, "ask").agg(F.min(F.struct("file_idx", "path")).alias("b")).join(listed.groupBy("ask").agg(F.count(F.lit(1)).cast("int").alias("n")), "ask")
    of = save_step(of.select(*CHANGE, "ask", "b.file_idx", "b.path", "n"), "files-that-hit")
    largest = of.groupBy(*CHANGE).agg(F.max(F.struct("n", (-F.col("file_idx")).alias("earlier"), "path", "ask")).alias("b"))
    largest = save_step(largest.select(*CHANGE, (-F.col("b.earlier")).alias("file_idx"), "b.path", "b.ask", "b.n"), "largest")
    most = largest.select(*CHANGE, F.col("ask").alias("most"), F.col("file_idx").alias("most_at"), "n")

    first = F.min_by(F.struct("endpoint_id", "file_idx", "reg_order", "path", "detail"), F.struct("file_idx", "reg_order", "path"))
    high = direct_hits(files, endpoints).join(ids.select("repo", "endpoint_id", "at", "detail"), ["repo", "endpoint_id"]).groupBy(*CHANGE, "at").agg(first.alias("b"))
    turn = F.row_number().over(Window.partitionBy(*CHANGE).orderBy("file_idx", "reg_order", "endpoint_id"))
    high = save_step(high.select(*CHANGE, "at", "b.*").withColumn("turn", turn), "high")
    # A hit's place in its change is twice its file's, and one more if it isn't direct.
    step = lambda is_medium: (F.col("file_idx") * 2 + is_medium).alias("step")
    others = of.drop("n").join(most.select(*CHANGE, "most"), CHANGE).where(F.col("ask") != F.col("most")).drop("most")
    others = others.join(listed.select("ask", "at"), "ask").select(*CHANGE, "at", step(1), F.lit(None).cast("int").alias("turn"))
    best = high.select(*CHANGE, "at", step(0), "turn").unionByName(others).repartition(*CHANGE)
    best = best.groupBy(*CHANGE, "at").agg(F.min("step").alias("step"), F.min("turn").alias("turn")).join(most, CHANGE, "left")
    found = best.join(listed.select(F.col("ask").alias("most"), "at", "pos"), ["most", "at"], "left")
    is_before = F.coalesce(F.col("step") < F.col("most_at") * 2 + 1, F.lit(True))
    found = save_step(found.withColumn("is_before", is_before).where("is_before or pos is null").select(*CHANGE, "at", "step", "turn", "is_before", "pos", F.coalesce("n", F.lit(0)).alias("n")), "kept")

    is_direct = F.col("step") % 2 == 0
    order = Window.partitionBy(*CHANGE).orderBy("step", F.when(is_direct, F.col("turn")), "at")
    ahead = F.when(F.col("is_before"), 0).otherwise(F.col("n") - F.count("pos").over(Window.partitionBy(*CHANGE)))
    kept = found.withColumn("rank", (F.row_number().over(order) + ahead).cast("int")).withColumn("file_idx", F.floor(F.col("step") / 2).cast("int"))
    kept = save_step(kept.join(of.select(*FILE, "path", "ask"), FILE, "left").select(*FILE, "at", "path", "ask", "rank", "is_before", is_direct.alias("is_direct")), "kept-ranked")
    columns = [*CHANGE, "endpoint_id", "file_idx", "confidence_rank", "reg_order", "path", "confidence", "rank", "lines", "detail", "is_before"]
    ranked = lambda rows, c: rows.withColumns({"confidence": F.lit(c), "confidence_rank": C.confidence_rank(F.lit(c))}).select(columns)
    told = listed.select("ask", "at", "endpoint_id", "reg_order", "lines", "detail")
    direct = kept.where("is_direct").select(*CHANGE, "at", "rank", "is_before").join(high, [*CHANGE, "at"]).withColumn("lines", F.lit(None).cast(listed.schema["lines"].dataType))
    kept = ranked(direct, "high").unionByName(ranked(kept.where("not is_direct").join(told, ["ask", "at"]), "medium"))
    facts = found.groupBy(*CHANGE).agg(F.count_if("is_before").cast("int").alias("before"), F.sort_array(F.collect_list("pos")).alias("gone"))
    largest = largest.join(facts, CHANGE, "left").withColumns({"before": F.coalesce("before", F.lit(0)), "gone": F.coalesce("gone", F.array().cast("array<int>"))})
    return Hits(listed, save_step(largest, "largest-placed"), kept)


def all_hits(changed: DataFrame, endpoints: DataFrame, references: DataFrame) -> DataFrame:
    """One row per change and endpoint: the first diff file that hits it wins, in a file high before medium.

    Adds confidence and rank, the order of output within the change.
    """
    return ranked_hits(changed, endpoints, references).rows().drop("lines", "detail")


def hits_with_reasons(changed: DataFrame, endpoints: DataFrame, references: DataFrame) -> DataFrame:
    """``with_reasons`` of ``all_hits``: lines and modules are known to the lists of hits before these are repeated."""
    module = endpoints.groupBy("repo", "endpoint_id").agg(F.struct(F.min_by("module", "reg_order").alias("module")).alias("detail"))
    rows = ranked_hits(changed, endpoints, references, module).rows()
    return rows.select(*[c for c in rows.columns if c not in ("lines", "detail")], *reasons(F.col("detail.module")))


def high_hits(changed: DataFrame, endpoints: DataFrame, references: DataFrame) -> DataFrame:
    """(…, endpoint_id, file_idx, path, reg_order): the rows of ``all_hits`` whose confidence is high, without looking for the others.

    A direct hit is hidden only where a file before it in the change depends on
    the endpoint, so that just those files are looked up.
    """
    files = touched(changed)
    direct = direct_hits(files, endpoints).groupBy(*CHANGE, "endpoint_id").agg(F.min(F.struct("file_idx", "reg_order", "path")).alias("b"))
    direct = save_step(direct.select(*CHANGE, "endpoint_id", "b.*"), "direct")
    before = direct.select(*CHANGE, "endpoint_id", F.col("file_idx").alias("at")).join(files, CHANGE).where("file_idx < at")
    before = save_step(before.select(*files.columns, "endpoint_id"), "files-before")
    hidden = before.join(asked_endpoints(before, references), ["ask", "endpoint_id"], "left_semi").select(*CHANGE, "endpoint_id").distinct()
    return direct.join(hidden, [*CHANGE, "endpoint_id"], "left_anti")


def hit_counts(changed: DataFrame, endpoints: DataFrame, references: DataFrame) -> DataFrame:
    """(…, hits, high): how many rows ``all_hits`` has for a change, and how many of them are high.

    What the largest file of a change depends on is only counted. What its other
    files hit is told apart one by one, and looked up among that.
    """
    files = touched(changed)
    high = high_hits(files, endpoints, references)
    known = save_step(references.join(endpoints.select("repo", "endpoint_id").distinct(), ["repo", "endpoint_id"], "left_semi"), "known-references")
    asking = save_touched(in_referenced(files, known))
    asked = save_step(asked_endpoints(asking, known), "asked")
    sizes = asked.groupBy("ask").agg(F.count(F.lit(1)).alias("n"))
    of = save_step(asking.select(*CHANGE, "ask").distinct().join(sizes, "ask"), "files-that-hit")
    largest = of.groupBy(*CHANGE).agg(F.max(F.struct("n", "ask")).alias("b")).select(*CHANGE, F.col("b.n").alias("n_largest"), F.col("b.ask").alias("largest"))
    largest = save_step(largest, "largest")
    others = of.join(largest, CHANGE).where(F.col("ask") != F.col("largest")).select(*CHANGE, "ask").join(asked, "ask").select(*CHANGE, "endpoint_id")
    direct = direct_hits(files, endpoints).select(*CHANGE, "endpoint_id")
    others = others.unionByName(direct).distinct().join(largest.select(*CHANGE, "largest"), CHANGE, "left")
    more = others.join(asked.withColumnRenamed("ask", "largest"), ["largest", "endpoint_id"], "left_anti").groupBy(*CHANGE).agg(F.count(F.lit(1)).alias("more"))
    n_high = high.groupBy(*CHANGE).agg(F.count(F.lit(1)).alias("high"))
    out = largest.join(more, CHANGE, "full").join(n_high, CHANGE, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*CHANGE, (n("n_largest") + n("more")).alias("hits"), n("high").alias("high"))


def above_threshold(hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Hits whose confidence weighs ``threshold`` or more. Apply after ``all_hits``: a file that hits first hides later ones."""
    return hits.where(C.weight(F.col("confidence")) >= threshold)


def with_reasons(hits: DataFrame, lines: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Adds reason, dependency_chain and changed_files."""
    handler = endpoints.groupBy("repo", "endpoint_id").agg(F.min_by("module", "reg_order").alias("module"))
    rows = hits.join(lines, [*FILE, "path", "endpoint_id"], "left").join(handler, ["repo", "endpoint_id"], "left")
    return rows.select(*[F.col(c) for c in hits.columns], *reasons(F.col("module")))


def reasons(module: Column) -> list[Column]:
    """reason, dependency_chain and changed_files of a hit with the columns confidence, path and lines."""
    high = F.col("confidence") == "high"
    return [
        F.when(high, C.direct_reason(F.col("path"))).otherwise(C.dependency_reason(F.col("path"), F.col("lines"))).alias("reason"),
        F.when(high, F.array("path")).otherwise(F.array(C.chain_start(module), F.col("path"))).alias("dependency_chain"),
        F.array("path").alias("changed_files"),
    ]


def line_groups(lines: DataFrame) -> DataFrame:
    """Runs of consecutive displayed lines, (…, endpoint_id, path, first, last)."""
    return lines.select(*FILE, "path", "endpoint_id", F.inline(C.runs(F.array_sort(F.array_distinct("lines")))))


def texts_of(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, first, last, found): of each distinct range the lines that the file has of it, as an array of texts.

    ``files`` has repo, file_path and content. Files without a range are left
    out before their text is looked at; lines are cut out of the text by their
    number, and no others become rows.
    """
    wanted = ranges.select("repo", "path", "first", "last").distinct().groupBy("repo", "path").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    text = files.where(F.col("content").isNotNull()).select("repo", F.col("file_path").alias("path"), F.split(F.regexp_replace("content", "\n$", ""), "\n").alias("lines"))
    start = lambda r: F.greatest(F.lit(1), r["first"]).cast("int")
    count = lambda r: F.greatest(F.lit(0), r["last"] - start(r) + 1).cast("int")
    cut = F.transform("runs", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), F.slice("lines", start(r), count(r)).alias("found")))
    return text.join(wanted, ["repo", "path"]).select("repo", "path", F.inline(cut))


def frames(groups: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds function_name and code_context to runs of lines.

    The function is the first symbol (repo, endpoint_id, sym_ord, file_path,
    symbol_name, start_line, end_line) of the endpoint in exactly this file that
    holds the run's first line, or else ``module``. The context is the text of
    the lines in ``files`` (repo, file_path, content), with a heading if they are
    several, and empty if the file doesn't have the first one.
    """
    keys = [*FILE, "path", "endpoint_id", "first", "last"]
    of = ["repo", "endpoint_id", "path"]
    owned = disjoint_segments(symbols.withColumnRenamed("file_path", "path"), of)
    owner = meet(groups, owned, of, F.col("start_line"), F.col("end_line"), "first").select(*keys, F.col("symbol_name").alias("function_name"))
    out = groups.join(owner, keys, "left").join(texts_of(groups, files), ["repo", "path", "first", "last"], "left")
    return out.select(*keys, F.coalesce("function_name", F.lit("module")).alias("function_name"), context_of_run().alias("code_context"))


def context_of_run() -> Column:
    """The text of a run of lines, from the columns first, last and found, as ``texts_of`` has it."""
    body = F.array_join(F.transform("found", lambda x: F.rtrim(x)), "\n")
    head = F.concat(F.lit("[lines "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit("]\n"))
    there = (F.size("found") > 0) & (F.col("first") >= 1)
    return F.when(F.coalesce(there, F.lit(False)), F.when(F.col("last") > F.col("first"), F.concat(head, body)).otherwise(body)).otherwise("")


#: Up to so many endpoints with a symbol in a run are kept beside it; if there are more, all endpoints of the run are joined with them.
OWNERS = 64


def display_frames(changed: DataFrame, references: DataFrame, symbols: DataFrame, files: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """``frames`` of ``display_groups``, found before they are repeated for each diff file.

    A text is that of a path and a run of lines, whatever the endpoint is. Only
    endpoints with a symbol in exactly this file have another function than
    ``module``; these are few, and looked up for each path, ask and run.
    Endpoints are repeated for the diff files last, and not shuffled after that.
    """
    rows = touched(changed)
    run = ["ask", "first", "last"]
    place = ["repo", "path", *run]
    groups = save_step(asked_lines(rows, references, around).select("ask", "endpoint_id", F.inline(C.runs(F.col("lines")))), "asked-groups")
    wanted = save_step(rows.select(*FILE, "path", "ask").join(groups.select(*run).distinct(), "ask"), "wanted-runs")
    places = save_step(wanted.select(*place).distinct(), "places")
    owned = disjoint_segments(symbols.withColumnRenamed("file_path", "path"), ["repo", "endpoint_id", "path"])
    owners = meet(places, owned, ["repo", "path"], F.col("start_line"), F.col("end_line"), "first").join(groups, [*run, "endpoint_id"])
    owners = save_step(owners.select(*place, "endpoint_id", F.col("symbol_name").alias("function_name")), "owners")
    counts = owners.groupBy(*place).agg((F.count(F.lit(1)) > OWNERS).alias("is_many"))
    few = owners.join(counts.where("not is_many").drop("is_many"), place).groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct("endpoint_id", "function_name"))).alias("owned"))
    many = counts.where("is_many")
    texts = texts_of(places, files).withColumn("code_context", context_of_run()).drop("found")
    told = wanted.join(texts, ["repo", "path", "first", "last"], "left").join(few, place, "left").join(many, place, "left")
    told = save_step(told.select(*FILE, "path", *run, F.coalesce("code_context", F.lit("")).alias("code_context"), "owned", "is_many"), "told-runs")
    out = lambda rows, name: rows.select(*FILE, "path", "endpoint_id", "first", "last", F.coalesce(name, F.lit("module")).alias("function_name"), "code_context")
    named = groups.join(many.drop("is_many"), run).join(owners, [*place, "endpoint_id"], "left")
    plain = told.where("is_many is null").drop("is_many").join(groups, run)
    return out(plain, F.col("owned")[F.col("endpoint_id")]).unionByName(out(told.where("is_many").drop("is_many", "owned").join(named, place), F.col("function_name")))


def with_call_stacks(affected: DataFrame, stacks: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds call_stack, an array of frames (file_path, line_number, function_name, code_context); empty for direct hits.

    ``stacks`` (repo, endpoint_id, stack_ord, file_path, frames) holds for each
    file that an endpoint reaches the frames of the calls to it; the first file
    that matches the changed path counts. Where there is such a stack the
    changed lines come after it: ``frames`` as ``frames`` above returns them.
    """
    medium = affected.where("confidence = 'medium'")
    chosen = first_reference(medium, stacks.withColumnRenamed("stack_ord", "ref_ord"), ["repo"]).select("repo", "endpoint_id", "path", "file_path")
    chosen = chosen.join(stacks.select("repo", "endpoint_id", "file_path", F.col("frames").alias("calls")), ["repo", "endpoint_id", "file_path"]).drop("file_path")
    frame = F.struct(F.col("path").alias("file_path"), F.col("first").cast("int").alias("line_number"), "function_name", "code_context")
    keys = [*FILE, "path", "endpoint_id"]
    shown = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", frame.alias("f")))).alias("shown"))
    rows = medium.join(chosen, ["repo", "endpoint_id", "path"]).join(shown, keys, "left").where(F.size("calls") > 0)
    kind = f"array<{FRAME}>"
    lines = F.coalesce(F.transform("shown", lambda x: x["f"]).cast(kind), F.array().cast(kind))
    rows = rows.select(*CHANGE, "endpoint_id", F.concat(F.col("calls").cast(kind), lines).alias("call_stack"))
    return affected.join(rows, [*CHANGE, "endpoint_id"], "left").withColumn("call_stack", F.coalesce("call_stack", F.array().cast(kind)))


def code_context(ranges: DataFrame, files: DataFrame, around: int = C.WINDOW_LINES) -> DataFrame:
    """``ranges`` (repo, file_path, first, last) with a row for each line of ``files`` (repo, file_path, content) from ``around`` before ``first`` to ``around`` after ``last``.

    Adds line_no, text and is_highlight, which is true inside of the range.
    """
    wide = ranges.withColumns({"_from": F.greatest(F.lit(1), F.col("first") - around), "_to": F.col("last") + around})
    texts = texts_of(wide.select("repo", F.col("file_path").alias("path"), F.col("_from").alias("first"), F.col("_to").alias("last")), files)
    texts = texts.select("repo", F.col("path").alias("file_path"), F.col("first").alias("_from"), F.col("last").alias("_to"), "found")
    met = wide.join(texts, ["repo", "file_path", "_from", "_to"]).select(*ranges.columns, "_from", F.posexplode("found").alias("_at", "text"))
    met = met.withColumn("line_no", (F.col("_from") + F.col("_at")).cast("int"))
    return met.drop("_from", "_at").withColumn("is_highlight", F.col("line_no").between(F.col("first"), F.col("last")))


def symbol_at_line(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, endpoint_id, path, line_no, symbol_name): the first symbol of the endpoint in a matching file that holds the line.

    Whether a file matches a path is a matter of their base names (see
    ``operators.paths``), so the symbols of an endpoint in all files of one name
    are flattened together: a line then meets one range per endpoint and name,
    however many files have that name.
    """
    of = ["repo", "name", "bare"]
    keyed = keys_of_files(symbols, ["repo"], "sym_ord", "symbol_name", "endpoint_id", "start_line", "end_line")
    owned = disjoint_segments(keyed, ["repo", "endpoint_id", "key"])
    # Paths of a class have the same symbols: each line of a class is looked up once, and what is found repeated for its paths last.
    paths = wanted.select("repo", "path", "line_no", *class_of(F.col("path"))).distinct()
    lines = paths.select(*of, "line_no").distinct()
    classes = lines.select(*of).distinct().withColumn("path", F.concat(F.when(F.col("bare"), "").otherwise("/"), "name"))
    asked = lines.join(keys_of_paths(classes, keyed, ["repo"]).join(classes, ["repo", "path"]).select(*of, "key"), of)
    met = meet(asked, owned, ["repo", "key"], F.col("start_line"), F.col("end_line"))
    found = met.groupBy("endpoint_id", *of, "line_no").agg(F.min_by("symbol_name", F.struct("sym_ord", "symbol_name")).alias("symbol_name"))
    return paths.join(found, [*of, "line_no"]).select("repo", "endpoint_id", "path", "line_no", "symbol_name")
