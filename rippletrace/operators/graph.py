"""Call tracing: naming call targets, resolving them, and what each endpoint reaches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rippletrace.functions import columns as C
from rippletrace.sources.tables import Growing, save_step

#: Fixed value: lines of a module that are referenced where no function is found in it.
MODULE_LINES = (1, 20)


def callee_name(call_sites: DataFrame) -> DataFrame:
    """Adds fullname: the resolved name, else the receiver's class and the member, else the receiver and the member, else null."""
    member = F.col("member")
    return call_sites.withColumn(
        "fullname",
        F.coalesce(
            F.nullif("callee_fullname", F.lit("")),
            F.concat("receiver_type", F.lit("."), member),
            F.concat("receiver_fullname", F.lit("."), member),
        ),
    )


def prefixes_of(names: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, fullname, prefix, n): each distinct name with all its dotted prefixes, itself included."""
    parts = F.split("fullname", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(parts, 1, i), ".").alias("prefix")))
    return names.select(*keys, "fullname").where("fullname is not null").distinct().select(*keys, "fullname", F.inline(prefixes))


def resolve_module(names: DataFrame, modules: DataFrame, keys: list[str] = []) -> DataFrame:
    """(``keys``, fullname, module) for distinct names: the longest dotted prefix that is a module; others are dropped."""
    rows = prefixes_of(names, keys).withColumnRenamed("prefix", "module")
    return rows.join(modules.select(*keys, "module").distinct(), [*keys, "module"]).groupBy(*keys, "fullname").agg(F.max_by("module", "n").alias("module"))


def resolve_function(wanted: DataFrame, symbols: DataFrame, keys: list[str] = []) -> DataFrame:
    """``wanted`` (``keys``, module, name) with the first symbol of that name in the module, by order of definition.

    A method is found by its bare name, in whatever class comes first.
    """
    by = [*keys, "module", "name"]
    rest = F.struct(*[F.col(c) for c in symbols.columns if c not in by])
    return wanted.select(*by).distinct().join(symbols, by).groupBy(*by).agg(F.min_by(rest, "def_order").alias("s")).select(*by, "s.*")


def resolve_targets(names: DataFrame, modules: DataFrame, symbols: DataFrame, keys: list[str] = []) -> DataFrame:
    """(``keys``, fullname, module, file_path, name, start_line, end_line, found) for distinct names inside the project.

    The symbol is what follows the module in the name, of which the last part
    is looked up. A module without it is referenced by its first lines.
    """
    owned = resolve_module(names, modules, keys)
    rest = F.substr(F.col("fullname"), F.length("module") + 2)
    last = F.element_at(F.split(F.when(rest != "", rest).otherwise(F.col("fullname")), r"\."), -1)
    owned = owned.withColumn("name", last)
    hit = resolve_function(owned, symbols, keys).select(*keys, "module", "name", "start_line", "end_line", F.lit(True).alias("found"))
    out = owned.join(hit, [*keys, "module", "name"], "left").join(modules.select(*keys, "module", "file_path"), [*keys, "module"])
    end = F.when(F.col("found"), C.symbol_end(F.col("start_line"), F.col("end_line"))).otherwise(MODULE_LINES[1])
    return out.select(
        *keys,
        "fullname",
        "module",
        "file_path",
        "name",
        F.coalesce("start_line", F.lit(MODULE_LINES[0])).alias("start_line"),
        end.alias("end_line"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def handler_roots(endpoints: DataFrame, modules: DataFrame, symbols: DataFrame, keys: list[str] = []) -> DataFrame:
    """Where tracing starts: the handler's function in its module, or just the handler's lines if there is none."""
    of = endpoints.join(modules.select(*keys, "file_path", F.col("module").alias("found_module")), [*keys, "file_path"], "left")
    first = resolve_function(of.select(*keys, F.col("found_module").alias("module"), "name"), symbols, keys)
    first = first.select(*keys, F.col("module").alias("found_module"), "name", F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.lit(True).alias("found"))
    out = of.join(first, [*keys, "found_module", "name"], "left")
    end = F.when(F.col("found"), C.symbol_end(F.col("s"), F.col("e"))).otherwise(C.impact_end(F.col("start_line"), F.col("end_line")))
    start = F.when(F.col("found"), F.col("s")).otherwise(F.col("start_line"))
    return out.select(*keys, "endpoint_id", "reg_order", "file_path", "name", start.alias("start_line"), end.alias("end_line"), F.coalesce("found", F.lit(False)).alias("is_traced"))


#: After so many rounds the tables of the rounds are written together as one.
COMPACT_EVERY = 16


def expand(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], name: str) -> DataFrame:
    """All rows (endpoint, node, …) that ``step`` makes from those of the round before, the first of each (endpoint, node).

    What was reached lies in buckets by endpoint and node, so that a round
    shuffles only its new rows to leave out those that were there before. Each
    round writes its rows to the shared folder; a lost executor costs one round.
    Rounds end when nothing new is found, however many that takes: a cycle ends
    because nothing is reached twice.
    """
    reached, keys = Growing(start, name, "endpoint", "node"), ["endpoint", "node"]
    frontier, depth = reached.rows().drop("_round"), 0
    while not frontier.isEmpty():
        depth += 1
        frontier = reached.add(step(frontier, depth).join(reached.rows().select(*keys), keys, "left_anti"))
        if reached.rounds > COMPACT_EVERY:
            reached = reached.compacted()
    return reached.done()


def reachability(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(endpoint, node, depth): all nodes that each root reaches over ``edges`` (caller, callee), itself at depth 0.

    Endpoints with the same root share its walk: what a root reaches doesn't
    depend on which of them asks.
    """
    roots = save_step(roots.select("endpoint", "node").distinct(), "roots")
    edges = Growing(edges.select("caller", "callee").distinct(), "edges", "caller")
    calls = edges.rows().select("caller", "callee")
    start = roots.select(F.col("node").alias("endpoint"), "node").distinct().withColumn("depth", F.lit(0))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        met = frontier.join(calls, F.col("node") == F.col("caller"))
        return met.select("endpoint", F.col("callee").alias("node")).distinct().withColumn("depth", F.lit(depth))

    found = _of_endpoints(roots, expand(start, step, "reached"))
    edges.done()
    return found


def call_stacks(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(endpoint, node, stack): the shortest chain of callers from the root, the node itself left out.

    Of chains equally short the one through the smallest place in the caller's
    order counts, then the smallest caller. ``edges`` has caller, callee and ord.
    """
    roots = save_step(roots.select("endpoint", "node").distinct(), "roots")
    edges = save_step(edges.select("caller", "callee", "ord"), "edges")
    kind = roots.schema["node"].dataType.simpleString()
    start = roots.select(F.col("node").alias("endpoint"), "node").distinct().withColumn("stack", F.array().cast(f"array<{kind}>"))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        met = frontier.join(edges, F.col("node") == F.col("caller"))
        met = met.select("endpoint", F.col("callee").alias("target"), F.concat("stack", F.array("node")).alias("stack"), "ord", "caller")
        return met.groupBy("endpoint", F.col("target").alias("node")).agg(F.min_by("stack", F.struct("ord", "caller")).alias("stack"))

    return _of_endpoints(roots, expand(start, step, "stacks"))


def first_visits(reached: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(endpoint, node, place, parent, stack): in which order a walk from each root first comes to the nodes that it reaches.

    The walk goes depth first along the calls of a function in their order
    (``edges`` has caller, callee and ord) and enters no node twice, the root
    included, which has place 0. ``parent`` is the node that it came from. Where
    a node is the first of its file (``files`` has node and file) that the walk
    comes to, not counting the root, ``stack`` has the callers that lead to it
    from the root on; elsewhere it is null. ``reached`` is as ``reachability``
    returns it, with the root as node at depth 0.

    The calls of a function are put in order once, whatever roots reach it.
    Rows of a root come one after the other, and a task holds those of one root
    at a time; roots are spread over tasks. Endpoints with the same root share
    its walk.
    """
    kind = edges.schema["callee"].dataType.simpleString()
    of = reached.where("depth = 0").select("endpoint", F.col("node").alias("root"))
    # One endpoint of each root stands for all.
    chosen = of.groupBy("root").agg(F.min("endpoint").alias("endpoint"))
    calls = edges.where("callee is not null").join(files.select(F.col("node").alias("callee"), "file").distinct(), "callee", "left")
    calls = calls.groupBy("caller").agg(F.array_sort(F.collect_list(F.struct("ord", "callee", "file"))).alias("c")).select("caller", "c.callee", "c.file")
    inside = reached.join(chosen, "endpoint").select("root", F.col("node").alias("caller")).join(calls, "caller", "left").select("root", "caller", "callee", "file")
    form = StructType.fromDDL(f"root {kind}, node {kind}, place int, parent {kind}, stack array<{kind}>")
    types = to_arrow_schema(form)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for root, group in groupby(rows, lambda r: r[0]):
            for row in walk(root, {caller: list(zip(callees or (), at or ())) for _, caller, callees, at in group}):
                out.append((root, *row))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], types.names)

    walked = inside.repartition("root").sortWithinPartitions("root").mapInArrow(work, form)
    return of.join(walked, "root").select("endpoint", "node", "place", "parent", "stack")


def walk(root: Any, calls: dict[Any, list[tuple]]) -> Iterator[tuple]:
    """(node, place, parent, stack) of ``first_visits`` from one root; ``calls`` has the callees of each function in order, with their files."""
    yield root, 0, None, None
    seen, files_seen, path, cursors, place = {root}, set(), [root], [iter(calls.get(root, ()))], 0
    while path:
        to, file = next(cursors[-1], (None, None))
        if to is None:
            path.pop()
            cursors.pop()
        elif to not in seen:
            seen.add(to)
            place += 1
            new = file is not None and file not in files_seen
            files_seen.add(file)
            yield to, place, path[-1], list(path) if new else None
            path.append(to)
            cursors.append(iter(calls.get(to, ())))


def _of_endpoints(roots: DataFrame, walked: DataFrame) -> DataFrame:
    """What was walked from each root, for each endpoint that has it."""
    of = roots.select("endpoint", F.col("node").alias("root"))
    return of.join(walked.withColumnRenamed("endpoint", "root"), "root").drop("root")


def stacks_by_file(stacks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(endpoint, file_path, node, stack): for each file that an endpoint reaches the shortest stack, then that of the smallest node."""
    best = F.min(F.struct(F.size("stack").alias("n"), "node", "stack")).alias("b")
    rows = stacks.join(symbols.select("node", "file_path"), "node").groupBy("endpoint", "file_path").agg(best)
    return rows.select("endpoint", "file_path", "b.node", "b.stack")


def endpoint_lines(reached: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct (endpoint, file_path, start_line, end_line): spans of reached functions and lines of calls in them.

    ``symbols`` has node, file_path, start_line and end_line, ``calls`` has
    caller and line. Ranges stay ranges; single lines have equal ends.
    """
    spans = reached.join(symbols, "node").select("endpoint", "file_path", "start_line", C.symbol_end(F.col("start_line"), F.col("end_line")).alias("end_line"))
    lines = reached.join(calls.select(F.col("caller").alias("node"), "line").distinct(), "node").join(symbols.select("node", "file_path"), "node")
    return spans.union(lines.select("endpoint", "file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))).distinct()


def endpoint_symbols(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(endpoint, sym_ord, node, file_path, symbol_name, start_line, end_line), breadth first, then by node."""
    place = F.row_number().over(Window.partitionBy("endpoint").orderBy("depth", "node")) - 1
    fields = ["endpoint", place.alias("sym_ord"), "node", "file_path", F.col("fullname").alias("symbol_name"), "start_line"]
    return reached.join(symbols, "node").select(*fields, C.symbol_end(F.col("start_line"), F.col("end_line")).alias("end_line"))


def visited_symbols(visits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(endpoint, sym_ord, node, file_path, symbol_name, start_line, end_line) in order of the first visit."""
    end = C.symbol_end(F.col("start_line"), F.col("end_line"))
    fields = ["endpoint", F.col("place").alias("sym_ord"), "node", "file_path", F.col("fullname").alias("symbol_name"), "start_line", end.alias("end_line")]
    return visits.join(symbols, "node").select(*fields)
