"""Reading and writing the tables of the library, and step tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippletrace.functions import columns as C


#: Stand-ins for the shared folder, by application.
_own: dict[str, str] = {}
#: The step tables written inside of ``step_scope``, if there is one.
_scope: ContextVar[list[str] | None] = ContextVar("steps", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a temporary folder of this machine stands in
    for it; on a cluster executors couldn't read each other's files there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="rippletrace-")
        _own[app] = found
    return found


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: it is read again from what was written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def save_step(df: DataFrame, name: str, by: str = "") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; files hold one value each of the column ``by``, if named.

    This cuts the lineage: a lost executor costs the tasks of the current step
    and not the steps before it. Tables lie under a folder named after the
    application, which can be removed when the application has ended;
    ``drop_steps`` and ``step_scope`` remove them earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.partitionBy(*[by] if by else []).parquet(path, compression="zstd")
    if (written := _scope.get()) is not None:
        written.append(path)
    saved = spark.read.schema(df.schema).parquet(path).select(df.columns)
    saved.step_path = path
    return saved


def numbered(rows: DataFrame, keys: list[str], order: list[str], into: str, name: str) -> DataFrame:
    """Adds ``into``, the place from 0 on of each row among those with its ``keys``, by ``order``.

    Rows are dealt into ranges of their order and written; a row's place is that
    in its range and the number of rows in the ranges before. No task holds all
    rows of a key, however few keys there are.
    """
    dealt = save_step(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), name)
    ranges = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of"), before.alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = dealt.join(ranges, reduce(and_, same, F.col("_range") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    return met.withColumn(into, (F.col("_before") + place).cast("int")).select(*rows.columns, into)


class Growing:
    """A table in the shared folder to which rounds add rows, kept in buckets by ``keys``.

    Joins on the keys read it without a shuffle, however many rounds there were.
    It is known to the catalogue until ``done``; its files then stay as those of
    a step table do.
    """

    def __init__(self, first: DataFrame, name: str, *keys: str) -> None:
        self.spark, self.name, self.keys, self.columns = first.sparkSession, name, keys, first.columns
        self.rounds, self.older = 0, []
        self.path = f"{shared_dir(self.spark)}/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self.table = f"rippletrace_{uuid.uuid4().hex}"
        if (written := _scope.get()) is not None:
            written.append(self.path)
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Add a round's rows; they are returned as they were written."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        out = rows.select(*self.columns, F.lit(self.rounds).alias("_round")).write.partitionBy("_round").bucketBy(buckets, *self.keys).mode("append")
        with _shuffles_dropped(self.spark):
            out.option("path", self.path).option("compression", "zstd").saveAsTable(self.table)
        self.rounds += 1
        return self.rows().where(F.col("_round") == self.rounds - 1).drop("_round")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def compacted(self) -> Growing:
        """The same rows written together, as one file a bucket; what was returned before can still be read until ``done``."""
        new = Growing(self.rows().select(*self.columns), self.name, *self.keys)
        new.older = [*self.older, self]
        return new

    def done(self) -> DataFrame:
        """All rows; the table leaves the catalogue, and what it was compacted from is removed."""
        schema = self.rows().select(*self.columns).schema
        for t in (self, *self.older):
            self.spark.sql(f"DROP TABLE {t.table}")
        for t in self.older:
            _remove(self.spark, t.path)
        return self.spark.read.schema(schema).parquet(self.path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_steps(*tables: DataFrame) -> None:
    """Remove step tables, as ``save_step`` returned them, that nothing will read again."""
    for t in tables:
        _remove(t.sparkSession, t.step_path)


@contextmanager
def step_scope(spark: SparkSession) -> Iterator[None]:
    """Step tables written inside are removed at the end; what is wanted of them must have been written elsewhere by then."""
    written: list[str] = []
    outer = _scope.set(written)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in written:
            _remove(spark, path)


HANDLER = "struct<name:string,module:string,file:string,line:int,end_line:int>"
ENDPOINT = f"struct<path:string,methods:array<string>,handler:{HANDLER},name:string,tags:array<string>,dependencies:array<string>>"
CATALOG = f"struct<total:bigint,endpoints:array<{ENDPOINT}>>"
SYMBOL = "struct<file_path:string,symbol_name:string,start_line:int,end_line:int>"
FRAME = "struct<file_path:string,line_number:int,function_name:string,code_context:string>"
DEPENDENCIES = (
    "map<string,struct<methods:array<string>,path:string,referenced_files:map<string,array<int>>,"
    f"referenced_symbols:array<{SYMBOL}>,call_stacks:map<string,array<{FRAME}>>>>"
)


def change_of(source: Column, root: str) -> Column:
    """The change that a file stands for: its path below ``root``; its name if it is ``root``; its whole path if ``root`` is a pattern."""
    bare = lambda x: re.sub("^file:/+", "/", x).rstrip("/")
    path, root = F.regexp_replace(source, "^file:/+", "/"), bare(root)
    below = F.when(path == root, C.basename(path)).when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30))
    return below.otherwise(path)


def read_diffs(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """(repo, change_id, diff_source, diff_text): one change per file under ``path``, a file, folder or pattern."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    source = F.col("_metadata.file_path")
    return files.select(F.lit(repo).alias("repo"), change_of(source, path).alias("change_id"), source.alias("diff_source"), F.col("value").alias("diff_text"))


def source_lines(files: DataFrame) -> DataFrame:
    """(repo, file_path, line_no, text) of ``files`` (file_path, content, and repo if it is there), lines counted from 1; no content, no lines."""
    keys, text = [c for c in ("repo", "file_path") if c in files.columns], F.regexp_replace("content", "\n$", "")
    rows = files.where(F.col("content").isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "text"))
    return rows.select(*keys, (F.col("n") + 1).alias("line_no"), "text")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, module, content) of the Python files below ``root``, without hidden folders and caches."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").text(root, wholetext=True)
    base = root.rstrip("/").rpartition("/")[0]
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rows = files.select(path.alias("file_path"), F.col("value").alias("content"))
    inner = F.replace(F.col("file_path"), F.lit(base + "/"), F.lit(""))
    return rows.withColumn("module", C.module_name(inner)).where(~C.is_hidden(inner))


def catalog_json(endpoints: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, catalog): the endpoints of each key in order, as one JSON document."""
    handler = F.struct("name", "module", F.col("file_path").alias("file"), F.col("start_line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"))
    row = F.struct("reg_order", F.struct("path", "methods", handler.alias("handler"), "name", "tags", "dependencies").alias("e"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["e"])
    return endpoints.groupBy(*keys).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"), rows.alias("endpoints"))).alias("catalog"))


def parse_catalog(catalogs: DataFrame, *keys: str) -> DataFrame:
    """Endpoints of catalogue documents (``keys``, catalog), with their place as reg_order."""
    rows = catalogs.select(*keys, F.posexplode(F.from_json("catalog", CATALOG)["endpoints"]).alias("reg_order", "e"))
    handler = [F.col(f"e.handler.{a}").alias(b) for a, b in (("module", "module"), ("file", "file_path"), ("line", "start_line"), ("end_line", "end_line"))]
    return rows.select(*keys, "reg_order", "e.path", "e.methods", F.col("e.handler.name").alias("name"), *handler, "e.tags", "e.dependencies")


def dependency_json(lines: DataFrame, symbols: DataFrame, *keys: str, endpoints: DataFrame | None = None, stacks: DataFrame | None = None) -> DataFrame:
    """(``keys``, cache): per key a JSON object from endpoint ids to what they depend on.

    ``lines`` has file_path, start_line and end_line of referenced ranges,
    ``symbols`` the reached functions with sym_ord, ``endpoints`` methods and
    path, ``stacks`` file_path and frames; all have ``keys`` and endpoint_id.
    Without ``endpoints`` or ``stacks`` methods and path are null and stacks
    empty. A document holds all endpoints of its key: choose keys, such as the
    repository and the endpoint, that keep documents small.
    """
    of = [*keys, "endpoint_id"]
    span = F.flatten(F.collect_list(F.sequence("start_line", "end_line")))
    files = lines.groupBy(*of, "file_path").agg(F.sort_array(F.array_distinct(span)).alias("lines"))
    files = files.groupBy(*of).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_path", "lines")))).alias("referenced_files"))
    named = F.struct("sym_ord", F.struct("file_path", "symbol_name", "start_line", "end_line").alias("s"))
    out = files.join(symbols.groupBy(*of).agg(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["s"]).alias("referenced_symbols")), of, "left")
    if endpoints is not None:
        out = out.join(endpoints.groupBy(*of).agg(F.min_by(F.struct("methods", F.col("path")), "reg_order").alias("e")).select(*of, "e.*"), of, "left")
    else:
        out = out.withColumns({"methods": F.lit(None).cast("array<string>"), "path": F.lit(None).cast("string")})
    if stacks is not None:
        entry = F.array_sort(F.collect_list(F.struct("file_path", F.col("frames").cast(f"array<{FRAME}>").alias("frames"))))
        out = out.join(stacks.groupBy(*of).agg(F.map_from_entries(entry).alias("call_stacks")), of, "left")
    else:
        out = out.withColumn("call_stacks", F.lit(None).cast(f"map<string,array<{FRAME}>>"))
    empty = {"referenced_symbols": F.array().cast(f"array<{SYMBOL}>"), "call_stacks": F.create_map().cast(f"map<string,array<{FRAME}>>")}
    row = F.struct("methods", "path", "referenced_files", *[F.coalesce(F.col(n).cast(e_type), e).alias(n) for n, e, e_type in (
        ("referenced_symbols", empty["referenced_symbols"], f"array<{SYMBOL}>"), ("call_stacks", empty["call_stacks"], f"map<string,array<{FRAME}>>"))])
    return out.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("endpoint_id", row.alias("deps"))))).alias("cache"))


def parse_dependencies(caches: DataFrame, *keys: str) -> DataFrame:
    """(``keys``, endpoint_id, methods, path, referenced_files, referenced_symbols, call_stacks) of cache documents; what is missing is empty."""
    rows = caches.select(*keys, F.explode(F.from_json("cache", DEPENDENCIES)).alias("endpoint_id", "d"))
    fields = rows.schema["d"].dataType
    empty = {"methods": F.array(), "referenced_files": F.create_map(), "referenced_symbols": F.array(), "call_stacks": F.create_map()}
    filled = {x: F.coalesce(F.col(f"d.{x}"), e.cast(fields[x].dataType)).alias(x) for x, e in empty.items()}
    return rows.select(*keys, "endpoint_id", filled["methods"], "d.path", *[filled[x] for x in ("referenced_files", "referenced_symbols", "call_stacks")])


def cached_references(parsed: DataFrame, repo: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, symbols and stacks, as ``jobs.trace`` makes them, of what ``parse_dependencies`` read back.

    Files come in the order of the document, which is that of their names.
    """
    named = F.lit(repo).alias("repo")
    files = parsed.select(named, "endpoint_id", F.posexplode(F.map_entries("referenced_files")).alias("ref_ord", "f"))
    files = files.select("repo", "endpoint_id", "ref_ord", F.col("f.key").alias("file_path"), F.explode("f.value").alias("start_line"))
    symbols = parsed.select(named, "endpoint_id", F.posexplode("referenced_symbols").alias("sym_ord", "s")).select("repo", "endpoint_id", "sym_ord", "s.*")
    stacks = parsed.select(named, "endpoint_id", F.posexplode(F.map_entries("call_stacks")).alias("stack_ord", "f"))
    stacks = stacks.select("repo", "endpoint_id", "stack_ord", F.col("f.key").alias("file_path"), F.col("f.value").alias("frames"))
    return files.withColumn("end_line", F.col("start_line")), symbols, stacks
