"""The catalogue of endpoints and look-ups in it.

An endpoint row has repo, reg_order (its place in the registration), path,
methods, name, tags, dependencies, endpoint_id and the handler's module,
file_path, start_line and end_line. Look-ups take a table of what is looked up,
so that many are one join; the looked-up side is usually small and then Spark
broadcasts it by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions import columns as C
from rippletrace.operators.paths import match_handler_file


def api_endpoints(routes: DataFrame) -> DataFrame:
    """Routes of the class APIRoute, with known methods only and their endpoint_id."""
    rows = routes.where(F.col("route_class") == "APIRoute").withColumn("methods", C.known_methods(F.col("methods")))
    return rows.withColumn("endpoint_id", C.endpoint_id(F.col("methods"), F.col("path"))).drop("route_class")


def route_dependencies(routes: DataFrame) -> DataFrame:
    """Adds dependencies: those of the route, then the names of ``Depends`` defaults, in order, repeats kept.

    ``routes`` has route_dependencies, an array of names, and param_defaults,
    an array of structs (kind, name).
    """
    used = F.transform(F.filter("param_defaults", lambda x: x["kind"] == "Depends"), lambda x: x["name"])
    return routes.withColumn("dependencies", F.concat("route_dependencies", used))


def lookup_equal(endpoints: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Endpoints whose ``column`` is one of ``wanted``'s, a table with that column."""
    return endpoints.join(wanted.select(column).distinct(), column)


def lookup_member(endpoints: DataFrame, wanted: DataFrame, column: str, member: str) -> DataFrame:
    """Endpoints whose array ``column`` holds one of ``wanted``.``member``; a row per endpoint and member."""
    rows = endpoints.withColumn(member, F.explode(F.array_distinct(column)))
    return rows.join(wanted.select(member).distinct(), member)


def registry_files(endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, file_path, file_order): handler files by when they were first registered."""
    return endpoints.groupBy(*keys, "file_path").agg(F.min("reg_order").alias("file_order"))


def lookup_line_range(endpoints: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Handlers that overlap ranges (``keys``, path, first, last) of a file, the path being matched with one handler file."""
    files = match_handler_file(ranges, registry_files(endpoints, keys), keys)
    start, end = F.col("start_line"), C.lookup_end(F.col("start_line"), F.col("end_line"))
    met = ranges.join(files, [*keys, "path"]).join(endpoints.drop("path"), [*keys, "file_path"])
    return met.where((start <= F.col("last")) & (end >= F.col("first")))


def index_by(endpoints: DataFrame, *keys: str) -> DataFrame:
    """Endpoints grouped by ``keys``: their number and their ids in order of registration."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("reg_order", "endpoint_id"))), lambda x: x["endpoint_id"])
    return endpoints.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_endpoints"), ordered.alias("endpoint_ids"))


def registry_index(endpoints: DataFrame) -> DataFrame:
    """The three indexes in one pass: (kind, value, n_endpoints, first_registered) by path, file and module."""
    keys = {"path": "path", "file": "file_path", "module": "module"}
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in keys.items()]))
    rows = endpoints.select("reg_order", sets.alias("key")).select("reg_order", "key.kind", "key.value").where("value is not null")
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_endpoints"), F.min("reg_order").alias("first_registered"))


def registry_distincts(endpoints: DataFrame) -> DataFrame:
    """One row: how many endpoints, files, modules and paths there are."""
    return endpoints.agg(
        F.count(F.lit(1)).alias("n_endpoints"),
        F.count_distinct("file_path").alias("n_files"),
        F.count_distinct("module").alias("n_modules"),
        F.count_distinct("path").alias("n_paths"),
    )


def registered(wanted: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``wanted`` (endpoint_id) with a flag whether it is registered."""
    known = endpoints.select("endpoint_id").distinct().withColumn("is_registered", F.lit(True))
    return wanted.join(known, "endpoint_id", "left").withColumn("is_registered", F.coalesce("is_registered", F.lit(False)))


def missing_from_cache(endpoints: DataFrame, cached: DataFrame) -> DataFrame:
    """Endpoints to analyse: one per id that ``cached`` doesn't have, the first registered."""
    new = endpoints.join(cached.select("endpoint_id").distinct(), "endpoint_id", "left_anti")
    first = Window.partitionBy("endpoint_id").orderBy("reg_order")
    return new.withColumn("_at", F.row_number().over(first)).where("_at = 1").drop("_at")


def listing(endpoints: DataFrame) -> DataFrame:
    """Rows of the endpoint table in Markdown, with their order."""
    cells = [
        F.array_join("methods", ", "),
        F.concat(F.lit("`"), "path", F.lit("`")),
        F.concat(F.lit("`"), "name", F.lit("`")),
        F.concat(F.lit("`"), C.basename(F.col("file_path")), F.lit("`")),
        F.col("start_line").cast("string"),
    ]
    return endpoints.select("reg_order", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))
