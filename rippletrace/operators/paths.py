"""Matching changed paths with known files.

A changed path matches a known file if they are equal, either one ends with the
other, or their base names are equal. Written as such that is a comparison of
all with all. It is the same as: equal base names, or one of the two has no
slash and the other ends with it. So all but slash-less paths meet by an
equi-join on the base name, and slash-less ones by an equi-join on each
possible ending of a base name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.functions import columns as C
from rippletrace.sources.tables import save_step


def endings(name: Column) -> Column:
    """All endings of a name, the whole one included."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substr(name, i))


def keys_of_files(known: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """(``keys``, key, ``columns``): rows with a file_path by the texts that a path is matched by.

    ``n:`` and the base name for each row; ``f:`` and the name for files without
    a slash, which match paths that end with it.
    """
    file = F.col("file_path")
    texts = F.array_compact(F.array(F.concat(F.lit("n:"), C.basename(file)), F.when(~file.contains("/"), F.concat(F.lit("f:"), file))))
    return known.select(*keys, F.explode(texts).alias("key"), *columns)


def keys_of_paths(changed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, path, key): for each path the keys of ``known`` (``keys_of_files``) that match it.

    Equal base names, a path without a slash that a base name ends with, and a
    file without a slash that the path ends with.
    """
    a = changed.select(*keys, "path").distinct()
    name, there = C.basename(F.col("path")), known.select(*keys, "key").distinct()
    own = a.select(*keys, "path", F.explode(F.array_append(F.transform(endings(name), lambda e: F.concat(F.lit("f:"), e)), F.concat(F.lit("n:"), name))).alias("key"))
    own = own.join(there, [*keys, "key"]).select(*keys, "path", "key")
    bare = a.where(~F.col("path").contains("/")).select(*keys, "path", F.col("path").alias("ending"))
    longer = there.where(F.col("key").startswith("n:")).select(*keys, "key", F.explode(endings(F.expr("substring(key, 3)"))).alias("ending"))
    return own.unionByName(bare.join(longer, [*keys, "ending"]).select(*keys, "path", "key")).distinct()


def match_paths(changed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (``keys``, path, file_path) that match; inputs have ``keys`` and path, or ``keys`` and file_path."""
    files = keys_of_files(known.select(*keys, "file_path").distinct(), keys, "file_path")
    return keys_of_paths(changed, files, keys).join(files, [*keys, "key"]).select(*keys, "path", "file_path").distinct()


def _last_two(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*/[^/]*$", 0)


def match_handler_file(changed: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, path, file_path): for each path the one registered file that it stands for.

    ``registered`` has ``keys``, file_path and file_order. An equal path comes
    first; then the first file, by order, that ends with the path, or with the
    path without its leading dots and slashes, or has its base name and holds
    it.

    Files with a common base name never all meet the paths with that name. A
    path of one or two parts is an ending of a file's last one or two parts, and
    of the files that have it only the first counts. In longer paths the last
    two parts are whole and equal to the file's. A path that lies inside a file's
    path and not at its end has its base name in the file's folder.
    """
    path, file, order = F.col("path"), F.col("file_path"), F.struct("file_order", "file_path")
    # Both are looked at several times, and may take long to make.
    paths, registered = save_step(changed.select(*keys, "path").distinct(), "paths"), save_step(registered.select(*keys, "file_path", "file_order"), "registered")
    equal = paths.join(registered.select(*keys, F.col("file_path").alias("path")).distinct(), [*keys, "path"])
    rest = paths.join(equal, [*keys, "path"], "left_anti")
    wanted = rest.select(*keys, "path", F.explode(F.array_distinct(F.array(path, F.ltrim(path, F.lit("./"))))).alias("end"))
    slashes = F.length(F.regexp_replace("end", "[^/]", ""))
    known = registered.withColumn("name", C.basename(file))
    # Paths of one part, which may be nothing but dots and slashes, and of two, whose second last part need not be whole.
    one = known.select(*keys, "file_order", "file_path", F.explode(F.array_distinct(F.concat(endings(F.col("name")), F.array(F.lit(""))))).alias("end"))
    folder = F.regexp_extract(file, "([^/]*)/[^/]*$", 1)
    whole = F.transform(F.sequence(F.lit(1), F.length(folder) + 1), lambda i: F.concat(F.substr(folder, i), F.lit("/"), "name"))
    two = known.where(file.contains("/")).select(*keys, "file_order", "file_path", F.explode(whole).alias("end"))
    first = one.unionByName(two).groupBy(*keys, "end").agg(F.min(order).alias("best"))
    short = wanted.where(slashes < 2).join(first, [*keys, "end"]).select(*keys, "path", "best")
    longer = wanted.where(slashes >= 2).withColumn("last", _last_two(F.col("end")))
    longer = longer.join(known.withColumn("last", _last_two(file)), [*keys, "last"]).where(file.endswith(F.col("end"))).select(*keys, "path", order.alias("best"))
    twice = known.where(F.expr("locate(name, file_path) <= length(file_path) - length(name)"))
    inside = rest.where(path.contains("/")).withColumn("name", C.basename(path)).join(twice, [*keys, "name"]).where(file.contains(path))
    best = short.unionByName(longer).unionByName(inside.select(*keys, "path", order.alias("best")))
    best = best.groupBy(*keys, "path").agg(F.min("best").alias("best"))
    return equal.select(*keys, "path", path.alias("file_path")).unionByName(best.select(*keys, "path", "best.file_path"))


def class_of(path: Column) -> list[Column]:
    """(name, bare): all that matters of a path when references are looked up, its base name and whether it is nothing else."""
    return [C.basename(path).alias("name"), (~path.contains("/")).alias("bare")]


def first_of_classes(classes: DataFrame, referenced: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, name, bare, endpoint_id, file_path, ref_ord): of an endpoint's files that match paths of a class, the first referenced.

    ``classes`` has ``keys``, name and bare, as ``class_of`` makes them. An equal
    base name is a match whatever else the paths hold, so that only the first of
    an endpoint's files with a base name counts, for all paths with that name.
    Endings of base names matter for paths and files without a slash, and are
    compared once for each different name.
    """
    best = F.min(F.struct("ref_ord", "file_path")).alias("best")
    files = referenced.select(*keys, "endpoint_id", "file_path", "ref_ord")
    first = files.withColumn("name", C.basename(F.col("file_path"))).groupBy(*keys, "endpoint_id", "name").agg(best)
    classes = classes.select(*keys, "name", "bare").distinct()
    shorter = lambda name: F.explode(F.slice(endings(name), 2, 1 << 30)).alias("ending")
    longer = first.select(*keys, "name").distinct().select(*keys, F.col("name").alias("known"), shorter(F.col("name")))
    ended = classes.where("bare").withColumn("ending", F.col("name")).join(longer, [*keys, "ending"]).select(*keys, "name", "bare", "known")
    known = first.withColumnRenamed("name", "known")
    met = classes.withColumn("known", F.col("name")).unionByName(ended).join(known, [*keys, "known"]).select(*keys, "name", "bare", "endpoint_id", "best")
    # A file without a slash that the path ends with.
    short = files.where(~F.col("file_path").contains("/")).groupBy(*keys, "endpoint_id", F.col("file_path").alias("ending")).agg(best)
    ends = classes.select(*keys, "name", "bare", shorter(F.col("name"))).join(short, [*keys, "ending"])
    met = met.unionByName(ends.select(*keys, "name", "bare", "endpoint_id", "best"))
    met = met.groupBy(*keys, "name", "bare", "endpoint_id").agg(F.min("best").alias("best"))
    return met.select(*keys, "name", "bare", "endpoint_id", "best.file_path", "best.ref_ord")


#: Paths of a common base name are dealt into so many parts.
PARTS = 64


def first_reference(changed: DataFrame, referenced: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, endpoint_id, path, file_path, ref_ord): of an endpoint's files that match a path, the first referenced.

    ``referenced`` has ``keys``, endpoint_id, file_path and ref_ord. The files
    are found once for all paths of a class (``first_of_classes``); paths meet
    them last, and nothing is shuffled after that. The paths of a class are dealt
    into parts, for each of which its files are repeated.
    """
    of = [*keys, "name", "bare"]
    paths = changed.select(*keys, "path").distinct().select(*keys, "path", *class_of(F.col("path")), F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part"))
    parts = paths.select(*of, "part").distinct()
    first = first_of_classes(parts, referenced, keys).join(parts, of)
    return paths.join(first, [*of, "part"]).select(*keys, "endpoint_id", "path", "file_path", "ref_ord")
