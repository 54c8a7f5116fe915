"""Lines and ranges that meet in bins, owners of lines, and texts of several repositories."""

import random

from pyspark.sql import functions as F

from rippletrace.operators import impact as I


def test_lines_meet_ranges_like_all_pairs(spark):
    draw = random.Random(2)
    lines = [(draw.choice("ab"), draw.randrange(-5, 400)) for _ in range(200)]
    ranges = [(draw.choice("abc"), i, s, s + draw.randrange(-3, 150)) for i in range(150) for s in [draw.randrange(-100, 400)]] + [("a", 900, None, 5), ("a", 901, 3, None)]
    met = I.meet(spark.createDataFrame(lines, "k string, line_no int"), spark.createDataFrame(ranges, "k string, i int, s int, e int"), ["k"], F.col("s"), F.col("e"))
    found = sorted((r["k"], r["line_no"], r["i"]) for r in met.collect())
    assert found == sorted((k, n, i) for k, n in lines for j, i, s, e in ranges if j == k and s is not None and e is not None and s <= n <= e)


def test_many_lines_and_ranges_of_one_file(spark):
    """A hundred thousand of each: about six million comparisons in bins, not ten thousand million."""
    lines = spark.range(100_000).select(F.lit("r").alias("repo"), F.col("id").alias("line_no"))
    ranges = spark.range(100_000).select(F.lit("r").alias("repo"), F.col("id").alias("s"), (F.col("id") + 1).alias("e"))
    assert I.meet(lines, ranges, ["repo"], F.col("s"), F.col("e")).count() == 199_999


def plain_owner(ranges, line):
    held = [(o, n) for s, e, o, n in ranges if s <= line <= e]
    return min(held) if held else None


def test_sweep_gives_the_first_symbol_of_each_line():
    draw = random.Random(5)
    for _ in range(300):
        ranges = sorted(((s := draw.randrange(40)), s + draw.randrange(12), draw.randrange(5), draw.choice("xy")) for _ in range(draw.randrange(9)))
        found = list(I.sweep(iter(ranges)))
        assert all(a[1] < b[0] for a, b in zip(found, found[1:])) and all(s <= e for s, e, _, _ in found)
        assert not any(a[1] + 1 == b[0] and a[2:] == b[2:] for a, b in zip(found, found[1:]))
        for line in range(60):
            assert plain_owner(found, line) == plain_owner(ranges, line)


def test_owners_in_ten_thousand_files_of_one_name(spark):
    """Each endpoint has one range left per line, whatever number of files has the name."""
    rows = spark.range(10_000).select(
        F.lit("r").alias("repo"), (F.col("id") % 10).cast("string").alias("endpoint_id"), F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/__init__.py")).alias("file_path"),
        F.col("id").alias("sym_ord"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol_name"), F.lit(1).alias("start_line"), F.lit(50).alias("end_line"),
    )
    wanted = spark.range(1, 40).select(F.lit("r").alias("repo"), F.lit("x/__init__.py").alias("path"), F.col("id").cast("int").alias("line_no"))
    found = I.symbol_at_line(wanted, rows).collect()
    assert len(found) == 390 and {(r["endpoint_id"], r["symbol_name"]) for r in found} == {(str(i), f"s{i}") for i in range(10)}
    assert I.disjoint_segments(rows, ["repo", "endpoint_id"]).count() == 10


def test_symbols_of_matching_files(spark):
    rows = [("r", "e", f, i, f"s{i}", 1, 9) for i, f in enumerate(["lib/util.py", "util.py", "til.py", "a/b/my_util.py"])]
    symbols = spark.createDataFrame(rows, "repo string, endpoint_id string, file_path string, sym_ord int, symbol_name string, start_line int, end_line int")
    paths = ["x/util.py", "util.py", "l.py", "x/my_util.py", "q/other.py", "x/stil.py"]
    found = {r["path"]: r["symbol_name"] for r in I.symbol_at_line(spark.createDataFrame([("r", p, 3) for p in paths], "repo string, path string, line_no int"), symbols).collect()}
    match = lambda f, p: f.endswith(p) or p.endswith(f) or f.rsplit("/", 1)[-1] == p.rsplit("/", 1)[-1]
    assert found == {p: next(n for _, _, f, _, n, _, _ in rows if match(f, p)) for p in paths if any(match(f, p) for _, _, f, *_ in rows)}


def test_texts_of_two_repositories_with_the_same_path(spark):
    files = spark.createDataFrame([("r1", "a.py", "one\ntwo  \nthree\n"), ("r2", "a.py", "uno\ndos"), ("r2", "b.py", None), ("r2", "c.py", "")], "repo string, file_path string, content string")
    runs = [("r1", 1, 0, "a.py", "e", 1, 2), ("r2", 1, 0, "a.py", "e", 1, 2), ("r2", 2, 0, "a.py", "e", 2, 7), ("r2", 2, 0, "a.py", "e", 9, 9), ("r2", 2, 0, "b.py", "e", 1, 1), ("r2", 2, 0, "c.py", "e", 1, 1), ("r3", 1, 0, "a.py", "e", 1, 1)]
    groups = spark.createDataFrame(runs, "repo string, change_id int, file_idx int, path string, endpoint_id string, first int, last int")
    symbols = spark.createDataFrame([("r1", "e", 5, "a.py", "late", 1, 9), ("r1", "e", 2, "a.py", "early", 1, 1), ("r2", "e", 0, "a.py", "other", 2, 2)], "repo string, endpoint_id string, sym_ord int, file_path string, symbol_name string, start_line int, end_line int")
    found = {(r["repo"], r["path"], r["first"]): (r["function_name"], r["code_context"]) for r in I.frames(groups, symbols, files).collect()}
    assert found == {
        ("r1", "a.py", 1): ("early", "[lines 1-2]\none\ntwo"), ("r2", "a.py", 1): ("module", "[lines 1-2]\nuno\ndos"), ("r2", "a.py", 2): ("other", "[lines 2-7]\ndos"),
        ("r2", "a.py", 9): ("module", ""), ("r2", "b.py", 1): ("module", ""), ("r2", "c.py", 1): ("module", ""), ("r3", "a.py", 1): ("module", ""),
    }
    shown = I.code_context(spark.createDataFrame([("r1", "a.py", 2, 2), ("r2", "a.py", 2, 2)], "repo string, file_path string, first int, last int"), files, 1)
    assert sorted(tuple(r) for r in shown.select("repo", "line_no", "text", "is_highlight").collect()) == [
        ("r1", 1, "one", False), ("r1", 2, "two  ", True), ("r1", 3, "three", False), ("r2", 1, "uno", False), ("r2", 2, "dos", True)
    ]


def test_only_wanted_texts_are_cut(spark):
    """Files are joined with what is wanted of them before their lines become rows."""
    files = spark.createDataFrame([("r", f"{i}.py", "x\n" * 10) for i in range(5)], "repo string, file_path string, content string")
    plan = I.texts_of(spark.createDataFrame([("r", "1.py", 1, 2)], "repo string, path string, first int, last int"), files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and plan.count("Generate") == 1
