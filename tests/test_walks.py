"""First visits and ordered symbols: one pass over what is reached, without a data frame for each root."""

from rippletrace.operators import graph as G


def test_first_visits_walk_roots_without_a_frame_each(spark):
    """Also for roots that call nothing, which aren't looked up a second time."""
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (3, 1, 0), (1, 2, 2)], "caller long, callee long, ord int")
    reached = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("b", 1, 0), ("b", 2, 1), ("b", 3, 1), ("c", 9, 0)], "endpoint string, node long, depth int")
    files = spark.createDataFrame([(2, "x"), (3, "x"), (1, "y")], "node long, file string")
    found = G.first_visits(reached, edges, files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "Union" not in plan and plan.count("MapInArrow") == 1
    rows = sorted(tuple(r) for r in found.collect())
    of = lambda e: [(e, 1, 0, None, None), (e, 2, 1, 1, [1]), (e, 3, 2, 1, None)]
    assert rows == [*of("a"), *of("b"), ("c", 9, 0, None, None)]


def test_a_walk_keeps_no_recursion_and_no_place_of_unknown_files():
    n = 20_000
    rows = list(G.walk(0, {i: [(i + 1, None), (0, "f")] for i in range(n)}))
    assert [(r[0], r[1]) for r in rows] == [(i, i) for i in range(n + 1)] and all(r[3] is None for r in rows)


def test_symbols_are_ordered_in_one_pass(spark):
    """What is reached meets the symbols once, and isn't joined with its own order again."""
    reached = spark.createDataFrame([("a", 5, 0), ("a", 9, 1), ("a", 2, 1), ("b", 2, 0)], "endpoint string, node long, depth int")
    symbols = spark.createDataFrame([(n, "f", f"m.{n}", n, None) for n in (2, 5, 9)], "node long, file_path string, fullname string, start_line int, end_line int")
    found = G.endpoint_symbols(reached, symbols)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [("a", 0, 5, "f", "m.5", 5, 55), ("a", 1, 2, "f", "m.2", 2, 52), ("a", 2, 9, "f", "m.9", 9, 59), ("b", 0, 2, "f", "m.2", 2, 52)]
