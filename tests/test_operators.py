"""Operators on hand-made rows, and two properties."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rippletrace.functions import columns as C
from rippletrace.jobs.impact import analyse
from rippletrace.operators import diffs as D
from rippletrace.operators import endpoints as E
from rippletrace.operators import graph as G
from rippletrace.operators import impact as I
from rippletrace.operators import paths as P
from rippletrace.operators import report as R
from rippletrace.sources import tables as T

ENDPOINT = (
    "repo string, reg_order int, path string, methods array<string>, endpoint_id string, name string, module string, file_path string, start_line int, end_line int, "
    "tags array<string>, dependencies array<string>"
)


@pytest.fixture(scope="module")
def endpoints(spark):
    rows = [
        ("r", 0, "/api/users", ["GET"], "GET /api/users", "get_users", "routers.users", "/app/routers/users.py", 10, 25, ["users"], ["get_db"]),
        ("r", 1, "/api/users", ["POST"], "POST /api/users", "create_user", "routers.users", "/app/routers/users.py", 30, 50, [], ["get_db", "verify_token"]),
    ]
    return spark.createDataFrame(rows, ENDPOINT)


def diff_of(spark, *texts):
    return spark.createDataFrame([("r", f"c{i}", t) for i, t in enumerate(texts)], "repo string, change_id string, diff_text string")


MODIFIED = "--- a/app/routers/users.py\n+++ b/app/routers/users.py\t2024\n@@ -9,3 +9,4 @@\n ctx\n-old\n+new one\n+new two\n ctx\n trailing text beyond the hunk\n"


def test_modified_file(spark):
    parsed = D.parse_diffs(diff_of(spark, MODIFIED))
    f = D.diff_files(parsed).first()
    assert (f["path"], f["change_type"], f["added"], f["removed"], f["is_python"], f["source_path"]) == ("app/routers/users.py", "modified", 2, 1, True, None)
    assert sorted((r["side"], r["line_no"]) for r in D.changed_lines(parsed).collect()) == [("added", 10), ("added", 11), ("removed", 10)]
    assert [tuple(r)[-2:] for r in D.affected_ranges(parsed).collect()] == [(9, 13)]


def test_kinds_of_files(spark):
    text = (
        "--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n+a\n+b\n"
        "--- a/gone.sql\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- sql comment\n-x\n"
        "--- a/old.py\n+++ b/b/backend/x.py\n@@ -5 +5 @@\n-a\n+b\n\\ No newline at end of file\n"
    )
    parsed = D.parse_diffs(diff_of(spark, text))
    assert D.diff_errors(parsed).count() == 0 and "Exchange" not in parsed._jdf.queryExecution().executedPlan().toString()
    found = [(r["path"], r["change_type"], r["source_path"], r["added"], r["removed"]) for r in D.diff_files(parsed).orderBy("file_idx").collect()]
    assert found == [("new.py", "added", None, 2, 0), ("gone.sql", "deleted", None, 0, 2), ("b/backend/x.py", "renamed", "old.py", 1, 1)]
    compat = [r["path"] for r in D.diff_files(parsed, compat=True).orderBy("file_idx").collect()]
    assert compat == ["new.py", "gone.sql", "ackend/x.py"]


def test_bad_and_empty_diffs(spark):
    short = "--- a/x.py\n+++ b/x.py\n@@ -1,5 +1,5 @@\n a\n-b\n+c\n--- a/y.py\n+++ b/y.py\n@@ -1,1 +1,1 @@\n-a\n+b\n"
    parsed = D.parse_diffs(diff_of(spark, short, "", None, MODIFIED))
    assert [tuple(r)[1:] for r in D.diff_errors(parsed).collect()] == [("c0", "Failed to parse diff: hunk 1")]
    assert [r["change_id"] for r in D.diff_files(parsed).collect()] == ["c3"]
    assert D.diff_files(D.parse_diffs(diff_of(spark, "x").limit(0))).count() == 0


def test_files_without_names(spark):
    """Renames, modes, binary and empty files, with git's header alone, next to a file with names."""
    text = (
        "diff --git a/old.py b/new.py\nsimilarity index 100%\nrename from old.py\nrename to new.py\n"
        "diff --git a/run.py b/run.py\nold mode 100644\nnew mode 100755\n"
        "diff --git a/empty.py b/empty.py\nnew file mode 100644\nindex 0000000..e69de29\n"
        "diff --git a/x.png b/x.png\nindex 1..2 100644\nBinary files a/x.png and b/x.png differ\n"
        "diff --git a/gone.py b/gone.py\ndeleted file mode 100644\nindex e69de29..0000000\n"
        "diff --git a/m.py b/m.py\nindex 1..2 100644\n--- a/m.py\n+++ b/m.py\n@@ -3 +3 @@\n-a\n+b\n"
        "Binary files a/y.png and /dev/null differ\n"
    )
    parsed = D.parse_diffs(diff_of(spark, text))
    found = [(r["path"], r["change_type"], r["source_path"], r["added"], r["removed"]) for r in D.diff_files(parsed).orderBy("file_idx").collect()]
    assert found == [
        ("new.py", "renamed", "old.py", 0, 0), ("run.py", "modified", None, 0, 0), ("empty.py", "added", None, 0, 0), ("x.png", "modified", None, 0, 0),
        ("gone.py", "deleted", None, 0, 0), ("m.py", "modified", None, 1, 1), ("y.png", "deleted", None, 0, 0),
    ]
    assert [(r["file_idx"], r["path"], r["line_no"]) for r in D.changed_in_python(parsed).collect()] == [(5, "m.py", 3)]


def test_a_huge_diff_is_parsed_in_linear_time():
    n = 300_000
    error, files, hunks, lines = D.parse_diff(f"--- a/x.py\n+++ b/x.py\n@@ -1,{n} +1,{n} @@\n" + "-a\n+b\n" * n)
    assert error is None and len(lines) == 2 * n and lines[-1][4] == n and files == [(0, "a/x.py", "b/x.py", n, n)]


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(C.endpoint_id(F.array(F.lit("POST"), F.lit("GET")), F.lit("/api/users"))) == "GET,POST /api/users"
    assert [value(C.is_python(F.lit(p))) for p in ("services/user_service.py", "frontend/app.js", ".py", "a/.py")] == [True, False, False, False]
    assert value(C.module_name(F.lit("app/pkg/__init__.py"))) == "app.pkg"
    assert value(C.is_hidden(F.lit("app/.git/x.py"))) and not value(C.is_hidden(F.lit("app/x.py")))
    assert [value(C.impact_end(F.lit(5), F.lit(e))) for e in (0, None, 9)] == [55, 55, 9]
    assert [value(C.symbol_end(F.lit(5), F.lit(e))) for e in (0, None, 9)] == [0, 55, 9]
    assert value(C.traceback_text(F.array().cast(f"array<{T.FRAME}>"))) == ""


def test_look_ups(spark, endpoints):
    wanted = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    assert E.lookup_equal(endpoints, wanted("path", "/api/users"), "path").count() == 2
    assert E.lookup_member(endpoints, wanted("m", "GET"), "methods", "m").count() == 1
    assert E.lookup_member(endpoints, wanted("t", "users", "nonexistent"), "tags", "t").count() == 1
    assert E.lookup_member(endpoints, wanted("d", "get_db"), "dependencies", "d").count() == 2
    ranges = spark.createDataFrame([("r", "routers/users.py", 15, 20), ("r", "routers/users.py", 35, 40)], "repo string, path string, first int, last int")
    assert sorted((r["first"], r["name"]) for r in E.lookup_line_range(endpoints, ranges, ["repo"]).collect()) == [(15, "get_users"), (35, "create_user")]
    assert tuple(E.registry_distincts(endpoints).first()) == (2, 1, 1, 1)


def test_impact(spark, endpoints):
    references = spark.createDataFrame(
        [("r", "GET /api/users", 0, "/app/services/user.py", 20, 30, 0, "get"), ("r", "POST /api/users", 0, "/other/user.py", 100, 110, 0, "make")],
        "repo string, endpoint_id string, ref_ord int, file_path string, start_line int, end_line int, sym_ord int, symbol_name string",
    )
    near = "--- a/services/user.py\n+++ b/services/user.py\n@@ -31,2 +31,3 @@\n a\n+new\n b\n"
    hit = near + MODIFIED
    found = analyse(diff_of(spark, MODIFIED, near, hit, "junk"), endpoints, references)
    rows = sorted((r["change_id"], r["endpoint_id"], r["confidence"], r["reason"]) for r in found.affected.collect())
    direct, lines = "Handler function directly modified in app/routers/users.py", "Type analysis shows dependency on services/user.py (lines [29, 30])"
    # In the third change the first file hides the direct hit in the second.
    assert rows == [("c0", "GET /api/users", "high", direct), ("c1", "GET /api/users", "medium", lines), ("c2", "GET /api/users", "medium", lines)]
    assert {r["change_id"]: r["affected_endpoints"] for r in found.summary.collect()} == {"c0": 1, "c1": 1, "c2": 1, "c3": 0}
    strict = analyse(diff_of(spark, MODIFIED, near, hit), endpoints, references, threshold=0.8)
    assert [r["change_id"] for r in strict.affected.collect()] == ["c0"]
    low = found.affected.withColumn("confidence", F.lit("low"))
    assert [r["confidence_rank"] for r in R.by_confidence(low).collect()] == [2, 2, 2] and I.above_threshold(low).count() == 0


def test_path_rule_equals_the_plain_comparison(spark):
    draws = random.Random(1)
    name = lambda: "/".join(draws.choice(["a", "b", "user.py", "superuser.py", "main.py", ".py", "r.py"]) for _ in range(draws.randrange(1, 4)))
    changed, known = sorted({name() for _ in range(150)}), sorted({name() for _ in range(150)})
    last = lambda p: p.rsplit("/", 1)[-1]
    expected = {(p, f) for p in changed for f in known if f.endswith(p) or p.endswith(f) or last(p) == last(f)}
    a = spark.createDataFrame([("r", p) for p in changed], "repo string, path string")
    b = spark.createDataFrame([("r", f) for f in known], "repo string, file_path string")
    assert {(r["path"], r["file_path"]) for r in P.match_paths(a, b, ["repo"]).collect()} == expected


def test_handler_files_equal_the_plain_rule(spark):
    draws = random.Random(2)
    parts = ["a", "ba", "user.py", "superuser.py", ".py", "r.py", "user.pyx", "", ".", ".."]
    name = lambda: "/".join(draws.choice(parts) for _ in range(draws.randrange(1, 6)))
    changed, known = sorted({name() for _ in range(700)} - {""}), sorted({name() for _ in range(500)} - {""})
    draws.shuffle(known)
    last = lambda p: p.rsplit("/", 1)[-1]
    expected = {}
    for p in changed:
        fits = [f for f in known if f.endswith(p) or f.endswith(p.lstrip("./")) or last(p) == last(f) and p in f]
        if p in known or fits:
            expected[p] = p if p in known else fits[0]
    a = spark.createDataFrame([("r", p) for p in changed], "repo string, path string")
    b = spark.createDataFrame([("r", f, i) for i, f in enumerate(known)], "repo string, file_path string, file_order int")
    found = P.match_handler_file(a, b, ["repo"]).collect()
    assert {r["path"]: r["file_path"] for r in found} == expected and len(found) == len(expected)


def test_first_references_equal_the_plain_rule(spark):
    draws = random.Random(3)
    name = lambda: "/".join(draws.choice(["a", "b", "user.py", "superuser.py", "main.py", ".py", "r.py"]) for _ in range(draws.randrange(1, 4)))
    changed, files = sorted({name() for _ in range(120)}), [(e, f, o) for e in ("x", "y", "z") for o, f in enumerate(sorted({name() for _ in range(60)}, key=lambda _: draws.random()))]
    last = lambda p: p.rsplit("/", 1)[-1]
    expected = {}
    for e, f, o in files:
        for p in changed:
            if f.endswith(p) or p.endswith(f) or last(p) == last(f):
                expected[e, p] = min(expected.get((e, p), (o, f)), (o, f))
    a = spark.createDataFrame([("r", p) for p in changed], "repo string, path string")
    b = spark.createDataFrame([("r", *f) for f in files], "repo string, endpoint_id string, file_path string, ref_ord int")
    assert {(r["endpoint_id"], r["path"]): (r["ref_ord"], r["file_path"]) for r in P.first_reference(a, b, ["repo"]).collect()} == expected


def test_common_base_names_do_not_meet(spark):
    """10,000 paths and 10,000 files of one base name: the joins stay as large as their results."""
    a = spark.range(10_000).select(F.lit("r").alias("repo"), F.concat(F.lit("src/p"), F.col("id").cast("string"), F.lit("/__init__.py")).alias("path"))
    b = spark.range(10_000).select(F.lit("r").alias("repo"), F.concat(F.lit("/srv/src/p"), (2 * F.col("id")).cast("string"), F.lit("/__init__.py")).alias("file_path"), F.col("id").alias("file_order"))
    assert P.match_handler_file(a, b, ["repo"]).count() == 5_000
    refs = b.select("repo", F.lit("e").alias("endpoint_id"), "file_path", F.col("file_order").alias("ref_ord"))
    found = P.first_reference(a, refs, ["repo"])
    assert found.count() == 10_000 and found.where("ref_ord = 0").count() == 10_000


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_equals_a_search(spark, seed):
    draws = random.Random(seed)
    edges = sorted({(draws.randrange(25), draws.randrange(25)) for _ in range(40)})
    out = {}
    for root in (0, 1, 2):
        todo, seen = [root], {root}
        while todo:
            n = todo.pop()
            for a, b in edges:
                if a == n and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= {(root, n): 1 for n in seen}
    roots = spark.createDataFrame([(r, r) for r in (0, 1, 2)], "endpoint long, node long")
    table = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "caller long, callee long, ord int")
    assert {(r["endpoint"], r["node"]) for r in G.reachability(roots, table).collect()} == set(out)
    for r in G.call_stacks(roots, table).collect():
        chain = [*r["stack"], r["node"]]
        assert chain[0] == r["endpoint"] and all(p in edges for p in zip(chain, chain[1:]))


def test_a_deep_chain_ends(spark, monkeypatch):
    """More rounds than any limit would allow; tables of rounds are written together."""
    monkeypatch.setattr(G, "COMPACT_EVERY", 5)
    n = 40
    roots = spark.createDataFrame([("a", 0), ("b", 0), ("c", 30)], "endpoint string, node long")
    table = spark.createDataFrame([(i, i + 1, 0) for i in range(n)] + [(n, 3, 0)], "caller long, callee long, ord int")
    found = {(r["endpoint"], r["node"]): r["depth"] for r in G.reachability(roots, table).collect()}
    assert {k: d for k, d in found.items() if k[0] == "a"} == {("a", i): i for i in range(n + 1)}
    assert len(found) == 2 * (n + 1) + n - 2 and found["c", 3] == n - 30 + 1
    assert {r["node"]: len(r["stack"]) for r in G.call_stacks(roots, table).where("endpoint = 'b'").collect()} == {i: i for i in range(n + 1)}


def test_step_tables_are_removed(spark):
    one = T.save_step(spark.range(3).toDF("x"), "one")
    with T.step_scope(spark):
        two = T.save_step(one, "two")
        assert two.count() == 3
    folder = lambda t: os.path.exists(t.step_path.removeprefix("file://"))
    assert folder(one) and not folder(two)
    T.drop_steps(one)
    assert not folder(one)


def test_files_are_read(spark, tmp_path):
    (tmp_path / "app" / ".hidden").mkdir(parents=True)
    (tmp_path / "app" / "x.py").write_text("a\nb\n")
    (tmp_path / "app" / ".hidden" / "y.py").write_text("a\n")
    (tmp_path / "one.diff").write_text(MODIFIED)
    rows = T.read_sources(spark, str(tmp_path / "app"))
    assert [(r["module"], r["line_no"], r["text"]) for r in rows.select("module", "file_path", "content").join(T.source_lines(rows), "file_path").orderBy("line_no").collect()] == [("app.x", 1, "a"), ("app.x", 2, "b")]
    assert T.read_diffs(spark, str(tmp_path / "one.diff")).first()["change_id"] == "one.diff"
    for name in ("x", "y"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.diff").write_text(MODIFIED)
    # Equal base names in two folders are two changes.
    assert sorted(r["change_id"] for r in T.read_diffs(spark, f"{tmp_path}/in/").collect()) == ["x/a.diff", "y/a.diff"]
    assert sorted(r["change_id"] for r in T.read_diffs(spark, f"{tmp_path}/in/*/a.diff").collect()) == [f"{tmp_path}/in/{n}/a.diff" for n in "xy"]


def test_stream_of_changes(spark, endpoints, tmp_path):
    from rippletrace.streaming.changes import analyse_stream, arriving_diffs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.diff").write_text(MODIFIED)
    references = spark.createDataFrame([], "repo string, endpoint_id string, ref_ord int, file_path string, start_line int, end_line int")
    steps = lambda: {d for d in os.listdir(folder) if d.startswith(("parsed-diffs", "changed", "affected"))} if os.path.exists(folder) else set()
    folder = f"{T.shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    before = steps()
    done = analyse_stream(arriving_diffs(spark, str(tmp_path / "in"), "r"), endpoints, references, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert done.awaitTermination(120)
    assert [r["endpoint_id"] for r in spark.read.parquet(str(tmp_path / "out" / "affected")).collect()] == ["GET /api/users"]
    assert steps() == before
