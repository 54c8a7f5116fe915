"""Diff files with the same name and lines are looked up once; changes are counted without listing what they hit."""

import random

import pytest
from pyspark.sql import functions as F

from rippletrace.jobs import derive
from rippletrace.operators import diffs as D
from rippletrace.operators import impact as I
from rippletrace.operators import paths as P
from rippletrace.sources import tables as T

CHANGED = "repo string, change_id string, file_idx int, path string, line_no int"
ENDS = "repo string, endpoint_id string, reg_order int, file_path string, start_line int, end_line int"
REFS = "repo string, endpoint_id string, ref_ord int, file_path string, start_line int, end_line int"


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(7)
    files = ["a/main.py", "b/main.py", "c/d/main.py", "main.py", "x/other.py"]
    lines = [("r", f"c{c}", i, draw.choice(files), draw.randrange(1, 150)) for c in range(12) for i in range(3) for _ in range(2)]
    path = {}
    lines = [(r, c, i, path.setdefault((c, i), p), n) for r, c, i, p, n in lines]
    ends = [("r", f"e{i}", i, "/srv/" + draw.choice(files), s, s + draw.randrange(30)) for i in range(14) for s in [draw.randrange(1, 130)]]
    refs = [("r", f"e{i}", o, "/srv/" + draw.choice(files), s, s + draw.randrange(20)) for i in range(14) for o in range(3) for s in [draw.randrange(1, 140)]]
    return spark.createDataFrame(lines, CHANGED), spark.createDataFrame(ends, ENDS), spark.createDataFrame(refs, REFS)


def test_files_of_a_common_name_are_dealt_and_looked_up_once(spark):
    """One row a class of paths before they are repeated, and no shuffle of what is repeated."""
    paths = spark.range(500).select(F.lit("r").alias("repo"), F.concat(F.lit("p"), "id", F.lit("/main.py")).alias("path"))
    refs = spark.range(40).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("endpoint_id"), F.lit("/srv/main.py").alias("file_path"), F.lit(0).alias("ref_ord"))
    classes = paths.select("repo", *P.class_of(F.col("path")))
    assert P.first_of_classes(classes, refs, ["repo"]).count() == 40
    found = P.first_reference(paths, refs, ["repo"])
    assert found.count() == found.distinct().count() == 20_000
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    assert not any("Aggregate" in line for line in top)


def test_same_lines_under_a_common_name_are_one_ask(spark):
    rows = [("r", f"c{i}", 0, f"p{i % 4}/main.py", n) for i in range(40) for n in (3, 70)]
    files = I.touched(spark.createDataFrame(rows, CHANGED))
    refs = spark.createDataFrame([("r", f"e{i}", 0, "/srv/main.py", 1, 5) for i in range(9)], REFS)
    assert files.count() == 40 and I.asked_endpoints(files, refs).count() == 9
    assert I.dependency_hits(files, refs).count() == 360


def test_groups_found_before_they_are_repeated(tables):
    changed, _, refs = tables
    shape = lambda t: sorted(tuple(r) for r in t.select("change_id", "file_idx", "endpoint_id", "first", "last").collect())
    assert shape(I.display_groups(changed, refs)) == shape(I.line_groups(I.display_lines(changed, refs)))


def test_lines_like_all_pairs(tables):
    changed, _, refs = tables
    lines, files = [tuple(r) for r in changed.distinct().collect()], {}
    # ref_ord decides between an endpoint's files; by its own line ranges of the chosen file count.
    for _, e, o, f, s, t in refs.collect():
        files.setdefault(e, []).append((o, f, s, t))
    expected = set()
    for r, c, i, p, n in lines:
        for e, known in files.items():
            fits = [x for x in known if x[1].endswith(p) or x[1].rsplit("/", 1)[-1] == p.rsplit("/", 1)[-1]]
            if fits:
                chosen = min(fits)[1]
                expected |= {(c, i, e, n) for _, f, s, t in known if f == chosen and s <= n <= t}
    found = [tuple(x) for x in I.referenced_lines(changed, refs).select("change_id", "file_idx", "endpoint_id", "line_no").collect()]
    assert sorted(found) == sorted(expected) and found


def test_high_hits_and_counts_equal_the_listed_hits(tables):
    changed, ends, refs = tables
    listed = I.all_hits(changed, ends, refs).collect()
    high = {(r["change_id"], r["endpoint_id"], r["file_idx"]) for r in listed if r["confidence"] == "high"}
    assert {(r["change_id"], r["endpoint_id"], r["file_idx"]) for r in I.high_hits(changed, ends, refs).collect()} == high and high
    counts = {r["change_id"]: (r["hits"], r["high"]) for r in I.hit_counts(changed, ends, refs).collect()}
    changes = {r["change_id"] for r in listed}
    assert counts == {c: (sum(r["change_id"] == c for r in listed), sum(h[0] == c for h in high)) for c in changes}


def test_lines_of_each_file_in_one_pass(spark):
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-a\n+b\n c\n@@ -200,1 +200,2 @@\n a\n+n\n--- a/y.txt\n+++ b/y.txt\n@@ -1 +1 @@\n-a\n+b\n--- a/z.py\n+++ /dev/null\n@@ -4,1 +0,0 @@\n-a\n"
    diffs = spark.createDataFrame([("r", "c", text)], "repo string, change_id string, diff_text string")
    parsed = D.parse_diffs(diffs, "error", "lines", "touched", "texts")
    assert parsed.columns == ["repo", "change_id", "error", "lines", "touched", "texts"]
    files = D.touched_in_python(parsed)
    assert [(r["file_idx"], r["path"], r["lines"]) for r in files.orderBy("file_idx").collect()] == [(0, "x.py", [1, 201]), (2, "z.py", [4])]
    bins = I.in_bins(files.where("file_idx = 0"))
    assert sorted((r["_bin"], r["part"]) for r in bins.collect()) == [(0, [1]), (3, [201])]
    texts = {(r["file_idx"], r["side"]): r["texts"] for r in D.text_lines(parsed).collect()}
    assert texts == {(0, "removed"): ["-a"], (0, "added"): ["+b", "+n"], (1, "removed"): ["-a"], (1, "added"): ["+b"], (2, "removed"): ["-a"]}
    lines, shape = D.changed_lines(parsed), lambda t, *c: sorted(tuple(r) for r in t.select("file_idx", *c).collect())
    assert shape(D.context_in_diffs(parsed), "line_no") == shape(D.context_lines(lines), "line_no")
    assert shape(D.runs_in_diffs(parsed), "first", "last") == shape(D.line_runs(lines, ["change_id", "file_idx"]), "first", "last")
    for made in (D.text_lines(parsed), D.context_in_diffs(parsed), D.runs_in_diffs(parsed)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_planned_files_are_the_sql_s(spark, sf_dir):
    """Also where documents are missing: a line without one still counts in its order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 > 0")
    docs.createOrReplaceTempView("documents")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    plain, late = (spark.sql(sql.format(docs=200)) for sql in (derive.DIFF_FILES, derive.DIFF_FILES_LATE))
    assert plain.columns == late.columns and plain.count() == late.count() > 0
    assert plain.exceptAll(late).isEmpty() and late.exceptAll(plain).isEmpty()


def test_paths_are_not_shuffled_with_planned_files(spark, sf_dir):
    """Where documents aren't broadcast, lines are shuffled twice, and without paths."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for t in ("documents", "lineitem"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        plan = derive.diff_texts(spark.sql(derive.DIFF_FILES_LATE.format(docs=200)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 3


def test_symbols_of_a_line_are_looked_up_once_for_paths_of_a_name(spark):
    """What is repeated for the paths isn't aggregated or shuffled any more."""
    wanted = spark.range(300).select(F.lit("r").alias("repo"), F.concat(F.lit("p"), "id", F.lit("/main.py")).alias("path"), F.lit(3).alias("line_no"))
    rows = [("r", f"e{i}", "/srv/main.py", i, f"s{i}", 1, 9) for i in range(20)]
    symbols = spark.createDataFrame(rows, "repo string, endpoint_id string, file_path string, sym_ord int, symbol_name string, start_line int, end_line int")
    found = I.symbol_at_line(wanted, symbols)
    assert found.count() == 6_000 and {(r["endpoint_id"], r["symbol_name"]) for r in found.distinct().collect()} == {(f"e{i}", f"s{i}") for i in range(20)}
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()[:2]
    assert not any("Aggregate" in line for line in top)


def test_places_in_a_repository_come_from_many_tasks(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 10 > 0, F.lit("r")).alias("repo"), F.array(F.struct((F.col("id") * 7919 % 5_000).alias("x"))).alias("at"), "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = T.numbered(rows, ["repo"], ["at"], "place", "in-order")
        assert found.schema["place"].dataType.simpleString() == "int"
        got = found.collect()
        tasks = found.where("repo = 'r'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for repo in ("r", None):
        mine = sorted((r["at"][0]["x"], r["place"]) for r in got if r["repo"] == repo)
        assert [p for _, p in mine] == list(range(len(mine))) and len(mine) in (4_500, 500)
    assert tasks > 1


def test_counts_keep_repositories_apart(spark):
    """An endpoint that only another repository has isn't counted."""
    changed = spark.createDataFrame([("a", "c", 0, "x/main.py", 3), ("b", "c", 0, "x/main.py", 3)], CHANGED)
    refs = spark.createDataFrame([(r, "e", 0, "/srv/main.py", 1, 5) for r in "ab"], REFS)
    ends = spark.createDataFrame([("b", "e", 0, "/srv/other.py", 1, 5)], ENDS)
    assert [(r["repo"], r["hits"], r["high"]) for r in I.hit_counts(changed, ends, refs).collect()] == [("b", 1, 0)]


def plain_hits(changed, ends, refs):
    """The hits by a join of all with all and a rank over a change's rows."""
    high = I.direct_hits(changed, ends).withColumn("confidence_rank", F.lit(0))
    ids = ends.groupBy("repo", "endpoint_id").agg(F.min("reg_order").alias("reg_order"))
    medium = I.dependency_hits(changed, refs).join(ids, ["repo", "endpoint_id"]).withColumn("confidence_rank", F.lit(1))
    best = {}
    for r in high.unionByName(medium).collect():
        key = r["repo"], r["change_id"], r["endpoint_id"]
        best[key] = min(best.get(key, (9,)), (r["file_idx"], r["confidence_rank"], r["reg_order"], r["path"]))
    out, order = {}, sorted((k[:2], v[:3], k[2], v) for k, v in best.items())
    for change, _, e, v in order:
        mine = out.setdefault(change, [])
        mine.append((e, *v, len(mine) + 1))
    return {c: sorted(rows) for c, rows in out.items()}


def test_hits_in_pieces_equal_plain_ones(spark, monkeypatch):
    """Also with pieces of three endpoints, files dealt two by two, equal asks in a change, and endpoints that aren't registered."""
    monkeypatch.setattr(I, "DEALT", 2)
    draw = random.Random(3)
    files = ["a/main.py", "b/main.py", "main.py", "x/other.py", "y/other.py", "py"]
    path = {}
    lines = [(f"r{c % 2}", f"c{c}", i, path.setdefault((c, i), draw.choice(files)), draw.choice([3, 5, 40, 90, 130])) for c in range(25) for i in range(4) for _ in range(2)]
    ends = [(r, f"e{i}", draw.randrange(9), "/srv/" + draw.choice(files[:5]), s, s + draw.randrange(60)) for r in ("r0", "r1") for i in range(20) for s in [draw.randrange(1, 130)]]
    refs = [(r, f"e{i}", o, "/srv/" + draw.choice(files), s, s + draw.randrange(-6, 60)) for r in ("r0", "r1") for i in range(23) for o in range(2) for s in [draw.randrange(1, 140)]]
    changed, ends, refs = spark.createDataFrame(lines, CHANGED), spark.createDataFrame(ends, ENDS), spark.createDataFrame(refs, REFS)
    made = I.ranked_hits(changed, ends, refs)
    assert made.largest.where("size(gone) > 0").count() and made.kept.where("not is_before").count() and made.kept.where("confidence = 'medium'").count()
    for size in (3, 1 << 20):
        pieces = made.pieces(size)
        monkeypatch.setattr(made, "pieces", lambda: pieces)
        found = {}
        for r in made.rows().collect():
            found.setdefault((r["repo"], r["change_id"]), []).append((r["endpoint_id"], r["file_idx"], r["confidence_rank"], r["reg_order"], r["path"], r["rank"]))
        assert {c: sorted(rows) for c, rows in found.items()} == plain_hits(changed, ends, refs)
        monkeypatch.undo()
    named = ends.withColumn("module", F.concat(F.lit("m."), "endpoint_id"))
    rows = I.with_reasons(I.all_hits(changed, named, refs), I.display_lines(changed, refs), named)
    both = [sorted(map(str, t.select(rows.columns).collect())) for t in (rows, I.hits_with_reasons(changed, named, refs))]
    assert both[0] == both[1] and any("Type analysis" in r for r in both[0])


def test_hits_of_a_common_file_are_not_shuffled(spark):
    """What a change's largest file hits is made by a generator over shared lists, with nothing shuffled after that."""
    rows = [("r", f"c{i}", 0, f"p{i}/main.py", 3) for i in range(300)]
    changed = spark.createDataFrame(rows, CHANGED)
    refs = spark.createDataFrame([("r", f"e{i}", 0, "/srv/main.py", 1, 5) for i in range(40)], REFS)
    ends = spark.createDataFrame([("r", f"e{i}", i, "/srv/other.py", 1, 5) for i in range(40)], ENDS)
    made = I.ranked_hits(changed, ends, refs)
    assert made.rows().count() == 12_000 and made.kept.count() == 0 and made.listed.count() == 40
    top = made.pieces()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert top[0].startswith("Project") and top[1].startswith("+- Join")
