"""Diffs of the usual shape are read hunk by hunk; that gives what reading line by line does, and all others are read so."""

import random

import pyarrow as pa
import pytest

from rippletrace.operators import diffs as D
from rippletrace.operators import report as R

HEAD = "--- a/x.py\n+++ b/x.py\n"


def both(text):
    """(error, files, hunks, numbers) read either way."""
    error, files, hunks, lines = D.parse_diff(text)
    return D.parse_diff(text, listed=False), (error, files, hunks, D.numbers_of(lines))


@pytest.mark.parametrize(
    "text, is_plain",
    [
        (HEAD + "@@ -1,3 +1,3 @@ def f\n a\n-b\n+c\n d\n", True),
        (HEAD + "@@ -5 +5 @@\n-b\n+c\n@@ -9,0 +10,2 @@\n+x\n+y", True),
        # A removed line that looks like a header, changes between changes, a hunk that is too long or too short, lines outside, no names.
        (HEAD + "@@ -1,2 +0,0 @@\n--- a/y.py\n-b\n", False),
        (HEAD + "@@ -1,2 +1,2 @@\n+c\n-b\n+d\n-e\n", False),
        (HEAD + "@@ -1,1 +1,1 @@\n-b\n+c\n+d\n", False),
        (HEAD + "@@ -1,2 +1,2 @@\n-b\n+c\n", False),
        (HEAD + "@@ -1 +1 @@\n-b\n\\ No newline at end of file\n+c\n", False),
        ("diff --git a/x.py b/x.py\nindex 1..2\n" + HEAD + "@@ -1 +1 @@\n-b\n+c\n", False),
        ("@@ -1 +1 @@\n-b\n+c\n", False),
    ],
)
def test_either_way_gives_the_same(text, is_plain):
    quick, slow = both(text)
    assert quick == slow
    assert (D.parse_plain(text + "\n" * (not text.endswith("\n"))) is not None) == is_plain


def test_damaged_diffs_are_read_the_same():
    draw = random.Random(7)
    for _ in range(2000):
        lines = (HEAD + "@@ -3,3 +3,3 @@\n a\n-b\n+c\n d\n--- /dev/null\n+++ b/y.py\n@@ -0,0 +1,2 @@\n+a\n+b\n").split("\n")
        for _ in range(draw.randrange(3)):
            i = draw.randrange(len(lines))
            lines[i : i + draw.randrange(2)] = [draw.choice(["", " ", "+x", "-x", "--- a/z.py", "+++ b/z.py", "@@ -1 +1 @@", "\\ No", "x", "@@"])]
        quick, slow = both("\n".join(lines))
        assert quick == slow


def test_touched_lines_come_in_order():
    kind = pa.list_(pa.struct([("file_idx", pa.int32()), ("source_name", pa.string()), ("target_name", pa.string()), ("lines", pa.list_(pa.int32()))]))
    texts = [HEAD + "@@ -9 +9 @@\n-b\n+c\n@@ -2 +2 @@\n-b\n+c\n", "", HEAD, "nothing"]
    found = D.touched_of([D.parse_diff(t, False) for t in texts], kind).to_pylist()
    assert found == [[{"file_idx": 0, "source_name": "a/x.py", "target_name": "b/x.py", "lines": [2, 9]}], [], [], []]


def test_parts_of_changes_are_as_many_as_asked(spark, sf_dir):
    """Left to Spark, few bytes are one part a core or fewer, however long it takes to parse them."""
    from rippletrace.jobs.derive import derive

    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        plan = derive(spark, sf_dir, "diff_plan")[0]
        assert plan.rdd.getNumPartitions() == 13
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_warnings_read_files_once(spark):
    rows = spark.createDataFrame([("r", 1, "a/x.py")], "repo string, change_id long, path string")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    files = rows.mapInArrow(count, rows.schema).selectExpr("*", "true AS is_python")
    bad = spark.createDataFrame([("r", "/srv/a/x.py", "SyntaxError")], "repo string, file_path string, error string")
    assert [r["warning"] for r in R.warnings_of(files, bad).collect()] == ["Error analyzing a/x.py: SyntaxError"]
    assert reads.value == 1
