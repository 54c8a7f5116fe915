"""What steps leave on disk, and which diff files are looked up at all."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rippletrace.operators import impact as I
from rippletrace.sources import tables as T

REFERENCES = "repo string, endpoint_id string, ref_ord int, file_path string, start_line int, end_line int"
PATHS = ["a/main.py", "main.py", "ain.py", "n.py", "x/ain.py", "other.py", "b/other.py", "py", "/srv/app/main.py", "long.py", "a/long.py", "g.py"]


def changed_files(spark):
    rows = [("r", 1, i, p, [3, 4]) for i, p in enumerate(PATHS)] + [("s", 1, 0, "a/main.py", [3]), ("s", 1, 1, "main.py", [3])]
    return spark.createDataFrame(rows, "repo string, change_id long, file_idx int, path string, lines array<int>")


@pytest.mark.parametrize("files", [["/srv/app/main.py"], ["/srv/app/main.py", "/srv/b/g.py"], ["/srv/app/main.py", "g.py"]])
def test_only_files_that_may_match_are_kept_and_all_of_them(spark, files):
    references = spark.createDataFrame([("r", "e", i, f, 1, 9) for i, f in enumerate(files)], REFERENCES)
    changed = changed_files(spark)
    name = lambda p: p.rpartition("/")[2]
    match = {p for p in PATHS for f in files if p.endswith(f) or f.endswith(p) or name(p) == name(f)}
    kept = {(r["repo"], r["path"]) for r in I.in_referenced(changed, references).collect()}
    assert {("r", p) for p in match} <= kept
    if all("/" in f for f in files):
        assert kept == {("r", p) for p in match}
    whole, pruned = (sorted(map(str, I.dependency_hits(t, references).collect())) for t in (changed, I.in_referenced(changed, references)))
    assert whole == pruned and len(whole) == len(match)


def test_step_tables_of_files_hold_only_what_the_rest_is_made_of(spark):
    changed = changed_files(spark)
    saved = I.save_touched(changed)
    assert sorted(map(str, saved.collect())) == sorted(map(str, I.touched(changed).select(saved.columns).collect()))
    stored = spark.read.parquet(saved.inputFiles()[0].rpartition("/")[0])
    assert stored.columns == ["repo", "change_id", "file_idx", "path", "lines"]
    assert {len(r["ask"]) for r in saved.collect()} == {16}


def test_written_steps_leave_no_shuffle_files(spark):
    folder = lambda: [f for f in Path(local).rglob("shuffle_*.data")]
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    rows = spark.range(10_000).select(F.rand(1).alias("a")).repartition(4, "a")
    before = set(folder())
    saved = T.save_step(rows, "shuffled")
    assert not set(folder()) - before and saved.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_hits_of_other_files_are_shuffled_as_numbers(spark, monkeypatch):
    """A change with two files of common names: neither texts nor lines of what the second hits are there before the last join."""
    ends = spark.range(40).select(
        F.lit("r").alias("repo"), F.concat(F.lit("e"), "id").alias("endpoint_id"), (50 - F.col("id")).alias("reg_order"), F.lit("/srv/h.py").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line")
    )
    spread = ends.select("repo", "endpoint_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ref_ord"), F.lit(f).alias("file_path")) for i, f in enumerate(("/srv/a/main.py", "/srv/a/__init__.py"))])).alias("f"))
    references = spread.select("repo", "endpoint_id", "f.*", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    references = references.where("ref_ord = 1 or endpoint_id < 'e3'")
    rows = [("r", 1, 0, "x/main.py", [3]), ("r", 1, 1, "h.py", [2]), ("r", 1, 2, "y/__init__.py", [4])]
    changed = spark.createDataFrame(rows, "repo string, change_id long, file_idx int, path string, lines array<int>")
    steps, write = {}, I.save_step
    monkeypatch.setattr(I, "save_step", lambda df, name, by="": steps.setdefault(name, write(df, name, by)))
    found = {r["rank"]: (r["endpoint_id"], r["file_idx"], r["path"], r["confidence"], r["lines"]) for r in I.ranked_hits(changed, ends, references).rows().collect()}
    assert {f.name for f in steps["kept"].schema if f.dataType.simpleString() not in ("int", "bigint", "boolean")} == {"repo"}
    order = sorted((f"e{i}" for i in range(40)), key=lambda e: -int(e[1:]))
    first, late = [e for e in order if e < "e3"], [e for e in order if e >= "e3"]
    expected = [(e, 0, "x/main.py", "medium", [3]) for e in first] + [(e, 1, "h.py", "high", None) for e in late]
    assert found == dict(enumerate(expected, 1))
