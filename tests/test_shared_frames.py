"""Frames of changed lines, found once for all diff files with the same path and lines."""

import pytest

from rippletrace.operators import impact as I


@pytest.fixture
def tables(spark):
    """Three files of a common name, of which two are known, and endpoints that refer to them."""
    changed = [("r", c, 0, path, lines) for c in range(4) for path, lines in [(("a/x.py", "/s/b/x.py", "x.py", "/s/c/x.py")[c], [2, 3, 9])]]
    changed = spark.createDataFrame(changed, "repo string, change_id long, file_idx int, path string, lines array<int>")
    refs = [("r", f"GET /{e}", f, s, s + 4, k, f"{f}.{s}", 0) for e in range(5) for k, (f, s) in enumerate([("/s/b/x.py" if e % 2 else "/s/c/x.py", 1), ("/s/b/x.py" if e % 2 else "/s/c/x.py", 7)])]
    refs = spark.createDataFrame(refs, "repo string, endpoint_id string, file_path string, start_line int, end_line int, sym_ord int, symbol_name string, ref_ord int")
    files = spark.createDataFrame([("r", f"/s/{f}/x.py", "\n".join(f"{f}{i} " for i in range(1, 9))) for f in "bc"], "repo string, file_path string, content string")
    return changed, refs, files


@pytest.mark.parametrize("owners", [0, 1, 64])
def test_frames_are_those_of_each_file(tables, monkeypatch, owners):
    changed, refs, files = tables
    monkeypatch.setattr(I, "OWNERS", owners)
    expected = I.frames(I.display_groups(changed, refs), refs.drop("ref_ord"), files)
    found = I.display_frames(changed, refs, refs.drop("ref_ord"), files).select(expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect())
    assert {r["function_name"] for r in found.collect()} == {"module", "/s/b/x.py.1", "/s/b/x.py.7", "/s/c/x.py.1", "/s/c/x.py.7"}


def test_endpoints_of_diff_files_are_not_shuffled(tables):
    """Rows for each diff file and endpoint are made last."""
    changed, refs, files = tables
    plan = I.display_frames(changed, refs, refs.drop("ref_ord"), files)._jdf.queryExecution().optimizedPlan()

    def made(node):
        names = {a.name() for a in (node.output().apply(i) for i in range(node.output().size()))}
        return names, [node.children().apply(i) for i in range(node.children().size())]

    def joins(node):
        names, below = made(node)
        if "Join" in node.nodeName():
            yield [made(b)[0] for b in below]
        for b in below:
            yield from joins(b)

    sides = [s for j in joins(plan) for s in j]
    assert sides and not [s for s in sides if {"change_id", "endpoint_id"} <= s]
