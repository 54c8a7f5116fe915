"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rippletrace.llm import hnsw, oracles, queries, url_filter



def in_sql(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(str(tuple(r[names.index(c)] for c in sorted(names))) for r in found.fetchall())


def in_spark(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    found = in_spark(queries.QUERIES[name](spark, sf_dir))
    assert found and found == in_sql(queries.ORACLES[name], **{t: f"{sf_dir}/{t}.parquet" for t in ("pages", "embeddings")})


def test_url_templates_equal_sql(spark, tmp_path):
    """Wide nodes, deep paths, merged siblings, hexadecimal names and missing URLs."""
    urls = [f"http://h.com/{a}/{b}/{i}" for i, (a, b) in enumerate((a, b) for a in ("en", "de", "x") for b in "pqrstuvwxyzabcdefghij")]
    urls += [f"http://H.com/en/{'/'.join('abcdefghijkl'[:n])}?q" for n in range(12)]
    urls += [f"http://s.example.com/en/7{i}/{'ab12cd34ef' * (i % 3)}/" for i in range(20)] + ["http://b.example.com/en/"] * 9
    urls += [None, "", "nothing", "://", "http://", "HTTP://A.ORG/es/x://y", "x://org/es/é\n/z"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages")
    for tree in ({}, {"depth": 2, "max_children": 3, "least_share": 0.3, "similar_z": 2.0}):
        found = url_filter.judge_urls(pages, queries.URL_RULES, reject_at=0.5, **tree).select("page_id", "host", "path", "rule", "verdict")
        expected = in_sql(oracles.url_filter_sql(queries.URL_RULES, reject_at=0.5, **tree), pages=f"{tmp_path}/pages/*.parquet")
        assert in_spark(found) == expected
        assert any("'allow'" in r and "None" in r for r in expected) and any("'block'" in r for r in expected)


def test_deep_urls_branch_to_their_end(spark, tmp_path):
    """Branches below the sixteenth segment, beginnings of each other, and single paths that go on alone; none is cut."""
    trunk = "/".join(f"s{chr(97 + i)}" for i in range(18))
    urls = [f"http://h.org/{trunk}/{a}/{b}/end" for a in ("good", "bad") for b in "pqrst"] + [f"http://h.org/{trunk}/{a}/new" for a in ("good", "bad")]
    urls += ["http://h.org/" + "/".join("uvwxuvwxuvwxuvwxuvwx"[:n]) for n in range(1, 21)] + ["http://i.org/" + "y/" * 20 + "bad", "http://j.org/" + "z/" * 20]
    pages = spark.createDataFrame([(i, u, None if u.endswith("new") else int("bad" in u)) for i, u in enumerate(urls)], "page_id long, url string, bad int")
    found = url_filter.judge_urls(pages, [], labels="bad", reject_at=0.5).collect()
    verdicts = {r["url"]: r["verdict"] for r in found}
    assert [verdicts[f"http://h.org/{trunk}/{a}/new"] for a in ("good", "bad")] == ["allow", "block"]
    assert verdicts["http://i.org/" + "y/" * 20 + "bad"] == "block" and len(found) == len(urls)
    # The same in SQL, with labels from rules.
    pages = pages.withColumn("url", F.when(F.col("bad") == 1, F.regexp_replace("url", "org/s", "org/es/s")).otherwise(F.regexp_replace("url", "org/s", "org/t")))
    pages.drop("bad").write.parquet(f"{tmp_path}/pages")
    got = url_filter.judge_urls(spark.read.parquet(f"{tmp_path}/pages"), queries.URL_RULES, reject_at=0.3).select("page_id", "host", "path", "rule", "verdict")
    assert in_spark(got) == in_sql(oracles.url_filter_sql(queries.URL_RULES, depth=24, reject_at=0.3), pages=f"{tmp_path}/pages/*.parquet")


def test_url_tree_blocks_on_purity(spark, sf_dir):
    """In the query, URLs that no rule covers are blocked where their host or branch is, and only there."""
    rows = queries.QUERIES["op5_url_filter"](spark, "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir).collect()
    ruled = [r for r in rows if r["rule"]]
    blocked = {r["host"] for r in ruled if r["verdict"] == "block"}
    by_tree = [r for r in rows if not r["rule"] and r["verdict"] == "block"]
    assert all(r["host"] in blocked for r in by_tree)
    # The same tree rejects at any purity that it has.
    pages = spark.createDataFrame([(i, f"http://a.com/{s}/{i}") for i, s in enumerate(["en"] * 30 + ["fr"] * 10)], "page_id long, url string")
    found = {(r["path"].split("/")[1], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert found == {("en", "com/en/", "block"), ("fr", None, "block")}


def test_url_branches_merge_where_labels_are_alike(spark):
    """Half a branch is bad: two alike siblings share their labels, a third keeps its own, one without labels has its parent's."""
    label = lambda s, i: {"a": i % 10 < 9, "b": i % 10 < 9, "c": False, "d": None}[s]
    n = {"a": 200, "b": 10, "c": 200, "d": 5}
    rows = [(s, f"http://h.org/x/{s}/{i}", None if label(s, i) is None else int(label(s, i))) for s in n for i in range(n[s])]
    pages = spark.createDataFrame(rows, "_h string, url string, bad int").withColumns({"_host": F.lit("mine"), "shape": F.lit(1), "n": F.lit(2), "row": F.lit(3)})
    out = url_filter.judge_urls(pages, [], labels="bad")
    assert {"_h", "_host", "shape", "n", "row", "host", "verdict"} <= set(out.columns)
    found = {(r["_h"], r["verdict"], r["_host"], r["row"]) for r in out.collect()}
    # b alone would have (9 + 4 * 0.47) / 14 = 0.78; with a it has 0.89.
    assert found == {("a", "block", "mine", 3), ("b", "block", "mine", 3), ("c", "allow", "mine", 3), ("d", "allow", "mine", 3)}
    assert url_filter.judge_urls(pages.limit(0), [], labels="bad").count() == 0
    deep = spark.createDataFrame([(1, "http://h.org/" + "a/" * 5000), (2, None)], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge_urls(deep, []).orderBy("page_id").collect()] == ["allow", "allow"]


def test_vector_links_equal_sql(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 2, [1.0, i / 100, 0.0]) for i in range(60)] + [(100 + i, 1, [0.0, 1.0, i / 50]) for i in range(20)]
    rows += [(200, 1, [0.0, 0.0, 0.0]), (201, 1, None), (202, 1, []), (203, 1, [1.0, None, 0.0]), (204, 0, [nan, 1.0, 0.0]), (205, 0, [inf, 1.0, 0.0])]
    rows += [(206, None, [1.0, 0.0, 0.0]), (207, 0, [1.0, 0.0]), (None, 0, [1.0, 0.0, 0.0])] + [(300, 0, [1.0, 0.0, 0.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings")
    assert in_spark(hnsw.near_duplicate_vectors(df)) == in_sql(oracles.vector_links_sql(), embeddings=f"{tmp_path}/embeddings/*.parquet")
