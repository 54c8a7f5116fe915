"""Mixing, URL filter, near duplicates, neighbours, components and the pipeline, against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rippletrace.llm import ann, components, hnsw, mixing, queries, secrets, simhash, url_filter


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Mixing


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_of_documents(spark, sf_dir):
    rows = queries.QUERIES["op3_mixing"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[d["source"]] += r["size"]
        taken[d["source"]] += r["taken"]
        largest[d["source"]] = max(largest[d["source"]], r["size"])
    targets = plain_targets(sizes, (5, 2, 1), 1.5, 2)
    for r in rows:
        assert r["target"] == pytest.approx(targets[docs[r["doc_id"]]["source"]])
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in targets)
    again = queries.QUERIES["op3_mixing"](spark.newSession(), sf_dir)
    assert sorted(r["copies"] * 10**6 + r["doc_id"] for r in again.collect()) == sorted(r["copies"] * 10**6 + r["doc_id"] for r in rows)


def test_mix_through_a_tree(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"))
    one = mixing.mix_sources(docs, leaf_rows=20, fan_in=4)
    got = {s: (t, n) for s, t, n in one.groupBy("source").agg(F.first("target"), F.sum("taken")).collect()}
    assert all(abs(t - n) <= 17 for t, n in got.values())
    two = mixing.mix_sources(docs.repartition(7), leaf_rows=20, fan_in=4)
    assert one.select("doc_id", "copies").exceptAll(two.select("doc_id", "copies")).count() == 0


def test_pivot_keeps_words_and_expectation():
    size = np.array([3, 5, 8, 13, 21, 34, 55, 89], float)
    p = np.full(8, 0.3)
    sums = np.zeros(8)
    for seed in range(3000):
        out = mixing.pivot(p, size, np.random.default_rng(seed))
        assert out @ size == pytest.approx(p @ size) and ((out > 0) & (out < 1)).sum() <= 1
        sums += out
    assert np.allclose(sums / 3000, p, atol=0.04)


def test_mix_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "a b", 9), (1, None, "a b", 9), (None, "s", None, 9), (2, "s", "", 9)], "doc_id long, source string, text string, size int")
    found = mixing.mix_sources(rows).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in found) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert sum(r["taken"] for r in found) in (4, 6, 8)
    assert mixing.mix_sources(rows.limit(0)).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_rows_with_one_key_are_rounded_one_by_one(spark, monkeypatch, key):
    docs = spark.range(3000).select(F.lit(key).cast("long").alias("doc_id"), (F.col("id") % 3 > 0).cast("string").alias("source"), F.lit("a b c").alias("text"))
    groups = []
    level = mixing._level

    def seen(rows, *more):
        groups.append(rows.groupBy("source", "bucket").count().agg(F.max("count")).first()[0])
        return level(rows, *more)

    monkeypatch.setattr(mixing, "_level", seen)
    rows = mixing.mix_sources(docs, leaf_rows=50, fan_in=4).collect()
    assert len(rows) == 3000 and max(groups) <= 150
    for source in ("true", "false"):
        ours = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in ours) - ours[0]["target"]) <= 3


@pytest.mark.parametrize("key", [None, 7])
def test_mix_stage_keeps_targets_of_rows_with_one_key(spark, sf_dir, key):
    import corpus_pipeline as pipeline

    docs = spark.range(900).select(F.lit(key).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.withColumn("source", F.lit("t"))).unionByName(docs.withColumn("source", F.lit("u")))
    got = {r["source"]: r["count"] for r in pipeline.mix(spark, docs, sf_dir).groupBy("source").count().collect()}
    targets = plain_targets(dict.fromkeys("stu", 2700), (5, 2, 1), 1.5, 2)
    assert all(abs(got.get(s, 0) * 3 - targets[s]) <= 3 for s in targets), (got, targets)


# URLs


def plain_rule(host, path):
    fits = [r for _, r in queries.URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_urls_by_rules(spark, sf_dir):
    verdict = {r: v for v, r in queries.URL_RULES}
    rows = {r["page_id"]: r for r in queries.QUERIES["op5_url_filter"](spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        rest = p["url"].split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        r = rows[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, plain_rule(host.lower(), path))
        assert r["verdict"] == verdict[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [(None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://A.Com", "a.com", ""), ("x://H?q/1", "h", ""), ("x://h/P a#f?b", "h", "/P a"), ("a://b://c", "b:", "//c"), ("http://ÄB.de/é", "Äb.de", "/é")],
)
def test_parts_of_urls(spark, url, host, path):
    r = spark.createDataFrame([(url,)], "url string").select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).first()
    assert tuple(r) == (host, path)


def test_templates_are_rejected_by_purity(spark):
    rows = [(f"http://h.org/user/{w}/ads/{i}", 1 if i % 10 else 0) for i, w in enumerate(f"n{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300))]
    rows += [(f"http://h.org/news/{i}", 0) for i in range(50)] + [("http://h.org/user/zzz/ads/new", None), ("http://h.org/news/x", None), (None, None)]
    pages = spark.createDataFrame([(i, u, b, "z") for i, (u, b) in enumerate(rows)], "page_id long, url string, bad int, verdict string")
    found = {r["url"]: r["verdict"] for r in url_filter.judge_urls(pages, [], labels="bad").collect()}
    assert found["http://h.org/user/naax/ads/0"] == "block" and found["http://h.org/news/3"] == "allow" and found["http://h.org/news/x"] == "allow" and found[None] == "allow"
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge_urls(pages.union(pages), queries.URL_RULES).count() == 2 * len(rows)


# Near duplicates of texts


def plain_fingerprint(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_documents(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_simhash"](spark, sf_dir).collect()}
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(prints)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    expected = roots(ids, edges)
    for i in ids:
        assert rows[i]["fingerprint"] == f"{prints[i]:016x}" and rows[i]["component_id"] == expected[i]


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_of_fingerprints(spark, bits):
    draws = random.Random(bits)
    prints = set()
    for _ in range(12):
        x = draws.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(draws.randrange(3)):
                x ^= 1 << draws.randrange(64)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
    found = [tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits).collect()]
    assert len(found) == len(set(found)) and set(found) == set(near)


def test_postings_of_a_dense_group_are_split(spark):
    """Thousands of fingerprints share six bytes; none of the postings that are paired off holds more than 256 of them."""
    x = np.array([0x0123456789ABCDEF ^ (a << 16) ^ (b << 56) for a in range(256) for b in range(16)], "uint64")
    bits = np.array([bin(v).count("1") for v in range(256)])
    apart = np.zeros((len(x), len(x)), "int64")
    for shift in (16, 56):
        byte = ((x >> np.uint64(shift)) & np.uint64(255)).astype("int64")
        apart += bits[byte[:, None] ^ byte[None]]
    prints = spark.createDataFrame([(int(v),) for v in x.astype("int64")], "fp long")
    pairs = simhash.tallied_pairs(prints).cache()
    assert pairs.where("bit_count(shared) < 6").count() == 0 and pairs.count() < len(x) * (128 + 256)
    assert simhash.fingerprint_links(prints).count() == (np.triu(apart <= 2, 1)).sum()


def test_tally_drops_pairs_before_they_are_verified(spark):
    """Fingerprints that share four to seven bytes: the tally is right for all pairs that meet, and drops those with too few."""
    draws = random.Random(8)
    prints = set()
    for _ in range(300):
        x = draws.getrandbits(64)
        prints.add(x)
        for _ in range(4):
            y = x
            for p in draws.sample(range(8), draws.randrange(1, 5)):
                y ^= (1 << draws.randrange(8)) << 8 * p
            prints.add(y)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    equal = lambda a, b: sum(1 << p for p in range(8) if not (a ^ b) >> 8 * p & 0xFF)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {(r["a"], r["b"]): r["shared"] for r in simhash.tallied_pairs(table).collect()}
    assert all(shared == equal(*pair) for pair, shared in found.items())
    near = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    reached = {pair for pair, shared in found.items() if shared.bit_count() >= 6}
    assert near <= reached and len(reached) < 0.7 * len(found)
    assert {tuple(r) for r in simhash.fingerprint_links(table).collect()} == near


@pytest.mark.parametrize("crowd", [1, 2, 5])
def test_refined_postings_lose_no_pair(spark, monkeypatch, crowd):
    """Small limits refine nearly every posting, at all levels."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draws = random.Random(crowd)
    x = draws.getrandbits(63)
    prints = sorted({x} | {x ^ 1 << i ^ 1 << j for i in range(0, 63, 3) for j in range(1, 63, 9) if i != j} | {x ^ draws.getrandbits(24) for _ in range(60)})
    near = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2}
    found = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert len(found) == len(near) and {tuple(r) for r in found} == near


def test_simhash_of_a_very_long_text():
    draws = random.Random(4)
    text = " ".join(draws.choice(["Words", "and", "more", "of", "THEM"]) for _ in range(100_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_simhash_edge_rows(spark):
    rows = spark.createDataFrame([(5, None, 1), (3, "", 2), (3, "", 2), (None, "  ", 3), (9, "A b", 4), (8, "a B", 5)], "doc_id long, text string, fp int")
    found = sorted((r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert [x[::2] for x in found] == [(0, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_components(spark):
    draws = random.Random(3)
    edges = [(draws.randrange(300), draws.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert found == roots(nodes, edges[:-1])
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# Vectors


def vectors_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], "float64")
    return [r["vec_id"] for r in rows], [r["label"] for r in rows], x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_recall(spark, sf_dir):
    ids, _, x = vectors_of(spark, sf_dir)
    place = {v: i for i, v in enumerate(ids)}
    found = defaultdict(list)
    for r in sorted(queries.QUERIES["op9_ann"](spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[place[r["query_id"]]] @ x[place[r["vec_id"]]]), abs=1e-9)
    hit = 0
    for i, q in enumerate(ids):
        if q % 50 == 0:
            cos = x @ x[i]
            best = sorted((n for n in range(len(ids)) if n != i), key=lambda n: (-cos[n], ids[n]))[:5]
            hit += len({ids[n] for n in best} & set(found.pop(q))) / 5
    assert not found and hit / sum(q % 50 == 0 for q in ids) >= 0.9


ODD = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0])]


def test_neighbours_edge_rows(spark):
    rows = spark.createDataFrame([(i, v, 1) for i, v in ODD], "vec_id long, embedding array<double>, rank int")
    found = ann.search_neighbours(rows, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 0.707107)]
    assert ann.search_neighbours(rows.limit(0), F.lit(True)).count() == 0


def nearest_by_brute_force(ids, x, i, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = {}
    for n, c in zip(ids, np.round(u @ u[i], 12)):
        if n != ids[i]:
            cos[n] = max(cos.get(n, -9), c)
    return sorted(cos, key=lambda n: (-cos[n], n))[:k]


def test_neighbours_among_copies(spark):
    draws = np.random.default_rng(5)
    one, other = draws.normal(size=(2, 8))
    x = np.concatenate([np.repeat(one[None], 3000, 0), other + draws.normal(size=(1500, 8)) * 1e-4, draws.normal(size=(1000, 8))])
    ids = draws.permutation(len(x)).tolist()
    asked = {ids[i]: i for i in [*range(0, 3000, 600), *range(3000, 4500, 100)]}
    rows = spark.createDataFrame([(n, v.tolist(), n in asked) for n, v in zip(ids, x)], "vec_id long, embedding array<double>, asks boolean")
    found = defaultdict(list)
    for r in ann.search_neighbours(rows, F.col("asks")).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    copies = [n for n, i in asked.items() if i < 3000]
    assert all(found[n] == nearest_by_brute_force(ids, x, asked[n]) for n in copies)
    assert np.mean([len(set(found[n]) & set(nearest_by_brute_force(ids, x, i))) / 5 for n, i in asked.items()]) >= 0.95


def test_neighbours_of_a_lonely_query(spark):
    draws = np.random.default_rng(6)
    x = np.concatenate([draws.normal(size=(400, 4)) * 0.05 + [1, 0, 0, 0], [[-1, 0.1, 0, 0], [-1, 0.1, 0.01, 0], [0, 0, -1, 0.2]]])
    ids = list(range(len(x)))
    rows = spark.createDataFrame([(n, v.tolist(), n >= 398) for n, v in zip(ids, x)], "vec_id long, embedding array<double>, asks boolean")
    found = defaultdict(list)
    for r in ann.search_neighbours(rows, F.col("asks"), goal=0.0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert {n: len(found[n]) for n in range(398, 403)} == dict.fromkeys(range(398, 403), 5)
    assert found[400][0] == 401 and found[401][0] == 400


LENGTHS = [(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [0.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0])]


def test_vectors_of_every_length(spark):
    """Vectors meet those of their own length only, and none is left out for its length."""
    rows = spark.createDataFrame([(i, v, 1) for i, v in LENGTHS], "vec_id long, embedding array<float>, label int")
    found = [(r["query_id"], r["vec_id"]) for r in ann.search_neighbours(rows, F.lit(True)).orderBy("query_id", "rank").collect()]
    assert found == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 2), (3, 1), (10, 11), (11, 10)]
    linked = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicate_vectors(rows).collect()}
    assert linked == {1: (0, 1), 2: (0, 2), 3: (0, 3), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def plain_links(ids, labels, x, least):
    same = np.array(labels)[:, None] == np.array(labels)[None]
    near = (x @ x.T >= least) & same
    np.fill_diagonal(near, False)
    return near.sum(axis=1), roots(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_duplicate_vectors(spark, shard_rows):
    draws = np.random.default_rng(4)
    centres = draws.normal(size=(12, 16))
    x = centres[draws.integers(0, 12, 400)] + draws.normal(size=(400, 16)) * draws.choice([0.02, 0.15, 1.0], (400, 1))
    labels, ids = draws.integers(0, 2, 400).tolist(), [i * 3 for i in range(400)]
    rows = spark.createDataFrame([(i, v.tolist(), n) for i, v, n in zip(ids, x, labels)], "vec_id long, embedding array<double>, label int")
    links, component = plain_links(ids, labels, x / np.linalg.norm(x, axis=1, keepdims=True), 0.93)
    found = {r["vec_id"]: r for r in hnsw.near_duplicate_vectors(rows, shard_rows=shard_rows).collect()}
    assert [found[i]["n_links"] for i in ids] == links.tolist()
    assert {i: found[i]["component_id"] for i in ids} == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_duplicate_vectors_edge_rows(spark):
    rows = spark.createDataFrame([(i, v, 1, "z") for i, v in ODD] + [(7, [1.0, 0.01], None, "z"), (8, [3.0, 0.0], 2, "z"), (9, [3.0, 0.0], 2, "z")], "vec_id long, embedding array<double>, label int, kept string")
    found = sorted(((r["vec_id"] if r["vec_id"] is not None else -1), r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicate_vectors(rows).collect())
    assert found == [
        (-1, 0, None, True), (0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (50, 0, 50, True),
    ]
    assert hnsw.near_duplicate_vectors(rows.limit(0)).count() == 0


# Pipeline


def test_pipeline(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (-5, "", None, "src0", 0), (None, "A lonely text, whose key is missing.", "en", None, 3)], docs.schema)
    # More columns, named as those that operators and stages use for themselves.
    clashing = ["row", "toxicity", "secret_spans", "_spans", "copies", "fp", "component_id", "of", "times", "doc", "size"]
    docs = docs.union(extra).withColumns({c: F.lit(i) for i, c in enumerate(clashing)})
    texts = [r["text"] for r in docs.collect()]
    kept, passed = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns, name
        passed[name] = kept.collect()
        assert all(tuple(r[c] for c in clashing) == tuple(range(len(clashing))) for r in passed[name])

    # Of each group of fingerprints within two bits the smallest doc_id is left.
    rows = passed["toxicity"]
    assert len(rows) > 0.8 * len(texts)
    prints = [plain_fingerprint(r["text"], 5) for r in rows]
    near = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 2])
    groups = defaultdict(list)
    for i, root in near.items():
        groups[root].append(rows[i]["doc_id"])
    order = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in passed["simhash_dedup"]), key=order) == sorted((min(g, key=order) for g in groups.values()), key=order)

    # Every secret is masked, nothing else is changed.
    before = Counter((r["doc_id"], r["text"] if r["text"] is None else secrets.redacted(r["text"], secrets.find_spans(r["text"]), pipeline.SECRET_MASK)) for r in passed["simhash_dedup"])
    assert Counter((r["doc_id"], r["text"]) for r in passed["secrets"]) == before
    assert all(r["n_chars"] == len(r["text"]) for r in passed["secrets"] if r["text"] and pipeline.SECRET_MASK in r["text"])

    # Whole copies of what came in, at most twice, each source near its share.
    mixed = Counter((r["doc_id"], r["text"]) for r in passed["mixing"])
    assert all(n <= 2 and key in before for key, n in mixed.items())
    words = lambda rows: Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows if r["source"] == s) for s in {r["source"] for r in rows}})
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(spark.createDataFrame(passed["secrets"], docs.schema)).select("source", "target").distinct().collect()}
    longest = max(len((r["text"] or "").split()) for r in passed["secrets"])
    found = words(passed["mixing"])
    assert all(abs(found[s] - t) <= longest for s, t in targets.items())

    library = Tokenizer.from_file(public_tokenizers.path(pipeline.VOCABULARY))
    ids = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    last = pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert Counter((r["doc_id"], r["source"], bytes(r["token_ids"])) for r in last) == Counter((r["doc_id"], r["source"], ids(r["text"])) for r in passed["mixing"])


def test_pipeline_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_pipeline_on_repeated_rows(spark, sf_dir):
    """Rows that repeat, with and without a key: one of each group of copies stays, and each is mixed by itself."""
    import corpus_pipeline as pipeline

    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    rows = [(key, t, "en", "src0", len(t)) for i, t in enumerate(texts) for key in (None, None, 7, i + 100)]
    docs = spark.createDataFrame(rows, schema)
    kept = pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert Counter(r["text"] for r in kept) == Counter(texts) and {r["doc_id"] for r in kept} == {7}
    same = spark.createDataFrame([(None, texts[0], "en", s, 1) for s in ["src0"] * 300 + ["src1"] * 100], schema)
    mixed = Counter(r["source"] for r in pipeline.mix(spark, same, sf_dir).collect())
    # 600 of 400 documents' words; src0 weighs 5, src1 weighs 2 and stops at twice its size.
    assert mixed == {"src0": pytest.approx(428.6, abs=1), "src1": pytest.approx(171.4, abs=1)}


def test_planted_groups_of_one_label_are_all_linked(spark):
    """Groups of near vectors among others of one label, with the query's own shards: every link, count and component."""
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(40, 24))
    planted = np.concatenate([c + draw.normal(size=(int(n), 24)) * 0.18 for c, n in zip(centres, draw.integers(2, 40, 40))])
    x = np.concatenate([planted, draw.normal(size=(1200, 24)), planted[:30]]).astype("float32")
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    found = {r["vec_id"]: r for r in hnsw.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    v = x.astype("float64")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.93
    np.fill_diagonal(near, False)
    pairs = np.argwhere(near)
    component = roots(range(len(x)), [tuple(map(int, p)) for p in pairs])
    assert len(pairs) > 5000
    for i in range(len(x)):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (int(near[i].sum()), component[i], component[i] == i)
