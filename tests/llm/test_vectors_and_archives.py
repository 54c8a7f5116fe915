"""Clustering, hard negatives and archives against plain versions, with odd rows."""

import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from rippletrace.llm import ann, lloyd, negatives, warc
from rippletrace.llm.common import new_path

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0], [1.0, None, 0.0, 0.0, 0.0], [NAN] * 5, [INF, 0.0, 0.0, 0.0, 0.0], [0.0, -INF, 0.0, 0.0, 0.0], [1e30] * 5, [1.0] * 6]


def numbers(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


# Clustering


def plain_clusters(rows, k, rounds, seed):
    """(id, cluster, distance) of rows (id, v), in whole numbers of any size."""
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(rows, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for i in range(len(centroids)):
            members = [v for (_, v), o in zip(rows, own) if o == i]
            if members:
                centroids[i] = [sum(c) // len(members) for c in zip(*members)]
    found = [(key, near(v)[1], near(v)[0]) for key, v in rows]
    sums = {c: sum(d for _, o, d in found if o == c) for _, c, _ in found}
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted((str(k), c, d, sums[c], sum(sums.values()), name(c)) for k, c, d in found)


@pytest.mark.parametrize("k, rounds", [(4, 5), (1, 2), (50, 3), (7, 0)])
def test_clusters_equal_the_plain_ones(spark, k, rounds):
    draw = random.Random(k)
    vectors = [[draw.choice((-2.0, 0.1, 3.0)) + draw.random() * draw.choice((0, 1)) for _ in range(5)] for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3])] * 5 + [(None, vectors[4]), (None, [0.0] * 5), (40, [9000.5, -1.0, 0.0, 0.0, 1.0])]
    odd = [(100 + i, v) for i, v in enumerate(ODD)]
    # Other columns, some with the names that the operator uses.
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, cluster string, chunk int, ids int").repartition(3)
    found = lloyd.cluster_vectors(frame, k, rounds, d=5, columns=2, chunk_rows=4)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == plain_clusters([(i, numbers(v)) for i, v in rows], k, rounds, 2)


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert lloyd.cluster_vectors(empty).collect() == []


def test_partial_distances_are_exact():
    x, c = np.array([[2**28 + 1, -3], [5, 7]]), np.array([[-(2**28) - 1, 2**20], [0, 1]])
    by_hand = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert lloyd.partial_distances(x, c).tolist() == by_hand
    x = x * 2**10
    assert lloyd.wide(lloyd.narrow(x), 2).tolist() == x.tolist() and lloyd.narrow(x)[:1] == b"8" and lloyd.narrow(c)[:1] == b"4"


# Hard negatives


def plain_negatives(rows, anchors, k=5, n=10, low=30, high=90):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = sorted((-dot(v, w), b, m == label) for b, m, w in rows if b != a and len(w) == len(v))
        for s, p in [(-s, b) for s, b, same in scored if same][:k]:
            fit = [(-t, b) for t, b, same in scored if not same and low * s <= -100 * t <= high * s][:n]
            out += [(a, p, i + 1, b, s, t) for i, (t, b) in enumerate(fit)]
    return sorted(out)


def clustered(draw, n, d=6):
    """Vectors near one of three directions, with equal ones among them."""
    ways = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(3)]
    rows = [[x + draw.gauss(0, 0.05) for x in draw.choice(ways)] for _ in range(n)]
    return rows + rows[: n // 10]


def test_negatives_equal_the_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 8)
    draw = random.Random(4)
    rows = [(i, draw.choice((1, 1, 2, 3)), v) for i, v in enumerate(clustered(draw, 200))]
    rows += [(900, 1, []), (901, 1, []), (902, 2, []), (910, 5, [1.0, 2.0]), (911, 6, [0.5, 0.5]), (920, 1, [0.0] * 6)]
    odd = [(1000 + i, 1, v) for i, v in enumerate(ODD) if v != [] and v != [1.0] and v != [1.0] * 6] + [(1100, None, [1.0] * 6), (None, 1, [1.0] * 6)]
    again = [rows[0]] * 3 + [(5, 9, [7.0] * 6)]  # a row that is repeated, and a key with a second, later label
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows + odd + again], "vec_id long, label int, embedding array<float>, d string, block int")
    found = negatives.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = plain_negatives([(i, m, numbers(v)) for i, m, v in rows], {i for i, _, _ in rows if i % 10 == 0})
    assert len(expected) > 200 and sorted(map(tuple, found.collect())) == expected
    assert any(a == 900 for a, *_ in expected)  # empty vectors score 0
    assert negatives.mine_hard_negatives(frame.where("false"), F.lit(True)).collect() == []
    assert negatives.mine_hard_negatives(frame, F.lit(None).cast("boolean")).collect() == []


def test_bounds_along_the_tree_hold_and_spare_work():
    draw = random.Random(9)
    x = np.array([numbers(v) for v in clustered(draw, 400)])
    norm = negatives.root_up((x**2).sum(axis=1))
    order, parent, edge = negatives.spanning_tree(x[:40])
    a = x[:40][order]
    lengths = sorted(np.sqrt(((a[i] - a[parent[i]]) ** 2).sum()) for i in range(1, 40))
    assert sorted(order) == list(range(40)) and all(parent[i] < i for i in range(40)) and all(e >= n for e, n in zip(sorted(edge[1:]), lengths))
    truth, scored = a @ x.T, 0

    def wanted(i, low, high):
        assert (low <= truth[i]).all() and (truth[i] <= high).all()
        return (high >= 60_000) & (low <= 70_000)

    for i, rows, exact in negatives.scores_along_tree(a, parent, edge, x, norm, wanted):
        scored += len(rows)
        assert (truth[i][rows] == exact).all() and set(np.flatnonzero((truth[i] >= 60_000) & (truth[i] <= 70_000))) <= set(rows)
    assert scored < truth.size / 2


def test_windows_and_roots():
    for p in (-7, -1, 0, 1, 3, 10, 99, 10**17):
        [(least, most)] = negatives.windows_of([p], 30, 90)
        assert 100 * least >= 30 * p > 100 * (least - 1) and 100 * most <= 90 * p < 100 * (most + 1)
    squares = np.array([0, 1, 2, 3, 4, 5, 10**12, 10**12 + 1, 2**58, 2**58 - 1])
    assert [int(r) for r in negatives.root_up(squares)] == [0, 1, 2, 2, 2, 3, 10**6, 10**6 + 1, 2**29, 2**29]


# Archives


def plain_records(rows, least=1000):
    out = []
    for key, html in rows:
        data = (html or "").encode()
        equal = [k for k, h in rows if (h or "").encode() == data and k is not None]
        revisit = len(data) >= least and equal and key != max(equal)
        out.append((str(key), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(equal) if revisit else None))
    return sorted(out, key=str)


def test_archives_read_back(spark):
    draw = random.Random(1)
    text = lambda n: " ".join(draw.choice(("<p>häuser</p>", "über", "\x00", "\r\n\r\nWARC/1.1", "😀", "<a href='x'>")) for _ in range(n))
    long, exact, short = text(400), "a" * 1000, "a" * 999
    rows = [(i, text(draw.choice((0, 1, 300)))) for i in range(60)] + [(100 + i, long) for i in range(300)] + [(None, long), (None, "b" * 2000), (None, "b" * 2000), (None, None)]
    rows += [(500, exact), (501, exact), (501, exact), (502, short), (503, short), (504, None), (505, ""), (506, text(200_000)), (-7, "c" * 1500), (-9, "c" * 1500)]
    urls = [None, "", "http://x.org/ä b\r\nWARC-Type: warcinfo", "http://x.org/a%20b?q=1#f"]
    pages = spark.createDataFrame([(k, urls[i % 4], h, "x", "y") for i, (k, h) in enumerate(rows)], "page_id long, url string, html string, payload string, last string")
    path = new_path(spark, "warc-test")
    plan = warc.plan_records(pages.repartition(3))
    warc.write_archives(plan, path, archive_bytes=200_000)
    back = warc.read_archives(spark, path).collect()
    found = sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str)
    assert found == plain_records(rows)
    texts = {k: (h or "").encode() for k, h in rows if k is not None}
    assert all(bytes(r["payload"]) == texts[r["page_id"]] for r in back if r["record_type"] == "response" and r["page_id"] is not None)
    assert all(r["payload"] is None for r in back if r["record_type"] == "revisit")
    assert {r["target_uri"] for r in back} == {None, "", "http://x.org/%C3%A4%20b%0D%0AWARC-Type:%20warcinfo", "http://x.org/a%20b?q=1#f"}

    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 3
    for data in files:
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and data.endswith(struct.pack("<II", 0x184D2A50, 0))
        # Any frame can be read alone, with the dictionary and its own bytes.
        whole = list(warc.records_of(data))
        assert all(r.startswith(b"WARC/1.1\r\n") for r in whole)
        at = data.rindex(struct.pack("<I", 0xFD2FB528), 8 + size)
        one = zstandard.ZstdDecompressor(dict_data=warc._dictionary(data[8 : 8 + size])).decompressobj().decompress(data[at:])
        assert one == whole[-1]
    assert any(d[8:12] == warc.DICTIONARY_MAGIC for d in files)


def test_nothing_and_damage(spark):
    path = new_path(spark, "warc-test")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(none), path)
    assert warc.read_archives(spark, path).collect() == []
    record = warc.make_record("response", 1, "u", b"abc" * 500, 1500, hashlib.sha1(b"abc" * 500).hexdigest(), None, "1970-01-01T00:00:00Z")
    data = warc.make_archive([record])
    assert [warc.parse_record(r)["payload_bytes"] for r in warc.records_of(data)] == [1500]
    with pytest.raises(ValueError):
        list(warc.records_of(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.records_of(data[8:]))
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abcabc", b"abcabd", 1))


def test_a_dictionary_helps():
    records = [warc.make_record("response", i, f"http://x.org/{i}", b"<html><head><title>shop</title></head><body>%d</body></html>" % i * 3, 9, "00" * 20, None, "1970-01-01T00:00:00Z") for i in range(2000)]
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(warc.make_archive(records)) < alone / 2


# Nearest neighbours


def test_what_the_search_sends_to_the_driver_is_small(spark):
    """Neither queries nor whole vectors of each task go by way of the driver, and the sample is that of the smallest hashes."""
    draws = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draws.normal(size=8)]) for i in range(400)] + [(7, [float(i)] * 8) for i in range(1, 40)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    taken = ann.smallest_hashes(vectors, 50)
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and plan.count("Exchange") == 1  # that of the given rows
    hashed = vectors.select("id", "v", F.xxhash64("id").alias("h"), F.xxhash64("v").alias("g")).collect()
    wanted = sorted((r["h"], r["g"], r["id"]) for r in hashed)[:50]
    assert sorted((r["h"], r["g"], r["id"]) for r in taken.collect()) == wanted
    assert ann.smallest_hashes(vectors.limit(0), 50).count() == 0
    found = ann.search_neighbours(vectors.withColumnsRenamed({"id": "vec_id", "v": "embedding"}), F.col("vec_id") % 10 == 0)
    found.collect()
    blocks = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [cell" in line and "salt" in line.split("Join")[1].split("]")[0]]
    assert blocks and not any("Broadcast" in line for line in blocks)
