"""Near-duplicate vectors through navigable small-world graphs, one per shard.

Vectors of a label are dealt to shards of bounded size. Each shard gets a
hierarchical navigable small-world graph, and each is asked for the neighbours
of the vectors of every shard of its label. A query's beam is widened while all
it holds is near enough; if an audit by brute force finds that links are still
missed, all beams start wider. What is found is verified in double precision,
counted, and joined into components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.ann import usable
from rippletrace.llm.common import materialise
from rippletrace.llm.components import connected_components

SHARD_ROWS = 8192
_STEP = 4  # beam entries that are expanded at once, at least; an eighth of wide beams


class SmallWorld:
    """A graph over the rows of ``x``, which have length 1.

    Searches run for many queries at once, in numpy. Vectors are inserted from
    the highest level down, in batches of at most the size of the graph; those
    of a batch are also compared with each other.

    In the lowest layer the last two links of a row aren't chosen for nearness.
    They make a tree: each vector is a child of the one nearest to it when it
    was inserted, and rows know their first child and their next sibling. So
    every vector can be reached, also from among many that are nearly equal.
    """

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 48, seed: int = 3, batch: int = 512) -> None:
        self.x, self.m, self.ef = x.astype("float32"), m, ef
        n = len(x)
        draws = np.random.default_rng(seed)
        level = np.minimum((-np.log(np.maximum(draws.random(n), 1e-12)) / np.log(m)).astype("int64"), 6)
        order = np.lexsort((np.arange(n), -level))
        self.links: list[np.ndarray] = []
        for h in range(int(level.max(initial=0)) + 1):
            self.links.append(np.full((n, 2 * m + 2 if h == 0 else m), -1, "int32"))
        self.entry, at = (int(order[0]) if n else -1), 1
        while at < n:
            new = order[at : at + max(1, min(at, batch))]
            self._insert(new, level)
            at += len(new)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -9)
        start = np.full(len(new), self.entry)
        for h in range(len(self.links) - 1, -1, -1):
            in_layer = level[new] >= h
            if not in_layer.all():
                rest = np.flatnonzero(~in_layer)
                start[rest] = self._beam(self.x[new[rest]], start[rest, None], 1, h)[0][:, 0]
            rows = np.flatnonzero(in_layer)
            if not len(rows):
                continue
            ids, sims = self._beam(self.x[new[rows]], start[rows, None], self.ef, h)
            start[rows] = ids[:, 0]
            if h == 0:
                tree = self.links[0][:, -2:]
                for node, parent in zip(new.tolist(), ids[:, 0].tolist()):
                    tree[node, 1], tree[parent, 0] = tree[parent, 0], node
            # Candidates from the same batch, as far as they are in this layer.
            near = np.where(in_layer[None], own[rows], -9)
            k = min(self.m, len(new))
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            more = np.take_along_axis(near, top, 1)
            ids = np.concatenate([ids, np.where(more > -5, new[top], -1)], axis=1)
            sims = np.concatenate([sims, more], axis=1)
            self._link(h, new[rows], ids, sims)

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, those nearer to it than to any selected before; then the nearest others."""
        sims = np.where(ids < 0, -9, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out = np.full((len(ids), most), -1, "int32")
        for at in range(0, len(ids), 512):
            i, s = ids[at : at + 512], sims[at : at + 512]
            v = self.x[np.maximum(i, 0)]
            mutual = np.einsum("bid,bjd->bij", v, v, optimize=True)
            kept, count = np.zeros(i.shape, bool), np.zeros(len(i), int)
            for c in range(i.shape[1]):
                worst = np.where(kept, mutual[:, c], -9).max(axis=1)
                take = (s[:, c] > -5) & (worst < s[:, c]) & (count < most // 2)
                kept[:, c] = take
                count += take
            # Selected ones first, then by nearness; what isn't there last.
            rank = np.argsort(np.where(s > -5, np.where(kept, 0, 1), 2), axis=1, kind="stable")[:, :most]
            got = np.where(np.take_along_axis(s, rank, 1) > -5, np.take_along_axis(i, rank, 1), -1)
            out[at : at + 512, : got.shape[1]] = got
        return out

    def _link(self, h: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[h][:, : self.m * (2 if h == 0 else 1)]
        most = links.shape[1]
        chosen = self._select(ids, sims, most)
        links[nodes] = chosen
        # And back: each neighbour chooses anew among what it had and who chose it.
        a, b = np.repeat(nodes, most), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        touched, first, n = np.unique(b, return_index=True, return_counts=True)
        for at in range(0, len(touched), 512):
            t, f, c = touched[at : at + 512], first[at : at + 512], n[at : at + 512]
            new = np.full((len(t), int(c.max())), -1, "int64")
            mask = np.arange(new.shape[1])[None] < c[:, None]
            new[mask] = a[np.repeat(f, c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c))]
            both = np.concatenate([links[t], new], axis=1)
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sim = np.einsum("bd,bkd->bk", self.x[t], self.x[np.maximum(both, 0)], optimize=True)
            links[t] = self._select(both, sim, most)

    def _beam(self, q: np.ndarray, start: np.ndarray, ef: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest found of each query in layer ``h``: ids, -1 where there are fewer, and similarities."""
        links, n = self.links[h], len(self.x)
        out_ids, out_sims = np.full((len(q), ef), -1, "int64"), np.full((len(q), ef), -9, "float32")
        room = max(16, min(512, 24_000_000 // max(n, 1), 4_000_000 // ef))
        for at in range(0, len(q), room):
            part = q[at : at + room]
            k = len(part)
            ids, sims = np.full((k, ef), -1, "int64"), np.full((k, ef), -9, "float32")
            seen, done = np.zeros((k, n), bool), np.zeros((k, ef), bool)
            first = start[at : at + room]
            if first.shape[1] > ef:
                first = first[:, :ef]
            ok = first >= 0
            seen[np.repeat(np.arange(k), ok.sum(axis=1)), first[ok]] = True
            s = np.einsum("qd,qkd->qk", part, self.x[np.maximum(first, 0)], optimize=True)
            ids[:, : first.shape[1]], sims[:, : first.shape[1]] = first, np.where(ok, s, -9)
            live = np.arange(k)
            while len(live):
                open_ = np.where(done[live] | (ids[live] < 0), -9, sims[live])
                p = min(max(_STEP, ef // 8), ef)
                pick = np.argpartition(-open_, p - 1, axis=1)[:, :p] if ef > p else np.broadcast_to(np.arange(ef), (len(live), ef))
                good = np.take_along_axis(open_, pick, 1) > -5
                moving = good.any(axis=1)
                live, pick, good = live[moving], pick[moving], good[moving]
                if not len(live):
                    break
                rows = np.repeat(np.arange(len(live)), good.sum(axis=1))
                done[live[rows], pick[good]] = True
                near = np.where(good[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1).astype("int64")
                near = np.sort(near, axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
                new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
                r, c = np.nonzero(new)
                seen[live[r], near[r, c]] = True
                got = np.full(near.shape, -9, "float32")
                got[r, c] = np.einsum("nd,nd->n", part[live[r]], self.x[near[r, c]])
                width = int(new.sum(axis=1).max(initial=0))
                if not width:
                    continue
                if width < got.shape[1]:
                    best = np.argpartition(-got, width - 1, axis=1)[:, :width]
                    near, got = np.take_along_axis(near, best, 1), np.take_along_axis(got, best, 1)
                all_s = np.concatenate([sims[live], got], axis=1)
                all_i = np.concatenate([ids[live], np.where(got > -5, near, -1)], axis=1)
                all_d = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
                top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
                sims[live], ids[live], done[live] = (np.take_along_axis(z, top, 1) for z in (all_s, all_i, all_d))
            order = np.argsort(-sims, axis=1, kind="stable")
            out_ids[at : at + room], out_sims[at : at + room] = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return out_ids, out_sims

    def within(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) found with a similarity of ``least`` or more.

        A query whose beam holds nothing else is asked again with a beam twice as wide.
        """
        if not len(self.x) or not len(q):
            return np.zeros(0, int), np.zeros(0, int)
        q = q.astype("float32")
        start = np.full((len(q), 1), self.entry)
        for h in range(len(self.links) - 1, 0, -1):
            start = self._beam(q, start, 1, h)[0][:, :1]
        found, open_ = [], np.arange(len(q))
        while len(open_):
            ef = min(ef, len(self.x))
            ids, sims = self._beam(q[open_], start, ef, 0)
            full = (sims[:, -1] >= least) & (ef < len(self.x))
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            found.append((open_[r], ids[r, c]))
            start, open_, ef = ids[full], open_[full], 2 * ef
        return tuple(np.concatenate(z) for z in zip(*found))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=np.array([self.entry]), **{f"h{i}": a for i, a in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, x: np.ndarray) -> SmallWorld:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            made.links = [f[f"h{i}"] for i in range(len(f.files) - 1)]
            made.entry = int(f["entry"][0])
        made.x = x.astype("float32")
        return made


def audited_beam(graph: SmallWorld, least: float, ef: int, goal: float, audits: int) -> int:
    """The beam with which ``audits`` rows of the shard find the share ``goal`` of their links.

    At last the beam is as wide as the shard, when nothing that the graph
    reaches is missed.
    """
    n = len(graph.x)
    rows = np.unique(np.linspace(0, n - 1, min(audits, n)).astype(int)) if n else np.zeros(0, int)
    true = int((graph.x[rows] @ graph.x.T >= least).sum())
    while ef < n and len(graph.within(graph.x[rows], least, ef)[0]) < goal * true:
        ef *= 2
    return min(ef, max(n, 1))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes, the smallest that the edges (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicate_vectors(
    vectors: DataFrame,
    least: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard_rows: int = SHARD_ROWS,
    ef: int = 32,
    goal: float = 0.999,
    audits: int = 200,
) -> DataFrame:
    """(``key``, n_links, component_id, kept) for each row.

    Rows of the same label, not null, link if their vectors' cosine in double
    precision is ``least`` or more; n_links counts the linked rows found, and
    component_id is the smallest key reachable, its own included. kept is
    key = component_id.

    A row with a null label or key, or with a vector that is null, empty, zero or
    holds null or non-finite numbers, links with nothing and is kept. Vectors of
    different lengths have no cosine and don't link. Equal vectors of a label link with each other and are
    searched once; a row that is repeated as a whole counts once and gets equal
    results. Rows of one key with different vectors are one node of the
    components. An empty table gives an empty table.

    Shards hold about ``shard_rows`` different vectors of one label and length,
    whatever the size of a label. Of two shards one stays where it is with its
    graph and the other sends it its vectors; which is which alternates, so that
    each shard is asked by about half of the others. A pair of shards yields
    counts and one edge per vector, never pairs.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fit = rows.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    fit = materialise(fit.distinct().withColumns({"hash": F.xxhash64("v"), "d": F.size("v")}), "hnsw-rows")
    same = fit.groupBy("label", "d", "v", "hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    same = materialise(same, "hnsw-vectors")
    sizes = same.groupBy(F.col("label").alias("of"), F.col("d").alias("of_d")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = same.join(sizes, (F.col("label") == F.col("of")) & (F.col("d") == F.col("of_d"))).withColumn("shard", F.pmod("hash", F.col("shards")).cast("int"))
    # Vectors are sent as they are stored; half the bytes of double precision as a rule.
    stored = "float32" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "float64"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "hash"])
        x = np.array([np.asarray(v, "float64") for v in pdf["v"]])
        graph = SmallWorld(x / np.linalg.norm(x, axis=1, keepdims=True))
        beam = audited_beam(graph, least - 1e-6, ef, goal, audits)
        out = pdf[["label", "d", "shard", "shards"]].head(1).assign(x=[x.astype(stored).tobytes()], graph=[graph.to_bytes()], beam=beam)
        return out.assign(**{k: [pdf[k].to_numpy("int64").tobytes()] for k in ("first", "hash", "copies")})

    kind = vectors.schema[label].dataType.simpleString()
    form = f"label {kind}, d int, shard int, shards int, x binary, graph binary, beam int, first binary, hash binary, copies binary"
    built = dealt.select("label", "d", "shard", "shards", "first", "hash", "copies", "v").groupBy("label", "d", "shard").applyInPandas(build, form)
    graphs = materialise(built, "hnsw-graphs")
    found = f"label {kind}, d int, node long, hash long, links long, root long"

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield _links_within(_Side(r.x, r.first, r.hash, r.copies, r.d, stored), r.graph, r.beam, least).assign(label=r.label, d=r.d)

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                asked, asking = _Side(r.x, r.first, r.hash, r.copies, r.d, stored), _Side(r.q_x, r.q_first, r.q_hash, r.q_copies, r.d, stored)
                yield _links_between(asked, asking, r.graph, r.beam, least).assign(label=r.label, d=r.d)

    # The shards that each one asks: smaller numbers of the same parity, larger ones of the other.
    other = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.when((F.col("shard") + o) % 2 == 0, o < F.col("shard")).otherwise(o > F.col("shard")))
    sent = [F.col(c).alias(f"q_{c}") for c in ("x", "first", "hash", "copies")]
    asks = graphs.select(F.col("label").alias("q_label"), F.col("d").alias("q_d"), F.explode(other).alias("asked"), *sent)
    to = (F.col("label") == F.col("q_label")) & (F.col("d") == F.col("q_d")) & (F.col("shard") == F.col("asked"))
    hits = graphs.mapInPandas(within, found).unionByName(graphs.where("shards > 1").join(asks, to).drop("q_label", "q_d", "asked").mapInPandas(between, found))
    hits = materialise(hits, "hnsw-hits")

    links = hits.groupBy("label", "d", F.col("node").alias("first"), "hash").agg(F.sum("links").alias("links"))
    of = fit.join(same, ["label", "d", "v", "hash"]).select("id", "label", "d", "hash", "first", "copies")
    of = materialise(of, "hnsw-members")
    counted = of.join(links, ["label", "d", "first", "hash"], "left")
    counted = counted.select("id", "label", "d", "hash", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    edges = hits.select(F.col("node").alias("a"), F.col("root").alias("b")).union(of.select(F.col("id").alias("a"), F.col("first").alias("b")))
    reached = connected_components(edges).select(F.col("node").alias("id"), "component")

    out = rows.select("id", "label", F.size("v").alias("d"), F.when(usable("v"), F.xxhash64("v")).alias("hash"))
    out = out.join(counted, ["id", "label", "d", "hash"], "left").join(reached, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


class _Side:
    """A shard's vectors and keys, unpacked."""

    def __init__(self, x: bytes, first: bytes, hash: bytes, copies: bytes, d: int, stored: str) -> None:
        self.first, self.hash, self.copies = (np.frombuffer(z, "int64") for z in (first, hash, copies))
        self.x = np.frombuffer(x, stored).reshape(-1, d).astype("float64")
        self.norm = np.linalg.norm(self.x, axis=1)
        self.unit = self.x / self.norm[:, None]

    def report(self, links: np.ndarray, root: np.ndarray) -> pd.DataFrame:
        hit = links > 0
        return pd.DataFrame({"node": self.first[hit], "hash": self.hash[hit], "links": links[hit], "root": root[hit]})


def _verified(asking: _Side, asked: _Side, graph: SmallWorld, beam: int, at: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``asking`` from ``at`` on, row of ``asked``) whose cosine in double precision suffices."""
    q, c = graph.within(asking.unit[at : at + 512], least - 1e-6, beam)
    q = q + at
    good = np.zeros(len(q), bool)
    for i in range(0, len(q), 1 << 16):
        a, b = q[i : i + (1 << 16)], c[i : i + (1 << 16)]
        good[i : i + (1 << 16)] = np.einsum("nd,nd->n", asking.x[a], asked.x[b]) / (asking.norm[a] * asked.norm[b]) >= least
    return q[good], c[good]


def _links_within(s: _Side, graph: bytes, beam: int, least: float) -> pd.DataFrame:
    """Links inside a shard. A pair may be found from one side only and counts for both: a bit for each pair."""
    n, world = len(s.first), SmallWorld.from_bytes(graph, s.unit)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 512):
        q, c = _verified(s, s, world, beam, at, least)
        linked[q, c] = linked[c, q] = True
    np.fill_diagonal(linked, False)
    links, root = np.zeros(n, "int64"), np.arange(n)
    for at in range(0, n, 512):
        q, c = np.nonzero(linked[at : at + 512])
        np.add.at(links, q + at, s.copies[c])
        root = _roots(n, np.concatenate([np.arange(n), q + at]), np.concatenate([root, c]))
    return s.report(links, s.first[root])


def audited_between(world: SmallWorld, asking: _Side, asked: _Side, least: float, beam: int, goal: float = 0.999, audits: int = 64) -> int:
    """The beam with which ``audits`` rows of ``asking`` find the share ``goal`` of their links to ``asked``.

    The rows are foreign to the graph, and so may be harder to find from than
    those by which its own beam was audited.
    """
    rows = np.unique(np.linspace(0, len(asking.unit) - 1, min(audits, len(asking.unit))).astype(int))
    true = int((asking.unit[rows] @ asked.unit.T >= least).sum())
    while beam < len(asked.unit) and len(world.within(asking.unit[rows], least - 1e-6, beam)[0]) < goal * true:
        beam *= 2
    return min(beam, len(asked.unit))


def _links_between(a: _Side, b: _Side, graph: bytes, beam: int, least: float) -> pd.DataFrame:
    """Links from the rows of ``b`` to those of ``a``, found in the graph of ``a``."""
    n, m, world = len(a.first), len(b.first), SmallWorld.from_bytes(graph, a.unit)
    beam = audited_between(world, b, a, least, beam)
    links_a, links_b, root = np.zeros(n, "int64"), np.zeros(m, "int64"), np.arange(n + m)
    for at in range(0, m, 512):
        q, c = _verified(b, a, world, beam, at, least)
        np.add.at(links_a, c, b.copies[q])
        np.add.at(links_b, q, a.copies[c])
        root = _roots(n + m, np.concatenate([np.arange(n + m), c]), np.concatenate([root, q + n]))
    nodes = np.concatenate([a.first, b.first])[root]
    return pd.concat([a.report(links_a, nodes[:n]), b.report(links_b, nodes[n:])], ignore_index=True)
