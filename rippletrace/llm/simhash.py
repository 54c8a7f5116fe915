"""Near duplicates by SimHash, linked through an inverted index of byte positions.

Two 64-bit fingerprints that differ in two bits or fewer share at least six of
their eight bytes, position by position. The index posts a fingerprint under
combinations of positional bytes:

1. Of the bytes taken as four pairs, two pairs are always shared in full. A
   fingerprint that is alone under all six combinations has no partner.
2. The others are posted under all 70 combinations of four bytes. Pairs that
   meet in a posting are counted there.
3. The entries of a posting with more than ``CROWD`` fingerprints don't meet in
   it, but in finer ones: they are posted again with each further byte, up to six
   shared bytes, and at last by one more byte or, for pairs that differ by a bit
   in both of the other bytes, by the half of each of the two that is equal. Such
   a posting holds at most 256 fingerprints, whatever the number of documents.

The postings in which a pair meets tell which bytes it shares. Where the tally
of these doesn't reach the six that are guaranteed, the pair is dropped; the
pairs that are left are verified. A near pair shares all combinations of its six
bytes, and both of its entries go on from a crowded posting, so that it meets
under each of the six bytes however its postings are refined.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippletrace.llm.common import add_columns, materialise
from rippletrace.llm.components import connected_components

#: Pairs meet in postings of up to so many fingerprints; larger ones are refined.
CROWD = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as an unsigned 64-bit number; 0 without words."""
    found = text.encode().lower().split() if text else []  # bytes: only A-Z and ASCII white space count
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in found)]
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, "int64"), len(found) - words + 1
    for at in range(0, n, 1 << 16):
        upto = min(n, at + (1 << 16))
        data = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts[at:upto], starts[at + words : upto + words])])
        ones += np.unpackbits(np.frombuffer(data, "uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(``key``, fp) for each row; fp holds the fingerprint's bits as a signed long."""

    def start():
        return lambda texts: [np.array([fingerprint(t, words, seed) for t in texts], "uint64").view("int64")]

    keyed = docs.select(F.col(key).cast("long").alias(key), text)
    return add_columns(keyed, text, start, [("fp", T.LongType(), pa.int64())], [key])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _kept(positions: Sequence[int]) -> int:
    """The mask of the bytes at ``positions``, as a signed number."""
    return _signed(sum(0xFF << 8 * p for p in positions))


def _posted(fps: DataFrame, combinations: Sequence[tuple[int, ...]]) -> DataFrame:
    """A posting (positions, key) of each fingerprint for each combination of bytes; ``positions`` has a bit for each of them."""
    posts = [F.struct(F.lit(sum(1 << p for p in c)).cast("long").alias("positions"), F.col("fp").bitwiseAND(F.lit(_kept(c))).alias("key")) for c in combinations]
    return fps.select("fp", F.inline(F.array(*posts)))


def _refined(postings: DataFrame) -> DataFrame:
    """Each entry posted again with each byte that its posting leaves open, once however many postings it comes from."""
    finer = [
        F.when(
            F.col("positions").bitwiseAND(F.lit(1 << p)) == 0,
            F.struct(
                F.col("positions").bitwiseOR(F.lit(1 << p)).alias("positions"),
                F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_kept([p])))).alias("key"),
            ),
        )
        for p in range(8)
    ]
    return postings.select("fp", F.inline(F.array_compact(F.array(*finer)))).distinct()


def _not_alone(postings: DataFrame, *keys: str) -> DataFrame:
    """The entries of postings that hold several fingerprints, with their number ``n``."""
    several = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return postings.join(several.hint("shuffle_hash"), list(keys))


def _split(fp: Column, i: Column, j: Column) -> Column:
    """Postings (positions, mask, key) under six shared bytes: by byte i or byte j as well, or by a half of each of the two.

    ``positions`` has a bit for each byte that is shared in full, ``mask`` the
    bits that are left open, and ``key`` all other bits.
    """
    take = lambda values, at: F.get(F.array(*[F.lit(_signed(v)) for v in values]), at)
    byte = lambda at, width, up: take([width << 8 * p + up for p in range(8)], at)
    lost = lambda at: take([1 << p for p in range(8)], at)
    rows = [(F.lit(255) - lost(at), byte(at, 0xFF, 0)) for at in (i, j)]
    rows += [(F.lit(255) - lost(i) - lost(j), byte(i, 0xF, x).bitwiseOR(byte(j, 0xF, y))) for x in (0, 4) for y in (0, 4)]
    return F.array(*[F.struct(p.cast("long").alias("positions"), m.alias("mask"), fp.bitwiseAND(F.bitwise_not(m)).alias("key")) for p, m in rows])


def tallied_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of fingerprints that meet in a posting, and a bit for each position that they share there.

    All pairs of ``distinct`` (fp) within two bits are among them, each once.
    """
    two_of_four = [tuple(p for q in two for p in (2 * q, 2 * q + 1)) for two in itertools.combinations(range(4), 2)]
    coarse = materialise(_not_alone(_posted(distinct, two_of_four), "positions", "key").select("fp").distinct(), "simhash-coarse")
    postings, meeting = _posted(coarse, list(itertools.combinations(range(8), 4))), []
    for size in (4, 5, 6):
        level = materialise(_not_alone(postings, "positions", "key"), f"simhash-{size}")
        mask = F.lit(0).cast("long").alias("mask")
        meeting.append(level.where(F.col("n") <= CROWD).select("positions", mask, "key", "fp"))
        crowded = level.where(F.col("n") > CROWD)
        postings = _refined(crowded)
    # A posting with seven shared bytes comes from each of the two bytes beside its own.
    open_ = F.filter(F.array(*map(F.lit, range(8))), lambda p: F.get(F.array(*[F.col("positions").bitwiseAND(F.lit(1 << q)) for q in range(8)]), p) == 0)
    fine = crowded.select("fp", open_.alias("open"))
    fine = fine.select("fp", F.inline(_split(F.col("fp"), F.get("open", F.lit(0)), F.get("open", F.lit(1))))).distinct()
    meeting.append(_not_alone(fine, "positions", "mask", "key").select("positions", "mask", "key", "fp"))
    met = materialise(functools.reduce(DataFrame.unionByName, meeting), "simhash-postings")
    other, where = met.withColumnRenamed("fp", "b"), ["positions", "mask", "key"]
    pairs = met.withColumnRenamed("fp", "a").join(other, where).where(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.bit_or("positions").alias("shared"))


def fingerprint_links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of ``distinct`` (fp) within ``bits`` bits, 0 to 2."""
    if bits not in (0, 1, 2):
        raise ValueError("bits must be 0, 1 or 2")
    enough = F.bit_count("shared") >= 8 - bits
    return tallied_pairs(distinct).where(enough).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 2
) -> DataFrame:
    """(``key``, fp, component_id) for each row: the smallest key reachable by links.

    Rows link whose fingerprints differ in ``bits`` bits or fewer. Exact copies
    are reduced to one fingerprint before anything is compared. Null, empty and
    blank texts have fingerprint 0 and link like any other. A null key never is
    a component's id unless all its rows have null keys. Repeated rows give
    repeated results; an empty table gives an empty table; other columns aren't
    read. Texts are read once; what is shuffled are keys and fingerprints.
    """
    prints = materialise(fingerprints(docs, key, text, words, seed), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    labels = connected_components(fingerprint_links(distinct.select("fp"), bits))
    of = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of = materialise(of, "simhash-components")
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(ids, "component").select("fp", "component_id")
    return prints.join(of, "fp").select(key, "fp", "component_id")
