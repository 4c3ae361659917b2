"""Near copies by their word shingles: documents link if the Jaccard similarity of their sets of five-word shingles is at least 0.8.

Candidates come from SimHash anchors, as in :mod:`simhash`.  A document's fingerprint has 96 words of 22 bits, one bit for
each position that is set in over half the hashes of its shingles.  The anchors of a word are those of the perfect Hamming
codes of length 15 and 7 on its two parts, so each word lies within two bits of exactly one anchor, its home, and equal
words share it.  Sets of similarity 0.8 differ in about 15 % of bits; two such words share a home with chance 0.07, so two
documents meet at one of 96 with chance 0.999.  At an anchor documents are compared by sketches, one bit of each of 128
min-hashes, and go on that have another within 30 bits there: a bit differs with half the chance that the sets do not share
an element of their union, so the expected distance at 0.8 is 13, and more than 30 has a chance below one in 100,000.  Each
is confirmed by the exact similarity of the whole sets, so no link is wrong.  Anchors with the same members are compared
once, and only documents that meet another carry their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm import simhash
from chronotext.llm.components import components
from chronotext.llm.shared import free, written

SHINGLE, LEAST = 5, 0.8
#: Words of a fingerprint, and the bits of their two parts.
WORDS, PARTS = 96, (15, 7)
#: Bits of a sketch that are compared at an anchor, and how many of them may differ.
SKETCH, FAR = 128, 30
#: Documents of an anchor up to this number are compared by shifting, more by search.
SHIFTS = 512
#: Documents that one task holds to compare a key's others with; a key with more is split.
HOMES = 2048
WIDTH = sum(PARTS)
_RNG = np.random.default_rng(4)
TIMES = _RNG.integers(0, 1 << 63, WORDS * WIDTH // 64, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RNG.integers(0, 1 << 63, WORDS * WIDTH // 64, np.uint64)
LEAST_TIMES = _RNG.integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
LEAST_PLUS = _RNG.integers(0, 1 << 63, SKETCH, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW, HIGH = (simhash.homes(n) for n in PARTS)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all word shingles, words as in :func:`simhash.fingerprint`; fewer words than a shingle, or none, are one shingle."""
    words = (text or b"").lower().split()
    grams = zip(*(words[k:] for k in range(size)), strict=False) if len(words) >= size else [words]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(b" ".join(g)) for g in grams]), np.uint64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The bits of the set ``own``, each set if it is in over half the hashes."""
    total = np.zeros(WORDS * WIDTH, np.int64)
    for at in range(0, len(own), 255):  # as many as a byte counts
        h = (own[at : at + 255, None] ^ PLUS) * TIMES
        h = (h ^ (h >> np.uint64(29))) * MIX
        h ^= h >> np.uint64(32)
        total += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * total > len(own)


def sketch(own: np.ndarray) -> np.ndarray:
    """One bit of each min-hash of the set ``own``, packed into bytes."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 256):
        np.minimum(least, ((own[at : at + 256, None] ^ LEAST_PLUS) * LEAST_TIMES).min(axis=0), out=least)
    return np.packbits(((least * MIX) >> np.uint64(63)).astype(np.uint8))


def anchors(bits: np.ndarray) -> np.ndarray:
    """The home of every word of every fingerprint (rows of bits), told apart by the word's place."""
    words = bits.reshape(len(bits), WORDS, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int64))
    return (np.arange(WORDS, dtype=np.int64) << WIDTH) | (HIGH[words >> PARTS[0]] << PARTS[0]) | LOW[words & ((1 << PARTS[0]) - 1)]


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have at least the similarity ``least``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (small + large - shared)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, key) of every document with an id, one row for each word's anchor; a and b are the sketch compared there."""

    def run(batches):
        for batch in batches:
            own = [shingles(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            bits = np.array([fingerprint(x) for x in own], bool).reshape(-1, WORDS * WIDTH)
            part = np.array([sketch(x) for x in own], np.uint8).reshape(-1, SKETCH // 8).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(anchors(bits).ravel()), WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy()), keys], names=["doc_id", "a", "b", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a long, b long, keys array<long>").select("doc_id", "a", "b", F.explode("keys").alias("key"))


def meeting(batches):
    """(key, rep, doc_id) of the documents of rows sorted by key that are near another one of their key; ``rep`` is one for all that nearness joins."""
    kept = None
    names = ["key", "doc_id", "a", "b"]

    def joined(c):
        fps = np.stack([c["a"], c["b"]], 1)
        x, y = simhash.links(c["key"], fps, np.ones(len(fps), bool), FAR, SHIFTS)
        of, before = np.arange(len(fps)), None
        while before is None or (of != before).any():
            before = of.copy()
            least = np.minimum(of[x], of[y])
            np.minimum.at(of, x, least)
            np.minimum.at(of, y, least)
            of = of[of]
        on = np.unique(np.concatenate([x, y]))
        return pa.RecordBatch.from_arrays([pa.array(c["key"][on]), pa.array(c["doc_id"][of[on]]), pa.array(c["doc_id"][on])], names=["key", "rep", "doc_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if kept is not None:
            now = {n: np.concatenate([kept[n], now[n]]) for n in names}
        cut = int(np.searchsorted(now["key"], now["key"][-1]))
        kept = {n: now[n][cut:] for n in names}
        if cut:
            yield joined({n: now[n][:cut] for n in names})
    if kept is not None:
        yield joined(kept)


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, own): the whole sorted shingle set of every document, eight bytes a shingle."""

    def run(batches):
        for b in batches:
            own = [shingles(t.as_py()).tobytes() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.binary())], names=["doc_id", "own"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, own binary")


def compare(batches):
    """Edges (a, b) that join what the links of each (key, tile) join, from rows sorted by it, homes first.

    Each row is compared with the tile's homes, except those that edges already join with it; only the homes are held.
    """
    now, homes, root = None, [], []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("key", "tile", "home", "doc_id", "own"))
        for key, tile, home, doc, own in zip(*columns, strict=True):
            if now != (key, tile):
                now, homes, root = (key, tile), [], []
            own, mine = np.frombuffer(own, np.uint64), None
            for k, (other, its) in enumerate(homes):
                at = find(k)
                if at != mine and similar(own, its):
                    out.append((doc, other))
                    if mine is not None:
                        root[max(at, mine)] = min(at, mine)
                    mine = at if mine is None else min(at, mine)
            if home:
                root.append(len(root) if mine is None else mine)
                homes.append((doc, own))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(docs: DataFrame, homes: int = HOMES) -> DataFrame:
    """(a, b): pairs of ids that span the links between the documents of ``docs`` (doc_id, text)."""
    keys = keyed(docs).repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(meeting, "key long, rep long, doc_id long")
    keys = written(keys.select(F.xxhash64("key", "rep").alias("key"), "doc_id"), "keys")
    members = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    groups = members.filter("lo < hi").groupBy("n", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / homes).cast("int").alias("tiles"))
    rows = written(keys.join(groups.hint("shuffle_merge"), "key").distinct(), "members")
    own = sets(docs.join(rows.select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_semi"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", "tile", (F.pmod(F.xxhash64("doc_id"), "tiles") == F.col("tile")).alias("home"), "doc_id").join(own.hint("shuffle_merge"), "doc_id")
    rows = rows.select("key", "tile", "home", "doc_id", "own").repartition("key", "tile").sortWithinPartitions("key", "tile", F.desc("home"))
    return rows.mapInArrow(compare, "a long, b long")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component of links the document with the smallest id, with all its columns.

    Rows without id stay, rows that repeat an id stay or go together, null counts as empty, and all texts of fewer than
    five words that agree but for case and white space link.  Columns of any name pass through; an empty table stays empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    (out,) = free(docs.columns, "_gone")
    gone = components(links(texts)).filter("node > component").select(F.col("node").alias(out)).distinct()
    return docs.join(gone.hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col(out), "left_anti")
