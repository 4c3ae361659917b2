"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has 64 bits, one for each bit position that is set in over half the hashes of its word shingles.
Two fingerprints link if they differ in at most three bits; then one of their 32-bit halves differs in at most one.  The
anchors of a half are the words of the perfect Hamming code of length 31 (the half's last bit plays no part): every half
lies within one bit of exactly one anchor, its home.  Each fingerprint is replicated to all anchors within two bits of
each half - the covering radius plus the threshold - so two fingerprints that link meet at the home of one of them, where
they are compared in full.  At most 2 x 17 rows leave each distinct fingerprint, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.components import components
from chronotext.llm.shared import few, free, written

SEED = 42
SHINGLE = 3
BITS = 3
#: Homes that one task compares with an anchor's replicas; an anchor with more is split.
HOMES = 4096
#: Split anchors that are broadcast at most; more are joined by a shuffle.
CROWDED_TO_BROADCAST = 100_000
#: Runs up to this length are compared by shifting, longer ones by search.
SHORT = 24


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer: ASCII lower case, words between ASCII white space, all shingles, repeats included.

    Fewer words than a shingle count as one shingle; no words (or null) give zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    total, seen, step = np.zeros(64, np.int64), 0, 1 << 16
    last = max(1, len(words) - shingle + 1)
    for at in range(0, last, step):
        part = words[at : min(at + step, last) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        hashes = b"".join([digest(join(g), SEED) for g in grams])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        seen += len(bits)
    return int.from_bytes(np.packbits(2 * total > seen).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long.  Whole texts are read; only the fingerprint leaves the task."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _pairs_by_syndrome() -> list[np.ndarray]:
    """For each syndrome s, the masks that carry a 31-bit word with it to the anchors within two bits (its home first)."""
    out = [np.zeros(1, np.int64)]
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) ^ (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s) <= 31]
        out.append(np.array([1 << (s - 1), *pairs], np.int64))
    return out


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor of every fingerprint; the anchors of the two halves are told apart by bit 31."""
    masks, found = _pairs_by_syndrome(), []
    u = fps.view(np.uint64)
    for half in (0, 1):
        word = ((u >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        syndrome = np.zeros(len(word), np.int64)
        for j in range(31):
            syndrome ^= np.where((word >> j) & 1, j + 1, 0)
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                keys = (word[at, None] ^ masks[s]) | (half << 31)
                home = np.zeros(keys.shape, bool)
                home[:, 0] = True
                found.append((np.repeat(at, keys.shape[1]), keys.ravel(), home.ravel()))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def replicas(distinct: DataFrame, homes_only: bool = False) -> DataFrame:
    """(anchor, home, fp, rep) for ``distinct`` (fp, rep)."""

    def run(batches):
        for b in batches:
            fps, reps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            row, key, home = anchors_of(fps)
            if homes_only:
                row, key, home = row[home], key[home], home[home]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fps[row]), pa.array(reps[row])], names=["anchor", "home", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "anchor long, home boolean, fp long, rep long")


def homes(length: int) -> np.ndarray:
    """For every word of ``length`` bits (2^k - 1) the one word of the perfect Hamming code that lies within one bit of it."""
    words = np.arange(1 << length, dtype=np.int64)
    syndrome = np.zeros(len(words), np.int64)
    for j in range(length):
        syndrome ^= np.where((words >> j) & 1, j + 1, 0)
    return words ^ np.where(syndrome, 1 << np.maximum(syndrome - 1, 0), 0)


def near(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether fingerprints, of one number or a row of numbers each, differ in at most ``bits`` bits."""
    differ = np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value's
    return (differ if differ.ndim < 2 else differ.sum(axis=1, dtype=np.int64)) <= bits


def spanning(fps: np.ndarray, home: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links of one anchor join, at most one for each row: a search that compares every home with all rows still unseen."""
    rest, edges_a, edges_b = np.arange(len(fps)), [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(fps[x], fps[rest], bits) & (home[x] | home[rest])
            if hit.any():
                new = rest[hit]
                rest = rest[~hit]
                edges_a.append(np.full(len(new), x))
                edges_b.append(new)
                queue.extend(new)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *edges_a]), np.concatenate([none, *edges_b])


def links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, bits: int = BITS, most: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs among rows sorted by key: all pairs of short runs, spanning ones of long runs."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.r_[starts, len(keys)])
    short = np.repeat(length <= most, length)
    out_a, out_b = [], []
    for d in range(1, min(most, int(length.max(initial=0)))):
        i = np.flatnonzero(short[:-d] & (keys[:-d] == keys[d:]) & (home[:-d] | home[d:]))
        i = i[near(fps[i], fps[i + d], bits)]
        out_a.append(i)
        out_b.append(i + d)
    for s, n in zip(starts[length > most], length[length > most], strict=True):
        a, b = spanning(fps[s : s + n], home[s : s + n], bits)
        out_a.append(a + s)
        out_b.append(b + s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def compare(batches):
    """Linked pairs (a, b) of representatives from rows sorted by anchor; an anchor that goes on in the next batch waits for it."""
    kept = None
    names = ["anchor", "tile", "home", "fp", "rep"]

    def pairs(c):
        key = np.stack([c["anchor"], c["tile"]], 1)
        change = np.r_[False, (key[1:] != key[:-1]).any(1)].cumsum() if len(key) else np.zeros(0, np.int64)
        a, b = links(change, c["fp"], c["home"])
        return pa.RecordBatch.from_arrays([pa.array(c["rep"][a]), pa.array(c["rep"][b])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if kept is not None:
            now = {n: np.concatenate([kept[n], now[n]]) for n in names}
        same = (now["anchor"] == now["anchor"][-1]) & (now["tile"] == now["tile"][-1])
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        kept = {n: now[n][cut:] for n in names}
        if cut:
            yield pairs({n: now[n][:cut] for n in names})
    if kept is not None:
        yield pairs(kept)


def linked_pairs(distinct: DataFrame, homes: int = HOMES) -> DataFrame:
    """(a, b): pairs of representatives of ``distinct`` (fp, rep) that span the links between different fingerprints.

    An anchor that is home to more than ``homes`` fingerprints is split: each of its tiles holds a part of the homes and
    all replicas.  Split anchors are few, as a rule none; they are broadcast only if they are counted to be few.
    """
    crowded = replicas(distinct, homes_only=True).groupBy("anchor").count().filter(F.col("count") > homes)
    crowded = written(crowded.select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("tiles")), "crowded")
    rows = replicas(distinct).join(few(crowded, CROWDED_TO_BROADCAST), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    rows = rows.select("anchor", "tile", (F.col("home") & (F.col("tile") == own)).alias("home"), "fp", "rep")
    return rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile").mapInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``; component_id is the smallest doc_id that links reach.

    Equal fingerprints are one node, so copies are never paired.  Null and empty texts have fingerprint zero and link like
    any other.  A row without doc_id gets a component if a row with an id has its fingerprint, else null.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL"), "distinct")
    found = components(linked_pairs(distinct)).withColumnRenamed("node", "rep")
    label = distinct.join(found.hint("shuffle_merge"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(label.hint("shuffle_merge"), "fp", "left").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id, with all its columns (every row of that id).

    Rows without an id have no name to stay by and go; null and empty texts link like any other; columns of any name pass
    through; an empty table gives an empty one.
    """
    (stays,) = free(docs.columns, "_stays")
    rows = near_components(docs, shingle)
    ids = rows.filter("doc_id = component_id").select(F.col("doc_id").alias(stays)).distinct()
    return docs.join(ids.hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col(stays), "left_semi")
