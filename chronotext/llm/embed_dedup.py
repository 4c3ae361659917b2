"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; k projections, shifted and cut into cells of one width, name a
bucket, and there are several tables of such buckets.  On unit vectors cosine >= 0.9 is a distance of at most 0.447, which
fixes the chance that a projection agrees and so the number of tables for a wanted recall.  Vectors that share a bucket
get an exact cosine in double precision.  Equal vectors are one row throughout; of a bucket come counts per vector and
edges that span its links, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.llm.components import components
from chronotext.llm.shared import few, free, written

COSINE = 0.9
WIDTH = 2.5
#: Wanted chance of finding a pair whose cosine is just the threshold; pairs above it are found more often.
RECALL = 0.96
#: (projections a table, tables), whatever the number of vectors: 14 tables of 10 projections find a pair at cosine 0.9 with chance 0.96.
SHAPE = (10, 14)
#: Unrelated vectors that a bucket should hold.  More of them mean fewer tables, so fewer copies of a vector are shuffled, and more exact cosines.
CROWD = 1024
#: Rows of one task's tile; larger buckets are cut into tiles that meet pairwise.
TILE = 2048
#: Buckets cut into tiles that are broadcast at most; more are joined by a shuffle.
CROWDED_TO_BROADCAST = 100_000
SEED = 8


def agreement(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection puts two vectors at ``distance`` into one cell (Datar et al., 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(k: int, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables of ``k`` projections that find a pair at ``cosine`` with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log1p(-(agreement(math.sqrt(2 - 2 * cosine)) ** k)))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """A shape for ``n`` vectors, to be chosen where SHAPE leaves buckets too full: projections so that unrelated vectors leave CROWD rows in a bucket, tables for the recall.

    The wanted chance of finding a link holds at every size, but which links the chance leaves out follows from ``n``, so
    that unrelated rows decide on them.
    """
    k = max(4, math.ceil(math.log(max(2.0, n / CROWD)) / -math.log(agreement(math.sqrt(2)))))
    return k, tables_for(k, cosine, recall)


def usable(v: Column) -> Column:
    """Neither null, nor empty, nor zero, nor with null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that very large or small ones neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Cells:
    """The buckets of vectors in all tables, from directions that follow from the seed and the dimension alone."""

    def __init__(self, k: int, tables: int, width: float = WIDTH):
        self.k, self.tables, self.width, self.drawn = k, tables, width, {}

    def of(self, unit_rows: np.ndarray, tables: int | None = None) -> np.ndarray:
        """One 32-bit bucket for each row and each of the first ``tables`` tables."""
        d, tables = unit_rows.shape[1], self.tables if tables is None else tables
        if d not in self.drawn:
            rng = np.random.default_rng([SEED, d])
            self.drawn[d] = rng.standard_normal((d, self.k * self.tables)), rng.uniform(0, self.width, self.k * self.tables), rng.integers(1, 1 << 62, self.k, dtype=np.int64) | 1
        a, shift, odd = self.drawn[d]
        n = self.k * tables
        # Without BLAS, so that a vector's sums do not depend on the rows beside it.
        cell = np.floor((np.einsum("ij,jk->ik", unit_rows, a[:, :n], optimize=False) + shift[:n]) / self.width).astype(np.int64)
        return ((cell.reshape(len(cell), tables, self.k) * odd).sum(axis=2) >> 24).astype(np.int32)


def signatures(distinct: DataFrame, k: int, tables: int, width: float = WIDTH) -> DataFrame:
    """``distinct`` (rep, copies, v) with dim and cells, one 32-bit bucket for each table."""

    def run(batches):
        drawn = Cells(k, tables, width)
        for b in batches:
            lists = b.column("v").to_pylist()
            dims = np.array([len(x) for x in lists], np.int32)
            cells = np.zeros((len(lists), tables), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cells[at] = drawn.of(unit(np.array([lists[i] for i in at], np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), b.column("v"), pa.array(dims), pa.array(list(cells), pa.list_(pa.int32()))], names=["rep", "copies", "v", "dim", "cells"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("rep", "copies", "v").mapInArrow(run, f"rep long, copies long, v {kind}, dim int, cells array<int>")


def span(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that span the links of a symmetric matrix, by breadth-first search."""
    a, b, unseen = [], [], np.ones(len(hit), bool)
    for root in np.flatnonzero(hit.any(axis=1)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(hit[x] & unseen)
            unseen[new] = False
            a += [x] * len(new)
            b += new.tolist()
            queue += new.tolist()
    return a, b


def bucket_links(table: int, two: bool, side: np.ndarray, v: np.ndarray, copies: np.ndarray, rep: np.ndarray, cosine: float, cells: Cells):
    """(rep, other, links) rows of one tile.  A pair that an earlier table has brought together is left to that table.

    ``side`` tells the parts of a tile apart: where it has two (``two``), only pairs between them count.  The buckets of
    earlier tables are worked out again, for the few rows that have links.
    """
    u = unit(v.astype(np.float64))
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    if two:
        hit &= side[:, None] != side[None, :]
    if not hit.any():
        return [], [], []
    rows = np.flatnonzero(hit.any(axis=1))
    hit = hit[np.ix_(rows, rows)]
    if table:
        earlier = cells.of(u[rows], table)
        for t in range(table):
            hit &= earlier[:, t, None] != earlier[None, :, t]
    links = hit @ copies[rows]
    a, b = span(hit)
    counted = np.flatnonzero(links)
    return [*rep[rows[counted]], *rep[rows[a]]], [*[None] * len(counted), *rep[rows[b]]], [*links[counted], *[0] * len(a)]


def near_vectors(df: DataFrame, cosine: float = COSINE, shape: tuple[int, int] = SHAPE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df`` (vec_id, embedding).

    ``shape`` is (projections a table, tables); whether two vectors link depends on it and on them alone.  It suits a
    threshold of 0.9; :func:`tables_for` gives the tables for others, :func:`plan` both for a number of vectors.
    n_links counts the other rows linked directly, equal vectors included; component_id is the smallest vec_id that links
    reach.  Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different length.  Rows that repeat a vec_id count as rows of their own; those without a vec_id count as links of
    others and get the component of an equal vector that has one.  An empty table gives an empty result.
    """
    of = df.schema["embedding"].dataType
    kind = "array<float>" if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else "array<double>"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    good = rows.filter(usable(F.col("v")))
    classes = written(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    k, tables = shape
    signed = written(signatures(classes.filter("rep IS NOT NULL"), k, tables), "signed")
    placed = signed.select("rep", F.posexplode("cells").alias("t", "cell"), "dim")
    crowded = placed.groupBy("t", "cell", "dim").count().filter(F.col("count") > TILE)
    crowded = written(crowded.select("t", "cell", "dim", F.ceil(F.col("count") / TILE).cast("int").alias("parts")), "crowded")
    rows_of = signed.select("rep", "copies", "v", "dim", F.posexplode("cells").alias("t", "cell")).join(few(crowded, CROWDED_TO_BROADCAST), ["t", "cell", "dim"], "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    rows_of = rows_of.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows_of = rows_of.select("t", "cell", "dim", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side"), "rep", "copies", "v")
    key = ["t", "cell", "dim", "p", "q"]

    def run(batches):
        names, cells = [*key, "side", "rep", "copies"], Cells(k, tables)
        held: list[dict] = []

        def flush():
            c = {n: np.concatenate([h[n] for h in held]) for n in [*names, "v"]}
            return bucket_links(int(c["t"][0]), bool(c["p"][0] != c["q"][0]), c["side"].astype(bool), np.stack(c["v"]), c["copies"], c["rep"], cosine, cells)

        out: tuple[list, list, list] = ([], [], [])
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            c["v"] = np.empty(b.num_rows, object)
            c["v"][:] = list(b.column("v").to_numpy(zero_copy_only=False))
            change = np.zeros(b.num_rows, bool)
            for n in key:
                change[1:] |= c[n][1:] != c[n][:-1]
            starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                now = tuple(c[n][s] for n in key)
                if now != last and held:
                    if sum(len(h["rep"]) for h in held) > 1:
                        for x, y in zip(out, flush(), strict=True):
                            x.extend(y)
                    held = []
                last = now
                held.append({n: x[s:e] for n, x in c.items()})
            if len(out[0]) > 20_000:
                yield _links(out)
                out = ([], [], [])
        if held and sum(len(h["rep"]) for h in held) > 1:
            for x, y in zip(out, flush(), strict=True):
                x.extend(y)
        if out[0]:
            yield _links(out)

    found = written(rows_of.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "rep long, other long, links long"), "links")
    counts = found.filter("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    parts_of = components(found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    # Classes are told apart by whole vectors; only the way back from a row to its class goes by 128 bits of hash.
    hashes = (F.xxhash64("v").alias("h"), F.xxhash64(F.lit(SEED), "v").alias("g"))
    label = classes.select("rep", "copies", *hashes).join(counts.hint("shuffle_merge"), "rep", "left").join(parts_of.hint("shuffle_merge"), "rep", "left")
    label = label.select("h", "g", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.select("vec_id", *hashes).join(label.hint("shuffle_merge"), ["h", "g"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(out):
    return pa.RecordBatch.from_arrays([pa.array([None if y is None else int(y) for y in x], pa.int64()) for x in out], names=["rep", "other", "links"])


def dedup(df: DataFrame, **how) -> DataFrame:
    """The vectors of ``df`` that stay, one of each component, with all columns of ``df``; rows without a vec_id go."""
    (stays,) = free(df.columns, "_stays")
    ids = near_vectors(df, **how).filter("kept").select(F.col("vec_id").alias(stays)).distinct()
    return df.join(ids.hint("shuffle_merge"), df["vec_id"].cast("long") == F.col(stays), "left_semi")
