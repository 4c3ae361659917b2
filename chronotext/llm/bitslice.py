"""Exact top-k search by inner product over a bit-sliced index.

The vectors, floor(256 * x) by component, are dealt into blocks.  A block is stored as bit slices: for each component, the
most significant bits of its values, each bit a bitmap over the rows of the block (Rinfret, O'Neil and O'Neil, 2001).  A
query's product with all rows of a block is then an addition of slices: a slice goes to each place where the query's
component has a bit, inverted where that component is negative, and carry-save adders of whole bitmaps sum them up.  The k-th
largest sum is read off from the most significant slice downward, one count of a bitmap for each slice.

The bits that the slices lack shift a sum by a bounded amount.  Rows whose sum is further below the k-th than that are out;
the others, the boundary rows, are found by a comparison of slices with that bound, and resolved with their exact values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.shared import written
from chronotext.llm.topk import Heaps, merged

SCALE = 256
#: Rows of a block, on average: a bitmap takes 1 KB.
BLOCK = 8192
#: Slices of a component; what its values have beyond, the least significant bits, is left to the exact values.
SLICES = 6
#: Components of all queries of one pass over the index, which is what gets broadcast.
PASS = 1 << 20
#: Larger components count as this, so that products of vectors of up to 64 components stay within 64 bits.
LARGEST = 1 << 28


def usable(v: Column) -> Column:
    """Neither null nor empty, nor with null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(v) > 0)


def scaled(v: Column) -> Column:
    """Integer components; beyond LARGEST they are cut."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))


class Slices:
    """The bit slices of the rows ``values`` (rows x components), and what a query needs to add and resolve them."""

    def __init__(self, values: np.ndarray):
        self.values, (self.n, d) = values, values.shape
        words = -(-self.n // 64)
        self.low = values.min(axis=0)
        above = values - self.low
        #: The bits of each component that are in no slice.
        self.shift = np.maximum([int(x).bit_length() for x in above.max(axis=0)], SLICES) - SLICES
        above >>= self.shift
        bits = np.zeros((d, SLICES, words * 64), bool)
        for b in range(SLICES):
            bits[:, b, : self.n] = ((above >> b) & 1).T
        self.bits = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.rows = np.packbits(np.arange(words * 64) < self.n, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[dict[int, np.ndarray], int, int]:
        """The product with ``q`` as bitmaps by place, an amount to be added, and the most by which the exact product is above both.

        A negative component adds the inverted slices: -x is the inverse of x less the largest value that the slices hold.
        """
        size, negative = np.abs(q), q < 0
        slices = self.bits ^ np.where(negative, ~np.uint64(0), np.uint64(0))[:, None, None]
        most = ((1 << SLICES) - 1) << self.shift
        unseen = (1 << self.shift) - 1
        # x = low + slices + unseen bits; of a negative component the unseen bits only lower the product.
        amount = int((q * self.low).sum() - (size * (most + unseen))[negative].sum())
        slack = int((size * unseen).sum())
        stacks: dict[int, list[np.ndarray]] = {}
        places = int(size.max(initial=0)).bit_length()
        on = (size[:, None] >> np.arange(places)) & 1 == 1
        j, p, b = np.nonzero(np.repeat(on[:, :, None], SLICES, axis=2))
        place = p + b + self.shift[j]
        for w in np.unique(place):
            at = place == w
            stacks[int(w)] = [slices[j[at], b[at]]]
        planes, w = {}, min(stacks, default=0)
        while stacks:
            held = stacks.pop(w, None)
            if held:
                a = np.concatenate(held) if len(held) > 1 else held[0]
                carries = []
                while len(a) > 2:  # three bitmaps become one and a carry
                    k = len(a) // 3
                    x, y, z = a[:k], a[k : 2 * k], a[2 * k : 3 * k]
                    t = x ^ y
                    carries.append((x & y) | (t & z))
                    a = np.concatenate([t ^ z, a[3 * k :]])
                if len(a) == 2:
                    carries.append((a[0] & a[1])[None])
                    a = (a[0] ^ a[1])[None]
                if carries:
                    stacks.setdefault(w + 1, []).extend(carries)
                planes[w] = a[0]
            w += 1
        return planes, amount, slack

    def top(self, q: np.ndarray, k: int, floor: int | None, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact products): all rows, but for ``own``, that can be among the ``k`` best, those below ``floor`` left out."""
        planes, amount, slack = self.sums(q)
        rows = self.rows
        if own is not None:
            rows = rows.copy()
            rows[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        down, kth, need, equal = sorted(planes, reverse=True), 0, k, rows
        for w in down:
            here = equal & planes[w]
            found = int(np.bitwise_count(here).sum())
            if found >= need:
                equal, kth = here, kth + (1 << w)
            else:
                equal, need = equal & ~planes[w], need - found
        least = kth - slack  # with fewer than k rows, kth is 0 and all of them remain
        if floor is not None:
            least = max(least, floor - amount - slack)
        if least > 0:
            above, equal = np.zeros_like(rows), rows
            for w in range(max(least.bit_length() - 1, *down, 0), -1, -1):
                plane = planes.get(w)
                if least >> w & 1:
                    equal = np.zeros_like(rows) if plane is None else equal & plane
                elif plane is not None:
                    above, equal = above | (equal & plane), equal & ~plane
            rows = above | equal
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        return at, self.values[at] @ q

    def pack(self) -> dict:
        kind = np.int16 if np.abs(self.values).max(initial=0) < 1 << 15 else np.int64
        return {"n": self.n, "low": self.low.tobytes(), "shift": self.shift.astype(np.int64).tobytes(), "bits": self.bits.tobytes(), "wide": kind is np.int64, "exact": self.values.astype(kind).tobytes()}

    @classmethod
    def unpack(cls, r: dict) -> Slices:
        s = cls.__new__(cls)
        s.n, s.low, s.shift = r["n"], np.frombuffer(r["low"], np.int64), np.frombuffer(r["shift"], np.int64)
        s.bits = np.frombuffer(r["bits"], np.uint64).reshape(len(s.low), SLICES, -1)
        s.values = np.frombuffer(r["exact"], np.int64 if r["wide"] else np.int16).astype(np.int64).reshape(s.n, -1)
        s.rows = np.packbits(np.arange(s.bits.shape[2] * 64) < s.n, bitorder="little").view(np.uint64)
        return s


INDEX = "block long, dim int, n int, ids binary, missing binary, row binary, low binary, shift binary, bits binary, wide boolean, exact binary"


def build(vectors: DataFrame, n: int) -> DataFrame:
    """The index of ``n`` rows (row, vec_id, v): a row for each block of about BLOCK vectors of one dimension."""
    blocks = max(1, math.ceil(n / BLOCK))
    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.size("v").alias("dim"), "row", "vec_id", "v")
    names = [f.split()[0] for f in INDEX.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in INDEX.split(", ")])

    def run(batches):
        held: list[dict] = []

        def block():
            ids = pa.chunked_array([h["vec_id"] for h in held])
            values = np.concatenate([h["v"].flatten().to_numpy() for h in held]).reshape(len(ids), -1)
            row = {"block": held[0]["block"], "dim": values.shape[1], "ids": ids.fill_null(0).to_numpy().tobytes(), "missing": np.asarray(ids.is_null()).tobytes(), "row": np.concatenate([h["row"].to_numpy() for h in held]).tobytes()}
            return pa.RecordBatch.from_pylist([{k: v for k, v in (row | Slices(values).pack()).items() if k in names}], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            key, dim = b.column("block").to_numpy(), b.column("dim").to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (dim[1:] != dim[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                if held and (held[0]["block"], held[0]["dim"]) != (int(key[s]), int(dim[s])):
                    yield block()
                    held = []
                held.append({"block": int(key[s]), "dim": int(dim[s])} | {c: b.column(c).slice(s, e - s) for c in ("row", "vec_id", "v")})
        if held:
            yield block()

    return dealt.repartition("block", "dim").sortWithinPartitions("block", "dim", "row").mapInArrow(run, INDEX)


def found(index: DataFrame, queries, k: int) -> DataFrame:
    """(query, score, vec_id): the ``k`` best rows of each broadcast query, by its place, in each partition of ``index``."""

    def run(batches):
        rows, vectors = queries.value
        heaps = Heaps(len(rows), k)
        for b in batches:
            for r in b.to_pylist():
                block, ids, missing = Slices.unpack(r), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["missing"], bool)
                place = {int(x): i for i, x in enumerate(np.frombuffer(r["row"], np.int64))}
                for i, (row, q) in enumerate(zip(rows, vectors, strict=True)):
                    if len(q) == r["dim"]:
                        floor = int(heaps.floor[i])
                        at, score = block.top(q, k, None if heaps.empty[i, -1] else floor, place.get(row))
                        heaps.offer(np.full(len(at), i), score, ids[at], missing[at])
        yield heaps.rows(["query", "score", "vec_id"])

    return index.mapInArrow(run, "query long, score long, vec_id long")


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) where ``queries`` holds, the ``k`` other rows with the largest inner product.

    Equal scores go by ascending vec_id, rows without one last; all other rows are returned where they are fewer than ``k``.
    Vectors that are null, empty or hold null or non-finite components take no part, and vectors of different length don't
    meet.  Rows that repeat a vec_id are rows of their own: each is a query, and found by the others.  Columns of other
    names are not looked at; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("_query", F.coalesce(queries, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "_query", F.col("embedding").alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.filter(usable(F.col("v"))).withColumn("v", scaled(F.col("v"))), "vectors")
    asked = rows.filter("_query")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("components")).first()
    index = written(build(rows, rows.count()), "bit-slices")
    passes, out = max(1, math.ceil(size.components / PASS)), None
    for p in range(passes):
        # One part of the queries, of about PASS components, goes to all tasks.
        part = asked.filter(F.pmod(F.xxhash64("row", F.lit("pass")), F.lit(passes)) == p).select("row", "vec_id", "v").orderBy("row").collect()
        sent = spark.sparkContext.broadcast(([r.row for r in part], [np.array(r.v, np.int64) for r in part]))
        ids = spark.createDataFrame([(i, r.vec_id) for i, r in enumerate(part)], "query long, query_id long")
        best = merged(found(index.repartition("block", "dim"), sent, k), "query", "score", "vec_id", k)
        best = best.join(F.broadcast(ids), "query").select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
