"""Ranked lexical search in reverse: the items are indexed, the documents pass by.

The items are the queries and few, the documents many.  So the inverted index is one of the items' terms; it is broadcast,
and each document's term counts stream through it: a document's term finds the items that hold it and adds to their scores.
Every task keeps one bounded heap for each item, and the tasks' heaps are merged.  No row pairs an item with a document, and
nothing is shuffled but counts of terms and heaps.

Of the documents one pass keeps (doc_id, length, known terms, their counts); document frequencies, number and length of all
documents come from these, and the second pass reads them instead of the texts.  Items beyond one index's bound are searched
block by block.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.shared import written
from chronotext.llm.topk import Heaps, merged

#: An index is made of at most about so many items, with so many bytes of text together; it is what gets broadcast.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Scores that a task works on at once.
CELLS = 1 << 21
#: Bytes that are part of terms, A-Z lower-cased; all others, turned into blanks, part them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """All terms of a whole text in UTF-8, with repeats; null has none."""
    return (text or b"").translate(FOLD).split()


class Index:
    """The items that hold a term, and how often: ``vocabulary`` numbers the terms, the postings of term t are those from start[t] on."""

    def __init__(self, items: list[tuple[int | None, bytes | None]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for k, (_, text) in enumerate(items):
            for term, n in Counter(terms(text)).items():
                t = self.vocabulary.setdefault(term, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((k, n))
        self.start = np.cumsum([0, *map(len, postings)])
        flat = np.array([p for of in postings for p in of], np.int64).reshape(-1, 2)
        self.item, self.times = flat[:, 0].copy(), flat[:, 1].copy()


def counts(docs: DataFrame, index) -> DataFrame:
    """(doc_id, n, terms, tf) of each document that has a term; terms and tf list those of its terms that the broadcast ``index`` knows."""

    def run(batches):
        known = index.value.vocabulary
        for b in batches:
            ids, n, of, tf = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                every = terms(text.as_py())
                if every:
                    found = Counter(t for t in map(known.get, every) if t is not None)
                    ids.append(doc)
                    n.append(len(every))
                    of.append(list(found))
                    tf.append(list(found.values()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, n, of, tf), kinds, strict=True)], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def chunks(weight: np.ndarray, most: int):
    """(from, to) of runs of rows whose weights sum up to about ``most`` at most; a heavier row is a run of its own."""
    ends = np.cumsum(weight)
    at = 0
    while at < len(weight):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def best(counted: DataFrame, index, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, score, doc_id): the ``k`` best documents of each item in each partition of ``counted``; items are numbered as in the index."""

    def run(batches):
        ix, w = index.value, weights.value
        items = len(ix.ids)
        heaps = Heaps(items, k)
        for b in batches:
            ids = b.column("doc_id")
            missing, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
            length = 100 - 75 + 75 * b.column("n").to_numpy() * n_docs // n_terms
            held = b.column("terms")
            sizes = np.diff(held.offsets.to_numpy())
            row, term, tf = np.repeat(np.arange(len(sizes)), sizes), held.flatten().to_numpy(), b.column("tf").flatten().to_numpy().astype(np.int64)
            value = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * length[row]))
            fan = ix.start[term + 1] - ix.start[term]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for lo, hi in chunks(items + np.bincount(row, fan, len(sizes)).astype(np.int64), CELLS):
                s, e = ends[lo], ends[hi]
                many = fan[s:e]
                # The postings of all terms of these rows, side by side.
                place = np.repeat(ix.start[term[s:e]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                score = np.zeros((hi - lo, items), np.int64)
                np.add.at(score, (np.repeat(row[s:e] - lo, many), ix.item[place]), np.repeat(value[s:e], many) * ix.times[place])
                r, q = np.nonzero((score > 0) & (score >= heaps.floor))
                heaps.offer(q, score[r, q], ids[lo + r], missing[lo + r])
        yield heaps.rows(["item", "score", "doc_id"])

    return counted.mapInArrow(run, "item long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Only scores above 0 count; fewer than ``k`` such documents are all returned, an item without any has no row.  Equal
    scores go by ascending doc_id, rows without one last.  Null and empty texts have no terms: they match nothing and count
    nowhere.  Rows that repeat are rows of their own, among the documents and among the items (each such item has ranks from
    1).  Columns of other names are not looked at.  An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    listed = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("row")), "items")
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size.n / BLOCK_ITEMS), math.ceil(size.bytes / BLOCK_BYTES))
    out = None
    for block in range(blocks):
        of = listed.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").select("item_id", F.col("text").cast("binary").alias("text")).collect()
        index = Index([(r.item_id, None if r.text is None else bytes(r.text)) for r in of])
        sent = spark.sparkContext.broadcast(index)
        counted = written(counts(docs, sent), "term-counts")
        total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        # One number for each term of the block.
        frequency = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(index.vocabulary))], np.int64)
        ids = spark.createDataFrame(list(enumerate(index.ids)), "item long, item_id long")
        found = merged(best(counted, sent, spark.sparkContext.broadcast(weights), total.docs, total.terms or 1, k), "item", "score", "doc_id", k)
        found = found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def oracle(k: int = 10) -> str:
    """The same in SQL; N, L, df, n and tf as in the operator."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = rf"unnest(regexp_extract_all(translate(text, '{capitals}', '{capitals.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return rf"""WITH d AS (SELECT doc_id, {split} FROM documents), i AS (SELECT item_id, {split} FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM len, total),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
