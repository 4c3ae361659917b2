"""Chunking by token budgets.

Where a chunk ends depends on where it began, so cuts follow one from another; but each is found by a search in the prefix
sums of the tokens, without looking at the segments between.  One stream of slim rows a source, token counts and sentence
ends alone, yields the cuts.  Everything heavy goes by time cells: segments are numbered inside a cell, a chunk names the
cells it has segments in, and texts meet their chunks by (source, cell), so a source that holds a third of all rows is
spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.functions import text as X
from chronotext.staging import staged

#: Seconds of a cell; times beyond FAR count as FAR, and null ones come first.
CELL, FAR = 512.0, 1e11


class Cuts:
    """The chunks of a source, from its segments in order: each is (no, from, to), of positions of segments.

    A chunk that the next segment would overfill is cut in front of it, or with ``at_stops`` behind its last sentence end,
    if there is one behind the part carried over.  The next chunk begins with the longest run of last segments of the cut
    part that has at most ``overlap`` tokens, and takes the segment that overfilled the one before whatever its size.
    Holds what belongs to the open chunk.
    """

    def __init__(self, max_tokens: int, overlap: int, at_stops: bool):
        self.most, self.overlap, self.at_stops = max_tokens, overlap, at_stops
        self.upto, self.stops, self.at = [0], [], []  # tokens before each segment and in all, sentence ends, (cell, no) of each
        self.no, self.first, self.unchecked, self.carried = 0, 0, 1, 0

    def add(self, tokens: list[int], stops: list[bool], at: list[tuple[int, int]]):
        n = len(self.at)
        self.upto += list(accumulate(tokens, initial=self.upto[-1]))[1:]
        self.stops += [n + k for k, stop in enumerate(stops) if stop]
        self.at += at
        while (over := bisect_right(self.upto, self.upto[self.first] + self.most, min(self.unchecked + 1, len(self.upto))) - 1) < len(self.at):
            cut = over
            if self.at_stops:
                last = bisect_left(self.stops, over) - 1
                if last >= 0 and self.stops[last] >= self.carried:
                    cut = self.stops[last] + 1
            yield self.chunk(cut)
            self.first = bisect_left(self.upto, self.upto[cut] - self.overlap, self.first, cut)
            self.carried, self.unchecked = cut, over + 1
        if self.first > 100_000:
            self.forget()

    def forget(self):
        k = self.first
        self.upto, self.at, self.stops = self.upto[k:], self.at[k:], [s - k for s in self.stops[bisect_left(self.stops, k) :]]
        self.first, self.unchecked, self.carried = 0, self.unchecked - k, self.carried - k

    def chunk(self, cut: int):
        self.no += 1
        return self.no - 1, [c for c, _ in groupby(c for c, _ in self.at[self.first : cut])], self.at[self.first][1], self.at[cut - 1][1]

    def rest(self):
        if self.first < len(self.at):
            yield self.chunk(len(self.at))


def cuts(slim: DataFrame, max_tokens: int, overlap: int, at_stops: bool) -> DataFrame:
    """(source_id, chunk_no, cells, from_no, to_no): the cells in which a chunk has segments, and its first and last number in the first and last of them."""
    kind = slim.schema["source_id"].dataType.simpleString()
    schema = pa.schema([("chunk_no", pa.int32()), ("cells", pa.list_(pa.int64())), ("from_no", pa.int32()), ("to_no", pa.int32())])

    def run(batches):
        now, state = None, None
        for b in batches:
            of, found, whose = b.column("source_id"), [], []
            ids, tok, stop, at = of.to_pylist(), b.column("tok").to_pylist(), b.column("stop").to_pylist(), list(zip(b.column("cell").to_pylist(), b.column("no").to_pylist(), strict=True))
            k = 0
            for source, rows in groupby(ids):
                e = k + sum(1 for _ in rows)
                if state is None or source != now:
                    if state is not None:
                        found += (rest := list(state.rest()))
                        whose += [now] * len(rest)
                    now, state = source, Cuts(max_tokens, overlap, at_stops)
                found += (new := list(state.add(tok[k:e], stop[k:e], at[k:e])))
                whose += [source] * len(new)
                k = e
            yield batch(whose, found, of.type)
        if state is not None:
            rest = list(state.rest())
            yield batch([now] * len(rest), rest, of.type)

    def batch(whose, found, kind):
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(whose, kind), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=["source_id", *schema.names])

    rows = slim.select("source_id", "cell", "no", "tok", "stop").repartition("source_id").sortWithinPartitions("source_id", "cell", "no")
    return rows.mapInArrow(run, f"source_id {kind}, chunk_no int, cells array<long>, from_no int, to_no int")


def _chunks(seg: DataFrame, max_tokens: int, overlap: int, counter: Callable[[Column], Column], at_stops: bool) -> DataFrame:
    """Chunks of segments in order of start and seq: text joined, times of the first and last segment, tokens of the joined text, the segments' seq."""
    stop = F.coalesce(F.col("text").rlike(r"[.!?]+[ \t\n\r\f]*$"), F.lit(False))
    cell = F.when(F.col("start").isNull(), -(1 << 60)).otherwise(F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("start"))) / CELL)).cast("long")
    rows = seg.select("source_id", F.col("seq"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), counter(F.col("text")).cast("long").alias("tok"), stop.alias("stop"), "text", F.xxhash64("text").alias("tie"))
    # Segments that agree in time and seq are told apart by their texts; equal rows stand for each other.
    # Tokens and sentence ends follow from the text, so they need no place in the order and are counted for the cuts alone.
    within = W.Window.partitionBy("source_id", "cell").orderBy("start", "seq", "end", "tie")
    rows = rows.withColumn("cell", cell).withColumn("no", F.row_number().over(within))
    found = cuts(rows, max_tokens, overlap, at_stops)
    last = F.col("pos") == F.size("cells") - 1
    found = found.select("*", F.posexplode("cells").alias("pos", "cell")).select("source_id", "cell", "chunk_no", (F.size("cells") == 1).alias("whole"), F.when(F.col("pos") == 0, F.col("from_no")).otherwise(0).alias("lo"), F.when(last, F.col("to_no")).otherwise((1 << 31) - 1).alias("hi"))
    met = rows.join(found.hint("shuffle_hash"), ["source_id", "cell"]).filter(F.col("no").between(F.col("lo"), F.col("hi")))
    # The join has dealt rows by (source, cell), so pieces are put together where they are; most chunks are one piece.
    # A piece whose texts are all null has none, so that it leaves no blank between its neighbours; a chunk has an empty one.
    joined = lambda p: F.when(F.exists(p, lambda x: x["text"].isNotNull()), F.array_join(F.transform(p, lambda x: x["text"]), " "))
    of = lambda p: [joined(p).alias("text"), F.get(p, F.lit(0))["start"].alias("start"), F.element_at(p, -1)["end"].alias("end")]
    whole_text = F.coalesce("text", F.lit(""))
    pieces = met.groupBy("source_id", "cell", "chunk_no", "whole").agg(F.array_sort(F.collect_list(F.struct("no", "seq", "start", "end", "text"))).alias("p"))
    pieces = pieces.select("source_id", "cell", "chunk_no", "whole", *of(F.col("p")), F.transform("p", lambda x: x["seq"]).alias("segment_indices"))
    pieces = staged(pieces.withColumn("token_count", F.when(F.col("whole"), counter(whole_text).cast("long"))), "pieces")
    fields = ["source_id", "chunk_no", "text", "start", "end", "segment_indices", "token_count"]
    parts = pieces.filter("NOT whole").groupBy("source_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("cell", "text", "start", "end", "segment_indices"))).alias("p"))
    parts = parts.select("source_id", "chunk_no", *of(F.col("p")), F.flatten(F.transform("p", lambda x: x["segment_indices"])).alias("segment_indices")).withColumn("token_count", counter(whole_text).cast("long"))
    out = pieces.filter("whole").select(*fields).unionByName(parts).withColumn("text", whole_text)
    return out.select("source_id", "chunk_no", chunk_id("chunk", F.col("chunk_no")).alias("chunk_id"), "text", "start", "end", "token_count", "segment_indices")


def chunk_id(prefix: str, no: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(no.cast("string"), 4, "0"))


def chunk_tokens(seg: DataFrame, max_tokens: int = 800, overlap: int = 50, counter: Callable[[Column], Column] = X.token_count) -> DataFrame:
    """Chunks of at most ``max_tokens`` (a longer segment stands alone); each starts with the last segments of the one before, up to ``overlap`` tokens."""
    return _chunks(seg, max_tokens, overlap, counter, False)


def chunk_sentences(seg: DataFrame, max_tokens: int = 800, overlap: int = 50, counter: Callable[[Column], Column] = X.token_count) -> DataFrame:
    """Chunks that, on overflow, are cut behind the last segment that ends a sentence.

    Only sentence ends behind the part carried over from the chunk before count; where there is none, the cut is in front of
    the segment that overflows.  The next chunk starts with the last segments of the cut part, up to ``overlap`` tokens.
    """
    return _chunks(seg, max_tokens, overlap, counter, True)


def merge_small(chunks: DataFrame, min_tokens: int = 100) -> DataFrame:
    """A chunk with fewer than ``min_tokens`` joins the group before it; a first group that stays short joins the second.  Tokens add up."""
    w = W.Window.partitionBy("source_id").orderBy("chunk_no")
    opens = (F.col("token_count") >= min_tokens) | (F.row_number().over(w) == 1)
    rows = chunks.withColumn("g", F.sum(opens.cast("int")).over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    first = F.sum(F.when(F.col("g") == 1, F.col("token_count"))).over(W.Window.partitionBy("source_id"))
    rows = rows.withColumn("g", F.when((first < min_tokens) & (F.col("g") > 1), F.col("g") - 1).otherwise(F.col("g")) - 1)
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "text", "segment_indices")))
    out = rows.groupBy("source_id", F.col("g").cast("int").alias("chunk_no")).agg(parts.alias("p"), F.min_by("start", "chunk_no").alias("start"), F.max_by("end", "chunk_no").alias("end"), F.sum("token_count").alias("token_count"))
    return out.select("source_id", "chunk_no", chunk_id("chunk", F.col("chunk_no")).alias("chunk_id"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), "start", "end", "token_count", F.flatten(F.transform("p", lambda x: x["segment_indices"])).alias("segment_indices"))


def chunk_hybrid(seg: DataFrame, max_tokens: int = 800, overlap: int = 50, min_tokens: int = 100, counter: Callable[[Column], Column] = X.token_count) -> DataFrame:
    return merge_small(chunk_sentences(seg, max_tokens, overlap, counter), min_tokens)


def overlap_suffix(seg: DataFrame, overlap: int = 50, counter: Callable[[Column], Column] = X.token_count) -> DataFrame:
    """Of each source, the longest run of last segments with at most ``overlap`` tokens."""
    back = W.Window.partitionBy("source_id").orderBy(F.col("start").desc(), F.col("seq").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    return seg.withColumn("tail_tokens", F.sum(counter(F.col("text")).cast("long")).over(back)).filter(F.col("tail_tokens") <= overlap)


def token_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.sum("token_count").alias("total_tokens"), F.count("*").alias("n_chunks"))
