"""Exact dedup by content sort.

Sampled splitters deal the rows out by the first bytes of the text, then by a hash of all of it, then by id; each
partition is sorted externally, so equal texts stand side by side, and neighbours are compared in full.  As ids take part
in the splitters, a text that makes up a third of all rows is split over many partitions like any other rows; the few runs
that touch the edge of a partition are then matched across partitions by their full texts (at most two blocks of each
partition).  Only 32 bytes, a hash and an id of each sampled row reach the driver for the splitters.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.llm.shared import written

PREFIX = 32


#: Ids of a run that are held; those of longer runs leave at once and are joined with the run's outcome afterwards.
HELD = 4096


class Run:
    """Neighbours with one text: how many, the ids not yet sent on, the last id, and where the last row lies."""

    __slots__ = ("ids", "last", "long", "n", "no", "text", "top")

    def __init__(self, no, text):
        self.no, self.text, self.ids, self.n, self.last, self.top, self.long = no, text, [], 0, None, None, False


def blocks(batches, spill=None):
    """(runs, at the edge) of a sorted partition, block by block; a block is the rows that splitters can't tell apart but by id.

    ``spill`` (run, ids) is called with the ids of a run whenever HELD of them have come together; without it only the last
    id is kept, so a run of any length takes no more room than one row.
    """
    block, key, edge, no = [], None, True, 0
    for batch in batches:
        hashes = batch.column("_h").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for i, (h, text, doc) in enumerate(zip(hashes, texts, batch.column("_id").to_pylist(), strict=True)):
            text = text or b""
            if block and key != (h, text[:PREFIX]):
                yield block, edge
                block, edge = [], False
            key = (h, text[:PREFIX])
            if not block or block[-1].text != text:
                block.append(Run(no, text))
                no += 1
            run = block[-1]
            if spill is not None:
                if len(run.ids) == HELD:
                    spill(run, run.ids)
                    run.ids, run.long = [], True
                run.ids.append(doc)
            run.n, run.top, run.last = run.n + 1, doc, (batch, i)
    if block:
        yield block, True


GROUPS = "_id long, keep_id long, group_size long, text_sha256 string, last boolean, edge boolean, long boolean, pid int, run int, edge_text binary"


def groups(batches):
    """A row for each row: its run's largest id, size and digest; runs at an edge are marked, and their last row carries the text.

    Of a long run only the last row has the run's largest id, size and digest, and edge is told by that row alone.
    """
    pid, out = TaskContext.get().partitionId(), []

    def spill(run, ids):
        out.extend((doc, None, None, None, False, False, True, pid, run.no, None) for doc in ids)

    for runs, edge in blocks(batches, spill):
        for r in runs:
            sha = hashlib.sha256(r.text).hexdigest()
            if r.long:
                spill(r, r.ids[:-1])
            held = r.ids[-1:] if r.long else r.ids
            for i, doc in enumerate(held, 1):
                last = i == len(held)
                out.append((doc, r.top, r.n, sha, last, edge, r.long, pid, r.no, r.text if edge and last else None))
        for k in range(0, len(out) if len(out) > 5000 else 0, 20_000):
            yield _batch(out[k : k + 20_000])
        if len(out) > 5000:
            out.clear()
    if out:
        yield _batch(out)


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in GROUPS.split(",")])


def sorted_by_content(docs: DataFrame) -> DataFrame:
    """(row, text, _id, _h) of ``docs``, dealt out by sampled splitters and sorted by content within partitions; null texts count as empty.

    row holds all columns but the text, so their names clash with nothing.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    prefix = F.substring(text.cast("binary"), 1, PREFIX)
    rows = docs.select(F.struct(*rest).alias("row"), "text", F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_h"))
    return rows.repartitionByRange(prefix, "_h", "_id").sortWithinPartitions(prefix, "_h", text, "_id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``.

    Texts are equal when identical; null counts as empty.  The row with the largest doc_id stays; of rows that repeat both
    text and id, one.  Rows without an id come first, so one of them stays only where no row of the group has an id.
    Columns other than doc_id and text are not looked at; an empty table gives an empty result.
    """
    rows = written(sorted_by_content(docs.select("doc_id", "text")).select("_id", "text", "_h").mapInArrow(groups, GROUPS), "runs")
    whole = rows.filter("group_size IS NOT NULL")
    ends = whole.filter("edge AND last").groupBy("edge_text").agg(F.max(F.struct("keep_id", "pid", "run")).alias("best"), F.sum("group_size").alias("n"), F.collect_list(F.struct("pid", "run")).alias("runs"))
    ends = ends.select(F.inline("runs"), "best", "n")
    told = ["_id", "keep_id", "group_size", "kept", "text_sha256", "long", "pid", "run"]
    inner = whole.filter("NOT edge").withColumn("kept", F.col("last")).select(*told)
    # Runs at an edge: two blocks of each partition, so their number is bounded by that of the partitions.
    outer = whole.filter("edge").drop("keep_id", "group_size", "edge_text").join(F.broadcast(ends), ["pid", "run"])
    outer = outer.withColumns({"keep_id": F.col("best.keep_id"), "group_size": F.col("n"), "kept": F.col("last") & (F.col("best.pid") == F.col("pid")) & (F.col("best.run") == F.col("run"))}).select(*told)
    known = inner.unionByName(outer)
    # A text that repeats very often lies in many partitions, in each as a run of its own.
    rest = rows.filter("group_size IS NULL").select("_id", "pid", "run").join(known.filter("long").drop("_id", "kept").hint("shuffle_merge"), ["pid", "run"])
    return known.unionByName(rest.withColumn("kept", F.lit(False)).select(*told)).select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of equal texts as in :func:`exact_groups`.

    Each partition drops its own copies at once; only runs at an edge are grouped again.
    """
    rows = sorted_by_content(docs)
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([fields["row"], fields["text"], T.StructField("edge", T.BooleanType()), T.StructField("at", T.LongType()), T.StructField("tie", T.IntegerType())])

    def survivors(batches):
        pid = TaskContext.get().partitionId()

        def rows_of(batch, at, marks):
            part = batch.take(pa.array(at, pa.int32()))
            more = [pa.array([m[0] for m in marks], pa.bool_()), pa.array([m[1] for m in marks], pa.int64()), pa.array([pid] * len(at), pa.int32())]
            return pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *more], names=["row", "text", "edge", "at", "tie"])

        now, at, marks = None, [], []
        for runs, edge in blocks(batches):
            for r in runs:
                batch, i = r.last
                if batch is not now and at:
                    yield rows_of(now, at, marks)
                    at, marks = [], []
                now = batch
                at.append(i)
                marks.append((edge, r.top))
        if at:
            yield rows_of(now, at, marks)

    found = written(rows.mapInArrow(survivors, schema), "survivors")
    inner = found.filter("NOT edge").select("row", "text")
    outer = found.filter("edge").groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.max_by(F.struct("row", "text"), F.struct("at", "tie")).alias("r")).select("r.row", "r.text")
    return inner.unionByName(outer).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
