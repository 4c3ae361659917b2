"""Choosing which timed observations of a source to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.operators import timejoin
from chronotext.operators.fold import ordered_fold


def by_interval(obs: DataFrame, interval: float = 30.0) -> DataFrame:
    """The first observation of each interval."""
    cell = F.floor(F.col("ts") / interval).cast("long")
    fields = [c for c in obs.columns if c != "source_id"]
    return obs.groupBy("source_id", cell.alias("bucket")).agg(F.min_by(F.struct(*fields), F.struct("ts", "frame_id")).alias("o")).select("source_id", *(f"o.{c}" for c in fields))


def by_change(obs: DataFrame, threshold: float = 0.2, interval: float = 30.0) -> DataFrame:
    """Observations that change by more than ``threshold``; sources without any are sampled by interval."""
    changed = obs.filter(F.col("scene_diff") > threshold)
    without = obs.join(changed.select("source_id").distinct(), "source_id", "left_anti")
    return changed.unionByName(by_interval(without, interval))


def at_points(obs: DataFrame, points: DataFrame, at: str = "t") -> DataFrame:
    """The observation nearest to each point of its source."""
    return timejoin.nearest_any(points, obs, at).filter("near IS NOT NULL")


def transition_points(chunks: DataFrame) -> DataFrame:
    """Distinct times (source_id, t): each chunk's start and midpoint, and five seconds before its end if it is longer than 15."""
    late = F.when(F.col("end") - F.col("start") > 15, F.col("end") - 5)
    return chunks.select("source_id", F.explode(F.array("start", (F.col("start") + F.col("end")) / 2, late)).alias("t")).filter("t IS NOT NULL").distinct()


#: Seconds of a cell are so many gaps.
CELL = 64.0


def islands(obs: DataFrame, gap: float) -> DataFrame:
    """``obs`` with cell, no (its number in the cell) and island: the time at which a run of observations less than ``gap`` apart began.

    Numbers and neighbours are found inside time cells; between cells pass one row each, the last time and the last
    beginning of a run, so no task reads all of a source.  Null times stand together in a cell and a run of their own.
    """
    fields = [c for c in obs.columns if c not in ("source_id", "ts", "frame_id")]
    width, far = max(gap, 1e-9) * CELL, 1e11
    cell = F.floor(F.greatest(F.lit(-far), F.least(F.lit(far), F.col("ts").cast("double"))) / width).cast("long")
    w = W.Window.partitionBy("source_id", "cell").orderBy("ts", "frame_id", *fields)
    rows = obs.withColumn("cell", F.when(F.col("ts").isNotNull(), cell).otherwise(-(1 << 60))).withColumn("no", F.row_number().over(w)).withColumn("_prev", F.lag("ts").over(w))
    # Cells are longer than the gap, so a run goes on from the cell just before or not at all.
    before = rows.groupBy("source_id", (F.col("cell") + 1).alias("cell")).agg(F.max("ts").alias("_before"))
    rows = rows.join(before.hint("shuffle_merge"), ["source_id", "cell"], "left")
    last = F.coalesce("_prev", "_before")
    rows = rows.withColumn("_new", F.when(last.isNull() | (F.col("ts") - last >= gap), F.col("ts")))
    began = rows.groupBy("source_id", "cell").agg(F.max("_new").alias("_began"))
    carried = began.select("source_id", "cell", F.last("_began", True).over(W.Window.partitionBy("source_id").orderBy("cell").rowsBetween(W.Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.max("_new").over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    rows = rows.join(carried.hint("shuffle_merge"), ["source_id", "cell"], "left")
    return rows.withColumn("island", F.coalesce(here, "_carried")).drop("_prev", "_before", "_new", "_carried")


def dedup_near(obs: DataFrame, gap: float = 3.0) -> DataFrame:
    """Of observations closer than ``gap`` to the last one kept, the larger stays, and becomes the one to measure from.

    What is kept depends on what was kept before, but never across a pause of ``gap``: so each run between pauses is folded
    apart, in time order, with the last one kept as state.  Rows that agree in time, id and size are alike: one stands for
    all of them.
    """
    fields = [c for c in obs.columns if c not in ("source_id", "ts", "frame_id")]

    def step():
        last = None

        def add(cell, no, ts, size):
            nonlocal last
            size = size or 0.0
            if last is None or ts is None or last[2] is None or ts - last[2] >= gap:
                yield from () if last is None else (last[:2],)
                last = (cell, no, ts, size)
            elif size > last[3]:
                last = (cell, no, ts, size)

        return add, lambda: [] if last is None else [last[:2]]

    rows = islands(obs, gap)
    slim = rows.select("source_id", "island", "cell", F.col("no").cast("bigint").alias("no"), F.col("ts").cast("double").alias("ts"), F.col("size").cast("double").alias("size"))
    kept = ordered_fold(slim, ["cell", "no"], step, "cell bigint, no bigint", ("island",))
    return rows.join(kept.hint("shuffle_merge"), ["source_id", "cell", "no"], "left_semi").select("source_id", "ts", "frame_id", *fields)


def content_score(obs: DataFrame) -> DataFrame:
    """``obs`` with content_score, the size as a share of the source's largest, at most 1."""
    most = F.max("size").over(W.Window.partitionBy("source_id"))
    return obs.withColumn("content_score", F.when(most > 0, F.least(F.lit(1.0), F.col("size") / most)).otherwise(0.0))


def top_k(obs: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` observations of each source with the highest content_score, in time order and numbered; ties go to the earlier."""
    best = W.Window.partitionBy("source_id").orderBy(F.col("content_score").desc(), "ts", "frame_id")
    line = W.Window.partitionBy("source_id").orderBy("ts", "frame_id")
    return obs.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank").withColumn("frame_no", F.row_number().over(line) - 1)


def add_transitions(primary: DataFrame, obs: DataFrame, chunks: DataFrame, gap: float = 3.0) -> DataFrame:
    """``primary`` and, for transition times without a primary observation closer than ``gap``, the nearest of all; as a bag."""
    times = timejoin.anti_near(transition_points(chunks), primary, gap)
    extra = at_points(obs, times).select("source_id", *(f"near.{c}" for c in obs.columns if c != "source_id"))
    return primary.unionByName(extra)


def observe(obs: DataFrame, chunks: DataFrame, mode: str = "change", threshold: float = 0.2, interval: float = 30.0, gap: float = 3.0, k: int = 30) -> DataFrame:
    """The whole sampling: primary observations by ``mode``, transition times, proximity dedup, content score, top k."""
    if mode not in ("interval", "change", "aligned"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "aligned":
        points = chunks.select("source_id", ((F.col("start") + F.col("end")) / 2).alias("t"))
        primary = at_points(obs, points).select("source_id", *(f"near.{c}" for c in obs.columns if c != "source_id"))
    else:
        primary = by_interval(obs, interval) if mode == "interval" else by_change(obs, threshold, interval)
    return top_k(content_score(dedup_near(add_transitions(primary, obs, chunks, gap), gap)), k)


def effective(own: DataFrame, below: DataFrame, key: list[str]) -> DataFrame:
    """Observations of sections: their own, and those of their subsections where they have fewer than two; of the same path and tenth of a second the first stays.

    Both sides have ``key``, path and ts; ``below`` has those of the subsections under their parent's key.
    """
    n = F.count("*").over(W.Window.partitionBy(*key))
    few = own.withColumn("_n", n)
    lone = below.join(few.filter("_n >= 2").select(*key).distinct(), key, "left_anti")
    rows = own.withColumn("_p", F.lit(0)).unionByName(lone.withColumn("_p", F.lit(1)))
    first = W.Window.partitionBy(*key, "path", F.round(F.col("ts") * 10)).orderBy("_p", "ts", "frame_id")
    return rows.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_p")
