"""Joins of timed rows: nearest, within, overlapping, containing, proximity anti and semi joins, all inside a source.

With a finite reach both sides are cut into time cells, so each row meets only rows of its own and the neighbouring cells;
a source with very many observations is thereby spread over tasks instead of filling one.  Intervals of any length meet in
cells of their own order of magnitude (:func:`spans`), so neither long nor short ones are copied into many cells.  Without a
reach, the nearest observation comes from windows over the merged time line, which needs one sort and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.operators import tree


def _cell(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(float(width))).cast("long")


def reach(left: DataFrame, right: DataFrame, lo: Column, hi: Column, ts: str, width: float) -> DataFrame:
    """Rows of ``left`` and ``right`` of one source with lo <= right.ts <= hi; ``lo`` and ``hi`` are columns of ``left``.

    Columns of ``right`` other than source_id must not clash with those of ``left``.
    """
    a = left.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
    a = a.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_lo"), width), _cell(F.col("_hi"), width))))
    b = right.withColumnRenamed("source_id", "_sid").withColumn("_c", _cell(F.col(ts), width))
    on = (F.col("source_id") == F.col("_sid")) & (F.col("_cell") == F.col("_c")) & (F.col(ts) >= F.col("_lo")) & (F.col(ts) <= F.col("_hi"))
    # Exploded rows have no reliable size estimate, so the strategy is set here.
    return a.join(b.hint("shuffle_hash"), on).drop("_lo", "_hi", "_cell", "_sid", "_c")


#: Cells of intervals are STEP ** level seconds wide, on levels 0 to LEVELS; times beyond FAR seconds count as FAR.
STEP, LEVELS, FAR = 16, 6, 1e11


def _placed(df: DataFrame, lo: Column, hi: Column, p: str, on) -> DataFrame:
    """``df`` once per cell that lo..hi touches on its own level, the lowest whose cells are as long, or on each of ``on(own)``.

    On its own level and above an interval touches at most two cells, but for those longer than the widest cell.  Bounds in
    the wrong order are swapped; NaN counts as the far end; rows without a bound touch nothing.
    """
    near = lambda c: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c.cast("double")))
    out = df.filter(lo.isNotNull() & hi.isNotNull()).withColumn("_a", near(F.least(lo, hi))).withColumn("_b", near(F.greatest(lo, hi)))
    own = _level(F.col("_a"), F.col("_b"))
    out = out.withColumn("_level", own if on is None else F.explode(on(own)))
    width = F.get(F.array(*(F.lit(float(STEP**k)) for k in range(LEVELS + 1))), F.col("_level"))
    out = out.withColumn(p, F.floor(F.col("_a") / width).cast("long"))
    return out.withColumn("_cell", F.explode(F.sequence(F.col(p), F.floor(F.col("_b") / width).cast("long")))).drop("_a", "_b")


def _level(a: Column, b: Column) -> Column:
    return sum(((b - a > float(STEP**k)).cast("int") for k in range(LEVELS)), F.lit(0))


def levels(df: DataFrame, lo: str, hi: str) -> list[int]:
    """The levels on which intervals of ``df`` lie: at most LEVELS + 1 numbers, worth a job of its own where ``df`` is written out."""
    near = lambda c: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col(c).cast("double")))
    rows = df.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(near(lo).alias("a"), near(hi).alias("b"))
    return sorted(r[0] for r in rows.select(_level(F.least("a", "b"), F.greatest("a", "b"))).distinct().collect())


def spans(left: DataFrame, right: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column], used: list[int] | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` of one source whose closed intervals ``a`` and ``b`` come near each other, each pair once.

    All pairs that touch are among them; callers filter for the exact relation.  A pair meets on the level of its longer
    interval, in the first cell that both touch there.  A point is an interval with equal bounds.  Columns other than
    source_id must not clash.  ``used`` are the :func:`levels` of the right side, where they are known: only there do rows
    of the left one have to be looked for.
    """
    every = F.array(*map(F.lit, range(LEVELS + 1) if used is None else used)).cast("array<int>")
    from_own = lambda own: F.filter(every, lambda k: k >= own)
    above = lambda own: F.slice(F.sequence(own, F.lit(LEVELS)), 2, LEVELS + 1)
    met = lambda x, y: x.join(y.hint("shuffle_merge"), ["source_id", "_level", "_cell"]).filter(F.col("_cell") == F.greatest("_fa", "_fb")).drop("_level", "_cell", "_fa", "_fb")
    short_left = met(_placed(left, *a, "_fa", from_own), _placed(right, *b, "_fb", None))
    if a[0] is a[1]:  # points are never the longer ones
        return short_left
    return short_left.unionByName(met(_placed(left, *a, "_fa", None), _placed(right, *b, "_fb", above)))


def nearest(points: DataFrame, obs: DataFrame, at: str, key: list[str], tol: float) -> DataFrame:
    """Each point with the observation nearest to ``at`` within ``tol`` (inclusive) as the struct ``near``; null where there is none.

    Ties go to the earlier observation, then to the smaller frame_id.
    """
    found = reach(points.select("source_id", *key, at), obs.select("source_id", F.struct(*[c for c in obs.columns if c != "source_id"]).alias("near"), F.col("ts").alias("_ts")), F.col(at) - tol, F.col(at) + tol, "_ts", max(tol, 1e-9) * 2)
    best = found.groupBy("source_id", *key).agg(F.min_by("near", F.struct(F.abs(F.col("_ts") - F.col(at)), "_ts", "near.frame_id")).alias("near"))
    return points.join(best.hint("shuffle_merge"), ["source_id", *key], "left")


def nearest_any(points: DataFrame, obs: DataFrame, at: str, id_col: str = "frame_id", ts: str = "ts", same: float = 0.0) -> DataFrame:
    """Like :func:`nearest` without a limit, by windows over the merged time line; sources without observations give null.

    Distances that differ by at most ``same`` are a tie.
    """
    fields = [c for c in obs.columns if c != "source_id"]
    one = obs.groupBy("source_id", ts).agg(F.min_by(F.struct(*fields), id_col).alias("near"))
    kind = one.schema["near"].dataType
    a = points.select("source_id", F.col(at).alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(kind).alias("near"), F.struct(*points.columns).alias("_point"))
    b = one.select("source_id", F.col(ts).alias("_t"), F.lit(0).alias("_tag"), "near", F.lit(None).cast(a.schema["_point"].dataType).alias("_point"))
    line = a.unionByName(b)
    past = F.last("near", True).over(W.Window.partitionBy("source_id").orderBy("_t", "_tag").rowsBetween(W.Window.unboundedPreceding, 0))
    coming = F.last("near", True).over(W.Window.partitionBy("source_id").orderBy(F.col("_t").desc(), F.col("_tag").desc()).rowsBetween(W.Window.unboundedPreceding, 0))
    rows = line.withColumn("_a", past).withColumn("_b", coming).filter("_tag = 1")
    closer = F.when(F.col("_b").isNull() | ((F.col("_t") - F.col(f"_a.{ts}")) - (F.col(f"_b.{ts}") - F.col("_t")) <= same), F.col("_a")).otherwise(F.col("_b"))
    return rows.select("_point.*", F.when(F.col("_a").isNull(), F.col("_b")).otherwise(closer).alias("near"))


def within(left: DataFrame, obs: DataFrame, pad: float = 3.0, width: float = 30.0) -> DataFrame:
    """Rows of ``left`` (start, end) with the observations from ``pad`` before to ``pad`` after them, both inclusive."""
    return reach(left, obs, F.col("start") - pad, F.col("end") + pad, "ts", width)


def overlap(seg: DataFrame, sec: DataFrame, used: list[int] | None = None) -> DataFrame:
    """Segments and sections of a source that share time (touching is not enough); ``sec`` has sec_start and sec_end, on the levels ``used``."""
    met = spans(seg, sec, (F.col("start"), F.col("end")), (F.col("sec_start"), F.col("sec_end")), used)
    return met.filter((F.col("end") > F.col("sec_start")) & (F.col("start") < F.col("sec_end")))


def contained(seg: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments with the block (block_start, block_end) in which they start; a block that ends with the transcript includes its end."""
    last = seg.groupBy("source_id").agg(F.max_by("end", "seq").alias("_last"))
    at = F.col("start")
    rows = spans(seg, blocks.join(last.hint("shuffle_merge"), "source_id"), (at, at), (F.col("block_start"), F.col("block_end")), levels(blocks, "block_start", "block_end"))
    closed = (F.col("block_end") == F.col("_last")) & (at <= F.col("block_end"))
    return rows.filter((at >= F.col("block_start")) & ((at < F.col("block_end")) | closed)).drop("_last")


def anti_near(times: DataFrame, obs: DataFrame, tol: float = 3.0) -> DataFrame:
    """Rows of ``times`` (t) without an observation strictly closer than ``tol``."""
    near = F.abs(F.col("_ts") - F.col("t")) < tol
    return reach_keep(times, obs.select("source_id", F.col("ts").alias("_ts")), tol, near, "left_anti")


def reach_keep(times: DataFrame, obs: DataFrame, tol: float, near: Column, kind: str) -> DataFrame:
    """Semi or anti join by proximity: observations are copied to their own and both neighbouring cells, so each time meets them in its own."""
    b = obs.withColumn("_c", F.explode(F.sequence(_cell(F.col("_ts") - tol, tol), _cell(F.col("_ts") + tol, tol)))).withColumnRenamed("source_id", "_sid")
    a = times.withColumn("_cell", _cell(F.col("t"), tol))
    return a.join(b.hint("shuffle_hash"), (F.col("source_id") == F.col("_sid")) & (F.col("_cell") == F.col("_c")) & near, kind).drop("_cell")


def active_section(pos: DataFrame, sections: DataFrame, key: list[str]) -> DataFrame:
    """Each position (source_id, t) with the section that is open then, as deep as there is one: the first open one of each level, inside that of the level above.

    ``sections`` has section_id, parent_id, ord, sec_start and sec_end, of any depth; no open section gives null.
    """
    of = tree.paths(sections, "sec_start", "sec_end").select("source_id", "section_id", "path", "open_from", "open_to").filter("open_from < open_to")
    t = F.col("t")
    open_then = spans(pos.select("source_id", *key, "t"), of, (t, t), (F.col("open_from"), F.col("open_to")), levels(of, "open_from", "open_to")).filter((F.col("open_from") <= t) & (t < F.col("open_to")))
    # Behind the sections below it, before those of the next: the smallest is the deepest of the first ones.
    order = F.array_append("path", F.struct(F.lit((1 << 63) - 1).alias("ord"), F.lit("").alias("id")))
    hit = open_then.groupBy("source_id", *key).agg(F.min_by("section_id", order).alias("section_id"))
    return pos.join(hit.hint("shuffle_merge"), ["source_id", *key], "left")


def active_line(pos: DataFrame, seg: DataFrame, key: list[str], pad: float = 0.12, near: float = 1.5) -> DataFrame:
    """Each position with the transcript line shown then: the last one open (``pad`` on either side), else the one with the nearest midpoint within ``near``."""
    t, mid = F.col("t"), (F.col("start") + F.col("end")) / 2
    # A position meets a line that is open or whose midpoint is near.
    of = seg.select("source_id", "seq", "start", "end", F.least(F.col("start") - pad, mid - near).alias("_lo"), F.greatest(F.col("end") + pad, mid + near).alias("_hi"))
    rows = spans(pos.select("source_id", *key, "t"), of, (t, t), (F.col("_lo"), F.col("_hi")), levels(of, "_lo", "_hi"))
    far = F.abs(t - mid)
    is_open = (F.col("start") - pad <= F.col("t")) & (F.col("t") < F.col("end") + pad)
    best = rows.groupBy("source_id", *key).agg(F.max(F.when(is_open, F.col("seq"))).alias("_open"), F.min(F.when(far <= near, F.struct(far.alias("d"), "seq"))).alias("_near"))
    return pos.join(best.hint("shuffle_merge"), ["source_id", *key], "left").withColumn("line_seq", F.coalesce("_open", "_near.seq")).drop("_open", "_near")


def numbered(seg: DataFrame) -> DataFrame:
    """``seg`` with _no, the place of each segment in its source, from 1."""
    return seg.withColumn("_no", F.row_number().over(W.Window.partitionBy("source_id").orderBy("seq")))


def centred(pos: DataFrame, rows: DataFrame, at: str = "t") -> DataFrame:
    """``pos`` with _centre, the number of the segment of ``rows`` (of :func:`numbered`) whose midpoint is closest; the first wins ties.

    Midpoints and positions are no exact decimals, so distances that differ by less than a nanosecond are a tie.
    """
    mid = rows.select("source_id", ((F.col("start") + F.col("end")) / 2).alias("mid"), F.col("_no").alias("no"))
    return nearest_any(pos, mid, at, "no", "mid", 1e-9).filter("near IS NOT NULL").withColumn("_centre", F.col("near.no")).drop("near")


def around(centre: DataFrame, rows: DataFrame, n: int = 3) -> DataFrame:
    """Rows of ``centre`` (source_id, _centre) with the segments of ``rows`` up to ``n`` before and behind."""
    out = centre.withColumn("_no", F.explode(F.sequence(F.col("_centre") - n, F.col("_centre") + n)))
    return out.join(rows.hint("shuffle_hash"), ["source_id", "_no"]).drop("_no")


def beside(centre: DataFrame, rows: DataFrame, fields: list[str], n: int = 3) -> DataFrame:
    """``centre`` (source_id, seq) with ``w``, the ``fields`` of the lines of ``rows`` from ``n`` before to ``n`` behind, in order.

    What is asked for stands among the lines as rows of its own, so lines go to their source once, not to each neighbour.
    """
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in fields]
    line = rows.select("source_id", "seq", F.lit(1).alias("_is"), *fields).unionByName(centre.select("source_id", "seq", F.lit(0).alias("_is"), *none))
    w = W.Window.partitionBy("source_id").orderBy("seq", "_is")
    line = line.withColumn("_asked", F.lag("_is").over(w) == 0).filter("_is = 1")
    at = lambda k: F.lag(F.struct(*fields), -k).over(w)
    out = line.select("source_id", "seq", "_asked", F.array(*map(at, range(-n, n + 1))).alias("w")).filter("_asked")
    return out.select("source_id", "seq", F.filter("w", lambda x: x.isNotNull()).alias("w"))


def neighbours(pos: DataFrame, seg: DataFrame, at: str = "t", n: int = 3) -> DataFrame:
    """Each position with the segments around the one whose midpoint is closest: ``n`` on either side; the first wins ties."""
    rows = numbered(seg)
    return around(centred(pos, rows, at), rows, n).drop("_centre")


def blurb_breaks(seg: DataFrame, obs: DataFrame, slack: float = 1.0) -> DataFrame:
    """Segments with breaks: an observation lies between the segment before and this one, give or take ``slack``."""
    before = F.lag("end").over(W.Window.partitionBy("source_id").orderBy("start", "seq"))
    rows = seg.withColumn("_before", before)
    hit = reach(rows.filter("_before IS NOT NULL").select("source_id", "seq", "start", "_before"), obs.select("source_id", "ts"), F.col("_before") - slack, F.col("start") + slack, "ts", 10.0).select("source_id", "seq").distinct()
    return rows.join(hit.withColumn("_hit", F.lit(True)).hint("shuffle_merge"), ["source_id", "seq"], "left").withColumn("breaks", F.coalesce("_hit", F.lit(False))).drop("_hit", "_before")
