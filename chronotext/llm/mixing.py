"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the mix in words.  Complete epochs come first: a source whose target is 1.3 times its
size gives every document once.  The rest is drawn without replacement: each document gets the key -ln(u) / w (u uniform
from a hash of its id and text, w its quality weight), and the documents with the smallest keys are taken until the next one would
overrun the budget; one document that fits what is missing completes it.

No task ever sorts a source.  Keys fall into bins by their order of magnitude, so that no bin holds more than about 1 in
4,000 of a source, whatever the weights; words are summed per (source, bin); only the bin in which a source's budget runs
out is sorted, and what comes out is one row per source: complete epochs, the last key taken and the document that fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronotext.llm.shared import few, word_count, written

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: The mix in words, as a share of all words.
SHARE = 1.5
#: A target is at most so many times its source's size.
MOST = 2.0
#: Bins of a source's keys for each power of two.
BINS = 1024
#: Above so many sources, the per-source rows are joined by a shuffle instead of a broadcast.
SOURCES_TO_BROADCAST = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with its weight and target.

    Targets share ``share`` of all words by weight; a target stops at ``most`` times its source's size, and what is cut off
    is shared again by weight.  The result of that repetition has a closed form: sources are capped in the order of
    cap / weight, up to the first whose share of what is left, L times its weight, fits.  One row per source is handled.
    """
    order = W.Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = W.Window.partitionBy()
    before = W.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size")).over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))
    level = F.min(fits).over(every)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def quality_weight(score: Column) -> Column:
    """A document's weight from its quality score (0 to 1, null: least), at least 0.05, so that no document is out of reach."""
    return F.greatest(F.lit(0.05), F.coalesce(score.cast("double"), F.lit(0.0)))


def keyed(docs: DataFrame, columns: list[str], seed: int, weight: Column | None) -> DataFrame:
    """``docs`` as (row, doc_id, s, size, es_key, bin), row holding ``columns``; this is the only look at the texts.

    s is the source, told apart from a null one; size counts words (a null text has none); es_key is the sampling key, and
    bin says in which 1,024th of which power of two it lies.  Ties go by doc_id, null ids first.  The hash is of id, crc32
    of the text and size, so rows that share an id, or have none, are drawn apart unless their texts agree too.
    """
    size = word_count(F.col("text"))
    u = (F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), size, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(u) / (F.lit(1.0) if weight is None else weight)
    s = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    row = F.struct(*columns) if columns else F.struct(F.lit(None).alias("_"))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), s.alias("s"), size.alias("size"), key.alias("es_key"))
    return rows.withColumn("bin", F.floor(F.log2("es_key") * BINS).cast("int"))


def _joined(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source, of which there is one row each in ``source``, a written table."""
    return rows.join(few(source, SOURCES_TO_BROADCAST, "shuffle_merge"), "s")


def cuts(rows: DataFrame, **how) -> DataFrame:
    """One row per source: source_size, target, the complete ``epochs`` and what the part epoch takes.

    That is all rows up to the key (edge_bin, cut_key, cut_id), and then one document more, fill_key and fill_id: of those
    left, the one whose size is nearest to what is still missing, if it comes nearer to the target than leaving it.  Rows
    that repeat in id and text have one key, and stand or fall together.  ``rows`` is a written table of :func:`keyed`.
    """
    rows = rows.drop("row")
    bins = written(rows.groupBy("s", "bin").agg(F.sum("size").alias("words")), "bins")
    sizes = bins.groupBy("s").agg(F.sum("words").alias("source_size"))
    named = sizes.select(F.when(~F.col("s.none"), F.col("s.name")).alias("source"), "source_size")
    source = targets(named, **how).withColumn("s", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    source = source.withColumn("epochs", F.floor(ratio).cast("int")).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    source = written(source.select("s", "source_size", "target", "epochs", "budget"), "targets")
    upto = W.Window.partitionBy("s").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, 0)
    at = _joined(bins.withColumn("upto", F.sum("words").over(upto)), source)
    edge = at.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
    edge = written(edge.select("s", F.col("bin").alias("edge_bin"), (F.col("budget") - F.col("upto") + F.col("words")).alias("room")), "edges")
    inside = _joined(rows, edge).filter("bin = edge_bin").groupBy("s", "room", "es_key", "doc_id").agg(F.sum("size").alias("size"))
    # The frame takes equal rows together; one bin holds about 1 in 4,000 rows of a source at most, whatever the weights.
    inside = inside.withColumn("sum", F.sum("size").over(W.Window.partitionBy("s").orderBy("es_key", "doc_id"))).filter("sum <= room")
    last = inside.groupBy("s").agg(F.max(F.struct("es_key", "doc_id")).alias("last"), F.max("sum").alias("sum"))
    part = written(edge.join(last.hint("shuffle_merge"), "s", "left").select("s", "edge_bin", F.col("last.es_key").alias("cut_key"), F.col("last.doc_id").alias("cut_id"), (F.col("room") - F.coalesce("sum", F.lit(0))).alias("missing")), "parts")
    rest = _joined(rows.filter("size > 0"), part).filter((F.col("missing") > 0) & ~_before()).groupBy("s", "missing", "es_key", "doc_id").agg(F.sum("size").alias("size"))
    off = F.abs(F.col("size") - F.col("missing"))
    fill = rest.filter(off < F.col("missing")).groupBy("s").agg(F.min(F.struct(off, "es_key", "doc_id")).alias("fill"))
    out = source.join(part.hint("shuffle_merge"), "s", "left").join(fill.hint("shuffle_merge"), "s", "left")
    return written(out.select("s", "source_size", "target", "epochs", (F.col("budget") > 0).alias("more"), "edge_bin", "cut_key", "cut_id", F.col("fill.es_key").alias("fill_key"), F.col("fill.doc_id").alias("fill_id")), "cuts")


def _before() -> Column:
    """Whether a row stands before its source's cut, or at it.  Null ids come first."""
    same = F.col("es_key") == F.col("cut_key")
    inside = (F.col("es_key") < F.col("cut_key")) | (same & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("cut_id"), F.lit(False))))
    return F.coalesce((F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & inside), F.lit(False))


def _mix(docs: DataFrame, columns: list[str], seed: int, weight: Column | None, how: dict) -> DataFrame:
    rows = written(keyed(docs, columns, seed, weight), "keys")
    filled = F.col("es_key").eqNullSafe(F.col("fill_key")) & F.col("doc_id").eqNullSafe(F.col("fill_id"))
    part = F.when(F.col("more") & (_before() | filled), 1).otherwise(0)
    return _joined(rows, cuts(rows, **how)).withColumn("times", F.col("epochs") + part)


def mix(docs: DataFrame, seed: int = 5, weight: Column | None = None, keep: list[str] | None = None, **how) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all if not given) with size, source_size, target and ``times``, how often the mix takes the row (0 included).

    ``weight`` is a column of ``docs`` (1 if not given), see :func:`quality_weight`.  Null texts have no words, a null source
    is a source of its own, an empty table gives an empty result.  Columns of ``docs`` named like the four results are
    replaced; any other name may occur, as the steps between keep the row apart from their own columns.
    """
    made = ("size", "source_size", "target", "times")
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    return _mix(docs, columns, seed, weight, how).select(*(F.col("row")[c].alias(c) for c in columns), *made)


def mixed(docs: DataFrame, seed: int = 5, weight: Column | None = None, keep: list[str] | None = None, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the columns ``keep`` (all if not given), whatever their names."""
    columns = docs.columns if keep is None else keep
    rows = _mix(docs, columns, seed, weight, how).filter("times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*(F.col("row")[c].alias(c) for c in columns))
