"""What several operators need: the shared scratch folder, word sizes, held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a new temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chronotext-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def free(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as keep it apart from the columns ``taken``, whose case does not count."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def few(df: DataFrame, most: int, otherwise: str = "shuffle_hash") -> DataFrame:
    """``df``, which is written and so cheap to count, to be broadcast in a join if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df.hint(otherwise)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, and lost executors cost no recomputation.

    All that one application writes lies in one folder, which can go when the application ends.
    """
    path = f"{scratch(df.sparkSession)}/chronotext-{df.sparkSession.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty.  Each word, with the white space behind it, becomes one letter, so no list of words is made."""
    plain = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(plain, WORD + r"[\x20\x09-\x0D]*", "x")).cast("long")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, seed: int = 11, most_bytes: int | None = None) -> DataFrame:
    """At most ``limit`` rows (doc_id, text, label) of labelled documents for which ``train`` holds, of at most ``most_bytes`` of texts in all.

    The rows with the smallest hashes of their id are taken, so reruns agree.  Label rows are thinned by hash before they
    are sorted, so no task sorts more than about ``limit`` rows; the sample, bounded by ``limit``, is what gets broadcast.
    """
    rows = labels.filter(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)))
    share = min(1.0, 1.2 * limit / max(1, rows.count()))
    rows = rows.filter(F.col("h") <= int(share * (1 << 40))).orderBy("h", "doc_id").limit(limit).select("doc_id", "label", "h")
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    if most_bytes is not None:
        # One number for each sampled id comes to the driver.  What does not fit is left out, and the rest goes on.
        room, over = most_bytes, []
        for h, n in sorted((h, n or 0) for h, n in found.groupBy("h").agg(F.sum(F.octet_length("text"))).collect()):
            if n <= room:
                room -= n
            else:
                over.append((h,))
        if over:
            found = found.join(F.broadcast(docs.sparkSession.createDataFrame(over, "h long")), "h", "left_anti")
    return found.select("doc_id", "text", "label")
