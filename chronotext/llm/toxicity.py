"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on windows of ordinary documents, one on stretches of toxic documents.  A
text is cut into windows of a word, each is compressed with either dictionary, and the bytes that the toxic one saves are the
window's distance.  Windows that save at least a calibrated number of bytes are hits, and a calibrated curve turns a
document's hits and length into a score.

A toxic document is ordinary but for a few words, so a dictionary of all it holds would be another ordinary one.  The toxic
dictionary is therefore trained on the stretches of toxic documents whose words begin (matches of zstandard are stretches of
bytes, whatever follows) like words that clearly more toxic than ordinary documents have.  All counts, windows and thresholds
cover the whole texts of the sampled rows; a part of these is held back from both dictionaries, for the thresholds and the
curve.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.shared import labelled_sample, written

#: Words of a window that is compared, and of one that the ordinary dictionary is trained on.
WINDOW, LEARNT = 1, 8
#: Labelled documents that are learnt from: at most so many rows, whose texts have together at most so many bytes.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: Bytes of the dictionaries.
ORDINARY, TOXIC = 6_144, 2_048
#: Bytes of a word's beginnings that are looked at besides the whole word; one is typical if it is so many times as frequent in toxic documents, at this many standard deviations.
BEGINNINGS, RATIO, Z = (5, 6, 7, 8), 6.0, 6.0
#: One sampled document in so many is held back for the thresholds and the curve.
CALIBRATE = 3
#: What stands before and behind a window as it is compressed.  zstandard stores short inputs as they are and looks for no
#: match in the last eight bytes; BEFORE, which both dictionaries end with, and BEHIND make it look at all of a short word.
BEFORE, BEHIND = b"The quick brown fox jumps over the lazy dog;", b"01234567"
#: Distances from here on are above every threshold, and counted together.
FAR = 16
#: Distances of windows that a task remembers, as words repeat; then it forgets them all.
REMEMBERED = 200_000


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of ``size`` words, ASCII lower case; null, empty and blank texts have none."""
    words = (text or b"").lower().split()
    return [b" ".join((b"", *words[i : i + size], b"")) for i in range(0, len(words), size)]


@lru_cache(maxsize=8)
def compressors(ordinary: bytes, toxic: bytes):
    """Compressors with the ordinary and with the toxic dictionary, and the distances of windows that have been met."""
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY2, target_length=16, write_content_size=0, write_dict_id=0)
    out = []
    for content in (ordinary, toxic):
        d = zstandard.ZstdCompressionDict(content + BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress)
    return (*out, {})


def distances(text: bytes | None, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """How many windows of the whole text have each distance: 0 (or less) to FAR (or more)."""
    plain, other, met = compressors(ordinary, toxic)
    counts = np.zeros(FAR + 1, np.int64)
    for w in windows(text):
        saved = met.get(w)
        if saved is None:
            if len(met) >= REMEMBERED:
                met.clear()
            whole = b"%b%b%b" % (BEFORE, w, BEHIND)
            saved = met[w] = min(max(len(plain(whole)) - len(other(whole)), 0), FAR)
        counts[saved] += 1
    return counts


def trained(samples: list[bytes], size: int, d: int) -> bytes:
    """A zstandard dictionary of the samples, chosen by their stretches of ``d`` bytes; where there are too few for the trainer, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def passages(text: bytes | None) -> dict[bytes, int]:
    """The beginnings of the words of a whole text, behind a blank, and for each the smallest hash of a word and its neighbours where it occurs."""
    words = [b"", *(w.strip(b".,;:!?") for w in (text or b"").lower().split()), b""]
    found: dict[bytes, int] = {}
    for before, w, after in zip(words, words[1:], words[2:], strict=False):
        at = xxhash.xxh64_intdigest(b"%b %b %b" % (before, w, after)) >> 1
        for g in {w, *(w[:n] for n in BEGINNINGS)}:
            if g and found.get(g, at) >= at:
                found[g] = at
    return found


def counted(sample: DataFrame) -> DataFrame:
    """(passage, toxic, ordinary): in how many toxic and ordinary documents of ``sample`` (label, text) a passage occurs.

    Documents in which the same words surround it count once, so that copies and near copies do not make their words look
    typical.
    """

    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["passage", "label", "at"])
        for b in batches:
            for text, label in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("label").to_pylist(), strict=True):
                found = passages(text)
                for column, values in zip(out, (found, [label] * len(found), found.values()), strict=True):
                    column.extend(values)
                if len(out[0]) > 50_000:
                    yield flush()
                    out = ([], [], [])
        yield flush()

    rows = sample.select("text", "label").mapInArrow(run, "passage binary, label int, at long")
    # One shuffle, by passage, serves both groupings.
    return rows.repartition("passage").distinct().groupBy("passage").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary"))


def typical(toxic: Column, ordinary: Column, n: int, m: int) -> Column:
    """Whether a count in ``n`` toxic documents is far above that in ``m`` ordinary ones, and above what both kinds together suggest."""
    share = (toxic + ordinary + 0.5) / (n + m + 1.0)
    z = (toxic - n * share) / F.sqrt(n * share * (1 - share))
    return (toxic / max(n, 1) >= RATIO * (ordinary + 0.5) / max(m, 1)) & (z >= Z)


def stretches(text: bytes | None, typical: set[bytes]) -> list[bytes]:
    """The runs of words of a whole text that begin with a typical passage."""
    out, run = [], []
    for w in [*(text or b"").lower().split(), b""]:
        bare = w.lstrip(b".,;:!?")
        if bare and any(bare[:n] in typical for n in (len(bare.rstrip(b".,;:!?")), *BEGINNINGS)):
            run.append(w)
        elif run:
            out.append(b" %b " % b" ".join(run))
            run = []
    return out


class Model:
    """The two dictionaries, three thresholds (the distances that make a window a weak, plain or strong hit) and the curve over a document's hits."""

    def __init__(self, ordinary: bytes, toxic: bytes, thresholds: tuple[int, int, int], curve: np.ndarray):
        self.ordinary, self.toxic, self.thresholds, self.curve = ordinary, toxic, thresholds, curve

    def shape(self, counts: np.ndarray) -> np.ndarray:
        """Of rows of window counts by distance: one, the number of windows, and hits of each strength, all but the first on a logarithmic scale."""
        edges = [*self.thresholds, FAR + 1]
        hits = [np.log1p(counts[:, a:b].sum(axis=1)) for a, b in zip(edges, edges[1:], strict=False)]
        return np.stack([np.ones(len(counts)), np.log1p(counts.sum(axis=1)) / 4, *hits], 1)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.shape(counts) @ self.curve))) if len(counts) else np.zeros(0)

    def score(self, text: bytes | None) -> float:
        """0 to 1; a text without words scores as one without windows."""
        return float(self.scores(distances(text, self.ordinary, self.toxic)[None, :])[0])


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept, column 0, is not shrunk."""
    w, ridge = np.zeros(x.shape[1]), l2 * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def measured(sample: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(label, counts): each document's windows by distance."""

    def run(batches):
        for b in batches:
            counts = [distances(t.as_py(), ordinary, toxic).tolist() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(counts, pa.list_(pa.int64()))], names=["label", "counts"])

    return sample.select("text", "label").mapInArrow(run, "label int, counts array<long>")


def calibrated(ordinary: bytes, toxic: bytes, counts: np.ndarray, y: np.ndarray) -> Model:
    """The model whose thresholds and curve fit the labels best, by log loss."""
    best = None
    for least in range(1, 7):
        for step in (1, 2, 3):
            m = Model(ordinary, toxic, (least, least + step, least + 2 * step), np.zeros(5))
            x = m.shape(counts)
            m.curve = logistic(x, y)
            p = np.clip(1 / (1 + np.exp(-(x @ m.curve))), 1e-9, 1 - 1e-9)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
            if best is None or loss < best[0]:
                best = (loss, m, p)
    _, m, p = best
    # A score of one half is where F1 is best; toxic documents are few, so that is below a chance of one half.
    f1 = [(2 * (y[p >= c] == 1).sum() / max(1, (p >= c).sum() + y.sum()), c) for c in np.arange(0.2, 0.51, 0.05)]
    cut = max(f1)[1]
    m.curve[0] -= np.log(cut / (1 - cut))
    return m


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "toxic", limit: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from a bounded sample of the labelled documents for which ``rows`` holds: at most ``limit`` rows and ``most_bytes`` of whole texts.

    Null texts count as empty; label rows that repeat count once (toxic if one says so), null labels not at all.  No rows,
    one class, or no typical passage give a model that scores every text with the smoothed base rate.
    """
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(CALIBRATE)) == 0).alias("held")
    sample = labelled_sample(docs, labels, label, rows, limit, most_bytes=most_bytes)
    sample = written(sample.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"), held), "toxicity-sample")
    n = {(r.label, r.held): r["count"] for r in sample.groupBy("label", "held").count().collect()}
    toxic, plain = ((n.get((k, False), 0), n.get((k, True), 0)) for k in (1, 0))
    base = Model(b"", b"", (1, 2, 3), np.array([np.log((sum(toxic) + 0.5) / (sum(plain) + 0.5)), 0, 0, 0, 0]))
    if not all((*toxic, *plain)):
        return base
    learnt, kept = sample.filter("NOT held"), sample.filter("held")
    # What is significant is few; how few does not depend on the corpus, as the sample is bounded.
    found = counted(learnt).filter(typical(F.col("toxic"), F.col("ordinary"), toxic[0], plain[0])).select("passage").collect()
    if not found:
        return base
    typical_ones = {bytes(r.passage) for r in found}
    of = lambda y: [bytes(r.text) for r in learnt.filter(F.col("label") == y).select(F.col("text").cast("binary").alias("text")).orderBy("doc_id", "text").collect()]
    pair = trained([w for t in of(0) for w in windows(t, LEARNT)], ORDINARY, 6), trained([x for t in of(1) for x in stretches(t, typical_ones)], TOXIC, 8)
    got = sorted((r.label, *r.counts) for r in measured(kept, *pair).collect())
    return calibrated(*pair, np.array([r[1:] for r in got]), np.array([r[0] for r in got], float))


def score(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with score (0 to 1, whole texts, null as empty) and predicted (1 if score >= 0.5); columns of those names are replaced, the text is dropped."""
    keep = [c for c in df.columns if c.lower() not in ("score", "predicted", "text")]
    schema = df.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        for b in batches:
            counts = np.array([distances(t.as_py(), model.ordinary, model.toxic) for t in b.column("text").cast(pa.binary())]).reshape(-1, FAR + 1)
            s = model.scores(counts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return df.select(*keep, "text").mapInArrow(run, schema)
