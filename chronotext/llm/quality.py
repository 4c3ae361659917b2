"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at its quantiles.  Training visits the features in turn and adds, at a small rate,
a tree of a few leaves fitted to the current residuals of that feature alone; as the trees of a feature see nothing else,
their sum is one lookup table.  Then the pairs of features that explain most of what is left get two-dimensional tables in
the same way.  A score is a sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.shared import labelled_sample

#: Labelled rows that the model is fitted on.
SAMPLE = 20_000
FEATURES = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "exclaim", "bar", "space", "high_byte", "distinct_words", "distinct_lines", "line_length", "stop_rate"]

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+<=>@\\^_`~{}[]/", b"!?", b"|", b" \t\n\x0b\x0c\r", b".,;:"), 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 8


def features(text: bytes | None) -> np.ndarray:
    """The features of a whole text; null counts as empty, and an empty text has zeros."""
    text = text or b""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    n = len(text)
    by = np.zeros(9)
    for at in range(0, n, 1 << 20):  # long texts in parts, so that memory stays small
        counts = np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, n - at), at), minlength=256)
        by += np.bincount(_CLASS, weights=counts, minlength=9)
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    out[:] = [np.log1p(n), np.log1p(len(words)), (n - by[6]) / w, by[1] / n, by[2] / n, by[3] / n, by[4] / n, by[5] / n, by[6] / n, by[8] / n, len(set(words)) / w, len(set(lines)) / len(lines), np.log1p(n / len(lines)), by[7] / w]
    return out


class Model:
    """Bin edges, one table for each feature, tables for pairs, and the base rate as log odds."""

    def __init__(self, edges, base):
        self.edges, self.base = edges, base
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.single):
            out += t[bins[:, j]]
        for i, j, t in self.pairs:
            out += t[bins[:, i] * len(t) // len(self.single[i]), bins[:, j] * t.shape[1] // len(self.single[j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(self.bins(x)))) if len(x) else np.zeros(0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, l2: float = 2.0, least: float = 8.0) -> np.ndarray:
    """Leaf values along one feature's bins: the best cut of the bins into at most ``leaves`` ranges, found greedily on sums of gradients."""
    cuts = [0, len(g)]
    G, H = np.r_[0, g.cumsum()], np.r_[0, h.cumsum()]
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + l2)
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            at = at[(H[at] - H[a] > least / 8) & (H[b] - H[at] > least / 8)]
            if len(at):
                won = gain(a, at) + gain(at, b) - gain(a, b)
                best = max(best, (won.max(), int(at[won.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15, pairs: int = 6, cells: int = 8) -> Model:
    """Fit the model; no rows, or rows of one class, give the (smoothed) base rate alone."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    m = Model(edges, base)
    if len(np.unique(y)) < 2:
        return m
    b = m.bins(x)
    f = m.log_odds(b)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(m.single):
            g, h = slopes()
            step = rate * tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += step
            f += step[b[:, j]]
    coarse = np.stack([b[:, j] * min(cells, len(t)) // len(t) for j, t in enumerate(m.single)], 1)
    shape = lambda i, j: (min(cells, len(m.single[i])), min(cells, len(m.single[j])))
    g, h = slopes()
    gains = []
    for i in range(len(FEATURES)):
        for j in range(i):
            at, (r, c) = coarse[:, i] * shape(i, j)[1] + coarse[:, j], shape(i, j)
            sg, sh = np.bincount(at, g, r * c), np.bincount(at, h, r * c)
            gains.append(((sg**2 / (sh + 5)).sum(), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        m.pairs.append((i, j, np.zeros(shape(i, j))))
    for _ in range(rounds // 4):
        for i, j, t in m.pairs:
            at = coarse[:, i] * t.shape[1] + coarse[:, j]
            g, h = slopes()
            sg, sh = (np.bincount(at, z, t.size).reshape(t.shape) for z in (g, h))
            # A tree of two levels: the best cut of one feature, then of the other one on either side.
            step = np.zeros(t.shape)
            first = tree(sg.sum(1), sh.sum(1), 2)
            for rows in (np.flatnonzero(first == v) for v in np.unique(first)):
                step[rows] = tree(sg[rows].sum(0), sh[rows].sum(0), 2)
            step *= rate
            t += step
            f += step.ravel()[at]
    return m


def with_features(df: DataFrame) -> DataFrame:
    """``df`` with ``x``, the features of ``text``, in place of the text; other columns pass through."""
    keep = [c for c in df.columns if c not in ("text", "x")]
    schema = df.select(*keep, F.array(F.lit(0.0)).alias("x")).schema

    def run(batches):
        for b in batches:
            x = [features(t.as_py()) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.select(*keep, "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "quality", limit: int = SAMPLE) -> Model:
    """A model for ``label`` from at most ``limit`` labelled documents for which ``rows`` holds; their features, not their texts, reach the driver.

    Null texts count as empty; label rows that repeat count once (1 if one says so), null labels not at all; no rows, or
    rows of one class, give a model that scores every text with the smoothed base rate.
    """
    got = with_features(labelled_sample(docs, labels, label, rows, limit)).select("doc_id", "label", "x").toPandas().sort_values(["doc_id", "label"])
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["label"].to_numpy())) if len(x) else np.zeros(0, int)
    return fit(x[order], got["label"].to_numpy(float)[order])


def score(df: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if score >= 0.5), under the names given.

    Columns of those names are replaced, all others kept.  Null and empty texts are scored too; rows that repeat get the
    same score; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c.lower() not in (score.lower(), predicted.lower())]

    @F.arrow_udf("double")
    def scores(text: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py()) for t in text.cast(pa.binary())]).reshape(-1, len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    # Only the text goes to Python, and only the score comes back.
    out = df.select(*keep, scores(F.coalesce("text", F.lit(""))).alias(score))
    return out.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
