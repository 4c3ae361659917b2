"""The pipeline's near-dedup stage against brute-force Jaccard."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from chronotext.llm import shingles, simhash


def slow(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_stage_drops_what_jaccard_links(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(900)}"
    base = [[word() for _ in range(rng.randrange(40, 300))] for _ in range(120)]
    texts = [" ".join(t) for t in base]
    for t in base:
        for _ in range(2):
            new = list(t)
            for _ in range(rng.randrange(1, 1 + len(t) // 25)):
                new[rng.randrange(len(t))] = word()
            texts.append(" ".join(new))
    texts += [texts[0].upper(), texts[1] + " tail", None, "", " \n ", "one", "One", "one two", " ".join(word() for _ in range(20_000))]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, texts[0], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    own, root = [slow(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert len(pairs) > 100
    got = corpus_pipeline.near_stage(spark, df, "")
    assert got.columns == df.columns
    kept = [r.doc_id for r in got.collect()]
    assert kept.count(None) == 1 and {i for i in kept if i is not None} == {find(i) for i in root}
    # Keys split over tiles span the same links, and no edge is wrong.
    edges = [tuple(r) for r in shingles.links(df.filter("doc_id IS NOT NULL").select("doc_id", "text"), 2).collect()]
    assert all(tuple(sorted(e)) in set(pairs) for e in edges)
    joined = list(range(len(texts)))
    for a, b in edges:
        while joined[a] != a:
            a = joined[a]
        while joined[b] != b:
            b = joined[b]
        joined[max(a, b)] = min(a, b)
    assert all(joined[i] == i for i in kept if i is not None) and sum(joined[i] == i for i in range(len(texts))) == len(kept) - 1
    assert corpus_pipeline.near_stage(spark, df.limit(0), "").count() == 0


def test_candidates_meet_at_anchors_of_fingerprints():
    rng = np.random.default_rng(3)
    for n in shingles.PARTS:
        home = simhash.homes(n)
        assert len(set(home)) == 2**n // (n + 1) and max(int(h ^ w).bit_count() for w, h in enumerate(home)) == 1
    sets, pairs = [], []
    for k in range(300):  # pairs of similarity 0.8 at least, and sets of 0.5 beside them
        a, b, c = (rng.integers(0, 1 << 63, 90, np.uint64) for _ in range(3))
        same = 90 - k % 11
        b[:same] = a[:same]
        c[:60] = a[:60]
        pairs.append((len(sets), len(sets) + 1))
        sets += [np.unique(x) for x in (a, b, c)]
    bits = np.array([shingles.fingerprint(s) for s in sets])
    keys, sketch = shingles.anchors(bits), np.packbits(bits[:, : shingles.SKETCH], axis=1).view(np.int64)
    words = bits.reshape(len(bits), shingles.WORDS, shingles.WIDTH) @ (1 << np.arange(shingles.WIDTH))
    assert np.bitwise_count((keys & ((1 << shingles.WIDTH) - 1)) ^ words).max() == 2
    rows = sorted((int(key), i, int(sketch[i, 0]), int(sketch[i, 1])) for i in range(len(sets)) for key in keys[i])
    found = {}
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 700], strict=True)], names=["key", "doc_id", "a", "b"]) for at in range(0, len(rows), 700)]
    for b in shingles.meeting(batches):
        for key, rep, doc in zip(*(b.column(c).to_pylist() for c in ("key", "rep", "doc_id")), strict=True):
            found.setdefault((key, rep), set()).add(doc)
    assert all(any({a, b} <= g for g in found.values()) for a, b in pairs)


def test_sketches_keep_pairs_of_0_8_and_few_of_0_4():
    rng = np.random.default_rng(5)

    def near(same: int, own: int) -> float:
        hits = 0
        for _ in range(300):
            both, a, b = (rng.integers(0, 1 << 63, n, np.uint64) for n in (same, own, own))
            hits += int(np.bitwise_count(shingles.sketch(np.r_[both, a]) ^ shingles.sketch(np.r_[both, b])).sum()) <= shingles.FAR
        return hits / 300

    assert near(80, 10) == near(400, 50) == 1
    assert near(40, 30) < 0.2


def test_fingerprints_that_differ_in_the_highest_bit_are_near():
    a = np.array([5, 5, 5], np.int64)
    b = a ^ np.array([-(1 << 63), -(1 << 63) + 1, -(1 << 63) + 15], np.int64)
    assert simhash.near(a, b).tolist() == [True, True, False]
