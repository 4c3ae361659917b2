"""Lexical search, Merkle manifest and bit-sliced search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.llm import bitslice, lexical, manifest, topk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, k):
    bags = [(i, Counter(slow_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 100 - 75 + 75 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, q in Counter(slow_terms(text)).items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    word = lambda: f"{rng.choice(['Aa', 'b', 'É', '漢'])}{min(rng.randrange(60), rng.randrange(60))}"
    docs = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(i + 500, t) for i, t in docs[:40]] + [docs[3], docs[3], (900, None), (901, ""), (902, " -- "), (None, docs[5][1]), (None, docs[5][1]), (903, "aa1 b2 " * 20_000)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(25)] + [(70, None), (71, ""), (72, "unknown"), (None, "AA1 b3"), (3, "b2 b2 aa5"), (3, "b2 b2 aa5")]
    return docs, items


@pytest.mark.parametrize(("k", "cells", "block"), [(10, 1 << 21, 20_000), (3, 500, 7)])
def test_lexical_search(spark, texts, monkeypatch, k, cells, block):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs, items = texts
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in lexical.search(df, asked, k).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == slow_search(docs, items, k)
    assert lexical.search(df.limit(0), asked).count() == lexical.search(df, asked.limit(0)).count() == 0
    assert lexical.search(df.filter("text IS NULL"), asked).count() == 0


def test_rows_are_taken_in_runs():
    assert list(lexical.chunks(np.array([3, 3, 9, 1, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 6)] and list(lexical.chunks(np.zeros(0, np.int64), 6)) == []


def test_heaps():
    rng = np.random.default_rng(3)
    heaps, rows = topk.Heaps(4, 3), []
    for _ in range(30):
        n = rng.integers(0, 9)
        q, s, i, none = rng.integers(0, 3, n), rng.integers(-5, 5, n), rng.integers(0, 9, n), rng.random(n) < 0.2
        heaps.offer(q, s, i, none)
        rows += list(zip(q.tolist(), s.tolist(), i.tolist(), none.tolist(), strict=True))
    got = heaps.rows(["q", "s", "i"]).to_pylist()
    for q in range(4):
        want = sorted((-s, none, i) for x, s, i, none in rows if x == q)[:3]
        assert [(r["s"], r["i"]) for r in got if r["q"] == q] == [(-s, None if none else i) for s, none, i in want]
    assert heaps.floor[3] == topk.LEAST and heaps.floor[0] == min(r["s"] for r in got if r["q"] == 0)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(*fields):
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def slow_tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(*r)))
        trees[s] = own, slow_tree([slow_leaf(*r) for r in own])
    top = slow_tree([trees[s][1][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for at, r in enumerate(trees[s][0]):
            even = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
            fold, proof = slow_leaf(*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]), []
            for levels, i in ((trees[s][1], at), (top, k)):
                for nodes in levels[:-1]:
                    g = i // 3 * 3
                    left, right = nodes[g:i], nodes[i + 1 : g + 3]
                    proof += [*left, *right]
                    fold, i = digest(*left, fold, *right), i // 3
            out.append((r[0], slow_leaf(*r), trees[s][1][-1][0], top[-1][0], digest(*proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


DDL = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pid int"


def sources(n):
    """Sources of very different size: one needs two rounds, and so do many small ones together."""
    rng = random.Random(n)
    rows = [(i, "hot", "en", i, f"text {i}\n" * (i % 3)) for i in range(2200)]
    rows += [(5000 + i, f"s{rng.randrange(n)}", None, None, rng.choice([None, "", "a\nb", "é"])) for i in range(1000)]
    rows += [(9000 + i, None, "x", 3, "no source\n") for i in range(7)] + [(9100, "", "x", 3, "empty\n"), (None, "hot", "x", 3, "no id\n"), (None, "s1", None, None, None)]
    return rows + [rows[4], rows[4], (4, "hot", "en", 9, "same id\n"), (9200, "long", "en", 1, "word \n" * 300_000)]


@pytest.mark.parametrize("n", [5, 900])
@pytest.mark.parametrize("broadcast", [manifest.BROADCAST, 3])
def test_manifest(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(manifest, "BROADCAST", broadcast)
    rows = sources(n)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL).repartition(6)
    made = manifest.build(df)
    got = manifest.proofs(made, siblings=True).collect()
    want = slow_manifest(rows)
    assert sorted((tuple(r[:7]) for r in got), key=str) == want and made.root == want[0][3]
    assert all(digest(*r.proof) == r.proof_sha256 for r in got) and 0 < sum(not r.verified for r in got) < len(got)
    parts = made.leaves.groupBy("part").agg(F.count("*").alias("rows")).collect()
    assert max(r["rows"] for r in parts) <= 3 * manifest.CHUNK
    # What a leaf partition fetches, it fetches once; a few nodes for each level.
    asked = manifest.requests(made)
    assert asked.distinct().count() == asked.count() <= len(parts) * 4 * 2 * manifest.depth(len(rows))


def test_small_manifests(spark):
    for rows in ([(1, "a", "en", 2, "x\ny")], [(1, "a", "en", 2, "x"), (2, None, "en", 2, "y\n")], [(i, "a", None, None, None) for i in range(4)]):
        got = manifest.proofs(manifest.build(spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL))).collect()
        assert sorted((tuple(r) for r in got), key=str) == slow_manifest(rows)
    none = manifest.build(spark.createDataFrame([], DDL))
    assert none.root is None and manifest.proofs(none).count() == 0


def test_missing_is_what_cannot_be_derived():
    assert list(manifest.missing({0, 1, 2}, 9)) == [(1, 1), (1, 2)] and list(manifest.missing(set(range(9)), 9)) == []
    assert list(manifest.missing({4}, 10)) == [(0, 3), (0, 5), (1, 0), (1, 2), (2, 1)] and list(manifest.missing({0}, 1)) == []


def slow_top(rows, k, asked):
    good = [(n, i, [math.floor(256 * c) for c in v]) for n, (i, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, q in good:
        if i is not None and asked(i):
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in good if m != n and len(v) == len(q))[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "scale", "passes"), [(8192, 1.0, 1 << 20), (100, 1.0, 90), (100, 3000.0, 1 << 20)])
def test_bit_sliced_search(spark, monkeypatch, block, scale, passes):
    monkeypatch.setattr(bitslice, "BLOCK", block)
    monkeypatch.setattr(bitslice, "PASS", passes)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 16)) * scale
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[3].tolist()) for i in range(150)] + [(20, v[9].tolist()), (20, v[9].tolist()), (None, v[20].tolist())]
    rows += [(2000, None), (2020, []), (2040, [1.0, None]), (2060, [float("nan")] * 16), (2080, [float("inf")] * 16), (2100, [0.0] * 16), (2120, [1.0, -2.0]), (2121, [0.5, 0.25]), (2140, [2.0] * 5)]
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in rows], "vec_id long, embedding array<double>, score string, row int").repartition(5)
    got = [tuple(r) for r in bitslice.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got, key=str) == slow_top(rows, 5, lambda i: i % 20 == 0)
    assert bitslice.search(df.limit(0), F.lit(True)).count() == bitslice.search(df, F.lit(False)).count() == 0


def test_sums_of_slices():
    """Slices alone bound every product from both sides; with few bits they are the products themselves."""
    rng = np.random.default_rng(1)
    for width, exact in ((20, True), (5000, False)):
        values, q = rng.integers(-width, width, (130, 9)), rng.integers(-300, 300, 9)
        s = bitslice.Slices(values)
        planes, amount, slack = s.sums(q)
        low = sum(np.unpackbits(p.view(np.uint8), bitorder="little")[:130].astype(np.int64) << w for w, p in planes.items()) + amount
        assert (low <= values @ q).all() and (values @ q <= low + slack).all() and (slack == 0) == exact
        again = bitslice.Slices.unpack(s.pack())
        others = np.delete(np.arange(130), 7)
        best = others[np.argsort(-(values @ q)[others], kind="stable")]
        for k in (1, 5, 200):
            at, score = again.top(q, k, None, 7)
            assert set(best[:k]) <= set(at) <= set(others) and (score == (values @ q)[at]).all()


def test_components_beyond_the_largest_are_cut(spark):
    df = spark.createDataFrame([(0, [1e300, 0.5]), (1, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    got = bitslice.search(df, F.lit(True)).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == {(0, 1, -(bitslice.LARGEST**2) + 128 * 512), (1, 0, -(bitslice.LARGEST**2) + 128 * 512)}
