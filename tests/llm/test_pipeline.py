"""The pipeline's stages on a small corpus, against what brute force keeps: copies, near copies, nulls, empty and very long
texts, rows that repeat, ids that are missing, columns named like the stages' own, and empty tables."""

import itertools
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from chronotext.llm import bpe

DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "predicted", "_score", "_quality", "_gone", "_h", "_id", "es_key", "cut_key", "bin", "s", "size", "target", "times", "_copy", "edge", "row", "best"]


def slow(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def dropped(texts):
    """Ids that are not the smallest of their group, by the Jaccard similarity of every pair."""
    own, root = {i: slow(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) != i}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(6)
    good = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(200)]
    texts = [*good, *good[:40], *(" ".join(w + "###" for w in t.split()) for t in good[:100]), *(t + " tail" for t in good[40:60]), " ".join(f"w{rng.randrange(900)}" for _ in range(60_000))]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, good[5], "en", "a", 1), (None, "no id " + good[6], None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def plain(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, corpus):
    path, rows = corpus
    quality, exact, near, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    read = spark.read.parquet(f"{path}/documents.parquet")
    one = quality(spark, read, path).cache()
    assert plain(one) == Counter((i, t) for i, t, *_ in rows if "###" not in t) and one.columns == read.columns
    two = exact(spark, one, path).cache()
    best = {}
    for i, t, *_ in rows:
        if "###" not in t:
            best[t] = max((best.get(t), i), key=lambda x: (x is not None, x or 0))
    assert plain(two) == Counter((i, t) for t, i in best.items()) and two.columns == read.columns
    three = near(spark, two, path).cache()
    gone = dropped({i: t for t, i in best.items() if i is not None})
    assert len(gone) >= 20 and plain(three) == Counter((i, t) for t, i in best.items() if i is None or i not in gone) and three.columns == read.columns
    four = mix(spark, three, path).cache()
    kept = plain(three)
    assert four.columns == read.columns and all(n <= 2 and k in kept for k, n in plain(four).items())
    size = lambda c: sum(n * len(t.split()) for (_, t), n in c.items())
    assert size(kept) <= size(plain(four)) <= 1.6 * size(kept)
    five = tokens(spark, four, path).cache()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    lengths = Counter((r.doc_id, r.n_tokens) for r in five.collect())
    assert lengths == Counter({(i, len(own.encode_ordinary(t))): n for (i, t), n in plain(four).items()}) and five.filter("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, path).count() == four.count()


def test_stages_on_odd_rows(spark, corpus):
    """Nulls, blanks, columns named like the stages' own and empty tables: rows that are no copies stay, and their columns with them."""
    path, _ = corpus
    word = lambda k: " ".join(f"v{k}x{j}" for j in range(30))
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, None, "en", None, 1), (5, word(5), "en", "b", 9), (6, word(6), "en", "b", 9), (6, word(6), "en", "b", 9), (None, word(7), "en", "b", 9), (8, "one two", "en", "b", 2)]
    df = spark.createDataFrame(odd, DDL)
    wide = df.select("*", *(F.concat_ws("/", F.lit(c), "doc_id").alias(c) for c in CLASH))
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, wide, path)
        assert got.columns == wide.columns
        for r in got.collect():
            assert {c: r[c] for c in CLASH} == {c: c if r.doc_id is None else f"{c}/{r.doc_id}" for c in CLASH}, name
        assert stage(spark, df.limit(0), path).count() == 0
    _, exact, near, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    assert plain(exact(spark, df, path)) == Counter([(2, ""), (3, " \n\t"), (5, word(5)), (6, word(6)), (None, word(7)), (8, "one two")])
    # Blank texts are near copies of each other; rows without an id stay.
    assert plain(near(spark, df, path)) == Counter([(1, None), (None, None), (5, word(5)), (6, word(6)), (6, word(6)), (None, word(7)), (8, "one two")])
    assert {(r.doc_id, r.text) for r in mix(spark, df, path).collect()} <= {(i, t) for i, t, *_ in odd}
    five = tokens(spark, wide, path)
    assert five.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "round_trip"] and five.count() == len(odd) and five.filter("round_trip").count() == len(odd)
    assert sorted(r.n_tokens for r in five.filter("doc_id <= 2").collect()) == [0, 0]
    assert tokens(spark, df.limit(0), path).count() == 0
