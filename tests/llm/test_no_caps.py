"""Nothing a result depends on is capped: separators, hints, samples, keys, and the recall of every shape."""

import re
import struct

import numpy as np
import pytest
import xxhash
import zlib
from pyspark.sql import functions as F
from test_operators import docs, fair, words

from chronotext.llm import bpe, embed_dedup, licenses, mixing, sharding, toxicity, url_filter
from chronotext.llm.shared import labelled_sample


def test_licence_sentences_however_they_wrap(spark):
    assert all(re.search(licenses.HINT, s) for s in licenses.KNOWN)
    said = {v: k for k, v in licenses.SENTENCES.items()}
    cases = [(k, s.replace(" ", gap).capitalize() + ".") for k, s in said.items() if not s.endswith(" at") for gap in (" ", "\n", "\n" + " " * 60, " \n * ")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license_sequence for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [f",{k}," for k, _ in cases]


def test_samples_skip_what_does_not_fit(spark):
    rows = spark.createDataFrame([(i, "x" * (1000 if i % 2 else 10)) for i in range(60)] + [(2, "x" * 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    got = labelled_sample(rows, labels, "toxic", F.lit(True), 1000, most_bytes=400).collect()
    assert len(got) == 31 and {len(r.text) for r in got} == {10}
    assert labelled_sample(rows, labels, "toxic", F.lit(True), 1000).count() == 61 and labelled_sample(rows, labels, "toxic", F.lit(True), 1000, most_bytes=5).count() == 0


def test_short_toxic_words_are_learnt(spark):
    rng = __import__("random").Random(2)
    rows = [(i, words(rng, 30) + (" zut zut" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score(df.withColumn("SCORE", F.lit("clash")).withColumn("Predicted", F.lit(0)), model).filter("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.95
    assert model.toxic and model.ordinary and model.ordinary not in model.toxic


def test_clashing_names(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, IDS string")
    assert bpe.transcode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).select("ids", "round_trip").first().round_trip


def xx(*values, seed=42):
    """Spark's xxhash64 of longs (and of an int, given as bytes), each seeded with the one before; nulls are left out."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed


def test_mixing_takes_what_its_keys_say(spark):
    """Which documents are taken, recomputed: keys from id, text and size, smallest first until one would overrun, then the best fill."""
    rng = __import__("random").Random(12)
    rows = [(None if i % 3 == 0 else i % 40, words(rng, rng.randrange(0, 30)), rng.choice(["a", "a", "b", "c", None])) for i in range(700)]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fair(sizes)
    taken = {}
    for r in got:
        taken.setdefault(r.source, []).append((-1 if r.doc_id is None else r.doc_id, r.text, r.times))
    for s in sizes:
        epochs = int(want[s] // sizes[s])
        budget, keyed = want[s] - epochs * sizes[s], []
        for i, t, own in rows:
            if own == s:
                n = len(t.split())
                u = (xx(i, zlib.crc32(t.encode()), n, struct.pack("<i", 5)) % (1 << 52) + 0.5) / (1 << 52)
                keyed.append((-np.log(u), -1 if i is None else i, t, n))
        keyed.sort()
        most, total, at = [], 0, 0
        while at < len(keyed):
            same = [k for k in keyed[at:] if k[:2] == keyed[at][:2]]
            if total + sum(k[3] for k in same) > budget:
                break
            total, at = total + sum(k[3] for k in same), at + len(same)
        most = keyed[:at]
        missing = budget - total
        fill = min(((abs(k[3] - missing), *k) for k in keyed[at:] if k[3] and abs(k[3] - missing) < missing), default=None)
        expected = sorted((i, t, epochs + 1) for _, i, t, _ in most + ([fill[1:]] if fill else [])) if budget else []
        assert sorted(x for x in taken[s] if x[2] > epochs) == expected
        assert abs(sum(len(t.split()) * n for _, t, n in taken[s]) - want[s]) <= 15


def test_mixing_of_rows_without_ids(spark):
    rows = docs(spark, [(None, f"w{i} " * 10, "s") for i in range(300)] + [(5, f"v{i} " * 10, "t") for i in range(300)] + [(i, "x " * 10, "u") for i in range(300)])
    got = {r.source: (r.target, r.taken) for r in mixing.mix(rows).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("times")).alias("taken")).collect()}
    assert all(abs(target - taken) <= 10 for target, taken in got.values())


@pytest.mark.parametrize("shape", [(4, 5), embed_dedup.SHAPE, (13, 23)])
def test_recall_of_every_shape(spark, shape):
    """Pairs planted at cosine 0.90 to 0.92 among others: at least 0.9 of their links are found, and unrelated rows don't change which."""
    rng = np.random.default_rng(15)
    one, side = embed_dedup.unit(rng.standard_normal((400, 64))), rng.standard_normal((400, 64))
    side = embed_dedup.unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    cos = rng.uniform(0.9, 0.92, (400, 1))
    planted = np.concatenate([one, cos * one + np.sqrt(1 - cos**2) * side])
    others = rng.standard_normal((1500, 64))
    table = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    few = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(table(planted), shape=shape).collect()}
    many = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(table(np.concatenate([planted, others])), shape=shape).collect()}
    true = (embed_dedup.unit(planted) @ embed_dedup.unit(planted).T >= 0.9).sum(axis=1) - 1
    assert sum(few.values()) >= 0.9 * true.sum() and all(few[i] <= true[i] and many[i] == few[i] for i in range(800))


def test_tables_for():
    assert embed_dedup.tables_for(embed_dedup.SHAPE[0]) == embed_dedup.SHAPE[1] and [embed_dedup.plan(n) for n in (50_000, 200_000, 1_000_000)] == [(7, 8), (10, 14), (13, 23)]


def test_listed_rules(spark):
    odd = [("block", "it's.org", "/a\\b'c/"), *url_filter.RULES]
    assert [tuple(r) for r in url_filter.listed(spark, odd).collect()] == odd


def test_a_version_that_another_run_has_stored(spark, tmp_path, monkeypatch):
    df = docs(spark, [(i, f"text {i}", "a") for i in range(50)])
    folder, asked = str(tmp_path / "maps"), []
    first = {r.doc_id: r.shard for r in sharding.shard_documents(df, folder, 4).collect()}

    def late(session, where, real=sharding.latest_version):
        """The first answer is what was true before the other run."""
        asked.append(real(session, where))
        return None if len(asked) == 1 else asked[-1]

    monkeypatch.setattr(sharding, "latest_version", late)
    rows = sharding.shard_documents(df, folder, 4).collect()
    assert asked == [1, 1] and {r.version for r in rows} == {2} and {r.doc_id: r.shard for r in rows} == first
