"""Every registered query of the numbered operators on the smallest data: the columns and digests that its contract names, against plain Python."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from chronotext.llm import bpe, registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("name", "mod", "rest"), [("op1_toxicity", 5, 0), ("op10_quality", 3, 1)])
def test_classifiers(spark, texts, name, mod, rest):
    got = rows(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_sharding(spark, texts):
    for _ in range(2):  # the second run edits the map of the first
        got = rows(spark, "op2_sharding")
        assert sorted(r.doc_id for r in got) == sorted(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        assert all((r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in got)
        load = [sum(r["size"] for r in got if r.shard == s) for s in range(16)]
        assert max(load) - min(load) <= max(r["size"] for r in got)
        for s in range(16):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_simhash(spark, texts):
    from test_operators import slow_print, union

    got = {r.doc_id: r for r in rows(spark, "op4_simhash")}
    ids = sorted(texts)
    fps = [slow_print(texts[i]) for i in ids]
    want = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", ids[w]) for i, f, w in zip(ids, fps, want, strict=True)}


def test_mixing(spark, texts):
    got = rows(spark, "op5_mixing")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode().split()) and r.taken in (0, r["size"], 2 * r["size"]) for r in got)


def test_bpe(spark, texts):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(registry.VOCABULARY)), special_tokens={})
    got = rows(spark, "op6_bpe")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_embeddings(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    v = np.array([x for _, x in table], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = (v @ v.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r for r in rows(spark, "op8_embedding_dedup")}
    assert sorted(got) == sorted(i for i, _ in table) and all(got[i].n_links <= n for (i, _), n in zip(table, links, strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.9 * links.sum() and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
