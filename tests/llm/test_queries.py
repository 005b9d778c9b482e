"""The registered queries on the smallest tables, against plain versions of what they must return."""

import hashlib
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from stintwise.llm.queries import QUERIES, SQL
from tests.compare import connect, differences
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_pii import brute as pii_brute
from tests.llm.test_secrets import plain_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").df()


def result(spark, name) -> pd.DataFrame:
    return QUERIES[name](spark, SF).toPandas()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_are_there():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", list(SQL))
def test_sql_twins(spark, name):
    assert differences(result(spark, name), connect(SF).execute(SQL[name]).df()) is None


def test_pieces(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: tuple(r)[1:] for r in result(spark, "op4_piece_coding").itertuples()}
    for i, t in docs.itertuples(index=False):
        ids = library.encode(t or "")
        row = got[i]
        assert row[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_near_duplicates(spark, docs):
    got = sorted(result(spark, "op6_near_duplicates").itertuples(index=False, name=None))
    assert got == sorted(near_brute(list(docs.itertuples(index=False, name=None)), 85))


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op7_secrets").itertuples()}
    kinds = ("assign", "access", "hex")
    for i, t in docs.itertuples(index=False):
        base = sorted(plain_base(t or ""), key=lambda s: (s[1], kinds.index(s[0])))
        text = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i].base_sha256 == sha(",".join(text))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in kinds)
        assert set(text) <= set(got[i].spans.split(","))


def test_shards(spark, docs):
    got = result(spark, "op8_shards")
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.itertuples(index=False)}
    assert dict(zip(got["doc_id"], zip(got["size"], got["text_crc32"], strict=True), strict=True)) == want
    sizes = got.groupby("shard")["size"].sum()
    assert (sizes - sizes.sum() / 8).abs().max() <= got["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()


def test_personal_data(spark, docs):
    got = {r.doc_id: r for r in result(spark, "op10_personal_data").itertuples()}
    for i, t in docs.itertuples(index=False):
        text = [f"{k}:{a}:{b}" for k, a, b in pii_brute(t)]
        assert got[i].base_sha256 == sha(",".join(text))
        assert set(text) <= set(got[i].spans.split(",")) or not text


def test_one_row_per_document(spark, docs):
    for name in ("op2_line_dedup", "op3_token_counts", "op5_toxicity", "op9_decontamination", "op11_lm_scores"):
        got = result(spark, name)
        assert len(got) == len(docs)
        assert name == "op3_token_counts" or sorted(got["doc_id"]) == sorted(docs["doc_id"])
