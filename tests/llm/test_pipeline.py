"""Each stage of the pipeline against a plain version of what it must do to its own input."""

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline as P
from stintwise.llm.leaks import decontaminate
from stintwise.llm.toxicity import toxicity
from stintwise.session import written
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_near_dup import brute as near_brute

SF = "/root/testdata/sf0.001"


def pairs(df):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=key)


@pytest.fixture(scope="module")
def staged(spark, odd_pairs):
    """Input and output of each stage: the smallest table, some odd rows, and a planted leak."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    odd = [(None if i is None else 100_000 + i, t) for i, t in odd_pairs] + [(200_000, f"it begins. {item} it ends")]
    more = spark.createDataFrame([(i, t, None, "odd", None) for i, t in odd], docs.schema)
    now = written(docs.unionByName(more), "test")
    out = []
    for _, stage in P.STAGES:
        after = written(stage(spark, now, SF), "test")
        out.append((now, after))
        now = after
    return out


def test_all_but_the_last_return_the_columns_of_documents(staged):
    for before, after in staged[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_toxic_documents_go(spark, staged):
    before, after = staged[0]
    found = toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in found.filter("predicted = 1").collect()}
    assert toxic and pairs(after) == [p for p in pairs(before) if p[0] not in toxic]


def test_repeated_lines_go(staged):
    before, after = staged[1]
    assert pairs(after) == sorted(((i, t) for i, t, _, _ in line_brute(pairs(before))), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    assert after.filter("n_chars <> length(text)").count() == before.filter("n_chars <> length(text)").count()


def test_one_of_each_group_stays(staged):
    before, after = staged[2]
    rows = pairs(before)
    kept = {(i, t or "") for (i, t), (*_, keep) in zip(rows, near_brute(rows, 80), strict=True) if keep and i is not None}
    got = pairs(after)
    assert [(i, t or "") for i, t in got if i is not None] == sorted(kept)
    assert [p for p in got if p[0] is None] == [p for p in rows if p[0] is None]
    assert len(got) < len(rows)


def test_leaks_go_and_clean_documents_stay(spark, staged):
    before, after = staged[3]
    found = decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    leaks = {r.doc_id for r in found.filter("contaminated").collect()}
    assert pairs(after) == [p for p in pairs(before) if p[0] not in leaks]
    assert 200_000 in leaks


def test_texts_are_encoded_as_the_library_does(staged):
    before, after = staged[4]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.PIECE_MODEL))
    got = sorted((r.doc_id or -1, r.ids) for r in after.collect())
    assert got == sorted((i or -1, library.encode(t or "")) for i, t in pairs(before))
    assert after.filter("n_tokens <> size(ids)").count() == 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.count() == 0


def test_batches_of_a_stage_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    def step(spark, docs, sf_dir):
        return docs.mapInArrow(sizes, "size long, n long")

    before = spark.conf.get(P.BATCH_CONF)
    try:
        docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('text ', 500) AS text")
        found = P._stage(step)(spark, docs, SF).collect()
    finally:
        spark.conf.set(P.BATCH_CONF, before)
    assert sum(r.n for r in found) == 3000
    assert max(r.size for r in found) < 1.5 * 2**20
