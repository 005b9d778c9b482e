"""The operators over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.llm.leaks import decontaminate
from stintwise.llm.line_dedup import dedup_lines
from stintwise.llm.lm_score import lm_scores
from stintwise.llm.manifest import manifest_sql, verification
from stintwise.llm.near_dup import near_duplicates
from stintwise.llm.pieces import encode_decode
from stintwise.llm.pii import KINDS as PII_KINDS
from stintwise.llm.pii import find_personal_data
from stintwise.llm.ranked import RANK_SQL, rank
from stintwise.llm.secrets import KINDS as SECRET_KINDS
from stintwise.llm.secrets import find_secrets
from stintwise.llm.shards import shard_by_bytes
from stintwise.llm.token_files import count_tokens, write_token_files
from stintwise.llm.topk import exact_top_k, quantised
from stintwise.llm.toxicity import toxicity
from stintwise.session import shared_dir

PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_RANKS = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents"), near_words=4, least_words=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    ranks = public_tokenizers.path(TOKEN_RANKS)
    write_token_files(_table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN, END_OF_DOCUMENT)
    # The names that Spark gives to part files differ between runs in their middle.
    name = F.regexp_replace("file", r"^.*/(part-[0-9]+)-.*-(c[0-9]+)\.[a-z]+$", "$1-$2")
    return count_tokens(spark, path, END_OF_DOCUMENT).withColumn("file", name)


def op4_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85).drop("record")


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _digest(found: DataFrame, kinds: tuple[str, ...], further: str, by_start: bool) -> DataFrame:
    """The columns that the span queries return: counts of base spans, their digest, and all spans."""
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    place = F.array(*[F.lit(k) for k in kinds])
    known = F.col("base").cast(spans)
    every = F.array_distinct(F.concat(known, F.transform(further, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))

    def ordered(all_spans: Column) -> Column:
        nth = lambda s: F.array_position(place, s["kind"])
        first = (lambda s: (s["start"], nth(s))) if by_start else (lambda s: (nth(s), s["start"]))
        keyed = F.transform(all_spans, lambda s: F.struct(*[c.alias(f"k{i}") for i, c in enumerate((*first(s), s["end"]))], s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.sort_array(keyed)

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(ordered(known)), 256).alias("base_sha256"), _joined(ordered(every)).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(find_secrets(_table(spark, sf_dir, "documents")), SECRET_KINDS, "nested", by_start=True)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("record")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(find_personal_data(_table(spark, sf_dir, "documents")), PII_KINDS, "added", by_start=False)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return lm_scores(_table(spark, sf_dir, "documents"), held_out)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_piece_coding": op4_piece_coding,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_secrets": op7_secrets,
    "op8_shards": op8_shards,
    "op9_decontamination": op9_decontamination,
    "op10_personal_data": op10_personal_data,
    "op11_lm_scores": op11_lm_scores,
    "op12_ranked_search": op12_ranked_search,
    "op13_manifest": op13_manifest,
}

SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM placed WHERE rank <= 5
    """,
    "op12_ranked_search": RANK_SQL,
    "op13_manifest": manifest_sql(),
}
