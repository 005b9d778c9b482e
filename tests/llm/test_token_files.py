import base64
import os
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stintwise.llm.token_files import count_tokens, write_token_files
from stintwise.session import shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EOD = 50256


def brute(ids, eod):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == eod:
            out.append((start, k - start, True))
            start = k + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.fixture
def split_bytes(spark):
    """Sets how many bytes of a file a task reads at most."""

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def found_in(spark, path, eod, dtype):
    got = {}
    for r in count_tokens(spark, str(path), eod, dtype).orderBy("file", "nth").collect():
        mine = got.setdefault(os.path.basename(r.file), [])
        assert r.nth == len(mine)
        mine.append((r.start, r.n_tokens, r.closed))
    return got


@pytest.mark.parametrize(("eod", "split"), [(7, 50), (7, 1 << 20), (0, 50), (0x5007, 64)])
@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_blocks_are_stitched(spark, tmp_path, split_bytes, eod, split, dtype):
    rng = random.Random(split)
    want = {}
    # Tokens that have the id's bytes, or halves of them, on other alignments.
    near = [eod << 8 & 0xFFFF, eod >> 8, (eod << 8 | eod >> 8) & 0xFFFF, 0x0707, 0x0007, 0x0700]
    for n, size in enumerate([0, 1, 2, 50, 200, 333]):
        ids = [rng.choice([eod, eod, rng.choice(near), rng.choice(near), rng.randrange(60_000)]) for _ in range(size)] + ([eod] if n % 2 else [])
        np.array(ids, dtype).tofile(tmp_path / f"f{n}.bin")
        want[f"f{n}.bin"] = brute(ids, eod)
    want["f6.bin"] = brute([9] * 100, eod)
    np.array([9] * 100, dtype).tofile(tmp_path / "f6.bin")
    split_bytes(split)
    assert found_in(spark, tmp_path, eod, dtype) == {k: v for k, v in want.items() if v}


def test_a_file_is_read_by_several_tasks(spark, tmp_path, split_bytes):
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 60_000, 400_000).astype("<u2")
    ids[rng.random(len(ids)) < 0.01] = EOD
    ids.tofile(tmp_path / "one.bin")
    split_bytes(100_000)
    assert found_in(spark, tmp_path, EOD, "<u2") == {"one.bin": brute(ids.tolist(), EOD)}
    read = spark.read.option("lineSep", np.array([EOD], "<u2").tobytes().decode("latin-1")).option("encoding", "ISO-8859-1").text(str(tmp_path))
    assert read.rdd.getNumPartitions() >= 8


def test_many_empty_documents(spark, tmp_path):
    np.full(500_000, EOD, "<u2").tofile(tmp_path / "empty.bin")
    start = time.monotonic()
    got = count_tokens(spark, str(tmp_path), EOD).agg(F.count("*"), F.max("n_tokens"), F.sum("nth"), F.sum("start")).first()
    assert tuple(got) == (500_000, 0, 499_999 * 250_000, 499_999 * 250_000)
    assert time.monotonic() - start < 30


def test_a_file_that_ends_within_a_token(spark, tmp_path):
    (tmp_path / "cut.bin").write_bytes(np.full(10, EOD, "<u2").tobytes() + b"x")
    with pytest.raises(Exception, match="within a token"):
        count_tokens(spark, str(tmp_path), EOD).collect()


def test_written_files_hold_the_documents(spark, documents, odd_pairs):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = shared_dir(spark, "tokens")
    write_token_files(documents(odd_pairs), path, RANKS, public_tokenizers.PATTERN, EOD, docs_per_file=2)
    got = count_tokens(spark, path, EOD).collect()
    assert all(r.closed for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(encoder.encode_ordinary(t or "")) for _, t in odd_pairs)
    empty = shared_dir(spark, "tokens")
    write_token_files(documents(odd_pairs).limit(0), empty, RANKS, public_tokenizers.PATTERN, EOD)
    assert count_tokens(spark, empty, EOD).count() == 0


def test_a_taken_or_large_id_is_refused(documents):
    for eod in (5, 1 << 20):
        with pytest.raises(ValueError):
            write_token_files(documents([]), "unused", RANKS, public_tokenizers.PATTERN, eod)
