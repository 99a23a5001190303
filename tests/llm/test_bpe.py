import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, queries, token_counts

TEXTS = ["", "Hello world, it's  fine.\n\n  Done", "a" * 40000, "ab1" * 9000, " " * 5000 + "x", "x" + "\n" * 60000 + " y", "é ü  ñ" * 4000, "!!''s don't'" * 3000, "y" + " " * 4000]


def _enc():
    return bpe.encoding(bpe.rank_path(), bpe.split_pattern())


@pytest.mark.parametrize("text", TEXTS)
def test_cut_texts_encode_as_whole(text):
    enc = _enc()
    got = bpe.encode_text(enc, text, limit=700)
    if len(text) < 20000 or "\n" * 100 not in text:
        assert got == enc.encode_ordinary(text)
    assert enc.decode_bytes(got) == text.encode()


def test_long_white_space_runs_split_like_the_pattern():
    enc = _enc()
    for n in (2500, 6000):
        for tail in ("", "z", "!", "9", "\tq"):
            text = "w" + " " * n + tail
            assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)
    assert enc.decode_bytes(bpe.encode_text(enc, " " * 1_000_000 + "a")) == (" " * 1_000_000 + "a").encode()


def test_encode_decode_frames(spark):
    df = spark.createDataFrame([(1, "Hi there"), (2, None), (None, "x"), (1, "Hi there")], "doc_id long, text string").withColumn("n_tokens", F.lit(7))
    out = bpe.decode(bpe.encode(df)).collect()
    assert sorted(bytes(r.decoded).decode() for r in out) == ["", "Hi there", "Hi there", "x"]
    assert {r.n_tokens for r in out} == {7}
    assert [list(r.token_ids) for r in out if r.text is None] == [[]]
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("token_ids", F.lit(1)))
    assert bpe.encode(df.limit(0)).count() == 0
    both = bpe.round_trip(df).collect()
    assert all(bytes(r.decoded) == _enc().decode_bytes(list(r.token_ids)) for r in both)


def test_histogram_against_brute_force(spark):
    texts = ["a b c", "", None, "word " * 1500, "word " * 1500, "x", "1 2 3 4"]
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    enc = _enc()
    lens = [len(enc.encode_ordinary(t or "")) for t in texts]
    rows = token_counts.token_length_histogram(df).collect()
    assert sum(r.n_docs for r in rows) == len(texts)
    for r in rows:
        n = r.n_tokens
        assert r.docs_ge == sum(x >= n for x in lens)
        assert r.tokens_ge == sum(x for x in lens if x >= n)
        assert r.truncated_tokens == sum(min(x, n) for x in lens)
        assert abs(r["rank"] - sum(x <= n for x in lens) / len(lens)) < 1e-12
    sums = token_counts.token_length_histogram(df)
    for r in token_counts.at_limits(sums, [0, 3, 10**6]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in lens)
        assert r.docs_fitting == sum(x <= r.context_limit for x in lens)
    q = {r.share: r.n_tokens for r in token_counts.quantile(sums, [0.5, 1.0]).collect()}
    assert q[0.5] == sorted(lens)[3] and q[1.0] == max(lens)
    by = token_counts.token_length_histogram(df, by=("source",)).collect()
    for r in by:
        own = [x for i, x in enumerate(lens) if (i % 2 == 1) == (r.source == "s")]
        assert r.total_docs == len(own) and r.total_tokens == sum(own)
    assert token_counts.token_length_histogram(df.limit(0)).count() == 0


def test_registered_digests(spark, tmp_path):
    """op8: counts and digests of whole texts against one ``encode_ordinary`` call each."""
    texts = [None, "", "Hi there, it's 12:30\n\n  now", "é ü ñ " * 50, "a1b2 " * 9000, " " * 3000 + "x", "日本語 text 😀"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_byte_bpe(spark, str(tmp_path)).collect()}
    enc, sha = _enc(), lambda b: hashlib.sha256(b).hexdigest()
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    clash = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, n_docs long, block long")
    assert token_counts.token_length_histogram(clash, by=("doc_id",)).count() == 1
