import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from splitfold.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def as_lists(encoded):
    return [np.frombuffer(x, "<u4").tolist() for x in encoded]


def ids(text):
    return np.frombuffer(bpe.replay(PATH, P.PATTERN).encode([text])[0], "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert bpe.replay(PATH, P.PATTERN).decode([np.array(ids(text), "<u4").tobytes()]) == [text.encode()]


def test_hard_texts():
    for text in ("", "a" * 3000, "ab" * 700, " \n\n  x \t", "<|endoftext|> 's 'LL don't", "é" * 50, "日本語テキスト 123456789", "\U0001f600" * 20, "\x00\x1c\x85    x"):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_lower_ranks_that_a_merge_makes_come_first():
    """Pieces merged together give what each gives alone."""
    replay = bpe.Replay(PATH, P.PATTERN)
    pieces = [w.encode() for w in ("aaaaaaaa", "ththereere", " banananana", "xyzzyxyzzy", "------====", "eauxeauxionion")]
    assert replay.replay(pieces) == [replay.replay([p])[0] for p in pieces] == as_lists(replay.together(pieces))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60), min_size=1, max_size=40), st.sampled_from([1, 7, 1 << 12]))
def test_both_ways_of_replay_agree(pieces, step):
    replay, was = bpe.replay(PATH, P.PATTERN), bpe.STEP
    try:
        bpe.STEP = step
        assert as_lists(replay.together(pieces)) == replay.replay(pieces)
    finally:
        bpe.STEP = was


def test_texts_of_megabytes_in_a_batch():
    rng = np.random.default_rng(6)
    many = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 12)))) for _ in range(200_000))
    texts = ["", "x" * 300_000, many, "short", "", "ab" * 400 + " " + "\n" * 999, ""]
    replay = bpe.replay(PATH, P.PATTERN)
    got = replay.encode(texts)
    assert as_lists(got) == [LIBRARY.encode_ordinary(t) for t in texts]
    assert replay.decode(got) == [t.encode() for t in texts]


def test_query(spark, sf_dir):
    from splitfold.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op9_bpe"](spark, sf_dir).collect()}
    for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        want = np.array(LIBRARY.encode_ordinary(r["text"]), "<u4")
        assert got[r["doc_id"]].n_tokens == len(want)
        assert got[r["doc_id"]].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert got[r["doc_id"]].decoded_sha256 == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "x", None), (None, "x", None)], "doc_id long, text string, n_tokens long")
    rows = df.select("doc_id", bpe.digests("text", PATH, P.PATTERN).alias("r"), bpe.encoded("text", PATH, P.PATTERN).alias("e")).collect()
    assert sorted(r.r.n_tokens for r in rows) == [0, 0, 1, 1] and sorted(r.e.decoded for r in rows) == ["", "", "x", "x"]
    assert df.limit(0).select(bpe.digests("text", PATH, P.PATTERN)).count() == 0
