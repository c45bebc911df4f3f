import hashlib

import numpy as np
import pytest

from splitfold.llm import substrings


def brute(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows():
    rng = np.random.default_rng(4)
    text = lambda n, k: "".join(rng.choice(list("ab cdé"[:k]), n))
    passage = text(130, 6)
    docs = [(100 + k, text(60, 6) + passage[k % 40 : 60 + k] + text(40, 6)) for k in range(40)]
    docs += [(7, "x" * 200), (8, "x" * 120), (9, ""), (10, None), (11, passage[:50]), (12, "é" + passage[:50]), (11, passage + "!"), (30, "In. " * 90), (31, "yIn. In. " * 50), (32, text(3000, 2)), (33, text(3000, 2)), (34, "\x00" * 90 + passage), (35, passage[20:49]), (36, "\x00" * 70)]
    return docs + [docs[0]]


@pytest.mark.parametrize("buffer", [substrings.BUFFER, 300])
def test_by_brute_force(spark, monkeypatch, buffer):
    if buffer != substrings.BUFFER:  # parts of long texts: seen by the workers through a default of the sampled step
        monkeypatch.setattr(substrings, "BUFFER", buffer)
        parts = [(h[2], len(r)) for r, _, heads in substrings._buffers([(1, 2, b"z" * 1000)]) for h in heads]
        assert len(parts) > 2
        raw = np.random.default_rng(1).integers(97, 100, 2000).astype(np.uint8)
        at, first, last, _ = substrings.cover(raw, np.array([2000]))
        assert first[0] == 0 and last[-1] == 1950 and (first[1:] == last[:-1] + 1).all() and (at >= last).all() and (at - first < 31).all()
        return
    docs = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS data")
    got = sorted(map(tuple, substrings.digests(df).collect()))
    assert got == brute([(d, (t or "").encode()) for d, t in docs])


def test_null_ids_and_empty_tables(spark):
    text = "".join(chr(97 + k * k % 19) for k in range(90))
    df = spark.createDataFrame([(None, text), (3, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substrings.digests(df).collect()) == [(-1, 90), (-1, 90), (3, 0)]
    assert sorted((r.doc_id or -1, len(r.kept)) for r in substrings.kept_text(df).collect()) == [(-1, 0), (-1, 0), (3, 90)]
    assert substrings.digests(df.limit(0)).count() == 0


def test_pieces_are_kept_apart_when_hashes_collide(monkeypatch):
    rng = np.random.default_rng(5)
    around = rng.integers(0, 255, (6, substrings.PIECE)).astype(np.uint8)
    around[3] = around[1]
    docs, packed = np.c_[np.arange(6), np.zeros(6, np.int64)], np.arange(6) << 10 | 5 << 5 | 2
    packed[4] |= 1
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(substrings, "_mixed", lambda h: h * np.uint64(0))
        whole, content = substrings._contents(around, packed)
        doc, key, at, content, pieces = substrings._opened([memoryview(substrings._gathered(docs, packed, content, whole))] * 2)
        assert doc.tolist() == [*range(6)] * 2 and at.tolist() == [*range(6)] * 2 and not key.any()
        assert len(pieces) == (12 if collide else 10)
        assert (pieces[content][:, : substrings.PIECE] == np.r_[around, around]).all()
        assert (pieces[content][:, substrings.PIECE + 1] == np.r_[packed, packed] % 32).all()


def test_query_by_brute_force(spark, sf_dir):
    from splitfold.llm.queries import QUERIES

    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op3_substrings"](spark, sf_dir).collect())) == brute(docs)


def test_a_hot_string_and_texts_of_several_parts(spark):
    """One passage in a third of all documents, with equal and with different surroundings; two texts longer than a part."""
    rng = np.random.default_rng(8)
    text = lambda n: "".join(map(chr, rng.integers(97, 117, n)))
    passage, long = text(70), text(substrings.BUFFER + 4000)
    docs = [(k, (passage + text(90) if k % 6 else "same before " + passage + " same after") if k % 3 == 0 else text(120)) for k in range(900)]
    docs += [(2000, long), (2001, "x" + long[3000:]), (2002, long[-300:])]
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = {r[0]: r[1:] for r in brute([(d, t.encode()) for d, t in docs if d < 2000])}
    assert {d: r for d, r in got.items() if d < 2000} == want
    assert got[2000][1:3] == (0, 0) and got[2001][1:3] == (len(long) - 3000, 1) and got[2002][1:3] == (300, 1)
