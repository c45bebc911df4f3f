import numpy as np
import xxhash

from splitfold.llm import simhash
from splitfold.llm.graph import components

DOCS = "doc_id long, text string, fp long, component_id string"


def brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one Two", "One two THREE", "É é \x0b a\x1cb c\x85d e", "word " * 40_000, " ".join(map(str, range(300)))):
        assert simhash.fingerprint(None if text is None else text.encode()) == brute(text)


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = classes(pairs, {x for p in pairs for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(12):
            fps.add(c ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 4))}))
    fps = np.array(sorted(fps), np.uint64)
    close = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 3]]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in close}
    assert classes(got, map(int, fps)) == classes(close, map(int, fps))


def test_large_lists_are_enumerated(monkeypatch):
    rng = np.random.default_rng(3)
    places = (0, 1, 2, 3, 4)
    fps = np.unique(rng.integers(0, 1 << 24, 700, dtype=np.uint64) << np.uint64(40))
    fps = np.unique(np.r_[fps, fps[:200] ^ np.uint64(7 << 41)])
    compared = list(simhash._forest(fps, places))
    monkeypatch.setattr(simhash, "ENUMERATE", 1)
    looked_up = list(simhash._forest(fps, places))
    nodes = [int(x) for x in fps]
    as_ints = lambda edges: [(int(a), int(b)) for a, b in edges]
    assert classes(as_ints(compared), nodes) == classes(as_ints(looked_up), nodes)
    assert all(bin(a ^ b).count("1") <= 3 for a, b in as_ints(looked_up))


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(9, text, 0, "x"), (4, text, 0, "x"), (4, text, 0, "x"), (7, None, 0, "x"), (8, "", 0, "x"), (None, " ", 0, "x"), (2, "alone here today", 0, None)]
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, 7), (2, 2), (4, 4), (4, 4), (7, 7), (8, 7), (9, 4)]
    kept = simhash.representatives(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7] and kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_representatives_of_shared_and_null_ids(spark):
    texts = [" ".join(f"{name}{k}" for k in range(200)) for name in "abcdefg"]
    near = texts[5] + " more"
    assert bin(simhash.fingerprint(texts[5].encode()) ^ simhash.fingerprint(near.encode())).count("1") <= 3
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (3, texts[3]), (3, texts[4]), (1, texts[5]), (2, near), (2, texts[6])]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, texts.index(r.text)) for r in kept) == [(-1, 0), (-1, 1), (-1, 2), (1, 5), (2, 6), (3, 3), (3, 4)]
