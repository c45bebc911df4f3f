import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splitfold.llm import bpe, simhash, toxicity
from splitfold.llm.common import table

LAST = corpus_pipeline.STAGES[-1][0]


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0.5 * n < docs.count() <= n
        assert docs.select("doc_id").distinct().count() == docs.count()
        assert docs.columns == columns or name == LAST
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_run_by_brute_force(spark, sf_dir):
    """Each stage's decision made once more by plain Python; the toxicity and PII models are the operators' own."""
    import public_tokenizers as P

    from splitfold.llm import pii
    from tests.llm.test_rules_and_decontamination import words
    from tests.llm.test_simhash import brute, classes

    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.Scorer(toxicity.train(docs, table(spark, sf_dir, "labels")))
    import numpy as np

    left = {r.doc_id: r.text for r in docs.collect() if scorer.score(np.array([scorer.features(r.text)]))[0] < 0.5}
    fps = {d: brute(t) for d, t in left.items()}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3]
    left = {d: left[d] for d in set(classes(links, fps).values())}
    windows = set()
    for r in table(spark, sf_dir, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    left = {d: t for d, t in left.items() if not hit(words(t))}
    masked = pii.redacted(docs.where(F.col("doc_id").isin(list(left)))).collect()
    assert {r.doc_id for r in masked} == set(left)
    replay = bpe.replay(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = {r.doc_id: len(replay.encode([r.text])[0]) // 4 for r in masked}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties, repeated rows and columns named like those that operators might use."""
    root = tmp_path_factory.mktemp("odd")
    plain = "the river was calm and boats went slowly by while people talked about old books "
    texts = [(1, None), (2, ""), (2, ""), (None, None), (None, "mail me@example.org now"), (3, plain * 40_000), (4, plain), (4, plain), (5, "call +1 (415) 555-1234 " + plain), (6, "a secret benchmark phrase of the test"), (7, "idiot moron you idiot")]
    names = ["_id", "_n", "_hash", "_w", "_l", "_s", "_key", "_spans", "_score_of_text", "key", "fp", "token", "rid", "spans", "kind", "n_words", "root", "n"]
    rows = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(k).alias(x) for k, x in enumerate(names)), F.lit(0).alias("a.b"))
    for name, df in {"documents": rows, "labels": spark.createDataFrame([(7, None, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, "secret benchmark phrase"), (2, None), (None, "")], "item_id long, text string")}.items():
        df.write.parquet(f"{root}/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/none/{name}.parquet")
    return str(root)


#: Of the stage alone: the ids that stay, null as 0.
STAY = {
    "toxicity": [0, 0, 1, 2, 2, 3, 4, 4, 5, 6],
    "simhash_near_dedup": [0, 1, 3, 4, 5, 6, 7],
    "benchmark_decontamination": [0, 0, 1, 2, 2, 3, 4, 4, 5, 7],
    "pii": [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 7],
    "byte_level_bpe": [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 7],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_of_each_stage(spark, odd_tables, name, stage):
    docs = table(spark, odd_tables, "documents")
    out = stage(spark, docs, odd_tables)
    assert out.columns == docs.columns or name == LAST
    got = out.collect()
    ids = sorted(r.doc_id or 0 for r in got)
    near = simhash.fingerprint(("the river was calm and boats went slowly by while people talked about old books " * 40_000).encode()) ^ simhash.fingerprint(b"the river was calm and boats went slowly by while people talked about old books ")
    want = STAY[name] if name != "simhash_near_dedup" or bin(near).count("1") > 3 else [d for d in STAY[name] if d != 4]
    assert ids == want
    if name == "pii":
        texts = {r.doc_id: r.text for r in got if r.text}
        assert "<email>" in texts[None] and "<phone>" in texts[5] and next(r.n_chars for r in got if r.doc_id == 5) == len(texts[5])
        assert [r["a.b"] for r in got] == [0] * len(got) and {r["_spans"] for r in got} == {7}
    none = stage(spark, table(spark, f"{odd_tables}/none", "documents"), f"{odd_tables}/none")
    assert none.count() == 0 and (none.columns == docs.columns or name == LAST)
