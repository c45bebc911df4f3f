import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from splitfold.llm import langid, quality, toxicity
from splitfold.llm.common import held_out
from splitfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_accuracy_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in table("documents")}
    got = [r for r in QUERIES["op10_language"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)])
def test_accuracy_on_held_out_rows(spark, name, label, least):
    label_of = {r["doc_id"]: r[label] for r in table("labels")}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    got = [r for r in rows if r.held_out and r.doc_id in label_of]
    assert sum(r.predicted == label_of[r.doc_id] for r in got) >= least * len(got)


def test_matcher_by_brute_force():
    import itertools

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    terms, stems = ["abcab", "bacca", "cab", "aabbcc"], ["bbb"]
    m = toxicity.Matcher(terms, stems)
    for n in range(1, 8):
        for w in map("".join, itertools.product("abc", repeat=n)):
            best = 3 if w.startswith("bbb") else 1 if w in terms else 2 if any(len(t) >= 5 and distance(w, t) <= 1 for t in terms) else 0
            assert m.match(w) == best, w


def test_quotation_counts_less_than_abuse():
    s = toxicity.Scorer(toxicity.Model())
    abuse, quoted, edited = s.features("you are an idiot"), s.features('the word "idiot" was quoted'), s.features("what an idiiot")
    assert abuse[0] > 5 * quoted[0] > 0 and quoted[3] > 0 and edited[1] > 0 and s.features(None) == [0.0] * 5


ODD = [(1, None, None), (2, "", "en"), (2, "12 34", "en"), (None, "x " * 50_000, "fr"), (5, "Hello there my friend", "en"), (5, "Hello there my friend", "en")]


def test_models_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(5, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    for d, y in ((docs, labels), (docs.limit(0), labels.limit(0)), (docs, labels.limit(0))):
        n = d.count()
        m = langid.train(d)
        out = d.select("text", langid.predict("text", m).alias("r")).collect()
        assert len(out) == n and all(r.r.lang_pred == "und" for r in out if not r.text or r.text == "12 34")
        out = d.select(toxicity.score("text", toxicity.train(d, y)).alias("r")).collect()
        assert len(out) == n and all(0 <= r.r.score <= 1 for r in out)
        out = d.select(quality.score("text", quality.train(d, y)).alias("r")).collect()
        assert len(out) == n and all(0 <= r.r.score <= 1 for r in out)


def test_repeated_rows_leave_samples_as_large(spark):
    from splitfold.llm.common import sample_of_each

    once = spark.range(400).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', 'b') AS c")
    many = once.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(60))))
    for rows in (once, many.drop("again")):
        got = sample_of_each(rows, "c", 50, "s").groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).collect()
        assert sorted(map(tuple, got)) == [("a", 50, 50), ("b", 50, 50)]
    assert sample_of_each(once, "c", 1000, "s").count() == 400


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(9)
    names = [f"l{k:03d}" for k in range(300)]
    alphabets = {n: [chr(0x400 + int(x)) for x in rng.integers(0, 4000, 12)] for n in names}
    say = lambda n: " ".join("".join(rng.choice(alphabets[n], 5)) for _ in range(6))
    rows = [(k, say(names[k % 300]), names[k % 300]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == names
    got = df.select("lang", langid.predict("text", model).alias("r")).collect()
    assert len({r.r.lang_pred for r in got}) > 290 and sum(r.r.lang_pred == r.lang for r in got) > 0.95 * len(got)


def test_sparse_logits_equal_dense_ones():
    rng = np.random.default_rng(1)
    w = np.where(rng.random((50, 7)) < 0.3, rng.normal(size=(50, 7)), 0)
    m = langid.sparse(list("abcdefg"), np.ones(50), w, np.arange(7.0))
    f, x = np.array([0, 3, 17, 49]), rng.random(4)
    assert np.allclose(m.logits(f, x), x @ w[f] + np.arange(7), atol=1e-5)


def test_tfidf_and_a_step_of_ftrl_by_hand(spark):
    texts = ["aab", "ab", "b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    idf = langid.inverse_frequencies(df)
    grams = lambda t: {(" " + t + " ")[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)}
    f, n = langid.counts("aab")
    assert n.sum() == 5 + 4 + 3 and len(f) == len(grams("aab"))
    shared = sum("a" in grams(t) for t in texts)
    assert np.isclose(sorted(set(idf[f].round(9)))[0], np.log(4 / 4) + 1) and np.isclose(np.log(4 / (1 + shared)) + 1, idf[f]).any()
    x = langid.tfidf(f, n, idf)
    assert np.isclose((x * x).sum(), 1) and np.allclose(x / x[0], (1 + np.log(n)) * idf[f] / ((1 + np.log(n[0])) * idf[f[0]]))
    was, langid.EPOCHS = langid.EPOCHS, 1
    try:
        w, bias = langid.ftrl([(np.array([4]), np.array([1.0]), 1)], 2)
    finally:
        langid.EPOCHS = was
    g = np.array([0.5, -0.5])  # softmax of zeros less the label
    z = g - np.abs(g) / langid.ALPHA * 0
    want = -(z - np.sign(z) * langid.L1) / ((langid.BETA + np.abs(g)) / langid.ALPHA + langid.L2)
    assert np.allclose(w[4], want) and np.allclose(bias, want) and not np.delete(w, 4, 0).any()


def test_risk_is_not_negative_and_its_gradient_is_right():
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1.5, 1, (400, 3)), np.vstack([rng.normal(1.5, 1, (300, 3)), rng.normal(-1.5, 1, (700, 3))])
    model = quality.fit(positive, unlabelled)
    assert 0.2 < model.prior < 0.45
    assert (model.scores(rng.normal(1.5, 1, (500, 3))) > 0.5).mean() > 0.85 and (model.scores(rng.normal(-1.5, 1, (500, 3))) < 0.5).mean() > 0.85


def test_quality_features_by_hand():
    f = dict(zip(quality.FEATURES, quality.features("Ab ab ab!\n\nx 12 #|\nx 12 #|"), strict=True))
    assert np.isclose(f["words"], np.log1p(9)) and np.isclose(f["length"], (2 + 2 + 3 + 2 * 5) / 9) and np.isclose(f["upper"], 1 / 17)
    assert np.isclose(f["digits"], 4 / 17) and np.isclose(f["top"], 2 / 9) and np.isclose(f["dup_lines"], 1 / 3) and f["again"] == 0
    assert np.isclose(f["bangs"], np.log1p(100 / 9)) and np.isclose(f["bars"], np.log1p(200 / 9)) and np.isclose(f["symbols"], np.log1p(200 / 9))


@pytest.mark.parametrize("name, label, recall, precision", [("op2_quality", "quality", 0.95, 0.95), ("op6_toxicity", "toxic", 0.85, 0.9)])
def test_recall_and_precision_on_held_out_rows(spark, name, label, recall, precision):
    sf = "/root/testdata/sf0.1"
    label_of = {r["doc_id"]: r[label] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = [(r.predicted, label_of[r.doc_id]) for r in QUERIES[name](spark, sf).where("held_out").collect() if r.doc_id in label_of]
    hit, said, true = sum(p == y == 1 for p, y in got), sum(p for p, _ in got), sum(y == 1 for _, y in got)
    assert true > 50 and hit >= recall * true and hit >= precision * said


def test_long_texts_have_the_same_ngrams_in_parts(monkeypatch):
    text = "".join(chr(97 + k * k % 23) for k in range(1000))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    parts = langid.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_terms_come_before_stems():
    m = toxicity.Matcher(["moron", "idiot"], ["moro", "idi"])
    assert [m.match(w) for w in ("moron", "moroon", "morose", "idiot", "idxot", "idiocy", "idle")] == [1, 2, 3, 1, 2, 3, 0]


def learned_from(spark, insults, n=240):
    """A model of n texts of which a quarter has an insult in turn; a third of the others has a harmless word near a term."""
    plain = "the sun rose over a calm river and boats went slowly by while people talked about old books".split()
    text = lambda k: " ".join(plain[(7 * k + j) % len(plain)] for j in range(60))
    toxic = [(k, f"{text(k)} {insults[k // 4 % len(insults)]} {insults[k // 4 * 5 % len(insults)]}", 1) for k in range(0, n, 4)]
    clean = [(k, text(k) + (" oron" if k % 3 == 0 else ""), 0) for k in range(n) if k % 4]
    rows = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    model = toxicity.train(rows.drop("toxic"), rows.drop("text"))
    scorer = toxicity.Scorer(model)
    return model, lambda words: float(scorer.score(np.array([scorer.features(f"{text(1)} {words} {text(2)}")]))[0])


def test_altered_insults_are_toxic(spark):
    model, score = learned_from(spark, ["idiot", "moron", "pathetic", "grumphaz"])
    weights = dict(zip(toxicity.FEATURES, model.weights, strict=True))
    assert weights["abuse"] > 0 and weights["edited"] > 0 and "grumphaz" in model.words and "oron" in model.harmless
    assert not any(w.startswith(s) for w in toxicity.TERMS for s in model.stems)
    for words in ("idxot", "moxon", "paxhetic", "grumphaz", "grxmphaz", "idiot"):
        assert score(f"{words} and {words}") >= 0.5, words
    assert score("oron") < 0.5 and score("") < 0.5


def test_stems_need_several_endings(spark):
    model, score = learned_from(spark, ["pathetic", "worthless", "idiotically", "grumphaz", "grumphel", "grumphio", "grumphuy"])
    assert model.stems == ["grumph"]
    for words in ("path", "worth", "pathology", "idiomatic", "the path was worth it"):
        assert score(words) < 0.5, words
    assert score("grumphorn and grumphest") >= 0.5
