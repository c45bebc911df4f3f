import hashlib
import re
from collections import Counter

import pytest

from splitfold.llm import decontaminate, rules
from splitfold.llm.queries import ORACLE, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_duckdb(name, spark, sf_dir):
    assert_same(QUERIES[name], ORACLE[name], spark, sf_dir)


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_features(spark):
    eight = "a b c d e f g h "
    texts = [None, "", " \n\t", eight, eight * 2, eight * 3 + "x", "q " * 30, eight + "z z z " + eight, "l1\nl1\n\nl1 \nl1\r\nÉ#|\x0b\x1c", " ".join(map(str, range(5000))) + " " + " ".join(map(str, range(40, 60)))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, _other string")
    for r in rules.judged(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.judged(df.limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_work(spark):
    df = spark.range(100).selectExpr("id", "id % 2 = 0 AS half", "id % 10 = 0 AS tenth")
    from pyspark.sql import functions as F

    costly, cheap = rules.Rule("costly", F.col("half"), F.lit(100.0)), rules.Rule("cheap", F.col("tenth"), F.lit(1.0))
    assert [r.name for r in rules.order(df, [costly, cheap])] == ["cheap", "costly"]
    first = df.select(rules.cascade([cheap, costly]).alias("r")).groupBy("r").count().collect()
    assert {r.r: r["count"] for r in first} == {"cheap": 10, "costly": 40, None: 50}
    assert [r.name for r in rules.order(df.limit(0), [costly, cheap])] == ["costly", "cheap"]


def test_costs_are_measured_and_rejections_conditional(spark):
    from pyspark.sql import functions as F

    df = spark.range(300).selectExpr("id", "id % 2 = 0 AS half", "id % 2 = 0 OR id = 1 AS more", "id % 10 = 1 AS tenth", "repeat('ab ', 3000) AS text").checkpoint()
    slow = rules.Rule("slow", F.col("half") & (F.length(F.regexp_replace("text", "(a|b)+ ", "x")) > 0))
    assert [r.name for r in rules.order(df, [slow, rules.Rule("quick", F.col("half"))])][0] == "quick"
    one = F.lit(1.0)
    chosen = rules.order(df, [rules.Rule("half", F.col("half"), one), rules.Rule("more", F.col("more"), one), rules.Rule("tenth", F.col("tenth"), one)])
    assert [r.name for r in chosen] == ["more", "tenth", "half"]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination_by_brute_force(spark):
    long_item = " ".join(f"w{k}" for k in range(20))
    items = [(1, long_item), (2, "Short Item"), (10, long_item), (3, None), (4, "..."), (None, "secret phrase"), (5, "aa aa aa")]
    docs = [(1, "x " + long_item.upper() + " y"), (2, "short, ITEM! short item"), (3, None), (4, ""), (5, " ".join(f"w{k}" for k in range(12))), (6, "aa aa aa aa b secret Phrase"), (7, "É short É item é"), (7, "short item"), (None, long_item[:60]), (8, "z " * 900 + "short item")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            iw = words(it)
            for win in [iw[k : k + 13] for k in range(max(1, len(iw) - 12))] if iw else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found |= {str(i)} if i is not None else set()
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_large_index_gives_the_same_rows(spark, monkeypatch):
    items = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(16))) for k in range(12)] + [(99, "the common words")]
    docs = [(k % 40, " ".join(f"w{(k * 7 + j) % 50}" for j in range(k % 30)) + " the" * (k % 4) + (" the common words" if k % 5 == 0 else "")) for k in range(120)] + [(1, None), (None, ""), (3, "the " * 2000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = docs.select(decontaminate.row_key().alias("key"), "doc_id", decontaminate.words(docs.text).alias("w")).selectExpr("key", "doc_id", "cast(size(w) AS bigint) AS n_words", "w")
        index = decontaminate.prefixes(base.select("w"), decontaminate.windows(items)[0])
        plan = decontaminate._met(base, index)._jdf.queryExecution().executedPlan().toString()
        # Words are dealt by token and salt without the array of their document's words.
        assert "hashpartitioning(token" in plan and sorted(map(tuple, decontaminate.contamination(docs, items).collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, token string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).first()[:4] == (1, 2, 0, 0)
    assert decontaminate.contamination(docs.limit(0), none).count() == 0
    assert decontaminate.clean(docs, none).columns == docs.columns


def test_clean_rows_stay_whose_id_a_contaminated_row_shares(spark):
    items = spark.createDataFrame([(1, "secret benchmark phrase")], "item_id long, text string")
    rows = [(1, "secret benchmark phrase"), (1, "plain words"), (None, "a secret benchmark phrase"), (None, "other words"), (None, None), (1, "plain words")]
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
