"""Quality rules as a short-circuit cascade, with DataFrame operations only.

A rule rejects a document by a condition. On a sample, each rule's cost is measured, by the time it takes over the sample's rows,
or taken from the work that the rule states. The cascade is ordered greedily: next comes the rule that rejects most, of the rows
that no rule before it rejects, per cost. For each document it stops at the first rule that rejects. The order changes the
time it takes, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import columns_of, cut, fresh

#: Rows on which costs and rejections are estimated, about, and how often a rule is timed on each; they decide the order only.
SAMPLE_ROWS, TIMES = 1000, 20
SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    work: Column | None = None  # measured if not given


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once for each row however often body uses it, also inside its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(w: Column) -> Column:
    """Words of w that lie in windows of WINDOW words found twice or more in w. Windows are told apart by 64-bit hashes."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda k: F.xxhash64(*(F.get(w, k + n) for n in range(WINDOW))))
    same = lambda s, x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
    twice = lambda s: F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["k"])
    step = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    covered = lambda p: F.aggregate(step(p), F.lit(0), lambda a, x: a + x)
    ordered = lambda h: F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
    found = lambda h: let(ordered(h), lambda s: let(F.sort_array(twice(s)), covered))
    return F.when(F.size(w) > WINDOW, let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), found(h)).otherwise(F.lit(0)))).otherwise(F.lit(0))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long); null counts as empty.
    Columns of docs with these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.array_remove(F.split(text, SPACE, -1), ""), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.concat_ws("", w)).alias("chars"), _repeated(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    w, x, s = fresh("words"), fresh("lines"), fresh("symbols")
    df = docs.withColumns({w: of_words, x: of_lines, s: F.length(F.regexp_replace(text, SYMBOL, ""))})
    made = {"n_words": F.col(f"{w}.n"), "word_chars": F.col(f"{w}.chars"), "n_symbols": F.col(s), "n_lines": F.col(f"{x}.n"), "n_dup_lines": F.col(f"{x}.n") - F.col(f"{x}.distinct"), "n_repeat_words": F.col(f"{w}.repeat")}
    return df.select(*(c for n, c in zip(docs.columns, columns_of(docs), strict=True) if n not in made), *(c.cast("long").alias(k) for k, c in made.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules over features() and the text; each fails only documents that are plainly junk."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    lower = F.length(F.regexp_replace(text, "[^a-z]+", ""))
    return [
        Rule("symbols", 5 * F.col("n_symbols") > F.col("n_words")),
        Rule("duplicate_lines", (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("word_length", (F.col("word_chars") > 25 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
        Rule("exclamations", 2 * F.regexp_count(text, F.lit("!")) > F.col("n_words")),
        Rule("shouting", upper > 2 * lower),
    ]


def order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """rules by estimated rejections per cost on the rows of sample, which must be few; ties keep their order."""
    if len(rules) < 2:
        return list(rules)
    stated = [F.lit(0.0) if r.work is None else r.work for r in rules]
    asked = [f for k, r in enumerate(rules) for f in (F.coalesce(r.rejects, F.lit(False)).alias(f"s{k}"), stated[k].cast("double").alias(f"w{k}"))]
    rows = sample.select(*asked).collect()
    again = sample.withColumn(fresh("time"), F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(rule: Rule) -> float:
        began = time.perf_counter()
        again.agg(F.count(F.when(rule.rejects, 1))).collect()
        return time.perf_counter() - began

    measured = [r for r in rules if r.work is None]
    if measured:
        seconds(measured[0])  # compiles what all share
    cost = {k: seconds(r) if r.work is None else sum(row[f"w{k}"] or 0.0 for row in rows) / max(1, len(rows)) for k, r in enumerate(rules)}
    left, out = list(range(len(rules))), []
    while left:
        best = min(left, key=lambda k: -sum(row[f"s{k}"] for row in rows) / max(cost[k], 1e-9))
        rows = [row for row in rows if not row[f"s{best}"]]
        left.remove(best)
        out.append(rules[best])
    return out


def sampled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """About SAMPLE_ROWS rows of all parts of docs, with features(), without those that fail the base checks; written to the
    shared folder. Features are computed for drawn rows only."""
    total = docs.count()
    drawn = docs.select(text_col).sample(min(1.0, SAMPLE_ROWS / max(1, total)), 7)
    return cut(features(drawn, text_col).where(~base_failed()).coalesce(8))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """docs with features(), base_failed and kept: false if the base checks fail, else whether no rule rejects.

    Null and empty texts have no words and fail the base checks; repeated rows are judged alike; an empty table gives no
    rows. Columns of docs named like the features, base_failed or kept are replaced; the others stay, whatever their names.
    """
    rules = default_rules(text_col) if rules is None else rules
    with_features = features(docs, text_col)
    rules = order(sampled(docs, text_col), rules) if len(rules) > 1 else rules
    df = with_features.withColumn("base_failed", base_failed())
    return df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(rules).isNull()))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS q FROM r) GROUP BY doc_id),
f AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (5 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars > 25 * n_words OR word_chars < 2 * n_words
    OR 2 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words OR length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(regexp_replace(t, '[^a-z]+', '', 'g'))) AS kept FROM b
"""
