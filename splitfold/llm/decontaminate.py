"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window of k item words is contained in a document only if all its k one-word shingles are, so the necessary prefix of its
shingles in order of rarity is its rarest one. Rarity is counted over all documents. The join meets each document word with
the windows whose rarest word it is; the word's place in the window then bounds where the window can start (positional
bound) and whether it fits into the document (length bound), and the words there are compared with the window's.

A small index is broadcast, and windows are compared where the words are. A large one is shuffled: then single words meet it,
each dealt to SALTS tasks, and what passes both bounds meets the words of its document, which are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitfold.llm.common import columns_of, cut, fresh, row_key

WINDOW = 13
#: Counted bytes up to which a table is broadcast; beyond, both sides are shuffled, and each word is dealt to so many tasks.
BROADCAST_BYTES, SALTS = 32 << 20, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD, -1), "")


def _small(df: DataFrame, column: Column) -> bool:
    """Whether the bytes of column, which are counted, are few enough to broadcast df."""
    return (df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame, column: Column) -> DataFrame:
    return F.broadcast(df) if _small(df, column) else df


def windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win) and which items have them (wid, item_id); items without words have none."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))))
    all_windows = items.select("item_id", "w", starts.alias("i")).select("item_id", F.slice("w", F.col("i"), WINDOW).alias("win"))
    grouped = cut(all_windows.groupBy("win").agg(F.collect_set("item_id").alias("items")).withColumn("wid", F.monotonically_increasing_id()))
    return grouped.select("wid", "win"), grouped.select("wid", F.explode("items").alias("item_id"))


def prefixes(docs_words: DataFrame, wins: DataFrame) -> DataFrame:
    """(token, wid, win, offset, k): each window under its rarest word over all documents (w), ties by the word itself."""
    tokens = wins.select("wid", "win", F.posexplode("win").alias("offset", "token"))
    vocabulary = tokens.select("token").distinct()
    seen = docs_words.select(F.explode("w").alias("token")).join(_sized(vocabulary, F.col("token")), "token").groupBy("token").agg(F.count("*").alias("n"))
    counted = tokens.join(_sized(cut(seen), F.col("token")), "token", "left").select("wid", "win", "token", "offset", F.coalesce("n", F.lit(0)).alias("n"))
    rarest = counted.groupBy("wid").agg(F.min_by(F.struct("token", "win", "offset"), F.struct("n", "token", "offset")).alias("x"))
    return rarest.select("x.token", "wid", "x.win", "x.offset", F.size("x.win").alias("k"))


def _met(base: DataFrame, index: DataFrame) -> DataFrame:
    """Of base (key, doc_id, n_words, w): (key, doc_id, n_words, start, k, wid), a row for each occurrence of a window and one
    for each row of base, whose start, k and wid are null."""
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("k") <= F.col("n_words"))
    same = F.slice("w", start + 1, F.col("k")) == F.col("win")
    own, place = ["key", "doc_id", "n_words"], [start.alias("start"), "k", "wid"]
    if _small(index, F.concat_ws(" ", "win")):
        end = F.array(F.lit(None).cast("string"))  # which no word equals, so each row has one row more
        words = base.select(*own, "w", F.posexplode(F.concat("w", end)).alias("pos", "token"))
        return words.join(F.broadcast(index), "token", "left").where(F.isnull("token") | (fits & same)).select(*own, *place)
    words = base.select("key", "n_words", F.posexplode("w").alias("pos", "token")).withColumn("salt", F.col("pos") % SALTS)
    dealt = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    may = words.join(dealt, ["token", "salt"]).where(fits).select("key", *place, "win").distinct()
    hits = may.join(base.select(*own, "w").dropDuplicates(["key"]), "key").where(F.slice("w", F.col("start") + 1, F.col("k")) == F.col("win"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("k", "int"), ("wid", "bigint"))]
    return base.select(*own, *none).unionAll(hits.select(*own, "start", "k", "wid"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs (doc_id, text).

    A window is 13 consecutive words of an item, or all words of a shorter item. n_hit counts the words inside any occurrence
    of a window, n_items the items that have an occurring window; contaminated: at least a twentieth of the words is hit.
    Null and empty texts have no words and are clean; an item without words has no window; an item with a null item_id
    counts in n_hit but isn't listed; repeated rows are returned as often as they occur; other columns are ignored.
    """
    return _judged(docs, benchmark).drop("key")


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with the key of each row, which tells an id and its text."""
    w = words(F.col("text"))
    base = docs.select(row_key().alias("key"), "doc_id", w.alias("w")).select("key", "doc_id", F.size("w").cast("long").alias("n_words"), "w")
    wins, members = windows(benchmark)
    met = cut(_met(base, cut(prefixes(docs.select(w.alias("w")), wins))))
    hits = met.where("wid IS NOT NULL").select("key", "start", "k", "wid").distinct()
    spans = hits.groupBy("key", "start").agg(F.max("k").alias("k"))
    before = F.max(F.col("start") + F.col("k")).over(W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), F.col("start") + F.col("k") - F.greatest("start", F.coalesce(before, F.lit(0))))
    counted = spans.withColumn("n", covered).groupBy("key").agg(F.sum("n").alias("n_hit"))
    items = hits.select("key", "wid").distinct().join(members, "wid").select("key", "item_id").distinct()
    items = items.groupBy("key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    found = counted.join(items, "key", "left")
    out = met.where("wid IS NULL").select("key", "doc_id", "n_words").join(found, "key", "left")
    n, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("key", "doc_id", "n_words", n.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.0) -> DataFrame:
    """docs without rows in which windows cover any word and at least least_share of the words.

    A benchmark passage in a long text is a small share of it and leaks all the same, so any hit rejects by default. The verdict is
    of id and text together: a clean row stays though it shares its id with one that goes. All columns stay, whatever their names;
    null and empty texts stay; repeated rows share their fate.
    """
    key = fresh("key")
    dirty = _judged(docs.select("doc_id", "text"), benchmark).where((F.col("n_hit") > 0) & (F.col("n_hit") >= least_share * F.col("n_words")))
    dirty = cut(dirty.select(F.col("key").alias(key)).distinct())
    return docs.withColumn(key, row_key()).join(_sized(dirty, F.col(key)), key, "left_anti").select(*columns_of(docs))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS k FROM ip),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp),
hit AS (SELECT doc_id, i, dg.k AS k, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN nh ON dw.doc_id = nh.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
