"""Personal data by weak supervision, with DataFrame operations only.

Candidates are the matches of base patterns and of wider ones. Labelers of three kinds vote on each candidate (yes, no or
abstain): regex and check-sum labelers, gazetteers, and the words around it. Expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is; its posteriors train a naive Bayes span classifier over votes and shape,
which decides on the candidates that no base rule accepts. Base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from splitfold.llm.common import columns_of, cut, fresh, row_key

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. They match as [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on do, but a run of
# characters is tried once, from its start or from where the last match ended, and never given back, so long runs stay linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, of which only the classifier accepts matches.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+",
    "phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must have for a pattern to be tried.
HINT = {("email", True): "@", ("email", False): "at", ("phone", True): "+", ("ip", False): ":"}
CONTEXT = 48
# Gazetteers and context words.
TLDS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "uk", "us", "eu", "ch", "at", "it", "nl", "be", "pl", "ca", "au", "jp", "cn", "in", "br", "mx", "ru"]
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NEAR = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|contacto|kontakt|courriel|correo|write|reach)\b",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|address|adresse|login|from)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|karte|carte|tarjeta|pay|paid)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono|sms|whatsapp)\b",
}
AGAINST = r"(?i)\b(?:version|v|release|build|isbn|issn|doi|order|invoice|sku|part|serial|page|pages|figure|table|id)\W{0,3}$"
LABELERS = ["regex", "gazetteer", "near", "against", "edges"]
#: Rounds of expectation-maximisation, and the weight of the prior counts.
ROUNDS, SMOOTH, MOST_PRIOR = 25, 1.0, 1.0


def _matches(text: Column, kind: str, base: bool) -> Column:
    """Structs of each match of a pattern, with the length of the text between it and the one before, and its surroundings."""
    pattern = (BASE if base else WIDE)[kind]
    hint = HINT.get((kind, base))
    holds = text.contains(hint) if hint else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    found = F.when(holds, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    between = F.when(holds, F.split(text, pattern, -1)).otherwise(none)
    made = lambda m, g: F.transform(
        m, lambda x, k: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), k.alias("k"), x.alias("match"), F.length(F.get(g, k)).alias("gap"), F.right(F.get(g, k), F.lit(CONTEXT)).alias("left"), F.substring(F.get(g, k + 1), 1, CONTEXT).alias("right"))
    )
    both = F.struct(found.alias("m"), between.alias("g"))
    return F.element_at(F.transform(F.array(both), lambda b: F.when(F.size(b["m"]) > 0, made(b["m"], b["g"])).otherwise(made(none, none))), 1)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)
    value = lambda k: F.substring(digits, n - k, F.lit(1)).cast("int")
    add = lambda a, k: a + F.when(k % 2 == 0, value(k)).otherwise(value(k) * 2 - F.when(value(k) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    """Whether a base match passes its kind's check."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    parts = F.split("match", r"\.")
    small = F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    checks = F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", small).when(F.col("kind") == "card", card).otherwise(F.length(digits).between(10, 15))
    return F.col("base") & checks


def _votes() -> Column:
    """The labelers' votes as a string of digits: 0 abstains, 1 yes, 2 no."""
    kind = F.col("kind")
    regex = F.when(F.col("valid"), 1).when(F.col("base"), 2).otherwise(0)
    end = F.lower(F.element_at(F.split("match", r"[.\])\x20]+"), -1))
    place = F.when(kind == "email", F.when(end.isin(TLDS), 1).otherwise(2)).when(kind == "phone", F.when(F.col("match").rlike(CALLING), 1).otherwise(0)).when(kind == "card", F.when(F.col("match").rlike("^[3-6]"), 1).otherwise(2)).otherwise(F.when(F.col("match").rlike(r"^0\."), 2).otherwise(0))
    near = F.lit(0)
    for k, pattern in NEAR.items():
        near = F.when((kind == k) & F.concat("left", F.lit(" "), "right").rlike(pattern), 1).otherwise(near)
    against = F.when(F.col("left").rlike(AGAINST), 2).otherwise(0)
    edges = F.when(F.col("left").rlike(r"[A-Za-z0-9_/=-]$") | F.col("right").rlike(r"^[A-Za-z0-9_/=]"), 2).otherwise(1)
    return F.concat(*(x.cast("string") for x in (regex, place, near, against, edges)))


def candidates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row of each candidate span (rid, doc_id, kind, start, end, valid, votes, shape) and one with a null kind of each
    document; start and end count code points, end exclusive. rid numbers the rows of docs; written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit(None).cast("struct<kind:string,base:boolean,k:int,match:string,gap:int,left:string,right:string>")
    found = F.concat(F.array(none), *(_matches(text, k, True) for k in BASE), *(_matches(text, k, False) for k in WIDE))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *(keep or []), found.alias("all")).select("rid", "doc_id", *(keep or []), F.explode("all").alias("c")).select("rid", "doc_id", *(keep or []), "c.*")
    size = F.length("match")
    upto = W.partitionBy("rid", "kind", "base").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + size).over(upto)
    rows = rows.withColumn("valid", F.when(F.col("kind").isNotNull(), _valid())).withColumn("votes", F.when(F.col("kind").isNotNull(), _votes()))
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    shape = F.concat(F.least(digits / 4, F.lit(5)).cast("int").cast("string"), F.least(size / 8, F.lit(5)).cast("int").cast("string"))
    rows = rows.select("rid", "doc_id", *(keep or []), "kind", "base", "valid", "votes", shape.alias("shape"), (end - size).cast("long").alias("start"), end.cast("long").alias("end"))
    # A span that no base rule accepts counts only where it overlaps none of its kind that one does.
    order = W.partitionBy("rid", "kind").orderBy("start", F.desc("valid"))
    last = F.max(F.when(F.col("valid"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(F.col("valid"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(last, F.lit(-1)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    return cut(rows.withColumn("free", F.col("valid") | F.coalesce(free, F.lit(True))).where("kind IS NULL OR free").drop("free", "base"))


def _bounded(odds: Column) -> Column:
    """Prior log odds, at most MOST_PRIOR either way: the candidates that must be judged are rarer than those that base rules accept."""
    return F.greatest(F.lit(-MOST_PRIOR), F.least(F.lit(MOST_PRIOR), odds))


def reliabilities(spans: DataFrame) -> DataFrame:
    """(kind, votes, p): the posterior of each vote pattern by expectation-maximisation, in one row of each kind at first.

    A kind has at most 3**5 patterns, so its row is bounded whatever the input.
    """
    counted = spans.where("kind IS NOT NULL").groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    grouped = counted.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("all"))
    k = len(LABELERS)
    # State: log odds of the prior and, for each labeler and vote, log P(vote | yes) - log P(vote | no). It starts from trust.
    start = F.struct(F.lit(0.0).alias("prior"), F.array(*(F.lit([0.0, 1.0, -1.0][v]) for _ in range(k) for v in range(3))).alias("w"))
    slot = lambda votes, i: 3 * i + F.substring(votes, i + 1, 1).cast("int")

    def posterior(state: Column, votes: Column) -> Column:
        z = state["prior"]
        for i in range(k):
            z = z + F.get(state["w"], slot(votes, i))
        return 1 / (1 + F.exp(-z))

    def step(state: Column, _: Column) -> Column:
        soft = F.transform(F.col("all"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * posterior(state, x["votes"])).alias("yes")))

        def updated(s: Column) -> Column:
            total = lambda f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
            weights = []
            for i in range(k):
                for v in range(3):
                    has = lambda x, i=i, v=v: F.substring(x["votes"], i + 1, 1) == str(v)
                    yes = total(lambda x, has=has: F.when(has(x), x["yes"]).otherwise(0.0))
                    every = total(lambda x, has=has: F.when(has(x), x["n"]).otherwise(0.0))
                    weights.append(F.struct((yes + SMOOTH * (1 + (v == 1))).alias("y"), (every - yes + SMOOTH * (1 + (v == 2))).alias("n")))
            yes, every = total(lambda x: x["yes"]), total(lambda x: x["n"])
            # An abstention is no evidence.
            w = [F.lit(0.0) if j % 3 == 0 else F.log(c["y"] / (yes + 4 * SMOOTH)) - F.log(c["n"] / (every - yes + 4 * SMOOTH)) for j, c in enumerate(weights)]
            return F.struct(_bounded(F.log((yes + SMOOTH) / (every - yes + SMOOTH))).alias("prior"), F.array(*w).alias("w"))

        return F.element_at(F.transform(F.array(soft), updated), 1)

    done = grouped.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step))
    return done.select("kind", F.explode("all").alias("x"), "state").select("kind", "x.votes", posterior(F.col("state"), F.col("x.votes")).alias("p"))


def classifier(spans: DataFrame, posteriors: DataFrame) -> DataFrame:
    """(kind, votes, shape, score): naive Bayes log odds of each feature pattern, trained on the posteriors as soft labels.

    There are at most 4 * 3**5 * 36 patterns, whatever the input.
    """
    patterns = spans.where("kind IS NOT NULL").groupBy("kind", "votes", "shape").agg(F.count("*").cast("double").alias("n"))
    soft = cut(patterns.join(F.broadcast(posteriors), ["kind", "votes"]).coalesce(1))
    features = F.array(*(F.concat(F.lit(f"{i}:"), F.substring("votes", i + 1, 1)) for i in range(len(LABELERS))), F.concat(F.lit("d:"), F.substring("shape", 1, 1)), F.concat(F.lit("l:"), F.substring("shape", 2, 1)))
    long = soft.select("kind", "votes", "shape", "n", "p", F.explode(F.filter(features, lambda f: ~f.rlike("^[0-9]:0$"))).alias("f"))
    totals = soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("ty"), F.sum(F.col("n") * (1 - F.col("p"))).alias("tn"))
    each = long.groupBy("kind", "f").agg(F.sum(F.col("n") * F.col("p")).alias("y"), F.sum(F.col("n") * (1 - F.col("p"))).alias("m"))
    odds = each.join(totals, "kind").select("kind", "f", (F.log((F.col("y") + SMOOTH) / (F.col("ty") + 3 * SMOOTH)) - F.log((F.col("m") + SMOOTH) / (F.col("tn") + 3 * SMOOTH))).alias("o"))
    prior = totals.select("kind", _bounded(F.log((F.col("ty") + SMOOTH) / (F.col("tn") + SMOOTH))).alias("prior"))
    return long.join(odds, ["kind", "f"]).groupBy("kind", "votes", "shape").agg(F.sum("o").alias("o")).join(prior, "kind").select("kind", "votes", "shape", (F.col("o") + F.col("prior")).alias("score"))


def accepted(spans: DataFrame) -> DataFrame:
    """The rows of candidates() whose span is valid or that the trained classifier accepts, and those without a kind.

    A span the strict regex labeler rejects is never accepted: it matched a base pattern and failed that pattern's check.
    """
    # Both tables have a bounded number of rows, so one task each is enough to write them.
    model = F.broadcast(cut(classifier(spans, cut(reliabilities(spans).coalesce(1))).coalesce(1)))
    judged = spans.join(model, ["kind", "votes", "shape"], "left")
    return judged.where("kind IS NULL OR valid OR (score > 0 AND substring(votes, 1, 1) <> '2')")


def detect(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) with its spans: array of (kind, start, end, base) by start, then kind as in KINDS.

    Null and empty texts have no spans; repeated rows are returned as often as they occur; columns but doc_id and those in
    keep are left out.
    """
    spans = accepted(candidates(docs, keep))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct("start", number.alias("number"), "end", "kind", F.col("valid").alias("base")))
    return spans.groupBy("rid", "doc_id", *(keep or [])).agg(F.sort_array(F.collect_list(one)).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of docs."""
    found = detect(docs)
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; of spans that overlap, the first names the place.

    n_chars, where docs has it, is counted anew. Rows are matched by id and text together, so rows that share an id are masked
    each by its own spans. A null text stays null; all rows and columns stay, whatever the columns' names.
    """
    key, spans = fresh("key"), fresh("spans")
    keyed = docs.withColumn(key, row_key())
    found = detect(docs.select("doc_id", "text", row_key().alias("key")), ["key"]).where(F.size("spans") > 0)
    found = found.groupBy(F.col("key").alias(key)).agg(F.first("spans").alias(spans))
    joined = keyed.join(found, key, "left")
    text = F.col("text")
    piece = lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.array_append(a["out"], F.concat(F.substring(text, a["at"] + 1, s["start"].cast("int") - a["at"]), F.lit("<"), s["kind"], F.lit(">"))).alias("out"), s["end"].cast("int").alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"].cast("int")).alias("at")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(spans, start, piece, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    out = joined.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(masked)).select(*columns_of(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
