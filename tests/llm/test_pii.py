import hashlib
import re

from splitfold.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


TEXTS = [
    None, "", "x@y x@y.z,a.b@c.d%e@f.g", "1.2.3.4.5.6.7.8.9 300.1.1.1 1.2.3 01.002.0003.4 0.0.0.0", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+1 (555) 555-1234 +12 +1 2 +1+2 3 +33 1 23 45 67 89...", "a@" * 50 + "b.c", "é\U0001f600 me@x.org é 10.0.0.1@x.y", "9" * 5000, "a" * 200_000, "1.1.1." * 3000 + " me@example.com", "a@b" + ".c" * 4000, "+1" + " " * 50_000 + "x",
    "write me: foo.bar [at] example [dot] com", "call 415-555-1234 today", "version 415-555-1234x",
]


def test_base_spans_by_brute_force(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y")], "doc_id long, text string, kind string")
    got = pii.digests(df.select("doc_id", "text")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = base(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in want).encode()).hexdigest(), TEXTS[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in PATTERNS]
        assert {x[2] for x in want} <= set(r.spans.split(","))


def test_documents_by_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.digests(df).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in base(texts[r.doc_id])).encode()).hexdigest()


def test_learned_spans_and_masking(spark):
    many = [(100 + k, f"Please call +1 (415) 555-{1000 + k} or write to name{k}@mail.example.com now") for k in range(60)]
    extra = [(1, "my phone: call 415-555-1234 please"), (2, "order id 415-555-1234"), (3, None), (3, "é me@x.org é")]
    df = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in many + extra], "doc_id long, text string, n_chars long, source string")
    masked = {(r.doc_id, r.text): r for r in pii.redacted(df).collect()}
    assert (2, "order id 415-555-1234") in masked
    texts = sorted(t for i, t in masked if i == 1)
    assert texts == ["my phone: call <phone> please"] and (3, None) in masked and (3, "é <email> é") in masked
    assert masked[3, "é <email> é"].n_chars == 11 and len(masked) == len(many) + len(extra)
    assert pii.redacted(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_reliable_labelers(spark):
    rows = [("phone", "11101", 60), ("phone", "10001", 30), ("phone", "02022", 40), ("phone", "00002", 20)]
    spans = spark.createDataFrame([(k, v) for k, v, n in rows for _ in range(n)], "kind string, votes string")
    p = {r.votes: r.p for r in pii.reliabilities(spans).collect()}
    assert p["11101"] > 0.9 and p["10001"] > 0.5 and p["02022"] < 0.1
