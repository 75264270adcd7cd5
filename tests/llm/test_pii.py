import hashlib
import random
import re

from tidemark.llm.pii import KINDS, detect, digest

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(x[::2]) + sum(sum(divmod(2 * v, 10)) for v in x[1::2])


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d or "1") % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "a@b", "x@y.z_d@e.f.g", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "1234", "+1 (363) 555-6578", "+44 20 7946 0958", "++1", "+1((((", " ", " ", "\n", "é", "日", ",", "-", "99", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "ssn "]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(400)]
    rows += [(900, None), (901, ""), (None, "mail a@b.cd"), (902, "1" * 50_000), (903, "a" * 50_000), (904, "a." * 20_000 + "@b" + ".c" * 20_000), (905, "+1" + "(" * 40_000), (906, "1 " * 20_000), (906, "1 " * 20_000)]
    df = spark.createDataFrame([(*r, "v", 3) for r in rows], "doc_id long, text string, spans string, value int").repartition(4)
    got = digest(detect(df)).collect()
    want = []
    for doc_id, text in rows:
        spans = plain(text)
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(base.encode()).hexdigest()))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(g)[:6] for g in got), key=key) == sorted(want, key=key)


def test_checksums_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 here", "GB82 WEST 1234 5698 7654 33", "my SSN is 123-45-6789", "part 123-45-6789 of", "call +1 363 555 6578", "DE89370400440532013000."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(KINDS[s.kind], s.start, s.end, s.score) for s in r.spans] for r in detect(df).collect()}
    assert got[0] == [("iban", 5, 32, 1.3)]
    assert got[1] == []
    assert got[2] == [("national_id", 10, 21, 0.7)]
    assert got[3] == []
    assert got[4] == [("phone", 5, 20, 1.0)]
    assert got[5] == [("iban", 0, 22, 0.9)]
    assert digest(detect(df.limit(0))).collect() == []


def test_account_numbers_end_where_their_check_passes(spark):
    texts = ["pay GB82 WEST 1234 5698 7654 32 BIC CODE", "DE89370400440532013000 EUR 500", "NL91 ABNA 0417 1643 00 NL91 ABNA 0417 1643 01", "XX00 0000 0000 0000 0000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if KINDS[s.kind] == "iban"] for r in detect(df).collect()}
    assert got == {0: ["GB82 WEST 1234 5698 7654 32"], 1: ["DE89370400440532013000"], 2: ["NL91 ABNA 0417 1643 00"], 3: []}


def test_a_text_of_many_spans(spark):
    n = 32_000
    df = spark.createDataFrame([(1, "10.0.0.1, " * n)], "doc_id long, text string")
    spans = detect(df).first().spans
    assert [(s.start, s.end) for s in spans] == [(10 * k, 10 * k + 8) for k in range(n)]
