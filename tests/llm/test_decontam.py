import random
import re

from tidemark.llm.decontam import decontaminate, digest, sha_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        found, hit, owners = WORD.findall(low(text)), set(), set()
        for item, passage in items:
            own = WORD.findall(low(passage))
            for at in range(max(1, len(own) - size + 1) if own else 0):
                w = own[at : at + size]
                for k in range(len(found) - len(w) + 1):
                    if found[k : k + len(w)] == w:
                        hit |= set(range(k, k + len(w)))
                        owners |= {str(item)} - {"None"}
        out.append((doc_id, len(found), len(hit), len(owners), sha_of(list(owners)), bool(hit)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["a", "b", "Çé", "b2", "the"]) + rng.choice(["", ",", "!\n"]) for _ in range(n))
    items = [(k, say(rng.choice([3, 9, 10, 14, 25]))) for k in range(12)] + [(12, ""), (13, None), (None, "a b"), (14, "zz"), (14, "zz yy")]
    docs = [(k, say(rng.randint(0, 60))) for k in range(60)] + [(60, None), (61, ""), (None, items[3][1].upper()), (62, "ZZ-yy"), (62, "ZZ-yy"), (63, "b " * 5000 + items[4][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, hits int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(brute(docs, items), key=key)
    for most in (8_000_000, 40):
        for r in decontaminate(d, b, most_bytes=most).collect():
            places = [m.span() for m in WORD.finditer(low(r.text))]
            runs = []
            for k in r.hits:
                if runs and runs[-1][2] == k - 1:
                    runs[-1][1:] = [places[k][1], k]
                else:
                    runs.append([*places[k], k])
            assert [(x.start, x.end) for x in r.spans] == [tuple(x[:2]) for x in runs]
        assert sorted((tuple(r) for r in digest(decontaminate(d, b, most_bytes=most)).collect()), key=key) == want


def test_empty(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in digest(decontaminate(d, b)).collect()] == [(1, 2, 0, 0)]
    assert digest(decontaminate(d.limit(0), b)).collect() == []
