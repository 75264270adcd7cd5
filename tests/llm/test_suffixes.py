import hashlib
import random

from tidemark.llm.suffixes import SuffixIndexFamily, digest, remove_repeats, repeated


def brute(rows, length):
    seen, out, done = set(), [], {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc_id, text in order:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        done[doc_id, text] = (doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    for row in rows:
        out.append(done[row])
    return out


def corpus(rng):
    say = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [say(n) for n in (60, 99, 100, 101, 150, 400)]
    rows = [(None, passages[5]), (500, None), (501, ""), (502, "x" * 3000), (503, "ab" * 700), (504, passages[5]), (504, passages[5])]
    for k in range(60):
        text = "".join(rng.choice([say(rng.randint(0, 200)), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))
        rows.append((k * 7 % 61, text))
    copy = rows[20][1]
    return rows + [(300 + k, copy[: 50 + k] + "#" + copy[50 + k :]) for k in range(25)]


def test_against_brute_force(spark):
    key = lambda r: tuple((v is not None, v) for v in r)
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, h int").repartition(4)
        got = digest(remove_repeats(df)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 100), key=key)


def test_hot_anchors_are_dealt_out(spark):
    rows = [(k, "boilerplate of a hot line that is common to many, " * 2 + f"{k % 7} tail {k % 5}" * 9) for k in range(60)]
    import zlib

    df = spark.createDataFrame([(k, zlib.crc32(t.encode()), t) for k, t in rows], "doc_id long, crc long, text string")
    spans = {r.doc_id: {b for s in r.spans for b in range(s.a, s.b)} for r in repeated(df, hot=8).collect()}
    assert {k: len(v) for k, v in spans.items() if v} == {r[0]: r[2] for r in brute(rows, 100) if r[2]}


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()) == 1


def test_family_levels():
    rng = random.Random(3)
    family, seen = SuffixIndexFamily(4, base=8), set()
    for _ in range(40):
        batch = ["".join(rng.choice("ab") for _ in range(9)).encode() for _ in range(3)]
        for run, got in zip(batch, family.add(batch), strict=True):
            want = set()
            for s in range(6):
                if run[s : s + 4] in seen:
                    want.add(s)
                seen.add(run[s : s + 4])
            assert got == want
    assert sum(map(len, family.levels.values())) == len(seen)
