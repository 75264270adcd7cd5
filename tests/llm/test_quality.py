import random
import re
from collections import Counter

from tidemark.llm.quality import digest, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    found, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if found[x] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_measures_and_verdict(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}é" for k in range(30)]
    junk = [f"{v}$$" for v in vocabulary]
    rows = [(k, " ".join(rng.choice(vocabulary if k % 5 else junk) + rng.choice(["", "", "\n", "\t", "\u000b\n"]) for _ in range(rng.choice([3, 9, 10, 30, 200])))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\n "), (None, rows[1][1]), (503, "a b c d e a b c d e f g h i j k"), (504, "same line of words\n" * 4), (505, "x" * 60_000), (506, "y " * 30_000), (507, "a b c"), (507, "a b c")]
    labels = [(k, int(k % 5 > 0)) for k in range(0, 120, 2)] + [(None, 1), (3, None), (4, 1)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, bucket int, w string").repartition(3)
    got = digest(quality(df, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(g)[:7] for g in got), key=key) == sorted(((r[0], *plain(r[1])) for r in rows), key=key)
    for g in got:
        if g.doc_id is not None and g.doc_id < 120 and not g.base_failed:
            assert g.kept == (g.doc_id % 5 > 0)
        assert not (g.base_failed and g.kept)


def test_empty_and_unlabelled(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    assert [r.kept for r in digest(quality(docs, labels)).collect()] == [True]
    assert digest(quality(docs.limit(0), labels)).collect() == []


def test_clashing_columns_pass(spark):
    from tidemark.llm.quality import digest, keep_good

    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, "mine", 7)], "doc_id long, text string, Measured string, kept int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in keep_good(df, labels).collect()] == [(1, text, "mine", 7)]
    found = quality(df, labels)
    assert found.columns == ["doc_id", "text", "Measured", "kept", "measured_"]
    assert digest(found).first().n_words == 30
