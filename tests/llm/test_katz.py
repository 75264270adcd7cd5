import math
import random
import zlib
from collections import Counter

import pytest

from tidemark.llm.katz import K, discounts, score


def plain(rows):
    texts = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, (t or "").encode().lower().split()) for d, t in rows]
    uni, bi = Counter(), Counter()
    for _, held, w in texts:
        if not held:
            uni.update([*w, None])
            bi.update(zip([0, *w], [*w, None], strict=True))
    n, v = sum(uni.values()), len(uni)
    of = Counter(bi.values())
    d = discounts([of[r] for r in range(1, K + 2)])
    after = {}
    for (a, b), r in bi.items():
        after.setdefault(a, {})[b] = r
    p1 = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(a, b):
        own = after.get(a)
        if not own:
            return p1(b)
        c = sum(own.values()) + 0.5
        dis = lambda r: (d[r - 1] if r <= K else 1) * r / c
        if b in own:
            return dis(own[b])
        return (1 - sum(map(dis, own.values()))) / (1 - sum(map(p1, own))) * p1(b)

    for a in [*list(after)[:5], 0]:
        assert sum(p(a, b) for b in uni) + p(a, "never") == pytest.approx(1)
    return [(doc, held, len(w) + 1, sum(uni[x] > 0 for x in [*w, None]), n, sum(math.log10(p1(x)) for x in [*w, None]), sum(math.log10(p(a, b)) for a, b in zip([0, *w], [*w, None], strict=True))) for doc, held, w in texts]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [rng.choice("abcdé") * rng.randint(1, 4) + str(k % 9) for k in range(40)]
    rows = []
    for k in range(80):
        w, text = rng.choice(vocabulary), []
        for _ in range(rng.randint(0, 60)):
            text.append(w)
            w = vocabulary[(vocabulary.index(w) * 3 + rng.randint(0, 3)) % 40]
        rows.append((k, " ".join(text)))
    rows += [(None, "aa1 B2"), (7, None), (200, ""), (201, "Never seen"), (202, rows[3][1]), (203, "x y"), (203, "x y"), (204, "a " * 3000)]
    got = sorted(score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(3)).collect(), key=str)
    want = sorted(plain(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    got = sorted(got, key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert tuple(g)[5:] == pytest.approx(w[5:], rel=1e-9)
    turns = score(spark.createDataFrame(rows, "doc_id long, text string"), most=20).collect()
    turns = sorted(turns, key=lambda r: (str(r[0]), r[2], r[5]))
    assert [tuple(r)[:5] for r in turns] == [tuple(r)[:5] for r in got]
    assert [r.score for r in turns] == pytest.approx([r.score for r in got], rel=1e-9)
    held = [(g.score, g.base_score) for g in got if g.held_out and g.n_tokens > 5]
    assert held and sum(a for a, _ in held) > sum(b for _, b in held)


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert score(spark.createDataFrame([], schema)).collect() == []
    one = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    (row,) = score(spark.createDataFrame([(one, "a b")], schema)).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.score == pytest.approx(row.base_score) == pytest.approx(0)
