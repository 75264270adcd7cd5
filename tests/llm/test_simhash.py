import random

import numpy as np
from xxhash import xxh64_intdigest

from tidemark.llm.components import components
from tidemark.llm.simhash import digest, fingerprint, near_duplicates, near_edges


def plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, errors):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= errors:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_documents_against_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice(["The", "ß", "ab", "c1", "Éa", "of"]) for _ in range(rng.choice([1, 2, 3, 40, 400]))] for _ in range(25)]
    texts = [None, "", " \t\n", "one", "one", "one two", "x" * 50_000]
    for w in base:
        texts.append(" ".join(w))
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            texts.append("\n".join(v))
    rows = [(k * 3 % 137, t, "f", 1) for k, t in enumerate(texts)] + [(None, "one", "f", 1)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in digest(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, root int").repartition(3))).collect()}
    fps = [plain(r[1]) for r in rows]
    assert fps == [fingerprint(r[1]) for r in rows]
    of = groups(fps, 3)
    least = {}
    for r, g in zip(rows, of, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    assert got == {(r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, of, strict=True)}


def test_edges_of_dense_groups(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 4)
    values = {0, 1, 2**63}
    for c in centre.tolist():
        for _ in range(150):
            v = c
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    want = groups(values, 3)
    for most in (4096, 20):
        edges = near_edges(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, most)
        got = {r.node: r.root for r in components(edges).collect()}
        pairs = {}
        for v, g in zip(signed, want, strict=True):
            pairs.setdefault(g, set()).add(got.get(v, v))
        assert all(len(x) == 1 for x in pairs.values())
        assert len({next(iter(x)) for x in pairs.values()}) == len(pairs)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (None, 1), (1, 2), (2, 5), (2, 5)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}
    assert components(edges.limit(0)).collect() == []
