import random

import corpus_pipeline
from tidemark.llm.simhash import fingerprint


def test_stage_links_by_simhash(spark, tmp_path):
    rng = random.Random(41)
    texts = [None, "", " ", "one two", "One  two", "one"]
    for n in (60, 150, 400, 900):
        w = [f"w{rng.randrange(500)}" for _ in range(n)]
        for changes in (0, 1, 1, 2, 3, 8):
            v = list(w)
            for at in rng.sample(range(n), changes):
                v[at] = "zz"
            texts += [" ".join(v), " ".join(v).upper()]
    rows = [(k * 7 % 1009, t, "own") for k, t in enumerate(texts)] + [(None, texts[6], "own"), (7, texts[1], "own"), (14, texts[30], "own")]
    prints, root = [fingerprint(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3:
                links += a != b
                root[find(i)] = find(j)
    assert links > 5
    first = {}
    for k, (d, _, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), (True, 10**9)), (d is not None, d or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, __th string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got.collect()) == sorted(first.values())
