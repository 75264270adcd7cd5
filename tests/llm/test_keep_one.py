import random

from tidemark.llm.simhash import keep_one


def sets(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)}


def test_stage_links_by_five_word_jaccard(spark):
    rng = random.Random(31)
    texts = [None, "", " ", "one two", "One  two", "one"]
    for n in (6, 12, 60, 60, 150, 400):
        w = [f"w{rng.randrange(500)}" for _ in range(n)]
        texts += [" ".join(w), " ".join(w).upper()]
        for changes in (1, 1, 2, 3, 5, 8):
            v = list(w)
            for at in rng.sample(range(n), min(n, max(1, changes * n // 150))):
                v[at] = "zz"
            texts += [" ".join(v), " ".join([*w, "end"])]
    rows = [(k * 7 % 1009, t, 1) for k, t in enumerate(texts)] + [(None, texts[6], 1), (7, texts[1], 1)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own, links = [sets(t) for _, t, _ in rows], 0
    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if len(a & b) * 5 >= len(a | b) * 4:
                links += a != b
                root[find(i)] = find(j)
    assert links > 20
    first = {}
    for k, (d, _, _) in enumerate(rows):
        place = (d is not None, d or 0)
        first[find(k)] = min(first.get(find(k), place), place)
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(3)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted(first.values())
