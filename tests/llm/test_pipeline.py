import random

import corpus_pipeline
from tests.llm.test_decontam import brute
from tests.llm.test_keep_one import sets


def groups(texts):
    """Each text's group by the Jaccard similarity of five-word shingles."""
    own, root = [sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(texts))]


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(200)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(14), say(9)
    rows = []
    for k in range(80):
        text = "\n".join(say(rng.choice([12, 40])) for _ in range(rng.randint(1, 4)))
        if k % 10 == 0:
            text += "\n" + line
        if k % 13 == 0:
            text += "\nso: " + passage.upper() + "!"
        rows.append((k, text))
    rows += [(100, rows[5][1] + " end"), (101, rows[5][1]), (102, "junk$$ " * 40), (103, None), (104, "few words"), (None, say(50)), (105, rows[7][1]), (105, rows[7][1])]
    full = [(d, t, "en", "s", len(t or ""), "theirs") for d, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_dropped_lines string"
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/out{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == before.columns
            assert {r.n_dropped_lines for r in kept[name]} == {"theirs"}
    ids = lambda n: sorted((r.doc_id is not None, r.doc_id or 0) for r in kept[n])
    assert ids("quality_rules") == sorted((d is not None, d or 0) for d, _ in rows if d not in (102, 103, 104))
    texts = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert sum(line in t for t in texts.values()) == 1 and line in texts[0]
    assert 101 not in texts and 105 not in texts
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    own = [(r.doc_id, r.text) for r in kept["line_dedup"]]
    of = groups([t for _, t in own])
    first = {}
    for (d, _), g in zip(own, of, strict=True):
        first[g] = min(first.get(g, (True, 10**9)), (d is not None, d or 0))
    assert ids("near_dedup") == sorted(first.values())
    dirty = {b[0] for b in brute([(r.doc_id, r.text) for r in kept["near_dedup"]], [(1, passage)]) if b[-1]}
    assert dirty and ids("decontamination") == sorted((r.doc_id is not None, r.doc_id or 0) for r in kept["near_dedup"] if r.doc_id not in dirty)
    assert {r.doc_id for r in kept["best_fit_packing"]} == {r.doc_id for r in kept["decontamination"]}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in whole))) == sorted(map(str, (tuple(r)[:5] for r in kept["best_fit_packing"])))
