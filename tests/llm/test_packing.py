import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound, pack
from tidemark.llm.queries import word_tokenizer

SCHEMA = "text string, doc_id long, length string, `done` int"


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "an", "é", "ing", "42", "'s", ",", "ß", "ﬁ", "Σ", "İ", "é"]) for _ in range(rng.randint(1, 5)))
    made = [" ".join(word() for _ in range(rng.choice([1, 5, 300, 3000]))) for _ in range(60)]
    return [*made, "", None, "  \n ", made[0], made[0], "a<|endoftext|>b c", "one two", "x" * 30_000]


def test_pieces_match_the_tokenizer_and_fill_sequences(spark):
    rows = [(t, k if k else None, "x", 1) for k, t in enumerate(texts())]
    got = best_fit_packing(spark.createDataFrame(rows, SCHEMA).repartition(5), word_tokenizer()).collect()
    encoder = Tokenizer.from_file(word_tokenizer())
    want = []
    for text, doc_id, *_ in rows:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= lower_bound(np.array([w[3] for w in want]), 4096) + 1


@pytest.mark.parametrize("per_partition", [7, 40, 1000])
def test_exchange_places_every_piece_once(spark, per_partition):
    rng = random.Random(per_partition)
    rows = [(k, 0, 0, rng.choice([10, 33, 50, 51, 99, 100]), 0) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(df, 100, per_partition, 3).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 100


def test_empty(spark):
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), word_tokenizer()).collect() == []


def test_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.sort(rng.integers(1, 41, rng.integers(1, 60)))[::-1]
        *_, made = best_fit_decreasing(lengths, 40)
        assert lengths.sum() / 40 <= made and lower_bound(lengths, 40) <= made <= 1.3 * lower_bound(lengths, 40) + 1
    assert lower_bound(np.array([21, 21, 21]), 40) == 3
