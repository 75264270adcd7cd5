import random

import public_tokenizers as P

from tidemark.llm.counting import CountTree, Encoder, count_tokens, revision

PATH = P.path("byte_bpe_50k.tiktoken")


def test_edits_match_whole_encoding():
    rng, encoder = random.Random(6), Encoder(PATH, P.PATTERN)
    whole = lambda t: [(len(p), encoder.count(p)) for p in encoder.pieces(t)]
    parts = ["the", " ", "  ", "\n", "\n\n ", "'", "ll", "'ve", "'s", "42", "é", "ß,", "!!", "word", "\t", "日本", "l"]
    say = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for size in (0, 1, 3, 20, 400, 3000):
        for _ in range(12):
            text = say(size)
            tree = CountTree(encoder.pieces(text), encoder)
            for _ in range(12):
                start = rng.randint(0, len(text))
                end = min(len(text), start + rng.choice([0, 0, 1, 2, 9, 300]))
                text, n = tree.edit(text, start, end, say(rng.choice([0, 1, 2, 5, 200])))
                flat = [x for a, b in tree.blocks for x in zip(a, b, strict=True)]
                assert flat == whole(text)
                assert tree.tokens == sum(b for _, b in flat) == len(encoder.core.encode_ordinary(text))
    text = say(30_000)
    assert CountTree(encoder.pieces(text), encoder).edit(text, 9000, 9003, "x")[1] < 20


def test_rows(spark):
    rows = [(1, "A text, with words.\n\nAnd 'll more of them."), (2, None), (None, ""), (3, "x"), (3, "x"), (4, "ab " * 20_000)]
    got = count_tokens(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int"), PATH, P.PATTERN).collect()
    encoder = Encoder(PATH, P.PATTERN).core
    assert len(got) == len(rows)
    for g, (doc_id, text) in zip(got, rows, strict=True):
        after = text or ""
        assert (g.doc_id, g.n_tokens) == (doc_id, len(encoder.encode_ordinary(after)))
        for start, end, new in revision(after):
            after = after[:start] + new + after[end:]
        assert g.n_tokens_edited == len(encoder.encode_ordinary(after)) and g.n_reencoded < 60
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
