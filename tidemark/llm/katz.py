"""Katz backoff scoring of whole texts with a word bigram model.

P(w|v) is d(r)·r/(c(v) + 1/2) for a bigram met r > 0 times in training, and
alpha(v)·P(w) for one never met; P(w) is the smoothed unigram model, d the
Good-Turing discount, and alpha(v) normalises exactly: what the discounts and
the half count of context v have freed, over the unigram mass of the words
never met after v. After a context that training lacks, P(w|v) is P(w).

The count tables are partitioned by the hash of the predicted word, so a
partition knows c(w), every r(v,w) and every occurrence of w. Words and pairs
with a large share of a partition's load are counted beforehand, over all
texts: such words are dealt by the pair, such pairs by the text, and their
counts are broadcast, a bounded number of them. The log of a
text's probability is a sum over its tokens, which the partitions take apart:

    per token        -log (c(v) + 1/2), which the partition of v adds for the token v
    met bigram       log r + log d(r)       (d is applied when all counts are known)
    unmet bigram     log (c(v) + 1/2) + log alpha(v) + log P(w)

so that only unmet bigrams, of held-out texts alone, are joined with alpha.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, checkpointed, released, shuffle_partitions

#: Counts up to this are discounted.
K = 5
#: Hashes of the two tokens that aren't words: words have no spaces.
START, END = " start", " end"
#: A word or pair is hot if it has over 1 / (HOT * partitions) of the tokens of a sample of SAMPLE texts at least, or SAMPLE_X a partition.
#: The sample only decides where tokens are dealt to; whatever it holds, all counts are those of all texts.
HOT, SAMPLE, SAMPLE_X = 8, 5_000, 25
#: Parts that a hot context's bigrams are dealt to when they meet its weight.
SALTS = 64


#: The arrays of a body: its words, the number of each, the tokens before them, their texts' places in the last (low and high half,
#: which pack better), the texts' numbers.
BODY = ("<u8", "<u4", "<u8", "<u2", "<u2", "<i8")


def hashed(token: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(token)


def held_out(doc_id: int | None) -> bool:
    """The remainder of crc32(doc_id as text) by 10 is 0; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Hashes(dict):
    """Hashes of words, remembered; begun anew when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = hashed(word)
        return value


def squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = [a.tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(parts))


def stretch(body: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(body)
    sizes = np.frombuffer(raw, "<i8", len(types))
    at, out = 8 * len(types), []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes."""
    x = v * np.uint64(0x9E3779B97F4A7C15) ^ w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hot:
    """Hot words and pairs with their counts in training, and look-ups of arrays of hashes in them."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.words = np.array(sorted((w, n) for _, w, n, pair in rows if not pair), "<u8").reshape(-1, 2).T
        pairs = np.array([(v, w, n) for v, w, n, pair in rows if pair], "<u8").reshape(-1, 3).T
        keys = mixed(pairs[0], pairs[1])
        order = np.argsort(keys)
        self.keys, self.pairs = keys[order], pairs[:, order]

    @staticmethod
    def places(found: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of `found` are in the sorted `listed`, and where these are."""
        if not len(listed):
            return np.zeros(len(found), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
        hit = listed[at] == found
        return hit, at[hit]

    def counted(self, v: np.ndarray, w: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> None:
        """Adds the occurrences among (v, w) to `words` and `pairs`."""
        hit, at = self.places(w, self.words[0])
        words += np.bincount(at, minlength=len(words))
        _, at = self.places(mixed(v[hit], w[hit]), self.keys)
        pairs += np.bincount(at, minlength=len(pairs))


def tokens(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Of each text's row, held and text: row, held, and the hashes of its tokens and of those before them, `most` at a time."""
    of, start, end = Hashes(), np.uint64(hashed(START.encode())), np.uint64(hashed(END.encode()))
    for batch in batches:
        for row, held, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = (text or "").encode().lower().split()
            for at in range(0, len(found) + 1, most):  # a very long text is no body of its own
                part = found[at : at + most]
                ids = np.fromiter(map(of.__getitem__, part), np.uint64, len(part))
                if at + most > len(found):
                    ids = np.append(ids, end)
                first = np.uint64(of[found[at - 1]]) if at else start
                yield row, held, np.append(first, ids[:-1]), ids


def candidates(docs: DataFrame, parts: int, most: int = 200_000) -> list[tuple[int, int, int, bool]]:
    """(v, w, 0, pair) of the words (v is 0) and pairs that seem hot by a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after, size = [], [], 0
        for _, _, v, w in tokens(batches, most):
            before.append(v)
            after.append(w)
            size += len(w)
            if size >= most:
                yield summed(before, after)
                before, after, size = [], [], 0
        if size:
            yield summed(before, after)

    def summed(before, after) -> pa.RecordBatch:
        v, w = np.concatenate(before), np.concatenate(after)
        words, n = np.unique(w, return_counts=True)
        _, at, m = np.unique(mixed(v, w), return_index=True, return_counts=True)
        columns = np.concatenate([np.zeros(len(words), np.uint64), v[at]]), np.concatenate([words, w[at]]), np.concatenate([n, m]), np.arange(len(n) + len(m)) >= len(n)
        return pa.record_batch([pa.array(c.view("<i8") if c.dtype == np.uint64 else c) for c in columns], names=["v", "w", "n", "pair"])

    share = max(SAMPLE, SAMPLE_X * parts) / max(1, docs.count())
    some = docs.where(F.pmod("row", F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))
    counts = checkpointed(bounded_batches(some).mapInArrow(run, "v long, w long, n long, pair boolean").groupBy("v", "w", "pair").agg(F.sum("n").alias("n")))
    whole = counts.where("not pair").agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > whole / (HOT * parts)).select("v", "w", "pair").toLocalIterator()  # at most 2 * HOT * parts
    return [(r.v % 2**64, r.w % 2**64, 0, r.pair) for r in found]


def hot_tokens(docs: DataFrame, parts: int, most: int = 200_000) -> Hot:
    """The hot words and pairs with their counts over all texts in training."""
    hot = Hot(candidates(docs, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = np.zeros(hot.words.shape[1], np.int64), np.zeros(len(hot.keys), np.int64)
        before, after, size = [], [], 0
        for _, _, v, w in tokens(batches, most):
            before.append(v)
            after.append(w)
            size += len(w)
            if size >= most:
                hot.counted(np.concatenate(before), np.concatenate(after), words, pairs)
                before, after, size = [], [], 0
        if size:
            hot.counted(np.concatenate(before), np.concatenate(after), words, pairs)
        yield pa.record_batch([pa.array(np.append(np.arange(len(words)), np.arange(len(pairs)))), pa.array(np.append(words, pairs)), pa.array(np.arange(len(words) + len(pairs)) >= len(words))], names=["at", "n", "pair"])

    counts = bounded_batches(docs.where("not held")).mapInArrow(run, "at long, n long, pair boolean").groupBy("pair", "at").agg(F.sum("n").alias("n"))
    for r in counts.toLocalIterator():
        if r.pair:
            hot.pairs[2, r.at] = r.n
        else:
            hot.words[1, r.at] = r.n
    return hot


def bigrams(docs: DataFrame, parts: int, hot: Hot, most: int = 1_200_000) -> DataFrame:
    """(part, body): the tokens of `part`, each with the token before it, its document's number and whether it is in training.

    `docs` has row (a hash of doc_id and text, under 2**62), held and text. A body holds the tokens of a few thousand texts, sorted, so that it packs well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after, rows, size = [], [], [], 0
        for row, held, v, w in tokens(batches, most):
            before.append(v)
            after.append(w)
            rows.append((2 * row + (not held), len(w)))
            size += len(w)
            if size >= most:
                yield bodies(before, after, rows)
                before, after, rows, size = [], [], [], 0
        if size:
            yield bodies(before, after, rows)

    def bodies(before, after, rows) -> pa.RecordBatch:
        v, w = np.concatenate(before), np.concatenate(after)
        own = np.array([r[0] for r in rows], np.int64)
        doc = np.repeat(np.arange(len(rows), dtype=np.uint16 if len(rows) < 65_536 else np.uint32), [r[1] for r in rows])
        deal = w.copy()
        hit, _ = hot.places(w, hot.words[0])
        deal[hit] = key = mixed(v[hit], w[hit])
        again, _ = hot.places(key, hot.keys)
        hit[hit] = again
        deal[hit] = mixed(own[doc[hit]].view(np.uint64), deal[hit])
        part = (deal >> np.uint64(32)) % np.uint64(parts)
        order = np.lexsort((doc, v, w, part))
        v, w, doc, part = v[order], w[order], doc[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
            x = w[a:b]
            new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            numbers = np.diff(np.append(new, len(x))).astype(np.uint32)
            used, local = np.unique(doc[a:b], return_inverse=True)
            out.append((int(part[a]), squeeze(x[new], numbers, v[a:b], (local & 0xFFFF).astype("<u2"), (local >> 16).astype("<u2"), own[used])))
        return pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], names=["part", "body"])

    return bounded_batches(docs).mapInArrow(run, "part int, body binary")


def between(bodies: list[bytes], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens w with low <= w < high, the tokens before them and their texts' numbers."""
    ws, vs, docs = [], [], []
    for body in bodies:
        words, numbers, v, low_half, high_half, own = stretch(body, *BODY)
        # words of one part are in order
        a, b = (len(words) if edge == 2**64 else int(np.searchsorted(words, np.uint64(edge))) for edge in (low, high))
        start, end = int(numbers[:a].sum()), int(numbers[:b].sum())
        ws.append(np.repeat(words[a:b], numbers[a:b]))
        vs.append(v[start:end].copy())
        docs.append(own[low_half[start:end] + (high_half[start:end].astype(np.int64) << 16)])
    return np.concatenate(ws), np.concatenate(vs), np.concatenate(docs)


def counted(dealt: DataFrame, hot: Hot, most: int = 800_000) -> DataFrame:
    """What each partition of tokens knows, as packed bodies of three kinds:

    'sums', per text: its copies, tokens, known tokens, base and score sums, and how many of its bigrams were met 1..K times in training
    'unmet', per unmet bigram of a held-out text: the text, its context and c(w)
    'context', per context in training: the unigram mass and the counts of the words met after it
    'totals': training tokens, distinct training tokens, and how many bigrams were met 1..K+1 times

    Hot words are left out of the distinct tokens, hot pairs of the contexts and of the bigrams met: no partition has all of them.
    A task opens about `most` of its tokens at a time, those in a range of hashes, and keeps the others packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [b for batch in batches for b in batch.column("body").to_pylist()]
        if not bodies:
            return
        size, owners = 0, []
        for body in bodies:
            _, _, v, _, _, own = stretch(body, *BODY)
            size += len(v)
            owners.append(own >> 1)
        owners = np.unique(np.concatenate(owners))
        sums = np.zeros((5 + K, len(owners)))
        totals = np.zeros(K + 3, np.int64)
        kinds, out = [], []
        turns = -(-size // most)
        for turn in range(turns):
            edges = [turn * 2**64 // turns, (turn + 1) * 2**64 // turns]
            w, v, doc = between(bodies, *edges)
            if len(w):
                for kind, body in known(w, v, doc, owners, sums, totals):
                    kinds.append(kind)
                    out.append(body)
                    if len(out) == 8:
                        yield pa.record_batch([pa.array(kinds), pa.array(out, pa.binary())], names=["kind", "body"])
                        kinds, out = [], []
            del w, v, doc
        for a in range(0, len(owners), 20_000):
            kinds.append("sums")
            out.append(squeeze(owners[a : a + 20_000], *(x[a : a + 20_000] for x in sums)))
        kinds.append("totals")
        out.append(totals.astype("<i8").tobytes())
        for a in range(0, len(out), 8):
            yield pa.record_batch([pa.array(kinds[a : a + 8]), pa.array(out[a : a + 8], pa.binary())], names=["kind", "body"])

    def known(w, v, doc, owners, sums, totals) -> Iterator[tuple[str, bytes]]:
        order = np.lexsort((v, w))
        w, v, doc = w[order], v[order], doc[order]
        train = (doc & 1).astype(np.int64)
        text = doc >> 1
        del order, doc
        new_w = np.concatenate([[True], w[1:] != w[:-1]])
        new_vw = new_w | np.concatenate([[True], v[1:] != v[:-1]])
        at_w, at_vw = np.flatnonzero(new_w), np.flatnonzero(new_vw)
        c_w, r_vw = np.add.reduceat(train, at_w), np.add.reduceat(train, at_vw)
        totals[0] += c_w.sum()
        hot_w, at = hot.places(w[at_w], hot.words[0])
        c_w[hot_w] = hot.words[1, at]
        hot_vw, at = hot.places(mixed(v[at_vw], w[at_vw]), hot.keys)
        r_vw[hot_vw] = hot.pairs[2, at]
        c = np.repeat(c_w, np.diff(np.append(at_w, len(w))))
        r = np.repeat(r_vw, np.diff(np.append(at_vw, len(w))))
        is_end = w == np.uint64(hashed(END.encode()))
        totals[1] += ((c_w > 0) & ~hot_w).sum()
        for n in range(1, K + 2):
            totals[1 + n] += ((r_vw == n) & ~hot_vw).sum()

        place = np.searchsorted(owners, text)
        add = lambda row, x: np.add(sums[row], np.bincount(place, weights=x, minlength=len(owners)), out=sums[row])
        add(0, is_end)
        add(1, None)
        add(2, c > 0)
        add(3, np.log10(c + 0.1))
        add(4, np.where(is_end | (c == 0), 0, -np.log10(c + 0.5)) + np.log10(np.maximum(r, 1)))
        for n in range(1, K + 1):
            add(4 + n, r == n)
        del place, is_end
        no = np.flatnonzero(r == 0)
        for a in range(0, len(no), 50_000):
            n = no[a : a + 50_000]
            yield "unmet", squeeze(text[n], v[n], c[n])
        met = np.flatnonzero((r_vw > 0) & ~hot_vw)
        context, mass, count = v[at_vw[met]], c[at_vw[met]], r_vw[met]
        order = np.argsort(context, kind="stable")
        context, mass, count = context[order], mass[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        if len(at):
            columns = [context[at], np.add.reduceat(mass, at), np.diff(np.append(at, len(context))), np.add.reduceat(count, at)]
            columns += [np.add.reduceat((count == n).astype(np.int64), at) for n in range(1, K + 1)]
            for a in range(0, len(at), 50_000):
                yield "context", squeeze(*(x[a : a + 50_000] for x in columns))

    return dealt.mapInArrow(run, "kind string, body binary")


def opened(tables: DataFrame, kind: str, schema: str, *types: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                columns = stretch(body, *types)
                yield pa.record_batch([pa.array(c.view("<i8") if c.dtype == np.uint64 else c) for c in columns], names=names)

    return tables.where(F.col("kind") == kind).select("body").mapInArrow(run, schema)


def discounts(numbers: list[int]) -> list[float]:
    """Katz's d(1)..d(K) from how many bigrams were met 1..K+1 times; a value outside (0, 1], which too few counts may give, is 1 if r > 1, else 0.5.

    d(1) stays under 1, so every context with a bigram met once frees some mass.
    """
    n = [0, *numbers]
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d <= 1 and (r > 1 or d < 1) else 1.0 if r > 1 else 0.5)
    return out


def score(docs: DataFrame, most: int = 800_000) -> DataFrame:
    """Per row of `docs` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score.

    Texts of rows whose crc32(doc_id) mod 10 is 0 are held out, all others train the model. A null text is one end token. Rows that are
    equal in doc_id and text are counted as often as they come, and each gets its score. With no training row all counts are 0. A task of the
    count opens about `most` tokens at a time.
    """
    spark = docs.sparkSession
    fields = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    own = docs.select(*fields).withColumn("row", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    own = own.withColumn("held", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    parts = max(32, shuffle_partitions(spark))
    texts = own.select("row", "held", "text")
    hot = hot_tokens(texts, parts)
    tables = checkpointed(counted(bigrams(texts, parts, hot).repartition(parts, "part"), hot, most))
    released(spark)

    totals = np.zeros(K + 3, np.int64)
    for line in tables.where("kind = 'totals'").select("body").toLocalIterator():  # a few numbers from each partition
        totals += np.frombuffer(line[0], "<i8")
    r = hot.pairs[2].astype(np.int64)
    totals[1] += int((hot.words[1] > 0).sum())
    totals[2:] += [int((r == k).sum()) for k in range(1, K + 2)]
    n, distinct, met = int(totals[0]), int(totals[1]), totals[2:].tolist()
    d = discounts(met)
    whole = n + 0.1 * (distinct + 1)

    numbers = [f"m{r}" for r in range(1, K + 1)]
    parted = ("copies", "tokens", "known", "base", "part", *numbers)
    sums = opened(tables, "sums", "row long, " + ", ".join(f"{c} double" for c in parted), "<i8", *["<f8"] * len(parted))
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in parted))
    context = opened(tables, "context", "v long, mass long, words long, count long, " + ", ".join(f"{m} long" for m in numbers), "<u8", *["<i8"] * (3 + K))
    of_word = dict(hot.words.T.tolist())
    listed = [(v - 2**64 if v >= 2**63 else v, of_word[w], 1, k, *(int(k == j) for j in range(1, K + 1))) for v, w, k in hot.pairs.T.tolist() if k]
    if listed:
        context = context.union(spark.createDataFrame(listed, context.schema))
    context = context.groupBy("v").agg(*(F.sum(c).alias(c) for c in ("mass", "words", "count", *numbers)))
    freed = sum((F.col(f"m{r}") * (r * (1 - d[r - 1])) for r in range(1, K + 1)), F.lit(0.5)) / (F.col("count") + 0.5)
    unseen = 1 - (F.col("mass") + 0.1 * F.col("words")) / whole
    context = context.select("v", (F.log10(freed / unseen) + F.log10(F.col("count") + 0.5)).alias("back"), F.log10(F.col("count") + 0.5).alias("log_count"))
    context = checkpointed(context)
    released(spark)
    # the start of a text is no token, so nothing has added its count yet: the count of training texts
    start = hashed(START.encode())
    start = start - 2**64 if start >= 2**63 else start
    begun = context.where(F.col("v") == start).select("log_count").first()
    log_start = float(begun[0]) if begun else 0.0
    often = [start, *(w - 2**64 if w >= 2**63 else w for w in hot.words[0].tolist())]
    often = F.broadcast(spark.createDataFrame([(v, True) for v in sorted(set(often))], "v long, hot boolean"))
    unmet = opened(tables, "unmet", "row long, v long, c long", "<i8", "<u8", "<i8").join(often, "v", "left")
    unmet = unmet.withColumn("salt", F.when(F.col("hot"), F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    weights = context.join(often, "v", "left").select("v", "back", F.explode(salts).alias("salt"))
    extra = unmet.join(weights, ["v", "salt"], "left").groupBy("row").agg(F.sum(F.coalesce("back", F.lit(0.0)) + F.log10((F.col("c") + 0.1) / whole)).alias("extra"))
    discounted = sum((F.col(f"m{r}") * float(np.log10(d[r - 1])) for r in range(1, K + 1)), F.lit(0.0))
    joined = own.select("row", "doc_id", "held").join(sums.join(extra, "row", "left"), "row")
    return joined.select(
        "doc_id", F.col("held").alias("held_out"), F.round(F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), F.round(F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), ((F.col("base") - F.col("tokens") * float(np.log10(whole))) / F.col("copies")).alias("base_score"),
        ((F.col("part") + discounted + F.coalesce("extra", F.lit(0.0))) / F.col("copies") - log_start).alias("score"),
    )
