"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by a binary trie self-join.

Fingerprints that differ in few bits agree in one of `errors + 1` blocks of
bits. Rotated so that this block leads, they share the top of a trie; below
it, pairs of nodes are walked together, one bit at a time, and a pair is
pruned as soon as the differing bits on its way exceed the budget. All the
tries of a task are walked at once, level by level, as arrays.

`keep_first`, the pipeline's stage, keeps one document of each component.
`keep_one` links by the Jaccard similarity of five-word shingles. SimHashes at that similarity are some ten bits apart, too many for
blocks; so documents that share two of their least shingle hashes are
candidates, and their whole sets of shingles decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, checkpointed, free, shuffle_partitions
from tidemark.llm.components import components

BITS = 64
#: So many least shingle hashes of a document make its keys in `keep_one`.
LEAST = 8


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; a text of fewer words is one shingle, none gives zero."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    flat = b" ".join(found)
    if len(found) <= shingle:
        return xxh64_intdigest(flat, seed)
    ends = np.cumsum([len(w) + 1 for w in found])
    first = np.concatenate([[0], ends[:-shingle]]).tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 100_000):
        hashes = np.array([xxh64_intdigest(flat[a:b], seed) for a, b in zip(first[at : at + 100_000], last[at : at + 100_000], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, fp, bigint columns of `also`): fp is the fingerprint's 64 bits as a signed bigint. A null text has no words. Rows are neither merged nor dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(made), *batch.columns[2:]], names=["doc_id", "fp", *also])

    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also)
    return bounded_batches(kept).mapInArrow(run, ", ".join(f"{name} long" for name in ("doc_id", "fp", *also)))


def trie_pairs(bucket: np.ndarray, value: np.ndarray, depth: int, errors: int, leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i != j, of all pairs of one bucket whose values differ in at most `errors` bits, in bounded chunks.

    Rows must be sorted by (bucket, value); only the lowest `depth` bits may differ within a bucket.
    """
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    stack = [(starts, ends, starts, ends, np.zeros(len(starts), np.int64), depth - 1)]
    while stack:
        al, ah, bl, bh, err, bit = stack.pop()
        keep = (ah > al) & (bh > bl) & (err <= errors) & ~((al == bl) & (ah - al == 1))
        al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        if len(al) > 500_000:
            half = len(al) // 2
            stack += [tuple(x[:half] for x in (al, ah, bl, bh, err)) + (bit,), tuple(x[half:] for x in (al, ah, bl, bh, err)) + (bit,)]
            continue
        small = ((ah - al) * (bh - bl) <= leaf) | (bit < 0)
        if small.any():
            yield from _leaves(value, *(x[small] for x in (al, ah, bl, bh)), errors)
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm = _split(value, al, ah, bit), _split(value, bl, bh, bit)
        own = al == bl
        other = ~own
        stack.append((
            np.concatenate([al, am, al, am[other]]), np.concatenate([am, ah, am, ah[other]]),
            np.concatenate([bl, bm, bm, bl[other]]), np.concatenate([bm, bh, bh, bm[other]]),
            np.concatenate([err, err, err + 1, err[other] + 1]), bit - 1,
        ))


def _split(value: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the rows with this bit begin, for each range of rows that agree above it: a binary search of all ranges together."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        one = np.zeros(len(low), bool)
        one[open_] = (value[middle[open_]] >> np.uint64(bit)) & np.uint64(1) == 1
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)
    return low


def _leaves(value, al, ah, bl, bh, errors: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = (ah - al) * (bh - bl)
    group = np.cumsum(width) // most
    for g in np.unique(group):
        k = group == g
        a0, b0, nb, w = al[k], bl[k], (bh - bl)[k], width[k]
        at = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        i, j = np.repeat(a0, w) + at // np.repeat(nb, w), np.repeat(b0, w) + at % np.repeat(nb, w)
        near = (i != j) & (np.bitwise_count(value[i] ^ value[j]) <= errors)
        yield i[near], j[near]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that `pairs` connect it with."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root])[root != up].size:
                root = up
    return root


def near_edges(distinct: DataFrame, errors: int = 3, most: int = 4096) -> DataFrame:
    """(a, b): edges between fingerprints of `distinct` (fp) that connect just what links at up to `errors` bits connect.

    Each fingerprint goes to `errors + 1` buckets, one a block. A bucket of more than `most` is dealt to pairs of chunks, so that no
    task gets it whole. A task returns a forest of its links and not all pairs.
    """
    width = BITS // (errors + 1)
    spread = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(errors))).alias("block"))
    spread = spread.withColumn("part", F.expr(f"shiftrightunsigned(fp, block * {width}) & {(1 << width) - 1}L"))
    large = spread.groupBy("block", "part").count().where(F.col("count") > most)
    chunks = F.coalesce(F.ceil(F.col("count") / most).cast("int"), F.lit(1))
    dealt = spread.join(large, ["block", "part"], "left").withColumn("chunks", chunks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.select("block", "part", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "fp")
    dealt = dealt.repartition(shuffle_partitions(distinct.sparkSession), "block", "part", "c", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        block, part, c, d, fp = (rows[k].to_numpy() for k in ("block", "part", "c", "d", "fp"))
        turn = (block * width).astype(np.uint64)
        value = fp.view(np.uint64)
        # the block moves to the top; a shift by 64 isn't defined, so the pair of shifts is split
        rotated = ((value << (np.uint64(BITS - width) - turn)) | ((value >> turn) >> np.uint64(width)))
        order = np.lexsort((rotated, d, c, part, block))
        block, part, c, d, fp, rotated = (x[order] for x in (block, part, c, d, fp, rotated))
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        root = forest(len(fp), trie_pairs(np.cumsum(new), rotated, BITS - width, errors))
        linked = root != np.arange(len(fp))
        yield pa.record_batch([pa.array(fp[linked]), pa.array(fp[root[linked]])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, fp and component_id, the smallest doc_id that links at up to `errors` differing bits reach.

    Null texts and texts without words have fingerprint zero, which links like any other. Null doc_ids get a component but never name
    one, unless all of its rows have none. Repeated rows stay.
    """
    marked = checkpointed(fingerprints(docs))
    least = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_edges(least.select("fp"), errors)).withColumnsRenamed({"node": "fp"})
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(smallest, "root").select("fp", "component_id"), "fp")


def keep_first(docs: DataFrame, errors: int = 3) -> DataFrame:
    """The rows of `docs`, all columns, of which each component of fingerprints within `errors` bits keeps the smallest doc_id (null first), then text hash.

    Rows that are equal in doc_id and text leave one row.
    """
    doc, th, k, kth = (free(name, docs) for name in ("__doc", "__th", "__k", "__kth"))
    own = docs.withColumns({doc: F.col("doc_id").cast("long"), th: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    least = checkpointed(fingerprints(own, th).groupBy("fp").agg(F.min(F.struct("doc_id", th)).alias("first")))
    roots = components(near_edges(least.select("fp"), errors)).withColumnsRenamed({"node": "fp"})
    kept = least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("kept"))
    kept = kept.select(F.col("kept.doc_id").alias(k), F.col(f"kept.{th}").alias(kth))
    joined = own.join(kept, own[doc].eqNullSafe(F.col(k)) & (own[th] == F.col(kth)), "left_semi")
    return joined.dropDuplicates([doc, th]).select(docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """The different hashes of a text's shingles, sorted; a text of fewer words is one shingle, none has none."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()
    runs = (b" ".join(found[at : at + size]) for at in range(max(1, len(found) - size + 1) if found else 0))
    return np.unique(np.fromiter((xxh64_intdigest(x, seed) for x in runs), np.uint64))


def jaccard_edges(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): pairs of `classes` (sig, n, least, first: place of a text) that link all with a Jaccard similarity of `percent` at least.

    A pair shares two hashes of `least` at least, of which each class has its lowest eight: at 80 % all but 8 in 100,000 do. So that a
    large group of near copies doesn't make pairs with the square of its size, each class is first held against the least one of those
    that have two hashes in common, and then only against classes not connected yet.
    """
    spread = F.flatten(F.transform("least", lambda x, i: F.transform(F.slice("least", i + 2, F.lit(LEAST)), lambda y: F.xxhash64(x, y))))
    keyed = checkpointed(classes.select("sig", "n", F.explode(spread).alias("key")))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("sig").alias("pivot")).where("rows > 1").drop("rows")
    keyed = checkpointed(keyed.join(several, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "own"])

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = checkpointed(pairs.distinct())
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        places = classes.join(ends, "sig", "left_semi").select("sig", F.col("first.__doc").alias("__k"), F.col("first.__th").alias("__kth"))
        own = texts.join(places, texts["__doc"].eqNullSafe(F.col("__k")) & (texts["__th"] == F.col("__kth"))).dropDuplicates(["sig"])
        sets = checkpointed(bounded_batches(own.select("sig", "text")).mapInArrow(run, "sig long, own array<long>"))
        x, y = sets.select(F.col("sig").alias("a"), F.col("own").alias("x")), sets.select(F.col("sig").alias("b"), F.col("own").alias("y"))
        same = F.size(F.array_intersect("x", "y"))
        return pairs.join(x, "a").join(y, "b").where(same * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b")

    near = components(checked(keyed.where("sig <> pivot").select(F.col("pivot").alias("a"), F.col("sig").alias("b"))))
    rooted = keyed.drop("pivot").join(near.withColumnsRenamed({"node": "sig"}), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    x, y = rooted.alias("x"), rooted.alias("y")
    open_ = (F.col("x.sig") < F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & open_).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    return near.select(F.col("node").alias("a"), F.col("root").alias("b")).union(checked(more))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which each group of near-duplicates keeps one: the smallest doc_id (null first), then text hash.

    Near-duplicates are linked by a Jaccard similarity of `percent` at least of their shingles of `size` words; texts without words are
    one group. Rows that are equal in doc_id and text leave one row.
    """
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__th": th})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(2).to_pylist()]
            sig = np.array([xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            least = pa.array([x[:LEAST].view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sig), pa.array([len(x) for x in sets], pa.int64()), least], names=["__doc", "__th", "sig", "n", "least"])

    texts = own.select("__doc", "__th", F.col("text").cast("string").alias("text"))
    marked = checkpointed(bounded_batches(texts).mapInArrow(run, "__doc long, __th long, sig long, n long, least array<long>"))
    classes = checkpointed(marked.groupBy("sig").agg(F.min(F.struct("__doc", "__th")).alias("first"), F.first("n").alias("n"), F.first("least").alias("least")))
    roots = components(jaccard_edges(classes, texts, size, percent)).withColumnsRenamed({"node": "sig"})
    kept = classes.select("sig", "first").join(roots, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("first").alias("kept"))
    kept = kept.select(F.col("kept.__doc").alias("__k"), F.col("kept.__th").alias("__kth"))
    joined = own.join(kept, own["__doc"].eqNullSafe(F.col("__k")) & (own["__th"] == F.col("__kth")))
    return joined.dropDuplicates(["__doc", "__th"]).select(docs.columns)
