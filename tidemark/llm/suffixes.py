"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A suffix matters up to `length` bytes. Its anchor, the least hash of its
k-grams, depends on nothing but these bytes, so equal suffixes have equal
anchors: suffixes are dealt out by it. Neighbouring suffixes with the same
anchor travel together as one run of bytes. Runs that are equal as a whole
are settled by their hashes; runs that share an anchor but differ are indexed:
they come in the order of the corpus, in batches, a batch gets a suffix array,
is merge-scanned against the arrays of the existing levels for matches of
`length` bytes, and levels of equal size merge.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, checkpointed, released, shuffle_partitions

#: Odd multipliers of the rolling hash and its final mixing; any will do.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SEGMENT = 1 << 20
RUNS = "doc_id long, crc long, h long, run long, start long, n long"
GONE = "doc_id long, crc long, a long, b long"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes, k a power of two, by doubling."""
    out, step, factor = data.astype(np.uint64) + np.uint64(1), 1, ROLL
    while step < k:
        out = out[:-step] * factor + out[step:]
        step, factor = 2 * step, factor * factor
    out ^= out >> np.uint64(31)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    rest = width - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def suffix_runs(data: bytes, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(hash of the anchor, first suffix, number of suffixes) of the runs of all suffixes of at least `length` bytes."""
    view = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(view) - length + 1), SEGMENT):
        grams = gram_hashes(view[at : at + SEGMENT + length - 1], k)
        low = np.uint64((1 << 22) - 1)
        order = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_least(order, length - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        number = np.diff(np.append(first, len(anchor)))
        yield from zip(grams[anchor[first]].view(np.int64).tolist(), (first + at).tolist(), number.tolist(), strict=True)


def all_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            ids, crcs, sizes, parts = batch.column(0), batch.column(1), [], []
            for text in batch.column(2).to_pylist():
                data = (text or "").encode()
                own = list(suffix_runs(data, length, k))
                sizes.append(len(own))
                if own:
                    whole = np.array([xxh3_64_intdigest(data[s : s + n + length - 1]) for _, s, n in own], np.uint64).view(np.int64)
                    parts.append((np.array(own, np.int64), whole))
            if not parts:
                continue
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            rows, whole = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            yield pa.record_batch([ids.take(row), crcs.take(row), pa.array(rows[:, 0].copy()), pa.array(whole), pa.array(rows[:, 1].copy()), pa.array(rows[:, 2].copy())], names=["doc_id", "crc", "h", "run", "start", "n"])

    return bounded_batches(docs).mapInArrow(run, RUNS)


class SuffixIndexFamily:
    """Levels of sorted arrays of suffixes, each cut at `length` bytes; level n holds about `base` * 2**n of them."""

    def __init__(self, length: int, base: int = 256):
        self.length, self.base, self.levels = length, base, {}

    def add(self, batch: list[bytes]) -> list[set[int]]:
        """Adds runs in order; for each the suffixes that occurred before, in an earlier run or earlier in this one."""
        array = sorted((run[s : s + self.length], k, s) for k, run in enumerate(batch) for s in range(len(run) - self.length + 1))
        seen: list[set[int]] = [set() for _ in batch]
        new = []
        for suffix, places in groupby(array, key=lambda x: x[0]):
            new.append(suffix)
            next(places)  # the first of the batch
            for _, k, s in places:
                seen[k].add(s)
        known: set[bytes] = set()
        for level in self.levels.values():
            known.update(self._matches(level, new))
        if known:
            for suffix, k, s in array:
                if suffix in known:
                    seen[k].add(s)
        self._push([s for s in new if s not in known])
        return seen

    @staticmethod
    def _matches(level: list[bytes], new: list[bytes]) -> Iterator[bytes]:
        """Of two sorted arrays, what both have: one pass over their merge."""
        before = None
        for suffix in heapq.merge(level, new):
            if suffix == before:
                yield suffix
            before = suffix

    def _push(self, array: list[bytes]) -> None:
        while array:
            size = max(0, (len(array) // self.base).bit_length())
            if size not in self.levels:
                self.levels[size] = array
                return
            array = list(heapq.merge(self.levels.pop(size), array))


def repeated(docs: DataFrame, length: int = 100, k: int = 32, hot: int = 2048) -> DataFrame:
    """(doc_id, crc, spans): the maximal runs of bytes to remove of each document that has any; `docs` has doc_id, crc and text."""
    runs = all_runs(docs, length, k)
    by_anchor, by_run = W.partitionBy("h"), W.partitionBy("h", "run").orderBy("doc_id", "crc", "start")
    ranked = (
        runs.repartition(shuffle_partitions(docs.sparkSession), "h")
        .withColumns({"size": F.count(F.lit(1)).over(by_anchor), "mixed": F.min("run").over(by_anchor) != F.max("run").over(by_anchor)})
        .where("size > 1")
        .withColumn("turn", F.rank().over(by_run))
        .where("turn > 1 or mixed")
    )
    ranked = checkpointed(ranked)
    del runs
    released(docs.sparkSession)
    gone = ranked.where("turn > 1").select("doc_id", "crc", F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b"))
    first = ranked.where("turn = 1")
    wanted = first.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("h", "start", "n", "size")).alias("runs"))
    texts = docs.join(wanted, (docs["doc_id"].eqNullSafe(wanted["doc_id"])) & (docs["crc"] == wanted["crc"])).select(docs["doc_id"], docs["crc"], "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, crc, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for r in own:
                    salts = min(64, -(-r["size"] // hot))
                    out += [(doc_id, crc, r["h"], salt, salts, r["start"], data[r["start"] : r["start"] + r["n"] + length - 1]) for salt in range(salts)]
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    names = ["doc_id", "crc", "h", "salt", "salts", "start", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for (_, salt, salts), group in groupby(rows, key=lambda r: r[2:5]):
            family, batch = SuffixIndexFamily(length), []
            for row in group:
                batch.append(row)
                if len(batch) == 256:
                    out += family_spans(family, batch, salt, salts)
                    batch = []
            out += family_spans(family, batch, salt, salts)
            if len(out) > 10_000:
                yield spans_batch(out)
                out = []
        if out:
            yield spans_batch(out)

    def spans_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "crc", "a", "b"])

    def family_spans(family: SuffixIndexFamily, batch: list[tuple], salt: int, salts: int) -> list[tuple]:
        out = []
        if salts == 1:
            found = family.add([row[6] for row in batch])
            for row, seen in zip(batch, found, strict=True):
                for s in seen:
                    out.append((row[0], row[1], row[5] + s, row[5] + s + length))
            return out
        # a hot anchor's suffixes are dealt out by their content; equal ones meet
        cut_out = [(row, s, row[6][s : s + length]) for row in batch for s in range(len(row[6]) - length + 1)]
        cut_out = [x for x in cut_out if int.from_bytes(hashlib.blake2b(x[2], digest_size=4).digest(), "little") % salts == salt]
        for (row, s, _), seen in zip(cut_out, family.add([x[2] for x in cut_out]), strict=True):
            if seen:
                out.append((row[0], row[1], row[5] + s, row[5] + s + length))
        return out

    runs_of_bytes = (
        texts.mapInArrow(cut, "doc_id long, crc long, h long, salt int, salts int, start long, bytes binary")
        .repartition(shuffle_partitions(docs.sparkSession), "h", "salt")
        .sortWithinPartitions("h", "salt", "doc_id", "crc", "start")
    )
    return gone.union(runs_of_bytes.mapInArrow(index, GONE)).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_bytes, n_removed, n_spans, kept (binary).

    Each byte goes that is covered by a string of `length` bytes which also starts earlier: in a smaller doc_id (null is smallest; rows
    that share a doc_id come by their texts' CRC) or earlier in the same document. Rows equal in doc_id and text count as one document
    and get the same result. Null texts are empty; texts under `length` bytes lose nothing.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = repeated(own, length, k)
    joined = own.join(found, (own["doc_id"].eqNullSafe(found["doc_id"])) & (own["crc"] == found["crc"]), "left").select(own["doc_id"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                if not spans:
                    rows.append((len(data), 0, 0, data))
                    continue
                mark = np.zeros(len(data) + 1, np.int64)
                ends = np.array([(x["a"], x["b"]) for x in spans])
                np.add.at(mark, ends[:, 0], 1)
                np.add.at(mark, ends[:, 1], -1)
                gone = np.cumsum(mark[:-1]) > 0
                begun = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), begun, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
