"""Benchmark decontamination: one Aho-Corasick automaton over normalised test passages, one scan of each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

#: Bytes of ASCII that are no part of a word become a space, A-Z become a-z; all of UTF-8 above ASCII stays.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SPANS = "array<struct<start:int,end:int>>"
SCANNED = f"doc_id long, text string, n_words long, hits array<int>, items array<string>, spans {SPANS}"


def folded(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows(text: str | None, size: int) -> Iterator[bytes]:
    """Each run of `size` words, with a space on either side; a shorter text is one window, one without words none."""
    found = folded(text)
    for at in range(max(1, len(found) - size + 1) if found else 0):
        yield b" " + b" ".join(found[at : at + size]) + b" "


def original(text: str, hits: list[int]) -> list[dict[str, int]]:
    """The maximal runs of neighbouring words of `hits`, from the first word's start to the last one's end, in code points of the text as it came.

    Folding replaces bytes one by one, so a word's bytes are in the same place before and after.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(data.tobytes().translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    first, last = at[np.flatnonzero(edge == 1)], at[np.flatnonzero(edge == -1)]
    found = np.array(hits)
    cut = np.flatnonzero(np.diff(found) > 1)
    return [{"start": a, "end": b} for a, b in zip(first[found[np.append(0, cut + 1)]].tolist(), last[found[np.append(cut, len(found) - 1)]].tolist(), strict=True)]


def automaton(items: list[tuple[str | None, str | None]], size: int):
    """Over latin-1 views of UTF-8 bytes, so that every byte is one symbol and matches are exact. Windows of an item without id have no owner."""
    import ahocorasick

    of: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            of.setdefault(window, set()).update([] if item is None else [item])
    machine = ahocorasick.Automaton()
    for window, owners in of.items():
        machine.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, sorted(owners)))
    if of:
        machine.make_automaton()
    return machine if of else None


def scan(docs: DataFrame, items: list[tuple[str | None, str | None]], size: int) -> DataFrame:
    """Adds what one block of items hits to `hits` (word numbers), `items` and `spans`."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value, size)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, hits, items, spans in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True):
                found = folded(text)
                if machine is not None and found:
                    flat = b" " + b" ".join(found) + b" "
                    matches = [(end - length + 1, n, owners) for end, (length, n, owners) in machine.iter(flat.decode("latin-1"))]
                    if matches:
                        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
                        first = np.searchsorted(spaces, [m[0] for m in matches])
                        marked = np.zeros(len(found) + 1, np.int64)
                        np.add.at(marked, first, 1)
                        np.add.at(marked, first + [m[1] for m in matches], -1)
                        hits = np.union1d(np.flatnonzero(np.cumsum(marked)[:-1]), hits or []).astype(int).tolist()
                        items = sorted(set(items or []).union(*(m[2] for m in matches)))
                        spans = original(text, hits)
                for column, value in zip(columns, (len(found), hits or [], items or [], spans or []), strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.list_(place))], names=["doc_id", "text", "n_words", "hits", "items", "spans"])

    return docs.mapInArrow(run, SCANNED)


def blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The test items in blocks of about `most_bytes` of text: a block's size bounds what is broadcast, whatever the table's size."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 8_000_000) -> DataFrame:
    """Per document: n_words, `hits`, the numbers of its words that lie in an occurrence of a benchmark window, the items whose windows
    occur, and `spans`, the runs of hit words as offsets in the text as it came (code points, end exclusive).

    A window is `size` consecutive words of an item; an item of fewer words is one window. Null texts have no words, items of null text
    no windows; windows of an item without id hit words and are named by no item. The text comes along. Documents are never shuffled: each block of items is one more scan in the same stage.
    """
    out = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"), F.array().cast(SPANS).alias("spans"))
    some = False
    for block in blocks(benchmark, most_bytes):
        out, some = scan(out, block, size), True
    return out if some else scan(out, [], size)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = 8_000_000) -> DataFrame:
    """The rows of `docs`, all columns, whose texts have no occurrence of a benchmark window; see `decontaminate`."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    for block in blocks(benchmark, most_bytes):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value, size)
            for batch in batches:
                clean = []
                for text in batch.column(at).to_pylist():
                    found = folded(text) if machine is not None else []
                    flat = b" " + b" ".join(found) + b" "
                    clean.append(not found or next(machine.iter(flat.decode("latin-1")), None) is None)
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = bounded_batches(docs).mapInArrow(run, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of `decontaminate`."""
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
