"""Best-fit packing of tokenised documents, with certified bin counts.

Documents are tokenised once into pieces of at most `capacity` tokens. Every
partition packs its pieces by best-fit decreasing and certifies the number of
its bins by dual feasible functions. A partition whose count meets the bound
gives up its emptiest bin only; one with a gap gives up the emptiest bins that
the gap may hide in. Pieces given up are dealt to fewer partitions and packed
again, until one partition is left.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, checkpointed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, done boolean"


class EndedPieces:
    """Ids of runs by a BPE vocabulary whose words end in a suffix: byte pieces with an end byte, merged in the order of their ids.

    Only runs of printable characters under U+0250 take this way: for these the tokenizer's normalisation is lower-casing alone.
    `usable` tells whether the tokenizer is of this form; any other goes through its library.
    """

    END = b"\xff"  # in no UTF-8

    def __init__(self, encoder):
        import json

        import regex

        spec = json.loads(encoder.to_str())
        model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        vocabulary, merges = model.get("vocab", {}), model.get("merges", [])
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.usable = (
            model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in split] == ["Split", "ByteLevel"] and split[0].get("behavior") == "Removed"
            and all(vocabulary.get("".join(p)) == 512 + k for k, p in enumerate(pairs))
        )
        if not self.usable:
            return
        from tiktoken import _tiktoken

        ranks = {}
        for token, number in vocabulary.items():
            if not token.startswith("<|"):
                word = token.removesuffix("</w>") or token
                ranks[bytes(byte[c] for c in word) + (self.END if word != token else b"")] = number
        self.core = _tiktoken.CoreBPE(ranks, {}, r"[\s\S]+")
        self.find = regex.compile(split[0]["pattern"]["Regex"]).findall
        self.odd = regex.compile("[^\x21-\x7e\xa1-\u024f]").search

    def __call__(self, run: bytes) -> bytes | None:
        text = run.decode()
        if self.odd(text) or "<|" in text:
            return None
        ids = []
        for piece in self.find(text.lower()):
            ids += self.core.encode_single_piece(piece.encode() + self.END)
        return array("H", ids).tobytes()


class WordIds:
    """Token ids of whole texts. Pre-tokens never cross ASCII white space, so runs between it are encoded once and remembered.

    What is remembered has two generations of at most `most` runs: when the newer is full, it takes the place of the older,
    from which a run that is met again comes back.
    """

    def __init__(self, path: str, most: int = 450_000):
        from tokenizers import Tokenizer

        self.encoder, self.most = Tokenizer.from_file(path), most
        self.fast = EndedPieces(self.encoder)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        group, size = [], 0
        for text in texts:
            raw = (text or "").encode()
            group.append((raw if b"<|" in raw else raw.lower()).split())
            size += len(raw)
            if size > 1_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[bytes]]) -> Iterator[np.ndarray]:
        wanted = set().union(*group)
        if len(self.known) + len(wanted) > self.most:
            self.old, self.known = self.known, {}
        missing = wanted - self.known.keys()
        back = missing & self.old.keys()
        for run in back:
            self.known[run] = self.old[run]
        new = []
        for run in missing - back:
            got = self.fast(run) if self.fast.usable else None
            if got is None:
                new.append(run)
            else:
                self.known[run] = got
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            for run, got in zip(part, self.encoder.encode_batch_fast([r.decode() for r in part], add_special_tokens=False), strict=True):
                self.known[run] = np.array(got.ids, dtype="<u2").tobytes()
        for runs in group:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, runs)), dtype="<u2")


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One a worker, so that what a task has learnt serves the next."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of each document: its tokens followed by `end_id`, cut only where longer than `capacity`.

    A null text counts as empty and gives one piece of one token. A null doc_id is kept. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.packing import word_ids

        ids_of = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of `lengths` has fewer bins: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    cut = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - cut + 1]
    middle = total[capacity - cut + 1] - total[cut]
    best = int((large + -(-middle // capacity)).max())
    sizes = np.arange(capacity + 1)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. `lengths` must come in descending order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for at, size in enumerate(lengths.tolist()):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, chosen, made = capacity, made, made + 1
        bins[at], offsets[at] = chosen, capacity - room
        left = room - size
        if left:
            free[left].append(chosen)
            mask |= 1 << left
    return bins, offsets, made


def pack(items: DataFrame, capacity: int = 4096, per_partition: int = 1 << 17, fewer: int = 8) -> DataFrame:
    """`items` (the columns of PIECES) with sequence_id and offset; every row of `items` is placed once.

    Rows are dealt round robin, so repeated rows spread. Empty input gives no rows. A partition holds `per_partition` lengths at most
    in its first round; what later rounds get shrinks, since only emptiest bins are given up.
    """
    left, parts, out = items, max(1, -(-items.count() // per_partition)), None
    turn = 0
    while True:
        last = parts == 1

        def run(batches: Iterator[pa.RecordBatch], turn=turn, last=last) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            rows = pa.Table.from_batches(got).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = rows["length"].to_numpy()
            bins, offsets, made = best_fit_decreasing(lengths, capacity)
            done = np.ones(len(lengths), bool)
            if not last:
                gap = made - lower_bound(lengths, capacity)
                fill = np.bincount(bins, weights=lengths, minlength=made)
                open_bins = np.argsort(fill, kind="stable")[: 1 if gap == 0 else 4 * gap + 1]
                done = ~np.isin(bins, open_bins)
            base = (turn << 56) | (TaskContext.get().partitionId() << 32)
            rows = rows.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).append_column("done", pa.array(done))
            yield from rows.to_batches(max_chunksize=50_000)

        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        packed = checkpointed(left.select(*names).repartition(parts).mapInArrow(run, PACKED))
        kept = packed.where("done").drop("done")
        out = kept if out is None else out.unionByName(kept)
        if last:
            return out
        left, turn = packed.where("not done"), turn + 1
        parts = max(1, parts // fewer)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs `docs` (doc_id, text) into sequences of at most `capacity` tokens; see `pieces` and `pack`.

    Ids are kept in two bytes, so a tokenizer may have 65,536 ids at most; a larger id raises an error.
    """
    return pack(checkpointed(pieces(docs, tokenizer, capacity, end_id)), capacity)
