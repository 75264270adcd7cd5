"""Token counts that follow edits: a tree of pre-tokens per document, of which an edit re-encodes only what it touches.

The leaves of a tree are blocks of neighbouring pre-tokens with their lengths
and token counts; inner nodes have the sums of both. An edit is found by
descending along the lengths. Encoding starts over at the pre-token that could
have looked at the first changed character, and ends where a new pre-token
begins at an old one's place behind the edit: from there on nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

BLOCK = 64
#: A pre-token's end depends on so many characters behind it at most.
AHEAD = 3
COUNTED = "doc_id long, n_tokens long, n_pretokens long, n_tokens_edited long, n_reencoded long"


class Encoder:
    """Pre-tokens of a text and their token counts, remembered in two generations of at most `most` each."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 300_000):
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.most = regex.compile(pattern), most
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, piece: str) -> int:
        got = self.known.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = len(self.core.encode_single_piece(piece)) if hasattr(self.core, "encode_single_piece") else len(self.core._encode_single_piece(piece))
            if len(self.known) >= self.most:
                self.old, self.known = self.known, {}
            self.known[piece] = got
        return got

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class CountTree:
    def __init__(self, pieces: list[str], encoder: Encoder):
        self.encoder = encoder
        lengths, counts = list(map(len, pieces)), list(map(encoder.count, pieces))
        self.blocks = [(lengths[a : a + BLOCK], counts[a : a + BLOCK]) for a in range(0, len(pieces), BLOCK)] or [([], [])]
        self._grow()

    def _grow(self) -> None:
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(self.blocks)] = [(sum(a), sum(b)) for a, b in self.blocks]
        at = self.width
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at].reshape(-1, 2, 2).sum(axis=1)
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pretokens(self) -> int:
        return sum(len(a) for a, _ in self.blocks)

    def find(self, place: int) -> tuple[int, int]:
        """The block that holds the character at `place` (the last block if none does), and where the block begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place >= begin + self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.width, begin

    def edit(self, text: str, start: int, end: int, new: str) -> tuple[str, int]:
        """Replaces text[start:end], a part of the tree's text; returns the new text and how many pre-tokens were encoded."""
        edited = text[:start] + new + text[end:]
        first, begin = self.find(max(0, start - AHEAD))
        lengths, counts = self.blocks[first]
        keep = 0
        while keep < len(lengths) and begin + lengths[keep] + AHEAD <= start:
            begin += lengths[keep]
            keep += 1
        shift = len(new) - (end - start)
        block, at, old = first, keep, begin  # the next old pre-token, and where it begins
        made: list[tuple[int, int]] = []
        place = begin
        for match in self.encoder.pattern.finditer(edited, begin):
            place = match.start()
            while old + shift < place or old < end:
                if at >= len(self.blocks[block][0]):
                    if block + 1 >= len(self.blocks):
                        break
                    block, at = block + 1, 0
                    continue
                old += self.blocks[block][0][at]
                at += 1
            if old >= end and old + shift == place and place >= start + len(new) and (at < len(self.blocks[block][0]) or block + 1 < len(self.blocks)):
                break
            made.append((match.end() - place, self.encoder.count(match.group())))
        else:
            block, at = len(self.blocks) - 1, len(self.blocks[-1][0])
        tail = self.blocks[block]
        joined = ([*lengths[:keep], *(a for a, _ in made), *tail[0][at:]], [*counts[:keep], *(b for _, b in made), *tail[1][at:]])
        self._put(first, block, joined)
        return edited, len(made)

    def _put(self, first: int, last: int, joined: tuple[list[int], list[int]]) -> None:
        if first == last and len(joined[0]) <= 2 * BLOCK:
            self.blocks[first] = joined
            node = self.width + first
            self.sums[node] = sum(joined[0]), sum(joined[1])
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            return
        self.blocks[first : last + 1] = [(joined[0][a : a + BLOCK], joined[1][a : a + BLOCK]) for a in range(0, len(joined[0]), BLOCK)] or [([], [])]
        self._grow()


def revision(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query, each on the text that the one before leaves: an insertion, a deletion and a replacement."""
    n = len(text)
    return [(n // 4, n // 4, " edited"), (n // 2, min(n, n // 2 + 8), ""), (3 * n // 4, min(n - min(8, n - n // 2) + 7, 3 * n // 4 + 5), "'ll 42")]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, edits=revision) -> DataFrame:
    """Per row of `docs` (doc_id, text): the tokens and pre-tokens of the whole text, its tokens after `edits`, and how many pre-tokens
    these edits had encoded again.

    `edits` gives the edits of a text as (start, end, replacement), each within the text as it is by then. A null text is empty: it has
    no tokens before its edits. Rows are handled one by one, whatever repeats; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                tree = CountTree(encoder.pieces(text), encoder)
                before, leaves, again = tree.tokens, tree.pretokens, 0
                for start, end, new in edits(text):
                    text, n = tree.edit(text, start, end, new)
                    again += n
                rows.append((before, leaves, tree.tokens, again))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[x.split()[0] for x in COUNTED.split(", ")])

    return bounded_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, COUNTED)
