"""Bloom filters as SQL expressions: one bitmap for each hash, made by Spark's bitmap aggregate.

A filter is the bitmaps of its HASHES hashes one after the other, in base64; each has a whole number of BLOCK bits, and the length of all
tells their size.
"""

from __future__ import annotations

import base64
import binascii

from tidemark.errors import Invalid, Unsupported

#: Seven hashes and 1.37 bits for each of them and entry: one false positive in a hundred.
HASHES, BITS_PER_ENTRY, BLOCK, LEAST, MOST_BLOCKS = 7, 1.37, 32_768, 8, 8


def _place(value: str, k: int, size: str) -> str:
    return f"pmod(xxhash64({k}, CAST({value} AS STRING)), {size})"


def build(value: str, entries: int) -> str:
    """The aggregate that makes a filter of a value's non-null occurrences, of which at most `entries` should differ."""
    blocks = -(-int(max(LEAST, entries) * BITS_PER_ENTRY) // BLOCK)
    if blocks > MOST_BLOCKS:
        raise Unsupported("bloomFilter", f"more than {int(MOST_BLOCKS * BLOCK / BITS_PER_ENTRY)} entries")
    parts = []
    for k in range(HASHES):
        at = _place(value, k, str(blocks * BLOCK))
        parts += [f"bitmap_construct_agg(CASE WHEN {value} IS NOT NULL AND {at} DIV {BLOCK} = {b} THEN {at} % {BLOCK} END)" for b in range(blocks)]
    return f"base64(concat({', '.join(parts)}))"


def test(value: str, filter_: str) -> str:
    """Whether a filter (an expression that gives base64) may have a value; false for null."""
    raw = f"unbase64({filter_})"
    each = f"(octet_length({raw}) DIV {HASHES})"
    bits = []
    for k in range(HASHES):
        at = _place(value, k, f"{each} * 8")
        byte = f"CAST(conv(hex(substring({raw}, CAST({k} * {each} + {at} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
        bits.append(f"(shiftright({byte}, CAST({at} % 8 AS INT)) & 1) = 1")
    return f"coalesce({value} IS NOT NULL AND {' AND '.join(bits)}, false)"


def checked(text: str) -> str:
    """The filter, if it is one."""
    try:
        size = len(base64.b64decode(text, validate=False))
    except (binascii.Error, ValueError):
        size = 0
    if not size or size % (HASHES * BLOCK // 8):
        raise Invalid("bloomFilter", "malformed filter")
    return text
