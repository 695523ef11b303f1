"""Byte-level BPE encoding and decoding with a public tokenizer's vocabulary.

Each pre-token is merged with contiguous arrays: the part ids and, beside them,
the rank of each adjacent pair. The minimum rank (leftmost on ties) is found by a
scan, one boundary is deleted and the two neighbouring ranks are looked up again.
That is quadratic, so pre-tokens of more than SHORT bytes use a heap with the
same order of merges. Pre-tokens repeat, so each Python worker keeps a bounded
cache of their ids.

Null texts count as empty (no ids). The special token's string in a text is one
id. Decoding gives back the text exactly. Texts are encoded whole, of any length.
Repeated rows are encoded each; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.text import slices

SHORT = 96
CACHE = 250_000
SLICE_BYTES = 1 << 20
#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 62


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A tokenizer file's vocabulary, with pair ranks keyed by two ids in one integer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(symbols[c] for c in s) for s, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """Ids by repeated scans of the contiguous rank array."""
        ids = [self.byte_id[b] for b in word]
        get, none = self.pairs.get, (_NONE, 0)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least[0] == _NONE:
                break
            at = ranks.index(least)
            ids[at] = least[1]
            del ids[at + 1]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | ids[at], none)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 20 | ids[at + 1], none)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges from a heap over a linked list: n log n for a long pre-token."""
        ids = [self.byte_id[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, heap, end = self.pairs.get, [], len(ids)

        def push(at: int) -> None:
            if at >= 0 and after[at] < end and (hit := get(ids[at] << 20 | ids[after[at]])):
                heapq.heappush(heap, (hit[0], at, ids[at], ids[after[at]], hit[1]))

        for i in range(end - 1):
            push(i)
        while heap:
            _, at, left, right, new = heapq.heappop(heap)
            nxt = after[at]
            if ids[at] != left or nxt >= end or ids[nxt] != right:
                continue
            ids[at], ids[nxt] = new, -1
            after[at] = after[nxt]
            if after[at] < end:
                before[after[at]] = at
            push(before[at])
            push(at)
        return [i for i in ids if i >= 0]

    def _piece(self, text: str, out: list[bytes]) -> None:
        cache = self.cache
        for word in self.words.findall(text):
            packed = cache.get(word)
            if packed is None:
                data = word.encode("utf-8", "surrogatepass")
                packed = np.array(self.merge_short(data) if len(data) <= SHORT else self.merge_long(data), "<u4").tobytes()
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = packed
            out.append(packed)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        for i, part in enumerate(self.split.split(text) if self.split and any(s in text for s in self.special) else [text]):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                self._piece(part, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The tokenizer of a file, once in each Python process."""
    return Bpe(path)


def with_ids(df: DataFrame, text: str, path: str, decoded: str | None = None) -> DataFrame:
    """``df`` with the binary column ``ids`` (packed ids) and, if named, a column of the text decoded from them.

    Rows go through one Python worker in slices of about SLICE_BYTES of text, so
    its memory is the vocabulary, the cache and a few times a slice or the
    longest text. Columns of the same names are replaced.
    """
    added = [T.StructField("ids", T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    names = {f.name for f in added}
    kept = df.select([c for c in df.columns if c not in names or c == text])
    schema = T.StructType([*(f for f in kept.schema if f.name not in names), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text, SLICE_BYTES):
            ids = [bpe.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in schema if f.name not in names]
            columns.append(pa.array(ids, pa.binary()))
            if decoded:
                columns.append(pa.array([bpe.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)
