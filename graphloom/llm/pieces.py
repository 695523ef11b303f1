"""SentencePiece encoding and decoding with a public merge-type model's pieces.

The model joins two neighbouring symbols whenever their concatenation is a piece,
the best score first, the leftmost on ties. An encoding is that of the whole text
exactly if every piece alone and every two adjacent pieces come out again when
their characters are merged anew, as the joins inside a piece never depend on what
stands beside it. So a text is encoded from left to right: an Aho-Corasick
automaton gives the longest piece at each place; a piece is taken if the place
after it hasn't failed and it is compatible with the piece before it, else the next
shorter piece that begins it is tried; where none is left, the place is marked in a
bit field of failed places and the piece before it is given back. No place fails
twice, so a long word without spaces takes time in proportion to its length.

Characters that no joining piece holds (digits, line ends) and the beginnings of
runs of spaces after other characters are never inside a piece, so texts are cut
there first, which is exact too; each Python worker keeps the ids of the latest
parts (two generations of CACHE) and which pairs are compatible. A symbol that is no piece becomes its UTF-8
bytes.

Null and empty texts have the begin and end ids only. Repeated rows each give their
row; an empty table gives an empty one. Texts are encoded whole, in slices of rows.
"""

from __future__ import annotations

import functools
import re
from codecs import register_error
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.text import slices

SPACE = "\u2581"
CACHE = 200_000
SLICE_BYTES = 1 << 20
NORMAL, CONTROL, BYTE = 1, 3, 6

register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Pieces:
    """The pieces of a merge-type model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or rule.precompiled_charsmap or rule.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models that leave the text as it is are supported")
        if not model.trainer_spec.byte_fallback or {p.type for p in model.pieces} - {NORMAL, 2, CONTROL, BYTE}:
            raise ValueError("only models with byte fallback and without symbols of a user are supported")
        self.begin, self.end, self.prefix = model.trainer_spec.bos_id, model.trainer_spec.eos_id, SPACE if rule.add_dummy_prefix else ""
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.loss = {p.piece: -p.score for p in model.pieces if p.type == NORMAL and len(p.piece) > 1}
        bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_id = [bytes_at[b] for b in range(256)]
        self.bytes_of = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        self.bytes_of[model.trainer_spec.unk_id] = model.trainer_spec.unk_surface.encode()
        for b, i in bytes_at.items():
            self.bytes_of[i] = bytes([b])
        self.first_may_begin = {i for p, i in self.id_of.items() if p.startswith(SPACE)}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}

        joining = [p for p in self.loss]
        inside = {c for p in joining for c in p} - {SPACE}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in joining):
            self.parts = re.compile(f"[{SPACE}{_ranges(inside)}]+|.", re.S)
        else:
            self.parts = re.compile(f"{SPACE}*[{_ranges(inside)}]+|{SPACE}+|.", re.S) if inside else re.compile(f"{SPACE}+|.", re.S)
        whole = {p for p in self.id_of if len(p) == 1 or self.merged(p) == [p]}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), p[:1] if len(p) > 1 else "") for p in whole}
        self.most = max(map(len, whole))
        self.found = ahocorasick.Automaton()
        for p in whole:
            self.found.add_word(p, (len(p) - 1, p))
        self.found.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.packed_of = {p: i.to_bytes(4, "little") for p, i in self.id_of.items()}
        self.packed_byte = [i.to_bytes(4, "little") for i in self.byte_id]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols of a short text by joining the best pair again and again."""
        parts, get, none = list(text), self.loss.get, float("inf")
        losses = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while losses and (least := min(losses)) != none:
            at = losses.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del losses[at]
            if at:
                losses[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(losses):
                losses[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether two adjacent pieces come out again when their characters are merged anew."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def split(self, part: str) -> list[str]:
        """The pieces of a text by backtracking over the longest pieces."""
        if len(part) == 1 or part in self.shorter:
            return [part]
        size, search, known, shorter_of, compatible = len(part), self.found.iter_long, self.pairs.get, self.shorter.get, self.compatible
        out: list[str] = []
        at, last = 0, ""
        for end, (back, piece) in search(part):  # the longest piece at each place, as long as all fit together
            if end - back != at or last and not (known((last, piece)) or compatible(last, piece)):
                break
            out.append(piece)
            at, last = end + 1, piece
        if at == size:
            return out
        longest: dict[int, str] = {}

        def longest_at(place: int) -> str:
            for end, (back, piece) in search(part[place : place + self.most]):
                if end == back:
                    return piece
                break
            return part[place]  # a character that is no piece stands for itself

        failed = bytearray((size >> 3) + 1)
        piece = longest_at(at)
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not last or known((last, piece)) or compatible(last, piece)):
                out.append(piece)
                if end == size:
                    return out
                at, last = end, piece
                piece = longest.get(end) or longest.setdefault(end, longest_at(end))
            elif shorter := shorter_of(piece, ""):
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("the model's pieces contradict each other")
                piece = out.pop()
                last = out[-1] if out else ""
                at -= len(piece)

    def _packed(self, part: str) -> bytes:
        packed_of = self.packed_of.get
        return b"".join([packed_of(p) or b"".join(self.packed_byte[b] for b in p.encode("utf-8", "surrogatepass")) for p in self.split(part)])

    def _of(self, part: str) -> bytes:
        """The ids of a part that is not among the latest ones: from the older ones, else by splitting."""
        packed = self.old.get(part) or self._packed(part)
        if len(part) <= 64:
            if len(self.cache) >= CACHE:
                self.cache, self.old = {}, self.cache
            self.cache[part] = packed
        return packed

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = [self.begin.to_bytes(4, "little")] if begin else []
        for part in self.parts.findall(self.prefix + text.replace(" ", SPACE)) if text else ():
            out.append(self.cache.get(part) or self._of(part))
        if end:
            out.append(self.end.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids without the space put before it; a byte that is not UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        runs = [numbers] if self.silent.isdisjoint(numbers[1:-1]) else [list(g) for silent, g in groupby(numbers, self.silent.__contains__) if not silent]
        text = "".join(b"".join(map(self.bytes_of.__getitem__, run)).decode("utf-8", "each_byte") for run in runs)
        first = next((i for i in numbers if i not in self.silent), None)
        return text[1:] if self.prefix and first in self.first_may_begin else text


def _ranges(chars: set[str]) -> str:
    """The inside of a character class."""
    out, codes = [], sorted(map(ord, chars))
    begin = 0
    for i, code in enumerate(codes):
        if i + 1 == len(codes) or codes[i + 1] != code + 1:
            out.append(re.escape(chr(codes[begin])) + (f"-{re.escape(chr(code))}" if i > begin else ""))
            begin = i + 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The pieces of a file, once in each Python process."""
    return Pieces(path)


def with_pieces(df: DataFrame, text: str, path: str, decoded: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """``df`` with the binary column ``ids`` (packed ids) and, if named, a column of the text decoded from them.

    A Python worker holds the model, its caches and a few times a slice of
    SLICE_BYTES of text or the longest text. Columns of the same names are replaced.
    """
    added = [T.StructField("ids", T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    names = {f.name for f in added}
    kept = df.select([df[f"`{c}`"] for c in df.columns if c not in names or c == text])
    schema = T.StructType([*(f for f in kept.schema if f.name not in names), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in slices(batches, text, SLICE_BYTES):
            ids = [pieces.encode(t, begin, end) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in schema if f.name not in names]
            columns.append(pa.array(ids, pa.binary()))
            if decoded:
                columns.append(pa.array([pieces.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)
