"""Secret scans by sliding-window entropy.

Fixed patterns give the base spans (kinds assign, access, hex). The method adds
spans of kind entropy: in every candidate string (a run of 20 or more key-like
characters) a window moves over the characters of each class; the counts of its
characters are changed by the one that enters and the one that leaves, and so is
the sum of c*log2(c), which gives the Shannon entropy of each window in O(1).
Windows at or above the class's threshold are merged. The sum is kept in whole
numbers (units of 2^-40), so that it doesn't drift over a long candidate.

The allow-list suppresses added spans only, never base spans: a candidate that is a
UUID, and of a merged span the leading and closing parts between slashes that are a
repeated group, a number, name a placeholder or read like words. What is left is
kept if it still fills a window, so that a secret is found in an address whose other
parts are allowed.

Null and empty texts have no spans; an empty table gives an empty one. Repeated
rows each give their row. Spans are in code points, the end exclusive. Only the text
column is read or replaced, whatever other columns are named. Long texts are scanned
whole; a task holds a slice of SLICE_BYTES of text or the longest text, a few times.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.text import slices

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Class, window, least entropy in bits. A window of 20 random hexadecimal digits has about 3.3 bits, one of 20 random base-64 characters about 4.1.
CLASSES = ((frozenset("0123456789abcdef"), 20, 3.0), (frozenset("0123456789ABCDEF"), 20, 3.0), (None, 20, 3.75))
#: Characters that an added span has at least.
LEAST_SPAN = 20
#: Candidates that are no secrets.
UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
#: Parts of spans that are no secrets: none, one repeated group, numbers, and words that name a placeholder.
ALLOW = re.compile(r"|(.{1,4}?)\1+|[0-9_=+-]+|.*(example|placeholder|changeme|dummy).*", re.I)
LETTERS = re.compile(r"[A-Za-z_=+-]+")
#: Parts of letters read like words with a share of vowels within these limits, and few or all letters in upper case.
VOWELS, LEAST_VOWELS, MOST_VOWELS, MOST_UPPER = frozenset("aeiouyAEIOUY"), 0.22, 0.65, 0.3

SLICE_BYTES = 1 << 20
UNIT = 1 << 40
_XLOGX = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, 257))]


def like_words(s: str) -> bool:
    """Whether a string of letters and separators looks like words: enough vowels, few or all letters in upper case."""
    letters = [c for c in s if c.isalpha()]
    if not letters or not LETTERS.fullmatch(s):
        return False
    vowels, upper = (sum(f) / len(letters) for f in ([c in VOWELS for c in letters], [c.isupper() for c in letters]))
    return LEAST_VOWELS <= vowels <= MOST_VOWELS and (upper <= MOST_UPPER or upper == 1)


def without_allowed(s: str, a: int, b: int) -> tuple[int, int]:
    """The span a:b of ``s`` less the parts at its ends that the allow-list suppresses."""
    allowed = lambda part: bool(ALLOW.fullmatch(part)) or like_words(part)
    while a < b:
        cut = s.find("/", a, b)
        if not allowed(s[a : cut if cut >= 0 else b]):
            break
        a = cut + 1 if cut >= 0 else b
    while a < b:
        cut = s.rfind("/", a, b)
        if not allowed(s[cut + 1 if cut >= 0 else a : b]):
            break
        b = max(a, cut)
    return a, b


def entropy_runs(s: str, allowed: frozenset | None, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Merged spans of ``s`` whose windows hold only ``allowed`` characters and reach ``least`` bits."""
    counts: dict[str, int] = {}
    total, size, begin, end = 0, 0, -1, -1
    most = math.floor((math.log2(window) - least) * window * UNIT)
    for i, c in enumerate(s):
        if allowed is not None and c not in allowed:
            counts, total, size = {}, 0, 0
            continue
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _XLOGX[k + 1] - _XLOGX[k]
        size += 1
        if size > window:
            out = s[i - window]
            k = counts[out]
            counts[out] = k - 1
            total -= _XLOGX[k] - _XLOGX[k - 1]
            size = window
        if size == window and total <= most:
            if i + 1 - window > end:
                if end > 0:
                    yield begin, end
                begin = i + 1 - window
            end = i + 1
    if end > 0:
        yield begin, end


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind in the order of KINDS."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    candidates = [(m.start(), m[0]) for m in CANDIDATE.finditer(text)]
    for at, s in candidates:  # a hexadecimal run of 32 lies in such a run
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(s) if m.end() - m.start() >= 32]
    for at, s in candidates:
        if UUID.fullmatch(s):
            continue
        runs = sorted({run for known, window, least in CLASSES for run in entropy_runs(s, known, window, least)})
        end = -1
        for a, b in runs:
            a, b = without_allowed(s, a, b)
            if b > end and b - a >= LEAST_SPAN:
                found.append((at + a, 3, at + b))
                end = b
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.struct([pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32())])


def _spans(texts: list[str | None]) -> pa.Array:
    """One list of spans for each text, without a Python object per field."""
    found = [scan(t) for t in texts]
    kinds, starts, ends = zip(*itertools.chain.from_iterable(found)) if any(found) else ((), (), ())
    values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_ARROW))
    return pa.ListArray.from_arrays(pa.array(itertools.accumulate(map(len, found), initial=0), pa.int32()), values)


def with_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with the array of spans of ``text`` as the column ``out``; a column of that name is replaced."""
    kept = df.select([df[f"`{c}`"] for c in df.columns if c != out or c == text])
    schema = T.StructType([*(f for f in kept.schema if f.name != out), T.StructField(out, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in schema if f.name != out]
            yield pa.RecordBatch.from_arrays([*columns, _spans(batch.column(batch.schema.get_field_index(text)).to_pylist())], schema.names)

    return kept.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by a mark."""
    out, done = [], 0
    for _, start, end in sorted(scan(text), key=lambda s: s[1:]):
        if end > done:
            if start >= done:
                out += [text[done:start], "[SECRET]"]
            done = end
    return "".join([*out, text[done:]]) if out else text


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by ``[SECRET]``; a null text stays null."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            at = batch.schema.get_field_index(text)
            masked = pa.array([mask(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else batch.column(i) for i in range(batch.num_columns)], schema.names)

    return df.mapInArrow(run, schema)
