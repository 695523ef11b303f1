"""Substring deduplication: words in windows of 35 words that start anywhere else are removed.

1. Count-min prefilter. Equal windows have equal minimizers (the word 10-gram of
   least hash in the window), each at a place of its own, so counting minimizer
   places overestimates window counts. Every task fills a sketch of two rows of
   cells that saturate at two; the sketches are merged slice by slice (cells at
   one or more, cells at two or more) in a stream, and only the bits "two or
   more" are broadcast: WIDTH / 4 bytes in all, whatever the input.
2. Exact pass. Windows whose minimizer is estimated repeated (none that repeats
   is missed) are grouped by 128 bits: two 64-bit hashes, each over its own 64-bit
   hash of every word's bytes. Each task first groups its own: a
   hash that it has more than once is known to repeat, and one row stands for
   all of them, so that a hot window sends a row per task. Rows of a hash meet
   sorted in one partition and are compared with their neighbours in a stream.
3. The starts of repeated windows are combined to blocks of 64 bits, first in the
   tasks that find them, then gathered per document and joined to the texts, whose
   covered words are dropped.

A wider sketch than the data needs costs memory, a narrower one sends more rows
to the exact pass; the result is the same. Null and empty texts have no words; an
empty table gives an empty one. Ids are integers (or cast to them). Repeated rows
are elsewhere for each other, so their windows all repeat. Rows without an id or
with a repeated one are told apart by a 64-bit hash of their text as well. Only
the id and the text of ``docs`` are read, whatever other columns are named. Texts
are processed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut
from graphloom.llm.text import mix, raw, rolling, slices, spans, word_hashes

WINDOW, GRAM = 35, 10
#: Cells of each of the sketch's two rows, and the slices in which they are merged.
WIDTH, SLICES = 1 << 25, 32
SEGMENT = 1 << 22
#: Windows that a task groups at a time before it sends them.
FLUSH = 1 << 20
#: Stands for a missing id in joins.
NO_ID = -(1 << 62)


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start word, text row, word within the text, minimizer hash, minimizer place) of all windows of a string array."""
    data, offsets = raw(column)
    start, end, first = spans(data, offsets)
    hashes = word_hashes(data, start, end)
    grams = rolling(hashes, GRAM, 1)
    count = max(0, len(hashes) - WINDOW + 1)
    place = np.zeros(count, np.int64)
    span = WINDOW - GRAM + 1
    for at in range(0, count, SEGMENT):
        stop = min(count, at + SEGMENT)
        part = grams[at : stop + span - 1]
        key = (part & ~np.uint64((1 << 23) - 1)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
        place[at:stop] = (key[: stop - at] & np.uint64((1 << 23) - 1)).astype(np.int64) + at
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    begin = np.arange(count)
    whole = begin[row[:count] == row[WINDOW - 1 :]] if count else begin
    return whole, row[whole], whole - first[row[whole]], grams[place[whole]] if count else grams[:0], place[whole]


def _cells(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64(width - 1)
    return (h & last).astype(np.int64), (mix(h + np.uint64(77)) & last).astype(np.int64)


def sketch(texts: DataFrame, width: int) -> list[np.ndarray]:
    """For both rows of the merged count-min sketch the packed bits of cells that counted two or more."""
    share = width // SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(width, np.uint8) for _ in range(2)]
        for batch in slices(batches, "text"):
            _, _, _, grams, place = windows(batch.column(batch.schema.get_field_index("text")))
            grams = grams[np.unique(place, return_index=True)[1]]
            for table, cells in zip(tables, _cells(grams, width), strict=True):
                cell, n = np.unique(cells, return_counts=True)
                table[cell] = np.minimum(table[cell] + n, 2)
        for r, table in enumerate(tables):
            for s in range(SLICES):
                part = table[s * share : (s + 1) * share]
                if part.any():
                    packed = [zlib.compress(np.packbits(part >= k).tobytes(), 1) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([r * SLICES + s], pa.int32()), pa.array(packed[:1]), pa.array(packed[1:])], ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])], ["slice", "twice"])

        for batch in batches:
            for i in range(batch.num_rows):
                no = batch.column(0)[i].as_py()
                a, b = (np.frombuffer(zlib.decompress(batch.column(k)[i].as_py()), np.uint8) for k in (1, 2))
                if no != at:
                    if at is not None:
                        yield out()
                    at, once, twice = no, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if at is not None:
            yield out()

    parts = texts.mapInArrow(fill, "slice int, once binary, twice binary")
    merged = parts.repartition(2 * SLICES, "slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, twice binary")
    bits = [np.zeros(width // 8, np.uint8) for _ in range(2)]
    for r in merged.collect():  # at most 2 * SLICES rows, WIDTH / 4 bytes in all
        at = r["slice"] % SLICES * (share // 8)
        bits[r["slice"] // SLICES][at : at + share // 8] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return bits


def _set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def repeated_starts(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, start, n) of ``texts`` (doc_id, mark, text): runs of n window starts, in words of the text, whose windows also start elsewhere; a null doc_id is NO_ID."""
    bits = texts.sparkSession.sparkContext.broadcast(sketch(texts, width))
    names = ["h1", "h2", "doc_id", "mark", "start", "n"]

    def group(h1, h2, doc, mark, start) -> pa.RecordBatch:
        """One row for each hash of a task: with its place if it came once, else with n = 0 and its places as runs without hash."""
        order = np.lexsort((h2, h1))
        h1, h2, doc, mark, start = (x[order] for x in (h1, h2, doc, mark, start))
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(h1)))
        lone = np.repeat(size == 1, size)
        reps = np.flatnonzero(new & ~lone)
        i = np.flatnonzero(~lone)
        i = i[np.lexsort((start[i], mark[i], doc[i]))]
        d, t, s = doc[i], mark[i], start[i]
        fresh = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1)) if len(i) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        k = np.flatnonzero(lone)
        cols = [
            np.concatenate((h1[k], h1[reps], d[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64),
            np.concatenate((h2[k], h2[reps], np.zeros(len(at), np.uint64))).view(np.int64),
            np.concatenate((doc[k], np.zeros(len(reps), np.int64), d[at])),
            np.concatenate((mark[k], np.zeros(len(reps), np.int64), t[at])),
            np.concatenate((start[k], np.zeros(len(reps), np.int32), s[at])),
            np.concatenate((np.ones(len(k), np.int32), np.zeros(len(reps), np.int32), -np.diff(np.append(at, len(i))).astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = 0
        for batch in slices(batches, "text"):
            ids, marks, column = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "mark", "text"))
            begin, row, word, grams, _ = windows(column)
            one, two = _cells(grams, width)
            hit = _set(bits.value[0], one) & _set(bits.value[1], two)
            if not hit.any():
                continue
            data, offsets = raw(column)
            start, end, _ = spans(data, offsets)
            begin, row, word = begin[hit], row[hit], word[hit].astype(np.int32)
            own = [rolling(word_hashes(data, start, end, k), WINDOW, 2 + k)[begin] for k in (0, 1)]
            kept.append((*own, ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)[row], marks.to_numpy(zero_copy_only=False)[row], word))
            held += len(begin)
            if held >= FLUSH:
                yield group(*(np.concatenate(x) for x in zip(*kept, strict=True)))
                kept, held = [], 0
        if kept:
            yield group(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row is judged with both neighbours, so a batch's last row waits for the
        # next batch and takes the row before it along.
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if not len(cols[0]):
                continue
            low = 0
            if held is not None:
                low = len(held[0]) - 1
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            yield _settled(cols, low, len(cols[0]) - 1)
            held = [c[-2:] for c in cols]
        if held is not None:
            yield _settled(held, len(held[0]) - 1, len(held[0]))

    rows = texts.mapInArrow(find, "h1 long, h2 long, doc_id long, mark long, start int, n int")
    rows = rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2")
    return rows.mapInArrow(meet, "doc_id long, mark long, start int, n int")


def _settled(cols: list[np.ndarray], low: int, high: int) -> pa.RecordBatch:
    """(doc_id, mark, start, n) of repeated starts among the rows low..high of sorted rows; the rows around serve as neighbours."""
    h1, h2, doc, mark, start, n = cols
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (n[1:] >= 0) & (n[:-1] >= 0)
    twin = np.append(False, same) | np.append(same, False)
    take = (n < 0) | (twin & (n == 1))
    take[:low], take[high:] = False, False
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[take], mark[take], start[take], np.abs(n[take]))], ["doc_id", "mark", "start", "n"])


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    again = own.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    mark = F.when(F.col("doc_id").isNull() | F.col("again").isNotNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)
    texts = own.join(cut(again, "repeated-ids"), F.col("doc_id") == F.col("again"), "left").select("doc_id", "text", mark.alias("mark"))
    each = repeated_starts(texts, width).select("doc_id", "mark", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("start"))
    blocks = each.groupBy("doc_id", "mark", F.shiftright("start", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, start & 63)")).alias("bits"))
    blocks = blocks.groupBy(F.col("doc_id").alias("run_id"), F.col("mark").alias("run_mark")).agg(F.collect_list(F.struct("block", "bits")).alias("blocks"))
    known = F.coalesce("doc_id", F.lit(NO_ID))
    joined = texts.join(blocks, (known == F.col("run_id")) & (F.col("mark") == F.col("run_mark")), "left").select("doc_id", "text", "blocks")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = raw(batch.column(1))
            start, end, first = spans(data, offsets)
            covered = np.zeros(len(start) + 1, np.int64)
            for i, marks in enumerate(batch.column(2).to_pylist()):
                for m in marks or ():
                    bits = np.unpackbits(np.array([m["bits"]], "<i8").view(np.uint8), bitorder="little")
                    at = first[i] + m["block"] * 64 + np.flatnonzero(bits)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + WINDOW, -1)
            keep = np.cumsum(covered)[:-1] == 0
            size = np.where(keep, end - start + 1, 0)
            stop = np.concatenate(([0], np.cumsum(size)))
            line = np.full(int(stop[-1]), 32, np.uint8)
            long = np.where(keep, end - start, 0)
            within = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
            line[within + np.repeat(stop[:-1], long)] = data[within + np.repeat(start, long)]
            text, edge = line.tobytes(), stop[first]
            out = [text[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            total = np.diff(first)
            removed = total - np.diff(np.concatenate(([0], np.cumsum(keep)))[first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(removed), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(rebuild, "doc_id long, n_words long, n_removed long, kept_text string")
