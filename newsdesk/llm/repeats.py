"""Removal of repeated byte strings with a run-length index of the texts around shared anchors.

A byte goes if a string of SPAN bytes that covers it also starts earlier: in a document of smaller id, or
earlier in its own. No pair of documents is compared and no text meets all others:

1. Every string of SPAN bytes picks the ANCHOR-byte string of the smallest hash within it, the leftmost on ties.
   Equal strings pick equal anchors at equal places, so they meet at their anchor; neighbouring strings mostly
   pick the same one, which leaves about one anchor in 33 bytes. An anchor's context is the union of the strings
   that picked it. Only hashes of anchors and contexts are shuffled; each task sends one row for the
   contexts that occur several times in what it holds together.
2. A context that occurs earlier with all its bytes is covered. Anchors with different contexts stay open, and
   the earliest occurrence of each of their contexts is cut out of its document.
3. The open contexts are dealt into blocks by anchor. For each block a run-compressed Burrows-Wheeler transform is
   built, with suffix samples and match lengths kept at the ends of runs alone. Matching statistics are streamed in
   text order: each position's match and its length follow from the last sample before it. Matches of SPAN
   bytes chain the positions of equal strings, and all but the earliest of each chain are marked.
4. Anchors with more open contexts than a block holds go another exact way: every string of theirs is hashed,
   and the earliest place of each hash is found by a partial aggregation.

Contexts, and strings in step 4, count as equal if their 64-bit hashes and their anchors' are equal.

Cases: null texts are empty; texts shorter than SPAN lose nothing; a document is a doc_id with a text: rows that repeat
both are one document for matching, each with its own result, and texts that share a doc_id are documents of
their own, in the order of their hashes; rows without a doc_id come before all others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.arrays import BYTE_VALUES, Rolling, mix, slices, text_buffer, tidy
from newsdesk.llm.tables import stored

SPAN, ANCHOR = 100, 36
#: Strings that one anchor can serve, and the longest context.
STEP = SPAN - ANCHOR + 1
CONTEXT = SPAN + STEP - 1
#: Bytes of contexts in one index, and contexts of an anchor that are indexed together.
BLOCK_BYTES, HOT_CONTEXTS = 1 << 20, 5_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor start, first string, last string, anchor hash, context hash) of every anchor; places in data."""
    sizes = np.diff(offsets)
    none = np.empty(0, np.int64)
    if not (sizes >= SPAN).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(BYTE_VALUES[data])
    h = rolling.windows(ANCHOR)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= STEP:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < STEP:
        least = np.minimum(least[: len(least) - (STEP - width)], least[STEP - width :])
    doc = np.flatnonzero(sizes >= SPAN)
    counts = sizes[doc] - SPAN + 1
    begin = np.concatenate(([0], np.cumsum(counts)))
    s = np.arange(begin[-1]) + np.repeat(offsets[doc] - begin[:-1], counts)
    picked = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = picked[1:] != picked[:-1]
    new[begin[:-1]] = True
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(s)) - 1
    a, lo, hi = picked[at], s[at], s[last]
    context = mix(rolling.hashes(lo, hi + SPAN) + (a - lo).astype(np.uint64))
    return np.repeat(doc, counts)[at], a, lo, hi, h[a], context


def _packed(start: np.ndarray, left: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Start of the anchor (in its document), bytes before it, and strings of the context, in one number."""
    return start << 16 | left << 8 | strings


#: A row is known by its doc_id and the hash of its text; a missing doc_id counts as the smallest number.
NO_ID = -(1 << 63)
ROW = ("doc", "twin")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, twin, text) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(anchor, context, doc, twin, place, copy): a copy's context stands earlier in the same slice of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                of, a, lo, hi, key, context = anchors(data, offsets)
                doc, twin = (part.column(c).to_numpy()[of] for c in ROW)
                place = _packed(a - offsets[of], a - lo, hi - lo + 1)
                order = np.lexsort((place, twin, doc, context, key))
                key, context, doc, twin, place = key[order], context[order], doc[order], twin[order], place[order]
                same = np.zeros(len(key), bool)
                same[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key)))) if len(key) else np.empty(0, int)
                again = same & (doc == doc[head]) & (twin == twin[head]) & (place == place[head])
                copy = same & ~again
                # copies are done: they only have to travel, so their rows are spread
                key = np.where(copy, mix(doc.view(np.uint64) + place.view(np.uint64)), key)
                kept = ~again
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (key.view(np.int64), context.view(np.int64), doc, twin, place, copy)], names=["anchor", "context", "doc", "twin", "place", "copy"])

    return texts.mapInArrow(tidy(run), "anchor long, context long, doc long, twin long, place long, copy boolean")


class RunIndex:
    """Run-compressed index of a text of contexts: samples and match lengths at the ends of runs of its
    Burrows-Wheeler transform. Matches never cross contexts."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        """text: bytes of the contexts one after another; ends: for each place the end of its context."""
        n = len(text)
        self.n = n
        place = np.arange(n)
        left = ends - place
        key = np.zeros(n, np.uint64)
        for k in range(7):
            there = place + k < ends
            key = key << np.uint64(9) | np.where(there, text[np.minimum(place + k, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        ranks: list[tuple[int, np.ndarray]] = []
        width = 7
        while True:
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            ranks.append((width, rank))
            if width >= CONTEXT:
                break
            beyond = np.where(width < left, rank[np.minimum(place + width, n - 1)], 0)
            key = rank.astype(np.uint64) << np.uint64(32) | beyond.astype(np.uint64)
            width *= 2
        # order is the suffix array; a context's first place is preceded by its border, code 0
        first = np.zeros(n, bool)
        first[0] = True
        first[1:] = ends[1:] != ends[:-1]
        before = np.where(first, 0, text[np.maximum(place - 1, 0)].astype(np.int64) + 1)
        bwt = before[order]
        head = np.ones(n, bool)
        # borders are not a letter: each is a run of its own
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        runs = np.flatnonzero(head)
        sample, above = order[runs], order[np.maximum(runs - 1, 0)]
        length = np.zeros(len(runs), np.int64)
        for width, rank in reversed(ranks):
            inside = (length + width <= left[sample]) & (length + width <= left[above])
            x, y = np.minimum(sample + length, n - 1), np.minimum(above + length, n - 1)
            length += width * (inside & (rank[x] == rank[y]))
        for _ in range(6):
            x, y = np.minimum(sample + length, n - 1), np.minimum(above + length, n - 1)
            length += (length < left[sample]) & (length < left[above]) & (text[x] == text[y])
        length[0] = 0  # nothing stands above the first suffix
        by_place = np.argsort(sample)
        self.sample, self.above, self.length = sample[by_place], above[by_place], length[by_place]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, in text order: the place of its match (the suffix above it) and the match's length."""
        place = np.arange(self.n)
        j = np.searchsorted(self.sample, place, "right") - 1
        gone = place - self.sample[j]
        return self.above[j] + gone, np.maximum(self.length[j] - gone, 0)

    def earliest(self, span: int) -> np.ndarray:
        """For each place, the first place in the text with the same `span` bytes (itself if none)."""
        match, length = self.statistics()
        place = np.arange(self.n)
        root = np.where(length >= span, match, place)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        first = place.copy()
        np.minimum.at(first, root, place)
        return first[root]


def _covered(starts: np.ndarray, docs: np.ndarray, twins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (doc, twin, from, to) of strings at `starts`, given in order of context and start."""
    if not len(starts):
        return docs, twins, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (twins[1:] != twins[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return docs[at], twins[at], starts[at], starts[np.append(at[1:], len(starts)) - 1] + SPAN


def index_blocks(contexts: DataFrame) -> DataFrame:
    """(doc, twin, from, to) spans found by a run-length index of each block; contexts are sorted by anchor, doc, twin, start."""

    def mark(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        sizes = np.array([len(r[4]) for r in rows])
        ends = np.cumsum(sizes)
        first = RunIndex(text, np.repeat(ends, sizes)).earliest(SPAN)
        strings = sizes - SPAN + 1
        row = np.repeat(np.arange(len(rows)), strings)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
        place = (ends - sizes)[row] + inside
        hit = first[place] < place
        doc, twin, start = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _covered((start[row] + inside)[hit], doc[row[hit]], twin[row[hit]])], names=["doc", "twin", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "twin", "start", "bytes")), strict=True):
                if rows and row[:4] == rows[-1][:4]:
                    continue  # rows that repeat a document are one here
                if size >= BLOCK_BYTES and row[0] != rows[-1][0]:
                    yield mark(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield mark(rows)

    return contexts.mapInArrow(tidy(run), "doc long, twin long, from long, to long")


def hashed_strings(contexts: DataFrame) -> DataFrame:
    """(doc, twin, from, to) spans of the anchors with very many contexts: each string's earliest place by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_buffer(batch.column("bytes").cast(pa.binary()))
            windows = Rolling(BYTE_VALUES[data]).windows(SPAN)
            strings = np.diff(offsets) - SPAN + 1
            row = np.repeat(np.arange(batch.num_rows), strings)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
            key = batch.column("anchor").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(windows[offsets[:-1][row] + inside].view(np.int64)), *(pa.array(batch.column(c).to_numpy()[row]) for c in ROW), pa.array(batch.column("start").to_numpy()[row] + inside)], names=["anchor", "string", *ROW, "start"])

    every = contexts.mapInArrow(tidy(run), "anchor long, string long, doc long, twin long, start long")
    first = every.groupBy("anchor", "string").agg(F.min(F.struct(*ROW, "start")).alias("first"))
    later = every.join(first, ["anchor", "string"]).where(F.struct(*ROW, "start") > F.col("first"))
    return later.select(*ROW, F.col("start").alias("from"), (F.col("start") + SPAN).alias("to"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, twin, text) and (doc, twin, from, to): the texts of the rows and the byte spans to remove; spans may overlap."""
    texts = keyed(docs, id_col, text_col)
    rows = anchor_rows(texts)
    order = Window.partitionBy("anchor").orderBy("context", *ROW, "place")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = rows.withColumn("before", F.lag("context").over(order)).withColumn("after", F.lead("context").over(order)).withColumn("lo", F.min("context").over(whole)).withColumn("hi", F.max("context").over(whole))
    one = Window.partitionBy("anchor", "context").orderBy(*ROW, "place")
    seen = seen.where("copy or before is not null or after is not null")
    seen = seen.withColumn("head", F.first(F.struct(*ROW, "place")).over(one))
    seen = seen.withColumn("covered", F.col("copy") | (F.struct(*ROW, "place") > F.col("head")))
    seen = seen.where("covered or (lo < hi and (before is null or before <> context))")
    start = F.expr("shiftright(place, 16) - (shiftright(place, 8) & 255)")
    found = stored(seen.select("anchor", *ROW, start.alias("from"), (start + F.expr("place & 255") + (SPAN - 1)).alias("to"), "covered"), "anchors")
    covered = found.where("covered").select(*ROW, "from", "to")
    opened = found.where("not covered")
    hot = opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_CONTEXTS).select("anchor", F.lit(True).alias("hot"))
    wanted = opened.groupBy(*ROW).agg(F.collect_list(F.struct("anchor", "from", "to")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                raw = data.tobytes()
                out = {}
                for doc, twin, at, wanted in zip(*(part.column(c).to_pylist() for c in ROW), offsets.tolist(), part.column("wanted").to_pylist(), strict=False):
                    for w in wanted:
                        out[w["anchor"], doc, twin, w["from"]] = raw[at + w["from"] : at + w["to"]]
                yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in out], pa.int64()) for i in range(4)), pa.array(list(out.values()), pa.binary())], names=["anchor", *ROW, "start", "bytes"])

    contexts = texts.join(wanted, list(ROW)).mapInArrow(tidy(cut), "anchor long, doc long, twin long, start long, bytes binary")
    contexts = stored(contexts.join(hot, "anchor", "left"), "contexts")
    usual = contexts.where("hot is null").drop("hot")
    size = usual.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    usual = usual.repartition(max(1, int(size) // (4 * BLOCK_BYTES) + 1), "anchor").sortWithinPartitions("anchor", *ROW, "start")
    spans = covered.unionByName(index_blocks(usual)).unionByName(hashed_strings(contexts.where("hot")))
    return texts, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept], the bytes that stay (binary: a span may
    end inside a character)."""
    texts, spans = repeated_spans(docs, id_col, text_col)
    merged = spans.groupBy(*ROW).agg(F.collect_list("from").alias("from"), F.collect_list("to").alias("to"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                raw = data.tobytes()
                rows = []
                for doc, a, b, lo, hi in zip(part.column("doc").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), part.column("from").to_pylist(), part.column("to").to_pylist(), strict=True):
                    text, n_spans, removed = raw[a:b], 0, 0
                    if lo:
                        kept, at = [], 0
                        for x, y in sorted(zip(lo, hi, strict=True)):
                            if x > at or not n_spans:
                                kept.append(text[at:x])
                                n_spans += 1
                                removed += y - x
                            elif y > at:
                                removed += y - at
                            at = max(at, y)
                        text = b"".join(kept) + text[at:]
                    rows.append((doc if doc != NO_ID else None, b - a, removed, n_spans, hashlib.sha256(text).hexdigest(), *[text] * with_text))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return texts.join(merged, list(ROW), "left").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op5_suffix_array_dedup(spark, sf_dir):
    from newsdesk.llm.tables import read

    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
