"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words are streamed through it and the
longest match ending at each word is tracked: a match of `window` words, or of a whole shorter item, is an
occurrence, and all its words are hit. Only runs of words that items use at all are streamed, since any other
word sets the match to nothing.

Items are taken in blocks of bounded size, one automaton each. Documents pass through the blocks one after another
and each row carries its own hits along, so nothing is joined or grouped, any number of blocks gives the same
rows, and what is broadcast is bounded by a block (or by one item, if it is longer).

Cases: null and empty texts have no words and no hits and stay as they are; items without words match nothing; an
item_id that occurs with several texts is one item; an item without an id hits words but is not listed; rows are
judged one by one, so a null, repeated or shared doc_id changes nothing; empty tables give no rows or no
hits; other columns of documents are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsdesk.llm.arrays import PLAIN_WORD, Words, slices, text_buffer, tidy
from newsdesk.llm.tables import spare, stored

WINDOW = 10
#: Bytes of item texts in one automaton.
BLOCK_BYTES = 1 << 19
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """Generalised suffix automaton over word numbers; a state in which an occurrence ends knows the items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        paths: list[tuple[int, list[int]]] = []
        self.names: list[str | None] = []
        for name, words in items:
            if not words:
                continue
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.numbers.setdefault(w, len(self.numbers)))
                path.append(last)
            paths.append((len(self.names), path))
            self.names.append(name)
        #: items of the states that hold their windows, and (length, item) of the short items that end in a state
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for item, path in paths:
            if len(path) < window:
                self.whole.setdefault(self._holder(path[-1], len(path)), []).append((len(path), item))
            for state in path[window - 1 :]:
                self.items.setdefault(self._holder(state, window), set()).add(item)
        self.shortest = min([window, *(len(p) for _, p in paths)], default=window)

    def _holder(self, state: int, length: int) -> int:
        """The state that holds the last `length` words of a state's longest run."""
        while self.link[state] >= 0 and self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _extend(self, last: int, w: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            if size[q] == size[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def packed(self) -> dict:
        """The automaton as flat arrays, which are what is sent to tasks."""
        n = max(1, len(self.numbers))
        flat = [(state * n + w, to) for state, out in enumerate(self.next) for w, to in out.items()]
        keys, to = (np.array(x, np.int64) for x in zip(*flat, strict=True)) if flat else (np.empty(0, np.int64),) * 2
        words = pa.array([w.decode("utf-8", "replace") for w in self.numbers], pa.string())
        # the words' own hashes, made as the documents' are
        data, offsets = text_buffer(words)
        known = Words(data, offsets, PLAIN_WORD).hashes(data, lower=False) if self.numbers else np.empty(0, np.uint64)
        order = np.argsort(known)
        return {"keys": keys, "to": to, "known": known[order], "number": order, "link": np.array(self.link), "size": np.array(self.size), "items": self.items, "whole": self.whole, "names": self.names, "window": self.window, "shortest": self.shortest}


class Stream:
    """Longest matches of runs of word numbers in a packed automaton."""

    def __init__(self, packed: dict):
        self.known, self.number, self.names = packed["known"], packed["number"], packed["names"]
        self.window, self.shortest, self.items, self.whole = packed["window"], packed["shortest"], packed["items"], packed["whole"]
        self.words = max(1, len(self.known))
        self.to = dict(zip(packed["keys"].tolist(), packed["to"].tolist(), strict=True))
        self.link, self.size = packed["link"].tolist(), packed["size"].tolist()

    def run(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Occurrences (first, end) and items in a run, and the longest match."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = length = longest = 0
        to, words, link, size, window = self.to.get, self.words, self.link, self.size, self.window
        for i, w in enumerate(numbers):
            nxt = to(state * words + w)
            while state and nxt is None:
                state = link[state]
                length = size[state]
                nxt = to(state * words + w)
            if nxt is not None:
                state = nxt
                length += 1
            longest = max(longest, length)
            if length < self.shortest:
                continue
            widest, at = 0, state
            while at > 0:
                for n, item in self.whole.get(at, ()):
                    if n <= length:
                        widest = max(widest, n)
                        found.add(item)
                if length >= window and size[at] >= window > size[link[at]]:
                    widest = window
                    found |= self.items.get(at, set())
                at = link[at]
            if widest:
                spans.append((i + 1 - widest, i + 1))
        return spans, found, longest

    def hits(self, words: Words, h: np.ndarray) -> dict[int, tuple]:
        """(spans, item names, longest match) of each text with a match; spans are merged word numbers of the text."""
        if not len(self.known) or not len(h):
            return {}
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        number = np.where(self.known[at] == h, self.number[at], -1)
        inside = number >= 0
        cut = np.zeros(len(h) + 1, bool)
        cut[words.first] = True
        joined = inside[1:] & inside[:-1] & ~cut[1:-1]
        begin = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
        end = np.flatnonzero(inside & ~np.concatenate((joined, [False]))) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        doc = np.searchsorted(words.first, begin, "right") - 1
        out: dict[int, tuple] = {}
        for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
            spans, found, longest = self.run(number[a:b].tolist())
            if longest:
                own = out.get(d, ([], set(), 0))
                base = a - int(words.first[d])
                out[d] = (own[0] + [(base + s, base + e) for s, e in spans], own[1] | {self.names[i] for i in found}, max(own[2], longest))
        return {d: (merged(spans), names - {None}, longest) for d, (spans, names, longest) in out.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str | None, list[bytes]]]]]:
    """The number of blocks, and the items in blocks of bounded size, collected one block at a time."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))

    def blocks() -> Iterator[list[tuple[str | None, list[bytes]]]]:
        for k in range(n):
            rows = (b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
            yield [(r["item_id"], item_words(r["text"])) for r in sorted(rows, key=lambda r: (r["item_id"] or "", r["text"]))]

    return n, blocks()


HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
HIT_DDL = "struct<n_words:long,n_hit:long,starts:array<long>,ends:array<long>,items:array<string>,longest:long>"
Finish = Callable[[pa.RecordBatch, list[dict], Words], pa.RecordBatch]


def _pass(docs: DataFrame, items: list, window: int, text_col: str, before: str | None, finish: Finish, schema: str | StructType) -> DataFrame:
    """docs through one block: `before` names the column with the hits so far, `finish` makes the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(items, window).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(shared.value)
        for batch in batches:
            for part in slices(batch, text_col):
                data, offsets = text_buffer(part.column(text_col))
                words = Words(data, offsets, PLAIN_WORD)
                found = stream.hits(words, words.hashes(data) if len(words.starts) else np.empty(0, np.uint64))
                had = part.column(before).to_pylist() if before else [None] * part.num_rows
                rows = []
                for d, (n, old) in enumerate(zip(np.diff(words.first).tolist(), had, strict=True)):
                    spans, names, longest = found.get(d, ([], set(), 0))
                    if old is not None:
                        spans, names, longest = merged(spans + list(zip(old["starts"], old["ends"], strict=True))), names | set(old["items"]), max(longest, old["longest"])
                    rows.append({"n_words": n, "n_hit": sum(e - s for s, e in spans), "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(names), "longest": longest})
                if before:
                    part = part.drop_columns([before])
                yield finish(part, rows, words)

    return docs.mapInArrow(tidy(run), schema)


def _through_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, text_col: str, finish: Finish, schema: str | StructType) -> DataFrame:
    n, blocks = _item_blocks(benchmark, block_bytes)
    column, before = spare(docs, "_hits"), None

    def carry(part: pa.RecordBatch, rows: list[dict], words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, HIT)], names=[*part.schema.names, column])

    carried = docs.withColumn(column, F.lit(None).cast(HIT_DDL)).schema
    for k, items in enumerate(blocks):
        if k == n - 1:
            return _pass(docs, items, window, text_col, before, finish, schema)
        docs, before = stored(_pass(docs, items, window, text_col, before, carry, carried), "hits"), column
    raise AssertionError("there is a last block")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, word spans [starts, ends) of the hit words, items (sorted, distinct) and
    the longest match."""

    def finish(part: pa.RecordBatch, rows: list[dict], words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), *pa.array(rows, HIT).flatten()], names=["doc_id", *(f.name for f in HIT)])

    return _through_blocks(docs.select(id_col, text_col), benchmark, window, block_bytes, text_col, finish, "doc_id long, " + HIT_DDL[7:-1].replace(":", " "))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the benchmark passages; those of which more than max_coverage of the words are hit go.

    Of a span the words and what stands between them are cut. docs needs a text; n_chars follows it if docs has one."""

    def finish(part: pa.RecordBatch, rows: list[dict], words: Words) -> pa.RecordBatch:
        texts = part.column("text").to_pylist() if any(r["n_hit"] for r in rows) else []
        for d, r in enumerate(rows):
            if r["n_hit"]:
                raw, first = texts[d].encode(), int(words.first[d])
                base = int(words.offsets[d])
                kept, at = [], 0
                for s, e in zip(r["starts"], r["ends"], strict=True):
                    kept.append(raw[at : int(words.starts[first + s]) - base])
                    at = int(words.ends[first + e - 1]) - base
                texts[d] = (b"".join(kept) + raw[at:]).decode()
        columns = dict(zip(part.schema.names, part.columns, strict=True))
        if texts:
            hit = pa.array([bool(r["n_hit"]) for r in rows])
            columns["text"] = pa.array(texts, part.schema.field("text").type)
            if "n_chars" in columns:
                sizes = pa.array([len(t) if t is not None else 0 for t in texts]).cast(part.schema.field("n_chars").type)
                columns["n_chars"] = pc.if_else(hit, sizes, columns["n_chars"])
        out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        return out.filter(pa.array([r["n_hit"] <= r["n_words"] * max_coverage for r in rows]))

    return _through_blocks(docs, benchmark, window, block_bytes, "text", finish, docs.schema)


def op9_benchmark_decontamination(spark, sf_dir):
    from newsdesk.llm.tables import read

    hits = benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (
  select distinct cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (
  select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
sizes as (select distinct n from win),
g as (
  select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, sizes where len(ws) >= n)),
m as (select doc_id, i, g.n, item_id from g join win using (g)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from m)) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from m group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (doc_id) left join it using (doc_id)
"""
