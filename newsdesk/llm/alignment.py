"""Alignment of two tokenizers' tokens over the bytes of the same texts, with corpus-wide counts of token pairs.

Text is cut before spaces that follow a letter, digit or ASCII mark: neither tokenizer has a token across such a place, so
both end tokens there. Texts are gathered into blocks as positions in the list of their distinct chunks, and chunks
are tokenised and aligned once for a block. Distinct pairs of linked ids get a minimal perfect hash: pairs are dealt into
buckets that Spark's tasks hash level by level, a bit for each key that is alone in its place, and a pair's index is
the number of bits before its own. Each task then counts its links into one dense vector by that index; vectors are
summed FAN_IN at a time, slice by slice, up a tree. A second pass aligns the blocks again, looks the counts up (the key
at the index must be the pair itself) and adds them up for each document.

Hash, keys and counts are broadcast, which MAX_PAIRS bounds. If there are more distinct pairs, the ids of the second
tokenizer are parted into ranges of at most so many pairs, and the passes run for one range after another.

Cases: null and empty texts, and texts whose tokens of either side do not spell a space and the text, have no tokens; rows that
share or lack a doc_id, and repeated rows, are each aligned and all count; of equally frequent pairs all are best; a text of
any length stays in one block, so memory follows the longest one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import mix, segment_sum, slices, tidy
from newsdesk.llm.pieces import MARK, Block, block_number, model_path, pack, pack_places, processor, segments, unpack, unpack_places
from newsdesk.llm.tables import stored

#: Characters of a block of texts; chunks whose tokens a worker keeps (it starts anew when it would hold more).
BLOCK_CHARS, CACHED_CHUNKS = 1 << 22, 100_000
#: Pairs of one broadcast; pairs that one task hashes; counts of a slice of a vector; vectors that are summed at a time.
MAX_PAIRS, BUCKET_PAIRS, SLICE, FAN_IN = 2_000_000, 50_000, 1 << 16, 16
#: Bits for each key of a level, and levels at most (each one leaves less than half of its keys).
ROOM, LEVELS = 2, 64
#: Chunks that are tokenised in one call.
TOGETHER = 500
#: Ends of chunks: before a space behind one of these characters, none of which is white space.
CUT, OTHER_END, CHUNK = re.compile(r"(?<=[\w!-~])(?= )"), re.compile(r"[^\w!-~ ] "), re.compile(r" *[^ ]+| +")
SOUND_END = re.compile(r"[\w!-~]$")
#: Chunks of printable ASCII, line ends and letters that every version of Unicode in use takes for letters: Latin, Greek, Cyrillic.
_LETTERS = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481"
PLAIN = re.compile(rf" +[\n!-~{_LETTERS}]*[!-~{_LETTERS}]")


def bytes_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def byte_tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def plain_encoder(path: str, table: list[bytes]) -> Callable[[str], list[int]] | None:
    """A faster encoder of the same vocabulary for PLAIN chunks, if the vocabulary is numbered in the order of its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, kind = held["model"], held.get("pre_tokenizer") or {}
    merges = [x.split(" ") if isinstance(x, str) else x for x in model.get("merges", ())]
    ordered = all(model["vocab"].get("".join(x)) == 256 + k for k, x in enumerate(merges))
    if not ordered or model["type"] != "BPE" or model.get("ignore_merges") or kind.get("type") != "ByteLevel" or not kind.get("use_regex") or held.get("normalizer"):
        return None
    ranks = {table[k]: k for k in range(256 + len(merges))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Both tokenizers with the bytes of their tokens and a cache of chunks."""

    def __init__(self, first: str, second: str):
        self.a, self.b = byte_tokenizer(first), processor(second)
        letters = byte_letters()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace(MARK, " ").encode() for k, x in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.plain = plain_encoder(first, self.a_bytes)
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def a_ids(self, text: str, plain: bool) -> list[int]:
        return self.plain(text) if plain and self.plain else self.a.encode(text, add_special_tokens=False).ids

    def _joined(self, chunks: list[str], plain: bool) -> list[tuple[bytes, bytes]]:
        """Tokens of chunks that are encoded as one text, parted again where the chunks end."""
        text = "".join(chunks)
        raw = text.encode()
        ends = np.cumsum(list(map(len, chunks)) if len(raw) == len(text) else [len(c.encode()) for c in chunks])
        sides = []
        for ids, table, sizes in ((self.a_ids(text, plain), self.a_bytes, self.a_sizes), (self.b.encode(text[1:]), self.b_bytes, self.b_sizes)):
            packed = np.array(ids, "<u4")
            reached = np.cumsum(sizes[packed])
            at = np.searchsorted(reached, ends)
            if b"".join(map(table.__getitem__, ids)) != raw or (reached[at] != ends).any():
                return [self._alone(c) for c in chunks]
            cuts, whole = [0, *(4 * at + 4).tolist()], packed.tobytes()
            sides.append([whole[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
        return list(zip(*sides, strict=True))

    def _alone(self, chunk: str) -> tuple[bytes, bytes]:
        """A chunk's ids on both sides; none if a side's bytes are not the chunk's."""
        a, b = self.a_ids(chunk, False), segments(self.b, [MARK if chunk == " " else chunk])[0]
        raw = chunk.encode()
        good = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if good else (b"", b"")

    def learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > CACHED_CHUNKS:
            self.known.clear()
        plain = [c for c in chunks if PLAIN.fullmatch(c)]
        rest = [c for c in chunks if not PLAIN.fullmatch(c)]
        sound = [c for c in rest if len(c) > 1 and SOUND_END.search(c)]
        self.known.update((c, self._alone(c)) for c in rest if not (len(c) > 1 and SOUND_END.search(c)))
        for kind, group in ((True, plain), (False, sound)):
            for k in range(0, len(group), TOGETHER):
                part = group[k : k + TOGETHER]
                self.known.update(zip(part, self._joined(part, kind), strict=True))

    def of(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        new = [c for c in chunks if c not in self.known]
        out = {c: self.known[c] for c in chunks if c in self.known}
        for k in range(0, len(new), CACHED_CHUNKS // 4):
            part = new[k : k + CACHED_CHUNKS // 4]
            self.learn(part)
            out.update((c, self.known[c]) for c in part)
        return [out[c] for c in chunks]


@lru_cache(maxsize=1)
def tokens_of(first: str, second: str) -> Tokens:
    """One cache for all tasks of a worker."""
    return Tokens(first, second)


def chunks_of(text: str, window: int = 1 << 20) -> Iterator[list[str]]:
    """The chunks of a space and the text, a window at a time; none of an empty text."""
    text, at = f" {text}" if text else "", 0
    while at < len(text):
        found = CUT.search(text, at + window)
        end = found.start() if found else len(text)
        part = text[at:end]
        yield CUT.split(part) if OTHER_END.search(part) else CHUNK.findall(part)
        at = end


BLOCKS = "block long, doc_ids array<long>, counts array<long>, places binary, a binary, a_counts binary, b binary, b_counts binary"


def tokenize(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """Blocks of texts with the ids of their distinct chunks on both sides (BLOCKS); chunks that differ have none."""
    fields = [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("places", "a", "a_counts", "b", "b_counts")]
    schema = pa.schema(fields)

    def row(number: int, block: Block) -> pa.RecordBatch:
        found = tokens_of(first, second).of(list(block.index))
        columns = [[number], [block.ids], [block.counts], [pack_places(np.frombuffer(block.places, np.uint32))]]
        for side in (0, 1):
            ids = [x[side] for x in found]
            columns += [[pack(np.frombuffer(b"".join(ids), "<u4"))], [pack(np.array([len(x) // 4 for x in ids], np.int64))]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, made = Block(), 0
        for batch in batches:
            for piece in slices(batch, text_col):
                texts = [t or "" for t in piece.column(text_col).to_pylist()]
                block.size += sum(map(len, texts))
                for doc, text in zip(piece.column(id_col).to_pylist(), texts, strict=True):
                    block.add(doc, chunks_of(text))
                if block.size >= block_chars:
                    yield row(block_number(made), block)
                    block, made = Block(), made + 1
        if block.ids:
            yield row(block_number(made), block)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(tidy(run), BLOCKS)


class Aligned:
    """The chunks of a block, aligned: groups and links of each one, and the documents that have tokens."""

    def __init__(self, row: dict, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.doc_ids, counts = row["doc_ids"], np.array(row["counts"], np.int64)
        self.places = unpack_places(row["places"])
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.a, self.a_counts, self.b, self.b_counts = (unpack(row[c]) for c in ("a", "a_counts", "b", "b_counts"))
        n = len(self.a_counts)
        self.a_end, self.b_end = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        self.cuts = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        a_first, b_first = (np.concatenate(([0], np.cumsum(c))) for c in (self.a_counts, self.b_counts))
        total = np.concatenate(([0], self.a_end))[a_first]
        self.groups = np.diff(np.searchsorted(self.cuts, total, "right"))
        a_start, b_start = self.a_end - a_sizes[self.a], self.b_end - b_sizes[self.b]
        low = np.searchsorted(self.b_end, a_start, "right")
        linked = np.searchsorted(b_start, self.a_end, "left") - low
        self.link_first = np.concatenate(([0], np.cumsum(linked)))[a_first]
        begin = np.cumsum(linked) - linked
        right = np.repeat(low - begin, linked) + np.arange(linked.sum())
        #: the linked ids as one number, chunk by chunk
        self.pairs = np.repeat(self.a, linked) << 32 | self.b[right]
        bad = np.concatenate(([0], np.cumsum((self.a_counts == 0)[self.places])))[self.first]
        self.good = (np.diff(bad) == 0) & (counts > 0)
        #: how often each chunk occurs in documents with tokens
        self.times = np.bincount(self.places[np.repeat(self.good, counts)], minlength=n)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the block and the number of their links."""
        times = np.repeat(self.times, np.diff(self.link_first))
        pairs, of = np.unique(self.pairs[times > 0], return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, of, times[times > 0])
        return pairs, counts

    def written(self, numbers: list[str]) -> list[str]:
        """The groups of each chunk: ids of the first side, a bar, ids of the second, groups parted by semicolons."""
        key = np.concatenate([2 * np.searchsorted(self.cuts, self.a_end), 2 * np.searchsorted(self.cuts, self.b_end) + 1])
        order = np.argsort(key, kind="stable")
        ids, step = np.concatenate([self.a, self.b])[order].tolist(), np.diff(key[order], append=-9)
        marks = np.where(step == 0, ",", np.where((step == 1) & (key[order] % 2 == 0), "|", ";")).tolist()
        text = [numbers[k] + m for k, m in zip(ids, marks, strict=True)]
        ends = np.cumsum(self.a_counts + self.b_counts).tolist()
        return ["".join(text[x:y])[:-1] for x, y in zip([0, *ends[:-1]], ends, strict=True)]


class PerfectHash:
    """A minimal perfect hash of distinct numbers in buckets, and the keys by their index."""

    def __init__(self, buckets: list[tuple[int, list[int], bytes, bytes]], n_buckets: int):
        """buckets: number, bits of each level, bit table (a byte for each bit), keys in the order of their bits."""
        self.n_buckets = n_buckets
        self.sizes, self.starts = np.ones((LEVELS, n_buckets), np.int64), np.zeros((LEVELS, n_buckets), np.int64)
        at, tables, keys = 0, [], []
        for number, sizes, table, own in sorted(buckets):
            self.sizes[: len(sizes), number] = sizes
            self.starts[: len(sizes), number] = at + np.cumsum([0, *sizes[:-1]])
            self.starts[len(sizes) :, number] = -1
            at += sum(sizes)
            tables.append(np.frombuffer(table, bool))
            keys.append(np.frombuffer(own, np.int64))
        self.bits = np.concatenate(tables) if tables else np.zeros(0, bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)

    @staticmethod
    def spread(keys: np.ndarray, level: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(1)).astype(np.int64)

    @classmethod
    def levels(cls, keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Bits of each level, the bit table and the keys in the order of their bits."""
        sizes, tables, order = [], [], []
        while len(keys):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, ROOM * len(keys))
            place = cls.spread(keys, len(sizes)) % size
            alone = np.bincount(place, minlength=size) == 1
            held = alone[place]
            order.append(keys[held][np.argsort(place[held])])
            sizes.append(size)
            tables.append(alone)
            keys = keys[~held]
        return sizes, np.concatenate(tables or [np.zeros(0, bool)]), np.concatenate(order or [np.zeros(0, np.int64)])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 if it is none of the keys."""
        out = np.full(len(keys), -1, np.int64)
        bucket, live = self.spread(keys, LEVELS) % self.n_buckets, np.arange(len(keys))
        for level in range(LEVELS):
            start = self.starts[level, bucket[live]]
            live, start = live[start >= 0], start[start >= 0]
            if not len(live) or not len(self.bits):
                break
            place = start + self.spread(keys[live], level) % self.sizes[level, bucket[live]]
            hit = self.bits[place]
            out[live[hit]] = self.rank[place[hit]] - 1
            live = live[~hit]
        out[out >= 0] = np.where(self.keys[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out


def hash_pairs(pairs: DataFrame, n: int) -> PerfectHash:
    """The hash of n distinct numbers in column pair, made in buckets by Spark's tasks. n is MAX_PAIRS at most."""
    n_buckets = max(1, n // BUCKET_PAIRS)

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series((PerfectHash.spread(keys.to_numpy(np.int64), LEVELS) % n_buckets).astype(np.int32))

    def build(table: pa.Table) -> pa.Table:
        sizes, bits, keys = PerfectHash.levels(table.column("pair").to_numpy())
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits.tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())})

    made = pairs.select(bucket("pair").alias("bucket"), "pair").groupBy("bucket").applyInArrow(build, "bucket int, sizes array<long>, bits binary, keys binary")
    return PerfectHash([(r["bucket"], list(r["sizes"]), bytes(r["bits"]), bytes(r["keys"])) for r in made.collect()], n_buckets)  # MAX_PAIRS keys at most


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def sum_vectors(vectors: DataFrame, n_tasks: int) -> DataFrame:
    """vectors (part, task, counts): the sum of each part, FAN_IN vectors at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"part": table.column("part").slice(0, 1), "task": table.column("task").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    while True:
        vectors = vectors.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long")).groupBy("part", "task").applyInArrow(add, "part int, task long, counts binary")
        n_tasks = -(-n_tasks // FAN_IN)
        if n_tasks <= 1:
            return vectors


def count_pairs(blocks: DataFrame, pairs: PerfectHash, low: int, high: int, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Links of each pair, by its index, over all blocks; pairs whose second id is low <= id < high."""
    shared = blocks.sparkSession.sparkContext.broadcast((pairs, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = shared.value
        counts = np.zeros(-(-len(held.keys) // SLICE) * SLICE, np.int64)
        for row in rows_of(batches):
            keys, times = Aligned(row, *sizes).counted()
            own = ((keys & 0xFFFFFFFF) >= low) & ((keys & 0xFFFFFFFF) < high)
            at = held.index(keys[own])
            if (at < 0).any():
                raise ValueError("a pair has no place in the hash")
            counts[at] += times[own]
        task = TaskContext.get().partitionId()
        for k in range(0, len(counts), SLICE):
            if counts[k : k + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([task], pa.int64()), pa.array([counts[k : k + SLICE].tobytes()], pa.binary())], names=["part", "task", "counts"])

    vectors = stored(blocks.mapInArrow(tidy(run), "part int, task long, counts binary"), "pair-counts")
    n_tasks = (vectors.agg(F.max("task").alias("t")).first()["t"] or 0) + 1
    out = np.zeros(len(pairs.keys), np.int64)
    for r in sum_vectors(vectors, n_tasks).collect():  # MAX_PAIRS counts at most
        part = out[r["part"] * SLICE : (r["part"] + 1) * SLICE]
        part += np.frombuffer(r["counts"], np.int64)[: len(part)]
    return out


def look_up(blocks: DataFrame, pairs: PerfectHash, counts: np.ndarray, low: int, high: int, sizes: tuple[np.ndarray, np.ndarray], whole: bool) -> DataFrame:
    """The blocks aligned again: for each document its links' counts and best links, of pairs whose second id is
    low <= id < high; with whole=True all that does not depend on counts too."""
    best = np.zeros(len(sizes[1]), np.int64)
    np.maximum.at(best, pairs.keys & 0xFFFFFFFF, counts)
    shared = blocks.sparkSession.sparkContext.broadcast((pairs, counts, best[pairs.keys & 0xFFFFFFFF] == counts, sizes))
    numbers = ("n_best", "count_sum") if not whole else ("n_best", "count_sum", "n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64())] + [(c, pa.int64()) for c in numbers] + [("groups", pa.string())] * whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, is_best, sizes = shared.value
        names = [str(k) for k in range(max(map(len, sizes)))]
        for row in rows_of(batches):
            x = Aligned(row, *sizes)
            keys, of = np.unique(x.pairs, return_inverse=True)
            at = np.where(((keys & 0xFFFFFFFF) >= low) & ((keys & 0xFFFFFFFF) < high), held.index(keys), -1)
            found = [np.where(at >= 0, table[at], 0)[of] if len(counts) else np.zeros(len(of), np.int64) for table in (is_best.astype(np.int64), counts)]
            chunks = [segment_sum(f, x.link_first) for f in found]
            if whole:
                chunks += [x.a_counts, x.b_counts, x.groups, np.diff(x.link_first)]
            columns = [np.where(x.good, segment_sum(c[x.places], x.first), 0) for c in chunks]
            texts = x.written(names) if whole else []
            at_doc, size, n = 0, 0, len(x.doc_ids)
            groups: list[str] = []
            for k in range(n):
                if whole:
                    groups.append(";".join([texts[i] for i in x.places[x.first[k] : x.first[k + 1]].tolist()]) if x.good[k] else "")
                    size += len(groups[-1])
                if size > 1 << 20 or k == n - 1:
                    part = slice(at_doc, k + 1)
                    arrays = [pa.array([row["block"]] * (k + 1 - at_doc), pa.int64()), pa.array(range(at_doc, k + 1), pa.int64()), pa.array(x.doc_ids[part], pa.int64()), *(pa.array(c[part]) for c in columns)]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(groups, pa.string())] * whole, schema=schema)
                    at_doc, size, groups = k + 1, 0, []

    ddl = "block long, row long, doc_id long, " + ", ".join(f"{c} long" for c in numbers) + ", groups string" * whole
    return blocks.mapInArrow(tidy(run), ddl)


def align(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its second id), count_sum
    and groups (`a1,a2|b1;a3|b2`, ids in order).

    first, second: paths of a byte-level vocabulary, which gets a space and the text, and of a model that puts a mark
    before the text, on every executor."""
    first, second = first or bytes_path(), second or model_path()
    blocks = stored(tokenize(docs, first, second, id_col, text_col, block_chars), "token-blocks")
    both = tokens_of(first, second)
    sizes = (both.a_sizes, both.b_sizes)
    held = docs.sparkSession.sparkContext.broadcast(sizes)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(Aligned(row, *held.value).counted()[0])], names=["pair"])

    pairs = stored(blocks.mapInArrow(tidy(distinct), "pair long").distinct(), "id-pairs")
    second_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    n = pairs.count()
    ranges = [(0, len(sizes[1]), n)]
    if n > max_pairs:
        # a count for each id of the second vocabulary; one id has no more pairs than the first vocabulary has ids
        ranges, low, held_pairs = [], 0, 0
        for r in pairs.groupBy(second_id.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect():
            if held_pairs and held_pairs + r["n"] > max_pairs:
                ranges.append((low, r["b"], held_pairs))
                low, held_pairs = r["b"], 0
            held_pairs += r["n"]
        ranges.append((low, len(sizes[1]), held_pairs))
    out: list[DataFrame] = []
    for low, high, held_n in ranges:
        own = hash_pairs(pairs.where((second_id >= low) & (second_id < high)), held_n)
        out.append(look_up(blocks, own, count_pairs(blocks, own, low, high, sizes), low, high, sizes, not out))
        if len(ranges) > 1:
            out[-1] = stored(out[-1], "aligned")
    whole = out[0]
    if len(out) > 1:
        parts = [x.select("block", "row", "n_best", "count_sum") for x in out]
        rest = parts[0]
        for x in parts[1:]:
            rest = rest.unionByName(x)
        whole = whole.drop("n_best", "count_sum").join(rest.groupBy("block", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), ["block", "row"])
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def op13_token_alignment(spark, sf_dir):
    from newsdesk.llm.tables import read

    out = align(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
