"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents of one length are interchangeable, so the packing is planned on the histogram of piece lengths -
at most `capacity` counts, however large the corpus - and every piece then finds its place from its rank among
the pieces of its length. The plan follows best-two-fit: a bin is filled greedily with the longest pieces
that fit, then its shortest piece gives way to the two unpacked pieces that fill the widened gap best.
A bin's pattern repeats as long as the counts allow, which gives the same bins as making them one by one.

Cases: null or empty text is a document with the end token only; repeated rows are packed as many times as
they occur, and so are rows that share or lack a doc_id; of equal lengths the smaller doc_id and piece comes first, and
equally good pairs of replacements are decided for the longer first piece; an empty table gives no rows; tokenize()
ignores other columns of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.arrays import LOWER_VALUES, SPACED_WORD, Rolling, Words, byte_class, slices, text_buffer, tidy
from newsdesk.llm.tables import spare, stored

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that one task ranks.
PART_ROWS = 1_000_000
#: Words longer than this are not kept in a worker's cache, and the cache starts anew when it would hold more.
CACHED_WORD_CHARS, CACHED_WORDS = 48, 1_500_000
#: Unknown words that are tokenised in one call.
LEARNT_TOGETHER = 200
CLOSING_MARK, ASCII_LETTER = byte_class([(c, c) for c in b".,;:!?"]), byte_class([(0x41, 0x5A), (0x61, 0x7A)])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Little-endian ids of words by the 64-bit hashes of their lower-case forms. The vocabulary lower-cases, drops white
    space, and no token crosses white space or the border of letters and punctuation, so a text's ids are those of its
    words in turn, and a closing mark is tokenised apart from an ASCII letter before it."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most

    def learn(self, keys: list[int], words: list[str]) -> list[bytes]:
        """The ids of words that are not known yet: they are tokenised together, which costs less than one by one."""
        out: list[bytes] = []
        for at in range(0, len(words), LEARNT_TOGETHER):
            part = words[at : at + LEARNT_TOGETHER]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begin = np.cumsum([0, *(len(w) + 1 for w in part)])
            cuts = (4 * np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), begin)).tolist()
            ids = np.array(found.ids, "<u4").tobytes()
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(self) + len(out) > self.most:
            self.clear()
        self.update((k, x) for k, w, x in zip(keys, words, out, strict=True) if len(w) <= CACHED_WORD_CHARS)
        return out

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the first one of each text, without end tokens."""
        data, offsets = text_buffer(column)
        words = Words(data, offsets, SPACED_WORD)
        s, e = words.starts, words.ends
        if not len(s):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        marked = CLOSING_MARK[data[e - 1]] & (e - s > 1) & ASCII_LETTER[data[np.maximum(e - 2, 0)]]
        parts = 1 + marked
        last = np.cumsum(parts) - 1
        starts, ends = np.repeat(s, parts), np.repeat(e, parts)
        ends[last[marked] - 1] -= 1
        starts[last[marked]] = e[marked] - 1
        first = np.concatenate(([0], last + 1))[words.first]
        hashes = Rolling(LOWER_VALUES[data]).hashes(starts, ends)
        order = np.argsort(hashes)
        new_key = np.ones(len(order), bool)
        new_key[1:] = hashes[order[1:]] != hashes[order[:-1]]
        at, of = order[new_key], np.empty(len(order), np.int64)
        of[order] = np.cumsum(new_key) - 1
        known = hashes[at].tolist()
        ids = list(map(self.get, known))
        new = [k for k, x in enumerate(ids) if x is None]
        if new:
            raw, lo, hi = data.tobytes(), starts[at[new]].tolist(), ends[at[new]].tolist()
            for k, x in zip(new, self.learn([known[k] for k in new], [raw[a:b].decode() for a, b in zip(lo, hi, strict=True)]), strict=True):
                ids[k] = x
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(sizes) - sizes
        counts = sizes[of]
        total = np.concatenate(([0], np.cumsum(counts)))
        place = np.repeat(begin[of] - total[:-1], counts) + np.arange(total[-1])
        return np.frombuffer(b"".join(ids), "<u4")[place], total[first]


@lru_cache(maxsize=2)
def word_ids(path: str, most: int = CACHED_WORDS) -> WordIds:
    """One cache for all tasks of a Python worker."""
    return WordIds(path, most)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of at most `capacity` ids of each document.

    vocabulary: path of a tokenizer file that every executor has. with_ids adds the ids as packed
    little-endian unsigned 32-bit numbers."""
    path = vocabulary or vocabulary_path()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path, cached_words)
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part in slices(batch, text_col):
                ids, first = words.texts(part.column(text_col))
                whole = ids.tobytes()
                rows: list[tuple] = []
                for doc, a, b in zip(part.column(id_col).to_pylist(), (4 * first[:-1]).tolist(), (4 * first[1:]).tolist(), strict=True):
                    text = whole[a:b] + end
                    for k, at in enumerate(range(0, len(text), step)):
                        piece = text[at : at + step]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), *[piece] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(tidy(run), ddl)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """counts[n]: pieces of length n. Returns runs (length, first rank, pieces a bin, first bin, offset):
    rank r of the run goes to bin `first bin + (r - first rank) // pieces a bin`."""
    left = counts.astype(np.int64).copy()
    taken = np.zeros_like(left)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while left.any():
        used: dict[int, int] = {}
        gap = capacity

        def pick(longest: int) -> int:
            """The longest length with an unused piece, `longest` at most; 0 if none."""
            while longest > 0:
                found = np.flatnonzero(left[1 : longest + 1])
                if not len(found):
                    return 0
                longest = int(found[-1]) + 1
                if left[longest] > used.get(longest, 0):
                    return longest
                longest -= 1
            return 0

        while n := pick(gap):
            k = min(int(left[n]) - used.get(n, 0), gap // n)
            used[n] = used.get(n, 0) + k
            gap -= k * n
        shortest = min(used)
        if gap and sum(used.values()) > 1:
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            lengths = np.flatnonzero(free)
            wide = gap + shortest
            lengths = lengths[lengths < wide]
            if len(lengths):
                partner = np.searchsorted(lengths, wide - lengths, "right") - 1
                same = (partner >= 0) & (lengths[partner] == lengths) & (free[lengths] < 2)
                partner = np.where(same, partner - 1, partner)
                total = np.where(partner >= 0, lengths + lengths[np.maximum(partner, 0)], 0)
                best = int(np.argmax(total))
                if total[best] > shortest:
                    used[shortest] -= 1
                    for n in (int(lengths[best]), int(lengths[partner[best]])):
                        used[n] = used.get(n, 0) + 1
        used = {n: k for n, k in used.items() if k}
        times = min(int(left[n]) // k for n, k in used.items())
        at = 0
        for n, k in sorted(used.items(), reverse=True):
            runs.append((n, int(taken[n]), k, bins, at))
            at += k * n
            taken[n] += k * times
            left[n] -= k * times
        bins += times
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset, which replace columns of those names; all others
    are kept.

    Ranks within a length are dealt over hash parts of about part_rows pieces, so a length that a third of the
    pieces share is sorted by many tasks. The driver sees a count for each length and each part."""
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    part, rank, parts = (spare(pieces, c) for c in ("_part", "_rank", "_parts"))
    total = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    dealt = spark.createDataFrame([(r["length"], -(-r["n"] // part_rows)) for r in total], f"length long, {parts} long")
    keyed = pieces.join(F.broadcast(dealt), "length").select(*pieces.columns, F.pmod(F.xxhash64("doc_id", "piece"), parts).alias(part))
    sizes = keyed.groupBy("length", part).agg(F.count(F.lit(1)).alias("n")).collect()  # capacity and a row for part_rows pieces at most
    counts = np.zeros(capacity + 1, np.int64)
    before: dict[tuple[int, int], int] = {}
    for n, k, rows in sorted((r["length"], r[part], r["n"]) for r in sizes):
        before[n, k] = int(counts[n])
        counts[n] += rows
    runs = sorted(best_two_fit(counts, capacity))
    length, first, fold, bins, at = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.empty(0, np.int64)] * 5
    plan = spark.sparkContext.broadcast((length << 44 | first, first, fold, bins, at, before))
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy("length", part).orderBy("doc_id", "piece")))
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, fold, bins, at, before = plan.value
        for batch in batches:
            n, k, r = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", part, rank))
            r = r - 1 + np.array([before[x] for x in zip(n.tolist(), k.tolist(), strict=True)], np.int64)
            j = np.searchsorted(key, n << 44 | r, "right") - 1
            inside = r - first[j]
            kept = [c for c in batch.schema.names if c not in (part, rank)]
            columns = [batch.column(c) for c in kept] + [pa.array(bins[j] + inside // fold[j]), pa.array(at[j] + inside % fold[j] * n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Tokenise and pack whole documents; only those longer than `capacity` are cut. A smaller cache takes less memory of
    each worker and more time."""
    return pack(stored(tokenize(docs, capacity, vocabulary, with_ids, cached_words=cached_words), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir):
    from newsdesk.llm.tables import read

    return pack_documents(read(spark, sf_dir, "documents"))
