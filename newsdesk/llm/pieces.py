"""SentencePiece encoding and decoding through a table of distinct marked words.

In the vocabularies this is for, white space is a mark at the beginning of pieces, and no piece has a mark behind another
character. A normalised text is then a sequence of marked words (a run of marks and what follows up to the next one)
that are segmented independently of one another. Texts are gathered into blocks; a block keeps its texts as
positions in the list of its distinct marked words. The distinct words of all blocks are dealt by a hash into parts of
a table, in which each one is segmented once, and their ids come back to the blocks, where they are joined by position.
A frequent word is one entry of each block, so no part is hot. A block whose answers do not fit its words, as could be
after a loss if the input's rows came in another order, is an error.

Cases: null and empty texts have no ids and decode to an empty text; repeated rows, and rows that share or lack a doc_id,
are each encoded; white space of any length, and marks in the text itself, are encoded as the library does; a text of
any length stays in one block, so memory follows the longest one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import list_array, slices, tidy

MARK = "▁"
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of a block of texts, and parts that its words are dealt into at most.
BLOCK_CHARS, MOST_PARTS = 1 << 24, 1024
#: Words whose segments a task of the table keeps; it starts anew when it would hold more.
CACHED_WORDS = 200_000
#: Ids of a batch of the result.
OUT_IDS = 1 << 19


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(path: str):
    """The library's processor; one for all tasks of a worker."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in found.id_to_piece(i).lstrip(MARK) for i in range(found.get_piece_size())):
        raise ValueError("pieces of this vocabulary cross white space, so words are not segmented apart from one another")
    return found


def segments(sp, words: list[str]) -> list[list[int]]:
    """Ids of marked words. The library puts a mark before a text, so the first one of a word is left to it."""
    mark = [sp.piece_to_id(MARK)]
    return [mark if w == MARK else ids for w, ids in zip(words, sp.encode([w[1:] for w in words], num_threads=1), strict=True)]


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed; those below 65,536 as 16-bit ones."""
    narrow = not len(numbers) or int(numbers.max()) < 1 << 16
    return bytes([narrow]) + zstandard.ZstdCompressor().compress(numbers.astype("<u2" if narrow else "<u4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<u2" if data[0] else "<u4").astype(np.int64)


def pack_places(places: np.ndarray) -> bytes:
    """Positions in a list that is in the order of first occurrence: a first occurrence is 0, the others their position and
    one. They are kept by planes of their bytes, the low one first, which compress better."""
    first = np.zeros(len(places), bool)
    if len(places):
        first[1:] = places[1:] > np.maximum.accumulate(places)[:-1]
        first[0] = True
    codes = np.where(first, 0, places.astype(np.int64) + 1).astype("<u4")
    return zstandard.ZstdCompressor().compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    codes = np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)
    first = codes == 0
    codes -= 1
    codes[first] = np.arange(first.sum())
    return codes


class Block:
    """Texts as positions in the list of their distinct words."""

    def __init__(self) -> None:
        self.ids: list = []
        self.counts: list[int] = []
        self.index: dict[str, int] = {}
        self.places = array("I")
        self.size = 0

    def add(self, doc_id, stretches: Iterable[list[str]]) -> None:
        before, index = len(self.places), self.index
        for words in stretches:
            self.places.extend([index.setdefault(w, len(index)) for w in words])

        self.ids.append(doc_id)
        self.counts.append(len(self.places) - before)


def marked_words(text: str, window: int = 1 << 20) -> Iterator[list[str]]:
    """The marked words of a normalised text, a window at a time."""
    at = 0
    while at < len(text):
        end = text.find(MARK, at + window)
        while end > 0 and text[end - 1] == MARK:
            end = text.find(MARK, end + 1)
        end = end if end > 0 else len(text)
        yield MARKED_WORD.findall(text, at, end)
        at = end


def block_number(k: int) -> int:
    """A number for the k-th block of this task that no other task gives."""
    return TaskContext.get().partitionId() << 32 | k


ROWS = "block long, part int, doc_ids array<long>, counts array<long>, body binary, sizes binary"
ROW_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("body", pa.binary()), ("sizes", pa.binary())])


def row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, ROW_SCHEMA, strict=True)], schema=ROW_SCHEMA)


def cut(docs: DataFrame, path: str, parts: int, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """A row with part -1 for each block: its documents, the number of words of each, the positions of these words and the
    part of each distinct word. And a row for each part that has some of the words: the words and their lengths."""

    def rows(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        words = list(block.index)
        part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))
        yield row(number, -1, block.ids, block.counts, pack_places(np.frombuffer(block.places, np.uint32)), pack(part))
        order = np.argsort(part, kind="stable")
        bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = [words[i] for i in order[a:b].tolist()]
            text = zstandard.ZstdCompressor().compress("".join(own).encode())
            yield row(number, int(part[order[a]]), None, None, text, pack(np.fromiter(map(len, own), np.int64, len(own))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, block, made = processor(path), Block(), 0
        for batch in batches:
            for piece in slices(batch, text_col):
                texts = [t or "" for t in piece.column(text_col).to_pylist()]
                block.size += sum(map(len, texts))
                for doc, text in zip(piece.column(id_col).to_pylist(), sp.normalize(texts), strict=True):
                    block.add(doc, marked_words(text))
                if block.size >= block_chars:
                    yield from rows(block_number(made), block)
                    block, made = Block(), made + 1
        if block.ids:
            yield from rows(block_number(made), block)

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(tidy(run), ROWS)


def segment_table(rows: DataFrame, path: str) -> DataFrame:
    """The rows of cut(), those of a part in one task, with the words replaced by their ids and the number of ids of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known = processor(path), {}
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("part")[k].as_py() < 0:
                    yield batch.slice(k, 1)
                    continue
                text = zstandard.ZstdDecompressor().decompress(batch.column("body")[k].as_py()).decode()
                ends = np.cumsum(unpack(batch.column("sizes")[k].as_py())).tolist()
                words = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                if len(known) > CACHED_WORDS:
                    known.clear()
                new = [w for w in words if w not in known]
                known.update(zip(new, (np.array(x, "<u4").tobytes() for x in segments(sp, new)), strict=True) if new else ())
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield row(batch.column("block")[k].as_py(), batch.column("part")[k].as_py(), None, None, pack(np.frombuffer(b"".join(ids), "<u4")), pack(counts))

    return rows.mapInArrow(tidy(run), ROWS)


def join_back(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) from the rows of segment_table(), those of a block behind one another, part -1 first."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def joined(head: dict, found: list[dict]) -> Iterator[tuple]:
        sp, part = processor(path), unpack(head["sizes"])
        if [x["part"] for x in found] != np.unique(part).tolist():
            raise ValueError("words of a block have no ids")
        none = [np.empty(0, np.int64)]
        ids, sizes = (np.concatenate([unpack(x[c]) for x in found] or none) for c in ("body", "sizes"))
        # answers stand by part, the block's words in the order of first occurrence
        order = np.argsort(part, kind="stable")
        begin, size = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        begin[order], size[order] = np.cumsum(sizes) - sizes, sizes
        places, at = unpack_places(head["body"]), 0
        for doc, n in zip(head["doc_ids"], head["counts"], strict=True):
            own = places[at : at + n]
            at += n
            length = size[own]
            last = np.cumsum(length)
            total = int(last[-1]) if n else 0
            flat = ids[np.repeat(begin[own] - last + length, length) + np.arange(total)]
            yield doc, flat, sp.decode(flat.tolist()) if total else ""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head: dict | None = None
        found: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if one["part"] >= 0:
                    found.append(one)
                    continue
                if head:
                    yield from joined(head, found)
                head, found = one, []
        if head:
            yield from joined(head, found)

    def made(held: list[tuple]) -> pa.RecordBatch:
        doc_ids, ids, texts = zip(*held, strict=True)
        first = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), list_array(np.concatenate(ids), first, pa.int32()), pa.array(texts, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for document in documents(batches):
            held.append(document)
            size += len(document[1])
            if size > OUT_IDS:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, ids (array<int>, as the library's encode gives them) and decoded, the text of its decode(ids).

    model: path of a model file that every executor has."""
    path = model or model_path()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(docs, path, min(MOST_PARTS, tasks), id_col, text_col, block_chars)
    by_part = F.when(F.col("part") >= 0, F.col("part").cast("long")).otherwise(F.col("block"))
    answered = segment_table(rows.repartition(tasks, by_part), path)
    return join_back(answered.repartition(tasks, "block").sortWithinPartitions("block", "part"), path)


def op12_sentencepiece(spark, sf_dir):
    from newsdesk.llm.tables import read

    out = encode(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
