"""MinHash near-duplicates with tensored banding.

Two collections of SIDE sub-keys are made, each sub-key from ROWS minimum hashes. Table (i, j) is keyed by
sub-key i of the first and j of the second collection, so SIDE * SIDE tables of 2 * ROWS rows need only
2 * SIDE * ROWS minimum hashes. Sub-keys that nobody shares are dropped before the pairs are formed, so
most documents never enter a table. Texts with equal shingle sets are one class from the start, and every link
is confirmed on full sets. With the defaults a pair of similarity 0.8 meets in no table with probability
9e-5, in about 51 tables on average.

Cases: null and empty texts, and texts without words, have no shingles and no links; texts shorter than a
shingle are one shingle; an empty table gives no rows; other columns are ignored. Rows with the same doc_id are
one document: it is linked through each of its texts, and each row keeps its own n_shingles. A row without a doc_id
is linked to others but names nobody: its component is the smallest doc_id that it reaches, null if there is none,
and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import SPACED_WORD, Words, chains, list_array, mix, owners, segment_unique, slices, text_buffer, tidy
from newsdesk.llm.linking import link, only, without
from newsdesk.llm.tables import stored
from newsdesk.operators.graph import components

SIDE, ROWS = 14, 3
WIDTH, PERCENT = 5, 80


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts and the first one of each text."""
    data, offsets = text_buffer(column)
    words = Words(data, offsets, SPACED_WORD)
    h = words.hashes(data)
    counts = np.diff(words.first)
    every = chains(h, width)
    inside = owners(words.first)[: len(every)]
    inside_end = words.first[1:][inside] if len(every) else inside
    values, of = every[np.arange(len(every)) + width <= inside_end], inside[np.arange(len(every)) + width <= inside_end]
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = [int(chains(h[words.first[i] : words.first[i + 1]], int(counts[i]))[0] ^ np.uint64(counts[i])) for i in short]
    values = np.concatenate((values, np.array(whole, np.uint64)))
    of = np.concatenate((of, short))
    order = np.argsort(of, kind="stable")
    return segment_unique(values[order], np.searchsorted(of[order], np.arange(len(counts) + 1)))


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 4 * SIDE * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return seed[::2] | np.uint64(1), seed[1::2]


def sub_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[text, 2 * SIDE] keys; texts without shingles get zeros."""
    n = len(first) - 1
    out = np.zeros((n, 2 * SIDE), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        times, plus = _parameters()
        for k in range(2 * SIDE):
            key = np.full(len(some), np.uint64(k + 1))
            for r in range(k * ROWS, (k + 1) * ROWS):
                key = mix(key ^ np.minimum.reduceat(values * times[r] + plus[r], first[some]))
            out[some, k] = key
    return out


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, set_a, set_b, left, right): set size, 128 bits that equal sets share, and the two collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                values, first = shingles(part.column(text_col), width)
                keys = sub_keys(values, first).view(np.int64)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(c)), dtype=np.uint64))) for c in (1, 2)]
                sets = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                at = np.arange(part.num_rows + 1) * SIDE
                lists = [list_array(np.ascontiguousarray(x).ravel(), at, pa.int64()) for x in (keys[:, :SIDE], keys[:, SIDE:])]
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(np.diff(first)), *map(pa.array, sets), *lists], names=["doc", "n", "set_a", "set_b", "left", "right"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc long, n long, set_a long, set_b long, left array<long>, right array<long>")


def full_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, items) with the shingle hashes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                values, first = shingles(part.column(text_col), width)
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(np.diff(first)), list_array(values.view(np.int64), first, pa.int64())], names=["doc", "n", "items"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc long, n long, items array<long>")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents with 100 * |A and B| >= percent * |A or B| are linked."""
    sketch = stored(sketches(docs, width), "sketches")
    same = ["set_a", "set_b", "n"]
    classes = stored(sketch.where("n > 0").groupBy(*same).agg(F.min("doc").alias("rep")), "classes")
    reps = sketch.join(classes.select(F.col("rep").alias("doc"), *same), ["doc", *same], "left_semi").dropDuplicates(["doc", "set_a", "set_b"])
    # one side alone: sub-keys that a single class has go before any pair of sub-keys is formed
    lefts = reps.select("doc", "n", F.explode("left").alias("left"))
    shared = lefts.groupBy("left").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("left")
    rights = reps.select("doc", "n", "right")
    tables = lefts.join(shared, "left").join(rights, ["doc", "n"]).select("doc", "n", F.explode(F.transform("right", lambda r: F.xxhash64("left", r))).alias("bucket"))
    tables = stored(tables.distinct(), "tables")
    full = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    buckets = stored(tables.join(full, "bucket"), "buckets")
    sets = stored(full_sets(only(docs, stored(buckets.select("doc").distinct(), "members"), "doc_id"), width).where("n > 0").distinct(), "sets")
    labels = link(buckets, sets, percent)
    # a document with several texts holds their classes together
    several = sketch.where("n > 0 and doc is not null").groupBy("doc").agg(F.min(F.struct("set_a", "set_b")).alias("lo"), F.max(F.struct("set_a", "set_b")).alias("hi")).where("lo <> hi").select("doc")
    bound = stored(sketch.join(several, "doc", "left_semi").join(classes, same).select("rep", F.col("doc").alias("other")).where("rep <> other").distinct(), "bound")
    if not bound.isEmpty():
        labels = stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(bound.select(F.col("rep").alias("a"), F.col("other").alias("b")))), "labels")
    named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc", *same).join(named, same, "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are linked to a smaller doc_id, directly or through others."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("doc")).distinct()
    return without(docs, stored(gone, "gone"), "doc_id")


def op1_minhash_near_dedup(spark, sf_dir):
    from newsdesk.llm.tables import read

    return near_duplicates(read(spark, sf_dir, "documents"), width=4)


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (
  select a.doc_id as a, b.doc_id as b from s a join s b using (g) join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r as (select doc_id as d, doc_id as c from n union select r.d, e.b from r join e on e.a = r.c),
k as (select d, min(c) as c from r group by d)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(k.c, w.doc_id) as component_id, coalesce(k.c, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join k on k.d = w.doc_id
"""
