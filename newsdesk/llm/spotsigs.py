"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Each occurrence of a common word is an anchor, and so is each word with no common word among the GAP words before it,
so that texts without common words have anchors too and an edit changes only what is near. An anchor with the next
two content words behind it (common words are passed over; at the end of a text there may be fewer) forms a signature.
Texts without words have the hash of the whole text, so every text that is not empty has a fingerprint. A
fingerprint is the size of the signature set and its SKETCH smallest hashes. Likeness is the Jaccard share of the
whole signature sets; it can't exceed smaller / larger, so sets of very unlike sizes need no merge below a threshold.

near_duplicates() compares whole signature sets: documents are parted by set length, meet through the
signatures of a prefix that a pair above the threshold must share, and links are confirmed on the full sets.

Cases: null texts are empty; empty texts have the fingerprint "0:" and likeness 1 to each other, 0 to others;
documents with the same id stand in the order of their texts, those without an id come last; a single document is its
own next one; repeated rows are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import PLAIN_WORD, Words, list_array, mix, owners, segment_unique, slices, text_buffer, tidy
from newsdesk.llm.linking import link
from newsdesk.llm.main_text import STOP_WORDS
from newsdesk.llm.tables import stored

CHAIN = 2
#: A word is an anchor of its own if no common word stands among so many before it.
GAP = 8
#: Hashes in a written fingerprint.
SKETCH = 256
#: Documents of a range of ids that one task orders, and ranges at most.
RANGE_DOCS, RANGES = 3_000, 8_192


def _anchor_hashes() -> np.ndarray:
    data, offsets = text_buffer(pa.array(sorted(STOP_WORDS)))
    return np.sort(Words(data, offsets, PLAIN_WORD).hashes(data))


ANCHORS = _anchor_hashes()


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct signature hashes of all texts and the first one of each text."""
    data, offsets = text_buffer(column)
    words = Words(data, offsets, PLAIN_WORD)
    h, of, n = words.hashes(data), owners(words.first), len(offsets) - 1
    common = ANCHORS[np.minimum(np.searchsorted(ANCHORS, h), len(ANCHORS) - 1)] == h
    place = np.arange(len(h))
    start = words.first[:-1][of]
    # the last common word before each word, in its own text
    last = np.maximum.accumulate(np.concatenate(([-1], np.where(common, place, -1))))[:-1]
    spots = np.flatnonzero(common | (last < np.maximum(start, place - GAP)))
    content = np.flatnonzero(~common)
    k = np.searchsorted(content, spots, "right")
    sig = h[spots]
    for c in range(CHAIN):
        at = k + c
        word = content[np.minimum(at, len(content) - 1)] if len(content) else np.zeros(len(at), np.int64)
        held = (at < len(content)) & (of[word] == of[spots]) if len(h) else np.zeros(0, bool)
        sig = mix(sig + np.uint64(c + 1)) ^ np.where(held, h[word], np.uint64(0)) if len(h) else sig
    values, rows = [mix(sig)], [of[spots]]
    counts, sizes = np.diff(words.first), np.diff(offsets)
    bare = np.flatnonzero((counts == 0) & (sizes > 0))
    raw = data.tobytes()
    values.append(np.array([int.from_bytes(hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=8).digest(), "little") for i in bare], np.uint64))
    rows.append(bare)
    every, row = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return segment_unique(every[order], np.searchsorted(row[order], np.arange(n + 1)))


def signature_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct signature hashes of each text."""
    values, first = signatures(column)
    return [values[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def written(items: np.ndarray) -> str:
    """The size of a signature set and its smallest hashes, as 32-bit numbers."""
    kept = np.unique((items[:SKETCH] >> np.uint64(32)).astype(np.uint32))
    return f"{len(items)}:{kept.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard share of two signature sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stretch, halo, doc_id, text) dealt by ranges of ids and sorted by descending id within each; every range
    ends with a copy, marked halo, of the document that follows its last one (at the very end, of the first)."""
    d = docs.select(F.coalesce(F.col(id_col), F.lit(-(1 << 63))).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = d.count()
    parts = max(1, min(RANGES, n // RANGE_DOCS))
    cuts = []
    if parts > 1:
        shares = ",".join(str(k / parts) for k in range(1, parts))
        cuts = d.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 10 * parts)})").alias("q")).first()["q"]
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), "right"), dtype="int32")

    held = d.select(stretch("doc_id").alias("stretch"), "doc_id").groupBy("stretch").agg(F.max("doc_id").alias("top")).orderBy("stretch").collect()  # RANGES rows at most
    if not held:
        return d.select(F.lit(0).alias("stretch"), F.lit(False).alias("halo"), "doc_id", "text")
    own = [r["stretch"] for r in held]
    #: the range whose last document is followed by the top of each range
    copies = {r["top"]: (own[(k + 1) % len(own)],) for k, r in enumerate(held)}

    @F.pandas_udf("array<struct<stretch:int,halo:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.to_numpy(np.int64), "right").tolist()
        return pd.Series([[{"stretch": p, "halo": False}] + [{"stretch": c, "halo": True} for c in copies.get(i, ())] for i, p in zip(ids.tolist(), at, strict=True)])

    dealt = d.withColumn("place", F.explode(places("doc_id"))).select("place.stretch", "place.halo", "doc_id", "text")
    return dealt.repartition(len(own), "stretch").sortWithinPartitions("stretch", "halo", F.desc("doc_id"), "text")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, both fingerprints and the two likenesses.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document
    in descending id."""
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def rows(part: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch | None:
        texts = part.column("text").to_pylist()
        prints = signature_sets(part.column("text"))
        if after is not None:
            texts.append(after.column("text")[0].as_py())
            prints += signature_sets(after.column("text").slice(0, 1))
        own = [i for i, halo in enumerate(part.column("halo").to_pylist()) if not halo]
        if not own:
            return None
        edited = []
        for i in own:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        new = signature_sets(pa.array(edited, pa.string()))
        ids = part.column("doc_id").to_pylist()
        columns = [
            [ids[i] if ids[i] != -(1 << 63) else None for i in own],
            [len(texts[i]) for i in own],
            [hashlib.sha256(x.encode()).hexdigest() for x in edited],
            [written(prints[i]) for i in own],
            [written(x) for x in new],
            [likeness(prints[i], x) for i, x in zip(own, new, strict=True)],
            [likeness(prints[i], prints[i + 1]) for i in own],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of a part may need the first of the next one; after a range's last document stands its halo
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                if last is not None and (out := rows(last, part)) is not None:
                    yield out
                last = part
        if last is not None and (out := rows(last, None)) is not None:
            yield out

    return in_order(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents whose signature sets reach the share `percent`, through any number of links."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                values, first = signatures(part.column(text_col))
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(np.diff(first)), list_array(values.view(np.int64), first, pa.int64())], names=["doc", "n", "items"])

    every = stored(docs.select(id_col, text_col).mapInArrow(tidy(sets), "doc long, n long, items array<long>").where("n > 0"), "signatures")
    same = every.groupBy("n", "items").agg(F.min("doc").alias("rep"))
    reps = stored(same.select(F.col("rep").alias("doc"), "n", "items"), "signature_classes")
    # sets of a pair lie in the same or in neighbouring classes of length
    width = math.log(100 / percent)
    length = F.floor(F.log(F.col("n")) / width).cast("int")
    prefix = F.slice("items", 1, F.col("n").cast("int") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    prefixes = reps.select("doc", "n", length.alias("at"), F.explode(prefix).alias("item"))
    buckets = prefixes.withColumn("length", F.explode(F.array("at", F.col("at") + 1))).select("doc", "n", F.xxhash64("item", "length").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    labels = link(stored(buckets.join(shared, "bucket"), "buckets"), reps, percent).select(F.col("node").alias("rep"), "component")
    named = same.join(labels, "rep", "left").select("n", "items", F.coalesce("component", "rep").alias("component_id"))
    linked = every.join(named, ["n", "items"]).select(F.col("doc").alias("doc_id"), "component_id")
    return linked


def op2_document_fingerprints(spark, sf_dir):
    from newsdesk.llm.tables import read

    return neighbour_fingerprints(read(spark, sf_dir, "documents"))
