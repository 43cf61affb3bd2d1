"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Besides words, pairs and pairs one apart, the beginnings of words are features, so that inflected and
compound forms of a word share a weight. Only features of MIN_DOCS training documents or more are learnt.

Each coordinate has its own learning rate, and the L1 term keeps only weights that earn their place, so the
model is broadcast as a few thousand (bucket, weight) pairs. It is learnt on at most `max_rows` labelled
documents, chosen by a hash of the id; the sample is dealt into shards of bounded size that train side by side
and are averaged. Scoring reads whole texts, needs no shuffle and looks only at the words.

Cases: null and empty texts get the bias alone; rows without a label are not learnt from; a document that
is labelled twice counts once, with the larger label; without any labelled row every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import LOWER_VALUES, PLAIN_WORD, Rolling, Words, give_back, mix, owners, slices, text_buffer, tidy
from newsdesk.llm.tables import hash_share, held_out, spare

BITS = 20
#: Labelled rows learnt from at most, and the bytes of text of a training shard, whose features take about twice as much.
MAX_ROWS, SHARD_BYTES = 16_000, 14_000_000
ALPHA, BETA, L1, L2, PASSES, MIN_DOCS = 5.0, 1.0, 16.0, 0.0, 15, 3
#: Code points of the word beginnings; the weight of a toxic row in training.
STEMS, TOXIC_WEIGHT = (3, 4, 5, 6), 5.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of words, word beginnings, neighbouring words and words one apart, with the row of each; not distinct."""
    data, offsets = text_buffer(column)
    words = Words(data, offsets, PLAIN_WORD)
    rolling = Rolling(LOWER_VALUES[data])
    h, row = rolling.hashes(words.starts, words.ends), owners(words.first)
    buckets, rows = [h], [row]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = row[gap:] == row[:-gap]
        buckets.append(mix(h[:-gap] * np.uint64(3) + np.uint64(salt) ^ h[gap:])[same])
        rows.append(row[gap:][same])
    leads = (data & 0xC0) != 0x80
    places = np.append(np.flatnonzero(leads), len(data))
    first = np.concatenate(([0], np.cumsum(leads)))[words.starts]
    for k in STEMS:
        ends = places[np.minimum(first + k, len(places) - 1)]
        longer = ends < words.ends
        buckets.append(mix(rolling.hashes(words.starts[longer], ends[longer]) + np.uint64(k)))
        rows.append(row[longer])
    return (np.concatenate(buckets) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows), len(offsets) - 1


def train_shard(texts: Iterable[pa.Array], labels: np.ndarray | list[float], order_of: Callable[[], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero buckets, their weights and the bias after PASSES passes over the shard. Texts are dropped one after another as their
    features are taken; labels and order_of(), the order of the rows, are asked for behind the last of them."""
    docs: list[np.ndarray] = []
    for column in texts:
        bucket, row, n = features(column)
        order = np.argsort(row, kind="stable")
        bucket, ends = bucket[order], np.searchsorted(row[order], np.arange(n + 1))
        docs += [np.unique(bucket[a:b]).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    seen = np.zeros(1 << BITS, np.int32)
    for at in docs:
        seen[at] += 1
    for i, at in enumerate(docs):
        docs[i] = at[seen[at] >= MIN_DOCS]
    labels = np.array(labels, float)
    if order_of is not None:
        places = order_of()
        docs, labels = [docs[i] for i in places.tolist()], labels[places]
    give_back()
    z, n2 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(docs)):
            at = docs[i]
            zi, ni = z[at], n2[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[i]
            g *= TOXIC_WEIGHT if labels[i] else 1.0
            if abs(g) < 1e-4:
                continue
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n2[at] = ni + g * g
            bias_n += g * g
            bias -= g * ALPHA / (BETA + bias_n**0.5)
    kept = np.flatnonzero(np.abs(z) > L1)
    zk = z[kept]
    return kept, (np.sign(zk) * L1 - zk) / ((BETA + np.sqrt(n2[kept])) / ALPHA + L2), bias


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Buckets, weights and bias; None if no row is labelled. Rows held out are never learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return None
    sample = known.where(hash_share(F.col("doc_id"), max_rows / n))
    # about max_rows pairs of numbers, whatever the size of the labels
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(shards))).withColumn("h", F.xxhash64("text"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        labels: list[float] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids.append(part.column("doc_id").to_numpy())
                    hashes.append(part.column("h").to_numpy())
                    labels.extend(part.column("toxic").to_pylist())
                    yield part.column("text")

        kept, weights, bias = train_shard(texts(), labels, lambda: np.lexsort((np.concatenate(hashes), np.concatenate(ids))))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1), pa.int64()), pa.array(np.append(weights, bias), pa.float64())], names=["bucket", "weight"])

    model = rows.groupBy("shard").applyInArrow(train, "bucket long, weight double").groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).orderBy("bucket").collect()  # 2 ** BITS rows at most
    if not model:
        return None
    buckets, weights = np.array([r["bucket"] for r in model]), np.array([r["weight"] for r in model])
    return buckets[1:], weights[1:], float(weights[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, column: str = "score") -> DataFrame:
    """docs with the probability of being toxic in `column`, which replaces one of that name; other columns are kept."""
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, bias = shared.value
        table = np.zeros(1 << BITS)
        table[buckets] = weights
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row, n = features(part.column("text"))
                heavy = table[bucket] != 0
                pairs = np.unique(row[heavy] << BITS | bucket[heavy])
                total = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], n) + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*part.schema.names, column])

    return docs.mapInArrow(tidy(run), docs.withColumn(column, F.lit(0.0)).schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    column = spare(docs, "_toxicity")
    return score(docs, fit(docs, labels), column).where(F.col(column) < threshold).drop(column)


def op6_toxicity(spark, sf_dir):
    from newsdesk.llm.tables import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
