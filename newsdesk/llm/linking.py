"""Links between documents that share buckets, confirmed on their full sets, and the components they form.

Round one compares each document with the smallest one of fitting size that it shares a bucket with. Buckets whose
documents then lie in one component are done, which ends most groups of copies at once. What is still apart in a
mixed bucket is joined exactly on the items of the full sets: of two sets that reach the share, the first common
item, in any one order of all items, stands among the first n - least overlap + 1 of either. The least overlap follows
from both sizes, so a set has a prefix for each class of partner sizes and meets only sets of that class. Items are
ordered by the number of documents that hold them, so those that one document has for itself fill its prefix: they bring
nobody together, nor do items that lie in one component. The numbers are exact at any size, except for items that
are frequent in a sample, which come last and are sent to all tasks.

The exact join runs in steps that look at ever more of the partners, GROWTH times as many each time and all of them in
the end. A document that is linked to many leaves in an early step, so the pairs of a large group do not grow
with its square, and no link between documents that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.llm.arrays import mix, owners, tidy
from newsdesk.llm.tables import hash_share, stored
from newsdesk.operators.graph import components

#: Documents whose ids may be broadcast; documents that tell which items are frequent, and such items at most.
BROADCAST_IDS, SAMPLE_DOCS, FREQUENT_ITEMS = 500_000, 4_000, 400_000
#: Items that are put in order at once; what comes behind all numbers of documents that are counted.
ITEMS_AT_ONCE, BEHIND = 1_000_000, 1 << 40
#: Documents of the largest group that the first step of the exact join looks at, and the growth from step to step. A
#: step that would look at LAST or more of all partners looks at all.
FIRST_PARTNERS, GROWTH, LAST = 32, 32, 0.25


def _size_classes() -> np.ndarray:
    """First sizes of the classes: each is a tenth wider than the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 11 // 10))
    return np.array(out, np.int64)


SIZE_CLASSES = _size_classes()


def reaches(n_a: Column, n_b: Column, common: Column, percent: int) -> Column:
    """True if sets of these sizes with `common` items in common reach the share."""
    return (100 + percent) * common >= percent * (n_a + n_b)


def fits(n_a: Column, n_b: Column, percent: int) -> Column:
    """No smaller set can reach the share of a larger one."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which 100 * |intersection| >= percent * |union|; sets: (doc, n, items). A document with several
    sets is linked through each of them."""
    near = pairs.select("a", "b").join(sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b")), "b")
    near = near.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a")), "a")
    near = near.where(fits(F.col("n_a"), F.col("n_b"), percent))
    return near.withColumn("_common", F.size(F.array_intersect("items_a", "items_b"))).where(reaches(F.col("n_a"), F.col("n_b"), F.col("_common"), percent)).select("a", "b").distinct()


def only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is in ids(doc); few ids are broadcast, many are joined by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = ids.select(F.col("doc").alias(id_col))
    return docs.join(F.broadcast(named) if few else named, id_col, "left_semi")


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in ids(doc), a stored table; rows without an id stay."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = ids.select(F.col("doc").alias(id_col))
    return docs.join(F.broadcast(named) if few else named, id_col, "left_anti").select(*docs.columns)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc, ...) with the component of each document, itself if it has no link yet."""
    return rows.drop("component").join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc) of the buckets whose documents lie in several components."""
    rows = labelled(buckets.select("bucket", "doc"), labels)
    several = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return buckets.join(several, "bucket", "left_semi").select("doc").distinct()


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, ITEMS_AT_ONCE items and those of one row at a time at most."""
    place = batch.column("items").offsets.to_numpy()[:-1].astype(np.int64)
    group = (place - place[:1]) // ITEMS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in pairwise(cuts) if b > a)


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows and the first one of each row."""
    first = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]], first - first[0]


def sampled(values: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often the sample holds each value, 0 if it is not among the known ones, which are in order."""
    if not len(known) or not len(values):
        return np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[place] == values, times[place], 0)


def counted(values: np.ndarray, of: np.ndarray, held: np.ndarray, held_of: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The times of each value of a row among the held ones of that row, 0 if it is not there."""
    row, value = np.concatenate((of, held_of)), np.concatenate((values, held))
    is_held = np.arange(len(row)) >= len(of)
    order = np.lexsort((is_held, value, row))
    found = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]]) & is_held[order[1:]] & ~is_held[order[:-1]]
    out = np.zeros(len(of), np.int64)
    out[order[:-1][found]] = times[order[1:][found] - len(of)]
    return out


def with_holders(sets: DataFrame, frequent: Broadcast) -> DataFrame:
    """sets (doc, items) with held and times: those of its items that are not frequent and that other sets hold too, and how
    many do. Frequent ones are left out before the shuffle, so that no task counts an item of very many sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values, first = lists(part.column("items"))
                rare = sampled(values, *frequent.value) == 0
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(owners(first)[rare])), pa.array(values[rare])], names=["doc", "item"])

    rare = sets.select("doc", "items").mapInArrow(tidy(run), "doc long, item long")
    rare = rare.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("item"))).where("k > 1")
    held = rare.groupBy("doc").agg(F.collect_list(F.struct("item", "k")).alias("held"))
    none = F.array().cast("array<long>")
    return sets.select("doc", "items").join(held, "doc", "left").select("doc", "items", F.coalesce("held.item", none).alias("held"), F.coalesce("held.k", none).alias("times"))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, doc, n, rank) of the items of each set (doc, n, items), a stored table, by which a partner of each class of
    sizes must be met. A key stands for an item and the two classes; rank is the item's place in the set: the
    order is by the number of sets that hold an item, of sampled ones for those that are frequent, then by the item. Items of one
    set alone have a place but no row, since they meet nobody."""
    count = sets.count()
    sample = sets.where(hash_share(F.col("doc"), SAMPLE_DOCS / max(1, count)))
    held = sample.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("k")).where("k > 2")
    frequent = held.orderBy(F.desc("k"), "item").limit(FREQUENT_ITEMS).toArrow().sort_by("item")
    shared = sets.sparkSession.sparkContext.broadcast((frequent.column("item").to_numpy(), frequent.column("k").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b)):
            values, first = lists(batch.column("items"))
            of = owners(first)
            held, held_first = lists(batch.column("held"))
            k = sampled(values, *shared.value)
            k = np.where(k > 0, BEHIND + k, counted(values, of, held, owners(held_first), lists(batch.column("times"))[0]))
            order = np.lexsort((values, k, of))
            values, met = values[order], k[order] > 0
            rank = np.arange(len(values)) - first[:-1][of] + 1
            n = np.diff(first)
            own = np.searchsorted(SIZE_CLASSES, n, "right") - 1
            least, most = -(-percent * n // 100), 100 * n // percent
            steps = [np.searchsorted(SIZE_CLASSES, np.maximum(x, 1), "right") - 1 - own for x in (least, most)]
            for step in range(int(steps[0].min(initial=0)), int(steps[1].max(initial=0)) + 1):
                partner = own + step
                inside = (partner >= 0) & (partner < len(SIZE_CLASSES) - 1) & (n > 0)
                partner = np.where(inside, partner, 0)
                low, high = np.maximum(SIZE_CLASSES[partner], least), np.minimum(SIZE_CLASSES[partner + 1] - 1, most)
                length = np.where(inside & (low <= high), n - -(-percent * (n + low) // (100 + percent)) + 1, 0)
                if not (length > 0).any():
                    continue
                keep = met & (rank <= length[of])
                doc, x, y = of[keep], np.minimum(own, partner).astype(np.uint64), np.maximum(own, partner).astype(np.uint64)
                key = mix(values[keep].view(np.uint64) ^ mix(x[doc] << np.uint64(32) | y[doc]))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("doc").take(pa.array(doc)), pa.array(n[doc]), pa.array(rank[keep])], names=["key", "doc", "n", "rank"])

    return with_holders(sets, shared).mapInArrow(tidy(run), "key long, doc long, n long, rank long")


def apart(rows: DataFrame, percent: int, share: float) -> DataFrame:
    """Pairs (a, b) of different components that may reach the share, all that do if `share`, the part of the
    partners that are looked at, is 1; rows: (key, doc, component, n, rank, in_main), a stored table.

    Of a key's documents, those of its most frequent component are not paired with each other."""
    x = rows.where("not in_main").select("key", *(F.col(c).alias(f"x_{c}") for c in ("doc", "component", "n", "rank")))
    y = rows if share >= 1 else rows.where(hash_share(F.col("doc"), share))
    y = y.select("key", "in_main", *(F.col(c).alias(f"y_{c}") for c in ("doc", "component", "n", "rank")))
    size, left = F.col("x_n") + F.col("y_n"), F.least(F.col("x_n") - F.col("x_rank"), F.col("y_n") - F.col("y_rank"))
    # the first common item has this one's place at most, and all later ones of either may follow
    first = ((100 + percent) * (F.col("x_n") - F.col("x_rank") + 1) >= percent * size) & ((100 + percent) * (F.col("y_n") - F.col("y_rank") + 1) >= percent * size)
    reach = reaches(F.col("x_n"), F.col("y_n"), F.least("x_rank", "y_rank") + left, percent)
    other = (F.col("x_component") != F.col("y_component")) & (F.col("in_main") | (F.col("x_doc") < F.col("y_doc")))
    met = x.join(y, "key").where(other & fits(F.col("x_n"), F.col("y_n"), percent) & first & reach)
    return met.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, doc, n, rank) of keys whose documents lie in several components, with component and in_main."""
    named = labelled(rows, labels)
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    return named.join(main, "key").select("key", "doc", "component", "n", "rank", (F.col("component") == F.col("main")).alias("in_main"))


def link(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the documents with a confirmed link. buckets: (bucket, doc[, n]), sets: (doc, n, items), both
    stored tables; n in buckets keeps sets of unlike sizes from being compared."""
    sized = "n" in buckets.columns
    end = F.struct("doc", "n") if sized else F.struct("doc")
    least = buckets.groupBy("bucket").agg(F.min(end).alias("end"))
    first = buckets.join(least, "bucket").where(F.col("doc") != F.col("end.doc"))
    if sized:
        first = first.where(fits(F.col("n"), F.col("end.n"), percent))
    first = first.groupBy(F.col("doc").alias("b")).agg(F.min("end.doc").alias("a")).select("a", "b")
    labels = stored(components(confirmed(stored(first, "pairs"), sets, percent)), "labels")
    open_ = stored(mixed(buckets, labels).join(sets, "doc").select("doc", "n", "items"), "open")
    rows = stored(prefixes(open_, percent), "prefixes")
    share = 0.0
    while share < 1:
        rows = stored(open_rows(rows, labels), "open_rows")
        if rows.isEmpty():
            break
        share = GROWTH * share if share else FIRST_PARTNERS / rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0]
        share = 1.0 if share >= LAST else share
        found = confirmed(apart(rows, percent, share), sets, percent)
        joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
        labels = stored(components(joined), "labels")
        rows = rows.select("key", "doc", "n", "rank")
    return labels
