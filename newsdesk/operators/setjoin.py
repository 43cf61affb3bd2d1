"""All pairs of sets that share a percentage of their union, without a pair of items ever being formed.

Two sets of n and m items that reach the share differ in a bounded number of items, which follows from n and m. Items are dealt to one
part more than that, the same for all sets, so in one part at least both sets hold the same: sets meet there. Sizes are
split into windows, since the bound grows with them; a pair belongs to the window of its smaller set. Frequent items, told by a
sample, are dealt so that each part tells sets apart about equally well; that decides how many meet by chance, not which pairs
are found. What meets is compared by 64 bits that two sets can't differ in more often than in items, and a pair is kept at the
first of its parts that are alike alone. Groups of more than BLOCK sets are worked on block against block, in as many tasks.

A set goes to about twice as many rows as it may differ in items, each as long as that: for titles and other short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets that tell which items and which keys are frequent; items that are dealt by their frequency.
SAMPLE_SETS, SAMPLE_KEYS, FREQUENT_ITEMS = 4_000, 20_000, 2_000
#: Sets of a key that one task compares; rows that are compared at once; sets that are cut into parts at once.
BLOCK, AT_ONCE, CUT = 8_192, 100_000, 2_000
#: Sets of a key up to which all keys are compared at once, place by place; cells of the table of larger ones.
FEW, SIDE = 48, 512
#: Bits of a key: window, part, hash of what a set holds in the part, the two blocks.
WINDOW_AT, PART_AT, HASH_AT, BLOCK_AT = 56, 42, 26, 13
ROWS = "key long, id long, sketch long, n int, side int, own binary"


def mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def most_apart(total, percent: int):
    """Items that only one of two sets holds, at most, if they share percent of their union; total: both sizes."""
    return total * (100 - percent) // (100 + percent)


def windows(largest: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(first size, end, largest partner, parts) of the windows of the smaller set's size."""
    out, first = [], 1
    while first <= largest:
        end = max(first + 1, first * 5 // 4)
        partner = 100 * (end - 1) // percent
        out.append((first, end, partner, most_apart(end - 1 + partner, percent) + 1))
        first = end
    return out


def dealt(share: np.ndarray, parts: int) -> np.ndarray:
    """The part of each frequent item, from the share of sets that hold it: what tells most comes first, to the part that tells least."""
    tells = -np.log(np.maximum(share**2 + (1 - share) ** 2, 1e-9))
    out, load = np.zeros(len(share), np.int64), np.zeros(parts)
    for k in np.argsort(-tells, kind="stable").tolist():
        out[k] = load.argmin()
        load[out[k]] += tells[k]
    return out


def part_rows(batches: Iterator[pa.RecordBatch], spans: list, known: np.ndarray, places: list[np.ndarray], hot: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """ROWS of sets (id, items): for each window and part of a set its key, with the hashes of all its parts. known: frequent items in
    order, places: their parts in each window; hot: keys of many sets in order, blocks: how many blocks they are in."""
    for batch in (b.slice(at, CUT) for b in batches for at in range(0, b.num_rows, CUT)):
        ids = batch.column("id").to_numpy()
        lists = batch.column("items")
        first = lists.offsets.to_numpy().astype(np.int64)
        items = lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]].view(np.uint64)
        n = np.diff(first)
        of = np.repeat(np.arange(len(n)), n)
        mixed = mix(items)
        sketch = np.zeros(len(n), np.uint64)
        np.bitwise_xor.at(sketch, of, np.uint64(1) << (mixed >> np.uint64(58)))
        at = np.minimum(np.searchsorted(known, items), max(len(known) - 1, 0))
        frequent = known[at] == items if len(known) else np.zeros(len(items), bool)
        for w, (least, _, most, parts) in enumerate(spans):
            inside = (n >= least) & (n <= most)
            if not inside.any():
                continue
            row, held = np.cumsum(inside) - 1, inside[of]
            part = np.where(frequent, places[w][at] if len(known) else 0, (mixed % np.uint64(parts)).astype(np.int64))[held]
            sums = np.zeros(int(inside.sum()) * parts, np.uint64)
            np.add.at(sums, row[of[held]] * parts + part, mix(mixed[held]))
            own = (mix(sums) >> np.uint64(48)).astype(np.uint16).reshape(-1, parts)
            key = (w << WINDOW_AT) | (np.arange(parts) << PART_AT) | (own.astype(np.int64) << HASH_AT)
            key, who = key.ravel(), np.repeat(np.flatnonzero(inside), parts)
            side = np.zeros(len(key), np.int32)
            place = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
            many = np.flatnonzero(hot[place] == key) if len(hot) else np.zeros(0, np.int64)
            source = np.arange(len(key))
            if len(many):
                # the block of a set meets each block, itself too
                count = blocks[place[many]]
                again = np.repeat(many, count)
                other = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                mine = (mix(ids[who[again]].view(np.uint64)) % np.repeat(count, count).astype(np.uint64)).astype(np.int64)
                split = key[again] | (np.minimum(mine, other) << BLOCK_AT) | np.maximum(mine, other)
                kept = np.ones(len(key), bool)
                kept[many] = False
                source = np.concatenate((source[kept], again))
                key, side = np.concatenate((key[kept], split)), np.concatenate((side[kept], (mine > other).astype(np.int32)))
                who = who[source]
            told = np.ascontiguousarray(own[source // parts])
            offsets = np.arange(len(told) + 1, dtype=np.int32) * (2 * parts)
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(told), [None, pa.py_buffer(offsets), pa.py_buffer(told)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[who]), pa.array(sketch[who].view(np.int64)), pa.array(n[who].astype(np.int32)), pa.array(side), binary], names=["key", "id", "sketch", "n", "side", "own"])


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their keys, AT_ONCE or more at a time, all rows of a key together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
        else:
            held = table.combine_chunks().to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def alike(sketch: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one group whose sketches differ in `most` bits at most; start and end: of each group."""
    few = end - start <= FEW
    ends = np.repeat(end[few], (end - start)[few])
    rows = np.concatenate([np.zeros(0, np.int64), np.repeat(start[few], (end - start)[few])]) + (np.arange(len(ends)) - np.repeat(np.cumsum((end - start)[few]) - (end - start)[few], (end - start)[few]))
    for step in range(1, FEW):
        live = rows + step < ends
        rows, ends = rows[live], ends[live]
        if not len(rows):
            break
        near = np.bitwise_count(sketch[rows] ^ sketch[rows + step]) <= most
        yield rows[near], rows[near] + step
    for a, b in zip(start[~few].tolist(), end[~few].tolist(), strict=True):
        for x in range(a, b, SIDE):
            for y in range(x, b, SIDE):
                i, j = np.nonzero(np.bitwise_count(sketch[x : min(x + SIDE, b), None] ^ sketch[None, y : min(y + SIDE, b)]) <= most)
                upper = i + x < j + y
                yield i[upper] + x, j[upper] + y


def meet(batches: Iterator[pa.RecordBatch], spans: list, percent: int) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id) that may reach the share, each pair once, of ROWS in order of their keys."""
    for table in whole_keys(batches):
        keys = table.column("key").to_numpy()
        cuts = np.flatnonzero(np.diff(keys >> WINDOW_AT)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            part = table.slice(a, b - a).combine_chunks()
            key, n, side, ids = (part.column(c).to_numpy() for c in ("key", "n", "side", "id"))
            first, end, partner, parts = spans[int(key[0] >> WINDOW_AT)]
            sketch, at = part.column("sketch").to_numpy().view(np.uint64), (key >> PART_AT) & ((1 << (WINDOW_AT - PART_AT)) - 1)
            blocks = key & ((1 << HASH_AT) - 1)
            split = (blocks >> BLOCK_AT) != (blocks & ((1 << BLOCK_AT) - 1))
            told = pa.concat_arrays(part.column("own").chunks)
            begin = int(np.frombuffer(told.buffers()[1], np.int32)[told.offset])
            own = np.frombuffer(told.buffers()[2], np.uint16, count=len(told) * parts, offset=begin).reshape(-1, parts)
            start = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(np.diff(key)) + 1))
            stop = np.concatenate((start[1:], np.array([len(key)], np.int64)))
            several = stop - start > 1
            order = np.arange(parts)
            for i, j in alike(sketch, start[several], stop[several], parts - 1):
                low, high = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
                near = (low < end) & (100 * low >= percent * high) & (np.bitwise_count(sketch[i] ^ sketch[j]) <= most_apart(low + high, percent))
                near &= (~split[i] | (side[i] != side[j])) & (ids[i] != ids[j])
                i, j = i[near], j[near]
                if len(i):
                    # a pair that was alike in a part before was met there
                    new = ~((own[i] == own[j]) & (order < at[i][:, None])).any(axis=1)
                    x, y = ids[i[new]], ids[j[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["left_id", "right_id"])


def near_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(left_id, right_id, common, total) of sets that share percent of their union, left_id the smaller one; sets: (id, n, items), a stored
    table of distinct ids with distinct longs each, n of them."""
    count, largest = sets.agg(F.count(F.lit(1)), F.max("n")).first()
    spans = windows(largest or 0, percent)

    def sample(at_least: int) -> tuple[DataFrame, float]:
        """Sets by the hash of their ids, and their share of all."""
        share = min(1.0, at_least / max(count, 1))
        return (sets if share == 1 else sets.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)), share

    some, _ = sample(SAMPLE_SETS)
    held = some.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("k")).where("k > 2")
    top = held.orderBy(F.desc("k"), "item").limit(FREQUENT_ITEMS).toArrow()
    known = top.column("item").to_numpy().view(np.uint64)
    order = np.argsort(known)
    shares = np.minimum(top.column("k").to_numpy()[order] / max(1, min(SAMPLE_SETS, count)), 1.0)
    known, places = known[order], [dealt(shares, parts) for _, _, _, parts in spans]
    none = np.zeros(0, np.int64)
    some, share = sample(SAMPLE_KEYS)
    keys = some.select("id", "items").mapInArrow(lambda b: part_rows(b, spans, known, places, none, none), ROWS).groupBy("key").agg(F.count(F.lit(1)).alias("k"))
    many = keys.where(F.col("k") > BLOCK * share).toArrow().sort_by("key")
    hot, blocks = many.column("key").to_numpy(), np.minimum(np.ceil(many.column("k").to_numpy() / share / BLOCK), (1 << BLOCK_AT) - 1).astype(np.int64)
    rows = sets.select("id", "items").mapInArrow(lambda b: part_rows(b, spans, known, places, hot, blocks), ROWS)
    pairs = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: meet(b, spans, percent), "left_id long, right_id long")
    sides = [sets.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.col("items").alias(f"{side}_items")) for side in ("left", "right")]
    # rows of one left set come one after another, so that its items are written small
    full = pairs.join(sides[0].hint("merge"), "left_id").join(sides[1].hint("shuffle_hash"), "right_id")
    full = full.select("left_id", "right_id", F.size(F.array_intersect("left_items", "right_items")).alias("common"), (F.col("left_n") + F.col("right_n")).alias("both"))
    return full.select("left_id", "right_id", "common", (F.col("both") - F.col("common")).alias("total")).where(100 * F.col("common") >= percent * F.col("total"))
