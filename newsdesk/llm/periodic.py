"""Runs of repeated word sequences in documents, found through string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least `repeats` periods and `least` words long, that
no neighbouring word extends. At each dyadic scale t, positions are selected by hashes of the t words behind them: a
position is kept if its hash is the smallest of a window of t / 4 positions at either end of it. The choice depends
only on the words around, so positions one period apart in a run are selected together, and neighbouring selected
positions whose contexts of 1.25 t or 1.75 t words are equal propose their distance as a period. Such a context is longer
than the periods it stands for (0.75 t to 1.75 t), so nothing nearer can be equal. Blocks of t words inside
a run of a period of t / 3 or less are left out, because their hashes repeat; the position behind such a region is
selected instead. Periods up to SMALL come from a separate search for highly periodic regions. Each proposal is extended
by comparing hashes of ranges, then compared word by word.

Documents are put behind one another with a different mark between them, so a task works on a slice of text at a time.

Cases: null and empty texts have no runs and an empty rest; repeated rows, and rows that share or lack a doc_id, are judged
each by its own text; of stretches with several periods only the smallest counts; a text of any length is one unit of
work; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import Rolling, mix, slices, tidy
from newsdesk.llm.tables import spare

LEAST, REPEATS = 24, 3
#: Periods up to SMALL are searched one by one; the scales 8, 16, ... see those of 6 and more.
SMALL, FIRST_SCALE = 8, 8
_SEED = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def periodic_stretches(words: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the longest stretches of at least `least` words in which words `period` apart are equal."""
    same = np.zeros(max(len(words) - period, 0) + 2, np.int8)
    same[1:-1] = words[period:] == words[: len(words) - period] if len(words) > period else 0
    edge = np.diff(same)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = ends - starts + period
    kept = length >= least
    return starts[kept], length[kept]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by windows that double."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def selected(block: np.ndarray, scale: int, left_out: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set of a scale. block: hashes of the `scale` words from each position;
    left_out: positions inside highly periodic regions."""
    width = scale // 4
    ids = np.where(left_out, _NONE, block)
    if len(ids) <= width:
        return np.empty(0, np.int64)
    low = window_minimum(ids, width + 1)
    chosen = np.zeros(len(ids), bool)
    n = len(low)
    chosen[:n] = (low != _NONE) & ((ids[:n] == low) | (ids[width:] == low))
    # a region's end is locally consistent too
    chosen[1:] |= left_out[:-1] & ~left_out[1:]
    return np.flatnonzero(chosen)


def common_length(rolling: Rolling, a: np.ndarray, b: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from a and from b (backwards: before them) are equal, `room` at most."""
    low, high = np.zeros_like(room), room.copy()
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live] + 1) // 2
        x, y = (a[live] - mid, b[live] - mid) if back else (a[live], b[live])
        equal = rolling.raw(x, x + mid) == rolling.raw(y, y + mid)
        low[live] = np.where(equal, mid, low[live])
        high[live] = np.where(equal, high[live], mid - 1)
    return low


def find_runs(words: np.ndarray, longest: int | None = None, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """All runs of a sequence of numbers as rows (start, length, period), by start and period. longest: no run is longer.

    repeats must be 3 or more: the scales see a run through three of its periods."""
    if repeats < 3:
        raise ValueError("runs of fewer than three periods are not seen at every scale")
    n = len(words)
    longest = min(n, longest or n)
    found: list[tuple[int, int, int]] = []
    # with their smallest period, whatever their length: later scales need the short ones too
    for p in range(1, min(SMALL, longest // repeats) + 1):
        s, m = periodic_stretches(words, p, 3 * p)
        found += zip(s.tolist(), m.tolist(), [p] * len(s), strict=True)
    values = mix(words.astype(np.uint64) * _SEED + np.uint64(1))
    rolling = Rolling(values)
    scale = FIRST_SCALE
    while 3 * scale <= 4 * (longest // repeats):
        block = rolling.windows(scale)
        if not len(block):
            break
        inside = np.zeros(len(block) + 1, np.int32)
        dense = [(s, m) for s, m, p in found if 3 * p <= scale and m >= scale]
        if dense:
            s, m = np.array(dense, np.int64).T
            np.add.at(inside, s, 1)
            np.add.at(inside, s + m - scale + 1, -1)
        places = selected(block, scale, np.cumsum(inside)[:-1] > 0)
        proposals = []
        for context in (5 * scale // 4, 7 * scale // 4):
            at = places[places + context <= n]
            key = rolling.hashes(at, at + context)
            order = np.lexsort((at, key))
            key, at = key[order], at[order]
            pair = np.flatnonzero((key[1:] == key[:-1]) & (np.diff(at) <= 2 * scale))
            proposals.append(np.stack([at[pair], at[pair + 1] - at[pair]]))
        at, period = np.unique(np.concatenate(proposals, axis=1), axis=1)
        right = common_length(rolling, at, at + period, n - at - period)
        left = common_length(rolling, at, at + period, at.copy(), back=True)
        length = left + right + period
        kept = length >= 3 * period
        for s, m, p in sorted(set(zip((at - left)[kept].tolist(), length[kept].tolist(), period[kept].tolist(), strict=True))):
            equal = words[s : s + m - p] == words[s + p : s + m]
            whole = equal.all() and (s == 0 or words[s - 1] != words[s - 1 + p]) and (s + m == n or words[s + m] != words[s + m - p])
            if whole:
                found.append((s, m, p))
            else:  # a hash said more than the words do: look at all of the stretch
                ps, pm = periodic_stretches(words[max(s - p, 0) : s + m + p], p, 3 * p)
                found += zip((ps + max(s - p, 0)).tolist(), pm.tolist(), [p] * len(ps), strict=True)
        scale *= 2
    smallest: dict[tuple[int, int], int] = {}
    for s, m, p in found:
        smallest[s, m] = min(p, smallest.get((s, m), p))
    rows = sorted((s, m, p) for (s, m), p in smallest.items() if m >= max(least, repeats * p))
    rows.sort(key=lambda r: (r[0], r[2]))
    return np.array(rows, np.int64).reshape(-1, 3)


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period in words, by start and period) and collapsed: the words that no
    run repeats, joined by spaces. A run repeats its words after its first period."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [(t or "").encode().split() for t in part.column(text_col).to_pylist()]  # ASCII white space
                numbers: dict[bytes, int] = {}
                begin, every = [0], []
                for k, words in enumerate(texts):
                    every += [numbers.setdefault(w, len(numbers)) for w in words]
                    every.append(-1 - k)  # no two documents share a mark
                    begin.append(len(every))
                rows = find_runs(np.array(every, np.int64), max(map(len, texts)), least, repeats)
                dropped = np.zeros(len(every) + 1, np.int64)
                np.add.at(dropped, rows[:, 0] + rows[:, 2], 1)
                np.add.at(dropped, rows[:, 0] + rows[:, 1], -1)
                gone = np.cumsum(dropped) > 0
                first = np.searchsorted(rows[:, 0], begin)
                runs, rest = [], []
                for k, words in enumerate(texts):
                    own = rows[first[k] : first[k + 1]]
                    runs.append([{"start": s - begin[k], "length": m, "period": p} for s, m, p in own.tolist()])
                    left = [w for w, x in zip(words, gone[begin[k] :].tolist(), strict=False) if not x] if len(own) else words
                    rest.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(runs, schema.field("runs").type), pa.array(rest, pa.string())], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods, the first of equals; null if there is none."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten ends with repeated words, by the crc32 h of its decimal id.

    With g = h div 10, word i >= a = g % n becomes word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8)."""
    docs = docs.select("doc_id", "text")
    words, hashed = spare(docs, "_words"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(hashed % 10 == 0, F.lit(False))
    rows = docs.withColumn(words, F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size(words), F.floor(hashed / 10).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    place = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
    changed = F.array_join(F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.coalesce(n > 0, F.lit(False)), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    from newsdesk.llm.tables import read

    found = periodic_runs(planted(read(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
