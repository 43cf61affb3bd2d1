"""The exact join of linking meets sets by items that few sets hold, however many sets there are."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsdesk.llm import linking


def test_items_of_two_sets_come_behind_those_of_one(spark, monkeypatch):
    """Items of two sets each are not frequent in a sample; half of each set is held by it alone and fills its prefix."""
    monkeypatch.setattr(linking, "SAMPLE_DOCS", 4)
    sets = [(d, 100, [1000 * (d // 2) + i for i in range(50)] + [10**6 + 1000 * d + i for i in range(50)]) for d in range(200)]
    sets.append((200, 100, [1000 * 7 + i for i in range(46)] + [10**6 + 1000 * 14 + i for i in range(50)] + list(range(-4, 0))))
    frame = spark.createDataFrame(sets, "doc long, n long, items array<long>")
    keys = linking.prefixes(frame, 80).groupBy("key").agg(F.collect_set("doc").alias("docs"))
    met = {tuple(sorted(r.docs)) for r in keys.where(F.size("docs") > 1).collect()}
    assert met == {(14, 200)}
    buckets = spark.createDataFrame([(0, d, 100) for d, _, _ in sets], "bucket long, doc long, n long")
    assert {(r.node, r.component) for r in linking.link(buckets, frame, 80).collect() if r.node != r.component} == {(200, 14)}


def test_items_are_looked_up_by_row(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc": [9, 1, 2, 3], "items": [[8], [5, 7, 9], [], [7, 5]]}).slice(1)
    values, first = linking.lists(batch.column("items"))
    assert values.tolist() == [5, 7, 9, 7, 5] and first.tolist() == [0, 3, 3, 5]
    held, held_of, times = np.array([5, 9, 9, 7]), np.array([0, 0, 0, 2]), np.array([2, 3, 3, 4])
    assert linking.counted(values, np.array([0, 0, 0, 2, 2]), held, held_of, times).tolist() == [2, 0, 3, 4, 0]
    monkeypatch.setattr(linking, "ITEMS_AT_ONCE", 2)
    assert [p.column("doc").to_pylist() for p in linking.pieces(batch)] == [[1], [2, 3]]
    assert not list(linking.pieces(batch.slice(3)))
