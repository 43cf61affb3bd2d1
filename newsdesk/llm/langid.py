"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams by language are made from about `max_rows` labelled documents (chosen by a hash of
the id, whole texts; a language that has more than its equal share gives that share, a smaller one all its
rows), summed by Spark, and turned into a column of log-probabilities for each language. The matrix is broadcast, and each
batch is scored with gathers and segment sums. Priors are the shares of all labelled rows.

The matrix has a column for each of the `max_langs` most frequent languages (512 by default, 134 MB); a corpus with more
needs a larger bound.

Cases: null texts and texts without a letter are `und` with score 0; without any labelled row everything is
`und`; ties go to the language that sorts first; rows without lang or text are not learnt from; repeated rows count
as often as they occur and are each predicted, whatever their doc_id; an empty table gives no rows; other columns are
kept but for lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.arrays import slices, text_buffer, tidy
from newsdesk.llm.tables import held_out, spare

BITS = 16
MAX_ROWS = 12_000
#: Bound of the matrix: languages that a model has.
MAX_LANGS = 512


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points (A-Z and Latin-1 letters) of all texts and the offsets of each text."""
    data, offsets = text_buffer(column)
    first = (data & 0xC0) != 0x80
    places = np.concatenate(([0], np.cumsum(first)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).copy()
    upper = ((points >= 65) & (points <= 90)) | ((points >= 192) & (points <= 222) & (points != 215))
    points[upper] += 32
    return points, places


def grams(points: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the bucket of the n-gram that ends at each code point, and whether it lies in one text."""
    n = len(points)
    start = np.repeat(places[:-1], np.diff(places))
    at = np.arange(n)
    h = np.zeros(n, np.uint32)
    for k in range(3):
        h = h * np.uint32(0x01000193)
        if k:
            h[k:] += points[:-k] * np.uint32(0x85EBCA6B)
        else:
            h = points * np.uint32(0x85EBCA6B)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(k * 0x5BD1E995)
        mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x297A2D39)
        yield mixed >> np.uint32(32 - BITS), at - k >= start


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-probabilities [bucket, language], with the log-priors in a last row."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    frequent = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    rows = {r["lang"]: r["n"] for r in frequent}
    if not rows:
        return [], np.zeros((1, 0), np.float32)
    share = F.create_map(*(F.lit(x) for lang, n in rows.items() for x in (lang, max_rows / len(rows) / n)))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                points, places = code_points(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                own = np.repeat(np.arange(len(langs)), np.diff(places))
                for bucket, inside in grams(points, places):
                    for lang in set(langs):
                        counts = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                        counts[:-1] += np.bincount(bucket[inside & (langs == lang)[own]], minlength=1 << BITS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def column(table: pa.Table) -> pa.Table:
        counts = np.zeros((1 << BITS) + 1)
        counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        smooth = counts[:-1] + 0.5
        logs = np.log(smooth / smooth.sum()).astype(np.float32)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "logs": pa.array([logs.tobytes()], pa.binary())})

    # a row of 2 ** BITS numbers for each language
    made = dict(counted.groupBy("lang").applyInArrow(column, "lang string, logs binary").collect())
    langs = sorted(made)
    if not langs:
        return [], np.zeros((1, 0), np.float32)
    prior = np.log(np.array([rows[x] for x in langs]) / sum(rows[x] for x in langs)).astype(np.float32)
    return langs, np.vstack([np.stack([np.frombuffer(made[x], np.float32) for x in langs], 1), prior])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs (with a text column) and lang_pred, score, which replace columns of those names; others are kept."""
    langs, matrix = model
    docs = docs.drop("lang_pred", "score")
    letters_col = spare(docs, "_letters")
    out = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    if not langs:
        return out
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(matrix.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = shared.value
        names = np.array(langs, object)
        for batch in batches:
            for part in slices(batch, "text"):
                points, places = code_points(part.column("text"))
                total = np.tile(logs[:, -1].astype(np.float64)[:, None], part.num_rows)
                found = list(grams(points, places))
                some = np.flatnonzero(np.diff(places))
                for k, column in enumerate(logs):
                    each = sum(column[bucket] * inside for bucket, inside in found)
                    if len(some):
                        # each text is summed by itself, so its score does not depend on what is beside it
                        total[k, some] += np.add.reduceat(each.astype(np.float64), places[some])
                best = total.argmax(0)
                share = 1 / np.exp(total - total.max(0)).sum(0)
                letters = part.column(letters_col).to_numpy(zero_copy_only=False)
                kept = [c for c in part.schema.names if c != letters_col]
                columns = [part.column(c) for c in kept] + [pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, share, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return docs.withColumn(letters_col, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(tidy(run), out.schema)


def op3_language_id(spark, sf_dir):
    from newsdesk.llm.tables import read

    docs = read(spark, sf_dir, "documents")
    # neither lang nor source reaches the prediction; the text leaves before the result is made
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
