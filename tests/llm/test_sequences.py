"""Periodic runs, SentencePiece encoding and token alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsdesk.llm import alignment, periodic, pieces

ROW = "doc_id long, text string, runs string, block string, part int, _words string, groups string, ids string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = "the of and river stone lamp Paper walk, under light. open seven 42 3,5 straße größe вода мир naïve l'eau it's don't".split()
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    out += ["a b " * 40, "x " * 30 + "y " * 30, " ".join(["one two three four five six seven"] * 9), "q " * 23, "q " * 24, " ".join((["a", "a", "a", "b"] * 20 + ["c"]) * 4)]
    out += [None, "", " ", "  lead", "trail ", "trail  ", "▁mark ▁▁ a▁b", "x \n y\n\n z\t", "　wide space — dash  two", "nul\x00byte", "<s> </s> <unk> <|endoftext|> <0x0A>", "日本語 テスト です 日本語", "a" * 4000, "🙂 🙂🙂 x🙂", "\r\n crlf\r\nend"]
    return out + [out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7 if i % 13 else None, t, "r", "b", 3, "w", "g", "i") for i, t in enumerate(texts)]
    rows += [(7, "another text of a known id", "", "", 0, "", "", "")]
    return spark.createDataFrame(rows, ROW).repartition(3).cache()


def runs_by_loop(words, least=24, repeats=3):
    found, n = {}, len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def spaced(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_find_runs_equals_loop():
    rng = random.Random(5)
    for _ in range(600):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(0, 260)
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 60)
            base = [rng.randrange(k) for _ in range(p)]
            if rng.random() < 0.4:  # blocks of a small period inside a larger one
                base = (base[: max(1, p // 5)] * 6)[: p - 1] + base[-1:]
            for i in range(a, min(n, a + rng.randrange(1, 200))):
                w[i] = base[(i - a) % len(base)]
        for least in (24, 9):
            assert [tuple(r) for r in periodic.find_runs(np.array(w, np.int64), None, least).tolist()] == runs_by_loop(w, least)
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), repeats=2)


def test_periodic_runs(docs, texts):
    got = Counter((r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in periodic.periodic_runs(docs).collect())
    want = Counter()
    for r in docs.collect():
        words = spaced(r.text)
        runs = runs_by_loop(words)
        want[r.doc_id, tuple(runs), collapsed(words, runs)] += 1
    assert got == want and sum(bool(k[1]) for k in want) >= 5
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, docs, monkeypatch):
    monkeypatch.setattr("newsdesk.llm.tables.read", lambda *_: docs)
    got = Counter(tuple(r) for r in periodic.op11_periodic_runs(spark, "").collect())
    want, planted = Counter(), 0
    for r in docs.collect():
        words = spaced(r.text)
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = runs_by_loop(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        want[(r.doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs)))] += 1
    assert got == want and planted


def test_sentencepiece(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = Counter()
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id, tuple(ids), sp.decode(ids)] += 1
    for size in (pieces.BLOCK_CHARS, 50):  # one block and many
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode(docs, block_chars=size).collect()) == want
    assert pieces.encode(docs.limit(0)).count() == 0
    numbers = np.array([0, 1, 70_000, 5])
    assert pieces.unpack(pieces.pack(numbers)).tolist() == numbers.tolist() and pieces.unpack(pieces.pack(numbers[:2])).tolist() == [0, 1]
    places = np.array([0, 1, 0, 2, 2, 1, 3], np.uint32)
    assert pieces.unpack_places(pieces.pack_places(places)).tolist() == places.tolist()
    assert pieces.unpack_places(pieces.pack_places(places[:0])).tolist() == []
    long = "ab  cd " * 50
    assert sum(pieces.marked_words(sp.normalize(long), 20), []) == pieces.MARKED_WORD.findall(sp.normalize(long))


def test_missing_answers_are_an_error(spark, docs):
    rows = pieces.segment_table(pieces.cut(docs, pieces.model_path(), 4, "doc_id", "text", 1 << 20), pieces.model_path())
    with pytest.raises(Exception, match="have no ids"):
        pieces.join_back(rows.where("part <> 2").coalesce(1).sortWithinPartitions("block", "part"), pieces.model_path()).collect()


def aligned_by_loop(text, a, b, entries, letters):
    if not text:
        return None
    whole = f" {text}".encode()
    sides = []
    ids = a.encode(f" {text}", add_special_tokens=False).ids
    sides.append((ids, [bytes(letters[c] for c in entries[i]) for i in ids]))
    ids = b.encode(text)
    sides.append((ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))
    if any(b"".join(x) != whole for _, x in sides):
        return None
    spans = []
    for ids, raw in sides:
        at, own = 0, []
        for i, x in zip(ids, raw, strict=True):
            own.append((at, at + len(x), i))
            at += len(x)
        spans.append(own)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
    groups = ";".join("|".join(",".join(str(i) for _, e, i in side if low < e <= high) for side in spans) for low, high in zip([0, *cuts[:-1]], cuts, strict=True))
    return len(spans[0]), len(spans[1]), len(cuts), links, groups


def test_alignment(spark, docs):
    a = Tokenizer.from_file(alignment.bytes_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    entries = {k: e for e, k in a.get_vocab().items()}
    found = [(r.doc_id, aligned_by_loop(r.text, a, b, entries, alignment.byte_letters())) for r in docs.collect()]
    counts = Counter(x for _, f in found if f for x in f[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    want = Counter((i, *((0,) * 6), "") if f is None else (i, *f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for i, f in found)
    assert sum(f is None for _, f in found) >= 3
    for kind in ({}, {"max_pairs": 150, "block_chars": 300}):  # one range of pairs and several, one block and many
        assert Counter(tuple(r) for r in alignment.align(docs, **kind).collect()) == want
    assert alignment.align(docs.limit(0)).count() == 0


def test_plain_chunks_are_encoded_alike(texts):
    quick, slow = (alignment.Tokens(alignment.bytes_path(), pieces.model_path()) for _ in range(2))
    assert quick.plain
    slow.plain = None
    chunks = list(dict.fromkeys(c for t in texts for part in alignment.chunks_of(t or "", 200) for c in part))
    assert sum(bool(alignment.PLAIN.fullmatch(c)) for c in chunks) > 40
    assert quick.of(chunks) == slow.of(chunks)


def test_perfect_hash(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 30_000))
    made = alignment.hash_pairs(spark.createDataFrame([(int(k),) for k in keys], "pair long"), len(keys) * 4)
    at = made.index(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (made.keys[at] == keys).all()
    assert (made.index(keys + (1 << 50)) == -1).all()
    none = alignment.PerfectHash([], 1)
    assert none.index(keys[:3]).tolist() == [-1, -1, -1]


def test_vectors_are_summed_by_a_tree(spark):
    rows = [(p, t, np.full(alignment.SLICE, t + p, np.int64).tobytes()) for p in range(2) for t in range(40)]
    out = alignment.sum_vectors(spark.createDataFrame(rows, "part int, task long, counts binary"), 40).collect()
    assert {r.part: int(np.frombuffer(r.counts, np.int64)[5]) for r in out} == {0: 780, 1: 820} and len(out) == 2


def test_best_run_is_the_most_periodic(spark):
    d = spark.createDataFrame([([(5, 30, 3), (0, 60, 6), (9, 21, 2)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    got = d.select(periodic.strongest(F.col("runs")).alias("b")).collect()
    assert tuple(got[0].b) == (9, 21, 2) and got[1].b is None
