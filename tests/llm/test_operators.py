"""Training-data operators against brute force, on fixtures with nulls, ties, repeats, long and empty texts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import decontaminate, langid, linking, main_text, minhash, packing, pii, repeats, spotsigs, toxicity, warc

WORDS = "the of and river stone lamp paper green walk under light open seven chair table winter road music small north".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(5, 160)) for _ in range(60)]
    out = list(base)
    shared = sentence(rng, 40)
    for k in range(20):
        words = base[k].split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [base[0]] * 5 + [f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}" for _ in range(10)]
    out += [None, "", "   ", "one", "one two", "!!! ???", "é" * 150, ("ab" * 120), sentence(rng, 4000), shared]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def empty(docs):
    return docs.limit(0)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("width", [4, 5])
def test_minhash(docs, texts, width):
    sets = [shingle_set(t, width) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(texts), linked)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)
    assert minhash.near_duplicates(empty(docs), width).count() == 0


def test_minhash_large_group_and_outsider(spark):
    rng = random.Random(1)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(120)] = f"w{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    sets = [shingle_set(t, 5) for _, t in rows]
    want = components(300, [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(300)] == want


def test_links_to_any_member_of_a_large_bucket(spark):
    # members are linked to the base, and each outsider to one member only, never to the smallest
    size, base = 250, list(range(100))
    sets = [set(base)] + [set(base[9:]) | set(range(1000 * i, 1000 * i + 9)) for i in range(1, size)]
    sets += [set(sorted(sets[m])[9:]) | set(range(-1000 * m - 9, -1000 * m)) for m in (77, 140, 201)]
    want = components(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert want == [0] * len(sets)
    buckets = spark.createDataFrame([(b, i) for b in range(3) for i in range(len(sets))], "bucket long, doc long")
    rows = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in enumerate(sets)], "doc long, n long, items array<long>")
    got = {r.node: r.component for r in linking.link(buckets, rows, 80).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == want


def test_outsiders_of_a_group_of_thousands(spark):
    # 3,000 members are linked to the hub; each of 150 outsiders is linked to one member and to nobody else
    rng = random.Random(9)
    hub = [f"h{i}" for i in range(100)]
    texts = [hub]
    for m in range(3000):
        words = list(hub)
        at = rng.randrange(100 - 6)
        words[at : at + 6] = [f"m{m}x{k}" for k in range(6)]
        texts.append(words)
    chosen = rng.sample(range(1, 3001), 150)
    for k, m in enumerate(chosen):
        words = list(texts[m])
        free = next(i for i in range(0, 94) if all(w.startswith("h") for w in words[i : i + 6]) and abs(i - next(j for j, w in enumerate(words) if w.startswith("m"))) > 12)
        words[free : free + 6] = [f"o{k}x{j}" for j in range(6)]
        texts.append(words)
    ids = rng.sample(range(10**6), len(texts))
    sets = [shingle_set(" ".join(t), 4) for t in texts]
    links = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(links(0, m) for m in range(1, 3001))
    assert all(links(3001 + k, m) and not links(3001 + k, 0) for k, m in enumerate(chosen))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 4).collect()}
    assert {got[i] for i in ids} == {min(ids)}


def test_minhash_repeated_and_missing_ids(spark):
    rng = random.Random(3)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(7, a), (7, b), (9, b), (4, c), (None, c), (None, "alone here now"), (7, a), (11, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(7, 7, True), (7, 7, True), (7, 7, True), (9, 7, False), (4, 4, True), (None, 4, True), (None, None, True), (11, 11, True)], key=repr)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def test_drop_near_duplicates_keeps_columns(docs):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_spotsigs_neighbours(docs, texts, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_DOCS", 15)
    got = {r.doc_id: r for r in spotsigs.neighbour_fingerprints(docs).collect()}
    assert len(got) == len(texts)
    n = len(texts)
    for i in range(n):
        t, after = texts[i] or "", texts[i - 1 if i else n - 1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for i in range(n):
        same.setdefault(texts[i] or "", set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert spotsigs.neighbour_fingerprints(empty(docs)).count() == 0


def test_spotsigs_likeness_and_links(spark, docs, texts):
    prints = spotsigs.signature_sets(pa.array([t or "" for t in texts]))
    values, first = spotsigs.signatures(pa.array([t or "" for t in texts]))
    sets = [set(values[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    for i in range(0, len(sets), 3):
        for j in range(0, len(sets), 5):
            union = sets[i] | sets[j]
            assert spotsigs.likeness(prints[i], prints[j]) == pytest.approx(len(sets[i] & sets[j]) / len(union) if union else 1.0)
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(sets), linked)
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs).collect()}
    assert got == {i: want[i] for i in range(len(sets)) if sets[i]}


def plain_signatures(text):
    """SpotSigs by the definition: (anchor, next content words) of each anchor."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    common = [w in main_text.STOP_WORDS for w in words]
    out = set()
    for i, w in enumerate(words):
        if common[i] or not any(common[max(0, i - spotsigs.GAP) : i]):
            out.add((w, *[v for v, c in zip(words[i + 1 :], common[i + 1 :]) if not c][: spotsigs.CHAIN]))
    return out or ({text} if text else set())


def test_spotsigs_sets_by_definition(texts):
    every = [*texts, "one", "the", "The RIVER of stone", "a b c d e f g h i j k l", "of the and", "word " * 30, "", "!?"]
    got = spotsigs.signature_sets(pa.array([t or "" for t in every]))
    want = [plain_signatures(t) for t in every]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(0, len(every), 2):
        for j in range(0, len(every), 7):
            both, union = want[i] & want[j], want[i] | want[j]
            assert spotsigs.likeness(got[i], got[j]) == pytest.approx(len(both) / len(union) if union else 1.0)


def test_language_id_against_plain_naive_bayes(spark):
    rng = random.Random(8)
    own = {"en": "the of and river with".split(), "de": "der und nicht über schön".split(), "rare": "zzq qqz xqx".split()}
    rows = [(i, " ".join(rng.choice(own[k]) for _ in range(rng.randrange(1, 30))), k) for i, k in enumerate(rng.choices(["en", "de"], [8, 3], k=150) + ["rare"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = langid.fit(d)
    learnt = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5]
    assert langs == sorted({k for _, k in learnt})
    counts = {k: Counter() for k in langs}
    for t, k in learnt:
        points, places = langid.code_points(pa.array([t]))
        for bucket, inside in langid.grams(points, places):
            counts[k].update(bucket[inside].tolist())
    got = {r.doc_id: r for r in langid.predict(d, (langs, matrix)).collect()}
    for i, t, _ in rows[:40]:
        points, places = langid.code_points(pa.array([t]))
        logs = []
        for k in langs:
            total = sum(counts[k].values()) + 0.5 * (1 << langid.BITS)
            p = np.log(sum(x == k for _, x in learnt) / len(learnt))
            for bucket, inside in langid.grams(points, places):
                p += sum(np.log((counts[k][b] + 0.5) / total) for b in bucket[inside].tolist())
            logs.append(p)
        share = np.exp(np.array(logs) - max(logs))
        assert got[i].lang_pred == langs[int(np.argmax(logs))]
        assert got[i].score == pytest.approx(float(share.max() / share.sum()), abs=1e-3)
    assert langid.predict(d.limit(0), (langs, matrix)).count() == 0


def test_main_text_without_an_article_element():
    words = "the river of stone is in the light and the lamp was by the road with paper to be had from a table there"
    page = f"<body><div><a href=x><div>Home</div><p>News</p></a></div><div><p>{words} {words}</p><p>short line</p></div><div><a href=1>one</a> <a href=2>two</a></div><p>tail bit"
    # the short line follows the text beside it, the last one the links before it
    assert main_text.main_text(page) == f"{words} {words}\n\nshort line"
    # a link that is left open ends with its block
    assert main_text.main_text(f"<main><p><a href=x>go</p><p>{words}</p></main>").endswith(words)


def test_language_id(spark):
    rng = random.Random(2)
    own = {"en": "the of and river with".split(), "de": "der und nicht über schön".split(), "fr": "le être où ça déjà".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(own[lang]) for _ in range(20)), lang if i % 7 else None))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !! 34", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d.select("doc_id", "text"), langid.fit(d)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == ("en", "de", "fr")[i % 3] for i in range(240))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert langid.fit(d.limit(0)) == ([], pytest.approx(np.zeros((1, 0)))) or langid.fit(d.limit(0))[0] == []
    assert langid.predict(d.select("doc_id", "text"), ([], np.zeros((1, 0)))).where("lang_pred <> 'und'").count() == 0


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><div class="sidebar"><p>the side of the page and more of it</p></div>
    <article><h1>A &amp; B</h1><p><b>First   part<br>of the text</b><p>Second&nbsp;part.</p><!-- <p>hidden</p> --><form><p>Sign up</p></form></article>
    <section id="comments"><article><p>the comment of a reader and more</p></article></section><footer>&copy; x</footer></body></html>"""
    assert main_text.main_text(page) == "A & B\n\nFirst part of the text\n\nSecond part."
    assert main_text.main_text(None) == "" and main_text.main_text("") == ""
    long = "This is the text of a page and it has no article element, but it is long enough to be one of the blocks that are kept for the words in it, as they are common."
    assert main_text.main_text(f"<div><a href=x>the link of a menu</a></div><p>{long}</p><p>Short.</p><p>{long}</p><ul><li><a href=y>more of it</a></ul>") == f"{long}\n\nShort.\n\n{long}"
    assert main_text.main_text("<article><p>cut off <b") == "cut off"


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", 5), (2, None, None, None)], "page_id long, url string, html string, other int")
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    assert got[1].text == "x" and got[2].text == "" and got[1].other == 5


@pytest.mark.parametrize("hot", [5_000, 3])
def test_repeats(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert len(got) == len(texts)
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mark) if not m)
        spans = sum(1 for j in range(len(mark)) if mark[j] and (not j or not mark[j - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()), i
        assert bytes(got[i].kept) == kept
    assert repeats.remove_repeats(empty(docs)).count() == 0


def test_run_index_matches_by_hand():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    ends = np.cumsum([len(p) for p in parts])
    first = repeats.RunIndex(np.frombuffer(b"".join(parts), np.uint8), np.repeat(ends, [len(p) for p in parts])).earliest(6)
    seen = {}
    for p, end in zip(parts, ends):
        for k in range(len(p)):
            at = end - len(p) + k
            want = seen.setdefault(p[k : k + 6], at) if k + 6 <= len(p) else at
            assert first[at] == want


def test_toxicity(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = sentence(rng, 30).split()
        if bad:
            words[rng.randrange(30)] = rng.choice(["vile1", "vile2"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert got[1000] == got[1001] < 0.5
    assert toxicity.fit(d, labels.limit(0)) is None
    assert toxicity.drop_toxic(d, labels.limit(0)).count() == len(rows)


def test_packing(docs, texts):
    got = packing.pack_documents(docs, with_ids=True).collect()
    tokenizer = packing.WordIds(packing.vocabulary_path()).tokenizer
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in pieces) == ids
        for k, r in enumerate(pieces):
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
    for rows in by_bin.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(empty(docs)).count() == 0


def test_best_two_fit_repeats_patterns():
    rng = random.Random(6)
    counts = np.zeros(101, np.int64)
    for _ in range(500):
        counts[rng.randrange(1, 61)] += 1
    bins = Counter()
    for n, _, fold, first, at in packing.best_two_fit(counts, 100):
        assert at + fold * n <= 100
    runs = sorted(packing.best_two_fit(counts, 100))
    for k, (n, start, fold, first, at) in enumerate(runs):
        end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == n else counts[n]
        for r in range(end - start):
            bins[first + r // fold] += n
    total = sum(n * c for n, c in enumerate(counts))
    assert max(bins.values()) <= 100 and sum(bins.values()) == total and len(bins) <= 1.05 * total / 100


def test_pii_discovers_by_context(spark):
    rows = [(i, f"hello reach desk at +1 (555) 010-{1000 + i} thanks") for i in range(6)]
    rows += [(50, "hello reach desk at 555-014-2233 thanks"), (51, "version 555-014-9999 of it"), (52, None), (53, ""), (54, "a.b@c.d_e@f.gh 1.2.3.4.5.6.7.8 999.1.1.1 x 4111 1111 1111 1111")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.all_spans(d).collect()}
    assert [(x.start, x.end, x.kind) for x in got[50].extra] == [(20, 32, "phone")]
    assert not got[51].extra and not got[52].extra and all(len(got[i].phone) == 1 for i in range(6))
    assert [x.value for x in got[54].email] == ["a.b@c.d", "_e@f.gh"] and [x.value for x in got[54].ip] == ["1.2.3.4", "5.6.7.8"]
    assert [x.value for x in got[54].card] == ["4111 1111 1111 1111"]
    clean = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert clean[50] == "hello reach desk at <PHONE> thanks" and clean[51] == rows[7][1] and clean[52] is None and clean[53] == ""
    assert clean[54] == "<EMAIL><EMAIL> <IP>.<IP> 999.1.1.1 x <CARD>"
    plan = pii.all_spans(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontamination(spark, texts, docs, monkeypatch):
    items = [("a", " ".join((texts[0] or "").split()[:25])), ("b", "one two"), ("c", None), ("d", texts[8]), ("d2", texts[8]), ("e", "ONE")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for name, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    for block in (1 << 20, 60):
        got = {r.doc_id: r for r in decontaminate.benchmark_hits(docs, bench, block_bytes=block).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            w, hit, found = split(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            r = got[i]
            assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(found)), i
            assert set(p for a, b in zip(r.starts, r.ends) for p in range(a, b)) == hit
    clean = decontaminate.remove_spans(docs, bench)
    assert clean.columns == docs.columns
    assert decontaminate.benchmark_hits(clean, bench).where("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_repeated_ids(spark):
    x, y = sentence(random.Random(3), 30), sentence(random.Random(4), 30)
    bench = spark.createDataFrame([("q", x), ("q", y), ("r", x)], "item_id string, text string")
    rows = [(1, f"{x} {y}"), (1, f"before {y}"), (2, x), (2, x), (None, x), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, 61 - 30, 30, ["q"], [1], [31]), (1, 60, 60, ["q", "r"], [0], [60]), (2, 30, 30, ["q", "r"], [0], [30]), (2, 30, 30, ["q", "r"], [0], [30]), (3, 0, 0, [], [], []), (3, 0, 0, [], [], []), (None, 30, 30, ["q", "r"], [0], [30])]
    for block in (1 << 20, 60):
        got = decontaminate.benchmark_hits(docs, bench, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), list(r.starts), list(r.ends)) for r in got), key=repr) == sorted(want, key=repr)


def test_warc_round_trip(spark, tmp_path):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"
    rows = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (7, "u", tricky), (8, "v", tricky), (9, "w", "only"), (9, "w", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_captures(pages, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a")).cache()
    captures = warc.assemble(records).collect()
    assert len(captures) == 7 and all(c.request is not None and c.metadata is not None for c in captures)
    by_id = {int(c.metadata.fields.split()[1]): c for c in captures}
    html = {i: h or "" for i, _, h in rows}
    for i, c in by_id.items():
        body = html[i].encode()
        assert c.response.payload_bytes == len(body)
        assert c.response.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min(j for j in html if html[j] == html[i])
        assert c.response.kind == ("response" if first == i else "revisit")
        if first == i:
            assert c.response.payload == html[i]
        else:
            assert c.response.refers_to == by_id[first].capture_id
    warc.write_captures(pages.limit(0), str(tmp_path / "b"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "b"))).count() == 0
    warc.write_captures(pages, str(tmp_path / "c"), min_bytes=5)
    kinds = Counter(r.kind for r in warc.read_records(spark, str(tmp_path / "c")).collect())
    assert kinds["revisit"] == 2


def test_clashing_columns_are_kept(spark):
    rows = [(i, f"hello the river number {i} reach a{i}@b.cd", "en", "x", "y", 0.5, "z") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, starts string, _spans string, score double, _toxicity string")
    bench = spark.createDataFrame([("a", "the river number 3")], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    for out in (pii.redact(d), decontaminate.remove_spans(d, bench), minhash.drop_near_duplicates(d), toxicity.drop_toxic(d, labels, 2.0)):
        assert out.columns == d.columns and out.count() == 12
    assert set(langid.predict(d, langid.fit(d)).columns) == {*d.columns, "lang_pred"}
    assert {r.text for r in decontaminate.remove_spans(d, bench).where("doc_id = 3").collect()} == {"hello  reach a3@b.cd"}


def test_rows_that_share_or_lack_an_id(spark):
    rng = random.Random(11)
    long, passage = sentence(rng, 80), sentence(rng, 40)
    rows = [(1, f"{sentence(rng, 5)} {passage} end"), (2, long), (2, "tiny text a@b.cd"), (2, f"other {passage} b@c.de"), (None, f"none {passage}"), (None, "call x@y.zz or z@y.xx now"), (2, long), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs, with_text=False).collect())
    # without an id first, then by id; equal rows are one document
    want = Counter()
    done = set()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        again = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in done:
                again[k : k + 100] = b"\1" * 100
        want[i, len(raw), sum(again)] += 1
        if (i, t) != (2, long):
            done |= {raw[k : k + 100] for k in range(len(raw) - 99)}
    assert got == want
    clean = Counter((r.doc_id, r.text) for r in pii.redact(docs).collect())
    assert clean == Counter((i, re.sub(r"\w@\w\.\w\w", "<EMAIL>", t) if t else t) for i, t in rows)
    assert pii.all_spans(docs).count() == len(rows)
    bench = spark.createDataFrame([("p", passage), (None, "tiny text")], "item_id string, text string")
    for block in (1 << 20, 20):
        cut = Counter((r.doc_id, r.text) for r in decontaminate.remove_spans(docs, bench, max_coverage=0.99, block_bytes=block).collect())
        assert cut == Counter((i, t.replace(passage, "").replace("tiny text", "") if t else t) for i, t in rows)


def test_personal_data_in_runs_and_beside_long_words(spark):
    rows = [(i, f"write to desk +4{i} 555 010 {1000 + i} or") for i in range(5)]
    far = "w" * 100_000
    rows += [(20, f"{far} desk 555 014 22 33 and 24/7 {far}@"), (21, "1 " * 20_000), (22, "desk " + "9" * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.all_spans(d).collect()}
    at = len(far) + 6
    assert [(x.start, x.end, x.kind) for x in got[20].extra] == [(at, at + 13, "phone")]
    assert not got[21].extra and not got[22].extra


def test_ids_equal_those_of_whole_texts():
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "İ", "ß", "1", "٣", ".", ",", "!", "?", ";", ":", "'", "-", " ", "  ", "\n", "́", " ", "日", "本", "'s", "ǆ", "_", "@"]
    path = packing.vocabulary_path()
    words = packing.WordIds(path)
    texts = ["İ.", "aİ! b", "x. y", "don't.", "ΑΣ. ΣΑ", "\u0085", "a\u0085b", "A\u030a.", "w" * 200] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25))) for _ in range(6000)]
    ids, first = words.texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    # once more, with all words known
    assert words.texts(pa.array(texts))[0].tolist() == ids.tolist()


def test_best_two_fit_bin_by_bin():
    rng = random.Random(6)
    for capacity, n in ((20, 60), (64, 200), (13, 40)):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(n)] + [7] * 30
        counts = np.bincount(lengths, minlength=capacity + 1)
        left, want = Counter(lengths), []
        while left:
            bin_, gap = [], capacity
            while fit := max((x for x in left if x <= gap), default=0):
                bin_.append(fit)
                gap -= fit
                left -= Counter([fit])
            small = min(bin_)
            if gap and len(bin_) > 1:
                # the two unpacked ones that fill the widened gap best; of equal sums the pair with the smallest member
                pairs = [(x + y, -min(x, y), x, y) for x in left for y in left if x + y <= gap + small and (x != y or left[x] > 1)]
                if pairs and max(pairs)[0] > small:
                    _, _, x, y = max(pairs)
                    bin_.remove(small)
                    bin_ += [x, y]
                    left = left + Counter([small]) - Counter([x, y])
            want.append(tuple(sorted(bin_)))
        got = {}
        for length, first, fold, begin, _ in packing.best_two_fit(counts, capacity):
            total = sum(1 for r in packing.best_two_fit(counts, capacity) if r[0] == length and r[1] > first)
            after = sorted(r[1] for r in packing.best_two_fit(counts, capacity) if r[0] == length and r[1] > first)
            last = after[0] if total else int(counts[length])
            for r in range(first, last):
                got.setdefault(begin + (r - first) // fold, []).append(length)
        assert Counter(tuple(sorted(x)) for x in got.values()) == Counter(want)


def test_ftrl_against_a_plain_loop():
    rng = random.Random(12)
    texts = [sentence(rng, rng.randrange(3, 40)) + (" awful nasty words" if i % 4 == 0 else "") for i in range(80)]
    labels = np.array([float(i % 4 == 0) for i in range(80)])
    buckets, weights, bias = toxicity.train_shard([pa.array(texts)], labels)
    bucket, row, n = toxicity.features(pa.array(texts))
    sets = [sorted({int(b) for b, r in zip(bucket, row) if r == i}) for i in range(n)]
    seen = Counter(b for s in sets for b in s)
    sets = [[b for b in s if seen[b] >= toxicity.MIN_DOCS] for s in sets]
    z, q, b0, q0 = Counter(), Counter(), 0.0, 0.0
    weight = lambda b: 0.0 if abs(z[b]) <= toxicity.L1 else (np.sign(z[b]) * toxicity.L1 - z[b]) / ((toxicity.BETA + q[b] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    order = np.random.default_rng(7)
    for _ in range(toxicity.PASSES):
        for i in order.permutation(len(sets)):
            w = {b: weight(b) for b in sets[i]}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()) + b0, -35, 35))) - labels[i]
            g *= toxicity.TOXIC_WEIGHT if labels[i] else 1.0
            if abs(g) < 1e-4:
                continue
            for b in sets[i]:
                z[b] += g - ((q[b] + g * g) ** 0.5 - q[b] ** 0.5) / toxicity.ALPHA * w[b]
                q[b] += g * g
            q0 += g * g
            b0 -= g * toxicity.ALPHA / (toxicity.BETA + q0**0.5)
    want = {b: weight(b) for b in z if weight(b)}
    assert dict(zip(buckets.tolist(), weights.tolist())) == pytest.approx(want) and bias == pytest.approx(b0)


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= sum(c.isdigit() for c in x) <= 19 and luhn(x)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= sum(c.isdigit() for c in x) <= 15),
}


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(13)
    pieces = ["a@b.c", "x.y%z@q-r.st.u", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-1234", "+", "12", " ", ".", "-", "é", "5500000000000004", "+49 30 1234567 89", "word", "@b.c", "(", ")"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    for r in pii.base_spans(d).join(d, "doc_id").collect():
        for kind, (pattern, valid) in BASE.items():
            want = [(m.start(), m.end()) for m in re.finditer(pattern, r.text or "") if valid(m.group())]
            assert [(x.start, x.end) for x in r[kind]] == want, (kind, r.text)


def test_long_and_large_rows(spark):
    rng = random.Random(14)
    long = sentence(rng, 400_000)
    docs = spark.createDataFrame([(1, long), (2, long[: len(long) // 2]), (3, "short text here"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([("a", " ".join(long.split()[200_000:200_012]))], "item_id string, text string")
    assert len(long) > 3 * (1 << 19)
    assert minhash.near_duplicates(docs).count() == 4 and spotsigs.neighbour_fingerprints(docs).count() == 4
    hits = {r.doc_id: r.n_hit for r in decontaminate.benchmark_hits(docs, bench).collect()}
    assert hits[1] >= 12 and hits[3] == 0
    assert decontaminate.remove_spans(docs, bench).where("doc_id = 1").first().text.startswith(long[:1000])
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs, with_text=False).collect()}
    assert got[2] == len(long) // 2 and got[3] == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 4 and pii.redact(docs).count() == 4
    assert {r.length for r in packing.tokenize(docs).where("doc_id = 1").collect()} >= {2048}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {len(r.text) for r in main_text.extract(pages).collect()} >= {len(" ".join(long.split()))}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(none, labels) is None and toxicity.drop_toxic(docs, labels).count() == docs.count()
    assert langid.fit(none)[0] == [] and spotsigs.near_duplicates(none).count() == 0
    assert pii.all_spans(none).count() == 0 and pii.redact(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0 and packing.pack_documents(none).count() == 0
    assert minhash.drop_near_duplicates(none).count() == 0 and main_text.extract(none.withColumn("html", F.col("text"))).count() == 0


def test_columns_with_the_operators_own_names(spark):
    rows = [(i, f"the river number {i} and a{i}@b.cd", i) for i in range(8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").withColumns({c: F.lit("x") for c in ("offset", "_part", "_rank", "_parts", "doc", "twin", "key", "_hits", "_key", "label", "n", "items", "kept", "component_id", "hits")})
    assert repeats.remove_repeats(d).count() == 8 and spotsigs.neighbour_fingerprints(d).count() == 8
    assert minhash.drop_near_duplicates(d).columns == d.columns and pii.redact(d).columns == d.columns
    bench = spark.createDataFrame([("a", "the river number 3")], "item_id string, text string")
    assert decontaminate.remove_spans(d, bench).columns == d.columns and decontaminate.benchmark_hits(d, bench).count() == 8
    pieces = packing.tokenize(d).withColumns({c: F.lit("x") for c in ("_part", "_rank", "_parts", "offset")})
    packed = packing.pack(pieces)
    assert {"_part", "_rank", "_parts"} <= set(packed.columns) and packed.where("offset = 0").count() == 1
