from __future__ import annotations

import random
import time
from collections import Counter
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, prose
from pyspark.sql import functions as F

from quillgraph.llm import decontamination as dec
from quillgraph.llm import license_scan as lic
from quillgraph.llm import pii, quality, topk_search, url_filter


# decontamination


def edits_inside(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, text, n):
    y = list(text)
    for _ in range(n):
        p = rng.randrange(len(y))
        rng.choice([lambda: y.__setitem__(p, rng.choice("xyz")), lambda: y.pop(p), lambda: y.insert(p, rng.choice("xyz"))])()
    return "".join(y)


def test_contamination_matches_full_alignment(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(12, 30))) for i in range(12)] + [(20, "tiny one"), (21, None), (22, ""), (None, prose(rng, 20))]
    loaded = dec.Items([(-1 if i is None else i, t) for i, t in items if t], dec.Q, dec.EDIT_RATE)
    budget = dict(zip(loaded.ids, loaded.budget.tolist(), strict=True))
    rows = []
    for n in range(60):
        i, t = items[n % 12]
        rows.append((n, f"{prose(rng, 40)} {edited(rng, t, rng.randint(0, 2 * budget[i])).upper()}\n{prose(rng, 30)}"))
    rows += [(100, None), (101, ""), (102, "a TINY\tone b"), (103, items[0][1]), (103, items[0][1]), (None, items[1][1]), (104, prose(rng, 20_000) + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dec.contaminated(docs(spark, rows), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    for n, text in rows[:60]:
        for i, t in items[:12]:
            e = edits_inside(t, text.lower().replace("\n", " "))
            assert ((n, i) in found) == (e <= budget[i]), (n, i, e, budget[i])
    assert {(102, 20), (103, 0), (None, 1), (104, 2)} <= found
    assert sum(r.doc_id == 103 for r in got) == 2
    for r in got:
        if r.edits == 0:
            text = dict(rows)[r.doc_id].lower().replace("\n", " ").replace("\t", " ")
            assert text[r.start : r.end] == dict(items)[r.item_id]
    left = dec.drop_contaminated(docs(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in found}


def test_edited_items_at_the_ends_of_a_text():
    rng = random.Random(8)
    for n in range(6):
        item = prose(rng, rng.randint(14, 30)) + "."
        loaded = dec.Items([(1, item)], dec.Q, dec.EDIT_RATE)
        e = int(loaded.budget[0])
        k = rng.randint(1, e)
        for part in (item[:-k], item[k:], item[: len(item) // 2] + item[len(item) // 2 + k :], edited(rng, item, e)):
            for text in (part, part + " " + prose(rng, 40), prose(rng, 40) + " " + part):
                starts = np.array([0, 4, 5 + len(text)])
                got = list(dec.regions(dec.folded("abc\x00" + text + "\x00"), starts, loaded))
                least = edits_inside(item, text)
                assert least <= e and [g[:3] for g in got] == [(1, 0, least)], (item, text)
                assert 0 <= got[0][3] < got[0][4] <= len(text) and edits_inside(text[got[0][3] : got[0][4]], item) <= e


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dec.contaminated(docs(spark, [(1, "x")]), bench).count() == 0
    assert dec.contaminated(docs(spark, []), spark.createDataFrame([(1, "x" * 100)], "item_id long, text string")).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 20)) for i in range(8)]
    bench, rows = spark.createDataFrame(items, "item_id long, text string"), docs(spark, [(i, t + " and more") for i, t in items])
    whole = sorted(map(tuple, dec.contaminated(rows, bench).collect()))
    monkeypatch.setattr(dec, "BLOCK_CHARS", 300)
    assert sorted(map(tuple, dec.contaminated(rows, bench).collect())) == whole and len(whole) == 8


# licences


def test_repetitive_texts_take_time_in_proportion():
    rng = random.Random(6)
    began = time.monotonic()
    items = dec.Items([(1, "-" * 400), (2, "| --- " * 60)], dec.Q, dec.EDIT_RATE)
    for text in ("-" * 1_000_000, "| --- " * 60_000):
        found = list(dec.regions(dec.folded(text + "\0"), np.array([0, len(text) + 1]), items))
        assert {r[1] for r in found if r[2] == 0} and all(r[0] == 0 for r in found)
    prefix = "Read the following passage with care and answer the question in one word: "
    rows = [(i, prefix + prose(rng, 25)) for i in range(5000)]
    items = dec.Items(rows, dec.Q, dec.EDIT_RATE)
    text = prose(rng, 2000) + prefix + prose(rng, 2000) + rows[7][1] + prefix + prose(rng, 10)
    assert [r[1:3] for r in dec.regions(dec.folded(text + "\0"), np.array([0, len(text) + 1]), items)] == [(7, 0)]
    assert time.monotonic() - began < 90


def test_blank_repeated_and_null_items(spark):
    bench = spark.createDataFrame([(1, "\n"), (2, "\t \u00a0"), (3, " the long river runs past the old stone bridge\n"), (3, " the long river runs past the old stone bridge\n"), (None, "seven green lamps hang in the quiet market hall"), (4, None)], "item_id int, text string")
    rows = [(1, "we know the long river runs past the old stone bridge today"), (2, "a b c\n"), (None, "Seven green lamps hang in the quiet market hall."), (1, "nothing")]
    got = dec.contaminated(docs(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.edits, r.start) for r in got) == [("1", "3", 0, 8), ("None", "None", 0, 0)]


def test_licences(spark):
    mit = next(t for n, t in lic.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, mit.lower().replace("software", "Software")), (3, "nothing to see"), (4, None), (5, ""), (6, "licence"), (None, "Licensed under CC BY-NC 4.0."), (1, "Released under the MIT License."), (7, prose(random.Random(1), 30_000) + "\n" + mit)]
    got = sorted((str(r.doc_id), r.license, r.first_line, r.last_line) for r in lic.licenses(docs(spark, rows)).collect() if r.dice > 0.99)
    assert ("1", "MIT", 1, 1) in got and ("1", "MIT", 0, 0) in got and ("None", "CC-BY-NC-4.0", 0, 0) in got
    assert [g[:2] for g in got if g[0] in "27"] == [("2", "MIT"), ("7", "MIT")]
    assert not {g[0] for g in got} & {"3", "4", "5", "6"}
    assert lic.licenses(docs(spark, [])).count() == 0


def licence_scan(text, templates):
    grams, _ = lic.bigrams(np.frombuffer(text.encode() + b"\n", np.uint8))
    return lic.scan_text(*templates.hits(grams), templates)


def brute_licences(text, rows, threshold):
    """The best of all runs of words and all templates, then the best of those that don't overlap it."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    pairs = lambda w: Counter(zip(w, w[1:], strict=False))
    w, every = split(text), []
    known = [(n, pairs(split(t))) for n, t in rows]
    for i in range(len(w)):
        for j in range(i + 2, len(w) + 1):
            region = pairs(w[i:j])
            for n, b in known:
                d = 2 * (region & b).total() / (region.total() + b.total())
                if d >= threshold:
                    every.append((-d, i - j, i, n, j - 1))
    out, taken = [], set()
    for d, _, i, n, z in sorted(every):
        if taken.isdisjoint(range(i, z + 1)):
            taken.update(range(i, z + 1))
            out.append((n, i, z, round(-d, 6)))
    return sorted(out, key=lambda x: x[1])


def test_licences_match_all_runs_of_words():
    rng = random.Random(3)
    rows = (("A", "you may copy this work for free if you keep this notice"), ("B", "you may not copy this work"), ("C", "may copy this work for free if you may copy this work"), ("D", "free work"), ("A", "keep this notice"))
    templates = lic.Templates(rows, 0.8)
    vocabulary = sorted({w for _, t in rows for w in t.split()}) + ["other", "words"]
    for _ in range(60):
        text = " ".join(rng.choice(rows)[1] if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(rng.randrange(1, 14)))
        assert licence_scan(text, templates) == brute_licences(text, rows, 0.8), text
    shuffled = lic.Templates(rows[::-1], 0.8)
    assert licence_scan(rows[0][1], shuffled) == licence_scan(rows[0][1], templates)


def test_licences_wherever_they_stand():
    templates = lic.Templates(lic.TEMPLATES, lic.THRESHOLD)
    whole = [(n, t) for n, t in lic.TEMPLATES if len(t) > 500]
    mit = next(t for n, t in whole if n == "MIT")
    for n, t in whole:
        for text in (f"{mit}\n\n{t}", f"{t}\n\n{mit}", mit + " " + t, t + "\n" + t):
            assert [x[0] for x in licence_scan(text, templates)] in ([n, "MIT"], ["MIT", n], [n, n]), (n, text[:40])
    lines = mit.split("\n")
    assert [x[0] for x in licence_scan("\n".join([*lines[:3], "A line of quite other words in between.", *lines[3:]]), templates)] == ["MIT"]
    assert [x[0] for x in licence_scan("Our scripts. Licensed under the MIT License. See also the other folders.", templates)] == ["MIT"]
    assert [x[0] for x in licence_scan("some prose before " + mit.replace("\n", " ") + " and some after", templates)] == ["MIT"]


def test_repeated_licences_take_time_in_proportion():
    mit = next(t for n, t in lic.TEMPLATES if n == "MIT" and len(t) > 500)
    began = time.monotonic()
    assert len(licence_scan("\n".join([mit] * 300), lic.Templates(lic.TEMPLATES, lic.THRESHOLD))) == 300
    assert time.monotonic() - began < 60


# personal data


def brute_spans(text):
    given = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, *m.span()) for k in pii.KINDS for m in re.finditer(given[k], text or "") if pii.PATTERNS[k][2](m.group())]


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é", " ", "\n", ".", "user", "0" * 17, "99"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)
    rows = [*enumerate(texts[:60]), (None, "a@b.co"), (1, "a@b.co"), (900, None), (901, ""), (902, prose(rng, 30_000) + " me@x.org")]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans if s.exact]) for r in got) == sorted((str(d), brute_spans(t)) for d, t in rows)
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_time_follows_the_length():
    w = pii.train(60, 5)
    n = 1_000_000
    began = time.monotonic()
    for text in ("x" * n + " 1", "9" * n, "x" * n + "@", "1." * (n // 2), "12 34 " * (n // 24), "a@b.co " * (n // 14), "+1 " * (n // 12)):
        pii.find(text, w)
    assert time.monotonic() - began < 120


def test_long_islands_are_cut_as_short_ones(monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["12", "4111", "555-1234", "a@b.co", "1.2.3.4", "(020)", "+44"]) for _ in range(60))
    w = pii.train(60, 5)
    whole = pii.find(text, w)
    monkeypatch.setattr(pii, "BLOCK", 7)
    assert pii.find(text, w) == whole


def test_field_sums_over_all_cuttings():
    island = pii.Island(text := "12 34-5 a@b.c 7", *next(pii.runs(text)))
    w = np.random.default_rng(1).normal(size=(pii.FEATURES, 4)) * 0.3
    scores = island.x @ w
    best = [-np.inf, None]

    def walk(at, total):
        if at == island.n:
            if total > best[0]:
                best[0] = total
            return [total]
        out = walk(at + 1, total)
        for k, (i, j, _, _) in enumerate(island.segments):
            if i == at:
                for c in range(4):
                    out += walk(j + 1, total + scores[k, c])
        return out

    totals = walk(0, 0.0)
    assert island.forward(scores)[2] == pytest.approx(np.logaddexp.reduce(totals))
    spans = {(a, z): k for k, (_, _, a, z) in enumerate(island.segments)}
    assert sum(scores[spans[a, z], pii.KINDS.index(kind)] for kind, a, z in pii.best(text, *next(pii.runs(text)), w)) == pytest.approx(best[0])


def test_field_on_unseen_examples():
    w = pii.train()
    hit = miss = wrong = 0
    for text, spans in pii.examples(300, seed=41):
        got = {s for run in pii.runs(text) for s in pii.best(text, *run, w)}
        hit, miss, wrong = hit + len(got & set(spans)), miss + len(set(spans) - got), wrong + len(got - set(spans))
    assert hit / (hit + miss) > 0.9 and hit / (hit + wrong) > 0.9
    clean = "The year 2024 had 365 days, 12 months and 3.14 as pi; v1.2.3 cost 45 euros at 10:30."
    assert pii.find(clean, w) == ([], [])


# quality


def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    offsets = np.array([0, 4, 5, 9])
    good, change = rng.normal(size=9), rng.normal(size=(2, 2))
    p, pairs, z = quality.Chains(offsets).marginals(good, change)
    total, both = 0.0, np.zeros((2, 2))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        ways = {y: np.exp(sum(good[a + i] for i in range(b - a) if y[i]) + sum(change[y[i], y[i + 1]] for i in range(b - a - 1))) for y in itertools.product((0, 1), repeat=b - a)}
        whole = sum(ways.values())
        total += np.log(whole)
        for i in range(b - a):
            assert p[a + i] == pytest.approx(sum(v for y, v in ways.items() if y[i]) / whole)
        for y, v in ways.items():
            for i in range(b - a - 1):
                both[y[i], y[i + 1]] += v / whole
    assert z == pytest.approx(total) and pairs == pytest.approx(both)


def test_lines_of_a_document_can_differ():
    rng = np.random.default_rng(3)
    offsets = np.array([0, 6, 7, 20])
    weight, share = rng.integers(1, 90, 20).astype(float), np.array([0.9, 0.9, 0.1])
    p, pairs = quality.expected(quality.Chains(offsets), rng.normal(size=20), np.array([[1.0, 0.0], [0.0, 1.0]]), weight, offsets, share, 30)
    assert np.add.reduceat(p * weight, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]) == pytest.approx(share, abs=1e-3)
    assert np.ptp(p[:6]) > 0.01 and pairs.sum() == pytest.approx(5 + 12)


def test_accept_keeps_every_column(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("_score", F.lit(7))
    out = quality.accept(table, spark.read.parquet(f"{d}/labels.parquet"))
    assert out.columns == table.columns and {(r.score, r._score) for r in out.collect()} == {("clash", 7)}


def test_held_out_accuracy_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/documents.parquet")
    out = {r.doc_id: r for r in quality.op6_quality_classifier(spark, d).collect()}
    assert len(out) == table.count()
    held = [(out[r.doc_id], r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(o.held_out and 0 <= o.score <= 1 and o.predicted == int(o.score >= 0.3) for o, _ in held)
    assert np.mean([o.predicted == q for o, q in held]) > 0.95
    labels = spark.read.parquet(f"{d}/labels.parquet")
    field = quality.fit(table, labels)
    rows = docs(spark, [(1, None), (2, ""), (3, "\n\n"), (None, "word " * 50_000), (3, "x"), (3, "x")], "label", "text2")
    scores = quality.quality(rows, field).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    assert quality.quality(docs(spark, []), field).count() == 0
    assert quality.fit(table, labels.limit(0)) is None
    assert {r.score for r in quality.quality(rows, None).collect()} == {0.5}


def test_scores_use_the_text_only():
    x = pa.array(["a line\nanother one here", "%%% ### $$$"])
    feats, _, offsets = quality.line_features(x)
    assert len(feats) == 3 and offsets.tolist() == [0, 2, 3]


# URLs


def brute_rule(host, path, rules):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_url_rules(spark):
    rng = random.Random(4)
    hosts, paths = ["com", "example.com", "a.example.com", "net", "b.net", "org"], ["/", "/en/", "/en/7", "/en/7/x", "/de", ""]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.6}.values())
    urls = [f"{s}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(hosts)}{rng.choice([*paths, '/en/7/x/y', '/EN/', '/en/\U0010ffffz'])}{rng.choice(['', '?q=://x/en/', '#f'])}" for s in ("http", "HTTPS") for _ in range(150)]
    rows = [*enumerate(urls), (500, None), (501, "no scheme"), (502, ""), (503, "://"), (504, "http://EXAMPLE.COM/en/7"), (None, urls[0]), (0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    rdf = spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "host string, path string, rule string, verdict string")

    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        if rest is None:
            return "", ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        return rest[:cut].lower(), tail[:end]

    for groups in (10**6, 40):  # one sweep a host, and several
        got = url_filter.judge(pages, rdf, keys_per_group=groups).collect()
        want = sorted((str(i), *parts(u), *map(str, brute_rule(*parts(u), rules))) for i, u in rows)
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    assert url_filter.judge(pages.limit(0), rdf).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rdf.limit(0)).collect()} == {"allow"}


# search


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(size=8).round(3).tolist()) for i in range(700)] + [(1000 + i, [0.5] * 8) for i in range(300)]
    vectors += [(2000, None), (2001, [float("nan")] + [0.0] * 7), (2002, [float("inf")] * 8), (2003, [None] * 8), (2004, [1.0] * 3), (2100, []), (None, [1.0] * 8), (5, [9.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0).collect()
    ok = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in ok:
        if q % 100 == 0:
            near = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_large_components_are_exact_or_an_error(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([-1, 1]) * rng.choice([0.5, 1.4e6, 4e5, 1.0]) for _ in range(4)]) for i in range(60)]
    got = topk_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    exact = {i: [int(np.floor(x * 1024)) for x in v] for i, v in vectors}
    want = []
    for q in (0, 20, 40):
        near = sorted((-sum(a * b for a, b in zip(exact[q], w, strict=True)), i) for i, w in exact.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        topk_search.top_k(spark.createDataFrame([(1, [1e300]), (2, [1e300])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_query_blocks_give_the_same(spark, monkeypatch):
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 6))).alias("embedding"))
    whole = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 200)
    assert sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect())) == whole and len(whole) == 120
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk_search.top_k(df.limit(1), F.lit(True)).count() == 0
