from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import Groups, docs, prose
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup
from quillgraph.llm.line_dedup import drop_repeated_lines, line_groups
from quillgraph.llm.links import connected_components, linked_groups
from quillgraph.llm.near_dedup import estimate, keep_one_of_each, merge, near_duplicates, registers


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    g = Groups()
    for i, a in enumerate(sets):
        g.find(i)
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                g.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(g.find(i), []).append(d)
    low = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted((str(d), len(sets[i]), str(low[g.find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([3, 30, 120]))) for i in range(40)]
    base = prose(rng, 150).split()
    for i in range(60):  # one large group of near copies, some of which are near to few others
        w = list(base)
        for _ in range(rng.choice([0, 1, 4, 9, 12])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((100 + i, " ".join(w)))
    rows += [(200, rows[0][1].upper()), (201, rows[1][1] + "\n"), (202, None), (203, ""), (204, " \t\n"), (205, "One"), (206, "one"), (207, "é É"), (None, rows[2][1]), (None, "alone here"), (3, rows[3][1]), (3, "another text of row three")]
    rows += [(300 + i, "the same copy of a text that many rows hold") for i in range(50)]
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("k", [2, 5])
def test_components_match_all_pairs(spark, seed, k):
    rows = corpus(seed)
    got = near_duplicates(docs(spark, rows), k).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_texts_and_no_rows(spark):
    text = prose(random.Random(4), 60_000)
    got = near_duplicates(docs(spark, [(1, text), (2, text + " tail"), (3, "x" * 400_000)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}
    assert near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    out = keep_one_of_each(docs(spark, [(5, "a b c d e f"), (2, "a b c d e f"), (7, ""), (8, ""), (None, "q r s t u v")]))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "7", "8", "None"]
    assert "kept" in out.columns


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64, 1500, dtype=np.uint64) for _ in range(2))
    b[:1000] = a[:1000]
    ra, rb, rc = (registers(x, np.array([0, len(x)]), 400) for x in (a, b, np.unique(np.concatenate((a, b)))))
    assert (merge(ra, rb) == rc).all()
    assert estimate(ra, rb, np.array([1500.0]), np.array([1500.0]))[0] == pytest.approx(0.5, abs=0.1)
    assert estimate(ra, ra, np.array([1500.0]), np.array([1500.0]))[0] == 1


def test_linked_groups_lose_no_link(spark):
    rng = random.Random(2)
    at = {i: rng.random() for i in range(120)}  # linked if near on a line; one bucket holds everything
    pos = spark.createDataFrame(list(at.items()), "id long, x double")
    near = lambda pairs: pairs.join(pos.toDF("a", "xa"), "a").join(pos.toDF("b", "xb"), "b").where("abs(xa - xb) < 0.01").select("a", "b")
    buckets = pos.select(F.lit(1).cast("long").alias("bucket"), "id")
    got = linked_groups(buckets, near, lambda rest: rest.join(pos, "id"), "abs(x_x - y_x) < 0.01")
    g = Groups()
    for i in at:
        for j in at:
            if abs(at[i] - at[j]) < 0.01:
                g.join(i, j)
    linked = {i for i in at if any(j != i and abs(at[i] - at[j]) < 0.01 for j in at)}
    assert sorted(map(tuple, got.select("id", "component").collect())) == sorted((i, g.find(i)) for i in linked)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def norm(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(x, y):
    x, y = x.split(" "), y.split(" ")
    most = int(0.2 * max(len(x), len(y)) + 1e-7)
    return abs(len(x) - len(y)) <= most and edits(x, y) <= most


def line_corpus(seed):
    rng = random.Random(seed)
    base = prose(rng, 90)
    near = []
    for _ in range(30):
        w = base.split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        near.append(" ".join(w))
    rows = [(i, "\n".join([prose(rng, rng.choice([1, 4, 20])), near[i % 30], "Same footer, everywhere!", "", prose(rng, 5)])) for i in range(40)]
    return [*rows, (50, None), (51, ""), (52, "\n\n--\n"), (None, "same footer everywhere"), (7, rows[7][1]), (60, "to to a\nto a to\na to to")]


@pytest.mark.parametrize("seed", range(2))
def test_lines_match_all_pairs(spark, seed):
    rows = line_corpus(seed)
    got = line_groups(docs(spark, rows)).collect()
    lines = [(d, n, norm(x)) for d, t in rows for n, x in enumerate((t or "").split("\n")) if norm(x)]
    g, texts = Groups(), sorted({x for *_, x in lines})
    for i, a in enumerate(texts):
        g.find(a)
        for b in texts[:i]:
            if alike(a, b):
                g.join(a, b)
    first = {}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    for d, n, x in lines:
        r = g.find(x)
        first[r] = min(first.get(r, (d, n)), (d, n), key=order)
    want = Counter((d, n, (d, n) == first[g.find(x)], *first[g.find(x)]) for d, n, x in lines)
    assert Counter(tuple(r) for r in got) == want
    assert len({g.find(t) for t in texts}) < len(texts)  # some fuzzy links exist


def edited(rng, words, n, kinds):
    """``n`` edits, so that the edit distance is ``n`` at most."""
    words = list(words)
    for _ in range(n):
        i, kind = rng.randrange(len(words)), rng.choice(kinds)
        words[i : i + (kind != "add")] = [] if kind == "drop" else ["edit" + str(rng.randrange(10**6))]
    return words


@pytest.mark.parametrize(("kinds", "least"), [(["replace"], 0.97), (["replace", "replace", "add", "drop"], 0.9)])
def test_recall_of_edits_alone(spark, kinds, least):
    """Pairs of every length and every number of edits, against the edit distance; nothing but the distance says what counts."""
    rng = random.Random(5)
    lines, wanted = [], []
    for n in [*range(4, 81), 100, 120, 150, 200, 400]:
        for _ in range(6):
            base = prose(rng, n).split()
            other = edited(rng, base, rng.randint(1, max(1, int(0.2 * n))), kinds)
            if other and base != other and alike(" ".join(base), " ".join(other)):
                wanted.append((len(lines), len(lines) + 1))
            lines += [" ".join(base), " ".join(other)]
    got = {r.line_no: r.first_line_no for r in line_groups(docs(spark, [(1, "\n".join(lines))])).collect()}
    recall = np.mean([got[a] == got[b] for a, b in wanted])
    print(f"recall of {kinds}: {recall:.3f} of {len(wanted)} pairs")
    assert recall >= least


def test_crowded_blocks_lose_no_link(spark):
    """Hundreds of lines that share a block but not their other words, with links between some that are nobody's pivot."""
    rng = random.Random(3)
    lines = []
    for i in range(300):
        n = rng.choice([12, 20, 30, 55])
        base = ["all", "lines", "begin", "with", "these", "six", *prose(rng, n).split()]
        lines.append(" ".join(base))
        if i % 10 == 0:
            lines.append(" ".join(edited(rng, base[:6], 0, ["replace"]) + edited(rng, base[6:], int(0.2 * len(base)), ["replace"])))
    got = {r.line_no: r.first_line_no for r in line_groups(docs(spark, [(1, "\n".join(lines))])).collect()}
    g = Groups()
    for i, a in enumerate(lines):
        g.find(i)
        for j in range(i):
            if alike(a, lines[j]):
                g.join(i, j)
    assert got == {i: g.find(i) for i in range(len(lines))}


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_every_link_of_mixed_edits(spark, similarity):
    """Pairs with the most edits that count, words added and dropped among them; half the lines share a phrase or nearly all their words."""
    rng = random.Random(17)
    lines = []
    for n in [*range(3, 60), 80, 130, 260]:
        for phrase in (0, 0, 6):
            base = [*"all lines begin with these six".split()[:phrase], *prose(rng, n).split()]
            most = int((1 - similarity) * len(base) + 1e-7)
            lines += [" ".join(base), *(" ".join(edited(rng, base, most, ["replace", "add", "drop"])) for _ in range(2))]
    few = [f"w{i}" for i in range(12)]
    for _ in range(150):
        base = [rng.choice(few) for _ in range(rng.randint(10, 20))]
        lines += [" ".join(base), " ".join(edited(rng, base, int((1 - similarity) * len(base) + 1e-7), ["replace", "add", "drop"]))]
    lines = [x for x in lines if x]
    got = {r.line_no: r.first_line_no for r in line_groups(docs(spark, [(1, "\n".join(lines))]), similarity).collect()}
    g, split = Groups(), [x.split() for x in lines]
    for i, a in enumerate(split):
        g.find(i)
        for j, b in enumerate(split[:i]):
            most = int((1 - similarity) * max(len(a), len(b)) + 1e-7)
            shared = sum((Counter(a) & Counter(b)).values())
            if max(len(a), len(b)) - shared <= most and edits(a, b) <= most:
                g.join(i, j)
    lost = sum(got[i] != g.find(i) for i in got)
    assert got == {i: g.find(i) for i in range(len(lines))}, f"{lost} of {len(lines)} lines in another group"


def test_short_lines_long_lines_and_unicode_punctuation(spark):
    rng = random.Random(9)
    lines = []
    for n in range(3, 10):
        base = [f"w{n}x{i}" for i in range(n)]
        lines += [" ".join(base), " ".join([*base[:1], "other", *base[2:]]), " ".join(base[:2] + base[3:])]
    rng.shuffle(lines)
    got = {r.line_no: r.first_line_no for r in line_groups(docs(spark, [(1, "\n".join(lines))])).collect()}
    g = Groups()
    for i, a in enumerate(lines):
        g.find(i)
        for j, b in enumerate(lines[:i]):
            if alike(a, b):
                g.join(i, j)
    assert got == {i: g.find(i) for i in range(len(lines))}
    words = [f"v{i}" for i in range(40_000)]
    long = " ".join(words) + "\n" + " ".join([*words[:7], "other", *words[8:]])
    rows = line_groups(docs(spark, [(1, long), (2, "\u201cquoted\u201d line \u2014 here"), (3, '"quoted" line - here')])).collect()
    assert {(r.doc_id, r.line_no) for r in rows if r.kept} == {(1, 0), (2, 0)}


def test_dropped_lines(spark):
    out = drop_repeated_lines(docs(spark, [(1, "alpha one\nbeta two"), (2, "Alpha  one!\ngamma"), (3, "beta two"), (4, ""), (5, None)]).withColumn("n_chars", F.length("text").cast("long")))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("alpha one\nbeta two", 18), 2: ("gamma", 5), 4: ("", 0), 5: (None, None)}
    assert drop_repeated_lines(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "alpha one\nbeta two"), (2, "alpha one")], "_id", "_gone", "lines", "left", "row", "gone_id")
    assert drop_repeated_lines(clash).columns == clash.columns and drop_repeated_lines(clash).count() == 1


def test_letters_are_fetched_for_few_pairs(spark, monkeypatch):
    """Long lines that share a phrase are told apart by their marks, and of near copies one pair a line is compared by its letters."""
    rng = random.Random(23)
    phrase = [f"sharedphraseofwords{i}" for i in range(8)]
    unlike = [" ".join([*phrase, *prose(rng, 150).split()]) for _ in range(40)]
    base = prose(rng, 60).split()
    near = [" ".join(edited(rng, base, 1, ["replace"])) for _ in range(40)]
    compared, whole = [], line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs, texts: compared.append(pairs.count()) or whole(pairs, texts))
    got = {r.line_no: r.first_line_no for r in line_groups(docs(spark, [(1, "\n".join(unlike + near))])).collect()}
    assert got == {i: min(i, 40) for i in range(80)}
    assert sum(compared) <= 80, compared
