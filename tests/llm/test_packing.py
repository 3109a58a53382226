from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import docs, prose
from tokenizers import Tokenizer

from quillgraph.llm.packing import pack, plan, tokenizer


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_fast_ids_equal_the_tokenizer_for_every_plain_character(slow):
    encode = tokenizer(None)
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x203B), 0x20AC]]
    rng = random.Random(1)
    texts = [f"{a}{c}{b}" for c in chars for a, b in ((" x", "y "), ("", ""), ("1", "."), ("\n", "\n"))] + ["".join(rng.choice(chars) for _ in range(60)) for _ in range(500)]
    texts += ["", " " * 50, "<|endoftext|> a", "日本語 text 😀", "a" * 5000, "Αβγ", "é" * 300]
    assert encode(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_valid_and_as_good_as_sequential_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.expovariate(1 / rng.choice([5, 20, 60]))) + 1) for _ in range(400)] + [64] * 30
    steps = plan(Counter(lengths), 64)
    rows, ranks = defaultdict(list), Counter()
    for length, lo, hi, first, offset in steps:
        assert lo == ranks[length]
        ranks[length] = hi
        for s in range(first, first + hi - lo):
            rows[s].append((offset, length))
    assert ranks == Counter(lengths)
    for placed in rows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(rows) <= best_fit(lengths, 64) * 1.02 + 1


def test_pieces_round_trip(spark, slow):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([0, 1, 10, 200, 900]))) for i in range(60)] + [(None, "no id"), (7, "again"), (7, "again"), (90, None), (91, ""), (92, "long " * 30_000)]
    out = pack(docs(spark, rows)).collect()
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    want = []
    for d, t in rows:
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(str(d), k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert len(by_sequence) <= best_fit([w[3] for w in want], 1024) + 1


def test_no_rows(spark):
    assert pack(docs(spark, [])).count() == 0
