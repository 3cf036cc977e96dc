"""Properties on generated input."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import bpe, leaks, pii, typography

WORDS = st.lists(st.sampled_from("abcde"), min_size=0, max_size=40)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_longest_run_is_the_longest_common_stretch(a, b):
    want = max((n for n in range(len(b) + 1) for i in range(len(b) - n + 1) if any(a[k : k + n] == b[i : i + n] for k in range(len(a) - n + 1))), default=0)
    code = {w: i for i, w in enumerate("abcde", 1)}
    score, run = leaks.align(np.array([code[w] for w in a], int), np.array([code[w] for w in b], int))
    assert run == want and score >= want * leaks.MATCH


def test_every_window_has_a_seed(spark):
    """The rarest n-gram of each window that stands whole in the corpus, against brute force."""
    rng = np.random.default_rng(3)
    rows, counts, want = [], {}, set()
    for item in range(40):
        n = int(rng.integers(12, 40))
        grams = [int(g) for g in rng.integers(0, 60, n - leaks.SEED_WORDS + 1)]
        counts |= {g: int(g) % 7 for g in grams}
        rows += [(item, at, g, n) for at, g in enumerate(grams)]
        for at in range(n - leaks.LEAK_WORDS + 1):
            best = min(range(at, at + leaks.LEAK_WORDS - leaks.SEED_WORDS + 1), key=lambda i: (counts[grams[i]], i))
            if counts[grams[best]]:
                want.add((grams[best], item, best, n))
    places = spark.createDataFrame(rows, "item long, at int, g long, size int")
    frequency = spark.createDataFrame([(g, n) for g, n in counts.items() if n], "g long, n long")
    assert {tuple(r) for r in leaks.choose_seeds(places, frequency).collect()} == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(pii.KINDS), st.integers(0, 50), st.integers(1, 12)), max_size=30))
def test_settled_spans_never_overlap(raw):
    spans = [(k, s, s + n) for k, s, n in raw]
    kept = pii._free(spans)
    assert all(a[2] <= b[1] for a, b in zip(kept, kept[1:]))
    assert set(kept) <= set(spans)
    for x in spans:  # what fell out overlaps something that stayed
        assert x in kept or any(not (x[2] <= y[1] or y[2] <= x[1]) for y in kept)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=25), min_size=1, max_size=6))
def test_merged_filters_hold_every_repeat(parts):
    bits = 1 << 12
    once = rep = np.zeros(bits, bool)
    for part in parts:
        o, r = np.zeros(bits, bool), np.zeros(bits, bool)
        for h in part:
            pos = typography._probe_bits(np.array([h * 7919]), np.array([h * 104729 + 1]), bits)[:, 0]
            if o[pos].all():
                r[pos] = True
            o[pos] = True
        once, rep = typography._merge(once, rep, o, r)
    flat = [h for p in parts for h in p]
    for h in {h for h in flat if flat.count(h) > 1}:
        assert rep[typography._probe_bits(np.array([h * 7919]), np.array([h * 104729 + 1]), bits)[:, 0]].all()


tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return bpe.PartitionEncoder(path), t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=20))
def test_any_text_is_encoded_like_the_library(both, texts):
    enc, t = both
    assert enc.encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
