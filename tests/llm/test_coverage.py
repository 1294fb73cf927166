from __future__ import annotations

import random
import string
import time
import tracemalloc

import numpy as np

from precursor.llm import secret_forest
from precursor.llm.common import word_hashes


def _plain(value, frequent):
    """Greedy longest match over the words as strings."""
    low = value.lower().encode()

    def known(s):
        return s.isalpha() and int(word_hashes(s)[1][0] % np.uint64(secret_forest.WORD_ENTRIES)) in frequent

    at = covered = 0
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 3, -1) if known(low[at:at + n])), 0)
        covered, at = covered + n, at + max(n, 1)
    return covered / len(low) if low else 0.0


def _words(rng):
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(4, 12))) for _ in range(200)]
    return words, frozenset((word_hashes(" ".join(words).encode())[1] % np.uint64(secret_forest.WORD_ENTRIES)).tolist())


def test_coverage_against_plain_search():
    rng = random.Random(3)
    words, frequent = _words(rng)
    for _ in range(300):
        v = "".join(rng.choice([rng.choice(words), rng.choice(words).upper(), "é", "_", "9x", rng.choice(string.ascii_letters)])
                    for _ in range(rng.randint(0, 25)))
        want = _plain(v, frequent)
        assert secret_forest.coverage(v, frequent) == want
        assert secret_forest.coverage(v, frequent, piece=13) == want  # words across the borders of pieces


def test_coverage_of_a_very_long_run():
    rng = random.Random(4)
    _, frequent = _words(rng)
    value = "".join(rng.choices(string.ascii_letters + "+/", k=5_000_000))
    tracemalloc.start()
    start = time.perf_counter()
    secret_forest.coverage(value, frequent)
    assert time.perf_counter() - start < 20 and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
