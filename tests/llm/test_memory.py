"""What a Python worker holds at once."""

import tracemalloc

import numpy as np

from gridleaf.llm import langid, tokens


def test_centroids_copy_few_vectors():
    """The vectors of a language are held once: a mean over a cluster of them adds in the same order without a second copy."""
    rows = np.random.default_rng(3).random((600, 4096), dtype=np.float32)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    at = np.arange(0, 600, 7)
    assert np.array_equal(langid._total(rows, at), rows[at].sum(axis=0))
    tracemalloc.start()
    langid.cluster(rows, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes / 4


def test_word_cache_is_small():
    """Rare words (numbers, names) would fill a large cache: at some 170 bytes an entry the whole of it stays under 32 MB."""
    assert tokens.CACHE * 170 < 32 << 20
