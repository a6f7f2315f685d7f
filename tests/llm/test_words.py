"""Word hashes: words made to collide under a sum of letters stay apart in all that uses them."""

import numpy as np
from pyspark.sql import functions as F

from sqltide.llm import jaccard, substring
from sqltide.llm.words import word_hashes


def twins(n=4096):
    """A word over a and b whose letters follow the parity of their place's bits, and its
    complement: sums of letters times powers of any odd number are equal modulo 2**64."""
    odd = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


def test_hashes_differ_and_kinds_have_nothing_in_common():
    for size in (32, 64, 65, 1024, 4096):
        a, b = twins(size)
        for kind in (0, 1):
            hashes, bounds = word_hashes([a, b, a.upper()], kind=kind)
            assert len(set(hashes.tolist())) == 3 and bounds.tolist() == [0, 1, 2, 3]
            lowered = word_hashes([a, b, a.upper()], lower=True, kind=kind)[0]
            assert lowered[0] == lowered[2] != lowered[1]
        assert not np.intersect1d(word_hashes([a, b])[0], word_hashes([a, b], kind=1)[0]).size


def test_operators_keep_colliding_words_apart(spark):
    a, b = twins()
    rows = [(1, " ".join([a] * 60)), (2, " ".join([b] * 60)),
            (3, f"{a} one two three"), (4, f"{b} one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring.report(docs).collect())
    assert all(r.id == r.component for r in jaccard.report(docs).collect())
    for size, percent in ((5, 80), (3, 90)):
        assert jaccard.representatives(docs, size=size, percent=percent).count() == 4
    assert substring.dedup(docs).where(F.length("text") == 0).isEmpty()
