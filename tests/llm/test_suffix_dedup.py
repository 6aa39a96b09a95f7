from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from rasterloom.llm import suffix_dedup


def covered(rows, least):
    words = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            seen[tuple(w[k : k + least])].add(i)
    found = set()
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            if len(seen[tuple(w[k : k + least])]) > 1:
                found |= {(i, k + j) for j in range(least)}
    return found


def test_against_brute_force(docs, corpus):
    found = suffix_dedup.repeated_passages(docs, 50).collect()
    assert {(r["doc_id"], k) for r in found for k in range(r["start_word"], r["end_word"])} == covered(corpus, 50)
    assert all(r["n_words"] >= 50 and r["other_id"] != r["doc_id"] for r in found)


def test_passages_just_long_enough(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for length in (49, 50, 51, 60, 75):
        passage = fresh(length)
        for _ in range(4):
            rows.append((len(rows), " ".join(fresh(rng.randrange(40)) + passage + fresh(rng.randrange(40)))))
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()
    assert {(r["doc_id"], k) for r in found for k in range(r["start_word"], r["end_word"])} == covered(rows, 50)
    assert {r["doc_id"] for r in found} == set(range(4, 20))


def test_selection_depends_on_content_alone():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 2**63, 50).astype(np.uint64)
    for _ in range(50):
        a, b = (np.r_[rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64), passage, rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)] for _ in range(2))
        assert len(np.intersect1d(suffix_dedup.kept_suffixes(a)[1], suffix_dedup.kept_suffixes(b)[1]))


def test_odd_and_empty_tables(odd_docs, no_docs, clashing, docs):
    assert suffix_dedup.repeated_passages(odd_docs, 50).count() == 0
    found = suffix_dedup.repeated_passages(odd_docs, 4).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["other_id"]) for r in found} == {(1, 0, 4, 2), (2, 0, 4, 1)}
    assert suffix_dedup.repeated_passages(no_docs).count() == 0
    assert sorted(suffix_dedup.repeated_passages(clashing).collect()) == sorted(suffix_dedup.repeated_passages(docs).collect())


def test_passages_of_an_id_with_several_texts(spark):
    """Id 5 has the text of 1 and another one, whose passage 9 holds too."""
    rng = random.Random(21)
    a, b, c = ([f"w{rng.randrange(5000)}" for _ in range(90)] for _ in range(3))
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*c[:20], *b[:79]])), (9, " ".join([*c[:20], *b[:79]]))]
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in found) == [(1, 0, 90), (5, 0, 90), (9, 20, 99)]
