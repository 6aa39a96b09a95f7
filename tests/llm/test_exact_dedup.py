from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterloom.llm import exact_dedup


def lowered(text):
    return (text or "").encode().lower()


def test_against_brute_force(docs, corpus):
    groups = defaultdict(list)
    for r in corpus:
        groups[lowered(r[1])].append(r[0])
    texts = {r[0]: lowered(r[1]) for r in corpus}
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(found) == len(corpus)
    for r in found:
        own = groups[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert bytes(r["sha"]) == hashlib.sha256(texts[r["doc_id"]]).digest()


def test_only_ascii_letters_are_lowered(spark):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "äB")]
    found = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 3, 3: 3, 2: 4, 4: 4}


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    bits = 40
    values = rng.integers(0, 2**bits, 3000).astype(np.uint64)
    values = np.r_[values, values[:500], values[:100], np.full(700, values[0]), np.arange(50, dtype=np.uint64)]  # many in one run
    rng.shuffle(values)
    parts = [exact_dedup.CountingQuotientFilter.of_all(x, bits) for x in np.array_split(values, 7)]
    merged = exact_dedup.CountingQuotientFilter.merged([exact_dedup.CountingQuotientFilter.unpacked(x.packed()) for x in parts])
    want, n = np.unique(values, return_counts=True)
    found, counts = merged.items()
    assert (found == want).all()
    assert (counts == n).all()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_filters_hold_remainders_only(n):
    values = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    one = exact_dedup.CountingQuotientFilter.of_all(values, 64)
    assert one.quotient_bits >= 1
    assert len(one.occupied) == 1 << one.quotient_bits
    assert (one.remainders < np.uint64(1 << 64 - one.quotient_bits)).all()
    assert one.run_ends.sum() == one.occupied.sum()
    assert one.items()[0].tolist() == values.tolist()
    again = exact_dedup.CountingQuotientFilter.unpacked(one.packed())
    assert again.items()[0].tolist() == values.tolist()
    assert len(one.packed()) < 18 + 9 * n + 2


def test_blocks_and_partial_filters(docs, monkeypatch):
    """However fingerprints are dealt to filters, the same ones are found to repeat."""
    keys = exact_dedup.text_keys(docs).cache()
    fps = [r["fp"] for r in keys.collect()]
    want = sorted(x for x, n in Counter(fps).items() if n > 1)
    for partial, block in ((10**6, 10**5), (500, 20), (500, 10**5)):
        monkeypatch.setattr(exact_dedup, "PARTIAL_FINGERPRINTS", partial)
        monkeypatch.setattr(exact_dedup, "BLOCK_FINGERPRINTS", block)
        assert sorted(r["fp"] for r in exact_dedup.repeated_fingerprints(keys, len(fps)).collect()) == want


def test_odd_rows(odd_docs):
    found = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(found) == 8
    assert [r["group_size"] for r in found if r["doc_id"] == 1] == [5, 5, 5]
    assert {r["keep_id"] for r in found if r["doc_id"] == 1} == {2}
    assert sorted((r["keep_id"], r["kept"]) for r in found if r["doc_id"] == 3) == [(3, True), (3, True)]
    assert sorted((str(r["keep_id"]), r["kept"]) for r in found if r["doc_id"] is None) == [("2", False), ("None", True)]
    kept = exact_dedup.keep_one_of_each(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("2", "Alpha BETA gamma delta"), ("None", "only here")]
    assert [r["doc_id"] for r in kept if not r["text"]] == [3]


def test_columns_and_empty_tables(clashing, no_docs):
    kept = exact_dedup.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert all(r["fp"] == f"fp{r['doc_id']}" for r in kept.collect())
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.keep_one_of_each(no_docs).count() == 0
