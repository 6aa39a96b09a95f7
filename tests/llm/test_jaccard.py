from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from rasterloom.llm import jaccard


def sets_of(rows, width):
    found = {}
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        n = min(width, len(words))
        found[r[0]] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    return found


def components_of(sets, num, den):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(sets, 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 50)])
def test_against_brute_force(docs, corpus, width, num):
    sets = sets_of(corpus, width)
    want = components_of(sets, num, 100)
    found = jaccard.similar_components(docs, width, num, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}


def test_hot_group_of_near_copies_and_chains(spark):
    """Near copies of near copies: the ends of the chain do not link with each other, nor with every hub."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(60)]
    rows, words = [], list(base)
    for i in range(80):
        words = list(words)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base, f"tail{i % 9}"])) for i in range(60)]
    rows += [(200 + i, " ".join(f"u{i}v{k}" for k in range(30)) + " all of these share one very common closing passage of a dozen words") for i in range(80)]
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == components_of(sets_of(rows, 3), 80, 100)


def test_prefixes_of_linked_sets_share_a_shingle_under_every_order():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 20, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(5, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.08], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            for order in range(jaccard.ORDERS):
                x, y = (jaccard.prefix(s, classes, order, 80, 100).tolist() for s in (a, b))
                first = next(t for t in x if t in set(y))
                assert min(len(a) - x.index(first), len(b) - y.index(first)) * 180 >= (len(a) + len(b)) * 80


def test_odd_rows(odd_docs):
    found = jaccard.similar_components(odd_docs, 3, 90, 100).collect()
    assert len(found) == 8
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert {(r["component_id"], r["n_shingles"]) for r in found if r["doc_id"] == 3} == {(3, 0)}
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}


def test_columns_and_empty_tables(clashing, no_docs):
    kept = jaccard.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert all(r["hub"] == f"hub{r['doc_id']}" for r in kept.collect())
    assert jaccard.similar_components(no_docs).count() == 0
    assert jaccard.keep_one_of_each(no_docs).count() == 0


def test_a_copy_with_another_text_under_its_id_stays(spark):
    """Id 5 has the text of 3 and one that 9 nearly has, so all three are one component."""
    rng = random.Random(12)
    a, b = ([f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(2))
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (9, " ".join([*b[:-1], "other"])), (12, "far from all of them")]
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(3, 3), (5, 3), (5, 3), (9, 3), (12, 12)]


def rows_that_may_meet(rows, num, den):
    """By a loop over the pairs of each token: (token, doc_id, n, place) that may link with another row."""
    of_token = {}
    for r in rows:
        of_token.setdefault(r[0], []).append(r)
    for same in of_token.values():
        for i, (token, _, doc_id, n, place) in enumerate(same):
            if any(k != i and min(n - place, m - other) * (num + den) >= (n + m) * num for k, (_, _, _, m, other) in enumerate(same)):
                yield token, doc_id, n, place


@pytest.mark.parametrize("num", [50, 80, 90])
def test_rows_that_can_link_with_none_leave_their_bucket(spark, num):
    """Buckets of all sizes, some over several batches, and a salted one, which stays whole."""
    rng = random.Random(num)
    rows = []
    for token in range(30_000):
        for _ in range(rng.choice([1, 2, 2, 3, 5]) if token % 10_000 else 600):
            n = rng.randrange(1, 300)
            rows.append((token, -1, len(rows), n, rng.randrange(jaccard.prefix_length(n, num, 100))))
    salted = [(40_000, k % 4, 10**6 + k, 10 * k + 10, 0) for k in range(700)]
    frame = spark.createDataFrame(rows + salted, "token long, salt int, doc_id long, n int, place int").coalesce(1).sortWithinPartitions("token")
    found = [tuple(r) for r in jaccard.met_again(frame, num, 100).collect()]
    want = [*rows_that_may_meet(rows, num, 100), *((r[0], *r[2:]) for r in salted)]
    assert len(want) < 0.8 * len(rows)
    assert sorted(found) == sorted(want)


def test_later_rounds_leave_out_what_is_settled(docs, corpus, monkeypatch):
    """Several rounds of hubs, each over what the one before left, find the components too."""
    monkeypatch.setattr(jaccard, "PAIRS_PER_TEXT", 0)
    staged, stage = [], jaccard.common.stage
    monkeypatch.setattr(jaccard.common, "stage", lambda df, name, *a: staged.append((name, df.columns)) or stage(df, name, *a))
    found = jaccard.similar_components(docs, 1, 50, 100).collect()
    rounds = [columns for name, columns in staged if name == "placed"]
    assert len(rounds) >= 2 and all("hub_id" in columns for columns in rounds)
    assert {r["doc_id"]: r["component_id"] for r in found} == components_of(sets_of(corpus, 1), 50, 100)
