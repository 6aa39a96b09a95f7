from __future__ import annotations

import math
from collections import Counter

from rasterloom.llm import mixing


def waterfill(sizes, weights, share, most):
    """Targets by repeated resharing."""
    total, stops = sum(sizes) * share, [s * most for s in sizes]
    targets, full = [0.0] * len(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(stops[i] for i in full)
        for i in open_:
            targets[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if targets[i] > stops[i]]
        if not over:
            return [stops[i] if i in full else targets[i] for i in range(len(sizes))]
        full |= set(over)


def test_plan_against_brute_force(docs, corpus):
    size = {r[0]: len((r[1] or "").encode().split()) for r in corpus}
    source = {r[0]: r[3] for r in corpus}
    names = [*sorted({s for s in source.values() if s is not None}), None]
    totals = [sum(size[i] for i in size if source[i] == n) for n in names]
    want = dict(zip(names, waterfill(totals, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2.0), strict=True))
    found = mixing.mixing_plan(docs).collect()
    assert len(found) == len(corpus)
    for r in found:
        assert r["size"] == size[r["doc_id"]]
        assert r["source_size"] == totals[names.index(r["source"])]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0.0
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1)
        assert r["copies"] <= 2
    assert {r["doc_id"]: r["copies"] for r in mixing.mixing_plan(docs).collect()} == {r["doc_id"]: r["copies"] for r in found}


def test_taken_words_come_near_targets(spark):
    rows = [(i, "w " * (20 + i % 50), "abcdef"[i % 4 if i % 3 else 0]) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mixing_plan(docs).collect():
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] for s in target)


def test_mix_emits_copies(clashing):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mixing_plan(clashing).collect()}
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    found = Counter(r["doc_id"] for r in out.collect())
    assert found == Counter({k: v for k, v in plan.items() if v})


def test_plan_is_native(docs):
    for df in (mixing.mixing_plan(docs), mixing.mixed(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert mixing.mixing_plan(odd_docs).count() == 8
    assert mixing.mixing_plan(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0
    only_empty = odd_docs.where("doc_id = 3")
    assert {(r["target"], r["copies"]) for r in mixing.mixing_plan(only_empty).collect()} == {(0.0, 0)}
