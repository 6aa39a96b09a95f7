from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import quality


def brute(text):
    text = text or ""
    data = text.encode()
    words = [w.decode() for w in data.split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


TEXTS = ["", None, " ", "a", "a b", "a b c", "a b c d", "a a a a", "a a a a a a", "x y z x y z", "x y z q x y z w x y", "l\nl\n\n\nm\nl", "é# |é", "one\x0btwo\x0cthree\rfour", "a b c", "  x", "p q r s p q r t q r s p"]


def test_measures_against_brute_force(spark, docs, corpus):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    found = {r["doc_id"]: r for r in quality.quality_filter(spark.createDataFrame(rows, "doc_id long, text string"), keep_measures=True).collect()}
    found |= {r["doc_id"] + 1000: r for r in quality.quality_filter(docs, keep_measures=True).collect()}
    for i, t in rows + [(r[0] + 1000, r[1]) for r in corpus]:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), t and t[:40]


def test_order_does_not_change_the_verdict(spark):
    prose = " ".join(f"w{i}" for i in range(80))
    rows = [(1, prose), (2, "|".join("abcdefghij" * 9) + " x" * 60), (3, "short"), (4, "\n".join(["same line again here"] * 40)), (5, prose.upper().replace(" ", "!! ")), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["failed_rule"] for r in quality.quality_filter(docs).collect()}
    full = {r["doc_id"]: r["failed_rule"] for r in quality.quality_filter(docs, keep_measures=True).collect()}
    assert {k for k, v in plain.items() if v is None} == {k for k, v in full.items() if v is None} == {1}


def test_rules_with_most_rejection_per_cost_come_first(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 30) for i in range(200)], "doc_id long, text string")
    dear = quality.Rule("dear", F.length(F.regexp_replace(F.repeat("text", 3000), "[aeiou]+", "")) < 0)
    cheap = quality.Rule("cheap", F.col("doc_id") % 2 == 0)
    assert [r.name for r in quality.rule_order(docs, [dear, cheap])] == ["cheap", "dear"]


def test_dear_measures_are_only_taken_where_their_rule_is_reached(docs):
    """Of what the rules need beyond the returned columns, nothing stands in the plan but inside the CASE, and a rule that
    rejects a text keeps those after it from being evaluated."""
    plan = quality.quality_filter(docs, keep_measures=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("!!") == plan.count("[^A-Z]") == 1
    assert min(plan.index("!!"), plan.index("[^A-Z]")) > plan.index("CASE WHEN")
    first = quality.Rule("first", F.col("doc_id") >= 0, 0.0)
    second = quality.Rule("second", F.raise_error(F.lit("reached")).isNull(), 1.0)
    rows = docs.where("doc_id is not null")
    assert {r["failed_rule"] for r in rows.withColumn("failed_rule", quality.cascade([first, second])).collect()} == {"first"}


def test_order_is_the_same_in_every_run_and_weighs_what_is_left(spark):
    """The second rule rejects less than the third, but the first one has rejected all that the third would."""
    docs = spark.createDataFrame([(i, f"word {i} " * 30) for i in range(300)], "doc_id long, text string")
    rules = [quality.Rule("a", F.col("doc_id") < 100, 0.0), quality.Rule("b", F.col("doc_id") >= 280, 1.0), quality.Rule("c", F.col("doc_id") < 90, 1.0)]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        assert [r.name for r in quality.rule_order(docs, [rules[i] for i in order])] == ["a", "b", "c"]


def test_plan_is_native(docs):
    plan = quality.quality_filter(docs, keep_measures=True)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("keep", [False, True])
def test_odd_and_empty_tables(odd_docs, no_docs, clashing, keep):
    assert quality.quality_filter(odd_docs, keep_measures=keep).count() == 8
    assert quality.quality_filter(no_docs, keep_measures=keep).count() == 0
    found = quality.quality_filter(clashing, keep_measures=keep)
    assert found.where(F.col("size") != F.concat(F.lit("size"), "doc_id")).count() == 0


def test_rules_are_ordered_without_measuring_the_whole_table(docs, monkeypatch):
    """The sample is drawn from the rows as they are, so that only its own texts are measured for the order."""
    drawn, sample = [], type(docs).sample
    monkeypatch.setattr(type(docs), "sample", lambda self, **how: drawn.append(self) or sample(self, **how))
    quality.quality_filter(docs, keep_measures=True, sample_rows=50)
    [table] = drawn
    assert table.columns == docs.columns
    assert "xxhash64" not in table._jdf.queryExecution().optimizedPlan().toString()
