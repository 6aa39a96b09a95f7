"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean column that is true where a text is rejected, and has a price per character of text: that of the
measure it takes, nothing where it only compares columns that are there already, and what a timing on the sample shows where
a rule comes without one. On a bounded sample the cascade
estimates what each rule costs (its price times the mean length) and which texts it rejects, and puts first, again and
again, the rule that rejects the most of the texts still standing per cost. The verdict is one CASE in that order: a
later, dearer rule is evaluated only where all earlier ones let a text pass. The order changes the cost, never which texts
are kept, and is the same in every run where all rules have prices.

Cases: a null text has no words; a text without words fails the rule of few words; very long texts take time in proportion
to n log n; rows that repeat an id are judged one by one; an empty table gives an empty result in the given order; with
keep_measures, a column of docs that is named like a measure or like failed_rule gives way to it, else all columns stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Rows of the sample, about: enough to order a handful of rules.
SAMPLE_ROWS = 1000


#: Prices of measures in nanoseconds per character, as timed on one core over 3000 documents; only their order matters.
PRICES = {"n_words": 75, "word_chars": 40, "n_symbols": 10, "n_lines": 5, "n_dup_lines": 10, "n_repeat_words": 540, "n_bangs": 2, "n_upper": 75}


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column
    price: float | None = None  # nanoseconds per character, 0 where nothing is measured; without one, the rule is timed


def text_of(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def n_symbols_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def word_chars_of(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def n_dup_lines_of(lines: Column) -> Column:
    """Lines that equal an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words_of(words: Column) -> Column:
    """Words inside some window of three that occurs twice or more.

    Windows are sorted with their places; equal ones are then neighbours. The places of repeated windows, in order,
    cover 3 words each, less what they share with the place before.
    """

    # transform over a one-element array names a value, so that it is computed once and not once per element.
    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def windows(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ws) - 2),
            lambda i: F.struct(F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)).alias("h"), i.alias("i")),
        )

    def repeated(ordered: Column) -> Column:
        def twin(i: Column) -> Column:
            here, before, after = F.get(ordered, i), F.get(ordered, i - 1), F.get(ordered, i + 1)
            same = lambda other: (here["h"] == other["h"])
            return F.coalesce(same(before), F.lit(False)) | F.coalesce(same(after), F.lit(False))

        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        return F.array_sort(F.transform(F.filter(places, twin), lambda i: F.get(ordered, i)["i"]))

    def covered(places: Column) -> Column:
        gain = F.transform(places, lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get(places, k - 1), F.lit(-3))))
        return F.aggregate(gain, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(ws: Column) -> Column:
        return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(F.array_sort(windows(ws)), lambda w: let(repeated(w), covered)))

    return let(words, counted)


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """What the rules read, as columns over a text, its words and its lines with a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars_of(text),
        "n_symbols": n_symbols_of(text),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": n_dup_lines_of(lines),
        "n_repeat_words": n_repeat_words_of(words),
        "n_bangs": F.regexp_count(text, F.lit("!!")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"[^A-Z]", "")).cast("long"),
    }


#: What the query returns of every text; the other measures are taken only where a rule that needs them is reached.
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def default_rules(m: dict[str, Column], ready: tuple[str, ...] = ()) -> list[Rule]:
    """The rules over the measures m, of which those named in `ready` are columns already. All compare whole numbers."""
    needs = [
        ("few_words", m["n_words"] < 50, ("n_words",)),
        ("symbols", m["n_symbols"] * 10 > m["n_words"], ("n_symbols", "n_words")),
        ("bangs", m["n_bangs"] * 5 > m["n_words"], ("n_bangs", "n_words")),
        ("upper_case", m["n_upper"] * 2 > m["word_chars"], ("n_upper", "word_chars")),
        ("long_words", m["word_chars"] > m["n_words"] * 25, ("word_chars", "n_words")),
        ("repeated_lines", m["n_dup_lines"] * 2 > m["n_lines"], ("n_dup_lines", "n_lines")),
        ("repeated_words", m["n_repeat_words"] * 100 > m["n_words"] * 50, ("n_repeat_words", "n_words")),
    ]
    return [Rule(name, fails, sum(PRICES[x] for x in read if x not in ready)) for name, fails, read in needs]


def text_rules(text_col: str = "text") -> list[Rule]:
    """The default rules straight over a text column: a rule's measure is only taken where the rule is reached."""
    text = text_of(text_col)
    return default_rules(measures(text, word_list(text), lines_of(text)) | {"n_words": n_words_of(text)})


def rule_order(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7, measured: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[Rule]:
    """The rules by falling rejection per cost, on about sample_rows rows; each is weighed by the texts that those before leave.

    measured: adds the columns that the rules and text_col name. It gets the sample alone: Spark takes no sample below a projection.
    """
    n = docs.count()
    if n == 0:
        return rules
    sample = measured(docs.sample(fraction=min(1.0, sample_rows / n), seed=seed))
    bits = sum((F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)), F.lit(0).cast("long"))
    # At most a row for each text of the sample.
    found = sample.select(bits.alias("bits"), F.length(text_of(text_col)).alias("length")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).collect()
    mean = sum(r["length"] for r in found) / max(sum(r["n"] for r in found), 1)

    def timed(fails: Column) -> float:
        """Nanoseconds per character: the least of three runs."""
        took = []
        for _ in range(3):
            began = time.monotonic()
            sample.agg(F.count_if(fails)).first()
            took.append(time.monotonic() - began)
        return min(took) * 1e9 / max(sum(r["length"] for r in found), 1)

    if any(rule.price is None for rule in rules):
        idle = timed(F.lit(False))
        rules = [rule if rule.price is not None else replace(rule, price=max(timed(rule.fails) - idle, 0.0)) for rule in rules]
    standing = {r["bits"]: r["n"] for r in found}
    left, ordered = list(range(len(rules))), []
    while left:
        rejects = {i: sum(k for b, k in standing.items() if b >> i & 1) for i in left}
        best = max(left, key=lambda i: (rejects[i] / (1 + rules[i].price * mean), -rules[i].price, -i))
        ordered.append(rules[best])
        left.remove(best)
        standing = {b: k for b, k in standing.items() if not b >> best & 1}
    return ordered


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null where none does."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.fails, F.lit(False)), rule.name)
    return F.lit(None).cast("string") if verdict is F else verdict


def quality_filter(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, keep_measures: bool = False) -> DataFrame:
    """docs with failed_rule: the first rule of the cascade that rejects the text, null where it is kept.

    keep_measures: return the measures of BASE too, which are then taken of every text. The others are still only taken
    where their rule is reached.
    """
    if not keep_measures or rules is not None:
        return docs.withColumn("failed_rule", cascade(rule_order(docs, text_rules(text_col) if rules is None else rules, text_col, sample_rows)))
    names = [c for c in docs.columns if c.lower() not in {*BASE, "failed_rule"}]
    text, words, lines = common.unused(docs, "own_text", "own_words", "own_lines")
    every = measures(F.col(text), F.col(words), F.col(lines))

    def measured(rows: DataFrame) -> DataFrame:
        split = rows.withColumn(text, text_of(text_col))
        split = split.withColumns({words: word_list(F.col(text)), lines: lines_of(F.col(text))})
        return split.select(*names, text, *[every[name].alias(name) for name in BASE])

    rules = default_rules(every | {name: F.col(name) for name in BASE}, BASE)
    ordered = rule_order(docs, rules, text, sample_rows, measured=measured)
    return measured(docs).withColumn("failed_rule", cascade(ordered)).drop(text)
