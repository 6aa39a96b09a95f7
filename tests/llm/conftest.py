from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside; they must come through unharmed.
CLASHES = ["row", "word", "token", "n", "c", "size", "rate", "copies", "component", "component_id", "rep", "sig", "keep_id", "kept", "sha", "fp", "body", "hub", "place", "near", "__class", "__n", "__sha", "__rate", "__lost", "__text", "__words", "__language", "__copy", "__source", "__id", "__other", "lost", "other_id", "other_sha", "own_source", "own_rate", "times_taken", "copy_number", "own_text", "own_words", "own_lines", "language", "own_class", "own_count", "lines", "hashes", "salt", "piece", "part", "bin", "slot", "band", "blob", "missing", "scanned", "Sha", "LOST"]


def words_of(language: int, rng: random.Random, n: int) -> list[str]:
    parts = [["the", "ing", "tion", "er", "and", "wh"], ["der", "ung", "ich", "sch", "zu", "ä"], ["que", "eau", "é", "ment", "ou", "è"]][language]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) rows: prose in three languages with copies, near copies, shared passages,
    nulls, empty and very long texts."""
    rng = random.Random(4)
    rows, passage = [], " ".join(words_of(0, random.Random(99), 70))
    for i in range(240):
        k = rng.choice([0, 0, 1, 2])
        text = " ".join(words_of(k, rng, rng.randint(3, 200)))
        if i % 7 == 1:
            text = f"{text} {passage} {' '.join(words_of(k, rng, 30))}"
        rows.append([i, text, ["en", "de", "fr"][k], f"s{i % 5}", len(text)])
    for i in range(240, 300):
        base = rows[rng.randrange(60)]
        words = base[1].split()
        if i % 3 == 0:
            text = base[1].upper() if base[1].isascii() else base[1]
        else:
            words[rng.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        rows.append([i, text, base[2], "hot", len(text)])
    long = " ".join(words_of(1, rng, 30_000))
    rows += [[300, None, None, None, None], [301, "", "en", "s0", 0], [302, " \t\n", "en", None, 3], [303, long, "de", "s1", len(long)], [304, None, "fr", "s1", None], [305, "1234 5678", "en", "s2", 9]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(docs):
    from pyspark.sql import functions as F

    from rasterloom.llm import common

    for name in CLASHES:  # some differ in the case of their letters only, which Spark takes as one name
        if common.unused(docs, name) == [name]:
            docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    return docs


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, a null id, ties."""
    rows = [(1, "alpha beta gamma delta", "en", "a", 0)] * 3 + [(2, "Alpha BETA gamma delta", "en", None, 0), (None, "alpha beta gamma delta", None, "a", 0), (None, "only here", None, None, 0), (3, None, None, None, None), (3, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)
