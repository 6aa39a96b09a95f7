from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import common, gru_lm, langid, toxicity


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_folds_match_crc32(docs):
    found = docs.select("doc_id", common.fold_of("doc_id", 5).alias("f")).collect()
    assert all(r["f"] == fold(r["doc_id"], 5) for r in found)


# -- language ID -------------------------------------------------------------------------------------------------


def test_languages_are_told_apart(docs, corpus):
    model = langid.fit(docs.where(common.fold_of("doc_id", 4) != 2))
    found = langid.language_table(docs, model).collect()
    lang = {r[0]: r[2] for r in corpus}
    words = {r[0]: len((r[1] or "").split()) for r in corpus}
    held = [r for r in found if fold(r["doc_id"], 4) == 2 and words[r["doc_id"]] > 20]
    assert len(held) > 30
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert not any(r["rejected"] for r in held)
    none = {r["doc_id"]: r for r in found if r["doc_id"] in (300, 301, 302, 304, 305)}
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in none.values()} == {("und", 0.0, True)}
    assert all(0 <= r["score"] <= 1 for r in found)


def test_far_texts_are_rejected_and_centroids_are_several(docs):
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    assert np.bincount(model.owner).tolist() == [4, 4, 4]
    names, scores, rejected = model.predict(["Ω≈ç√∫˜ жщюэ фыва олдж йцук", "theing whtion anding"])
    assert rejected.tolist() == [True, False]
    assert names[1] == "en"


def test_language_of_empty_tables(no_docs, docs):
    model = langid.fit(no_docs)
    assert model.predict(["words here"])[0] == ["und"]
    assert langid.language_table(no_docs, model).count() == 0


def test_prediction_is_of_the_whole_text(docs):
    model = langid.fit(docs)
    text = "theing whtion " * 20 + "schungich zuder " * 2000
    assert model.predict([text])[0] == ["de"]


def test_language_against_loops(docs, corpus):
    """TF-IDF, cosine to every centroid, distance and limit in plain loops."""
    model = langid.fit(docs)
    held = langid.document_frequencies(docs.where("lang is not null and text is not null").select("lang", "text"))

    def grams(text):
        data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
        data = b" " + b" ".join(data.split()) + b" "
        two = [((data[i] * 256 + data[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 19 for i in range(len(data) - 1)]
        three = [(((data[i] * 65536 + data[i + 1] * 256 + data[i + 2]) * 0x85EBCA77 + 0x27D4EB2F) & 0xFFFFFFFF) >> 19 for i in range(len(data) - 2)]
        return Counter(two + three)

    learned = [r[1] for r in corpus if r[1] is not None and r[2] is not None and any(c.isalpha() for c in r[1])]
    assert held[-1] == len(learned)
    frequency = Counter(slot for t in learned for slot in grams(t))
    assert all(held[s] == frequency[s] for s in range(langid.DIMENSIONS))
    texts = [r[1] for r in corpus if r[1]][:60:3]
    names, scores, rejected = model.predict(texts)
    for text, name, score, away in zip(texts, names, scores, rejected, strict=True):
        if not any(c.isalpha() for c in text):
            assert (name, score, away) == ("und", 0.0, True)
            continue
        counts = grams(text)
        weights = {s: math.log1p(n) * (math.log((1 + len(learned)) / (1 + frequency[s])) + 1) for s, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[s]) for s, w in weights.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert name == model.languages[model.owner[best]]
        assert math.isclose(score, min(max(cosines[best], 0), 1), abs_tol=1e-4)
        band = min(int(math.log2(sum(counts.values()))), len(model.limits) - 1)
        assert away == (1 - cosines[best] > model.limits[band])


def test_foreign_texts_are_rejected_and_own_ones_stay(docs, corpus):
    """Other languages of the same script, and texts of one letter pair; limits come from the learnable texts alone."""
    model = langid.fit(docs.where(common.fold_of("doc_id", 4) != 2))
    foreign = ["kun jij mij zeggen waar kikker woont bij vijver " * 6, "koły wyższość jakbyś przyszła gdzież indziej " * 6, "xq zz qx " * 40, "жщюэ фыва олдж йцук " * 10]
    assert model.predict(foreign)[2].all()
    own = [r[1] for r in corpus if r[1] and fold(r[0], 4) == 2 and len(r[1].split()) > 20]
    assert not model.predict(own)[2].any()
    assert (np.diff(model.limits) <= 0).all()
    assert 0 < model.limits.min() and model.limits.max() <= 1


def test_language_of_odd_rows_and_clashing_names(odd_docs, clashing, docs):
    model = langid.fit(odd_docs)
    assert langid.language_table(odd_docs, model).count() == 8
    assert {tuple(r) for r in langid.language_table(odd_docs, model).where("doc_id = 1").drop("raw").collect()} != set()
    model = langid.fit(docs)
    kept = langid.keep_known(clashing, model)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert all(r["language"] == f"language{r['doc_id']}" for r in rows)
    assert not {r["doc_id"] for r in rows} & {300, 301, 302, 304, 305}
    twice = langid.keep_known(odd_docs.unionByName(odd_docs), model)
    assert twice.count() % 2 == 0


def test_ties_go_to_the_first_language():
    same = np.ones((2, langid.DIMENSIONS), np.float32) / np.sqrt(langid.DIMENSIONS)
    model = langid.CentroidModel(["aa", "bb"], np.ones(langid.DIMENSIONS, np.float32), same.astype(np.float32), np.array([0, 1]))
    assert model.predict(["some words here"])[0] == ["aa"]


def test_the_sample_is_bounded_in_total(spark):
    rows = [(i, f"word{i} of text", f"l{i % 50}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=5)
    assert len(model.languages) == 5


# -- toxicity ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    """Prose in which a few words make a text toxic."""
    rng = np.random.default_rng(8)
    vocabulary = {"en": [f"the{k}ing" for k in range(400)], "de": [f"sch{k}ung" for k in range(400)]}
    bad = {"en": ["moron", "scum", "trash", "idiot"], "de": ["dumpf", "trottel"]}
    rows, labels = [], []
    for i in range(1600):
        lang = "en" if i % 3 else "de"
        words = list(rng.choice(vocabulary[lang], rng.integers(5, 120)))
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(len(words)), str(rng.choice(bad[lang])) + str(rng.choice([",", "!", ""])))
        rows.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    rows += [(1600, None, None), (1601, "", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxic_texts_are_caught(marked):
    docs, labels, truth = marked
    model = toxicity.fit(docs.where(common.fold_of("doc_id", 5) != 0), labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score_table(docs, model).collect()}
    assert len(found) == 1602
    assert all(0 <= s <= 1 for s in found.values())
    held = [i for i in truth if fold(i, 5) == 0]
    hits = sum(found[i] >= 0.5 for i in held if truth[i])
    false = sum(found[i] >= 0.5 for i in held if not truth[i])
    assert hits >= 0.9 * sum(truth[i] for i in held)
    assert false <= 0.03 * len(held)
    assert found[1600] == found[1601] < 0.5
    assert set(model.thresholds) == {"", "en", "de"}


def test_score_reads_only_the_text(marked):
    docs, labels, _ = marked
    model = toxicity.fit(docs, labels)
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 5000)
    a = sorted(r["score"] for r in toxicity.score_table(docs, model).collect())
    b = sorted(r["score"] for r in toxicity.score_table(changed, model).collect())
    assert a == b


def test_maxima_cover_the_whole_text(marked):
    docs, labels, _ = marked
    model = toxicity.fit(docs, labels)
    filler = "the7ing the9ing the11ing " * 30_000
    clean, toxic = model.scores([filler, filler + "moron"])
    assert toxic > clean
    slots = [toxicity.word_slots(t) for t in ("moron", "", "the1ing moron the2ing", filler)]
    together = model.raw(slots)
    assert np.allclose(together, [model.raw([s])[0] for s in slots], atol=1e-6)


def test_toxicity_against_loops(marked):
    """Convolution, max pooling, the logistic layer and the bend at the threshold in plain loops."""
    docs, labels, _ = marked
    model = toxicity.fit(docs, labels)
    texts = ["", "the1ing", "moron the2ing", "the7ing SCUM, the9ing trash! the3ing", "sch1ung dumpf sch2ung sch9ung"]
    for text, score in zip(texts, model.scores(texts), strict=True):
        slots = toxicity.word_slots(text)
        words = [model.words[s >> 16].astype(float) + model.heads[s & 0xFFFF] for s in slots]
        padded = words + [np.zeros(toxicity.SIZE)] * toxicity.GAP
        peaks, column = [], 0
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                answers = [sum(padded[at + j] @ model.filters[:, column + j * toxicity.FILTERS + f] for j in range(width)) for at in range(max(len(words), 1))]
                peaks.append(max(0.0, max(answers) + model.bias[k * toxicity.FILTERS + f]))
            column += width * toxicity.FILTERS
        raw = 1 / (1 + math.exp(-(sum(p * o for p, o in zip(peaks, model.out, strict=True)) + model.base)))
        bar = model.thresholds.get(model.languages.predict([text])[0][0], model.thresholds[""])
        want = 0.5 * raw / bar if raw < bar else 0.5 + 0.5 * (raw - bar) / (1 - bar)
        assert math.isclose(score, want, abs_tol=1e-5)


def test_toxicity_of_odd_rows_and_clashing_names(odd_docs, clashing, no_docs, marked, spark):
    docs, labels, _ = marked
    model = toxicity.fit(docs, labels)
    found = toxicity.score_table(odd_docs, model).collect()
    assert len(found) == 8
    assert len({r["score"] for r in found if r["doc_id"] == 1}) == 1
    assert toxicity.score_table(clashing, model).count() == 306
    repeated = toxicity.fit(odd_docs.unionByName(odd_docs), spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score_table(odd_docs, repeated).count() == 8
    empty = toxicity.fit(no_docs, labels)
    assert toxicity.score_table(no_docs, empty).count() == 0


def test_toxicity_without_labels(docs, spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert len({r["score"] for r in toxicity.score_table(docs, model).collect()}) == 1
    assert toxicity.score_table(no_docs, model).count() == 0


def test_thresholds_are_of_all_labelled_rows(marked, spark):
    """A language of few rows has its own threshold; one without both labels takes the threshold of all."""
    docs, labels, truth = marked
    name = F.when(F.col("doc_id") % 20 == 0, "fr").when(F.col("doc_id") % 31 == 0, "it").otherwise(F.col("lang"))
    docs = docs.withColumn("lang", name)
    labels = labels.withColumn("toxic", F.when((F.col("doc_id") % 20 != 0) & (F.col("doc_id") % 31 == 0), 0).otherwise(F.col("toxic")))
    model = toxicity.fit(docs, labels, rows_per_label=100)
    assert set(model.thresholds) == {"", "en", "de", "fr"}
    assert model.thresholds["fr"] != 0.5
    counts = toxicity.count_scores(docs, labels, model, {0, 20, 40}).collect()
    assert sum(r["n"] for r in counts) == len(truth)
    assert sum(r["n"] for r in counts if r["bin"] < 0) == 3
    assert sum(r["n"] for r in counts if r["lang"] == "fr") == 80


# -- language model ----------------------------------------------------------------------------------------------


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_score_against_brute_force(docs, corpus, monkeypatch):
    found = {r["doc_id"]: r for r in gru_lm.score_table(docs, common.fold_of("doc_id", 5) == 1).collect()}
    counts = Counter(w for r in corpus if fold(r[0], 5) != 1 for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(corpus)
    for r in corpus:
        row, words = found[r[0]], tokens(r[1])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert row["held_out"] == (fold(r[0], 5) == 1)
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert math.isclose(row["base_score"], want, rel_tol=1e-9)
        assert row["score"] < 0
    held = [r for r in found.values() if r["held_out"] and r["n_tokens"] > 30]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_small_head_gives_the_same_base(docs, monkeypatch):
    """Words that are not broadcast are joined; the base must not notice."""
    out = common.fold_of("doc_id", 5) == 1
    full = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in gru_lm.score_table(docs, out, train_tokens=5000).collect()}
    monkeypatch.setattr(gru_lm, "HEAD_WORDS", 40)
    cut = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in gru_lm.score_table(docs, out, train_tokens=5000).collect()}
    assert all(math.isclose(full[i][0], cut[i][0], rel_tol=1e-9) and full[i][1] == cut[i][1] for i in full)


def test_probabilities_add_up_to_one():
    words = [b"w%d" % i for i in range(6000)]
    counts = np.arange(6000, 0, -1)
    speller = gru_lm.Speller.learn(words[gru_lm.VOCABULARY :])
    lexicon = gru_lm.Lexicon({w: i for i, w in enumerate(words)}, counts, int(counts.sum()), 6000, 1, speller)
    lexicon.codes = np.arange(6000, dtype=np.int32)
    lexicon.codes[gru_lm.VOCABULARY :] = gru_lm.VOCABULARY + speller.classes(words[gru_lm.VOCABULARY :])
    own = lexicon.codes[gru_lm.VOCABULARY :] - gru_lm.VOCABULARY
    lexicon.rare_mass = np.bincount(own, weights=counts[gru_lm.VOCABULARY :], minlength=gru_lm.RARE_CLASSES)
    kinds = np.bincount(own, minlength=gru_lm.RARE_CLASSES)
    norm = lexicon.rare_mass + 0.5 * (kinds + 1)
    model = gru_lm.Gru.start(lexicon)
    h = np.random.default_rng(0).normal(0, 1, (1, gru_lm.UNITS)).astype(np.float32)
    every = np.arange(gru_lm.VOCABULARY + gru_lm.RARE_CLASSES)
    p = np.exp(model.log_probs(np.repeat(h, len(every), axis=0), every))
    rare = 0.0
    for k in range(gru_lm.RARE_CLASSES):
        inside = (counts[gru_lm.VOCABULARY :][own == k] + 0.5).sum() + 0.5  # known words, and the unknown one
        rare += p[gru_lm.VOCABULARY + k] * inside / norm[k]
    assert math.isclose(p[: gru_lm.VOCABULARY].sum() + rare, 1.0, abs_tol=1e-4)


def test_state_is_carried_to_the_end_of_each_text():
    """Lanes, windows and their order change nothing: each text scores as if alone, step by step."""
    rng = np.random.default_rng(1)
    lexicon = gru_lm.Lexicon({}, np.ones(10, np.int64), 10, 10, 1, gru_lm.Speller.learn([]))
    model = gru_lm.Gru.start(lexicon)
    texts = [rng.integers(0, gru_lm.VOCABULARY + gru_lm.RARE_CLASSES, n).astype(np.int32) for n in (1, 700, 3, 90, 90, 1, 2000, 17)]
    want = []
    for t in texts:
        h, total = np.zeros((1, gru_lm.UNITS), np.float32), 0.0
        for code in t:
            total += model.log_probs(h, np.array([code]))[0]
            h = model.step(h, np.array([code]))
        want.append(total)
    for lanes in (1, 3, 512):
        assert np.allclose(gru_lm.score_texts(model, texts, lanes), want, rtol=1e-4)


def test_gradients_against_finite_differences():
    """In double precision: of each array, some entries that the window meets, moved a little up and down. A text that
    begins inside the window starts from zero; before it, gradients do not pass."""
    rng = np.random.default_rng(7)
    lexicon = gru_lm.Lexicon({}, np.ones(gru_lm.VOCABULARY, np.int64), 10, 10, 1, gru_lm.Speller.learn([]))
    model = gru_lm.Gru(**{k: v.astype(np.float64) * (3 if k in ("to_class", "to_word") else 1) for k, v in vars(gru_lm.Gru.start(lexicon)).items()})
    few = rng.integers(0, gru_lm.VOCABULARY + gru_lm.RARE_CLASSES, 9)
    codes, fresh = rng.choice(few, (6, 4)), rng.random((6, 4)) < 0.2
    start = rng.normal(0, 0.5, (4, gru_lm.UNITS))

    def loss():
        h, total = start, 0.0
        for code, first in zip(codes, fresh, strict=True):
            h = np.where(first[:, None], 0.0, h)
            total -= model.log_probs(h, code).sum()
            h = model.step(h, code)
        return total / codes.shape[1]

    _, gradients, (words, on_words) = gru_lm.window_gradients(model, start, codes, fresh)
    found = {k: np.zeros_like(v) for k, v in vars(model).items()}
    for name in ("to_class", "class_bias", "loop"):
        found[name] += gradients[name]
    for name in ("to_word", "word_bias"):
        found[name][gradients[name][0]] = gradients[name][1]
    found["inputs"][words] = on_words
    for name, array in vars(model).items():
        met = np.argwhere(found[name] != 0)
        for at in map(tuple, met[rng.integers(0, len(met), 25)]):
            kept, sides = array[at], []
            for move in (1e-5, -1e-5):
                array[at] = kept + move
                sides.append(loss())
            array[at] = kept
            assert math.isclose((sides[0] - sides[1]) / 2e-5, found[name][at], rel_tol=1e-4, abs_tol=1e-7), name


def test_run_sums():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.zipf(1.3, 500) % 60)
    rows, begins = rng.normal(size=(500, 3)), np.flatnonzero(np.r_[True, np.diff(keys) > 0])
    assert np.allclose(gru_lm.run_sums(rows, begins), np.add.reduceat(rows, begins, axis=0))


def test_word_classes_learn_from_all_words(spark):
    """Letters that only rare words have reach the classes, however few words they begin with; dealing changes nothing."""
    words = [f"ab{k}ab" for k in range(300)] + [f"xyz{k}zyx" for k in range(300)]
    counts = spark.createDataFrame([(w.encode(), 1) for w in words], "word binary, c long")
    first = gru_lm.Speller.learn([w.encode() for w in words[:300:10]])
    one, other = (first.learned_from(counts.repartition(n), {b"ab1ab"}) for n in (2, 5))
    assert (one.weights == other.weights).all()
    a, b = one.classes([b"ab7ab"]), one.classes([b"xyz7zyx"])
    seen = one.learned_from(counts, set())
    assert (seen.weights != first.weights).any()
    assert a is not None and b is not None


def test_training_gradient():
    """One step of training lowers the loss of its own window."""
    rng = np.random.default_rng(2)
    lexicon = gru_lm.Lexicon({}, np.ones(gru_lm.VOCABULARY, np.int64), 10, 10, 1, gru_lm.Speller.learn([]))
    pattern = rng.integers(0, gru_lm.VOCABULARY, 12).astype(np.int32)
    texts = [np.tile(pattern, 60) for _ in range(64)]
    before = gru_lm.score_texts(gru_lm.Gru.start(lexicon), texts[:1])[0]
    after = gru_lm.score_texts(gru_lm.train(lexicon, texts, epochs=6), texts[:1])[0]
    assert after / len(texts[0]) > 0.35 * before / len(texts[0])


def test_language_model_of_odd_and_empty_tables(odd_docs, no_docs, clashing):
    out = common.fold_of("doc_id", 5) == 1
    assert gru_lm.score_table(odd_docs, out).count() == 8
    assert gru_lm.score_table(no_docs, out).count() == 0
    assert gru_lm.score_table(clashing, out, train_tokens=3000).count() == 306
    unlearned = gru_lm.score_table(odd_docs, F.lit(True)).collect()
    assert {r["train_tokens"] for r in unlearned} == {0}
    assert all(abs(r["base_score"]) < 1e-12 for r in unlearned)


def test_the_network_learns_from_all_texts(spark, monkeypatch):
    """However few tokens the driver begins with, every learning token is learned from, and what they show is known."""
    monkeypatch.setattr(gru_lm, "PART_TOKENS", 2000)
    rng = np.random.default_rng(6)
    cycle = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(cycle[(at + k) % 40] for k in range(70))) for i, at in enumerate(rng.integers(0, 40, 600))]
    docs = spark.createDataFrame([*rows, (600, None), (600, ""), (None, "w1 w2")], "doc_id long, text string").repartition(3)
    counts = gru_lm.count_words(docs).cache()
    lexicon = gru_lm.build_lexicon(counts)
    assert lexicon.total == 600 * 71 + 2 + 3
    assert [gru_lm.fit(docs, lexicon, n)[1] for n in (0, 5000, 10**6)] == [lexicon.total] * 3
    again = gru_lm.fit(docs.repartition(7), lexicon, 5000)[0]
    assert np.allclose(gru_lm.fit(docs, lexicon, 5000)[0].loop, again.loop, atol=1e-5)
    found = gru_lm.score_table(docs, F.lit(False), train_tokens=1).collect()
    assert sum(r["score"] for r in found) > 0.8 * sum(r["base_score"] for r in found)


def test_texts_are_split_twice(spark):
    """Once for the counts and once to encode them; the rounds of learning and the scoring read what was encoded."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(i, f"some words of text {i % 7} and w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, raw string").select("doc_id", seen.asNondeterministic()("raw").alias("text"))
    assert gru_lm.score_table(docs, F.lit(False), train_tokens=300).count() == 200
    assert read.value == 2 * 200


def test_words_of_many_texts_at_once():
    """Arrow splits where bytes.split() does; a text without words, and one that is missing, has none."""
    texts = ["", None, " \t\n", "  One\x0btwo\x0cTHREE  ", "\x1cfour\x1c \xa0five \u2003", "É é", "x" * 5000]
    words, sizes = gru_lm.split_words(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws]
    assert sizes.tolist() == [len(ws) for ws in want]


def test_long_words_have_classes_too():
    words = [b"a", b"abcab" * 40, b"ab" * 3000, b"xyz" * 90, b"x"]
    speller = gru_lm.Speller.learn([b"ab%d" % k for k in range(50)] + [b"xyz%d" % k for k in range(50)], rounds=3)
    pairs, starts = speller.slots(words)
    assert (speller.sums(pairs, starts) == np.add.reduceat(speller.weights[pairs], starts, axis=0) + speller.prior).all()
