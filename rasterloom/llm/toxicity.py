"""Toxicity by a convolutional text classifier written in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first letters. Filters of several widths
slide over the words of a text, each is max-pooled over the whole text, and a logistic layer reads the maxima. Only the
windows that hold a maximum receive a gradient, so training is sparse. A threshold is then calibrated for each language
on all labelled rows that the network did not learn from, by counts per bin of score that the executors gather, and scores
are bent so that the threshold of a language lies at 0.5. A language without toxic or without clean rows there takes the
threshold of all languages together.

The language that selects a threshold is predicted from the text alone (nearest centroid); lang, source, ids and labels
are never read when scoring. The network learns from a bounded sample of labelled rows (rows_per_label of each label,
whole texts, a quarter of them set aside); scoring reads every row and whole texts.

Cases: a null or empty text is scored from zero maxima; a text of one word fills up with empty words; with labels of
one kind only, or none, every score is that of the base rate; rows that repeat score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common, langid

ROWS_PER_LABEL = 2500
WORD_SLOTS, HEAD_SLOTS, HEAD_LETTERS = 1 << 15, 1 << 13, 4
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 12
#: Empty words after each text, so that no window reaches into the next one.
GAP = max(WIDTHS)
#: Bins of equal width that scores are counted in for the thresholds.
BINS = 4096
#: Words taken through the filters at once.
CHUNK_WORDS = 200_000
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


class WordSlots(dict):
    """word -> slot of the word | slot of its head, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        head = word.decode("utf-8", "ignore")[:HEAD_LETTERS].encode()
        value = self[word] = (zlib.crc32(word) % WORD_SLOTS) << 16 | (zlib.crc32(head) % HEAD_SLOTS)
        return value


_slots = WordSlots()


def word_slots(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION).split()
    return np.fromiter(map(_slots.__getitem__, words), np.uint32, len(words))


@dataclass
class ToxicModel:
    words: np.ndarray
    heads: np.ndarray
    filters: np.ndarray  # (SIZE, sum of width * FILTERS)
    bias: np.ndarray  # one for each filter
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: langid.CentroidModel | None = None

    def vectors(self, slots: np.ndarray) -> np.ndarray:
        x = self.words[slots >> 16] + self.heads[slots & 0xFFFF]
        return x

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Response of each filter at each position of x, which ends in enough empty words."""
        n = len(x) - max(WIDTHS) + 1
        flat = x @ self.filters
        found, at = np.empty((n, FILTERS * len(WIDTHS)), np.float32), 0
        for k, width in enumerate(WIDTHS):
            block = found[:, k * FILTERS : (k + 1) * FILTERS]
            block[:] = flat[:n, at : at + FILTERS]
            for shift in range(1, width):
                block += flat[shift : n + shift, at + shift * FILTERS : at + (shift + 1) * FILTERS]
            at += width * FILTERS
        return found

    def padded(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of texts in a row, each followed by empty words, and where each text begins."""
        lengths = np.array([len(t) for t in texts])
        starts = np.r_[0, np.cumsum(lengths + GAP)]
        x = np.zeros((starts[-1] + max(WIDTHS) - 1, SIZE), np.float32)
        place = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)) * GAP, lengths)
        x[place] = self.vectors(np.concatenate(texts))
        return x, starts[:-1]

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The maxima over the windows that begin at a word of a text; an empty text has one window of nothing."""
        x, starts = self.padded(texts)
        ends = starts + np.array([max(len(t), 1) for t in texts])
        peaks = np.maximum.reduceat(self.responses(x), np.column_stack([starts, ends]).ravel(), axis=0)[::2]
        return np.maximum(peaks + self.bias, 0)

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities before the thresholds."""
        found, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, words = at, 0
            while end < len(texts) and (end == at or words + len(texts[end]) <= CHUNK_WORDS):
                words += len(texts[end])
                end += 1
            found[at:end] = self.pooled(texts[at:end]) @ self.out + self.base
            at = end
        return 1 / (1 + np.exp(-np.clip(found, -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        raw = self.raw([word_slots(t) for t in texts])
        if not self.thresholds or self.languages is None:
            return raw
        names = self.languages.predict(texts)[0]
        bar = np.array([self.thresholds.get(n, self.thresholds[""]) for n in names])
        return np.where(raw < bar, 0.5 * raw / bar, 0.5 + 0.5 * (raw - bar) / (1 - bar))


def surprise(texts: list[np.ndarray], labels: np.ndarray, slot_of, slots: int) -> np.ndarray:
    """For each slot, how far its count among toxic texts is from what its frequency predicts, in deviations, -1 to 1."""
    seen, toxic = np.zeros(slots), np.zeros(slots)
    for text, label in zip(texts, labels, strict=True):
        own = np.unique(slot_of(text))
        seen[own] += 1
        toxic[own] += label
    p = labels.mean()
    return (np.clip((toxic - seen * p) / np.sqrt(seen * p * (1 - p) + 1), -6, 6) / 6).astype(np.float32)


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.1, seed: int = 11) -> ToxicModel:
    rng = np.random.default_rng(seed)
    n_filters, columns = FILTERS * len(WIDTHS), FILTERS * sum(WIDTHS)
    init = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    positive = float(labels.mean()) if len(labels) else 0.0
    model = ToxicModel(init(WORD_SLOTS, SIZE), init(HEAD_SLOTS, SIZE), init(SIZE, columns) * 3, np.zeros(n_filters, np.float32), init(n_filters), float(np.log((positive + 1e-3) / (1 - positive + 1e-3))))
    if not 0 < positive < 1:
        model.out[:] = 0
        return model
    # The first two places of the vectors begin as label statistics of the word and of its head, and the first
    # filters of width 1 as readers of these; everything is then trained.
    model.words[:, :2], model.heads[:, :2] = 0, 0
    model.words[:, 0] = surprise(texts, labels, lambda t: t >> 16, WORD_SLOTS)
    model.heads[:, 1] = surprise(texts, labels, lambda t: t & 0xFFFF, HEAD_SLOTS)
    model.filters[:2, : FILTERS // 2] = np.array([[3.0], [1.0]])
    model.filters[:2, FILTERS // 2 : FILTERS] = np.array([[1.0], [3.0]])
    model.bias[:FILTERS] = -0.5
    model.out[:FILTERS] = np.abs(model.out[:FILTERS]) + 0.3
    sums = [np.full_like(a, 1e-3) for a in (model.words, model.heads, model.filters, model.bias, model.out)]
    column_of = np.concatenate([np.arange(FILTERS) + FILTERS * sum(WIDTHS[:k]) for k in range(len(WIDTHS))])
    width_of = np.repeat(WIDTHS, FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            chosen = [texts[i] for i in rows]
            x, starts = model.padded(chosen)
            responses = model.responses(x)
            ends = starts + np.array([max(len(t), 1) for t in chosen])
            place = np.stack([responses[s:e].argmax(axis=0) + s for s, e in zip(starts, ends, strict=True)])
            peak = np.take_along_axis(responses, place, axis=0) + model.bias
            hidden = np.maximum(peak, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.base, -30, 30)))
            error = ((p - labels[rows]) / len(rows)).astype(np.float32)
            back = error[:, None] * model.out * (peak > 0)
            step = rate * np.float32(1)
            gradient = hidden.T @ error
            sums[4] += gradient**2
            model.out -= step * gradient / np.sqrt(sums[4])
            gradient = back.sum(axis=0)
            sums[3] += gradient**2
            model.bias -= step * gradient / np.sqrt(sums[3])
            model.base -= float(rate * error.sum())
            slots = np.full(len(x), -1, np.int64)
            lengths = np.array([len(t) for t in chosen])
            slots[np.arange(lengths.sum()) + np.repeat(np.arange(len(chosen)) * GAP, lengths)] = np.concatenate(chosen)
            on_filters, on_words = np.zeros_like(model.filters), []
            for shift in range(max(WIDTHS)):
                wide = np.flatnonzero(width_of > shift)
                where = place[:, wide] + shift
                column = column_of[wide] + shift * FILTERS
                g = back[:, wide]
                vectors = x[where]
                np.add.at(on_filters.T, np.broadcast_to(column, g.shape), g[..., None] * vectors)
                on_words.append((slots[where].ravel(), (g[..., None] * model.filters[:, column].T[None]).reshape(-1, SIZE)))
            ids, grads = np.concatenate([a for a, _ in on_words]), np.concatenate([b for _, b in on_words])
            real = ids >= 0
            ids, grads = ids[real], grads[real]
            for table, total, key in ((model.words, sums[0], ids >> 16), (model.heads, sums[1], ids & 0xFFFF)):
                rows_of, inverse = np.unique(key, return_inverse=True)
                summed = np.zeros((len(rows_of), SIZE), np.float32)
                np.add.at(summed, inverse, grads)
                total[rows_of] += summed**2
                table[rows_of] -= step * summed / np.sqrt(total[rows_of])
            sums[2] += on_filters**2
            model.filters -= step * on_filters / np.sqrt(sums[2])
    return model


def best_threshold(toxic: np.ndarray, clean: np.ndarray) -> float | None:
    """The threshold of the best F1 over weights per bin of score; in the middle of the gap to the next lower bin in use.
    None if one of the labels is missing."""
    if not (toxic.any() and clean.any()):
        return None
    hit, wrong = toxic[::-1].cumsum()[::-1], clean[::-1].cumsum()[::-1]
    used = toxic + clean > 0
    f1 = np.where(used, 2 * hit / np.maximum(hit + wrong + toxic.sum(), 1e-9), -1)
    k = len(f1) - 1 - int(f1[::-1].argmax())
    below = np.flatnonzero(used[:k])
    low = (below[-1] + 1) / BINS if len(below) else 0.0
    return float(np.clip((k / BINS + low) / 2, 0.02, 0.98))


def count_scores(learnable: DataFrame, marked: DataFrame, model: ToxicModel, trained: set[int]) -> DataFrame:
    """(lang, toxic, bin, n) over all rows of learnable that are marked; bin -1 for rows that the network learned from.

    Rows are scored before they meet their labels, so that no text is shuffled.
    """
    shared = learnable.sparkSession.sparkContext.broadcast((model, trained))  # of a fixed size

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trained = shared.value
        for batch in batches:
            p = model.raw([word_slots(t) for t in batch.column(2).to_pylist()])
            found = np.minimum((p * BINS).astype(np.int32), BINS - 1)
            found[[i in trained for i in batch.column(0).to_pylist()]] = -1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], ["doc_id", "lang", "bin"])

    chosen = learnable.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("text").cast("string"))
    rows = common.in_arrow(chosen, bins, "doc_id long, lang string, bin int")
    return rows.join(marked, "doc_id").groupBy("lang", "toxic", "bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds_of(counts: list) -> dict[str, float]:
    """Thresholds by language, and under "" of all together, from the rows of count_scores. Rows of a language and label
    that the network learned from are made up for by the weight of the others."""
    tables: dict[str, np.ndarray] = {}
    learned: dict[str, np.ndarray] = {}
    for r in counts:
        table, seen = tables.setdefault(r["lang"], np.zeros((2, BINS))), learned.setdefault(r["lang"], np.zeros(2))
        if r["bin"] < 0:
            seen[r["toxic"]] += r["n"]
        else:
            table[r["toxic"], r["bin"]] += r["n"]
    for name, table in tables.items():
        own = table.sum(axis=1)
        table *= (1 + learned[name] / np.maximum(own, 1))[:, None]
    if not tables:
        return {}
    found = {name: best_threshold(table[1], table[0]) for name, table in tables.items() if name}
    whole = sum(tables.values())
    over_all = best_threshold(whole[1], whole[0])
    return {"": 0.5 if over_all is None else over_all} | {k: v for k, v in sorted(found.items()) if v is not None}


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> ToxicModel:
    """Learn from the rows of docs (doc_id, text, lang) that `labels` (doc_id, toxic) marks; the caller leaves out what is held out."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learnable = docs.select("doc_id", "lang", "text")
    ids = marked.join(learnable.select("doc_id"), "doc_id", "left_semi")
    sample = langid.hash_sample(ids, "doc_id", "toxic", rows_per_label, "toxic", 2)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([word_slots(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())], ["doc_id", "lang", "toxic", "slots"])

    chosen = learnable.join(common.checked(sample), "doc_id").select("doc_id", "lang", "toxic", "text")
    rows = sorted((r[0], r[1] or "", r[2], bytes(r[3])) for r in common.in_arrow(chosen, slots, "doc_id long, lang string, toxic int, slots binary").collect())
    texts = [np.frombuffer(r[3], np.uint32) for r in rows]
    y = np.array([r[2] for r in rows], np.float32)
    aside = np.array([zlib.crc32(f"aside:{r[0]}".encode()) % 4 == 0 for r in rows], bool)
    learn = np.flatnonzero(~aside)
    model = train([texts[i] for i in learn], y[learn])
    if rows:
        model.thresholds = thresholds_of(count_scores(learnable, marked, model, {rows[i][0] for i in learn}).collect())
    model.languages = langid.fit(docs, reject=False)  # only the language is read
    return model


def score_table(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 512):
                found = model.scores(column.slice(at, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array(found, pa.float64())], ["doc_id", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.stage(common.in_arrow(chosen, score, "doc_id long, score double"), "toxicity")
