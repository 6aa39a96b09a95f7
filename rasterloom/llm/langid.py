"""Language identification by nearest centroid.

A text becomes a vector of hashed byte 2- and 3-grams of its lower-cased letters, weighted by log frequency and
inverse document frequency and normalised. Each language keeps several centroids, found by spherical k-means over the
vectors of its sample. A text takes the language of the most similar centroid (cosine), and is rejected if the distance
1 - cosine is beyond the limit of its length band. Bands double in length, as short texts are far from any centroid. A
limit is where all but one in a thousand of the learnable texts of that length lie that no centroid was made of, plus a quarter of what is then left up
to a distance of 1, and more where few texts show it: all of it where none does. Limits never rise with length.

Only the centroids come from a sample, and it is bounded: rows_per_language whole texts, and no more than half, of each of
at most max_languages languages (those with the most rows), chosen by a hash of the id. Document frequencies read all
learnable rows, limits all others.

Cases: a null text or one without a letter is `und` with score 0 and rejected; ties go to the first language in code-
point order; rows without a language are not learned from; with no learnable row at all every text is `und`; rows that
repeat are predicted alike; very long texts take linear time; a text longer than any learned from takes the last limit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

DIMENSIONS = 1 << 13
UNKNOWN = "und"
ROWS_PER_LANGUAGE = 600
CENTROIDS = 4
MAX_LANGUAGES = 200
#: Share of learnable texts within a limit, and the part of the rest up to 1 that is added to it.
WITHIN, SLACK = 0.999, 0.25
BINS = 2000
LETTER = re.compile(r"[^\W\d_]")
#: All ASCII but letters becomes a space; bytes of other scripts stay.
_TO_SPACE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams over the whole text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    slot = np.concatenate([two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)]) >> np.uint32(19)
    return np.bincount(slot, minlength=DIMENSIONS)


def bands(counts: np.ndarray) -> np.ndarray:
    """The length band of each row of gram counts: the logarithm of its grams."""
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int)


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # its language
    limits: np.ndarray = field(default_factory=lambda: np.ones(1))  # for each band, the distance beyond which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of the most similar centroid, and its cosine; the first language where several are alike."""
        cosines = self.vectors(counts) @ self.centroids.T  # centroids stand in the order of their languages
        best = cosines.argmax(axis=1)
        return self.owner[best], cosines[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        with_letters = [i for i, x in enumerate(texts) if x and LETTER.search(x)] if self.languages else []
        for at in range(0, len(with_letters), 64):
            rows = with_letters[at : at + 64]
            counts = np.stack([gram_counts(texts[i]) for i in rows])
            best, top = self.nearest(counts)
            for i, k in zip(rows, best, strict=True):
                names[i] = self.languages[k]
            scores[rows] = np.clip(top, 0, 1)
            rejected[rows] = 1 - top > self.limits[np.minimum(bands(counts), len(self.limits) - 1)]
        return names, scores, rejected


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    k = min(k, len(vectors))
    centers = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = (vectors @ centers.T).argmax(axis=1)
        for c in range(k):
            if (nearest == c).any():
                total = vectors[nearest == c].sum(axis=0)
                centers[c] = total / max(np.linalg.norm(total), 1e-9)
    return centers


def hash_sample(rows: DataFrame, id_col: str, class_col: str, rows_per_class: int, seed: str, max_classes: int, most: float = 1.0) -> DataFrame:
    """About rows_per_class rows of each class, but no more than the share `most` of it: those whose hashed id is below a
    bar set from the class's count; of the max_classes classes with the most rows."""
    counts = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), class_col).limit(max_classes)
    own, n = common.unused(rows, "own_class", "own_count")
    part = (F.crc32(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")) / F.lit(float(1 << 32)))
    bars = common.checked(counts.withColumnsRenamed({class_col: own, "n": n}))
    return rows.join(bars, rows[class_col] == F.col(own)).where(part < F.least(F.lit(float(rows_per_class)) / F.col(n), F.lit(most))).drop(own, n)


def document_frequencies(known: DataFrame) -> np.ndarray:
    """How many texts of a (lang, text) table with a letter hold each gram slot; last, how many there are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                if LETTER.search(text):
                    total[:-1] += gram_counts(text) > 0
                    total[-1] += 1
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["slot", "n"])

    found = np.zeros(DIMENSIONS + 1)
    for slot, n in common.in_arrow(known, counted, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        found[slot] = n
    return found


def distance_limits(known: DataFrame, model: CentroidModel) -> np.ndarray:
    """The limit of each length band, from the distances of all texts of a (lang, text) table."""
    shared = known.sparkSession.sparkContext.broadcast(model)  # at most max_languages * centroids rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, BINS), np.int64)
        for batch in batches:
            texts = [x for x in batch.column(1).to_pylist() if LETTER.search(x)]
            for at in range(0, len(texts), 64):
                counts = np.stack([gram_counts(x) for x in texts[at : at + 64]])
                distance = 1 - shared.value.nearest(counts)[1]
                np.add.at(total, (bands(counts), np.clip(distance * BINS, 0, BINS - 1).astype(int)), 1)
        band, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[band, place])], ["band", "bin", "n"])

    found = np.zeros((64, BINS))
    for band, place, n in common.in_arrow(known, counted, "band int, bin int, n long").groupBy("band", "bin").agg(F.sum("n")).collect():
        found[band, place] = n
    limits = []
    for row in found[: np.flatnonzero(found.any(axis=1)).max(initial=0) + 1]:
        n = row.sum()
        within = (np.searchsorted(row.cumsum(), WITHIN * n) + 1) / BINS if n else 0.0
        room = SLACK + (1 - SLACK) / np.sqrt(1 + n)  # few texts show little of how far others may lie
        limits.append(within + room * (1 - within))
    return np.minimum.accumulate(limits)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, centroids: int = CENTROIDS, max_languages: int = MAX_LANGUAGES, reject: bool = True) -> CentroidModel:
    """Learn from the rows of docs that have a language. The caller leaves out what is held out. reject: find the limits
    too, which is a pass over all rows; without them no text with a letter is rejected."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    ids = hash_sample(known.select("doc_id", "lang"), "doc_id", "lang", rows_per_language, "lang", max_languages, 0.5)
    ids = common.checked(ids.select("doc_id").distinct())

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    counts = gram_counts(text)
                    slots = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([slots.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[slots].astype(np.uint32).tobytes()], pa.binary())], ["lang", "slots", "counts"])

    chosen = known.join(ids, "doc_id", "left_semi").select("lang", "text")
    rows = sorted(common.in_arrow(chosen, sparse, "lang string, slots binary, counts binary").collect(), key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    model = CentroidModel(sorted({r[0] for r in rows}), np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int))
    if not rows:
        return model
    held = document_frequencies(known.select("lang", "text"))
    model.idf = (np.log((1 + held[-1]) / (1 + held[:-1])) + 1).astype(np.float32)
    parts = []
    for language in model.languages:  # one language's sample at a time is dense
        own = [r for r in rows if r[0] == language]
        counts = np.zeros((len(own), DIMENSIONS), np.float32)
        for i, (_, slots, n) in enumerate(own):
            counts[i, np.frombuffer(slots, np.uint16)] = np.frombuffer(n, np.uint32)
        parts.append(spherical_kmeans(model.vectors(counts), centroids))
    model.centroids = np.concatenate(parts)
    model.owner = np.repeat(np.arange(len(model.languages)), [len(p) for p in parts])
    if reject:
        model.limits = distance_limits(known.join(ids, "doc_id", "left_anti").select("lang", "text"), model)
    return model


def language_table(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, lang_pred, score, rejected) of each row of docs; raw is the binary SHA-256 of its text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    schema = "doc_id long, raw binary, lang_pred string, score double, rejected boolean"

    def predict(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        names, scores, rejected = shared.value.predict(texts)
        yield {"doc_id": batch.column(0), "raw": [hashlib.sha256((x or "").encode()).digest() for x in texts], "lang_pred": names, "score": scores, "rejected": rejected}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.stage(common.map_arrow(chosen, predict, schema), "languages")


def keep_known(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, all columns unchanged."""
    digest, other_id, other = common.unused(docs, "digest", "other_id", "other_digest")
    with common.Staging(docs.sparkSession) as own:
        found = language_table(docs, model, id_col, text_col)
        lost = own.keep(common.stage(found.where("rejected").select("doc_id", "raw").distinct(), "rejected", found.count()))
    lost = common.checked(lost.select(F.col("doc_id").alias(other_id), F.col("raw").alias(other)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.withColumn(digest, F.unhex(F.sha2(text.cast("binary"), 256)))
    return marked.join(lost, marked[id_col].cast("long").eqNullSafe(F.col(other_id)) & (F.col(digest) == F.col(other)), "left_anti").drop(digest)
