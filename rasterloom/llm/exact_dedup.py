"""Exact deduplication with counting quotient filters.

Each partition packs the 64-bit fingerprints of its texts into counting quotient filters, one for each block of their high
bits. What is left of a fingerprint is cut into a quotient, which is not stored but marked as occupied, and a remainder;
the remainders of one quotient stand in a run, in order, its last one marked as the run's end; a count is stored only
where it is above one. A filter gives its fingerprints back exactly, so filters of one block merge without loss by their
sorted remainders. Fingerprints whose merged count is above one name the only texts that can have a copy; those texts,
and no others, are compared byte by byte.

Cases: a null text counts as empty; empty texts equal each other; rows that repeat one doc_id with one text count
as separate copies and share one decision; a null doc_id is never the one kept while another id has the text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

#: Fingerprints of one block, on average, over all partitions.
BLOCK_FINGERPRINTS = 100_000
#: Fingerprints that a task packs at once.
PARTIAL_FINGERPRINTS = 1_000_000


@dataclass
class CountingQuotientFilter:
    """Sorted distinct fingerprints of some bits, with counts."""

    bits: int  # of a fingerprint
    quotient_bits: int  # of these, at least 1
    occupied: np.ndarray  # for each quotient, whether it has a run
    run_ends: np.ndarray  # for each slot, whether it is the last of its run
    remainders: np.ndarray  # of each slot, uint64
    counted: np.ndarray  # slots that occur more than once, in order
    counts: np.ndarray  # how often these occur

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """A filter of sorted distinct values; about every second quotient is in use."""
        q = min(max(1, len(values).bit_length()), bits - 1)
        quotients = values >> np.uint64(bits - q)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        run_ends = np.r_[quotients[1:] != quotients[:-1], np.ones(min(1, len(values)), bool)]
        counted = np.flatnonzero(counts > 1)
        return cls(bits, q, occupied, run_ends, values & np.uint64((1 << bits - q) - 1), counted, counts[counted].astype(np.int64))

    @classmethod
    def of_all(cls, values: np.ndarray, bits: int) -> CountingQuotientFilter:
        return cls.of(*np.unique(values, return_counts=True), bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts: the k-th run is that of the k-th occupied quotient."""
        run = np.cumsum(self.run_ends) - self.run_ends
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run] if len(run) else np.zeros(0, np.uint64)
        counts = np.ones(len(run), np.int64)
        counts[self.counted] = self.counts
        return quotients << np.uint64(self.bits - self.quotient_bits) | self.remainders, counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The union; counts of equal fingerprints add up. Each filter comes in order, so the sort only merges runs."""
        values, counts = (np.concatenate(x) for x in zip(*(f.items() for f in filters), strict=True))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])
        return cls.of(values[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits)

    def packed(self) -> bytes:
        """Bits of the quotients and run ends, remainders cut to whole bytes, and the counts above one."""
        width = -(-(self.bits - self.quotient_bits) // 8)
        head = struct.pack("<BBqq", self.bits, self.quotient_bits, len(self.remainders), len(self.counted))
        remainders = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join((head, np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(), remainders.tobytes(), self.counted.astype("<i8").tobytes(), self.counts.astype("<i8").tobytes()))

    @classmethod
    def unpacked(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n, k = struct.unpack_from("<BBqq", data)
        width, at = -(-(bits - q) // 8), struct.calcsize("<BBqq")

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.unpackbits(take(-(-(1 << q) // 8)), count=1 << q).astype(bool)
        run_ends = np.unpackbits(take(-(-n // 8)), count=n).astype(bool)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width).reshape(n, width)
        return cls(bits, q, occupied, run_ends, remainders.view("<u8").ravel(), take(8 * k).view("<i8"), take(8 * k).view("<i8"))


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, sha, raw) of each row: 64-bit fingerprint and SHA-256 of the lower-cased UTF-8 text, and SHA-256 of the
    text as it is."""

    def keys(batch: pa.RecordBatch):
        texts = common.lowered(batch.column(1))
        whole = batch.column(1).cast(pa.binary()).to_pylist()
        yield {
            "doc_id": batch.column(0),
            "fp": np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64),
            "sha": [hashlib.sha256(x).digest() for x in texts],
            "raw": [hashlib.sha256(x or b"").digest() for x in whole],
        }

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(chosen, keys, "doc_id long, fp long, sha binary, raw binary")


def repeated_fingerprints(keys: DataFrame, rows: int) -> DataFrame:
    """Fingerprints that occur more than once, by filters for each partition and block, and a merge per block."""
    block_bits = max(0, int(np.ceil(np.log2(max(rows, 1) / BLOCK_FINGERPRINTS))))
    bits = 64 - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def poured() -> pa.RecordBatch:
            values = np.sort(np.concatenate(waiting))
            blocks = values >> np.uint64(bits) if block_bits else np.zeros(len(values), np.uint64)
            begins = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            low = values & np.uint64((1 << bits) - 1)
            filters = [CountingQuotientFilter.of_all(part, bits).packed() for part in np.split(low, begins[1:])]
            return pa.RecordBatch.from_arrays([pa.array(blocks[begins].astype(np.int64)), pa.array(filters, pa.binary())], ["block", "filter"])

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(batch)
            if held >= PARTIAL_FINGERPRINTS:
                yield poured()
                waiting, held = [], 0
        if held:
            yield poured()

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values, counts = CountingQuotientFilter.merged([CountingQuotientFilter.unpacked(x) for x in frame["filter"]]).items()
        high = np.uint64(int(key[0]) << bits) if block_bits else np.uint64(0)
        return pd.DataFrame({"fp": (values[counts > 1] | high).view(np.int64)})

    filters = common.in_arrow(keys.select("fp"), build, "block long, filter binary")
    return filters.groupBy("block").applyInPandas(merge, "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha and raw (binary SHA-256 of the lower-cased
    text, and of the text as it is)."""
    with common.Staging(docs.sparkSession) as own:
        keys = common.stage(text_keys(docs, id_col, text_col), "keys")
        repeated = common.stage(repeated_fingerprints(keys, keys.count()), "repeated")

        def texts(batch: pa.RecordBatch):
            found = common.lowered(batch.column(1))
            yield {"doc_id": batch.column(0), "fp": np.array([xxhash.xxh3_64_intdigest(x) for x in found], np.uint64).view(np.int64), "body": found}

        chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        routed = common.map_arrow(chosen, texts, "doc_id long, fp long, body binary")
        routed = routed.join(common.checked(repeated), "fp", "left_semi")
        # Grouping by the bytes is the verification: equal fingerprints of different texts fall apart here.
        groups = routed.groupBy("fp", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.where("group_size > 1").select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "group_size")
        one = keys.select("doc_id", "sha", "raw").join(groups, "sha", "left")
        keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        decided = one.select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            keep.eqNullSafe(F.col("doc_id")).alias("kept"),
            "sha",
            "raw",
        )
        return own.keep(common.stage(decided, "decided"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns unchanged; of rows that repeat one id and text, one stays.

    Rows are matched by id and digest of their whole text, as an id may stand for several texts.
    """
    digest, other_id, other = common.unused(docs, "digest", "other_id", "other_digest")
    with common.Staging(docs.sparkSession) as own:
        decided = exact_dedup(docs, id_col, text_col)
        n = decided.count()
        lost = own.keep(common.stage(decided.where(~F.col("kept")).select("doc_id", "raw").distinct(), "lost", n))
        # Texts of one id that differ in their letters' case alone are rows that repeat too; of these any one stays.
        twice = decided.where("kept").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("first")).where("n > 1")
        twice = common.stage(twice, "twice", n)
        rows = decided.where("kept").join(twice.select(F.col("doc_id").alias("id"), "sha", "first"), F.col("doc_id").eqNullSafe(F.col("id")) & (decided["sha"] == twice["sha"]))
        rows = own.keep(common.stage(rows.select("doc_id", "raw", "first").distinct(), "repeats", n))

    def matches(other_rows: DataFrame, how: str, frame: DataFrame) -> DataFrame:
        other_rows = common.checked(other_rows.select(F.col("doc_id").alias(other_id), F.col("raw").alias(other)))
        return frame.join(other_rows, frame[id_col].cast("long").eqNullSafe(F.col(other_id)) & (F.col(digest) == F.col(other)), how)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = matches(lost, "left_anti", docs.withColumn(digest, F.unhex(F.sha2(text.cast("binary"), 256))))
    if not rows.isEmpty():
        once = matches(rows.where("raw = first"), "left_semi", left).dropDuplicates([id_col, digest])
        left = matches(rows, "left_anti", left).unionByName(once)
    return left.drop(digest)
