"""Secret scanning with an incremental ledger of blobs.

A blob is a text, addressed by its SHA-256; a rule's version is a digest of its definition. The ledger is a table of scans:
which rule versions a blob was scanned for, and what they found. A run addresses every version of every path (a row each),
takes the pairs of blob and rule version that the ledger lacks, scans one text of each such blob for just those rules,
appends that to the ledger, and joins the findings back to all rows that hold the blob. Without a ledger of earlier runs
it begins one that goes with the run; the way is the same.

Cases: a null text counts as empty; versions with one text share one scan; rows that repeat an id are versions of one path
and each get their findings; an empty table gives no findings. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common

#: (kind, pattern, group whose length counts, least length); a match that is too short is dropped after matching.
BASE_RULES = (
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones need no match
)
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 25),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36),
    ("pem", r"-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----", 0, 27),
)
RULES = BASE_RULES + MORE_RULES
LEDGER = "blob binary, scanned array<string>, versions array<string>, starts array<int>, ends array<int>"


def version_of(rule: tuple) -> str:
    """Changes whenever the rule does."""
    return f"{rule[0]}-{hashlib.sha256(repr(rule).encode()).hexdigest()[:12]}"


def find_spans(text: str, rules: tuple = RULES) -> list[tuple[int, int, int, str]]:
    """(start, place of the rule in the list, end, kind) of each finding, in that order."""
    found = []
    for place, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if len(m.group(group)) >= least:
                found.append((m.start(), place, m.end(), kind))
    return sorted(found)


def blob_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def address(batch: pa.RecordBatch):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        yield {"doc_id": batch.column(0), "blob": [hashlib.sha256(x or b"").digest() for x in texts]}

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(chosen, address, "doc_id long, blob binary")


def scan_blobs(texts: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Ledger rows of the texts of a one-column table: the blob, the rule versions it was scanned for, and parallel lists
    with each finding's rule version, start and end."""
    versions = [version_of(r) for r in rules]

    def scan(batch: pa.RecordBatch):
        out = {name: [] for name in ("blob", "scanned", "versions", "starts", "ends")}
        for text in batch.column(0).to_pylist():
            spans = find_spans(text or "", rules)
            out["blob"].append(hashlib.sha256((text or "").encode()).digest())
            out["scanned"].append(versions)
            out["versions"].append([versions[place] for _, place, _, _ in spans])
            out["starts"].append([s[0] for s in spans])
            out["ends"].append([s[2] for s in spans])
        yield out

    return common.map_arrow(texts, scan, LEDGER)


def unseen_pairs(keys: DataFrame, ledger: str | None, versions: list[str]) -> DataFrame:
    """(blob, doc_id, missing): blobs that lack a scan for some of the versions, with the smallest id that holds them."""
    blobs = keys.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = F.array(*[F.lit(v) for v in versions])
    if ledger is None:
        return blobs.withColumn("missing", wanted)
    seen = keys.sparkSession.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
    found = blobs.join(seen, "blob", "left").withColumn("missing", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen")))
    return found.where(F.size("missing") > 0).drop("seen")


def texts_to_scan(chosen: DataFrame, keys: DataFrame, first: DataFrame, n_all: int) -> DataFrame:
    """The texts of a (doc_id, text) table that hold the blobs of `first` (blob, doc_id), each once.

    Where an id stands for one row, ids alone choose the rows, and no text is moved. Ids that stand for several versions
    are told apart by the blob too.
    """
    n_unseen = first.count()
    if n_unseen == n_all:
        return chosen.select("text")
    if keys.select("doc_id").distinct().count() < n_all:
        firsts = common.checked(first.select("blob", F.col("doc_id").alias("first_id")), n_unseen)
        addressed = common.map_arrow(chosen, _addressed, "doc_id long, blob binary, text string")
        held = addressed.join(firsts, (addressed["blob"] == firsts["blob"]) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        return held.dropDuplicates(["blob"]).select("text")
    # Rows that need no scan: those of other blobs, and of each blob all rows but the first.
    idle = common.stage(keys.join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id").where("doc_id is not null"), "idle")
    n_idle = idle.count()
    if n_idle <= n_unseen or n_idle <= common.BROADCAST_ROWS:
        wanted = chosen.join(common.checked(idle, n_idle), "doc_id", "left_anti")
        return wanted.select("text") if first.where("doc_id is null").limit(1).count() else wanted.where("doc_id is not null").select("text")
    firsts = common.checked(first.select(F.col("doc_id").alias("first_id")), n_unseen)
    return chosen.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")


def _addressed(batch: pa.RecordBatch):
    texts = batch.column(1).to_pylist()
    yield {"doc_id": batch.column(0), "blob": [hashlib.sha256((x or "").encode()).digest() for x in texts], "text": texts}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: tuple = RULES) -> DataFrame:
    """One row per row of docs: doc_id, blob, starts, places, ends (parallel lists in order of start, then rule; null
    where nothing is found). places are those of the rules in their list.

    ledger: a folder in shared storage that earlier runs filled; None begins one for this run. Two runs at once may scan a
    pair twice, which leaves the findings as they are.
    """
    spark = docs.sparkSession
    versions = [version_of(r) for r in rules]
    with common.Staging(spark) as own:
        keys = common.stage(blob_keys(docs, id_col, text_col), "blobs")
        known = ledger is not None and common.exists(spark, ledger)
        if ledger is None:
            ledger = own.folder("ledger")
        unseen = common.stage(unseen_pairs(keys, ledger if known else None, versions), "unseen")
        n_all = keys.count()
        chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # As many sets as the rules have histories: one for blobs never seen, one for those that lack a new rule.
        for (missing,) in unseen.select("missing").distinct().collect():
            part = common.stage(unseen.where(F.col("missing") == F.array(*[F.lit(v) for v in missing])).select("blob", "doc_id"), "part")
            fresh = scan_blobs(texts_to_scan(chosen, keys, part, n_all), tuple(r for r, v in zip(rules, versions, strict=True) if v in missing))
            with common.small_batches(spark):
                fresh.write.mode("append").parquet(ledger)
            known = True
        place = F.create_map(*[F.lit(x) for i, v in enumerate(versions) for x in (v, i)])
        if known:
            found = spark.read.schema(LEDGER).parquet(ledger).where(F.size("starts") > 0)
            found = found.select("blob", F.explode(F.arrays_zip("starts", "versions", "ends")).alias("x"))
            found = found.select("blob", F.struct(F.col("x.starts").alias("start"), F.try_element_at(place, F.col("x.versions")).alias("place"), F.col("x.ends").alias("end")).alias("x"))
            found = found.where("x.place is not null").groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("x"))
            found = common.stage(found.select("blob", F.col("x.start").alias("starts"), F.col("x.place").alias("places"), F.col("x.end").alias("ends")), "findings")
        else:
            none = F.lit(None).cast("array<int>")
            found = unseen.select("blob", none.alias("starts"), none.alias("places"), none.alias("ends"))
        return own.keep(common.stage(keys.join(found, "blob", "left"), "spans"))
