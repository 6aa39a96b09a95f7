"""Repeated passages by sparse suffix arrays.

A suffix is kept only where a minimiser selects it: a word k-gram whose hash is the smallest in some window. Selection
depends on content alone, so a passage of `least` words that stands in two texts keeps the same suffixes in both, the
first of them early enough that at least `least` / 2 words of the passage follow. The kept suffixes of all texts are
sorted by what follows them (first the next `least` / 2 words, then the next `least`, then by text and place, as
hashes); neighbours in that order are compared and their matches are extended left and right, word by word, in the
texts themselves. Matches of `least` words or more are reported, merged for each text.

The longest match to the left need not be with a neighbour to the right. So windows of `least` words that begin up to
a selection window before a kept suffix, and that no match covers, are looked up by their hash in a last step. With it,
exactly those words are reported that lie in some window of `least` words which another text holds too.

Texts that are equal as word sequences are collapsed first and are reported as repeated from end to end. Only suffixes
whose next words occur in another text take part in the sort. It is a sort by range, so a passage that millions of
texts share is spread over many tasks; every suffix meets its two neighbours only, never all texts that share a key.

Cases: null, empty and shorter texts hold no passage; repeats inside one text are not reported; rows that repeat an id
and a text are one; where an id has several texts, passages of all of them are reported under it, places counted in each; a null id is left out; ties in the order are broken by id and place; very long texts take linear time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common
from rasterloom.llm.jaccard import WordHashes, mix

LEAST_WORDS = 50
GRAM = 8
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)
_words = WordHashes()


def forget() -> None:
    _words.clear()


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the root and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_ROOT, _ROOT_INVERSE)):
            _powers[k] = np.r_[np.uint64(1), np.cumprod(np.full(2 * n, base, np.uint64))]
    return _powers[0][: n + 1], _powers[1][: n + 1]


def word_hashes(lowered: bytes) -> np.ndarray:
    words = lowered.split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def range_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of the words from starts to ends, wherever in a text they stand."""
    return mix((total[ends] - total[starts]) * inverse[starts], 1) ^ (ends - starts).astype(np.uint64)


def kept_suffixes(h: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hash of the next least // 2 words, hash of the next `least` words or what is left) of a text's kept suffixes."""
    n, near = len(h), least // 2
    window, gram = least - near + 1, min(GRAM, near)
    if n < least:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    root, inverse = powers(n)
    total = np.r_[np.uint64(0), np.cumsum(h * root[:n])]
    starts = np.arange(n - gram + 1)
    grams = range_hashes(total, starts, starts + gram, inverse)
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    places = np.unique(np.concatenate([part.argmin(axis=1) + np.arange(at, at + len(part)) for at in range(0, len(views), 1 << 16) for part in [views[at : at + (1 << 16)]]]))
    places = places[places + near <= n]
    return places, range_hashes(total, places, places + near, inverse), range_hashes(total, places, np.minimum(places + least, n), inverse)


def suffix_table(docs: DataFrame, least: int) -> DataFrame:
    """Of each text a row (doc_id, n, sig), and of each kept suffix a row (doc_id, place, near, far)."""
    schema = "doc_id long, n int, sig binary, place int, near long, far long"
    kinds, names = common.arrow_types(schema), [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, sigs, found = [], [], [], [[], [], [], []]
            for doc_id, body in zip(batch.column(0).to_pylist(), common.lowered(batch.column(1)), strict=True):
                h = word_hashes(body)
                if len(h) < least:
                    continue
                ids.append(doc_id)
                sizes.append(len(h))
                sigs.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                places, near, far = kept_suffixes(h, least)
                for out, x in zip(found, (np.full(len(places), doc_id, np.int64), places.astype(np.int32), near.view(np.int64), far.view(np.int64)), strict=True):
                    out.append(x)
            if not ids:
                continue
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(sizes, kinds[1]), pa.array(sigs, kinds[2]), *[none.cast(k) for k in kinds[3:]]], names)
            own, places, near, far = (np.concatenate(x) for x in found)
            none = pa.nulls(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own), none.cast(kinds[1]), none.cast(kinds[2]), pa.array(places), pa.array(near), pa.array(far)], names)

    return common.in_arrow(docs, run, schema, forget)


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (doc_a, at_a, doc_b, at_b) of suffixes of different texts that are next to each other among those with one
    `near`; rows are sorted. `edge` marks instead the first and last row of a task, which still miss a neighbour."""
    schema = "doc_a long, at_a int, doc_b long, at_b int, near long, far long, edge boolean"
    kinds, names = common.arrow_types(schema), [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, current, row, first = None, [], None, True

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # near, far, doc_id, place
                if first:
                    out.append((row[2], row[3], None, None, row[0], row[1], True))
                    first = False
                if current and row[0] == current[-1][0] and row[2] == current[-1][2]:
                    current.append(row)
                else:
                    if current:
                        if row[0] == current[-1][0]:
                            out += [(x[2], x[3], row[2], row[3], None, None, False) for x in current[:-1]]
                        before = current[-1]
                    current = [row]
                if before is not None and before[0] == row[0] and before[2] != row[2]:
                    out.append((before[2], before[3], row[2], row[3], None, None, False))
            if out:
                yield table(out)
        if row is not None:
            yield table([(row[2], row[3], None, None, row[0], row[1], True)])

    return common.in_arrow(rows.select("near", "far", "doc_id", "place"), run, schema)


def sorted_neighbours(rows: DataFrame) -> DataFrame:
    """Neighbours over all tasks of a range sort: those inside tasks, and those across the borders of tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["near", "far", "doc_id", "place"]
    found = common.stage(neighbours(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)), "neighbours")
    edges = found.where("edge").select("near", "far", F.col("doc_a").alias("doc_id"), F.col("at_a").alias("place")).distinct()
    across = neighbours(edges.repartition(1).sortWithinPartitions(*order))  # two rows of each task
    return found.where("not edge").unionByName(across.where("not edge")).select("doc_a", "at_a", "doc_b", "at_b")


def extended(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of each maximal match through an anchor, if it is long enough."""
    by_shift = defaultdict(list)
    for x, y in anchors:
        by_shift[x - y].append(x)
    found = []
    for shift, places in by_shift.items():
        low, high = max(0, shift), min(len(a), len(b) + shift)
        same = np.r_[False, a[low:high] == b[low - shift : high - shift], False]
        turns = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = turns[::2], turns[1::2]
        hit = np.unique(np.searchsorted(starts, np.array(sorted(places)) - low, side="right") - 1)
        for k in hit[hit >= 0]:
            if ends[k] - starts[k] >= least:
                found.append((int(starts[k] + low), int(starts[k] + low - shift), int(ends[k] - starts[k])))
    return found


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted (start, end, other) with overlapping or touching spans as one, which takes the smallest other."""
    found: list[tuple[int, int, int]] = []
    for start, end, other in spans:
        if found and start <= found[-1][1]:
            before = found.pop()
            start, end, other = before[0], max(before[1], end), min(before[2], other)
        found.append((start, end, other))
    return found


def match_table(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, start, end, other): both sides of each match between the texts of each pair."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(f"doc_{side}"), F.col("text").alias(f"text_{side}")), f"doc_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed: dict[int, np.ndarray] = {}  # rows come sorted by one side, so a text is often that of the row before
        for batch in batches:
            found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            bodies = common.lowered(batch.column(3)), common.lowered(batch.column(4))
            for doc_a, doc_b, anchors, body_a, body_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), *bodies, strict=True):
                if len(hashed) > 64:
                    hashed.clear()
                for doc, body in ((doc_a, body_a), (doc_b, body_b)):
                    if doc not in hashed:
                        hashed[doc] = word_hashes(body)
                places = [(x["at_a"], x["at_b"]) for x in anchors]
                for x, y, n in extended(hashed[doc_a], hashed[doc_b], places, least):
                    found[doc_a].append((x, x + n, doc_b))
                    found[doc_b].append((y, y + n, doc_a))
            # What one text has in common with several others is merged here first.
            out = [(doc, *span) for doc, spans in found.items() for span in joined(sorted(spans))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "start", "end", "other"])

    return common.in_arrow(pairs.select("doc_a", "doc_b", "anchors", "text_a", "text_b"), run, "doc_id long, start int, end int, other long", forget)


def open_windows(bodies: DataFrame, kept: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """(doc_id, place, key): windows that hold a kept suffix early enough, and that no span covers."""
    back = least - least // 2
    places = kept.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    covers = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("covers"))
    rows = bodies.join(places, "doc_id").join(covers, "doc_id", "left").select("doc_id", "text", "places", "covers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, body, own, covers in zip(batch.column(0).to_pylist(), common.lowered(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                h = word_hashes(body)
                if len(h) < least:
                    continue
                wanted = np.zeros(len(h) - least + 2, np.int64)
                own = np.array(own)
                np.add.at(wanted, np.clip(own - back, 0, len(wanted) - 1), 1)
                np.add.at(wanted, np.minimum(own + 1, len(wanted) - 1), -1)
                wanted = np.cumsum(wanted)[:-1] > 0
                for c in covers or []:
                    wanted[c["start"] : max(c["start"], c["end"] - least + 1)] = False
                starts = np.flatnonzero(wanted)
                if len(starts):
                    root, inverse = powers(len(h))
                    total = np.r_[np.uint64(0), np.cumsum(h * root[: len(h)])]
                    keys = range_hashes(total, starts, starts + least, inverse)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), doc_id, np.int64)), pa.array(starts.astype(np.int32)), pa.array(keys.view(np.int64))], ["doc_id", "place", "key"])

    return common.in_arrow(rows, run, "doc_id long, place int, key long", forget)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text as one, with the smallest other text."""
    lists = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "other"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc_id, *span) for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for span in joined([(x["start"], x["end"], x["other"]) for x in own])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "start", "end", "other"])

    return common.in_arrow(lists, run, "doc_id long, start int, end int, other long", forget)


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated stretch of a text: doc_id, start_word, end_word (exclusive), n_words, other_id."""
    with common.Staging(docs.sparkSession) as own:
        chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
        table = common.stage(suffix_table(chosen, least), "suffixes")
        texts = table.where("sig is not null").select("doc_id", "n", "sig")
        groups = texts.groupBy("sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        groups = common.stage(groups, "groups")
        copies = common.stage(texts.join(groups, "sig"), "copies")
        whole = copies.select("doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other")).distinct()
        # An id that has other texts too stays with all of them: passages of those must still be found.
        single = texts.groupBy("doc_id").agg((F.min("sig") == F.max("sig")).alias("single")).where("single").select("doc_id")
        spare = copies.where("doc_id <> low").select("doc_id").distinct().join(single, "doc_id", "left_semi")
        spare = common.checked(common.stage(spare, "spare"))
        suffixes = table.where("sig is null").select("near", "far", "doc_id", "place").join(spare, "doc_id", "left_anti")
        common_keys = suffixes.groupBy("near").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("near")
        common_keys = common.stage(common_keys, "common-keys")  # as a table of its own, so that a hot key's rows can be split among tasks
        kept = common.stage(suffixes.join(common_keys, "near", "left_semi"), "kept")
        found = sorted_neighbours(kept)
        low_first = F.col("doc_a") < F.col("doc_b")
        ordered = [F.when(low_first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for c in ("doc", "at") for x, y in (("a", "b"), ("b", "a"))]
        pairs = found.select(*ordered).groupBy("doc_a", "doc_b").agg(F.collect_set(F.struct("at_a", "at_b")).alias("anchors"))
        pairs = common.stage(pairs, "pairs")
        ids = common.stage(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct(), "ids")
        bodies = chosen.join(common.checked(ids), "doc_id", "left_semi")
        spans = common.stage(match_table(pairs, bodies, least), "spans")
        windows = common.stage(open_windows(bodies, kept, spans, least), "windows")
        shared = windows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        shared = common.stage(shared, "shared-windows")
        late = windows.join(shared, "key").select("doc_id", F.col("place").alias("start"), (F.col("place") + least).alias("end"), F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))
        # A copy stands for its whole group: what its first text shares with others lies inside the whole-text row.
        merged_rows = merged(spans.unionByName(late).unionByName(whole))
        found = merged_rows.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_id"))
        return own.keep(common.stage(found, "passages"))
