"""N-gram Jaccard self-join with filters under several global orders.

Each text is the set of its distinct word shingles, as 64-bit hashes. For a threshold t, sort a set of n by any order
that is the same for all texts: two sets that link must share one of the first n - ceil(t n) + 1 shingles. This holds
under every order, so a pair must pass it under each of several orders before the sets themselves are compared.

* All orders put shingles that are frequent in the corpus last, by a count sketch over all texts, and differ in how they
  order shingles of like frequency. A sketch that counts too high costs time, never a link. Counts are held against the
  sketch's own noise, so shingles that would make large buckets stand out however large the corpus is.
* Texts with equal sets are collapsed to one representative before the join; they share its component.
* Prefixes are dealt by shingle once; where they arrive, those rows of a shingle are dropped that by size and place can link
  with no other row of it. A pair that links passes that test at its first common shingle, so both its rows stay.
* Buckets (texts sharing a prefix shingle) are never paired out in full. Each bucket first pairs its texts with one hub:
  the text with the fewest rarer shingles before the common one, which is the least edited of a family of copies, and to
  which all link that can link with many. What links is merged; then only texts that lie in another component than the
  hub are paired with the rest of their bucket. While that is still too much, the hubs' rounds are repeated with hubs
  from other components. Pairs inside one component are never needed, so no link between components is lost.

Cases: null and empty texts have empty sets and link with nothing; with fewer words than a shingle holds, the whole
text is one shingle; rows that repeat an id are one node; a null id has a null component; ties in the order are broken
by the hash itself; very long texts take n log n time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common, graph

SKETCH_BITS, BLOCK_BITS = 21, 16
ORDERS = 3
#: Pairs to be weighed (not made) beyond this multiple of the texts in buckets call for another round of hubs first.
PAIRS_PER_TEXT = 200
MAX_HUB_ROUNDS = 3
#: Pairs that one task compares, where there are few in all.
PAIRS_PER_TASK = 5000
#: Texts whose sets a task remembers while it compares pairs.
TEXTS_KEPT = 256
#: Prefix rows of one shingle that one task takes, by the sketch; those of a more frequent one are dealt to several.
SALT_BITS = 15
#: Prefix rows that a task tests together for whether they can link with another one of their shingle.
MET_ROWS = 50_000


class WordHashes(dict):
    """word -> 64-bit hash. Frequent words come early, so once full it remembers no more."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


_words = WordHashes()


def forget() -> None:
    _words.clear()


#: Odd multipliers that tell the places of a shingle's words apart: the golden ratio's bits times odd numbers.
_ODD = [0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(16)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words; another one for each salt."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(lowered: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a lower-cased text."""
    words = lowered.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    total = h[:n] * np.uint64(_ODD[0])
    for k in range(1, span):
        total += h[k : k + n] * np.uint64(_ODD[k % len(_ODD)] + 2 * (k // len(_ODD)))
    return np.unique(mix(total, span))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def order_keys(hashes: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Keys whose order is the given one: frequency class first, then the order's own hash."""
    return classes[hashes >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | mix(hashes, order) >> np.uint64(8)


def prefix(hashes: np.ndarray, classes: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in a given order, in that order."""
    length, keys = prefix_length(len(hashes), num, den), order_keys(hashes, classes, order)
    chosen = np.argpartition(keys, length - 1)[:length] if 0 < length < len(keys) else np.arange(len(keys))
    return hashes[chosen[np.lexsort((hashes[chosen], keys[chosen]))]]


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def describe(docs: DataFrame, width: int) -> DataFrame:
    """For each row (doc_id, n, sig) with the size and a 128-bit digest of its set, and for each partition the blocks of
    its count sketch (block, part, counters)."""
    schema = "doc_id long, n long, sig binary, block int, part int, counters binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = common.arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, waiting, held = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def poured() -> None:
            nonlocal counters, waiting, held
            if waiting:
                counters += np.bincount((np.concatenate(waiting) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                waiting, held = [], 0

        for batch in batches:
            n, sig = [], []
            for body in common.lowered(batch.column(1)):
                hashes = shingle_set(body, width)
                n.append(len(hashes))
                sig.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                waiting.append(hashes)
                held += len(hashes)
                if held > 1 << 20:
                    poured()
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, kinds[1]), pa.array(sig, kinds[2]), *[none.cast(k) for k in kinds[3:]]], names)
        poured()
        part = TaskContext.get().partitionId() >> 7
        for block, counts in enumerate(np.split(counters.astype(np.uint32), 1 << SKETCH_BITS - BLOCK_BITS)):
            if counts.any():
                none = [pa.nulls(1).cast(k) for k in kinds[:3]]
                yield pa.RecordBatch.from_arrays([*none, pa.array([block], kinds[3]), pa.array([part], kinds[4]), pa.array([zlib.compress(counts.tobytes(), 1)], kinds[5])], names)

    return common.in_arrow(docs, run, schema, forget)


def frequency_classes(blocks: DataFrame) -> np.ndarray:
    """One byte per counter of the summed sketch: twice the logarithm of what the count is above the sketch's median, which
    is the noise that other shingles leave in a counter. 2 MB, whatever the corpus."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.uint32 if part >= 0 else np.int64).astype(np.int64) for part, c in zip(frame["part"], frame["counters"], strict=True))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [-1], "counters": [zlib.compress(total.tobytes(), 1)]})

    schema = "block int, part int, counters binary"
    groups = blocks.groupBy("block", "part").applyInPandas(add, schema)  # 128 partitions at most in a group
    total = groups.groupBy("block").applyInPandas(add, schema)
    counts = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int64)
    for block, _, counters in total.collect():
        counts[block] = np.frombuffer(zlib.decompress(counters), np.int64)
    counts = counts.ravel()
    return (2 * np.log2(np.maximum(counts - int(np.median(counts)), 0) + 1)).astype(np.uint8)


def prefix_table(docs: DataFrame, classes, width: int, num: int, den: int) -> DataFrame:
    """(token, salt, doc_id, n, place): the prefix of each set under the first order, with each shingle's place in it.

    salt is -1, but for shingles that the sketch shows in more than 1 << SALT_BITS texts: these spread over several salts.
    """
    names = ["token", "salt", "doc_id", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for doc_id, body in zip(batch.column(0).to_pylist(), common.lowered(batch.column(1)), strict=True):
                hashes = shingle_set(body, width)
                if len(hashes):
                    found = prefix(hashes, classes.value, 0, num, den)
                    n = len(found)
                    bits = np.maximum(classes.value[found >> np.uint64(64 - SKETCH_BITS)].astype(np.int64) // 2 - SALT_BITS, 0)
                    own = int(mix(np.array([doc_id], np.int64).view(np.uint64))[0] >> np.uint64(40))
                    salt = np.where(bits > 0, own & (1 << bits) - 1, -1)
                    for out, x in zip(columns, (found.view(np.int64), salt.astype(np.int32), np.full(n, doc_id, np.int64), np.full(n, len(hashes), np.int32), np.arange(n, dtype=np.int32)), strict=True):
                        out.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names)

    return common.in_arrow(docs, run, "token long, salt int, doc_id long, n int, place int", forget)


def may_meet(token: np.ndarray, n: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Mask of the rows that may link with another row of their token, by the test of may_link; rows are sorted by token.

    That test says that either set is no larger than the other one reaches, which depends on its own size and place alone.
    So of each token's rows in the order of size, those within a row's reach are a stretch, and the greatest reach in it tells.
    """
    if not len(token):
        return np.zeros(0, bool)
    n, place = n.astype(np.int64), place.astype(np.int64)
    reach = np.maximum(((n - place) * (num + den) - n * num) // num, 0)
    order = np.lexsort((n, token))
    own = np.cumsum(np.r_[0, token[1:] != token[:-1]]) * (max(n.max(), reach.max()) + 2)  # tells tokens apart; a row keeps to its own
    size, far = (own + n)[order], (own + reach)[order]
    at, end = np.arange(len(size)), np.searchsorted(size, far, side="right")
    before = np.minimum(at, end) - 1
    keep = (before >= 0) & (np.maximum.accumulate(far)[before] >= size)
    left = np.flatnonzero(~keep & (end > at + 1))
    length, span, greatest = end[left] - left - 1, 1, far  # greatest reach of `span` rows from each
    while len(left):
        use = length < 2 * span
        i = left[use]
        keep[i] = np.maximum(greatest[i + 1], greatest[end[i] - span]) >= size[i]
        left, length = left[~use], length[~use]
        if len(left):
            greatest, span = np.maximum(greatest[:-span], greatest[span:]), 2 * span
    found = np.empty(len(keep), bool)
    found[order] = keep
    return found


def met_again(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of rows sorted by token in each task, those (token, doc_id, n, place) that may link with another one of their token,
    and all salted ones, whose token other tasks have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, enough = [], 0, MET_ROWS

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            """Rows of all tokens but the last one met, of which more may come."""
            nonlocal waiting, held, enough
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            token, n, place = (whole.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            cut = len(token) if last else int(np.searchsorted(token, token[-1]))
            yield whole.slice(0, cut).filter(pa.array(may_meet(token[:cut], n[:cut], place[:cut], num, den)))
            waiting, held = [whole.slice(cut)], len(token) - cut
            enough = max(MET_ROWS, 2 * held)

        for batch in batches:
            salted = pa.array(batch.column(1).to_numpy(zero_copy_only=False) >= 0)
            alone, batch = batch.filter(salted), batch.filter(pc.invert(salted))
            if len(alone):
                yield alone.select([0, 2, 3, 4])
            if len(batch):
                waiting.append(batch.select([0, 2, 3, 4]))
                held += len(batch)
                if held >= enough:
                    yield from settled(False)
        if held:
            yield from settled(True)

    names = ["token", "salt", "doc_id", "n", "place"]
    return common.in_arrow(rows.select(*names), run, "token long, doc_id long, n int, place int")


def first_common(x: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """Places in x and y of the first value of x that y has too; values of one array differ."""
    hit = np.flatnonzero(np.isin(x, y, assume_unique=True))
    return (int(hit[0]), int(np.flatnonzero(y == x[hit[0]])[0])) if len(hit) else None


def may_link(n: Column, place: Column, m: Column, other: Column, num: int, den: int) -> Column:
    """Can sets of n and m link whose first common shingle in an order is at these places (from 0) of each?

    What comes before is in one set only, so at most the rest of either is common. A pair is tested at each of its
    common shingles in a prefix; one that links passes at the first.
    """
    return F.least(n - place, m - other).cast("long") * (num + den) >= (n + m).cast("long") * num


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) that stand in some pair."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return docs.join(common.checked(ids), "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, classes, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link. A pair must pass the filter of every other order before its sets are compared.

    Texts travel, not sets: hashes cannot be compressed and would take three times the room.
    """
    texts = texts_of(docs, pairs)
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)

    def links(left: tuple, right: tuple) -> bool:
        n, m = len(left[0]), len(right[0])
        for x, y in zip(left[1], right[1], strict=True):
            at = first_common(x, y)
            if at is None or min(n - at[0], m - at[1]) * (num + den) < (n + m) * num:
                return False
        both = len(np.intersect1d(left[0], right[0], assume_unique=True))
        return both * den >= num * (n + m - both)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}  # hubs come again and again

        def described(body: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
            if body not in known:
                if len(known) >= TEXTS_KEPT:
                    known.clear()
                hashes = shingle_set(body, width)
                known[body] = hashes, [prefix(hashes, classes.value, k, num, den) for k in range(1, ORDERS)]
            return known[body]

        for batch in batches:
            bodies = zip(common.lowered(batch.column(2)), common.lowered(batch.column(3)), strict=True)
            mask = pa.array([links(described(x), described(y)) for x, y in bodies], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return common.in_arrow(pairs.select("a", "b", "text_a", "text_b"), compare, "a long, b long", forget)


def similar_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, where sets link if den * common >= num * union."""
    spark = docs.sparkSession
    chosen = _chosen(docs, id_col, text_col)
    with common.Staging(spark) as own:
        described = common.stage(describe(chosen, width), "described")
        sets = described.where("block is null").select("doc_id", "n", "sig")
        classes = spark.sparkContext.broadcast(frequency_classes(described.where("block is not null")))  # of a fixed size
        n_rows = described.count()
        groups = sets.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        groups = common.stage(groups, "groups", n_rows)
        found = linked_components(_representatives(chosen, sets, groups, n_rows), classes, width, num, den)
        of_set = groups.join(found, groups["rep"] == found["node"], "left").where("copies > 1 or component is not null")
        of_set = of_set.select("sig", F.coalesce("component", "rep").alias("component"))
        placed = sets.join(of_set, "sig", "left")
        component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
        placed = placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        return own.keep(common.stage(placed, "components"))


def _representatives(chosen: DataFrame, sets: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """The rows of chosen that take part in the search: of equal sets one, and all texts of an id that has several."""
    alone = groups.where("copies > 1")
    # An id that has other texts too stays with all of them: what links to those must still find it.
    several_sets = F.min("sig") != F.max("sig")
    single = sets.where("doc_id is not null").groupBy("doc_id").agg(several_sets.alias("several")).where("not several").select("doc_id")
    spare = sets.join(alone, "sig").where("doc_id <> rep").select("doc_id").distinct().join(single, "doc_id", "left_semi")
    spare = common.checked(common.stage(spare, "spare", n_rows))
    return chosen.where("doc_id is not null").join(spare, "doc_id", "left_anti")


def buckets_of(reps: DataFrame, classes, width: int, num: int, den: int) -> DataFrame:
    """(token, doc_id, n, place, texts, hub): prefix shingles that several texts have, and the hub of their bucket."""
    dealt = prefix_table(reps, classes, width, num, den).repartition("token", "salt").sortWithinPartitions("token")
    rows = common.stage(met_again(dealt, num, den), "buckets")
    n_rows = rows.count()
    # Shingles of one passage mostly have the same texts. Of buckets with equal texts (by their number and two
    # 64-bit digests) the first in the order stays, which is the one with the smallest places; it yields the same pairs.
    hubs = rows.groupBy("token").agg(F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"), F.sum("place").alias("places"), F.min(F.struct("place", "doc_id", "n")).alias("hub"))
    hubs = hubs.where("texts > 1").groupBy("texts", "x", "y").agg(F.min(F.struct("places", "token", "hub")).alias("kept")).select("kept.token", "texts", "kept.hub")
    # Both sides are staged, so that the rows of a hot key can be split among tasks in the join.
    return common.stage(rows.join(common.stage(hubs, "hubs", n_rows), "token"), "shared", n_rows)


def linked_components(reps: DataFrame, classes, width: int, num: int, den: int) -> DataFrame:
    """(node, component) of the texts that link with another one."""
    shared = buckets_of(reps, classes, width, num, den)
    n_shared = shared.count()
    n_texts = shared.select("doc_id").distinct().count()
    alike = may_link(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"), num, den)

    def with_hub(rows: DataFrame) -> DataFrame:
        return rows.where(alike & (F.col("doc_id") != F.col("hub.doc_id"))).select(*pair(F.col("doc_id"), F.col("hub.doc_id"))).distinct()

    def pair(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    pairs = tried = common.stage(with_hub(shared), "pairs", n_shared)
    edges = common.stage(verified(pairs, reps, classes, width, num, den), "links", pairs.count(), PAIRS_PER_TASK)
    found = graph.components(edges)
    # The hubs' pairs are settled: their rows go, and buckets of two with them.
    own_row = F.struct("place", "doc_id", "n")
    left = ["token", "doc_id", "n", "place", "texts", "hub_id"]
    rest = shared.where((F.col("texts") > 2) & (own_row != F.col("hub"))).withColumn("hub_id", F.col("hub.doc_id")).select(left)
    for turn in range(1, MAX_HUB_ROUNDS + 1):
        placed = rest.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
        # Next hubs come from outside the first hub's component: the most central text there, and then any.
        rank = F.col("place").cast("long") if turn == 1 else F.xxhash64("doc_id", F.lit(turn))
        outside = F.when(F.col("component") != F.col("hub_component"), F.struct(rank.alias("rank"), "doc_id", "n", "place", "component"))
        first = found.select(F.col("node").alias("hub_id"), F.col("component").alias("hub_component"))
        first = placed.join(first, "hub_id", "left").withColumn("hub_component", F.coalesce("hub_component", "hub_id"))
        turn_hubs = first.groupBy("token").agg(F.min(outside).alias("hub")).where("hub is not null")
        turn_hubs = common.stage(turn_hubs, "hubs", n_shared)
        placed = common.stage(placed.join(turn_hubs, "token"), "placed", n_shared)
        apart = placed.where("component <> hub.component")
        waiting = apart.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
        if waiting == 0:
            break
        last = waiting <= PAIRS_PER_TEXT * max(n_texts, 1) or turn == MAX_HUB_ROUNDS
        if last:
            one = apart.select("token", *[F.col(c).alias(f"{c}_1") for c in ("doc_id", "n", "place", "component")])
            two = placed.select("token", "doc_id", "n", "place", "component")
            new = one.join(two, (one["token"] == two["token"]) & (F.col("component") != F.col("component_1")) & may_link(F.col("n"), F.col("place"), F.col("n_1"), F.col("place_1"), num, den))
            new = new.select(*pair(F.col("doc_id"), F.col("doc_id_1"))).distinct()
        else:
            new = with_hub(apart)
        new = common.stage(new.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = common.stage(verified(new, reps, classes, width, num, den), "links", new.count(), PAIRS_PER_TASK)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            found = graph.components(edges)
        tried = tried.unionByName(new)
        if last:
            break
        rest = placed.where(own_row != F.struct("hub.place", "hub.doc_id", "hub.n")).select(left)  # only buckets with texts outside
    return found


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose id is the smallest of its component; a null id stays."""
    with common.Staging(docs.sparkSession) as own:
        found = similar_components(docs, width, num, den, id_col, text_col)
        [name] = common.unused(docs, "lost")
        lost = found.where("doc_id <> component_id").select("doc_id").distinct()
        lost = own.keep(common.stage(lost, "lost", found.count()))
        lost = common.checked(lost.withColumnRenamed("doc_id", name))
    return docs.join(lost, docs[id_col].cast("long") == F.col(name), "left_anti")
