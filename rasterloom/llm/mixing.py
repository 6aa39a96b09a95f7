"""Mixing sources to target weights, in DataFrame functions only.

Word totals are summed per source (with partial sums, so a hot source costs nothing extra). Sources in code-point
order, null last, take the weights in turn and share `share` times the total; a target stops at `most` times its
source's size and the excess is shared again by weight. The level at which nothing is above its stop is found in one
pass over the sources ordered by stop per weight. A document is emitted floor(rate) times, plus once more if a hash of
its id falls below the fraction of the rate.

Cases: a null text has size 0; null is a source of its own, last in order; a source of size 0 has target 0 and its
documents are taken 0 times; rows that repeat an id take one decision; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"


def with_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the running sum of each of `sums` in a global order, without gathering all rows in one task.

    Rows are dealt by range and written; each range sums its own rows, and only the totals of the ranges (as many as
    there are partitions) meet in one window.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id())
    dealt = common.stage(dealt, "ranges")
    totals = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.select("*", *[F.sum(c).over(inside).alias(k) for k, c in sums.items()])
    found = found.join(F.broadcast(starts), "__part")  # one row per partition
    return found.select(*rows.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums])


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) of each source of a (doc_id, source, size) table."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]  # Spark compares the bytes of UTF-8, which sort as code points do
    ranked = prefix_sums(totals, by_name, {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("stop"))
    weighed = weighed.withColumn("ratio", F.col("stop") / F.col("weight"))
    filled = prefix_sums(weighed, [F.col("ratio"), *by_name], {"stops": F.col("stop"), "used": F.col("weight")})
    filled = common.stage(filled, "filled")
    all_sizes, all_weight = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # If this source and all after it are below their stops, they share what the earlier ones leave.
    level = (F.lit(all_sizes * share) - (F.col("stops") - F.col("stop"))) / (F.lit(all_weight) - (F.col("used") - F.col("weight")))
    # Levels rise until one fits, and fall from there on.
    found = filled.select(level.alias("level"), "ratio").where("level <= ratio").agg(F.max("level")).first()[0]
    target = F.col("stop") if found is None else F.least(F.col("stop"), F.lit(found) * F.col("weight"))
    rated = filled.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return common.stage(rated.select("source", "source_size", "target", F.least(rate, F.lit(most)).alias("rate")), "rates")


def copies(rate: Column, id_column: Column, seed: int = 0) -> Column:
    """floor(rate), plus 1 if the hash of the id, as a fraction of 1, is below what is left of the rate."""
    digest = F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}")))
    part = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) of each document."""
    with common.Staging(docs.sparkSession) as own:
        sizes = own.keep(common.stage(with_sizes(docs), "sizes"))
        rates = own.keep(source_rates(sizes, weights, share, most))
    joined = _with_rates(sizes, rates, "source")
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", copies(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def _with_rates(rows: DataFrame, rates: DataFrame, source_col: str) -> DataFrame:
    [name] = common.unused(rows, "own_source")
    named = common.checked(rates.withColumnRenamed("source", name))
    return rows.join(named, rows[source_col].cast("string").eqNullSafe(F.col(name))).drop(name)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself: each row of docs, all columns unchanged, as often as it is taken."""
    names = docs.columns
    rate, times, number = common.unused(docs, "own_rate", "times_taken", "copy_number")
    with common.Staging(docs.sparkSession) as own:
        rates = own.keep(source_rates(with_sizes(docs), weights, share, most)).select("source", F.col("rate").alias(rate))
    taken = _with_rates(docs, rates, "source").withColumn(times, copies(F.col(rate), F.col("doc_id"), seed)).where(F.col(times) > 0)
    return taken.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*names)
