"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Every document draws its number of copies from a Poisson distribution whose mean
is its source's repetition rate: the hash of its id gives a uniform number, the
inverted distribution function gives the count. Copies are exploded and put in
a global random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Sources are broadcast up to this count; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def hash_uniform(key: Column) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """Array of P(X <= 0), P(X <= 1), ... up to where the tail is below 2**-52 of a draw's resolution."""
    top = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    ln = F.log(rate)
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("f"), F.array().cast("array<double>").alias("a"))

    def step(acc, i):
        f = acc["f"] + F.when(i > 0, F.log(i.cast("double"))).otherwise(0.0)
        c = acc["c"] + F.exp(i * ln - rate - f)
        return F.struct(c.alias("c"), f.alias("f"), F.concat(acc["a"], F.array(c)).alias("a"))
    return F.aggregate(F.sequence(F.lit(0), top), zero, step, lambda acc: acc["a"])


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict | None = None, power: float = 0.7,
                 epochs: float = 1.0) -> DataFrame:
    """(source, rate, cdf): copies each document of a source gets on average.

    ``weights`` names each source's target share (others get none; shares are
    normalised). Without it, the share of a source is its count to ``power``,
    which lifts small sources and lowers large ones. All shares together make
    ``epochs`` times the number of documents. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        spark = docs.sparkSession
        w = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        counts = counts.join(w, counts["source"].eqNullSafe(w["source"]), "left").select(
            counts["source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    scale = epochs * total["n"] / total["w"] if total["w"] else 0.0
    rates = counts.select("source", (F.lit(scale) * F.col("w") / F.col("n")).alias("rate"))
    return rates.withColumn("cdf", F.when(F.col("rate") > 0, poisson_cdf(F.col("rate"))))


def poisson_mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source",
                weights: dict | None = None, power: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """Every document repeated by its Poisson count, in a global random order.

    Returns all columns of ``docs`` and mix_copy (from 1), mix_copies, mix_rate and
    mix_key (32 hex digits, the global order; each written partition is sorted by it and holds
    a random share of all copies). A column of ``docs`` with one of these names is
    replaced (mix_source, mix_cdf and mix_u are dropped). Counts depend on the seed and the id alone, so a rerun or a
    larger table repeats them for equal rates; rows with equal ids get equal counts,
    null ids count as one id. Null text or source is data like any other; a source
    without weight gives no copies; an empty table gives an empty result.

    No source is ever gathered: a hot one is spread by its rows' keys.
    """
    own = ["mix_copy", "mix_copies", "mix_rate", "mix_key"]
    docs = docs.drop(*own, "mix_source", "mix_cdf", "mix_u")
    rates = source_rates(docs, source_col, weights, power, epochs).select(
        F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), F.col("cdf").alias("mix_cdf"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    cols = docs.columns
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    out = docs.join(rates, docs[source_col].eqNullSafe(F.col("mix_source")))
    n = F.when(F.col("mix_cdf").isNull(), 0).otherwise(
        F.size(F.filter("mix_cdf", lambda c: c <= F.col("mix_u"))))
    out = out.withColumn("mix_u", hash_uniform(key)).withColumn("mix_copies", n).filter("mix_copies > 0")
    out = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    out = out.withColumn("mix_key", F.md5(F.concat(key, F.lit(":"), F.col("mix_copy").cast("string"))))
    return out.select(*[F.col(f"`{c}`") for c in cols], *own).repartition("mix_key").sortWithinPartitions("mix_key")
