"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate, its share of the target volume over its own volume. A
document is repeated as often as a Poisson variable with that mean says; the variable is the inverse
of the distribution at a hash of seed and document id, so a task that runs again draws the same. The
copies are dealt to partitions and sorted by another hash: one global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

STEP = 256.0  # a larger mean is drawn as a sum of equal Poisson variables of at most this mean
UNIT = float(1 << 52)
BROADCAST_SOURCES = 100_000


def _hash_text(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def hash_unit(seed: int, *parts) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of an md5 of seed and parts."""
    return F.conv(F.substring(_hash_text(seed, *parts), 1, 13), 16, 10).cast("double") / UNIT


def poisson_table(rate: Column) -> Column:
    """Array of the Poisson distribution function at 0, 1, ... up to where the rest is below 2^-53."""
    top = F.ceil(rate + 9.0 * F.sqrt(rate) + 20.0).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, source_col: str, size: Column, weights: dict | None, alpha: float,
                 total: float | None) -> DataFrame:
    """(source, volume, rate): one row a source, a null source included."""
    volumes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.sum(size).cast("double").alias("volume"))
    if weights is None:
        wish = F.pow("volume", F.lit(alpha))
    else:
        items = [F.lit(x) for s, w in weights.items() if s is not None for x in (s, float(w))]
        known = F.create_map(*items)[F.col("source")] if items else F.lit(None).cast("double")
        wish = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(known, F.lit(0.0)))
    wanted = volumes.withColumn("wish", F.when(F.col("volume") > 0, wish).otherwise(F.lit(0.0)))
    sums = wanted.agg(F.sum("wish").alias("wish"), F.sum("volume").alias("volume")).first()
    target = (sums["volume"] if total is None else total) or 0.0
    share = F.lit(0.0) if not sums["wish"] else F.col("wish") / F.lit(sums["wish"])
    return wanted.select("source", "volume", F.when(F.col("volume") > 0, share * F.lit(float(target)) / F.col("volume"))
                         .otherwise(F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.5, total: float | None = None, seed: int = 17,
                id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` repeated to the target weights and globally shuffled, plus ``rate``, ``copies`` (how often
    the row occurs), ``copy`` (1 to ``copies``) and ``shuffle_key`` (its place in the shuffle).

    ``weights`` maps sources to shares of the result's volume (code points of ``text_col``; they need not
    sum to 1, a source left out has weight 0 and goes); without it a source's share is in proportion
    to its volume to the power ``alpha``. ``total`` is the wanted volume, that of ``docs`` by default.
    A null source is a source of its own. Rows that share an id are repeated alike; a null id is drawn
    as the empty id; a null or empty text adds no volume and is repeated like the rest of its source,
    a source without any volume goes. Input columns named like the outputs are replaced; an empty
    table stays empty.
    """
    spark = docs.sparkSession
    outputs = ("rate", "copies", "copy", "shuffle_key")
    kept = [c for c in docs.columns if c.lower() not in outputs]
    rates = source_rates(docs, source_col, F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)), weights, alpha, total)
    src, rate, parts, cdf, part = fresh(docs.columns, "mix_source", "mix_rate", "mix_parts", "mix_cdf", "mix_part")
    steps = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    rates = rates.select(F.col("source").alias(src), F.col("rate").alias(rate), steps.alias(parts),
                         poisson_table(F.col("rate") / steps).alias(cdf))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)  # beyond that bound it is a shuffled join, split by AQE where a source is hot
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col(src)))
    doc = F.col(f"`{id_col}`")
    drawn = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, i: acc + F.size(
        F.filter(F.col(cdf), lambda c: c <= hash_unit(seed, doc, i))))
    out = rows.withColumn("rate", F.col(rate)).withColumn("copies", drawn).where("copies > 0").drop(src, rate, parts, cdf)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.withColumn("shuffle_key", F.substring(_hash_text(seed, doc, F.col("copy"), F.lit("place")), 1, 16))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the key is uniform: equal slices of its range need no sampling pass
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 13), 16, 10).cast("double") / UNIT * n).cast("int")
    return out.withColumn(part, place).repartitionById(n, F.col(part)).sortWithinPartitions("shuffle_key", f"`{id_col}`").drop(part)
