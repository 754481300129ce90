"""Normalising sources over what they cover, and fusing them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Weights of the four sources (fixed values).
WEIGHTS = {"visual": 1.0, "object": 0.0891, "ocr": 0.1322, "asr": 0.2128}
LEAST_SIGMA = 1e-9
_KEY = ["query_id", "probe_idx", "source"]


def coverage(scores: DataFrame) -> DataFrame:
    return scores.groupBy("source").agg(F.coalesce(F.avg(F.col("covered").cast("int")), F.lit(0.0)).alias("coverage"))


def z_normalize(scores: DataFrame) -> DataFrame:
    """z over the covered rows of each query, probe and source; zero elsewhere and where nothing varies.

    One aggregate to a row a source, joined back: cheaper than a window over all frames."""
    own = F.when(F.col("covered"), F.col("score"))
    moments = scores.groupBy(*_KEY).agg(F.avg(own).alias("mu"), F.stddev_pop(own).alias("sigma"))
    z = F.when(F.col("covered") & (F.col("sigma") >= LEAST_SIGMA), (F.col("score") - F.col("mu")) / F.col("sigma")).otherwise(0.0)
    return scores.join(moments, _KEY).withColumn("z", z).drop("mu", "sigma")


def rank_normalize(scores: DataFrame) -> DataFrame:
    """Average rank of the covered rows, from -0.5 to 0.5; equal scores get equal values.

    Ranks come from counts of each different score, summed up in ranges of scores: no source is sorted in one task."""
    each = scores.where("covered").groupBy(*_KEY, "score").agg(F.count("*").alias("c"))
    each = staged(each.repartitionByRange(*_KEY, "score").withColumn("part", F.spark_partition_id()), "score-counts")
    per = each.groupBy(*_KEY, "part").agg(F.sum("c").alias("in_part"))
    before = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("in_part").over(before), F.lit(0))).withColumn("n", F.sum("in_part").over(Window.partitionBy(*_KEY)))
    within = Window.partitionBy(*_KEY, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("below") + F.coalesce(F.sum("c").over(within), F.lit(0))
    z = F.when(F.col("n") > 1, (first + (F.col("c") - 1) / 2) / F.greatest(F.lit(1), F.col("n") - 1) - 0.5).otherwise(0.0)
    ranked = each.join(per, [*_KEY, "part"]).select(*_KEY, "score", z.alias("_z"))
    return scores.join(ranked, [*_KEY, "score"], "left").withColumn("z", F.when(F.col("covered"), F.col("_z")).otherwise(0.0)).drop("_z")


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"z": z_normalize, "rank": rank_normalize}


def weight_of(weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(table[F.col("source")], F.raise_error(F.concat(F.lit("no weight for source "), F.col("source"))).cast("double"))


def fuse(scores: DataFrame, weights: dict[str, float] = WEIGHTS, mode: str = "z") -> DataFrame:
    """(query_id, probe_idx, row_id, s): weighted sum of normalised scores. A source of weight zero is
    never computed; one without a weight is an error."""
    if mode not in NORMALIZERS:
        raise ValueError(f"unknown normalisation {mode!r}; known: {sorted(NORMALIZERS)}")
    used = scores.where(~F.col("source").isin([k for k, w in weights.items() if w == 0]))
    return NORMALIZERS[mode](used).groupBy("query_id", "probe_idx", "row_id").agg(F.sum(weight_of(weights) * F.col("z")).alias("s"))


def best_over_probes(fused: DataFrame) -> DataFrame:
    return fused.groupBy("query_id", "row_id").agg(F.max("s").alias("s"))
