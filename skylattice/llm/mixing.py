"""Mixing sources to target weights: capped water-filling, then seeded sampling.

Native DataFrame operations only. Sources are few next to documents; everything
of a document's order of magnitude is hash-aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MAX_EPOCHS = 3
#: Hex digits of the sampling hash in each of the two levels of its bins.
LEVEL = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Water-filling in closed form: by ascending capacity for each weight unit, a source is
    clamped if what is left for the sources from it on, shared by weight, exceeds its capacity.
    The clamped ones are a prefix of that order, so one pass of prefix sums is the
    fixed point of clamping and resharing. Sums stay integers until the last division."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("unit", "nth").rowsBetween(Window.unboundedPreceding, -1)
    exact = "decimal(38,0)"
    out = per.withColumn("nth", F.row_number().over(named)).withColumn("weight", ((F.col("nth") - 1) % 3 + 1).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * max_epochs).withColumn("unit", F.col("source_size") * (F.lit(6) / F.col("weight")).cast("long"))
    out = out.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filling), F.lit(0)))
    out = out.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
    out = out.withColumn("clamped", F.col("cap").cast(exact) * F.col("weights") < F.col("left").cast(exact) * F.col("weight"))
    kept = lambda c: F.sum(F.when(F.col("clamped"), 0).otherwise(F.col(c))).over(everything)
    spent = F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything)
    total = F.sum("source_size").over(everything)
    shared = (total - spent).cast("double") * F.col("weight") / kept("weight")
    return out.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(shared)).select("source", "source_size", "target")


def _below(binned: DataFrame, keys: list[str], bin_col: str) -> DataFrame:
    """Sums of words in each bin, and in the bins before it with the same keys."""
    before = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    per = binned.groupBy(*keys, bin_col).agg(F.sum("size").alias("in_bin"))
    return per.withColumn("before", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))


def _binned(docs: DataFrame, seed: int) -> DataFrame:
    """docs and the two levels of each row's sampling bin, _b1 and _b2."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.withColumn("_b1", F.substring(h, 1, LEVEL)).withColumn("_b2", F.substring(h, LEVEL + 1, LEVEL))


def decisions(slim: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each source of slim(source, size, _b1, _b2): _source, source_size, target, whole repetitions,
    and the bins _e1 and _e2 up to which documents come once more. It is written, so its size is known before it is joined."""
    goals = source_targets(slim, max_epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = written(goals.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    def goal(df: DataFrame) -> DataFrame:
        g = goals.select(F.col("source").alias("g_source"), "part")
        return df.join(g, df["source"].eqNullSafe(g["g_source"])).drop("g_source")

    # the first-level bin in which the part ends: the last that starts at or below it; without a part nothing comes once more, not even empty texts
    coarse = goal(_below(slim, ["source"], "_b1")).where((F.col("part") > 0) & (F.col("before") <= F.col("part")))
    edge = coarse.groupBy("source").agg(F.max_by(F.struct("_b1", "before"), "_b1").alias("e")).select(F.col("source").alias("_source"), F.col("e._b1").alias("_e1"), F.col("e.before").alias("e_before"))
    inside = slim.join(edge, slim["source"].eqNullSafe(edge["_source"]) & (slim["_b1"] == edge["_e1"]))
    fine = goal(_below(inside, ["source", "e_before"], "_b2"))
    nearest = F.col("e_before") + F.col("before") + F.col("in_bin") / 2 <= F.col("part")
    last = fine.where(nearest).groupBy(F.col("source").alias("c_source")).agg(F.max("_b2").alias("_e2"))
    cut = edge.join(last, F.col("_source").eqNullSafe(F.col("c_source")), "left").select("_source", "_e1", F.coalesce("_e2", F.lit("")).alias("_e2"))
    return written(goals.join(cut, goals["source"].eqNullSafe(cut["_source"]), "left").select(F.col("source").alias("_source"), "source_size", "target", "whole", "_e1", "_e2"), "mix-decisions")


def _times():
    once_more = (F.col("_b1") < F.col("_e1")) | ((F.col("_b1") == F.col("_e1")) & (F.col("_b2") <= F.col("_e2")))
    return F.col("whole") + F.when(once_more, 1).otherwise(0)


def _slim(docs: DataFrame, seed: int) -> DataFrame:
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return written(_binned(sized, seed), "mix-sizes")


def mix(docs: DataFrame, seed: int = 7, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source).

    A source that gets e epochs repeats each document floor(e) times; one more repetition goes to
    the documents with the smallest seeded hashes, up to where the words taken come nearest to the
    target. The place of that cut comes from word sums of hash bins on two levels, so no source's
    rows are ever sorted or brought together; a bin (one of 16.7 million) is taken whole or not at all.

    Sources meet in one task, a row each, with bins of theirs: thousands of sources are fine, not one for each document.

    Null text: size 0, taken 0. Null source: a source of its own, named last. Repeated rows share
    a hash and so the decision. A long text counts whole, and is taken whole or not. Empty input: empty result. Other columns are ignored."""
    slim = _slim(docs, seed)
    by = decisions(slim, max_epochs)
    joined = slim.join(by, slim["source"].eqNullSafe(by["_source"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("long").alias("taken"))


def repeated(docs: DataFrame, seed: int = 7, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs, all columns, each as often as the mixture takes it."""
    by = decisions(_slim(docs, seed), max_epochs).select("_source", "whole", "_e1", "_e2")
    by = by.select(*[F.col(c).alias("_mix" + c) for c in by.columns])
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_s"), "doc_id")
    times = _binned(held, seed).join(by, F.col("_s").eqNullSafe(F.col("_mix_source"))).select("_row", "_b1", "_b2", F.col("_mixwhole").alias("whole"), F.col("_mix_e1").alias("_e1"), F.col("_mix_e2").alias("_e2"))
    out = times.select("_row", F.explode(F.array_repeat(F.lit(0), _times().cast("int"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


#: The same rows in SQL; bins of both levels at once.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {2 * LEVEL}) AS b FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS nth FROM s),
x AS (SELECT *, (nth - 1) % 3 + 1 AS weight, source_size * {MAX_EPOCHS} AS cap, source_size * (6 // ((nth - 1) % 3 + 1)) AS unit FROM w),
y AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weights
      FROM x WINDOW p AS (ORDER BY unit, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, cap * weights < rest * weight AS clamped FROM y),
t AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE
        CAST(sum(source_size) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS DOUBLE) * CAST(weight AS DOUBLE)
        / CAST(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM z),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT *, target - whole * source_size AS part FROM g),
b AS (SELECT source, b, sum(size) AS in_bin FROM d GROUP BY source, b),
c AS (SELECT *, coalesce(sum(in_bin) OVER (PARTITION BY source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
e AS (SELECT c.source, c.b, CASE WHEN before + in_bin / 2.0 <= part THEN 1 ELSE 0 END AS more FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source)
SELECT d.doc_id, d.size, h.source_size, h.target, CAST(d.size * (h.whole + e.more) AS BIGINT) AS taken
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.b = e.b
"""
