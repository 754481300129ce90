"""BM25 over an inverted index whose postings stand in blocks of bounded size.

Documents are dealt to buckets of some BLOCK_DOCS each; a token's postings of one bucket are a block, a row with the greatest count and
the least length in it. A token that every document has is as many rows as there are buckets, so neither building nor searching brings it into
one task, and the best score that a bucket can give a query is known before any of its postings is looked at."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, tokenize
from ..sources.staging import SMALL, fresh_path, staged

#: k1 and b by source (fixed values).
PARAMETERS = {"ocr": (0.6, 0.9), "asr": (1.5, 0.0), "object": (1.5, 0.75)}
DEFAULT = (1.5, 0.75)
BLOCK_DOCS = 1024
#: Into so many parts each token is split where postings are shuffled; buckets that a query looks into before its floor is set anew.
SALTS, STEPS = 32, (1, 8)
#: In place of a token that every document with text has: its blocks are the documents of the buckets. Pairs of probe and bucket that may be sent to every task.
EVERY, PAIRS = "", 1_000_000


@dataclass
class LexicalIndex:
    blocks: DataFrame  # token, bucket, n, most_tf, least_dl, entries: array of (doc, tf, dl)
    docs: DataFrame  # doc, dl
    terms: DataFrame  # token, df, idf
    corpus: DataFrame  # n, avgdl, buckets: one row


def read_index(spark, path: str) -> LexicalIndex:
    blocks, docs, terms, corpus = (spark.read.parquet(f"{path}/{name}") for name in ("blocks", "docs", "terms", "corpus"))
    return LexicalIndex(blocks.where(F.col("token") != EVERY), docs, terms, corpus)


def has_text(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def lengths(docs: DataFrame, folded: bool = False) -> DataFrame:
    """(doc, dl): the tokens of every row of docs(doc, text) with text that isn't blank. Nothing is shuffled or written."""
    text = F.col("text") if folded else fold(F.col("text"))
    return docs.where(has_text(F.col("text"))).select("doc", F.size(tokenize(text)).cast("long").alias("dl"))


def corpus_of(docs: DataFrame) -> DataFrame:
    """(n, avgdl) of docs(doc, dl): one row."""
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def asked_tokens(probes: DataFrame, folded: bool = False) -> DataFrame | None:
    """(token) of all probes(text), and EVERY; None if they are too many to be sent to every task."""
    text = F.col("text") if folded else fold(F.col("text"))
    found = staged(probes.select(F.explode_outer(F.concat(F.array(F.lit(EVERY)), tokenize(F.coalesce(text, F.lit(""))))).alias("token")).distinct(), "asked-tokens")
    return found if found.count() <= SMALL else None


def of_tokens(rows: DataFrame, only: DataFrame | None) -> DataFrame:
    return rows if only is None else rows.join(F.broadcast(only), "token", "left_semi")


def build(docs: DataFrame, path: str | None = None, folded: bool = False, block_docs: int = BLOCK_DOCS, only: DataFrame | None = None) -> LexicalIndex:
    """Index docs(doc, text) in the folder path: every row with text that isn't blank counts, even without tokens.

    Texts are shuffled once, by bucket; they are cut, counted and put in blocks where their bucket is. With only (asked_tokens of the probes that are
    to come) the other tokens count for lengths alone, which changes no score."""
    some = docs.where(has_text(F.col("text")))
    text = F.col("text") if folded else fold(F.col("text"))

    def counted(dealt: DataFrame) -> DataFrame:
        cut = dealt.select("bucket", "doc", tokenize(text).alias("tokens")).select("bucket", "doc", F.size("tokens").cast("long").alias("dl"), F.explode_outer(F.concat(F.array(F.lit(EVERY)), "tokens")).alias("token"))  # never empty; outer, or Spark would cut texts once more to see that
        return of_tokens(cut, only).groupBy("bucket", "token", "doc", "dl").agg(F.count("*").alias("tf"))

    return _built(some.select("doc", "text"), some.count(), counted, path, block_docs)


def build_counted(counts: DataFrame, path: str | None = None, block_docs: int = BLOCK_DOCS) -> LexicalIndex:
    """The same from counts(doc, token, tf), different tokens of each doc, which are folded; the row of EVERY, which each doc with text has, holds its length."""
    counts = staged(counts.select("doc", "token", F.col("tf").cast("long").alias("tf")), "token-counts")
    own = counts.where(F.col("token") == EVERY).select("doc", F.col("tf").alias("dl"))
    return _built(counts.join(own, "doc"), own.count(), lambda dealt: dealt, path, block_docs)


def _built(rows: DataFrame, n_docs: int, counted: Callable[[DataFrame], DataFrame], path: str | None, block_docs: int) -> LexicalIndex:
    """Rows with a doc are dealt to buckets; counted makes (bucket, doc, dl, token, tf) of them where they are."""
    spark = rows.sparkSession
    path = path or fresh_path(spark, "lexical-index")
    buckets = max(1, -(-n_docs // block_docs))
    parts = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")).repartition(parts, "bucket")
    entries = F.collect_list(F.struct("doc", "tf", "dl"))  # a token in a bucket has at most its documents
    blocks = counted(dealt).groupBy("bucket", "token").agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), entries.alias("entries"))
    blocks.select("token", "bucket", "n", "most_tf", "least_dl", "entries").sortWithinPartitions("token", "bucket").write.mode("overwrite").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.where(F.col("token") == EVERY).select(F.explode("entries").alias("e")).select("e.doc", "e.dl").write.mode("overwrite").parquet(f"{path}/docs")
    corpus_of(spark.read.parquet(f"{path}/docs")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/corpus")
    n, df = F.col("n"), F.col("df")
    terms = blocks.where(F.col("token") != EVERY).groupBy("token").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(spark.read.parquet(f"{path}/corpus").select("n")))
    terms.select("token", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")
    return read_index(spark, path)


def _asked(index: LexicalIndex, probes: DataFrame, folded: bool) -> DataFrame:
    """(query_id, probe_idx, token, idf): each known token of a probe once; staged, for it is small and read again."""
    text = F.col("text") if folded else fold(F.col("text"))
    tokens = probes.select("query_id", "probe_idx", F.explode(F.array_distinct(tokenize(text))).alias("token"))
    return staged(tokens.join(index.terms, "token").select("query_id", "probe_idx", "token", "idf"), "asked-tokens")


def _meet(asked: DataFrame, n_asked: int, blocks: DataFrame) -> DataFrame:
    """Blocks with the tokens asked. Few go to every task, and blocks stay where they are; many are shuffled by token and a part of its buckets."""
    if n_asked <= SMALL:
        return blocks.join(F.broadcast(asked), "token")
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.withColumn("salt", F.pmod("bucket", F.lit(SALTS))).join(salted, ["token", "salt"]).drop("salt")


def _part(tf: Column, dl: Column, k1: float, b: float) -> Column:
    length = F.when(F.col("avgdl") > 0, k1 * (1 - b + b * dl / F.col("avgdl"))).otherwise(0.0)
    return F.col("idf") * tf * (k1 + 1) / (tf + length)


def _scored(met: DataFrame, index: LexicalIndex, k1: float, b: float) -> DataFrame:
    """(query_id, probe_idx, doc, score) of all postings in met blocks."""
    hits = met.select("query_id", "probe_idx", "idf", F.explode("entries").alias("e")).crossJoin(F.broadcast(index.corpus.select("avgdl")))
    part = _part(F.col("e.tf"), F.col("e.dl"), k1, b)
    return hits.select("query_id", "probe_idx", F.col("e.doc").alias("doc"), part.alias("part")).groupBy("query_id", "probe_idx", "doc").agg(F.sum("part").alias("score"))


def search(index: LexicalIndex, probes: DataFrame, k1: float = DEFAULT[0], b: float = DEFAULT[1], folded: bool = False) -> DataFrame:
    """(query_id, probe_idx, doc, score) of the documents that share a token with a probe; each token of a probe counts once."""
    asked = _asked(index, probes, folded)
    return _scored(_meet(asked, asked.count(), index.blocks), index, k1, b)


def search_top(index: LexicalIndex, probes: DataFrame, k: int, k1: float = DEFAULT[0], b: float = DEFAULT[1], digits: int = 9, folded: bool = False) -> DataFrame:
    """(query_id, doc, score, rank): best_hits of search, of scores to `digits` decimals, without looking into buckets that cannot matter.

    A bucket's bound for a probe sums up its tokens' greatest scores there. A probe looks into the bucket of its greatest bound,
    then into the next best ones; with each step its k-th best score so far is a floor, and what is bounded below it goes. One query has one probe here."""
    asked = _asked(index, probes, folded)
    n_asked = asked.count()
    slim = _meet(asked, n_asked, index.blocks.drop("entries")).crossJoin(F.broadcast(index.corpus.select("avgdl", "buckets")))
    probe = ["query_id", "probe_idx"]
    bounds = staged(slim.groupBy(*probe, "bucket").agg(F.sum(_part(F.col("most_tf"), F.col("least_dl"), k1, b)).alias("bound"), F.first("buckets").alias("buckets")), "bucket-bounds")
    order = Window.partitionBy(*probe).orderBy(F.col("bound").desc(), "bucket")
    left = bounds.withColumn("nth", F.row_number().over(order))
    found, floors, seen = None, None, 0

    def scores(some: DataFrame | None) -> DataFrame:
        met = _meet(asked, n_asked, index.blocks)
        if some is not None:  # blocks stay where they are
            met = met.join(F.broadcast(some.select(*probe, "bucket")), [*probe, "bucket"], "left_semi")
        return best_hits(_scored(met, index, k1, b).withColumn("score", F.round("score", digits)), k).drop("rank")

    n_pairs = bounds.count()
    if n_pairs > PAIRS:  # too many to be told apart in every task: all are looked into
        return best_hits(scores(None), k)
    for step in STEPS if bounds.where(F.col("buckets") > STEPS[-1]).limit(1).count() else ():
        some = left.where(F.col("nth").between(seen + 1, step))
        if floors is not None:
            some = some.join(floors, probe, "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor")))
        got = scores(some)
        found = staged(best_hits(got if found is None else got.unionByName(found), k).drop("rank"), "best-so-far")
        floors = found.groupBy(*probe).agg(F.count("*").alias("held"), F.min("score").alias("floor")).where(F.col("held") >= k).select(*probe, "floor")
        seen = step
    rest = left.where(F.col("nth") > seen)
    if floors is not None:
        rest = rest.join(floors, probe, "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor")))
    got = scores(rest)
    return best_hits(got if found is None else got.unionByName(found), k)


def best_hits(hits: DataFrame, k: int) -> DataFrame:
    """Per query the k best by score, ties by the document's name as text."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc").cast("string"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Sparse:
    """A source by its hits(query_id, probe_idx, row_id, score), scores above zero, and the rows(row_id) that it covers."""

    hits: DataFrame
    covered: DataFrame


def text_source(texts: DataFrame | None, probes: DataFrame, source: str, k1: float | None = None, b: float | None = None, index: LexicalIndex | None = None) -> Sparse:
    """What texts(row_id, text) of frames, or an index of them that is there already, say to the probes; matrix.ScoreMatrix spells it out.

    Frames without text are not covered; a blank probe has no hits and leaves coverage as it is."""
    own = PARAMETERS.get(source, DEFAULT)
    index = index or build(texts.select(F.col("row_id").alias("doc"), "text"))
    hits = search(index, probes, own[0] if k1 is None else k1, own[1] if b is None else b)
    return Sparse(hits.withColumnRenamed("doc", "row_id"), index.docs.select(F.col("doc").alias("row_id")))
