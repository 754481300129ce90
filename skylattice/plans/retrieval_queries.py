"""Queries over vectors, text, fusion and pools, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import frame_index, fusion, lexical, matrix, nearest, pooling, rerank, sequence
from ..sources.staging import fresh_path
from . import hybrid
from .binding import Tables, sql

QUERIES, ORACLES = {}, {}


def query(statement: str | None = None):
    def note(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if statement:
            ORACLES[f.__name__] = statement
        return f

    return note


def _steady(scores: DataFrame) -> DataFrame:
    """Scores to nine decimals, so that rounding in sums does not decide ties."""
    return scores.withColumn("score", F.round("score", 9))


_TOP = "SELECT query_id, rank, row_id, round(score, 6) AS score FROM ranked WHERE rank <= 20"


@query(sql(_TOP, "ranked"))
def vector_topk(t: Tables) -> DataFrame:
    return nearest.top_k(_steady(t.visual), 20).select("query_id", "rank", "row_id", F.round("score", 6).alias("score"))


@query(sql(_TOP, "ranked"))
def vector_scan_topk(t: Tables) -> DataFrame:
    return nearest.scan_top_k(t.frames, t.asked, 20, digits=9).select("query_id", "rank", "row_id", F.round("score", 6).alias("score"))


@query(
    sql(
        "SELECT query_id, CAST(rank AS INT) AS rank, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM cut) WHERE rank <= 20",
        "frames", "asked",
        fu="SELECT row_id, list_transform(emb[1:32], lambda x: x / greatest(sqrt(list_inner_product(emb[1:32], emb[1:32])), 1e-12)) AS v FROM frames",
        qu="SELECT query_id, list_transform(vector[1:32], lambda x: x / greatest(sqrt(list_inner_product(vector[1:32], vector[1:32])), 1e-12)) AS w FROM asked",
        cut="SELECT query_id, row_id, list_inner_product(v, w) AS score FROM fu, qu",
    )
)
def vector_truncate_topk(t: Tables) -> DataFrame:
    short = lambda c: vectors.truncate_and_normalize(F.col(c), 32).alias(c)
    found = nearest.scan_top_k(t.frames.select("row_id", short("emb")), t.asked.select("query_id", "probe_idx", short("vector")), 20, digits=9)
    return found.select("query_id", "rank", "row_id", F.round("score", 6).alias("score"))


@query("SELECT label, count(*) AS vectors, count(*) FILTER (WHERE abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.01) AS unit FROM embeddings GROUP BY label")
def vector_norm_check(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count("*").alias("vectors"), F.sum(vectors.is_unit(F.col("embedding")).cast("long")).alias("unit"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS l1 FROM embeddings")
def vector_normalize(t: Tables) -> DataFrame:
    unit = vectors.l2_normalize(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query(sql("SELECT video_id, min(row_id) AS lo, max(row_id) + 1 AS hi, count(*) AS frames FROM r GROUP BY video_id", "frames", r="SELECT row_number() OVER (ORDER BY video_id, n) - 1 AS row_id, video_id FROM frames"))
def index_ranges(t: Tables) -> DataFrame:
    f = t.frames
    built = frame_index.build(f.select("video_id", "n", "emb"), f.select("video_id", "n", "frame_idx"))
    return frame_index.ranges(built).join(built.groupBy("video_id").agg(F.count("*").alias("frames")), "video_id")


@query(sql("SELECT row_id AS doc_id, CAST(len(toks) AS INT) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM docs", "docs"))
def fold_tokenize(t: Tables) -> DataFrame:
    tokens = text.tokenize(text.fold(F.col("text")))
    return t.documents.where(lexical.has_text(F.col("text"))).select("doc_id", F.size(tokens).alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


@query(f"SELECT lang, count(*) FILTER (WHERE regexp_matches(lower(text), '[{text.ACCENTED}]')) AS unfolded FROM documents GROUP BY lang")
def looks_unfolded(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.sum(F.coalesce(text.looks_unfolded(F.col("text")).cast("long"), F.lit(0))).alias("unfolded"))


def _index(t: Tables) -> lexical.LexicalIndex:
    return t.built("index-documents", lambda: lexical.build(t.documents.select(F.col("doc_id").alias("doc"), "text"), fresh_path(t.spark, "index-documents")), "documents")


@query(sql("SELECT count(*) AS n, round(avg(len(toks)), 6) AS avgdl FROM docs", "docs"))
def corpus_lengths(t: Tables) -> DataFrame:
    return lexical.corpus_of(doc_lengths(t)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(sql("SELECT row_id AS doc, CAST(len(toks) AS BIGINT) AS dl FROM docs", "docs"))
def doc_lengths(t: Tables) -> DataFrame:
    return lexical.lengths(t.documents.select(F.col("doc_id").alias("doc"), "text"))


_TF = "SELECT row_id, tok, count(*) AS tf FROM (SELECT row_id, unnest(toks) AS tok FROM docs) GROUP BY ALL"
_N = "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs"
_IDF = "SELECT tok, count(*) AS df, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, nn GROUP BY tok"


@query(sql("SELECT tok AS token, df, round(idf, 6) AS idf FROM idf", "docs", tf=_TF, nn=_N, idf=_IDF))
def term_df_idf(t: Tables) -> DataFrame:
    return _index(t).terms.select("token", "df", F.round("idf", 6).alias("idf"))


def _bm25_sql(k1: float, b: float) -> str:
    return sql(
        "SELECT query_id, CAST(rank AS INT) AS rank, row_id AS doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, CAST(row_id AS VARCHAR)) AS rank FROM hit) WHERE rank <= 20",
        "docs", tf=_TF, nn=_N, idf=_IDF, ask="SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[a-z0-9]+')) AS tok FROM benchmark",
        hit=f"SELECT query_id, row_id, sum(idf * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * len(toks) / avgdl))) AS score FROM ask JOIN idf USING (tok) JOIN tf USING (tok) JOIN docs USING (row_id), nn GROUP BY query_id, row_id",
    )


def _bm25(t: Tables, k1: float, b: float) -> DataFrame:
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.lit(0).alias("probe_idx"), "text")
    return lexical.search_top(_index(t), asked, 20, k1, b).select("query_id", "rank", "doc", F.round("score", 6).alias("score"))


@query(_bm25_sql(1.5, 0.75))
def bm25_search(t: Tables) -> DataFrame:
    return _bm25(t, *lexical.DEFAULT)


@query(_bm25_sql(0.6, 0.9))
def bm25_params_ocr(t: Tables) -> DataFrame:
    return _bm25(t, *lexical.PARAMETERS["ocr"])


@query(_bm25_sql(1.5, 0.0))
def bm25_params_asr(t: Tables) -> DataFrame:
    return _bm25(t, *lexical.PARAMETERS["asr"])


@query(sql("SELECT query_id, row_id, round(score, 6) AS score, covered FROM ocr", "ocr"))
def text_source(t: Tables) -> DataFrame:
    one = matrix.ScoreMatrix(t.frames, t.asked, {"ocr": t.text_source("ocr")}, visual=None, digits=12)
    return one.scores().select("query_id", "row_id", F.round("score", 6).alias("score"), "covered")


@query(sql("SELECT source, round(avg(CAST(covered AS INT)), 6) AS coverage FROM scores GROUP BY source", "scores"))
def coverage_fraction(t: Tables) -> DataFrame:
    return t.matrix.coverage().select("source", F.round("coverage", 6).alias("coverage"))


@query(sql("SELECT query_id, source, row_id, round(z, 6) AS z FROM zs", "zs"))
def z_normalize(t: Tables) -> DataFrame:
    return t.matrix.scores().select("query_id", "source", "row_id", F.round("z", 6).alias("z"))


@query(
    sql(
        """SELECT query_id, source, row_id, round(CASE WHEN covered AND n > 1 THEN (r - 1 + (c - 1) / 2.0) / greatest(1, n - 1) - 0.5 ELSE 0.0 END, 6) AS z FROM
        (SELECT *, rank() OVER (PARTITION BY query_id, source, covered ORDER BY score) AS r, count(*) OVER (PARTITION BY query_id, source, covered, score) AS c, count(*) OVER (PARTITION BY query_id, source, covered) AS n FROM scores)""",
        "scores",
    )
)
def rank_normalize(t: Tables) -> DataFrame:
    return fusion.rank_normalize(t.matrix.scores().drop("z")).select("query_id", "source", "row_id", F.round("z", 6).alias("z"))


@query(sql("SELECT query_id, row_id, round(s, 6) AS s FROM fused", "fused"))
def fuse(t: Tables) -> DataFrame:
    return t.matrix.fused().select("query_id", "row_id", F.round("s", 6).alias("s"))


@query(sql("SELECT row_id, round(max(s), 6) AS s FROM fused GROUP BY row_id", "fused"))
def best_over_probes(t: Tables) -> DataFrame:
    """Every label's query as a probe of one query."""
    one = t.matrix.fused().withColumn("query_id", F.lit(0))
    return fusion.best_over_probes(one).select("row_id", F.round("s", 6).alias("s"))


def _fused(t: Tables) -> DataFrame:
    """Fused scores of all frames."""
    return t.matrix.fused()


def _nominated(t: Tables) -> DataFrame:
    return t.nominated


@query(sql("SELECT query_id, source, row_id, CAST(nth AS INT) AS nth FROM quota", "quota"))
def pool_quota(t: Tables) -> DataFrame:
    return _nominated(t).select("query_id", "source", "row_id", "nth")


@query(sql("SELECT query_id, source, count(*) AS nominated FROM quota GROUP BY ALL", "quota"))
def pool_counts(t: Tables) -> DataFrame:
    return pooling.nomination_counts(_nominated(t))


def _pool(t: Tables, cap: int | None) -> DataFrame:
    base = fusion.best_over_probes(t.fused_nominated).withColumn("s", F.round("s", 9))
    return pooling.union_pool(_nominated(t), base, cap)


@query(sql("SELECT query_id, row_id, prov, agree FROM pool", "pool"))
def pool_provenance(t: Tables) -> DataFrame:
    return _pool(t, None).select("query_id", "row_id", F.col("prov").cast("int").alias("prov"), "agree")


@query(sql("SELECT query_id, row_id, CAST(pool_rank AS INT) AS pool_rank, round(s, 6) AS s FROM pool WHERE pool_rank <= 30", "pool"))
def pool_cap(t: Tables) -> DataFrame:
    return _pool(t, 30).select("query_id", "row_id", "pool_rank", F.round("s", 6).alias("s"))


@query(sql("SELECT query_id, count(*) AS rows_all, count(*) FILTER (WHERE row_id IN (SELECT p.row_id FROM pool p WHERE p.query_id = f.query_id)) AS pooled FROM fused f GROUP BY query_id", "pool"))
def pool_mask(t: Tables) -> DataFrame:
    flagged = pooling.in_pool(fusion.best_over_probes(_fused(t)), _pool(t, None))
    return flagged.groupBy("query_id").agg(F.count("*").alias("rows_all"), F.sum(F.col("pooled").cast("long")).alias("pooled"))


@query(sql("SELECT min(n) AS least, max(n) AS most, median(n) AS middle FROM (SELECT query_id, count(*) AS n FROM pool GROUP BY query_id)", "pool"))
def pool_sizes(t: Tables) -> DataFrame:
    sizes = _pool(t, None).groupBy("query_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("middle"))


@query(sql("SELECT query_id, row_id, CAST(rn AS INT) AS short_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id) AS rn FROM fused) WHERE rn <= 160", "fused"))
def vlm_shortlist(t: Tables) -> DataFrame:
    base = fusion.best_over_probes(_fused(t)).withColumn("s", F.round("s", 9))
    return rerank.shortlist(base).select("query_id", "row_id", "short_rank")


_VLM = "SELECT p.query_id, p.row_id, CAST((p.row_id * 7 + p.query_id) % 11 AS DOUBLE) / 10 AS score FROM pool p"


@query(
    sql(
        """SELECT f.query_id, f.row_id, round((f.s - bm.mu) / bm.sd + 0.25::DOUBLE * CASE WHEN v.score IS NULL OR vm.sd < 1e-9 THEN 0 ELSE (v.score - vm.mu) / vm.sd END, 6) AS s
        FROM fused f JOIN bm USING (query_id) JOIN vm USING (query_id) LEFT JOIN v ON v.query_id = f.query_id AND v.row_id = f.row_id""",
        "pool", v=_VLM, bm="SELECT query_id, avg(s) AS mu, stddev_pop(s) AS sd FROM fused GROUP BY query_id", vm="SELECT query_id, avg(score) AS mu, stddev_pop(score) AS sd FROM v GROUP BY query_id",
    )
)
def rerank_combine(t: Tables) -> DataFrame:
    """A stand-in model scores the pool; its scores join those of all frames."""
    seen = _pool(t, None).select("query_id", F.lit(0).alias("probe_idx"), F.lit("vlm").alias("source"), "row_id", (((F.col("row_id") * 7 + F.col("query_id")) % 11).cast("double") / 10).alias("score"), F.lit(True).alias("covered"))
    return rerank.combine(_fused(t), seen).select("query_id", "row_id", F.round("s", 6).alias("s"))


@query(sql("SELECT query_id, row_id, round(greatest(list_inner_product(emb, vector), list_inner_product(list_reverse(emb), vector)), 6) AS score FROM frames, asked", "frames", "asked"))
def crop_max(t: Tables) -> DataFrame:
    """Two crops a frame: its vector, and that turned round."""
    both = t.frames.select("row_id", F.explode(F.array("emb", F.reverse("emb"))).alias("vec"))
    return rerank.crop_source(both, t.asked).select("query_id", "row_id", F.round("score", 6).alias("score"))


@query(
    """SELECT row_id, entity, CAST(pos AS INT) AS pos, round(area, 6) AS area FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY area DESC, pos) AS nth FROM
    (SELECT l_orderkey AS row_id, l_returnflag AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity / 50, l_discount * 10) AS pos, (l_quantity / 50) * (l_discount * 10) AS area FROM lineitem) WHERE area >= 0.01) WHERE nth <= 2"""
)
def crop_boxes(t: Tables) -> DataFrame:
    """An order as a frame, its lines as boxes."""
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") / 50, F.col("l_discount") * 10)
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", box.alias("box")))).alias("b"))
    objects = lines.select(F.lit("v").alias("video_id"), F.col("l_orderkey").alias("n"), F.col("b.l_returnflag").alias("detection_class_entities"), F.col("b.box").alias("detection_boxes"))
    found = rerank.crops(objects, lines.select(F.lit("v").alias("video_id"), F.col("l_orderkey").alias("n"), F.col("l_orderkey").alias("row_id")))
    return found.select("row_id", "entity", (F.col("pos") + 1).alias("pos"), F.round("area", 6).alias("area"))


@query(
    sql(
        """SELECT query_id, video_id, frame_idx AS f0, round(round(s, 9), 6) AS score, CAST(rn AS INT) AS answer_rank FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, video_id, frame_idx) AS rn FROM pool JOIN frames USING (row_id) WHERE pool_rank <= 200) WHERE rn <= 100""",
        "pool",
    )
)
def hybrid_kis(t: Tables) -> DataFrame:
    """The flagship: vectors, text, speech and objects, fusion, pool, ranked answers."""
    fused, pool = hybrid.retrieve(t.matrix, hybrid.Settings(per_video=10))
    fused = fused.withColumn("s", F.round("s", 9))
    return hybrid.answer(t.frames, fused, pool, 1).select("query_id", "video_id", "f0", F.round("score", 6).alias("score"), "answer_rank")


@query(sql("SELECT query_id, video_id, frame_idx AS f0, CAST(rn AS INT) AS answer_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s0, 9) DESC, video_id, frame_idx) AS rn FROM triple) WHERE rn <= 100", "triple"))
def kis_emit(t: Tables) -> DataFrame:
    from .sequence_queries import triples

    pool = triples(t).withColumn("s0", F.round("s0", 9))
    return sequence.emit(pool, 1).select("query_id", "video_id", "f0", "answer_rank")
