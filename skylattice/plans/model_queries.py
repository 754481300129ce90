"""Queries over steps that models make (with stand-ins that SQL can follow), and over what surrounds them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import answering, frame_index, fusion, intervals, models, pooling, rerank, scoring, sequence
from ..operators import images as stored_images
from ..sources import files, writers
from ..sources.staging import fresh_path
from . import hybrid, sequence_queries
from .binding import Tables, sql
from .retrieval_queries import _fused, _nominated, _pool

QUERIES, ORACLES = {}, {}


def query(statement: str):
    def note(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = statement
        return f

    return note


LETTERS = "abcdefgh"


class LetterEncoder:
    """A stand-in: how often each of eight letters occurs."""

    dim = len(LETTERS)

    def encode(self, values: list) -> np.ndarray:
        return np.array([[v.lower().count(c) for c in LETTERS] for v in values], np.float64)


_COUNTS = "list_transform(string_split('abcdefgh', ''), lambda c: CAST(len(lower(text)) - len(replace(lower(text), c, '')) AS DOUBLE))"
_L1 = "round(list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))), 2)"


@query(f"SELECT doc_id, {_L1} AS l1 FROM (SELECT doc_id, {_COUNTS} AS v FROM documents WHERE text IS NOT NULL)")
def encode_texts(t: Tables) -> DataFrame:
    """Whole texts through an encoder."""
    out = models.encoded(t.documents.select("doc_id", "text"), "text", LetterEncoder, LetterEncoder.dim)
    return out.select("doc_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("l1"))


@query(f"SELECT key, {_L1} AS l1 FROM (SELECT left(sha1(text), 16) AS key, any_value({_COUNTS}) AS v FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0' AND text IS NOT NULL) GROUP BY text)")
def encode_missing(t: Tables) -> DataFrame:
    """Different texts that a cache filled by one source lacks go through the encoder."""
    keyed = t.documents.where("text is not null").select("source", text.cache_key(F.col("text")).alias("key"), "text")
    out = models.encode_missing(keyed, keyed.where("source = 'src0'").select("key").distinct(), LetterEncoder, LetterEncoder.dim)
    return out.select("key", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("l1"))


@query(
    """SELECT row_id, l AS "left", t AS top, r AS "right", b AS bottom, greatest(1, CAST(round_even((r - l) * least(1.0, 336.0 / greatest(r - l, b - t)), 0) AS INT)) AS crop_width, greatest(1, CAST(round_even((b - t) * least(1.0, 336.0 / greatest(r - l, b - t)), 0) AS INT)) AS crop_height FROM
    (SELECT row_id, CAST(trunc(least(1.0, greatest(0.0, x0 - (x1 - x0) * 0.06::DOUBLE)) * w) AS INT) AS l, CAST(trunc(least(1.0, greatest(0.0, y0 - (y1 - y0) * 0.06::DOUBLE)) * h) AS INT) AS t, CAST(trunc(least(1.0, greatest(0.0, x1 + (x1 - x0) * 0.06::DOUBLE)) * w) AS INT) AS r, CAST(trunc(least(1.0, greatest(0.0, y1 + (y1 - y0) * 0.06::DOUBLE)) * h) AS INT) AS b FROM
      (SELECT CAST(p_partkey AS BIGINT) AS row_id, 0.25::DOUBLE AS y0, p_size % 10 / 20.0::DOUBLE AS x0, 0.25::DOUBLE + p_partkey % 50 / 80.0::DOUBLE AS y1, p_size % 10 / 20.0::DOUBLE + p_size / 100.0::DOUBLE AS x1, 320 + CAST(p_partkey % 7 AS INT) * 200 AS w, 240 + CAST(p_partkey % 5 AS INT) * 200 AS h FROM part)) WHERE least(r - l, b - t) >= 24"""
)
def crop_plan(t: Tables) -> DataFrame:
    """A part as an image with one box: pixels, crops that are too small, and the size a model gets."""
    key, x0 = F.col("p_partkey").cast("long"), F.col("p_size") % 10 / F.lit(20.0)
    box = F.array(F.lit(0.25), x0, F.lit(0.25) + key % 50 / F.lit(80.0), x0 + F.col("p_size") / F.lit(100.0))
    sizes = t.part.select(key.alias("row_id"), (320 + key % 7 * 200).cast("int").alias("width"), (240 + key % 5 * 200).cast("int").alias("height"))
    return models.crop_plan(t.part.select(key.alias("row_id"), box.alias("box")), sizes, numbers.pixel_box).drop("box")


# -- questions ----------------------------------------------------------------


@query(sql("SELECT query_id, arg_min(row_id, (-round(s, 9), row_id)) AS row_id FROM (SELECT query_id, row_id, s FROM fused) GROUP BY query_id", "fused"))
def qa_top1(t: Tables) -> DataFrame:
    return answering.best_row(_fused(t).withColumn("s", F.round("s", 9)))


def _reader():
    from hashlib import md5

    digest = lambda text: md5(text.encode()).hexdigest()
    return lambda question, ocr, speech, image: f"{digest(question)} {digest(ocr)}  {digest(speech)}"


_READ = "left(md5(a.text) || ' ' || md5(left(coalesce(d.text, ''), 300)) || ' ' || md5(left(coalesce(r.text, ''), 400)), 120)"


@query(sql(f"SELECT query_id, {_READ} AS answer FROM (SELECT query_id, arg_min(row_id, (-round(s, 9), row_id)) AS row_id FROM fused GROUP BY query_id) b JOIN asked a USING (query_id) LEFT JOIN documents d ON d.doc_id = b.row_id LEFT JOIN around r ON r.row_id = b.row_id", "fused", "around"))
def qa_answers(t: Tables) -> DataFrame:
    """The best frame of each question, what stands on it and is said around it, and what a stand-in reader makes of that."""
    best = answering.best_row(_fused(t).withColumn("s", F.round("s", 9)))
    seen = answering.contexts(best, t.frames, t.texts("ocr"), t.speech)
    asked = seen.join(t.asked.select("query_id", F.col("text").alias("question")), "query_id").withColumn("image", F.lit(None).cast("binary"))
    return models.answered(asked, _reader)


@query("SELECT item_id, 'Truy' AS head, md5(trim(array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' '))) AS digest FROM benchmark")
def write_queries(t: Tables) -> DataFrame:
    """A stand-in writes all words of a passage under a heading and in quotes, which are cleaned away."""
    write = lambda: lambda rows: ['Truy vấn: "' + " ".join([w for w in x.split(" ") if w]) + '"' for x in rows["passage"]]
    out = models.written_queries(t.benchmark.select("item_id", F.col("text").alias("passage")), write, text.clean_generated)
    return out.select("item_id", F.lit("Truy").alias("head"), F.md5(F.trim("text")).alias("digest"))


@query(f"SELECT source AS video_id, CAST(doc_id AS INT) AS n, {_L1} AS l1 FROM (SELECT source, doc_id, {_COUNTS} AS v FROM documents WHERE text IS NOT NULL)")
def encode_resumed(t: Tables) -> DataFrame:
    """A source as a video. A run over every other document, one that was killed before it committed, one that stopped after
    a group of videos, and one to the end: what is read is whole and of the last run that had a say."""
    store = writers.video_shards(t.spark, fresh_path(t.spark, "encoded"))
    frames = t.documents.where("text is not null").select(F.col("source").alias("video_id"), F.col("doc_id").cast("int").alias("n"), "text")
    rows = max(1, frames.count() // 3)
    models.encode_pending(frames.where("n % 2 = 0"), store, "text", LetterEncoder, LetterEncoder.dim, rows)
    store.append(frames.select("video_id", "n", F.array(F.lit(9.0).cast("float")).alias("vector")), commit=False)
    models.encode_pending(frames, store, "text", LetterEncoder, LetterEncoder.dim, rows, groups=1)
    models.encode_pending(frames, store, "text", LetterEncoder, LetterEncoder.dim, rows)
    return store.read().select("video_id", "n", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("l1"))


class PixelEncoder:
    """A stand-in: how bright an image is, how bright its right side, how large it is."""

    dim = 3

    def encode(self, values: list) -> np.ndarray:
        return np.array([[p.sum(), (p.sum(axis=(0, 2), dtype=np.float64) * np.arange(p.shape[1])).sum() / 100, p.shape[0] * p.shape[1] * 100.0] for p in values], np.float64)


_BOXES = """SELECT CAST(s_suppkey AS BIGINT) AS row_id, CAST(pos AS INT) AS pos, 60 + CAST(s_suppkey % 7 AS INT) * 10 AS w, 50 + CAST(s_suppkey % 5 AS INT) * 10 AS h, 0.1::DOUBLE AS y0, 0.05::DOUBLE + pos * 0.2::DOUBLE AS x0,
    0.45::DOUBLE + s_suppkey % 9 / 20.0::DOUBLE AS y1, 0.5::DOUBLE + pos * 0.2::DOUBLE + s_suppkey % 4 / 20.0::DOUBLE AS x1 FROM supplier, (SELECT unnest([0, 1]) AS pos) WHERE s_suppkey % 10 NOT IN (0, 5)"""


@query(
    f"""SELECT row_id, pos, round(CAST(a / m AS FLOAT)::DOUBLE, 4) AS bright, round(CAST(b / m AS FLOAT)::DOUBLE, 4) AS to_right, round(CAST(c / m AS FLOAT)::DOUBLE, 4) AS size FROM (SELECT *, sqrt(a * a + b * b + c * c) AS m FROM
    (SELECT row_id, pos, CAST(sum(p) AS FLOAT)::DOUBLE AS a, CAST(CAST(sum(p * (x - l)) AS DOUBLE) / 100 AS FLOAT)::DOUBLE AS b, CAST(count(*) * 100 AS FLOAT)::DOUBLE AS c FROM (SELECT *, (3 * x + 5 * y + row_id) % 256 AS p FROM
      (SELECT *, unnest(range(t, b)) AS y FROM (SELECT *, unnest(range(l, r)) AS x FROM (SELECT row_id, pos, CAST(trunc(least(1.0, greatest(0.0, x0 - (x1 - x0) * 0.06::DOUBLE)) * w) AS INT) AS l, CAST(trunc(least(1.0, greatest(0.0, y0 - (y1 - y0) * 0.06::DOUBLE)) * h) AS INT) AS t,
        CAST(trunc(least(1.0, greatest(0.0, x1 + (x1 - x0) * 0.06::DOUBLE)) * w) AS INT) AS r, CAST(trunc(least(1.0, greatest(0.0, y1 + (y1 - y0) * 0.06::DOUBLE)) * h) AS INT) AS b FROM ({_BOXES})) WHERE least(r - l, b - t) >= 24))) GROUP BY row_id, pos))"""
)
def crop_vectors(t: Tables) -> DataFrame:
    """A supplier as a stored image with two boxes: a tenth of the images are missing, a tenth are broken. Images are cut and encoded where they are read."""
    path, k = fresh_path(t.spark, "pictures"), F.col("s_suppkey").cast("long")
    wide, high = (60 + k % 7 * 10).cast("int"), (50 + k % 5 * 10).cast("int")
    # pixel (x, y) is 3 x + 5 y + k (mod 256): each line is a part of one run of threes, from 171 (5 y + k), as 3 times 171 is 1
    threes = F.lit("".join(f"{3 * x % 256:02X}" for x in range(256 + 120)))
    line = F.transform(F.sequence(F.lit(0), high - 1), lambda y: F.substring(threes, (171 * (5 * y + k) % 256 * 2 + 1).cast("int"), wide * 2))
    data = F.concat(F.encode(F.format_string("P5 %d %d 255\n", wide, high), "UTF-8"), F.unhex(F.array_join(line, "")))
    images = files.dealt(t.supplier, "s_suppkey").select(k.alias("row_id"), F.concat(F.lit(f"{path}/"), k.cast("string"), F.lit(".pgm")).alias("path"), F.when(k % 10 == 5, F.substring(data, 1, 100)).otherwise(data).alias("content"))
    files.write_files(images.where("row_id % 10 <> 0"))
    low, left = F.lit(0.1), F.lit(0.05) + F.col("pos") * 0.2
    box = F.array(low, left, F.lit(0.45) + k % 9 / F.lit(20.0), F.lit(0.5) + F.col("pos") * 0.2 + k % 4 / F.lit(20.0))
    boxes = t.supplier.withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).select(k.alias("row_id"), "pos", box.alias("box"))
    found = stored_images.crop_vectors(boxes, images.select("row_id", "path"), stored_images.Netpbm, PixelEncoder, PixelEncoder.dim)
    return found.select("row_id", "pos", *[F.round(F.col("vec")[i].cast("double"), 4).alias(c) for i, c in enumerate(("bright", "to_right", "size"))])


class PoolModel:
    """A stand-in for a model of two answers; it fails on some images."""

    def tokens(self, text: str) -> list[int]:
        return [{"0": 0, "1": 1}[text]]

    def logits(self, jobs: list[dict]) -> np.ndarray:
        if any(j["image"] is None for j in jobs):
            raise RuntimeError("no image")
        return np.array([[j["row_id"] % 7 / 2, (j["row_id"] * 7 + j["query_id"]) % 11 / 3 + len(j["image"]) * 300] for j in jobs], np.float64)


@query(
    sql(
        """SELECT query_id, row_id, round(CASE WHEN row_id % 3 = 0 THEN 1.0 ELSE 1 / (1 + exp(row_id % 7 / 2.0::DOUBLE - (row_id * 7 + query_id) % 11 / 3.0::DOUBLE)) END, 9) AS score FROM pool WHERE row_id % 10 <> 9""",
        "pool",
    )
)
def token_scores(t: Tables) -> DataFrame:
    """The pool before a model that answers by one of two tokens. Rows without an image fail by themselves; a third of the rows come again, with another image."""
    rows = _pool(t, None).select("query_id", F.lit(0).alias("probe_idx"), "row_id")
    first = rows.select("*", F.lit(0).alias("seq"), F.when(F.col("row_id") % 10 != 9, F.lit("").cast("binary")).alias("image"))
    again = rows.where("row_id % 3 = 0 and row_id % 10 <> 9").select("*", F.lit(1).alias("seq"), F.lit("four").cast("binary").alias("image"))
    return rerank.token_scores(first.unionByName(again), PoolModel, batch=1).select("query_id", "row_id", F.round("score", 9).alias("score"))


@query(sql("SELECT query_id, row_id, CAST(rn AS INT) AS short_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id) AS rn FROM fused WHERE query_id % 3 <> 0) WHERE rn <= 160", "fused"))
def model_rows(t: Tables) -> DataFrame:
    """Every third query is one of a sequence: no model looks at it."""
    base = fusion.best_over_probes(_fused(t)).withColumn("s", F.round("s", 9))
    kinds = t.asked.select("query_id", F.when(F.col("query_id") % 3 == 0, "trake").otherwise("kis").alias("kind"))
    return rerank.model_rows(base, kinds).select("query_id", "row_id", "short_rank")


@query(sql("SELECT query_id, 0 AS probe_idx, row_id, (row_id * 7 + query_id) % 11 / 10.0::DOUBLE AS score FROM pool WHERE pool_rank <= 30", "pool"))
def model_scores(t: Tables) -> DataFrame:
    """A stand-in scorer, batch by batch, over the pool."""
    rows = _pool(t, 30).select("query_id", F.lit(0).alias("probe_idx"), "row_id")
    return rerank.model_scores(rows, lambda b: (b["row_id"] * 7 + b["query_id"]) % 11 / 10).select("query_id", "probe_idx", "row_id", "score")


# -- policies, sweeps, funnels ------------------------------------------------

_TRUE = "SELECT CAST(label AS BIGINT) AS query_id, vec_id AS row_id FROM embeddings WHERE vec_id % 10 = 3"


def _true(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 10 = 3").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("row_id"))


@query(sql("SELECT query_id, row_id, CAST(k AS INT) AS pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id) AS k FROM (SELECT f.query_id, f.row_id, s, row_number() OVER (PARTITION BY f.query_id, video_id ORDER BY round(s, 9) DESC, f.row_id) AS v FROM fused f JOIN frames USING (row_id)) WHERE v <= 4) WHERE k <= 25", "fused"))
def policy_fused(t: Tables) -> DataFrame:
    base = fusion.best_over_probes(_fused(t)).withColumn("s", F.round("s", 9))
    return pooling.fused_first(base, t.frames, 25, 4).select("query_id", "row_id", "pool_rank")


@query(
    sql(
        """SELECT query_id, row_id, CAST(pool_rank AS INT) AS pool_rank, reason FROM core UNION ALL SELECT query_id, row_id, CAST(20 + k AS INT), pick.source || '_rescue' FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pick.nth, round(s, 9) DESC, row_id) AS k FROM
          (SELECT query_id, row_id, min({'nth': nth, 'source': source}) AS pick FROM quota GROUP BY query_id, row_id) JOIN fused USING (query_id, row_id) WHERE (query_id, row_id) NOT IN (SELECT (query_id, row_id) FROM core)) WHERE k <= 20""",
        "fused", "quota", core="SELECT *, 'fused' AS reason FROM (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, row_id) AS pool_rank FROM fused) WHERE pool_rank <= 20",
    )
)
def policy_rescued(t: Tables) -> DataFrame:
    base = fusion.best_over_probes(_fused(t)).withColumn("s", F.round("s", 9))
    return pooling.rescued(base, _nominated(t), t.frames, 40).select("query_id", "row_id", "pool_rank", "reason")


@query(
    sql(
        """SELECT q.query_id, CASE WHEN best <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_10, CASE WHEN best <= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_50, CASE WHEN best <= 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_200, CAST(best AS INT) AS best_rank, CAST(coalesce(len(s), 0) AS INT) AS sources, CASE WHEN len(s) = 1 THEN s[1] END AS only
        FROM (SELECT DISTINCT query_id FROM truth) q LEFT JOIN (SELECT p.query_id, min(pool_rank) AS best FROM pool p JOIN truth t ON t.query_id = p.query_id AND t.row_id = p.row_id GROUP BY p.query_id) b USING (query_id)
        LEFT JOIN (SELECT n.query_id, list_sort(list(DISTINCT source)) AS s FROM quota n JOIN truth t ON t.query_id = n.query_id AND t.row_id = n.row_id GROUP BY n.query_id) x USING (query_id)""",
        "pool", truth=_TRUE,
    )
)
def candidate_funnel(t: Tables) -> DataFrame:
    return scoring.funnel(_nominated(t), _pool(t, None), _true(t))


@query(sql("SELECT one, other, round(common / CAST(a.n + b.n - common AS DOUBLE), 9) AS jaccard FROM (SELECT x.source AS one, y.source AS other, count(*) AS common FROM quota x JOIN quota y ON x.query_id = y.query_id AND x.row_id = y.row_id AND x.source < y.source GROUP BY ALL) JOIN (SELECT source AS one, count(*) AS n FROM quota GROUP BY source) a USING (one) JOIN (SELECT source AS other, count(*) AS n FROM quota GROUP BY source) b USING (other)", "quota"))
def source_overlap(t: Tables) -> DataFrame:
    return scoring.source_overlap(_nominated(t)).select("one", "other", F.round("jaccard", 9).alias("jaccard"))


_GRID = [{"fused4": 1.0, "vlm": v} for v in (0.0, 0.125, 0.25, 0.5, 1.0)]


@query(
    sql(
        """SELECT CAST(k - 1 AS INT) AS setting, round(avg(final), 6) AS final FROM (SELECT k, query_id, (coalesce(max(r) FILTER (WHERE rank <= 1), 0) + coalesce(max(r) FILTER (WHERE rank <= 5), 0) + coalesce(max(r) FILTER (WHERE rank <= 20), 0) + coalesce(max(r) FILTER (WHERE rank <= 50), 0) + coalesce(max(r), 0)) / 5.0 AS final FROM
          (SELECT k, query_id, CASE WHEN (query_id, row_id) IN (SELECT (query_id, row_id) FROM truth) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r, rank FROM
            (SELECT *, row_number() OVER (PARTITION BY k, query_id ORDER BY round(zb + [0.0, 0.125, 0.25, 0.5, 1.0][k]::DOUBLE * zv, 9) DESC, row_id) AS rank FROM z, (SELECT unnest(range(1, 6)) AS k)) WHERE rank <= 100) GROUP BY k, query_id) GROUP BY k""",
        "pool", truth=_TRUE, p="SELECT query_id, row_id, round(s, 9) AS base, (row_id * 7 + query_id) % 11 / 10.0::DOUBLE AS vlm FROM pool",
        z="SELECT query_id, row_id, CASE WHEN stddev_pop(base) OVER w >= 1e-9 THEN (base - avg(base) OVER w) / stddev_pop(base) OVER w ELSE 0.0 END AS zb, CASE WHEN stddev_pop(vlm) OVER w >= 1e-9 THEN (vlm - avg(vlm) OVER w) / stddev_pop(vlm) OVER w ELSE 0.0 END AS zv FROM p WINDOW w AS (PARTITION BY query_id)",
    )
)
def weight_sweep(t: Tables) -> DataFrame:
    """Weights of a stand-in model against the fused score, over the pool, all settings in one job."""
    pool = _pool(t, None).select("query_id", "row_id", "s")
    model = ((F.col("row_id") * 7 + F.col("query_id")) % 11).cast("double") / 10
    part = lambda name, score: pool.select("query_id", F.lit(0).alias("probe_idx"), F.lit(name).alias("source"), "row_id", score.alias("score"), F.lit(True).alias("covered"))
    z = fusion.z_normalize(part("fused4", F.col("s")).unionByName(part("vlm", model)))
    truth = _true(t).withColumn("r", F.lit(1.0))
    grade = lambda ranked: ranked.join(truth, ["query_id", "row_id"], "left").select("setting", "query_id", "rank", F.coalesce("r", F.lit(0.0)).alias("r"))
    return scoring.sweep(z, _GRID, grade, ["query_id"]).select("setting", F.round("final", 6).alias("final"))


# -- times, shots, groups -----------------------------------------------------


@query(sql("SELECT row_id, CASE WHEN row_id IN (SELECT doc_id FROM labels) THEN n * 40.0::DOUBLE ELSE 0.0::DOUBLE END AS ts_ms FROM frames", "frames"))
def frame_times_default(t: Tables) -> DataFrame:
    """Frames whose number `labels` knows have a time, the others 0."""
    times = t.frames.join(t.labels.select(F.col("doc_id").alias("row_id")).distinct(), "row_id", "left_semi").select("video_id", "n", numbers.frame_ms(F.col("n"), F.lit(25.0)).alias("ts_ms"))
    return frame_index.timed(t.frames, times).select("row_id", "ts_ms")


@query("SELECT c_custkey, c_mktsegment || '_' || c_custkey AS video_id FROM customer WHERE starts_with(c_mktsegment || '_' || c_custkey, 'BUILDING_') OR starts_with(c_mktsegment || '_' || c_custkey, 'MACHINERY_')")
def video_groups(t: Tables) -> DataFrame:
    videos = t.customer.select("c_custkey", F.concat("c_mktsegment", F.lit("_"), F.col("c_custkey").cast("string")).alias("video_id"))
    return frame_index.of_groups(videos, ["BUILDING", " MACHINERY ", ""])


_SHOTS = "SELECT DISTINCT source AS video_id, CAST(doc_id % 40 AS INT) AS shot_id FROM documents WHERE doc_id % 3 > 0"
_TRUTH = "SELECT CAST(doc_id AS VARCHAR) AS query_id, source AS video_id, doc_id % 50 AS number, CASE WHEN quality = 1 THEN 2 ELSE 1 END AS relevance, doc_id % 11 = 0 AS odd FROM labels JOIN documents USING (doc_id)"


def _named_shots(t: Tables) -> tuple[DataFrame, DataFrame]:
    shots = t.documents.where("doc_id % 3 > 0").select(F.col("source").alias("video_id"), (F.col("doc_id") % 40).cast("int").alias("shot_id")).distinct()
    name = F.when(F.col("doc_id") % 11 == 0, "no shot").otherwise(F.concat("source", F.lit("_shot_"), F.lpad((F.col("doc_id") % 50).cast("string"), 3, "0")))
    truth = t.labels.join(t.documents, "doc_id").select(F.col("doc_id").cast("string").alias("query_id"), name.alias("shot_id"), F.when(F.col("quality") == 1, 2).otherwise(1).alias("relevance"))
    return truth, shots


@query(f"WITH s AS ({_SHOTS}), t AS ({_TRUTH}) SELECT query_id, t.video_id, shot_id, max(relevance) AS relevance FROM t JOIN s ON s.video_id = t.video_id AND s.shot_id = t.number WHERE NOT odd GROUP BY ALL")
def truth_shots(t: Tables) -> DataFrame:
    return scoring.resolved_shots(*_named_shots(t))[0]


@query(f"WITH s AS ({_SHOTS}), t AS ({_TRUTH}) SELECT query_id, count(*) FILTER (WHERE odd OR s.shot_id IS NULL) AS unresolved FROM t LEFT JOIN s ON s.video_id = t.video_id AND s.shot_id = t.number GROUP BY query_id")
def truth_unresolved(t: Tables) -> DataFrame:
    return scoring.resolved_shots(*_named_shots(t))[1]


@query(
    sql(
        "SELECT row_id, greatest(0, lo, CASE WHEN n % 3 > 0 THEN frame_idx - 4 ELSE lo END) AS lo, least(hi, CASE WHEN n % 3 > 0 THEN frame_idx + 9 ELSE hi END, CASE WHEN video_id < 'v5' THEN 300 ELSE last END - 1) AS hi FROM w", "frames",
        w="""SELECT *, CAST(floor((p + frame_idx) / 2.0) AS BIGINT) AS lo, CAST(floor((frame_idx + q) / 2.0) AS BIGINT) AS hi FROM (SELECT row_id, video_id, n, frame_idx, max(frame_idx) OVER (PARTITION BY video_id) AS last,
            coalesce(lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx), frame_idx - 71) AS p, coalesce(lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx), frame_idx + 71) AS q FROM frames)""",
    )
)
def bounded_windows(t: Tables) -> DataFrame:
    """Two thirds of the frames have a shot; half of the videos have a last frame of their own."""
    f = t.frames.select("row_id", "video_id", "n", "frame_idx")
    shots = f.where("n % 3 > 0").select("video_id", "n", (F.col("frame_idx") - 4).alias("shot_start_frame"), (F.col("frame_idx") + 9).alias("shot_end_frame"))
    last = f.where("video_id < 'v5'").select("video_id", F.lit(300).alias("last_frame")).distinct()
    return intervals.bounded_windows(f, shots, last).select("row_id", "lo", "hi")


@query(
    sql(
        "SELECT video_id, score, CAST(row_number() OVER (ORDER BY score DESC, video_id) AS INT) AS rank FROM (SELECT video_id, max(value) AS score FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, -1.0 FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'view') = 0)".replace("SELECT video_id, max(value)", "SELECT user_id AS video_id, max(value)"),
    )
)
def ranked_videos(t: Tables) -> DataFrame:
    """Each user's best single event, and users in order of it."""
    return sequence.ranked_paths(sequence.best_paths(t.steps, 1)).select("video_id", "score", "rank")


@query(sequence_queries._paths_sql(3, 0.0001).replace("SELECT video_id, round(dp, 3) AS score, path[1] AS f0, path[2] AS f1, path[3] AS f2 FROM e WHERE r = 1", "SELECT video_id, round(dp, 3) AS score, CAST(row_number() OVER (ORDER BY round(dp, 9) DESC, video_id) AS INT) AS rank FROM e WHERE r = 1"))
def ranked_paths(t: Tables) -> DataFrame:
    """Users in order of their best three events, net of the seconds between them."""
    paths = sequence.best_paths(t.steps, 3, 0.0001).withColumn("score", F.round("score", 9))
    return sequence.ranked_paths(paths).select("video_id", F.round("score", 3).alias("score"), "rank")


@query(sql("SELECT query_id, 1 AS rank, video_id, [frame_idx, last] AS frames FROM (SELECT query_id, row_id, video_id, frame_idx, max(frame_idx) OVER (PARTITION BY query_id, video_id) AS last, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM ranked WHERE rank <= 100) x WHERE frame_idx < last AND (query_id, row_id) IN (SELECT (query_id, arg_min(row_id, rank)) FROM ranked WHERE rank <= 100 GROUP BY query_id)", "ranked"))
def answer_paths(t: Tables) -> DataFrame:
    """The best row of each query, and the last row of its video among the hundred best, as a path of two frames."""
    from .sequence_queries import _ranked

    r = _ranked(t).where("rank <= 100").select("query_id", "rank", "row_id", "video_id", "frame_idx")
    last = F.max_by("row_id", "frame_idx").over(Window.partitionBy("query_id", "video_id"))
    paths = r.withColumn("last", last).where((F.col("rank") == 1) & (F.col("last") != F.col("row_id"))).select("query_id", F.lit(1).alias("rank"), F.array("row_id", "last").alias("path"))
    return frame_index.answers(paths, t.frames)


# -- small rules --------------------------------------------------------------

_SPOKEN = "trim(regexp_replace(regexp_replace(text, '[\"“”'']', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""SELECT query_id, kind, CAST(p AS INT) AS probe_idx, CASE WHEN kind = 'kis' OR p = 0 THEN md5(q0) ELSE md5(q1) END AS digest, CAST(CASE WHEN p = 0 THEN 1 ELSE 0 END AS INT) AS quotes FROM
    (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'trake' ELSE 'kis' END AS kind, CASE WHEN item_id % 2 = 0 THEN t || ' "nha xe"' ELSE t || ' "nha xe"' END AS q0, 'then ' || t AS q1, unnest(CASE WHEN item_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS p FROM (SELECT item_id, replace(replace(replace({_SPOKEN}, '. ', ' '), '? ', ' '), '! ', ' ') AS t FROM benchmark))"""
)
def probe_table(t: Tables) -> DataFrame:
    """Passages as queries: those of even numbers with two marked events, whose first has a quote; several probes make a sequence."""
    plain = t.benchmark.select("item_id", F.regexp_replace("text", "[\"“”']", "").alias("t")).select("item_id", F.regexp_replace(text.squeezed(F.col("t")), r"[.?!] ", " ").alias("t"))
    one = F.concat("t", F.lit(' "nha xe"'))
    asked = plain.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("E1: "), one, F.lit(" E2: then "), "t")).otherwise(one).alias("text"), F.lit("kis").alias("kind"))
    return hybrid.probe_table(asked).select("query_id", "kind", "probe_idx", F.md5("text").alias("digest"), F.size("quoted").alias("quotes"))


@query("SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size * 7 AS BIGINT) AS span, (p_size BETWEEN 10 AND 20 OR p_size * 2 BETWEEN 10 AND 20) AS hit, p_size / 25.0::DOUBLE * 1000.0 AS ms FROM part")
def grid_rules(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("int")
    return t.part.select(F.col("p_partkey").cast("long").alias("k"), numbers.guaranteed_span(size, F.lit(7)).cast("long").alias("span"), numbers.grid_hits(F.array(size, size * 2), F.lit(10), F.lit(20)).alias("hit"), numbers.frame_ms(size, F.lit(25.0)).alias("ms"))


@query("SELECT doc_id, md5(replace(lower(nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss')) AS digest FROM documents WHERE text IS NOT NULL")
def composed_answers(t: Tables) -> DataFrame:
    """Whole texts as answers, decomposed first and composed again."""
    return t.documents.where("text is not null").select("doc_id", F.md5(text.normalize_answer(F.col("text"))).alias("digest"))
