"""Round trips: tables are written in the formats of sources and sinks, read by the readers, and compared with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frame_index
from ..sources import files, readers, writers
from ..sources.staging import fresh_path
from .binding import Tables, sql

QUERIES, ORACLES = {}, {}


def query(statement: str):
    def note(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[f.__name__] = statement
        return f

    return note


# -- OCR lines: a document as a frame of its source ---------------------------


def _ocr_file(t: Tables) -> str:
    path = fresh_path(t.spark, "ocr")
    rows = t.documents.select(
        F.col("source").alias("video_id"), F.col("doc_id").cast("int").alias("n"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7).cast("int").alias("shot_id"), F.lower("text").alias("text_ascii_folded"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("  ").alias("text_normalized"), F.concat(F.lit("raw "), F.col("text")).alias("text_raw"),
    )
    rows.write.json(path)
    return path


@query("SELECT source AS video_id, CAST(doc_id AS INT) AS n, md5(trim(lower(text))) AS digest FROM documents WHERE trim(lower(text)) <> ''")
def read_ocr_text(t: Tables) -> DataFrame:
    return readers.ocr_text(t.spark, _ocr_file(t)).select("video_id", "n", F.md5("text").alias("digest"))


@query("SELECT source AS video_id, CAST(doc_id AS INT) AS n, md5(CASE WHEN doc_id % 2 = 0 AND trim(text) <> '' THEN text ELSE 'raw ' || text END) AS digest FROM documents WHERE text IS NOT NULL")
def read_ocr_raw(t: Tables) -> DataFrame:
    return readers.ocr_raw(t.spark, _ocr_file(t)).select("video_id", "n", F.md5("text").alias("digest"))


@query("SELECT source AS video_id, CAST(doc_id AS INT) AS n, CAST(doc_id % 7 AS INT) AS shot_id FROM documents WHERE doc_id % 3 > 0")
def read_shot_ids(t: Tables) -> DataFrame:
    return readers.shot_ids(t.spark, _ocr_file(t))


# -- frame tables: a vector as a frame of its label's video -------------------

_ROWS = "SELECT video_id, n, CAST(frame_idx AS INT) AS frame_idx, CASE WHEN n % 5 > 0 THEN 25.0 END AS fps, CASE WHEN n % 4 > 0 THEN n // 6 END AS shot_id, CASE WHEN n % 9 > 0 THEN frame_idx // 40 * 40 END AS s, CASE WHEN n % 9 > 0 THEN frame_idx // 40 * 40 + 39 END AS e FROM frames"


def _frame_files(t: Tables) -> DataFrame:
    """CSV files with a header in a folder for each video."""
    path, f = fresh_path(t.spark, "frame-tables"), t.frames
    rows = f.select(
        "video_id", "n", "frame_idx", F.when(F.col("n") % 5 > 0, 25.0).alias("fps"), F.when(F.col("n") % 4 > 0, F.floor(F.col("n") / 6)).alias("shot_id"),
        F.when(F.col("n") % 9 > 0, F.floor(F.col("frame_idx") / 40) * 40).alias("shot_start_frame"), F.when(F.col("n") % 9 > 0, F.floor(F.col("frame_idx") / 40) * 40 + 39).alias("shot_end_frame"),
    )
    rows.repartitionByRange("video_id", "n").sortWithinPartitions("video_id", "n").write.partitionBy("video_id").option("header", True).csv(path)  # a long video has several files
    return readers.frame_table(t.spark, f"{path}/*/*", depth=1)


@query(sql("SELECT video_id, n, CAST(s AS INT) AS shot_start_frame, CAST(e AS INT) AS shot_end_frame FROM r WHERE s IS NOT NULL", "frames", r=_ROWS))
def read_shot_bounds(t: Tables) -> DataFrame:
    return readers.shot_bounds(_frame_files(t))


@query(sql("SELECT video_id, CAST(max(e) AS INT) AS last_frame FROM r GROUP BY video_id HAVING max(e) > 0", "frames", r=_ROWS))
def read_last_frames(t: Tables) -> DataFrame:
    return readers.video_last_frame(_frame_files(t))


@query(sql("SELECT video_id, n, frame_idx FROM r", "frames", r=_ROWS))
def read_frame_numbers(t: Tables) -> DataFrame:
    return readers.frame_numbers(_frame_files(t))


@query(sql("SELECT video_id, n, frame_idx / fps * 1000.0 AS ts_ms FROM r WHERE fps IS NOT NULL", "frames", r=_ROWS.replace("25.0 END", "25.0::DOUBLE END")))
def read_frame_times(t: Tables) -> DataFrame:
    return readers.frame_times(_frame_files(t))


@query(sql("SELECT video_id, CAST(shot_id AS INT) AS shot_id, CAST(arg_min({'s': s}, n).s AS INT) AS start, CAST(arg_min({'e': e}, n).e AS INT) AS \"end\" FROM r WHERE shot_id IS NOT NULL GROUP BY video_id, shot_id", "frames", r=_ROWS))
def read_shot_frames(t: Tables) -> DataFrame:
    """A shot's first row decides."""
    return readers.shot_frames(_frame_files(t))


@query(sql("SELECT video_id, count(*) AS expected FROM r GROUP BY video_id", "frames", r=_ROWS))
def read_expected_frames(t: Tables) -> DataFrame:
    return readers.frame_numbers(_frame_files(t)).groupBy("video_id").agg(F.count("*").alias("expected"))


# -- detector records: a supplier as a frame of its nation, nations' names as classes


def _object_files(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "objects")
    entities = F.array(F.col("s_name"), F.concat(F.lit("Brand"), F.col("s_nationkey").cast("string")))
    rows = files.dealt(t.supplier, "s_suppkey").select(
        F.col("s_nationkey").cast("string").alias("video_id"), F.col("s_suppkey").cast("string").alias("n"), F.lower("s_name").alias("layout_folded"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("two").alias("count_folded"), F.lit("c").alias("classes_folded"),
        entities.alias("classes"), entities.alias("detection_class_entities"), F.transform(entities, lambda x: F.concat(F.lit("một "), x)).alias("entities_vi"), F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.5, 0.5)]), F.array(*[F.lit(x) for x in (0.1, 0.1, 0.9, 0.9)])).alias("detection_boxes"),
    )
    record = F.to_json(F.struct(*[c for c in rows.columns if c not in ("video_id", "n")]))
    files.write_files(rows.select(F.concat(F.lit(f"{path}/"), "video_id", F.lit("/"), "n", F.lit(".json")).alias("path"), record.alias("content")))
    return readers.object_records(t.spark, path)


@query("SELECT CAST(s_nationkey AS VARCHAR) AS video_id, CAST(s_suppkey AS INT) AS n, lower(s_name) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' two' END || ' c' AS text FROM supplier")
def read_object_text(t: Tables) -> DataFrame:
    return readers.object_text(_object_files(t))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS video_id, CAST(s_suppkey AS INT) AS n, unnest([s_name, 'Brand' || s_nationkey]) AS class FROM supplier")
def read_object_classes(t: Tables) -> DataFrame:
    return readers.object_classes(_object_files(t))[0]


@query("SELECT class, 'một ' || class AS phrase FROM (SELECT DISTINCT unnest([s_name, 'Brand' || s_nationkey]) AS class FROM supplier)")
def read_class_phrases(t: Tables) -> DataFrame:
    return readers.object_classes(_object_files(t))[1]


# -- speech, queries, truths --------------------------------------------------


@query(sql("SELECT video_id, start_ms, end_ms, md5(trim(text)) AS digest FROM speech WHERE trim(text) <> ''", "speech"))
def read_speech(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "speech")
    files = t.speech.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("segments"))
    files.select("video_id", F.col("video_id").alias("file"), "segments").repartition("file").write.partitionBy("file").json(path)
    return readers.speech(t.spark, f"{path}/*/*").select("video_id", "start_ms", "end_ms", F.md5("text").alias("digest"))


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'q' || n_nationkey || '-qa' ELSE 'q' || n_nationkey END AS query_id, CASE WHEN n_nationkey % 3 = 1 THEN 'E1: ' || n_name || ' E2: sea' ELSE 'a ' || n_name END AS text, CASE n_nationkey % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'trake' ELSE 'kis' END AS kind FROM nation")
def read_query_files(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "queries")
    name = F.concat(F.lit("q"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 3 == 0, "-qa").otherwise(""))
    text = F.when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("E1:  "), "n_name", F.lit("  E2: sea "))).otherwise(F.concat(F.lit(" a "), "n_name"))
    t.nation.select(name.alias("query_id"), text.alias("value")).repartition("query_id").write.partitionBy("query_id").text(path)
    return readers.query_files(t.spark, f"{path}/*/*", depth=1)


@query("SELECT query_id, 'vision' AS query_type, shot_id, max(relevance) AS relevance FROM (SELECT CAST(l_orderkey AS VARCHAR) AS query_id, 'v' || l_suppkey || '_shot_' || l_linenumber AS shot_id, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS relevance FROM lineitem) GROUP BY ALL")
def read_shot_truth(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "truth")
    shot = F.struct(F.concat(F.lit("v"), F.col("l_suppkey").cast("string"), F.lit("_shot_"), F.col("l_linenumber").cast("string")).alias("shot_id"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("query_id")).agg(F.collect_list(F.when(F.col("l_quantity") > 25, shot)).alias("positive_shots"), F.collect_list(F.when(F.col("l_quantity") <= 25, shot)).alias("partial_shots"))
    rows.withColumn("query_type", F.lit("vision")).write.json(path)
    return readers.shot_truth(t.spark, path)


@query("SELECT CAST(p_size AS VARCHAR) AS video_id, CAST(p_partkey AS INT) AS n, 'keyframes/' || p_size || '/' || printf('%03d', p_partkey) || '.webp' AS member FROM part")
def read_archives(t: Tables) -> DataFrame:
    """An archive for each size, a member for each of its parts, and one that is no keyframe; tasks write and read them."""
    path = fresh_path(t.spark, "archives")
    size = F.col("p_size").cast("string")
    frames = t.part.select(size.alias("v"), F.concat(F.lit("keyframes/"), size, F.lit("/"), F.format_string("%03d", F.col("p_partkey").cast("long")), F.lit(".webp")).alias("member"), F.col("p_name").alias("content"))
    every = frames.unionByName(frames.select("v", F.lit("readme.txt").alias("member"), F.lit("x").alias("content")).distinct())
    files.write_archives(every.withColumn("archive", F.concat(F.lit(f"{path}/"), "v", F.lit(".zip"))))
    return files.archive_members(t.spark, f"{path}/*.zip").select("video_id", "n", "member")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS video_id, CAST(s_suppkey AS INT) AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'second' END AS root FROM supplier")
def find_images(t: Tables) -> DataFrame:
    """Two roots: the second has all images, the first half of them, which go before."""
    path = fresh_path(t.spark, "images")
    rows = files.dealt(t.supplier, "s_suppkey").select("s_nationkey", "s_suppkey", F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array(F.lit("second")))).alias("root"))
    name = F.format_string("/%d/%03d.webp", F.col("s_nationkey").cast("long"), F.col("s_suppkey").cast("long"))
    files.write_files(rows.select(F.concat(F.lit(f"{path}/"), "root", name).alias("path"), F.col("root").alias("content")))
    found = readers.image_files(t.spark, [f"{path}/first", f"{path}/second"])
    return found.select("video_id", "n", F.element_at(F.split("path", "/"), -3).alias("root"))


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS key, CAST(len(v) AS INT) AS dim, round(list_inner_product(v, list_transform(range(1, len(v) + 1), lambda i: CAST(i AS DOUBLE))), 6) AS weighed FROM
    (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 2) WHEN vec_id % 3 = 0 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)"""
)
def cache_round_trip(t: Tables) -> DataFrame:
    """Vectors are cached, some of them again and turned round, some a third time and doubled; a run that was killed has no say. Then the cache is compacted."""
    cache = writers.vector_cache(t.spark, fresh_path(t.spark, "cache"))
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    writers.cache_vectors(rows, cache)
    writers.cache_vectors(rows.where("id % 3 = 0").withColumn("vector", F.reverse("vector")), cache)
    cache.append(rows.where("id % 5 = 0").select("key", F.transform("vector", lambda x: x * 0).alias("vector")), commit=False)
    writers.cache_vectors(rows.where("id % 7 = 0").withColumn("vector", F.transform("vector", lambda x: x * 2)), cache)
    cache.compact()
    weighed = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return cache.read().select("key", F.size("vector").alias("dim"), F.round(weighed, 6).alias("weighed"))


# -- submissions, indexes, reports --------------------------------------------


def _answers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A nation as a task (a question), its customers as ranked answers."""
    from pyspark.sql import Window

    tasks = t.nation.select(F.concat(F.lit("run-q"), F.col("n_nationkey").cast("string")).alias("task_id"), F.lit("qa").alias("task_type"), F.lit(1).alias("n_moments"))
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = t.customer.select(F.concat(F.lit("run-q"), F.col("c_nationkey").cast("string")).alias("task_id"), rank.alias("rank"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("video_id"), F.array((F.col("c_custkey") % 997).cast("int")).alias("frames"), F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, ', "x"').otherwise("")).alias("answer"), F.lit(None).cast("double").alias("score"))
    return tasks, rows.where("rank <= 100")


_GIVEN = """SELECT 'run-q' || c_nationkey AS task_id, CAST(rank AS INT) AS rank, 'v' || c_custkey AS video_id, CAST(c_custkey % 997 AS INT) AS frame, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', "x"' ELSE '' END AS answer
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer) WHERE rank <= 100"""


@query(f"SELECT *, regexp_extract(task_id, '-(.*)$', 1) AS query_id FROM ({_GIVEN})")
def submission_round_trip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "submission")
    writers.submission_csv(_answers(t)[1], path)
    got = readers.submission_files(t.spark, f"{path}/*/*", depth=1)
    return got.select("task_id", "rank", "video_id", F.col("frames")[0].alias("frame"), "answer", readers.task_query(F.col("task_id")).alias("query_id"))


@query("SELECT 'run-q' || c_nationkey AS task_id, 1 AS rank, 'v' || c_custkey AS video_id, [CAST(c_custkey % 997 AS INT), CAST(c_custkey % 997 + 5 AS INT)] AS frames FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY c_nationkey)")
def submission_frames(t: Tables) -> DataFrame:
    """Answers of several frames and no text."""
    path = fresh_path(t.spark, "submission")
    rows = _answers(t)[1].where("rank = 1").withColumn("frames", F.array(F.col("frames")[0], F.col("frames")[0] + 5)).withColumn("answer", F.lit(None).cast("string"))
    writers.submission_csv(rows, path)
    return readers.submission_files(t.spark, f"{path}/*/*", depth=1).select("task_id", "rank", "video_id", "frames")


@query(f"SELECT task_id, rank, video_id, frame + 1 AS frame_id, answer FROM ({_GIVEN})")
def predictions_round_trip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "predictions")
    tasks, rows = _answers(t)
    writers.predictions_json(tasks.join(rows.select("task_id").distinct(), "task_id"), rows, path, shift=1)
    got = t.spark.read.schema("task_id string, results array<struct<rank:int,video_id:string,frame_id:int,answer:string>>").json(path)
    return got.select("task_id", F.explode("results").alias("r")).select("task_id", "r.*")


@query(sql("SELECT video_id, count(*) AS frames, round(sum(list_inner_product(h, h)), 6) AS units FROM (SELECT video_id, list_transform(emb[1:16], lambda x: x / greatest(sqrt(list_inner_product(emb[1:16], emb[1:16])), 1e-12)) AS h FROM frames) GROUP BY video_id", "frames"))
def index_round_trip(t: Tables) -> DataFrame:
    """The index is written, loaded with its checks, and cut to 16 values."""
    from ..functions.vectors import dot

    path, f = fresh_path(t.spark, "index"), t.frames
    writers.frame_index(frame_index.build(f.select("video_id", "n", "emb"), f.select("video_id", "n", "frame_idx")), path)
    got = frame_index.load(t.spark, path, 16)
    return got.groupBy("video_id").agg(F.count("*").alias("frames"), F.round(F.sum(dot(F.col("emb"), F.col("emb"))), 6).alias("units"))


@query(sql("SELECT video_id FROM frames GROUP BY video_id HAVING max(n) % 2 = 0", "frames"))
def pending_videos(t: Tables) -> DataFrame:
    """Shards of all videos are written, those of every other one without its last frame: they are still to do."""
    path, f = fresh_path(t.spark, "shards"), t.frames
    last = f.groupBy("video_id").agg(F.max("n").alias("last"))
    kept = f.join(last, "video_id").where(~((F.col("last") % 2 == 0) & (F.col("n") == F.col("last"))))
    store = writers.video_shards(t.spark, path)
    store.append(kept.select("video_id", "n", F.col("emb").alias("vector")))
    return frame_index.pending(f.groupBy("video_id").agg(F.count("*").alias("frames")), store.units()).select("video_id")


@query(sql("SELECT query_id, count(*) AS rows_kept, CAST(max(prov) AS INT) AS most FROM pool WHERE pool_rank <= 50 GROUP BY query_id", "pool"))
def trace_round_trip(t: Tables) -> DataFrame:
    from .retrieval_queries import _pool

    path = fresh_path(t.spark, "trace")
    writers.rerank_trace(_pool(t, 50).select("query_id", "row_id", F.col("s").alias("base"), "prov", "agree"), path)
    return t.spark.read.parquet(path).groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.count("*").alias("rows_kept"), F.max("prov").cast("int").alias("most"))


@query("SELECT source AS setting, count(*) AS value FROM documents GROUP BY source UNION ALL SELECT 'stages', 2")
def report_round_trip(t: Tables) -> DataFrame:
    """The report of a run over all documents: how many each source has, and the stages that were timed."""
    path = fresh_path(t.spark, "report")
    report = writers.RunReport()
    with report.stage("count"):
        report.content["settings"] = {r["source"]: r["n"] for r in t.documents.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a handful of sources
    with report.stage("write"):
        report.write(t.spark, f"{path}/first")
    report.write(t.spark, path + "/last")
    got = t.spark.read.schema("settings map<string,bigint>, timing_s map<string,double>").json(path + "/last")
    return got.select(F.explode(F.map_concat("settings", F.map_from_arrays(F.array(F.lit("stages")), F.array(F.size("timing_s").cast("long"))))).alias("setting", "value"))


@query("SELECT 'n' || s_suppkey AS name, CAST(strlen(s_name) AS BIGINT) AS bytes, sha256(s_name) AS sha256, CASE s_suppkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverifiable' ELSE 'not_applicable' END AS status FROM supplier")
def manifest_round_trip(t: Tables) -> DataFrame:
    """A file for each supplier; a third of the stated digests are right, a third wrong, a third missing."""
    path, out = fresh_path(t.spark, "artifacts"), fresh_path(t.spark, "manifest")
    files.write_files(files.dealt(t.supplier, "s_suppkey").select(F.concat(F.lit(f"{path}/n"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("content")))
    writers.manifest(t.spark, path, out, "/nowhere")
    found = t.spark.read.schema("path string, bytes bigint, sha256 string, branch string, commit string").json(out)
    number = F.regexp_extract("path", r"/n(\d+)$", 1).cast("int")
    stated = found.select("path", F.when(number % 3 == 0, F.col("sha256")).when(number % 3 == 1, F.lit("0")).alias("sha256"))
    return writers.verified(found, stated).join(found, "path").select(F.regexp_extract("path", r"/(n\d+)$", 1).alias("name"), "bytes", "sha256", "status")


@query("SELECT 'by_source' AS part, source AS name, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'by_lang', lang, count(*) FROM documents GROUP BY lang")
def eval_report_round_trip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "eval")
    parts = {f"by_{c}": t.documents.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")) for c in ("source", "lang")}
    writers.eval_report(parts, path)
    read = lambda p: t.spark.read.schema("name string, n bigint").json(f"{path}/{p}").select(F.lit(p).alias("part"), "name", "n")
    return read("by_source").unionByName(read("by_lang"))


@query("SELECT 'h_n' || n_regionkey || '_' || n_nationkey AS query_id, 'vision' AS query_type, CAST(n_nationkey AS BIGINT) AS frame_id, md5('a long query with eight words about ' || n_name) AS digest FROM nation WHERE n_nationkey % 2 = 0")
def generated_round_trip(t: Tables) -> DataFrame:
    """Generated queries that are long enough are written as text and as truth."""
    path = fresh_path(t.spark, "generated")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("a long query with eight words about "), "n_name")).otherwise(F.col("n_name"))
    rows = t.nation.select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("video_id"), F.col("n_nationkey").alias("n"), (F.col("n_nationkey") * 25).alias("frame_idx"), text.alias("text"), F.lit("vision").alias("query_type"))
    writers.generated_queries(rows, path)
    truth = t.spark.read.schema("query_id string, query_type string, frame_id bigint").json(f"{path}/truth")
    texts = t.spark.read.text(f"{path}/texts/*/*").select(readers._stem(1).alias("query_id"), F.md5("value").alias("digest"))
    return truth.join(texts, "query_id")
