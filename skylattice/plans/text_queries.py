"""Queries over query texts, submissions and plans of work, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import frame_index, planning, submission
from .binding import Tables, sql

QUERIES, ORACLES = {}, {}


def query(statement: str | None = None):
    def note(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if statement:
            ORACLES[f.__name__] = statement
        return f

    return note


@query(r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(regexp_replace(trim(text, E' \n\t\r'), '([.!?])[ \n\t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '')) AS INT) AS n FROM documents WHERE text IS NOT NULL")
def sentences(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


_MARKED_WHOLE = "'Intro. E1: ' || text || ' e2 : second one E3:third'"


@query(rf"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS probe_idx, trim(parts[i + 1]) AS probe FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, string_split_regex(' ' || trim(regexp_replace({_MARKED_WHOLE}, '\s+', ' ', 'g')), '\s[Ee]\s*\d+\s*:') AS parts FROM documents WHERE text IS NOT NULL)) WHERE trim(parts[i + 1]) <> ''")
def probe_split_whole(t: Tables) -> DataFrame:
    """Every whole document as the first of three marked events."""
    marked = F.concat(F.lit("Intro. E1: "), F.col("text"), F.lit(" e2 : second one E3:third"))
    return t.documents.where("text is not null").select("doc_id", F.posexplode(text.split_events(marked)).alias("probe_idx", "probe"))


_PLAIN = "trim(regexp_replace(regexp_replace(text, '[.!?]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT item_id, CAST(i - 1 AS INT) AS probe_idx, md5(CASE WHEN i = 1 THEN 'A view. ' || p || '.' WHEN i = 2 THEN 'Sau đó ' || p || '. It goes on.' ELSE 'Cuối cùng ' || p END) AS digest FROM (SELECT item_id, {_PLAIN} AS p, unnest(range(1, 4)) AS i FROM benchmark)")
def probe_connective(t: Tables) -> DataFrame:
    """Whole passages, of all letters, in sentences of which the third and the fifth open an event."""
    plain = text.squeezed(F.regexp_replace("text", "[.!?]", ""))
    asked = F.concat(F.lit("A view. "), plain, F.lit(". Sau đó "), plain, F.lit(". It goes on. Cuối cùng "), plain)
    return t.benchmark.select("item_id", F.posexplode(text.split_events(asked)).alias("probe_idx", "p")).select("item_id", "probe_idx", F.md5("p").alias("digest"))


@query(
    r"""WITH c AS (SELECT item_id, regexp_replace(text, '["“”'']', '', 'g') AS clean FROM benchmark), p AS (SELECT item_id, clean, len(clean) AS size, ceil(len(clean) / 80.0) AS n, unnest(range(CAST(ceil(len(clean) / 80.0) AS BIGINT))) AS i FROM c WHERE len(clean) >= 2),
    q AS (SELECT item_id, i, trim(substr(clean, CAST(floor(i * size / n) AS BIGINT) + 1, CAST(floor((i + 1) * size / n) - floor(i * size / n) AS BIGINT)), E' \n\t\r') AS quoted FROM p)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INT) AS quote_idx, quoted FROM (SELECT item_id, quoted, min(i) AS i FROM q GROUP BY item_id, quoted)"""
)
def quoted_whole(t: Tables) -> DataFrame:
    """Whole passages, cut evenly into quotes of at most 80 characters."""
    rows = t.benchmark.select("item_id", F.regexp_replace("text", "[\"“”']", "").alias("clean")).where(F.length("clean") >= 2)
    size, n = F.length("clean"), F.ceil(F.length("clean") / 80)
    at = lambda i: F.floor(i * size / n).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.concat(F.lit('"'), F.substring("clean", at(i) + 1, at(i + 1) - at(i)), F.lit('"')))
    return rows.select("item_id", F.posexplode(text.quoted(F.concat(F.lit("He said "), F.array_join(pieces, " and ")))).alias("quote_idx", "quoted"))


_ENDS = [*text.QUESTION_ENDS, *(f"{e} chiếc" for e in text.QUESTION_ENDS_WITH_A_WORD)]
_LEADS = ["", "Hãy cho biết ", "Trong video này, ", "trong khung hình đầu tiên, ", "Có bao nhiêu ", "mấy "]
_QUOTED_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_LONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT item_id, md5(trim({_LONE}, ' ,.;:?')) AS said FROM benchmark")
def declarativize(t: Tables) -> DataFrame:
    """Whole passages between a lead and an end of a question, each of which takes its turn."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("item_id") % len(xs) + 1).cast("int"))
    asked = F.concat(pick(_LEADS), F.regexp_replace("text", r"^\s+|\s+$", ""), F.when(F.col("item_id") % 3 == 0, " có là ").when(F.col("item_id") % 3 == 1, "  là ").otherwise(" "), pick(_ENDS), F.lit(" ?"))
    return t.benchmark.select("item_id", F.md5(text.declarativize(asked)).alias("said"))


@query(
    r"SELECT doc_id, CASE WHEN source IN ('src1', 'src4') THEN 'qa' WHEN source = 'src2' THEN 'trake' WHEN source = 'src3' THEN 'kis' WHEN regexp_matches(text || ' e 7 : x', '(^|\s)[Ee]\s*\d+\s*:') AND doc_id % 2 = 0 THEN 'trake' WHEN regexp_matches(text, '(^|\s)[Ee]\s*\d+\s*:') THEN 'trake' ELSE 'kis' END AS kind FROM documents WHERE text IS NOT NULL"
)
def query_kinds(t: Tables) -> DataFrame:
    """Some sources stand for names of a kind, in any case; the others' kind is told by a mark that half of the texts get."""
    name = F.when(F.col("source").isin("src1", "src4"), "03-QA-x").when(F.col("source") == "src2", "TRAKE-1").when(F.col("source") == "src3", "kis9").otherwise("z")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" e 7 : x"))).otherwise(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", text.query_kind(name, marked).alias("kind"))


@query(
    """SELECT doc_id, xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ord(c) >> CAST(k AS INT)) & 1))),
    lambda c, b: CASE WHEN (xor(c, CAST(b AS BIGINT)) & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) AS seed FROM documents"""
)
def stable_seed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.stable_seed(F.col("doc_id").cast("string")).alias("seed"))


@query("SELECT doc_id, left(sha1(text), 16) AS key FROM documents WHERE text IS NOT NULL")
def cache_key(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", text.cache_key(F.col("text")).alias("key"))


@query("SELECT left(sha1(text), 16) AS key, count(*) AS n FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0' AND text IS NOT NULL) GROUP BY text")
def cache_miss(t: Tables) -> DataFrame:
    """Distinct texts that a cache filled by one source lacks."""
    keyed = t.documents.where("text is not null").withColumn("key", text.cache_key(F.col("text")))
    cache = keyed.where("source = 'src0'").select("key").distinct()
    return keyed.groupBy("key").agg(F.count("*").alias("n")).join(cache, "key", "left_anti")


@query("SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM documents WHERE text IS NOT NULL")
def normalized_answers(t: Tables) -> DataFrame:
    """Whole texts as answers, with more blanks than they had."""
    spread = F.concat(F.lit(" "), F.regexp_replace("text", " ", " \n "))
    return t.documents.where("text is not null").select("doc_id", F.md5(text.normalize_answer(spread, False)).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN o >= 25 AND a >= 60 THEN 'vision+ocr+asr' WHEN o >= 25 AND a < 20 THEN 'vision+ocr' WHEN a >= 60 AND o < 10 THEN 'vision+asr' WHEN o < 10 AND a < 20 THEN 'vision' END AS kind FROM (SELECT conv_id, turn, length(coalesce(role, '')) * 3 AS o, length(coalesce(text, '')) AS a FROM conversations)")
def evidence_type(t: Tables) -> DataFrame:
    kind = text.evidence_type(F.repeat("role", F.lit(3)), F.col("text"))
    return t.conversations.select("conv_id", "turn", kind.alias("kind"))


@query(
    """WITH f AS (SELECT conv_id * 1000 + turn AS row_id, 'v' || conv_id AS video_id, length(coalesce(role, '')) * 3 AS o, length(coalesce(text, '')) AS a FROM conversations),
    k AS (SELECT row_id, video_id, md5('7:' || row_id) AS draw, CASE WHEN o >= 25 AND a >= 60 THEN 'vision+ocr+asr' WHEN o >= 25 AND a < 20 THEN 'vision+ocr' WHEN a >= 60 AND o < 10 THEN 'vision+asr' WHEN o < 10 AND a < 20 THEN 'vision' END AS query_type FROM f),
    v AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY draw, row_id) AS i FROM k WHERE query_type IS NOT NULL AND video_id NOT IN ('v1', 'v2'))
    SELECT row_id, video_id, query_type FROM (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY draw, row_id) AS n FROM v WHERE i <= 2) WHERE n <= 10"""
)
def evidence_sample(t: Tables) -> DataFrame:
    kind = text.evidence_type(F.repeat("role", F.lit(3)), F.col("text"))
    frames = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video_id"), kind.alias("query_type"))
    banned = t.spark.createDataFrame([("v1",), ("v2",)], "video_id string")
    return frame_index.sample_by_evidence(frames, 40, 7, banned).select("row_id", "video_id", "query_type")


@query("SELECT p_partkey AS k, 'một ' || p_name AS said FROM part")
def class_query(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("k"), text.class_query(F.concat("p_name", F.lit(" / other"))).alias("said"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE source || '_shot_1' END AS video_id, CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id % 90 AS INT) END AS shot FROM documents WHERE source IS NOT NULL")
def shot_parts(t: Tables) -> DataFrame:
    """Three in four names are those of shots, of videos that are named like shots themselves."""
    name = F.concat("source", F.lit("_shot_1"), F.when(F.col("doc_id") % 4 == 3, "_shot_").otherwise(F.concat(F.lit("_shot_"), F.lpad((F.col("doc_id") % 90).cast("string"), 3, "0"))))
    video, number = text.shot_parts(name)
    return t.documents.where("source is not null").select("doc_id", video.alias("video_id"), number.alias("shot"))


# -- submissions: an order is a task, its lines are answers -------------------

_LINES = "SELECT l_orderkey AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_suppkey AS v, CAST(l_quantity AS INT) AS f, l_extendedprice AS score FROM lineitem"


def _tasks(t: Tables) -> tuple[DataFrame, DataFrame]:
    tasks = t.orders.select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit("kis").alias("task_type"), F.lit(1).alias("n_moments"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    answers = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("task_id"), F.row_number().over(order).alias("rank"), F.col("l_suppkey").cast("string").alias("video_id"), F.array(F.col("l_quantity").cast("int")).alias("frames"), F.lit(None).cast("string").alias("answer"), F.col("l_extendedprice").alias("score"),
    )
    return tasks, answers


@query(
    sql(
        """SELECT CAST(ok AS VARCHAR) AS task_id, CAST(NULL AS INT) AS rank, 'over budget' AS rule FROM l GROUP BY ok HAVING count(*) > 5
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'no answers' FROM orders WHERE o_orderkey NOT IN (SELECT ok FROM l)
        UNION ALL SELECT CAST(ok AS VARCHAR), CAST(rank AS INT), 'duplicate answer' FROM (SELECT *, row_number() OVER (PARTITION BY ok, v, f ORDER BY rank) AS r FROM l) WHERE r > 1
        UNION ALL SELECT CAST(ok AS VARCHAR), CAST(rank AS INT), 'scores not descending' FROM (SELECT *, lag(score) OVER (PARTITION BY ok ORDER BY rank) AS p FROM l) WHERE score > p
        UNION ALL SELECT CAST(ok AS VARCHAR), CAST(rank AS INT), 'frame beyond end' FROM l WHERE f >= 45""",
        l=_LINES,
    )
)
def submission_violations(t: Tables) -> DataFrame:
    tasks, answers = _tasks(t)
    bounds = t.supplier.select(F.col("s_suppkey").cast("string").alias("video_id"), F.lit(45).alias("n_frames"))
    return submission.violations(tasks, answers, budget=5, bounds=bounds)


_MIXED = """SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 0 THEN ' ' WHEN c_custkey % 31 = 0 THEN 'twin' ELSE 't' || c_custkey END AS task_id, CASE c_custkey % 3 WHEN 0 THEN 'kis' WHEN 1 THEN 'qa' ELSE 'trake' END AS task_type,
    CASE WHEN c_custkey % 37 = 0 THEN 0 WHEN c_custkey % 3 = 2 OR c_custkey % 41 = 0 THEN 2 ELSE 1 END AS n_moments FROM customer"""
_SAID = """SELECT k, task_id, task_type, n_moments, CAST(rank AS INT) AS rank, CASE WHEN (k + rank) % 43 = 0 THEN '' ELSE 'v' || k % 5 END AS video_id, rank * 10 + k % 90 AS f, CASE WHEN (k + rank) % 47 = 0 THEN -1 WHEN (k + rank) % 53 = 0 THEN NULL ELSE rank * 10 + k % 90 END AS f0,
    CASE WHEN n_moments = 2 AND (k + rank) % 7 > 0 THEN rank * 10 + k % 90 + 5 - 20 * CAST((k + rank) % 11 = 0 AS INT) END AS f1, CASE WHEN (k + rank) % 13 = 0 THEN ' ' ELSE 'a' END AS answer, CASE WHEN k % 17 > 0 OR rank = 1 THEN 1.0::DOUBLE / rank END AS score
    FROM (SELECT * FROM m WHERE task_id LIKE 't%' AND task_id <> 'twin'), (SELECT unnest([1, 2, 3]) AS rank) WHERE k % 19 > 0 OR rank < 3"""


@query(
    sql(
        """SELECT task_id, CAST(NULL AS INT) AS rank, 'empty task id' AS rule FROM m WHERE trim(task_id) = '' UNION ALL SELECT task_id, NULL, 'moments below one' FROM m WHERE n_moments < 1 UNION ALL SELECT task_id, NULL, 'one moment only' FROM m WHERE task_type <> 'trake' AND n_moments <> 1
        UNION ALL SELECT task_id, NULL, 'no answers' FROM m WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT task_id, NULL, 'scores missing' FROM s GROUP BY task_id HAVING count(score) BETWEEN 1 AND count(*) - 1 UNION ALL SELECT task_id, NULL, 'budget not used' FROM s GROUP BY task_id HAVING count(*) < 3
        UNION ALL SELECT task_id, NULL, 'duplicate task id' FROM m GROUP BY task_id HAVING count(*) > 1 UNION ALL SELECT task_id, rank, 'empty video id' FROM s WHERE video_id = '' UNION ALL SELECT task_id, rank, 'wrong number of frames' FROM s WHERE n_moments <> 1 + CAST(f1 IS NOT NULL AS INT)
        UNION ALL SELECT task_id, rank, 'frame missing' FROM s WHERE f0 IS NULL UNION ALL SELECT task_id, rank, 'negative frame' FROM s WHERE least(f0, f1) < 0 UNION ALL SELECT task_id, rank, 'frames not ascending' FROM s WHERE n_moments > 1 AND f1 IS NOT NULL AND (f0 IS NULL OR f1 < f0) AND NOT (f0 IS NULL AND false)
        UNION ALL SELECT task_id, rank, 'answer missing' FROM s WHERE task_type = 'qa' AND trim(answer) = '' UNION ALL SELECT task_id, rank, 'unknown video' FROM s WHERE video_id IN ('', 'v4') UNION ALL SELECT task_id, rank, 'frame beyond end' FROM s WHERE video_id IN ('v0', 'v1', 'v2', 'v3') AND greatest(f0, f1) >= 100
        UNION ALL SELECT task_id, rank, 'not a frame of the video' FROM s WHERE video_id = 'v2' AND (f0 IS NULL OR f0 % 2 <> 0 OR f0 NOT BETWEEN 0 AND 200 OR f1 % 2 <> 0 OR f1 NOT BETWEEN 0 AND 200)""",
        m=_MIXED, s=_SAID,
    )
)
def submission_rules(t: Tables) -> DataFrame:
    """Customers as tasks of three kinds, with answers that break every other rule here and there."""
    k, rank = F.col("k"), F.col("rank")
    kind = F.when(k % 3 == 0, "kis").when(k % 3 == 1, "qa").otherwise("trake")
    name = F.when(k % 29 == 0, " ").when(k % 31 == 0, "twin").otherwise(F.concat(F.lit("t"), k.cast("string")))
    tasks = t.customer.select(F.col("c_custkey").alias("k")).select("k", name.alias("task_id"), kind.alias("task_type"), F.when(k % 37 == 0, 0).when((k % 3 == 2) | (k % 41 == 0), 2).otherwise(1).alias("n_moments"))
    each = tasks.where("task_id like 't%' and task_id <> 'twin'").withColumn("rank", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where((k % 19 > 0) | (rank < 3))
    f = (rank * 10 + k % 90).cast("int")
    one = F.when((k + rank) % 47 == 0, -1).when((k + rank) % 53 == 0, F.lit(None)).otherwise(f)
    two = F.when((F.col("n_moments") == 2) & ((k + rank) % 7 > 0), f + 5 - 20 * ((k + rank) % 11 == 0).cast("int"))
    answers = each.select(
        "task_id", "rank", F.when((k + rank) % 43 == 0, "").otherwise(F.concat(F.lit("v"), (k % 5).cast("string"))).alias("video_id"), F.when(two.isNull(), F.array(one)).otherwise(F.array(one, two)).alias("frames"),
        F.when((k + rank) % 13 == 0, " ").otherwise("a").alias("answer"), F.when((k % 17 > 0) | (rank == 1), 1.0 / rank).alias("score"),
    )
    bounds = t.spark.range(4).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("video_id"), F.lit(100).alias("n_frames"))
    valid = t.spark.range(101).select(F.lit("v2").alias("video_id"), (F.col("id") * 2).cast("int").alias("frame_idx"))
    return submission.violations(tasks.drop("k"), answers, budget=3, full=True, bounds=bounds, valid=valid)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS task_id, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT CAST(l_orderkey AS VARCHAR) || 'x', 'extra' FROM lineitem WHERE l_quantity > 49 GROUP BY l_orderkey")
def missing_extra(t: Tables) -> DataFrame:
    expected = t.orders.select(F.col("o_orderkey").cast("string").alias("task_id"))
    given = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("task_id"))
    other = t.lineitem.where("l_quantity > 49").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("x")).alias("task_id"))
    return submission.missing_and_extra(expected, given.unionByName(other))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def alignment_anti(t: Tables) -> DataFrame:
    return frame_index.missing_keys(t.documents, t.embeddings.withColumnRenamed("vec_id", "doc_id"), ("doc_id",))


@query(sql("SELECT CAST(ok AS VARCHAR) AS task_id, CAST(rank AS BIGINT) AS rank, CAST(v AS VARCHAR) AS video_id, CAST(f + 3 AS BIGINT) AS frame_id FROM l", l=_LINES))
def prediction_payload(t: Tables) -> DataFrame:
    """Every answer as its JSON tells it, frames shifted by three."""
    tasks, answers = _tasks(t)
    found = submission.payload(tasks, answers, 3)
    parsed = F.from_json("json", "task_id string, results array<struct<rank:bigint,video_id:string,frame_id:bigint>>")
    return found.select(parsed.alias("p")).select("p.task_id", F.explode("p.results").alias("r")).select("task_id", "r.*")


# -- plans of work ------------------------------------------------------------


def _videos(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").cast("string").alias("video_id")).agg(F.count("*").alias("weight"))


_LPT = """WITH RECURSIVE w AS (SELECT CAST(o_custkey AS VARCHAR) AS video_id, count(*) AS weight FROM orders GROUP BY o_custkey), total AS (SELECT sum(weight) AS n FROM w),
    v AS (SELECT row_number() OVER (ORDER BY weight DESC, video_id) AS i, video_id, weight FROM w, total WHERE weight * 1000 > n),
    deal AS (SELECT 0::BIGINT AS i, list_transform(range(10), lambda x: 0::BIGINT) AS loads, NULL::VARCHAR AS video_id, 0::BIGINT AS weight, 0::BIGINT AS slot
    UNION ALL SELECT n.i, list_transform(n.loads, lambda x, k: CASE WHEN k = n.slot THEN x + n.weight ELSE x END), n.video_id, n.weight, n.slot FROM (SELECT v.i, d.loads, v.video_id, v.weight, CAST(list_position(d.loads, list_min(d.loads)) AS BIGINT) AS slot FROM deal d JOIN v ON v.i = d.i + 1) n),
    l AS (SELECT unnest(loads) AS load, unnest(range(10)) AS shard FROM deal WHERE i = (SELECT max(i) FROM deal)),
    level AS (SELECT max_by(vol, m) AS vol, max(m) AS m FROM (SELECT row_number() OVER (ORDER BY load, shard) AS m, load, (SELECT coalesce(sum(weight), 0) FROM w, total WHERE weight * 1000 <= n) + sum(load) OVER (ORDER BY load, shard) AS vol FROM l) WHERE vol >= m * load),
    room AS (SELECT shard, sum(greatest(0, vol - m * load)) OVER (ORDER BY shard) AS til FROM l, level),
    light AS (SELECT video_id, weight, (sum(weight) OVER (ORDER BY video_id) - weight) * m AS begin FROM w, total, level WHERE weight * 1000 <= n),
    dealt AS (SELECT video_id, weight, CAST(slot - 1 AS INT) AS shard FROM deal WHERE i > 0 UNION ALL SELECT video_id, weight, CAST((SELECT count(*) FROM room WHERE til <= begin) AS INT) FROM light)"""


@query(f"{_LPT} SELECT video_id, weight, shard FROM dealt")
def lpt_shards(t: Tables) -> DataFrame:
    return planning.deal(_videos(t), 10)


@query(
    f"""{_LPT} SELECT 10::BIGINT AS shards, min(x) AS least, max(x) AS most, avg(x) AS mean, round(max(x) / avg(x), 9) AS imbalance, round(4.0 / 3 - 1.0 / 30, 9) AS bound FROM (SELECT CAST(sum(weight) AS BIGINT) AS x FROM dealt GROUP BY shard)"""
)
def shard_report(t: Tables) -> DataFrame:
    found = planning.shard_report(planning.deal(_videos(t), 10), 10)
    return found.withColumn("imbalance", F.round("imbalance", 9)).withColumn("bound", F.round("bound", 9))


@query("SELECT o_custkey AS video, count(*) AS frames FROM orders GROUP BY o_custkey")
def video_frames(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("video")).agg(F.count("*").alias("frames"))


@query("SELECT p_partkey AS k, round(p_size * 1000 / 12.5, 1) AS container_seconds, round(p_size * 1000 / 12.5 / 10, 1) AS wall_clock_seconds, round(p_size * 1000 / 12.5 / 3600 * 1.1::DOUBLE, 4) AS usd, round(1000 / 12.5 / 3600 * 1.1::DOUBLE, 5) AS usd_per_1000_frames FROM part")
def projected_cost(t: Tables) -> DataFrame:
    cost = numbers.projected_cost(F.col("p_size") * 1000, F.lit(12.5), F.lit(1.1), F.lit(10))
    return t.part.select(F.col("p_partkey").alias("k"), cost.alias("c")).select("k", "c.*")


@query("SELECT p_partkey AS k, CASE WHEN g <= c THEN 'gpu' WHEN 9.0 / p_size >= 3 THEN 'gpu' ELSE 'cpu' END AS device FROM (SELECT p_partkey, p_size, p_retailprice AS c, p_size * 40.0 AS g FROM part)")
def choose_device(t: Tables) -> DataFrame:
    pick = numbers.choose_device(F.col("p_retailprice"), F.lit(9.0), F.col("p_size") * 40.0, F.col("p_size").cast("double"))
    return t.part.select(F.col("p_partkey").alias("k"), pick.alias("device"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, round(4.0 / 3 - 1.0 / (3 * (o_custkey % 20 + 1)), 6) AS bound FROM orders")
def lpt_bound(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("long").alias("k"), F.round(numbers.lpt_bound(F.col("o_custkey") % 20 + 1), 6).alias("bound"))


@query("SELECT source AS class, count(*) AS frames, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS prevalence FROM documents GROUP BY source HAVING count(*) >= 20 AND count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) <= 0.35")
def class_filter(t: Tables) -> DataFrame:
    """Classes frequent enough to measure and rare enough to tell anything."""
    n = t.documents.agg(F.count("*").alias("all"))
    found = frame_index.measurable_classes(t.documents.select(F.col("source").alias("class")), n, least=20)
    return found.withColumn("prevalence", F.round("prevalence", 6))
