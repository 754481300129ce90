"""Queries over time: joins on ranges, paths, and grading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import coverage, frame_index, intervals, nearest, pooling, scoring, sequence
from ..sources.staging import fresh_path, staged
from .binding import Tables, sql

QUERIES, ORACLES = {}, {}


def query(statement: str | None = None):
    def note(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if statement:
            ORACLES[f.__name__] = statement
        return f

    return note


def _said(before: int, after: int, limit: int | None = None) -> str:
    text = "array_to_string(list_transform(list_sort(list({'a': start_ms, 'b': end_ms, 'c': text})), lambda x: x.c), ' ')"
    text = text if limit is None else f"substr({text}, 1, {limit})"
    return sql(
        f"SELECT row_id, CAST(count(*) AS BIGINT) AS spans, md5({text}) AS digest FROM frames f JOIN speech s ON s.video_id = f.video_id AND s.end_ms >= f.ts_ms - {before} AND s.start_ms <= f.ts_ms + {after} GROUP BY row_id",
        "frames", "speech",
    )


def _windowed(t: Tables, before: int, after: int, limit: int | None = None) -> DataFrame:
    said = intervals.window_text(t.frames, t.speech, before, after, limit)
    counts = intervals.overlap_join(t.frames, t.speech, before, after).groupBy("row_id").agg(F.count("*").alias("spans"))
    return said.join(counts, "row_id").select("row_id", "spans", F.md5("text").alias("digest"))


@query(_said(5000, 5000))
def asr_window_join(t: Tables) -> DataFrame:
    return _windowed(t, 5000, 5000)


@query(_said(5000, 5000, 400))
def qa_context(t: Tables) -> DataFrame:
    return _windowed(t, 5000, 5000, 400)


@query(_said(4000, 4000, 500))
def sampled_context(t: Tables) -> DataFrame:
    return _windowed(t, 4000, 4000, 500)


_SHOTS = "SELECT o_custkey AS k, o_orderkey AS shot, CAST(epoch_ms(o_orderdate) AS DOUBLE) AS s, CAST(epoch_ms(o_orderdate) AS DOUBLE) + 86400000.0 * 120 AS e FROM orders"
_MOMENTS = "SELECT o_custkey AS k, l_orderkey AS ok, l_linenumber AS ln, CAST(epoch_ms(l_shipdate) AS DOUBLE) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(
    sql(
        """SELECT m.ok, m.ln, CASE WHEN m.at <= s.e THEN s.shot END AS shot FROM m ASOF LEFT JOIN (SELECT k, s, max(shot) AS shot, max(e) AS e FROM s GROUP BY k, s) s ON m.k = s.k AND m.at >= s.s""",
        s=_SHOTS, m=_MOMENTS,
    )
)
def asof_shot(t: Tables) -> DataFrame:
    """A customer as a video, orders as shots of 120 days, shipped lines as moments."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("double")
    shots = t.orders.select(F.col("o_custkey").alias("k"), ms("o_orderdate").alias("s"), (ms("o_orderdate") + 86400000.0 * 120).alias("e"), F.col("o_orderkey").alias("shot"))
    moments = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), ms("l_shipdate").alias("at"))
    found = intervals.asof_join(moments, shots, "k", "at", "s", "e")
    return found.select("ok", "ln", "shot")


@query(
    sql(
        "SELECT row_id, greatest(CAST(floor((p + frame_idx) / 2.0) AS BIGINT), 0) AS lo, CAST(floor((frame_idx + q) / 2.0) AS BIGINT) AS hi FROM w", "frames",
        w="SELECT row_id, frame_idx, coalesce(lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx), frame_idx - 71) AS p, coalesce(lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx), frame_idx + 71) AS q FROM frames",
    )
)
def neighbor_window(t: Tables) -> DataFrame:
    return intervals.neighbour_windows(t.frames, lo=F.lit(0)).select("row_id", "lo", "hi")


def _paths_sql(n: int, lam: float) -> str:
    more = {"c": f"SELECT *, (ts_ms - min(ts_ms) OVER (PARTITION BY video_id)) / 1000.0 AS t, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, row_id) AS pos FROM steps", "d0": "SELECT *, s0 AS dp, [row_id] AS path FROM c"}
    for i in range(1, n):
        more[f"b{i}"] = f"""SELECT *, max({{'k': dp + {lam}::DOUBLE * t, 'pos': pos, 'path': path}}) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
            FROM d{i - 1} WHERE dp IS NOT NULL"""
        more[f"d{i}"] = f"SELECT * EXCLUDE (dp, path, b), s{i} + b.k - {lam}::DOUBLE * t AS dp, list_append(b.path, row_id) AS path FROM b{i}"
    more["e"] = f"SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY dp DESC, pos) AS r FROM d{n - 1} WHERE dp IS NOT NULL"
    return sql("SELECT video_id, round(dp, 3) AS score, " + ", ".join(f"path[{i + 1}] AS f{i}" for i in range(n)) + " FROM e WHERE r = 1", "steps", **more)


def _paths(t: Tables, n: int, lam: float) -> DataFrame:
    found = sequence.best_paths(t.steps, n, lam)
    return found.select("video_id", F.round("score", 3).alias("score"), *[F.col("path")[i].alias(f"f{i}") for i in range(n)])


@query(_paths_sql(1, 0.0))
def dante_n1(t: Tables) -> DataFrame:
    return _paths(t, 1, 0.0)


@query(_paths_sql(2, 0.0))
def dante_n2(t: Tables) -> DataFrame:
    return _paths(t, 2, 0.0)


@query(_paths_sql(3, 0.0))
def dante_n3(t: Tables) -> DataFrame:
    return _paths(t, 3, 0.0)


@query(_paths_sql(3, 0.0001))
def dante_lambda(t: Tables) -> DataFrame:
    return _paths(t, 3, 0.0001)


@query(_paths_sql(3, 0.0001).replace("user_id AS video_id", "0 AS video_id"))
def dante_one_video(t: Tables) -> DataFrame:
    """All events as those of one video, whose best three are found chunk by chunk."""
    found = sequence.best_paths_in_chunks(t.steps.withColumn("video_id", F.lit(0)), 3, 0.0001)
    return found.select("video_id", F.round("score", 3).alias("score"), *[F.col("path")[i].alias(f"f{i}") for i in range(3)])


def triples(t: Tables) -> DataFrame:
    """The visual pool of each query with its scores for that query and the two after it, looked up for the rows of the pool."""
    best = nearest.best_rows(t.frames, t.asked, pooling.PER_SOURCE, pooling.PER_VIDEO, 0.0, digits=9)
    pool = staged(pooling.nominate(best, t.frames).select("query_id", "video_id", "row_id"), "pool")
    cells = pool.select(F.col("query_id").alias("of"), "video_id", "row_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("of", "video_id", "row_id", "i", F.pmod(F.col("of") + F.col("i"), F.lit(10)).alias("query_id"), F.lit(0).alias("probe_idx"))
    wide = nearest.scores_of(cells, t.frames, t.asked).groupBy(F.col("of").alias("query_id"), "video_id", "row_id")
    return wide.agg(*[F.max(F.when(F.col("i") == i, F.col("score"))).alias(f"s{i}") for i in range(3)]).join(t.frames.select("row_id", "frame_idx"), "row_id")


def _tuples_sql(n: int, k: int, gap: int = 1, pacing: float = 0.0) -> str:
    names, score = [f"f{i}" for i in range(n)], "a0.s0" + "".join(f" + a{i}.s{i} - {pacing}::DOUBLE * (a{i}.frame_idx - a{i - 1}.frame_idx)" for i in range(1, n))
    joins = "triple a0" + "".join(f" JOIN triple a{i} ON a{i}.query_id = a0.query_id AND a{i}.video_id = a0.video_id AND a{i}.frame_idx >= a{i - 1}.frame_idx + {gap}" for i in range(1, n))
    tup = "SELECT a0.query_id, a0.video_id, " + ", ".join(f"a{i}.frame_idx AS f{i}" for i in range(n)) + f", {score} AS score FROM {joins}"
    order = "round(score, 9) DESC, " + ", ".join(reversed(names))
    return sql(f"SELECT query_id, video_id, {', '.join(names)}, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY {order}) AS rank FROM tup) WHERE rank <= {k}", "triple", tup=tup)


def _best(found: DataFrame, n: int) -> DataFrame:
    return found.select("query_id", "video_id", *[f"f{i}" for i in range(n)], F.round("score", 6).alias("score"), "rank")


@query(_tuples_sql(2, 5))
def kbest_pairs(t: Tables) -> DataFrame:
    return _best(sequence.k_best_by_joins(triples(t), 2, 5), 2)


@query(_tuples_sql(3, 3))
def kbest_triples(t: Tables) -> DataFrame:
    return _best(sequence.k_best_by_joins(triples(t), 3, 3), 3)


@query(_tuples_sql(2, 5, gap=40))
def kbest_min_gap(t: Tables) -> DataFrame:
    return _best(sequence.k_best_by_joins(triples(t), 2, 5, min_gap=40), 2)


@query(_tuples_sql(2, 5, pacing=0.001))
def kbest_pacing(t: Tables) -> DataFrame:
    return _best(sequence.k_best_by_joins(triples(t), 2, 5, pacing=0.001), 2)


@query(_tuples_sql(3, 3))
def kbest_viterbi(t: Tables) -> DataFrame:
    return _best(sequence.k_best_by_groups(triples(t), 3, 3), 3)


@query(
    sql(
        "SELECT query_id, video_id, f0, f1, round(paced, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, video_id ORDER BY paced DESC, rank) AS INT) AS rank FROM (SELECT *, score - 0.001::DOUBLE * (f1 - f0) AS paced FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, f1, f0) AS rank FROM tup) WHERE rank <= 5)",
        "triple", tup="SELECT a0.query_id, a0.video_id, a0.frame_idx AS f0, a1.frame_idx AS f1, a0.s0 + a1.s1 AS score FROM triple a0 JOIN triple a1 ON a1.query_id = a0.query_id AND a1.video_id = a0.video_id AND a1.frame_idx > a0.frame_idx",
    )
)
def pacing_posthoc(t: Tables) -> DataFrame:
    return _best(sequence.paced(sequence.k_best_by_joins(triples(t), 2, 5), 2, 0.001), 2)


@query(
    sql(
        "SELECT query_id, video_id, f0, f1, f2, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, video_id, f0, f1, f2) AS INT) AS answer_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 9) DESC, f2, f1, f0) AS r FROM tup) WHERE r = 1",
        "triple", tup="SELECT a.query_id, a.video_id, a.frame_idx AS f0, b.frame_idx AS f1, c.frame_idx AS f2, a.s0 + b.s1 + c.s2 AS score FROM triple a JOIN triple b ON b.query_id = a.query_id AND b.video_id = a.video_id AND b.frame_idx > a.frame_idx JOIN triple c ON c.query_id = a.query_id AND c.video_id = a.video_id AND c.frame_idx > b.frame_idx",
    )
)
def trake_emit(t: Tables) -> DataFrame:
    return sequence.emit(triples(t), 3).select("query_id", "video_id", "f0", "f1", "f2", "answer_rank")


# -- grading: a query's truth is its label's video, from its first vector to 200 frames on ------

_GT = "SELECT CAST(label AS BIGINT) AS query_id, 'v' || CAST(label AS VARCHAR) AS gt, CAST(min(vec_id) AS INT) AS s, CAST(min(vec_id) AS INT) + 200 AS e FROM embeddings GROUP BY label"
_GRADED = "SELECT r.query_id, rank, CASE WHEN video_id = gt AND frame_idx BETWEEN s AND e THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM ranked r JOIN gt USING (query_id)"
_RK = ", ".join(f"coalesce(max(r) FILTER (WHERE rank <= {k}), 0.0::DOUBLE) AS r_{k}" for k in numbers.CUTS)
_FIN = "(" + " + ".join(f"r_{k}" for k in numbers.CUTS) + ") / 5"


def _truth(t: Tables) -> DataFrame:
    first = t.embeddings.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min("vec_id").cast("int").alias("s"))
    return first.select("query_id", F.concat(F.lit("v"), F.col("query_id").cast("string")).alias("gt"), "s", (F.col("s") + 200).alias("e"))


def _ranked(t: Tables) -> DataFrame:
    best = nearest.scan_top_k(t.frames, t.asked, numbers.BUDGET, digits=9)
    return best.join(t.frames.select("row_id", "video_id", "frame_idx"), "row_id")


def _graded(t: Tables) -> DataFrame:
    met = _ranked(t).join(_truth(t), "query_id")
    windows = F.array(F.struct("s", "e"))
    r = scoring.r_score(F.lit("kis"), F.col("video_id"), F.array("frame_idx"), F.lit(None).cast("string"), F.col("gt"), windows, F.array().cast("array<string>"))
    return met.select("query_id", "rank", r.alias("r"))


@query(sql(f"SELECT query_id, {_RK} FROM graded WHERE rank <= 100 GROUP BY query_id", "ranked", gt=_GT, graded=_GRADED))
def r_at_k(t: Tables) -> DataFrame:
    return scoring.recall_table(_graded(t), _truth(t)).select("query_id", *[f"r_{k}" for k in numbers.CUTS])


@query(
    sql(
        f"SELECT query_id, round({_FIN}, 6) AS final, best, CAST(best_rank AS INT) AS best_rank, round(best - {_FIN}, 6) AS ranking_loss FROM (SELECT query_id, {_RK}, max(r) AS best, arg_min(rank, rank - r * 1000) AS best_rank FROM graded WHERE rank <= 100 GROUP BY query_id)",
        "ranked", gt=_GT, graded=_GRADED,
    )
)
def final_score(t: Tables) -> DataFrame:
    out = scoring.recall_table(_graded(t), _truth(t))
    return out.select("query_id", F.round("final", 6).alias("final"), "best", "best_rank", F.round("ranking_loss", 6).alias("ranking_loss"))


@query(
    sql(
        f"""SELECT CAST(g.query_id AS VARCHAR) AS query_id, {', '.join(f'coalesce(r_{k}, 0.0) AS r_{k}' for k in numbers.CUTS)}, round(coalesce({_FIN}, 0.0), 6) AS final, coalesce(n, 0) AS answers FROM gt g LEFT JOIN
        (SELECT query_id, count(*) AS n, {_RK} FROM graded WHERE rank <= 100 AND query_id % 4 <> 3 GROUP BY query_id) USING (query_id)""",
        "ranked", gt=_GT, graded=_GRADED,
    )
)
def graded_submission(t: Tables) -> DataFrame:
    """A submission is written in its files, read back, joined with the truth by the query its task is for, and graded; every fourth query was not answered."""
    from ..sources import readers, writers

    path = fresh_path(t.spark, "submission")
    given = _ranked(t).where("query_id % 4 <> 3").select(F.concat(F.lit("01-kis-"), F.col("query_id").cast("string")).alias("task_id"), "rank", "video_id", F.array("frame_idx").alias("frames"), F.lit(None).cast("string").alias("answer"))
    extra = given.limit(1).withColumn("task_id", F.lit("01-kis-nobody"))
    writers.submission_csv(given.unionByName(extra), path)
    answers = readers.submission_files(t.spark, f"{path}/*/*", depth=1).withColumn("query_id", readers.task_query(F.col("task_id")))
    truth = _truth(t).select(F.col("query_id").cast("string").alias("query_id"), F.lit("kis").alias("kind"), F.col("gt").alias("video_id"), F.array(F.struct("s", "e")).alias("windows"), F.array().cast("array<string>").alias("accepted"))
    table = scoring.recall_table(scoring.graded(answers, truth), truth)
    counts = answers.groupBy("query_id").agg(F.count("*").alias("answers"))
    return table.join(counts, "query_id", "left").select("query_id", *[f"r_{k}" for k in numbers.CUTS], F.round("final", 6).alias("final"), F.coalesce("answers", F.lit(0)).cast("long").alias("answers"))


@query(
    sql(
        f"""SELECT CASE WHEN grouping(query_type) = 1 THEN 'all' ELSE query_type END AS query_type, count(*) AS n, {', '.join(f'round(avg(r_{k}), 6) AS r_{k}' for k in numbers.CUTS)}, round(avg({_FIN}), 6) AS final
        FROM (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS query_type, {_RK} FROM graded WHERE rank <= 100 GROUP BY query_id) GROUP BY CUBE (query_type)""",
        "ranked", gt=_GT, graded=_GRADED,
    )
)
def by_type(t: Tables) -> DataFrame:
    table = scoring.recall_table(_graded(t), _truth(t)).withColumn("query_type", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    out = scoring.by_type(table)
    return out.select("query_type", "n", *[F.round(c, 6).alias(c) for c in (*[f"r_{k}" for k in numbers.CUTS], "final")])


@query(
    """SELECT l_orderkey AS ok, round(CAST(count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 10 + 5 * l_linenumber) AS DOUBLE) / count(*), 6) AS r FROM lineitem GROUP BY l_orderkey"""
)
def trake_rscore(t: Tables) -> DataFrame:
    """An order's lines as the events of a sequence, quantities as frames."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("i"), F.col("l_quantity").cast("int").alias("q")))).alias("x"))
    windows = F.transform("x", lambda x: F.struct(F.lit(10).alias("s"), (10 + 5 * x["i"]).alias("e")))
    r = scoring.r_score(F.lit("trake"), F.lit("v"), F.transform("x", lambda x: x["q"]), F.lit(None).cast("string"), F.lit("v"), windows, F.array().cast("array<string>"))
    return lines.select(F.col("l_orderkey").alias("ok"), F.round(r, 6).alias("r"))


@query("""SELECT c_custkey AS ck, CASE WHEN c_nationkey BETWEEN 5 AND 15 AND lower(trim(regexp_replace(c_mktsegment, '\\s+', ' ', 'g'))) IN ('building', 'machinery') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM customer""")
def qa_rscore(t: Tables) -> DataFrame:
    windows = F.array(F.struct(F.lit(5).alias("s"), F.lit(15).alias("e")))
    from ..functions.text import answer_matches

    r = scoring.r_score(F.lit("qa"), F.lit("v"), F.array(F.col("c_nationkey").cast("int")), F.concat(F.lit("  "), F.col("c_mktsegment")), F.lit("v"), windows, F.array(F.lit("Building"), F.lit(" MACHINERY ")), answer_matches)
    return t.customer.select(F.col("c_custkey").alias("ck"), r.alias("r"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS ok, (CASE WHEN r <= 1 THEN 1 ELSE 0 END + CASE WHEN r <= 5 THEN 1 ELSE 0 END + CASE WHEN r <= 20 THEN 1 ELSE 0 END + CASE WHEN r <= 50 THEN 1 ELSE 0 END + CASE WHEN r <= 100 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS w FROM (SELECT o_orderkey, o_custkey % 130 + 1 AS r FROM orders)")
def slot_weight(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("long").alias("ok"), numbers.slot_weight(F.col("o_custkey") % 130 + 1).alias("w"))


@query("SELECT doc_id, CASE WHEN q = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strict, CASE WHEN q = 2 THEN 1.0::DOUBLE WHEN q = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS graded FROM (SELECT doc_id, max(quality + toxic) AS q FROM labels GROUP BY doc_id)")
def shot_graded(t: Tables) -> DataFrame:
    rel = t.labels.groupBy("doc_id").agg(F.max(F.col("quality") + F.col("toxic")).alias("q"))
    return rel.select("doc_id", scoring.shot_grade(F.col("q"), True).alias("strict"), scoring.shot_grade(F.col("q"), False).alias("graded"))


@query(
    sql(
        """SELECT query_id, round(avg(CASE WHEN rank <= 1 THEN 1.0 WHEN rank <= 5 THEN 0.8 WHEN rank <= 20 THEN 0.6 WHEN rank <= 50 THEN 0.4 WHEN rank <= 100 THEN 0.2 ELSE 0.0 END), 6) AS final FROM
        (SELECT p.query_id, p.c, min(r.rank) AS rank FROM (SELECT query_id, gt, unnest(range(s, e + 1)) AS c FROM gt) p LEFT JOIN ranked r ON r.query_id = p.query_id AND r.rank <= 100 AND r.video_id = p.gt AND r.frame_idx BETWEEN p.c - 5 AND p.c + 5 GROUP BY p.query_id, p.c) GROUP BY query_id""",
        "ranked", gt=_GT,
    )
)
def jitter_expectation(t: Tables) -> DataFrame:
    windows = _truth(t).select("query_id", F.col("gt").alias("video_id"), F.col("s").alias("lo"), F.col("e").alias("hi"))
    return scoring.jitter_expectation(_ranked(t).select("query_id", "rank", "video_id", "frame_idx"), windows, 11).select("query_id", F.round("final", 6).alias("final"))


@query(
    sql(
        """SELECT 'final against 0.5' AS arm, mean, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi, wins, losses FROM
        (SELECT r, sum(w * delta) / nullif(sum(w), 0) AS m FROM (SELECT r, delta, len(list_filter([24109, 48219, 60273, 64291, 65296, 65497, 65531], lambda x: x <= u)) AS w FROM
          (SELECT r, delta, CAST('0x' || substr(md5('0:' || query_id || ':' || r // 8), CAST(4 * (r % 8) + 1 AS BIGINT), 4) AS BIGINT) AS u FROM d, (SELECT unnest(range(4000)) AS r))) GROUP BY r),
        (SELECT round(avg(delta), 9) AS mean, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta < 0) AS losses FROM d) GROUP BY mean, wins, losses""",
        "ranked", gt=_GT, graded=_GRADED, d=f"SELECT query_id, {_FIN} - 0.5::DOUBLE AS delta FROM (SELECT query_id, {_RK} FROM graded WHERE rank <= 100 GROUP BY query_id)",
    )
)
def bootstrap_ci(t: Tables) -> DataFrame:
    table = scoring.recall_table(_graded(t), _truth(t))
    found = scoring.bootstrap_difference(table.select(F.lit("final against 0.5").alias("arm"), "query_id", (F.col("final") - 0.5).alias("delta")))
    return found.select("arm", *[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")], "wins", "losses")


# -- windows and placement ----------------------------------------------------


@query("SELECT CAST(p_partkey AS BIGINT) AS k, unnest(list_sort(list_distinct(list_transform(range(5), lambda i: least(1000, greatest(0, p_size * 20 - 20 + CAST(i AS INT) * 10)))))) AS frame FROM part")
def uniform_grid(t: Tables) -> DataFrame:
    grid = numbers.uniform_grid((F.col("p_size") * 20).cast("int"), 5, 10, F.lit(0), F.lit(1000))
    return t.part.select(F.col("p_partkey").cast("long").alias("k"), F.explode(grid).alias("frame"))


@query(
    """SELECT k, CAST(pos AS INT) AS pos, CAST(f AS INT) AS frame FROM (SELECT k, f, row_number() OVER (PARTITION BY k ORDER BY abs(f - c), f) - 1 AS pos FROM
    (SELECT DISTINCT k, c, CAST(round_even(lo + i * ((hi - lo) / CAST(m - 1 AS DOUBLE)), 0) AS INT) AS f FROM (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS INT) * 20 AS c, CAST(p_size AS INT) * 17 AS lo, CAST(p_size AS INT) * 22 AS hi, 7 AS m, unnest(range(7)) AS i FROM part)))"""
)
def spread_window(t: Tables) -> DataFrame:
    c, lo, hi = ((F.col("p_size") * k).cast("int") for k in (20, 17, 22))
    return t.part.select(F.col("p_partkey").cast("long").alias("k"), F.posexplode(numbers.spread_in_window(c, lo, hi, F.lit(7))).alias("pos", "frame"))


@query("SELECT CAST(p_partkey AS BIGINT) AS k, CAST(least(20, greatest(3, round_even((p_size * 3 + 1) / 10.0, 0) + 1)) AS INT) AS m FROM part")
def adaptive_m(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").cast("long").alias("k"), numbers.adaptive_m(F.lit(0), F.col("p_size").cast("int") * 3).alias("m"))


_POSTERIOR = "SELECT user_id AS case_id, CAST(hour(ts) AS BIGINT) AS frame, sum(value) AS weight FROM events GROUP BY ALL"
_PLACED = "SELECT DISTINCT user_id AS case_id, CAST(hour(ts) AS BIGINT) AS frame FROM events WHERE event_type = 'purchase'"


def _posterior(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("case_id"), F.hour("ts").cast("long").alias("frame")).agg(F.sum("value").alias("weight"))


@query(
    sql(
        "SELECT case_id, round(CASE WHEN sum(weight) > 0 THEN sum(CASE WHEN hit THEN weight ELSE 0.0 END) / sum(weight) ELSE 0.0 END, 6) AS p FROM (SELECT p.*, EXISTS (SELECT 1 FROM c WHERE c.case_id = p.case_id AND p.frame BETWEEN c.frame - 1 AND c.frame + 1) AS hit FROM p) GROUP BY case_id",
        p=_POSTERIOR, c=_PLACED,
    )
)
def hit_probability(t: Tables) -> DataFrame:
    placed = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("case_id"), F.hour("ts").cast("long").alias("frame"))
    return coverage.hit_probability(placed, _posterior(t), 3).select("case_id", F.round("p", 6).alias("p"))


#: Weights in hundredths, so that sums are whole and ties are ties.
_CENTS = "SELECT case_id, frame, CAST(round(weight * 100) AS BIGINT) AS weight FROM p"


def _rounds_sql(m: int, length: int) -> dict[str, str]:
    out = {"c": _CENTS, "e1": f"SELECT *, {{'covered': own, 'starts': [frame]}} AS e FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY case_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND {length - 1} FOLLOWING) AS BIGINT) AS own FROM c WHERE weight > 0)"}
    for j in range(2, m + 1):
        out[f"e{j}"] = f"""SELECT * EXCLUDE (b, e), CASE WHEN b IS NULL THEN {{'covered': own, 'starts': [frame]}} ELSE {{'covered': own + b.covered, 'starts': list_append(b.starts, frame)}} END AS e
            FROM (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND {length} PRECEDING) AS b FROM e{j - 1})"""
    return out


@query(
    sql(
        "SELECT case_id, unnest(list_transform(e.starts, lambda f: f + 1)) AS frame FROM (SELECT case_id, max(e) AS e FROM (SELECT case_id, e FROM e1 UNION ALL SELECT case_id, e FROM e2 UNION ALL SELECT case_id, e FROM e3) GROUP BY case_id)",
        p=_POSTERIOR, **_rounds_sql(3, 4),
    )
)
def optimal_placement(t: Tables) -> DataFrame:
    cents = _posterior(t).withColumn("weight", F.round(F.col("weight") * 100).cast("long"))
    return coverage.optimal_placement(cents, 3, 4)


@query(
    sql(
        """SELECT round(avg(c) FILTER (WHERE kind = 'within'), 6) AS within, round(avg(c) FILTER (WHERE kind = 'across'), 6) AS across, avg(c) FILTER (WHERE kind = 'within') - avg(c) FILTER (WHERE kind = 'across') > 0.05 AS passed
        FROM (SELECT kind, list_inner_product(a.emb, b.emb) AS c FROM pairs JOIN frames a ON a.row_id = pairs.row_id JOIN frames b ON b.row_id = pairs.other)""",
        "frames", lanes="SELECT greatest(1, (count(*) + 4095) // 4096) AS n FROM frames", ids="SELECT row_id, video_id, md5('0:' || row_id) AS draw FROM frames", dealt="SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % n AS lane FROM ids, lanes",
        pairs="""SELECT 'within' AS kind, row_id, lead(row_id) OVER (PARTITION BY video_id ORDER BY row_id) AS other FROM ids
            UNION ALL SELECT 'across', row_id, other FROM (SELECT row_id, video_id, lead(row_id) OVER w AS other, lead(video_id) OVER w AS v FROM dealt WINDOW w AS (PARTITION BY lane ORDER BY draw, row_id)) WHERE v <> video_id""",
    )
)
def temporal_cohesion(t: Tables) -> DataFrame:
    return frame_index.temporal_cohesion(t.frames).select(F.round("within", 6).alias("within"), F.round("across", 6).alias("across"), "passed")


@query(
    sql(
        "SELECT gt AS class, CAST(max(CASE WHEN rank = 1 THEN CAST(hit AS INT) END) AS DOUBLE) AS p_at_1, round(avg(CAST(hit AS INT)), 6) AS p_at_k, round(avg(CAST(hit AS INT)) / max(prevalence), 6) AS lift FROM (SELECT 'v' || CAST(query_id AS VARCHAR) AS gt, rank, 'v' || CAST(query_id AS VARCHAR) = video_id AS hit FROM ranked WHERE rank <= 10) JOIN (SELECT video_id AS gt, count(*) / CAST((SELECT count(*) FROM frames) AS DOUBLE) AS prevalence FROM frames GROUP BY 1) USING (gt) GROUP BY gt",
        "ranked",
    )
)
def detector_lift(t: Tables) -> DataFrame:
    own = F.concat(F.lit("v"), F.col("query_id").cast("string"))
    ranked = _ranked(t).select(own.alias("class"), "rank", (own == F.col("video_id")).alias("hit"))
    n = t.frames.agg(F.count("*").alias("all"))
    prevalence = t.frames.groupBy(F.col("video_id").alias("class")).agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("class", (F.col("c") / F.col("all")).alias("prevalence"))
    out = scoring.label_precision(ranked, prevalence, 10)
    return out.select("class", "p_at_1", F.round("p_at_k", 6).alias("p_at_k"), F.round("lift", 6).alias("lift"))


@query(
    sql(
        "SELECT a.query_id, round(count(*) FILTER (WHERE b.row_id IS NOT NULL) / 20.0::DOUBLE, 6) AS overlap FROM (SELECT * FROM ranked WHERE rank <= 20) a LEFT JOIN (SELECT query_id, row_id FROM (SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(emb[1:32], vector[1:32]) / sqrt(list_inner_product(emb[1:32], emb[1:32])) / sqrt(list_inner_product(vector[1:32], vector[1:32])), 9) DESC, row_id) AS r FROM frames, asked) WHERE r <= 20) b ON a.query_id = b.query_id AND a.row_id = b.row_id GROUP BY a.query_id",
        "ranked",
    )
)
def overlap_at_k(t: Tables) -> DataFrame:
    """How many of the 20 best by whole vectors are among the 20 best by their first half."""
    from ..functions.vectors import truncate_and_normalize

    whole = _ranked(t).where("rank <= 20").groupBy("query_id").agg(F.collect_set("row_id").alias("a"))
    short = [df.withColumn(c, truncate_and_normalize(F.col(c), 32)) for df, c in ((t.frames.select("row_id", "emb"), "emb"), (t.asked, "vector"))]
    part = nearest.scan_top_k(*short, 20, digits=9).groupBy("query_id").agg(F.collect_set("row_id").alias("b"))
    return whole.join(part, "query_id").select("query_id", F.round(F.size(F.array_intersect("a", "b")) / 20.0, 6).alias("overlap"))
