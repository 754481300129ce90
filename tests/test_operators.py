import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import coverage, frame_index, fusion, intervals, lexical, matrix, nearest, planning, pooling, rerank, scoring, sequence, submission

FRAMES = [("A", 1, 0), ("A", 2, 1), ("A", 3, 2), ("B", 1, 3)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(v, n, r, float(ts)) for (v, n, r), ts in zip(FRAMES, (1000, 10000, 20000, 0), strict=True)], "video_id string, n int, row_id long, ts_ms double")


def probe(spark, *texts):
    return spark.createDataFrame([(0, i, x) for i, x in enumerate(texts)], "query_id int, probe_idx int, text string")


def scores(spark, rows):
    return spark.createDataFrame([(0, 0, s, r, float(x), c) for s, r, x, c in rows], "query_id int, probe_idx int, source string, row_id long, score double, covered boolean")


def listed(spark, **sources):
    return scores(spark, [(s, r, x, True if c is None else c[r]) for s, (xs, c) in sources.items() for r, x in enumerate(xs)])


def test_text_source(spark, frames):
    texts = spark.createDataFrame([(0, "con meo trang nam tren ghe"), (2, "con cho den chay ngoai san"), (3, "con meo den"), (1, "  ")], "row_id long, text string")
    vectors = lambda p: p.withColumn("vector", F.array(F.lit(1.0)))
    shown = lambda p: matrix.ScoreMatrix(frames.select("row_id", "video_id", F.array(F.lit(1.0)).alias("emb")), vectors(p), {"x": lexical.text_source(texts, p, "x")}, visual=None)
    got = {r.row_id: r for r in shown(probe(spark, "mèo")).scores().collect()}
    assert [got[i].covered for i in range(4)] == [True, False, True, True]
    assert got[0].score > 0 and got[1].score == got[2].score == 0 and got[3].score > 0
    blank = shown(probe(spark, " ")).scores().collect()
    assert {r.score for r in blank} == {0} and sum(r.covered for r in blank) == 3


def test_matrix_equals_the_long_table(spark):
    """Moments, nominations, pool rows and fused scores against plans over every cell."""
    rng = np.random.default_rng(4)
    emb, vectors = rng.normal(size=(200, 6)), rng.normal(size=(7, 6))
    emb[:40] = emb[0]  # ties
    vectors[3] = 0  # nothing varies
    f = spark.createDataFrame([(i, f"v{i % 5}", e.tolist()) for i, e in enumerate(emb)], "row_id long, video_id string, emb array<double>").repartition(3)
    q = spark.createDataFrame([(i // 2, i % 2, v.tolist()) for i, v in enumerate(vectors)], "query_id long, probe_idx int, vector array<double>")
    cells = [(i // 2, i % 2, r, round(float(rng.integers(1, 6)), 1)) for i in range(7) for r in sorted(rng.choice(120, 25, replace=False).tolist()) if i != 5]
    hits = spark.createDataFrame(cells, "query_id long, probe_idx int, row_id long, score double")
    text = lexical.Sparse(hits, spark.createDataFrame([(r,) for r in range(150)], "row_id long"))
    empty = lexical.Sparse(hits.where("false"), hits.select("row_id").where("false"))
    m = matrix.ScoreMatrix(f, q, {"ocr": text, "asr": empty})
    found = {(c[0], c[1], c[2]): c[3] for c in cells}
    long = [(i // 2, i % 2, "visual", r, round(float(emb[r] @ vectors[i]), 9), True) for i in range(7) for r in range(200)]
    long += [(i // 2, i % 2, s, r, found.get((i // 2, i % 2, r), 0.0) if s == "ocr" else 0.0, r < 150 and s == "ocr") for s in ("ocr", "asr") for i in range(7) for r in range(200)]
    plain = spark.createDataFrame(long, "query_id long, probe_idx int, source string, row_id long, score double, covered boolean")
    key = lambda r: (r.query_id, r.probe_idx, r.source, r.row_id, round(r.score, 8), r.covered, round(r.z, 6) + 0.0)
    every = sorted(map(key, m.scores().collect()))
    assert every == sorted(map(key, fusion.z_normalize(plain).collect()))
    for quota in ((5, 2), (40, None), (3, 1)):
        names = lambda df: {(r.query_id, r.probe_idx, r.source, r.row_id, r.nth) for r in df.collect()}
        assert names(m.nominated(*quota)) == names(pooling.nominate(plain, f, *quota))
    weights = {"visual": 1.0, "ocr": 0.5, "asr": 0.25}
    sums = lambda df: {(r.query_id, r.probe_idx, r.row_id): round(r.s, 6) + 0.0 for r in df.collect()}
    want = sums(fusion.fuse(plain, weights))
    assert sums(m.fused(weights)) == want
    some = spark.createDataFrame([(0, 3), (0, 199), (1, 10), (3, 0), (9, 1)], "query_id long, row_id long")
    assert sums(m.fused_rows(some, weights)) == {k: v for k, v in want.items() if (k[0], k[2]) in {(0, 3), (0, 199), (1, 10), (3, 0)}}
    assert {r.source: round(r.coverage, 6) for r in m.coverage().collect()} == {"visual": 1.0, "ocr": 0.75, "asr": 0.0}
    assert sums(m.fused(weights | {"visual": 0.0})) == sums(fusion.fuse(plain, weights | {"visual": 0.0}))
    with pytest.raises(ValueError, match="no weight"):
        m.fused({"visual": 1.0})


def test_pools_write_no_matrix(spark):
    """No stage of a pool's plan has a row for each frame and probe."""
    f = spark.range(5000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id") % 50).alias("video_id"), F.array(F.sin("id"), F.cos("id")).alias("emb"))
    q = spark.range(60).select(F.col("id").alias("query_id"), F.lit(0).alias("probe_idx"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
    m = matrix.ScoreMatrix(f, q, {})
    assert m.nominated(10, 3).count() == 600
    assert nearest.best_rows(f, q, 10, 3, 0.0).count() <= 600 * f.rdd.getNumPartitions()
    assert nearest.folded(f, q).count() <= 60 * f.rdd.getNumPartitions()


def test_bm25(spark):
    docs = spark.createDataFrame([(str(i), "alpha" if i < 3 else "beta") for i in range(10)], "doc string, text string")
    index = lexical.build(docs)
    idf = {r.token: r.idf for r in index.terms.collect()}
    assert math.isclose(idf["alpha"], math.log(1 + 7.5 / 3.5))
    ties = lexical.best_hits(lexical.search(lexical.build(spark.createDataFrame([(d, "alpha") for d in "zam"], "doc string, text string")), probe(spark, "alpha")), 5)
    assert [r.doc for r in ties.orderBy("rank").collect()] == ["a", "m", "z"]
    many = lexical.build(spark.createDataFrame([("a", "alpha " * 100), ("b", "alpha"), ("c", "x")], "doc string, text string"))
    s = {r.doc: r.score for r in lexical.search(many, probe(spark, "alpha alpha"), b=0.0).collect()}
    assert s["b"] < s["a"] < 10 * s["b"]
    assert lexical.search(lexical.build(docs.where("false")), probe(spark, "alpha")).count() == 0


def test_index_files(spark, tmp_path):
    lexical.build(spark.createDataFrame([("a", "x y"), ("b", "y")], "doc string, text string"), str(tmp_path))
    assert {r.doc for r in lexical.search(lexical.read_index(spark, str(tmp_path)), probe(spark, "y")).collect()} == {"a", "b"}


def _many(rng, n):
    """Texts that all have one token, and others of any rarity."""
    return [(i, " ".join(["the"] + rng.choices([f"w{j}" for j in range(400)], weights=[1 / (j + 1) for j in range(400)], k=rng.randint(1, 40)))) for i in range(n)]


def test_hot_token_spreads(spark):
    """A token in every document is a row a bucket, in many partitions; none of its blocks is large."""
    index = lexical.build(spark.createDataFrame(_many(random.Random(3), 3000), "doc long, text string"), block_docs=100)
    hot = index.blocks.where("token = 'the'")
    assert hot.count() == 30 and hot.agg(F.sum("n")).first()[0] == 3000 and hot.agg(F.max("n")).first()[0] < 200
    assert index.blocks.where("token = 'the'").select(F.input_file_name()).distinct().count() >= 1
    assert index.terms.where("token = 'the'").first().df == 3000


@pytest.mark.parametrize("small", [50_000, 0])
def test_search_top_equals_all_hits(spark, monkeypatch, small):
    rng = random.Random(4)
    index = lexical.build(spark.createDataFrame(_many(rng, 2000), "doc long, text string"), block_docs=40)
    asked = [(i, 0, " ".join(rng.sample([f"w{j}" for j in range(400)], rng.choice([1, 2, 5, 20])) + ["the"] * (i % 2))) for i in range(25)] + [(90, 0, "w399 w398"), (91, 0, ""), (92, 0, "unknown"), (93, 0, "the")]
    probes = spark.createDataFrame(asked, "query_id long, probe_idx int, text string")
    monkeypatch.setattr(lexical, "SMALL", small)
    key = lambda r: (r.query_id, r["rank"], r.doc, round(r.score, 7))
    every = lexical.search(index, probes).withColumn("score", F.round("score", 9))
    assert sorted(map(key, lexical.search_top(index, probes, 5).collect())) == sorted(map(key, lexical.best_hits(every, 5).collect()))


def test_search_top_skips_buckets(spark, monkeypatch):
    """A rare token's floor keeps the other token's buckets shut."""
    rows = [(i, "common " + ("rare " * 3 if i in (7, 70) else "") + f"u{i}") for i in range(2000)]
    index = lexical.build(spark.createDataFrame(rows, "doc long, text string"), block_docs=40)
    looked, real = [], lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda met, *a: looked.append(met.select("bucket").distinct().count()) or real(met, *a))
    best = lexical.search_top(index, spark.createDataFrame([(1, 0, "rare common")], "query_id long, probe_idx int, text string"), 2).collect()
    assert {r.doc for r in best} == {7, 70} and sum(looked) < 20


def values(df, name="z"):
    return [r[name] for r in df.orderBy("row_id").collect()]


def test_normalise(spark):
    some = listed(spark, a=([1, 5, 9, 100, 0], [True] * 4 + [False]))
    for f in (fusion.z_normalize, fusion.rank_normalize):
        z = values(f(some))
        assert abs(sum(z[:4])) < 1e-9 and z[4] == 0
    assert values(fusion.z_normalize(listed(spark, a=([7] * 5, None)))) == [0] * 5
    assert math.isclose(np.std(values(fusion.z_normalize(listed(spark, a=([1, 2, 3, 4], None))))), 1)
    assert values(fusion.rank_normalize(listed(spark, a=([0, 0, 0, 0, 5], None)))) == [-0.125] * 4 + [0.5]
    assert values(fusion.z_normalize(listed(spark, a=([0, 0, 0, 0, 1e6], None))))[4] > 1.5


def test_fuse(spark):
    both = listed(spark, visual=([0.50, 0.52, 0.48], None), ocr=([9, 0, 0], [True, True, False]))
    s = values(fusion.fuse(both, {"visual": 1.0, "ocr": 1.0}), "s")
    assert s.index(max(s)) == 0
    assert values(fusion.fuse(both, {"visual": 2.0, "ocr": 0.0}), "s") == [2 * x for x in values(fusion.z_normalize(both.where("source = 'visual'")))]
    with pytest.raises(Exception, match="no weight for source ocr"):
        fusion.fuse(both, {"visual": 1.0}).collect()
    with pytest.raises(ValueError, match="unknown"):
        fusion.fuse(both, mode="x")


def nominated(spark, df, video="A" * 99, **quota):
    videos = spark.createDataFrame([(r, video[r]) for r in range(9)], "row_id long, video_id string")
    return {r.row_id for r in pooling.nominate(df, videos, **quota).collect()}


def test_pools(spark):
    two = listed(spark, visual=([9, 8, 7, 0], None), ocr=([0, 0, 0, 5], None))
    assert nominated(spark, two, per_source=1) == {0, 3}
    quota = listed(spark, ocr=([5, 5, 5, 5, 1, 0.9, 0.8, 0.7], None))
    assert nominated(spark, quota, "AAAABBBBB", per_source=4, per_video=2) == {0, 1, 4, 5}
    assert nominated(spark, listed(spark, o=([1, 9, 8, 2, 7, 3, 6, 4], None)), "AAAABBBBB", per_source=4, per_video=1) == {1, 4}
    assert nominated(spark, listed(spark, o=([3, 0, 0, 0], None)), per_source=4) == {0}
    assert nominated(spark, listed(spark, asr=([2, -1, -3], None)), per_source=3) == {0}
    assert nominated(spark, listed(spark, o=([0, 0, 3], [False, False, True])), per_source=3) == {2}
    videos = spark.createDataFrame([(r, "A") for r in range(4)], "row_id long, video_id string")
    base = fusion.best_over_probes(fusion.fuse(two, {"visual": 1.0, "ocr": 1.0}))
    pool = {r.row_id: r for r in pooling.union_pool(pooling.nominate(two, videos, 3, None), base).collect()}
    assert pool[3].sources == ["ocr"] and pool[3].prov == 4 and pool[0].prov == 1 and pool[0].agree == 1
    with pytest.raises(ValueError):
        pooling.nominate(two, videos, 0)


def test_quota_equals_greedy(spark):
    rng = random.Random(1)
    xs, video = [rng.randint(0, 9) for _ in range(60)], [rng.choice("ABC") for _ in range(60)]
    taken, count = set(), {}
    for r in sorted(range(60), key=lambda r: (-xs[r], r)):
        if xs[r] > 0 and len(taken) < 12 and count.get(video[r], 0) < 5:
            taken.add(r)
            count[video[r]] = count.get(video[r], 0) + 1
    videos = spark.createDataFrame(list(enumerate(video)), "row_id long, video_id string")
    assert {r.row_id for r in pooling.nominate(listed(spark, o=(xs, None)), videos, 12, 5).collect()} == taken


def test_nearest(spark):
    unit = [[1.0, 0.0], [0.0, 1.0], [2**-0.5, 2**-0.5], [-1.0, 0.0]]
    f = spark.createDataFrame(list(enumerate(unit)), "row_id long, emb array<float>")
    q = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query_id int, probe_idx int, vector array<float>")
    top = nearest.top_k(nearest.visual_source(f, q), 9).orderBy("rank").collect()
    assert top[0].row_id == 0 and top[-1].row_id == 3 and top[-1].score < 0
    scan = nearest.scan_top_k(f, q, 2).orderBy("rank").collect()
    assert [r.row_id for r in scan] == [0, 2]
    many = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(9)], "query_id int, probe_idx int, vector array<double>")
    blocks = list(nearest.probe_blocks(many, 40))
    assert sorted(int(x) for b in blocks for x in b.query) == list(range(9)) and len(blocks) > 1
    with pytest.raises(Exception, match="differ in length"):
        nearest.scan_top_k(f, many.withColumn("vector", F.array(F.lit(1.0))), 2).collect()
    with pytest.raises(ValueError):
        nearest.top_k(f, 0)


def test_intervals(spark, frames):
    said = spark.createDataFrame([("A", 0, 3000, "chao mung quy vi"), ("A", 18000, 22000, "ket thuc ban tin")], "video_id string, start_ms long, end_ms long, text string")
    assert {r.row_id: r.text for r in intervals.window_text(frames, said, 5000).collect()} == {0: "chao mung quy vi", 2: "ket thuc ban tin"}
    rng = random.Random(2)
    points = [(i, rng.choice("AB"), float(rng.randint(0, 40000))) for i in range(60)]
    spans = [(rng.choice("AB"), s := rng.randint(0, 40000), s + rng.randint(0, 9000), f"t{i}") for i in range(60)]
    got = intervals.overlap_join(spark.createDataFrame(points, "row_id long, video_id string, ts_ms double"), spark.createDataFrame(spans, "video_id string, start_ms long, end_ms long, text string"), 700, 1900)
    want = sorted((p[0], s[3]) for p in points for s in spans if p[1] == s[0] and s[2] >= p[2] - 700 and s[1] <= p[2] + 1900)
    assert sorted((r.row_id, r.text) for r in got.collect()) == want


def test_long_spans_have_few_copies(spark):
    """A span of days beside short ones: every pair is found once, and the span is no row for each cell it touches."""
    rng = random.Random(12)
    points = [(i, "A", float(rng.randint(-200_000, 4 * 86_400_000))) for i in range(80)] + [(99, "A", 0.0)]
    spans = [("A", s := rng.randint(-300_000, 4 * 86_400_000), s + rng.choice([0, 500, 30_000, 3_600_000, 86_400_000]), f"t{i}") for i in range(60)] + [("A", -250_000, 4 * 86_400_000, "all"), ("A", 5, 4, "none")]
    p = spark.createDataFrame(points, "row_id long, video_id string, ts_ms double")
    s = spark.createDataFrame(spans, "video_id string, start_ms long, end_ms long, text string")
    got = intervals.overlap_join(p, s, 700, 1900)
    want = sorted((p[0], s[3]) for p in points for s in spans if s[1] <= s[2] and s[2] >= p[2] - 700 and s[1] <= p[2] + 1900)
    assert sorted((r.row_id, r.text) for r in got.collect()) == want
    nodes = spark.sql("SELECT CAST(-7 AS BIGINT) AS a, CAST(100000 AS BIGINT) AS z").select(intervals._nodes("a", "z", 16).alias("n")).first().n
    covered = [c for x in nodes for c in range(x.at << x.level, (x.at + 1) << x.level)]
    assert sorted(covered) == list(range(-7, 100_001)) and len(nodes) <= 34


def test_asof_of_one_key_in_many_tasks(spark):
    rng = random.Random(13)
    shots = [("A", s, s + rng.randint(0, 30), i) for i, s in enumerate(sorted(rng.sample(range(100, 3000), 60)))]
    at = [("A", rng.randint(0, 3200)) for _ in range(400)] + [(None, 5)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = intervals.asof_join(spark.createDataFrame(at, "v string, f int"), spark.createDataFrame(shots, "v string, s int, e int, shot int"), "v", "f", "s", "e")
        assert found.where("v = 'A'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        got = sorted((r.f, r.shot if r.shot is not None else -1) for r in found.where("v = 'A'").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = []
    for k, f in at[:-1]:
        last = [x for x in shots if x[1] <= f]
        want.append((f, last[-1][3] if last and f <= last[-1][2] else -1))
    assert got == sorted(want) and found.where("v is null").first().shot is None


def test_asof(spark):
    shots = spark.createDataFrame([("A", 0, 10, 1), ("A", 20, 30, 2), ("B", 5, 6, 3)], "v string, s int, e int, shot int")
    at = spark.createDataFrame([("A", f) for f in (0, 10, 15, 20, 99)] + [("B", 4), ("B", 6), ("C", 1)], "v string, f int")
    got = {(r.v, r.f): r.shot for r in intervals.asof_join(at, shots, "v", "f", "s", "e").collect()}
    assert got == {("A", 0): 1, ("A", 10): 1, ("A", 15): None, ("A", 20): 2, ("A", 99): None, ("B", 4): None, ("B", 6): 3, ("C", 1): None}


def cells(spark, s, times, video="A"):
    rows = [(0, video, r, float(times[r]), *map(float, c)) for r, c in enumerate(zip(*s, strict=True))]
    return spark.createDataFrame(rows, ", ".join(["query_id int, video_id string, row_id long, ts_ms double", *(f"s{i} double" for i in range(len(s)))]))


def path(spark, s, times, lam=0.0):
    got = sequence.best_paths(cells(spark, s, times), len(s), lam).collect()
    return (tuple(got[0].path), got[0].score) if got else None


@pytest.mark.parametrize("n,lam", [(1, 0.0), (2, 0.5), (3, 0.0), (4, 0.25)])
def test_chunks_of_one_video_give_its_best_path(spark, n, lam):
    """Whole scores and quarter seconds, so sums are exact and ties are many."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in range(4):
            rng = random.Random(seed)
            rows = [(0, v, i, rng.randint(0, 40) * 250.0, *[None if rng.random() < 0.1 else float(rng.randint(0, 4)) for _ in range(n)]) for v, k in (("A", 60), ("B", n), ("C", n - 1), ("D", 15)) for i in range(k)]
            df = spark.createDataFrame(rows, ", ".join(["query_id int, video_id string, row_id long, ts_ms double", *(f"s{i} double" for i in range(n))]))
            got = {r.video_id: (r.score, r.path) for r in sequence.best_paths_in_chunks(df, n, lam).collect()}
            assert got == {r.video_id: (r.score, r.path) for r in sequence.best_paths(df, n, lam).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_best_paths(spark):
    s, t = [[9, 0, 5, 0], [0, 9, 0, 5]], [0, 100_000, 200_000, 201_000]
    assert path(spark, s, t)[0] == (0, 1) and path(spark, s, t, 0.5)[0] == (2, 3)
    assert path(spark, [[0.1, 0.9, 0.3, 0.7]], range(4)) == ((1,), 0.9)
    assert path(spark, [[1, 2], [3, 4]], [5, 5])[0] == (0, 1)
    assert path(spark, [[4, 1, 0, 0], [0, 4, 1, 0]], [3000, 0, 1000, 2000]) == ((1, 2), 2.0)
    assert path(spark, [[0, 0]] * 3, [0, 1]) is None
    with pytest.raises(ValueError):
        path(spark, s, t, -1)


def test_best_paths_equal_enumeration(spark):
    rng = random.Random(3)
    for lam in (0.0, 0.3):
        s, t = [[rng.randint(0, 6) for _ in range(9)] for _ in range(3)], sorted(rng.randint(0, 20_000) for _ in range(9))
        best = max(sum(s[i][c] for i, c in enumerate(p)) - lam * (t[p[-1]] - t[p[0]]) / 1000 for p in itertools.combinations(range(9), 3))
        assert math.isclose(path(spark, s, t, lam)[1], best)


def pool(spark, fs, s):
    rows = [(0, "A", f, f, *map(float, c)) for f, c in zip(fs, zip(*s, strict=True), strict=True)]
    return spark.createDataFrame(rows, ", ".join(["query_id int, video_id string, row_id int, frame_idx int", *(f"s{i} double" for i in range(len(s)))]))


def tuples(df, n):
    return [tuple(r[f"f{i}"] for i in range(n)) for r in df.orderBy("rank").collect()]


def test_k_best(spark):
    fs = list(range(0, 300, 10))
    s = [[0.9 if f <= 80 else 0.8 if f == 100 else 0.0 for f in fs], [0.9 if f >= 200 else 0.8 if f == 110 else 0.0 for f in fs]]
    for k_best in (sequence.k_best_by_joins, sequence.k_best_by_groups):
        assert tuples(k_best(pool(spark, fs, s), 2, 20, pacing=0.01), 2)[0] == (100, 110)
        assert (100, 110) not in tuples(k_best(pool(spark, fs, s), 2, 20), 2)
        assert tuples(k_best(pool(spark, [5, 10, 15, 20], [[0.1, 0.9, 0.3, 0.7]]), 1, 3), 1) == [(10,), (20,), (15,)]
        assert tuples(k_best(pool(spark, [0, 1, 2], [[1, 1, 1]] * 2), 2, 3, min_gap=100), 2) == []


def test_best_first_equals_enumeration():
    rng = random.Random(4)
    for _ in range(150):
        m, n, k, gap, lam = rng.randint(1, 8), rng.randint(1, 4), rng.randint(1, 6), rng.randint(1, 4), rng.choice([0, 0.25])
        fs = sorted(rng.sample(range(20), m))
        s = [[rng.randint(0, 2) for _ in fs] for _ in range(n)]
        every = [(sum(s[i][j] for i, j in enumerate(p)) - lam * (fs[p[-1]] - fs[p[0]]), tuple(fs[j] for j in p)) for p in itertools.combinations(range(m), n) if all(fs[b] - fs[a] >= gap for a, b in itertools.pairwise(p))]
        assert sequence.k_best_tuples(fs, s, k, gap, lam) == sorted(every, key=lambda e: (-e[0], e[1][::-1]))[:k]


def test_pacing_and_emit(spark):
    t = spark.createDataFrame([(0, "A", 10, 25, 50, 2.0, 1), (0, "A", 10, 11, 12, 1.5, 2), (0, "A", 10, 15, 50, 2.0, 3)], "query_id int, video_id string, f0 int, f1 int, f2 int, score double, rank int")
    got = sequence.paced(t, 3, 0.1).orderBy("rank").collect()
    assert [r.f1 for r in got] == [11, 25, 15] and math.isclose(got[1].score, 2.0 - 4.0)
    p = spark.createDataFrame([(0, v, i, f, float(s)) for i, (v, f, s) in enumerate([("A", 10, 9), ("A", 20, 8), ("A", 30, 7), ("B", 40, 1), ("A", 10, 5)])], "query_id int, video_id string, row_id int, frame_idx int, s0 double")
    assert [r.video_id for r in sequence.emit(p, 1).orderBy("answer_rank").collect()] == ["A", "A", "A", "B"]


def test_rerank(spark):
    boxes = [[0, 0, 0.2, 0.2], [0, 0, 0.9, 0.9], [0, 0, 0.5, 0.5], [0, 0, 0.05, 0.05]]
    objects = spark.createDataFrame([("A", 1, ["Car", "Clothing", "Person", "Dot"], [[float(x) for x in b] for b in boxes])], "video_id string, n int, detection_class_entities array<string>, detection_boxes array<array<double>>")
    rows = spark.createDataFrame([(0, "A", 1), (1, "A", 2)], "row_id long, video_id string, n int")
    assert [r.entity for r in rerank.crops(objects, rows).orderBy(F.desc("area")).collect()] == ["Clothing", "Person"]
    assert [r.entity for r in rerank.crops(objects, rows, ["Car"]).collect()] == ["Car"]
    vec = spark.createDataFrame([(0, [0.2]), (0, [0.9]), (1, [-0.5]), (1, [-0.3])], "row_id long, vec array<double>")
    q = spark.createDataFrame([(0, 0, [1.0])], "query_id int, probe_idx int, vector array<double>")
    assert {r.row_id: r.score for r in rerank.crop_source(vec, q).collect()} == {0: 0.9, 1: -0.3}
    base = spark.createDataFrame([(0, 0, r, float(s)) for r, s in enumerate((5, 4, 3, 2, 1))], "query_id int, probe_idx int, row_id long, s double")
    one_only = scores(spark, [("vlm", 4, 0.9, True)])
    assert values(rerank.combine(base, one_only), "s") == values(rerank.combine(base, one_only.where("false")), "s")
    seen = values(rerank.combine(base, scores(spark, [("vlm", 0, 0.9, True), ("vlm", 1, 0.1, True)])), "s")
    plain = values(rerank.combine(base, one_only.where("false")), "s")
    assert seen[0] > plain[0] and seen[1] < plain[1] and seen[2] == plain[2]
    scored = rerank.model_scores(base, lambda b: b["row_id"] / 10.0).collect()
    assert {r.row_id: r.score for r in scored}[3] == 0.3


def test_scores(spark):
    w = lambda *x: F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in x])
    f = lambda *x: F.array(*map(F.lit, x))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    r = lambda *a: spark.range(1).select(scoring.r_score(*a)).first()[0]
    kis = [r(F.lit("kis"), F.lit("v"), f(x), none, F.lit("v"), w((500, 510)), empty) for x in (505, 600, 500, 510, 499, 511)]
    assert kis == [1, 0, 1, 1, 0, 0]
    ok = f("màu xanh")
    assert r(F.lit("qa"), F.lit("v"), f(888), F.lit("  Màu   Xanh "), F.lit("v"), w((800, 900)), ok) == 1
    assert r(F.lit("qa"), F.lit("v"), f(950), F.lit("màu xanh"), F.lit("v"), w((800, 900)), ok) == 0
    four = w((95, 105), (145, 155), (195, 205), (245, 255))
    assert r(F.lit("trake"), F.lit("v"), f(101, 156, 203, 251), none, F.lit("v"), four, empty) == 0.75
    assert r(F.lit("trake"), F.lit("v"), f(100, 150), none, F.lit("v"), four, empty) == 0.5
    assert r(F.lit("trake"), F.lit("x"), f(100, 150), none, F.lit("v"), four, empty) == 0
    with pytest.raises(Exception, match="unknown kind"):
        r(F.lit("other"), F.lit("v"), f(1), none, F.lit("v"), four, empty)


def test_recall_table(spark):
    hits = {1: 0.5, 3: 0.8, 15: 0.6}
    rows = [(1, k, hits.get(k, 0.1)) for k in range(1, 101)] + [(2, k, 1.0 if k > 100 else 0.0) for k in range(1, 151)]
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: r for r in scoring.recall_table(spark.createDataFrame(rows, "query_id int, rank int, r double"), q).collect()}
    assert math.isclose(got[1].final, 0.74) and math.isclose(got[1].ranking_loss, 0.06) and got[1].best_rank == 3
    assert got[2].final == 0 and got[3].final == 0 and got[3].best_rank is None


def test_bootstrap(spark):
    pairs = spark.createDataFrame([("x", i, 0.1 if i % 3 else -0.1) for i in range(90)], "arm string, query_id int, delta double")
    (r,) = scoring.bootstrap_difference(pairs, rounds=500).collect()
    assert r.lo < r.mean < r.hi and r.wins == 60 and r.losses == 30
    again = scoring.bootstrap_difference(pairs.repartition(7), rounds=500).first()
    assert again.lo == pytest.approx(r.lo) and again.hi == pytest.approx(r.hi)
    w = np.array([scoring.copies(0, q, 2000) for q in range(300)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    means = (w * np.array([0.1 if i % 3 else -0.1 for i in range(300)])[:, None]).sum(axis=0) / w.sum(axis=0)
    assert abs(means.std() - 0.0943 / 300**0.5) < 0.0006
    assert scoring.bootstrap_difference(pairs.where("false"), rounds=8).count() == 0


def test_best_tuples_lead_the_k_best(spark):
    rng = random.Random(8)
    rows = [(0, v, f, *[float(rng.randint(0, 3)) for _ in range(3)]) for v in "ABCDE" for f in sorted(rng.sample(range(30), rng.randint(1, 9)))]
    p = spark.createDataFrame(rows, "query_id int, video_id string, frame_idx int, s0 double, s1 double, s2 double")
    for gap, pacing in ((1, 0.0), (4, 0.25)):
        got = {r.video_id: (r.score, r.f0, r.f1, r.f2) for r in sequence.best_tuples(p, 3, gap, pacing).collect()}
        assert got == {r.video_id: (r.score, r.f0, r.f1, r.f2) for r in sequence.k_best_by_joins(p, 3, 1, gap, pacing).collect()}


def test_placement(spark):
    rng = np.random.default_rng(5)
    cases = {c: rng.integers(0, 5, rng.integers(1, 9)).astype(float) for c in range(12)}
    post = spark.createDataFrame([(c, i, float(w)) for c, p in cases.items() for i, w in enumerate(p)], "case_id int, frame int, weight double").cache()
    for m, length in itertools.product((1, 2, 3), (1, 3, 4)):
        found = {c: [] for c in cases}
        for r in coverage.optimal_placement(post, m, length).collect():
            found[r.case_id].append(r.frame)
        for c, p in cases.items():
            cover = lambda fs, p=p, length=length: sum(p[i] for i in range(len(p)) if any(f - (length - 1) // 2 <= i <= f + length // 2 for f in fs))
            assert len(found[c]) <= m and math.isclose(cover(found[c]), max(cover(s) for s in itertools.combinations(range(-5, len(p) + 5), m)))
    with pytest.raises(ValueError):
        coverage.optimal_placement(post, 0, 3)
    assert coverage.optimal_placement(post.where("weight < 0"), 2, 3).count() == 0
    with pytest.raises(Exception, match="negative"):
        coverage.optimal_placement(post.withColumn("weight", -F.col("weight")), 2, 3).collect()
    post = spark.createDataFrame([(1, i, 1.0) for i in range(20)], "case_id int, frame int, weight double")
    placed = spark.createDataFrame([(1, f) for f in (5, 10, 15, 19)], "case_id int, frame int")
    assert math.isclose(coverage.hit_probability(placed, post, 5).first().p, 0.85)
    best = coverage.optimal_placement(post, 4, 5)
    assert math.isclose(coverage.hit_probability(best, post, 5).first().p, 1.0)


def test_submissions(spark):
    tasks = spark.createDataFrame([("a", "kis", 1), ("b", "qa", 1), ("c", "trake", 2), ("d", "kis", 2), ("e", "kis", 1), ("a2", "kis", 1), ("a2", "kis", 1)], "task_id string, task_type string, n_moments int")
    answers = [("a", 1, "v", [5], None, 1.0), ("a", 2, "v", [5], None, 2.0), ("b", 1, "v", [5], " ", None), ("c", 1, "v", [9, 3], None, None), ("c", 2, "w", [1], None, None), ("d", 1, "v", [-1], None, None), ("a2", 1, "v", [700], None, None)]
    df = spark.createDataFrame(answers, "task_id string, rank int, video_id string, frames array<int>, answer string, score double")
    bounds = spark.createDataFrame([("v", 600)], "video_id string, n_frames int")
    valid = spark.createDataFrame([("v", 5), ("v", 3), ("v", 700)], "video_id string, frame_idx int")
    got = {(r.task_id, r.rule) for r in submission.violations(tasks, df, bounds=bounds, valid=valid).collect()}
    assert got >= {("a", "duplicate answer"), ("a", "scores not descending"), ("b", "answer missing"), ("c", "frames not ascending"), ("c", "wrong number of frames"), ("c", "unknown video"), ("d", "one moment only"), ("d", "negative frame"), ("d", "not a frame of the video"), ("e", "no answers"), ("a2", "duplicate task id"), ("a2", "frame beyond end")}
    ok = submission.violations(tasks.where("task_id = 'a'"), df.where("task_id = 'a' and rank = 1"), bounds=bounds, valid=valid)
    assert ok.count() == 0
    import json

    (p,) = submission.payload(tasks.where("task_id = 'c'"), df.where("task_id = 'c'"), shift=1).collect()
    assert json.loads(p.json)["results"][0] == {"rank": 1, "video_id": "v", "frame_ids": [10, 4]}
    sides = submission.missing_and_extra(tasks, df.where("task_id <> 'a'").select("task_id").unionByName(spark.createDataFrame([("z",)], "task_id string")))
    assert {(r.task_id, r.side) for r in sides.collect()} == {("a", "missing"), ("e", "missing"), ("z", "extra")}


def test_planning(spark):
    videos = spark.createDataFrame([(f"v{i}", w) for i, w in enumerate((7, 7, 6, 6, 5))], "video_id string, weight long")
    dealt = planning.deal(videos, 2)
    assert sorted(r.load for r in dealt.groupBy("shard").agg(F.sum("weight").alias("load")).collect()) == [13, 18]
    assert planning.shard_report(planning.deal(videos, 9), 9).first().least == 0
    with pytest.raises(ValueError):
        planning.deal(videos.unionByName(videos), 2)
    with pytest.raises(ValueError):
        planning.deal(videos.withColumn("weight", F.lit(0)), 2)


def test_light_videos_are_laid_end_to_end(spark):
    """Heavy ones greedily, light ones by sums of ranges: every video once, and no shard above the level by more than a light video."""
    rng = random.Random(5)
    for shards, heavy, light in ((7, [5000, 4000, 900], 3000), (3, [], 2000), (5, [10**6], 500), (1, [7], 90)):
        weights = heavy + [rng.randint(1, 9) for _ in range(light)]
        videos = spark.createDataFrame([(f"v{i}", w) for i, w in enumerate(weights)], "video_id string, weight long")
        dealt = planning.deal(videos, shards)
        rows = dealt.collect()
        assert sorted((r.video_id, r.weight) for r in rows) == sorted((f"v{i}", w) for i, w in enumerate(weights))
        loads = [sum(r.weight for r in rows if r.shard == s) for s in range(shards)]
        fair = max(sum(weights) / shards, max(weights))
        assert max(loads) <= fair + max(9, sum(weights) / shards / planning.HEAVY) and all(0 <= r.shard < shards for r in rows)
        assert "SinglePartition" not in dealt.where("shard = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert planning.water_level([5, 1, 9], 3) == (4, 1) and planning.water_level([5, 1, 9], 5) == (11, 2) and planning.water_level([0, 0], 0) == (0, 2)


def test_frame_index(spark, tmp_path):
    h = 2**-0.5
    rows = [("V2", 5, [0.0, 1.0, 0.0]), ("V1", 3, [0.0, 0.0, 1.0]), ("V1", 1, [1.0, 0.0, 0.0]), ("V2", 2, [h, h, 0.0])]
    vec = spark.createDataFrame(rows, "video_id string, n int, emb array<float>")
    idx = spark.createDataFrame([("V1", 1, 8), ("V1", 3, 129), ("V2", 2, 61), ("V2", 5, 425)], "video_id string, n int, frame_idx int")
    built = frame_index.build(vec, idx)
    assert [(r.row_id, r.video_id, r.n, r.frame_idx) for r in built.orderBy("row_id").collect()] == [(0, "V1", 1, 8), (1, "V1", 3, 129), (2, "V2", 2, 61), (3, "V2", 5, 425)]
    assert {(r.video_id, r.lo, r.hi) for r in frame_index.ranges(built).collect()} == {("V1", 0, 2), ("V2", 2, 4)}
    for bad in (vec.unionByName(vec), vec.withColumn("emb", F.expr("transform(emb, x -> x * 2)")), vec.withColumn("emb", F.when(F.col("n") == 5, F.expr("array(1.0f)")).otherwise(F.col("emb")))):
        with pytest.raises(ValueError):
            frame_index.build(bad, idx)
    with pytest.raises(ValueError, match="frame number"):
        frame_index.build(vec, idx.where("n <> 5"))
    built.write.parquet(str(tmp_path / "i"))
    assert frame_index.load(spark, str(tmp_path / "i"), 2).count() == 4
    built.withColumn("frame_idx", F.when(F.col("n") != 5, F.col("frame_idx"))).write.parquet(str(tmp_path / "j"))
    with pytest.raises(ValueError, match="broken"):
        frame_index.load(spark, str(tmp_path / "j"))
    paths = spark.createDataFrame([(0, 1, [2, 3])], "query_id int, rank int, path array<long>")
    assert frame_index.answers(paths, built).first().frames == [61, 425]
    with pytest.raises(Exception, match="one video"):
        frame_index.answers(spark.createDataFrame([(0, 1, [0, 3])], "query_id int, rank int, path array<long>"), built).collect()
    todo = spark.createDataFrame([("V1", 2), ("V2", 2)], "video_id string, frames long")
    done = spark.createDataFrame([("V1", 2, 2, 3, True), ("V2", 2, 1, 3, True)], "video_id string, vectors long, ids long, dim int, finite boolean")
    assert [r.video_id for r in frame_index.pending(todo, done).collect()] == ["V2"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lengths_need_no_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, " "), (3, "?!"), (4, None)], "doc long, text string")
    found = lexical.lengths(docs)
    assert sorted(map(tuple, found.collect())) == [(1, 3), (3, 0)] and "Exchange" not in _plan(found)
    assert tuple(lexical.corpus_of(found).first()) == (2, 1.5)
    index = lexical.build(docs, str(tmp_path))
    assert sorted(map(tuple, index.docs.collect())) == [(1, 3), (3, 0)] and {r.token for r in index.blocks.collect()} == {"a", "b"}


def test_blocks_of_a_bucket_stand_together(spark, tmp_path):
    """Texts are shuffled by bucket, postings are not: a bucket is in one file, and every file has rare and common tokens."""
    index = lexical.build(spark.createDataFrame([(i, f"the w{i % 7}") for i in range(400)], "doc long, text string"), str(tmp_path), block_docs=50)
    files = index.blocks.select("bucket", F.input_file_name().alias("f")).distinct().groupBy("bucket").count().collect()
    assert len(files) == 8 and all(r["count"] == 1 for r in files)


def test_speech_is_counted_once(spark):
    """The index of what is said around points is that of its text, for texts without tokens too; one of the tokens asked for has the same lengths."""
    points = spark.createDataFrame([(i, "v", i * 700.0) for i in range(40)], "row_id long, video_id string, ts_ms double")
    rows = [("v", 4000 * (i % 5), 4000 * (i % 5) + 3000, ["Đá x", "x y x", "?", " "][i % 4]) for i in range(19)] + [("v", 90000, 91000, "far"), ("v", 24000, 25000, "!")]
    spans = spark.createDataFrame(rows, "video_id string, start_ms long, end_ms long, text string")
    texts = intervals.window_text(points, spans).select(F.col("row_id").alias("doc"), "text")
    plain = lexical.build(texts)
    only = lexical.asked_tokens(spark.createDataFrame([("X?",), (None,)], "text string"))
    counted = lambda only: lexical.build_counted(intervals.window_counts(points, spans, only=only).withColumnRenamed("row_id", "doc"))
    entry = lambda i, some: sorted((r.token, e.doc, e.tf, e.dl) for r in i.blocks.collect() if r.token in some for e in r.entries)
    for index, tokens in ((counted(None), {"da", "x", "y"}), (counted(only), {"x"}), (lexical.build(texts, only=only), {"x"})):
        assert entry(index, {"da", "x", "y", "far"}) == entry(plain, tokens)
        assert sorted(map(tuple, index.docs.collect())) == sorted(map(tuple, plain.docs.collect())) and index.corpus.first() == plain.corpus.first()
        assert {r.token: r.idf for r in index.terms.collect()} == {r.token: r.idf for r in plain.terms.collect() if r.token in tokens}


def test_missing_and_extra_in_many_tasks(spark):
    """Both sides meet once, in tasks that are not put together; a null is on no other side."""
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "task_id string")
    found = submission.missing_and_extra(frame("a", "b", "b", None, None), frame("b", "c", "c", None))
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "missing"), ("c", "extra"), (None, "extra"), (None, "missing")]
    assert {tuple(r) for r in submission.missing_and_extra(frame("a", None), frame()).collect()} == {("a", "missing"), (None, "missing")}
    assert found.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
