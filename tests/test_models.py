import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import models
from skylattice.plans.model_queries import LetterEncoder
from skylattice.sources import staging, writers


def test_lazy_encoder_loads_when_asked():
    loads = []
    e = models.LazyEncoder(lambda: loads.append(1) or LetterEncoder(), 8)
    assert e.encode([]).shape == (0, 8) and not loads
    assert e.encode(["abc", "hh"]).tolist() == [[1, 1, 1, 0, 0, 0, 0, 0], [0] * 7 + [2]] and e.encode(["x"]).sum() == 0 and loads == [1]
    with pytest.raises(ValueError):
        models.LazyEncoder(LetterEncoder, 9).encode(["a"])


def test_encoder_speed():
    got = models.encoder_speed(LetterEncoder(), ["abc"] * 20, (1, 8))
    assert [r["batch"] for r in got] == [1, 8] and all(r["rows_per_second"] > 0 for r in got)


def test_encoded_vectors_are_unit(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, None), (3, "zzz")], "k int, t string")
    got = {r.k: r.vector for r in models.encoded(rows, "t", LetterEncoder, 8).collect()}
    assert set(got) == {1, 3} and np.allclose(np.linalg.norm(got[1]), 1) and not any(got[3])


def test_git_state(tmp_path):
    assert writers.git_state(str(tmp_path)) == {"branch": None, "commit": None}
    (tmp_path / ".git/refs/heads").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git/refs/heads/main").write_text("abc\n")
    assert writers.git_state(str(tmp_path)) == {"branch": "main", "commit": "abc"}


def test_staged(spark):
    rows = spark.range(250).withColumnRenamed("id", "k")
    assert sorted(r.k for r in staging.staged(rows, "test").collect()) == list(range(250))


def _frames(spark, rows):
    return spark.createDataFrame(rows, "video_id string, n int, text string")


def test_encoding_resumes(spark, tmp_path):
    rows = [(f"v{v}", n, "abcdefgh"[v % 8] * (n + 1)) for v in range(9) for n in range(v + 1)] + [("v0", 77, None)]
    store = writers.video_shards(spark, f"file://{tmp_path}/shards")
    assert store.units().count() == 0 and store.live() == []
    done = models.encode_pending(_frames(spark, rows), store, "text", LetterEncoder, 8, group_rows=10, groups=2)
    some = store.read().select("video_id").distinct().count()
    assert done <= 2 and 0 < some < 9
    before = store.live()
    store.append(spark.createDataFrame([("v1", 0, [9.0])], "video_id string, n int, vector array<float>"), commit=False)  # killed before its marker
    models.encode_pending(_frames(spark, rows), store, "text", LetterEncoder, 8, group_rows=10)
    assert store.live()[: len(before)] == before
    assert sorted((r.video_id, r.n) for r in store.read().collect()) == sorted((v, n) for v, n, t in rows if t)
    assert models.encode_pending(_frames(spark, rows), store, "text", LetterEncoder, 8) == 0
    more = [r for r in rows if r[0] != "v3"] + [("v3", 50, "hhh")]  # another content of one video replaces all of it
    assert models.encode_pending(_frames(spark, more), store, "text", LetterEncoder, 8) == 1
    (r,) = store.read().where("video_id = 'v3'").collect()
    assert r.n == 50 and r.vector[7] == 1


def test_versions_replace_and_compact(spark, tmp_path, monkeypatch):
    from skylattice.sources import versions

    cache = writers.vector_cache(spark, f"file://{tmp_path}/cache")
    with pytest.raises(ValueError, match="nothing"):
        cache.read()
    held = {}
    put = lambda rows: (writers.cache_vectors(spark.createDataFrame(rows, "key string, vector array<float>"), cache), held.update(dict(rows)))
    put([(f"k{i}", [float(i)]) for i in range(20)])
    put([(f"k{i}", [float(i), 1.0]) for i in range(0, 30, 3)])
    put([("k3", [7.0]), (None, [1.0])])
    put([("k3", [8.0]), (None, [2.0])])
    writers.cache_vectors(spark.createDataFrame([("twice", [1.0]), ("twice", [3.0])], "key string, vector array<float>"), cache)
    held["twice"] = [3.0]
    read = lambda: {r.key: r.vector for r in cache.read().collect()}
    assert read() == held and cache.read().count() == len(held) == cache.units().count()
    assert len(cache.live()) == 5
    cache.compact()
    assert read() == held and len(cache.live()) == 1
    monkeypatch.setattr(versions, "MOST", 2)
    for i in range(4):
        put([("k1", [float(i)])])
    assert read() == held and len(cache.live()) <= 2


def test_token_share():
    from skylattice.operators.rerank import token_share

    assert token_share([0.0, 1000.0, -1000.0, 3.0], [0.0, -1000.0, 1000.0, 1.0]) == pytest.approx([0.5, 1, 0, 1 / (1 + np.exp(-2))])
    assert np.isnan(token_share([np.nan], [0.0]))[0]


def _model():
    class Model:
        def tokens(self, text):
            return [1, 2] if text == "long" else [int(text)]

        def logits(self, jobs):
            if any(j["image"] == b"bad" for j in jobs):
                raise OSError("no such image")
            return np.array([[0.0, float(j["row_id"]) + j["seq"]] if j["row_id"] != 5 else [np.nan, 0] for j in jobs])

    return Model


def test_token_scores(spark):
    from skylattice.operators import rerank

    rows = [(1, 0, r, 0, b"bad" if r == 3 else b"x", "d") for r in range(8)] + [(1, 0, 2, 1, b"x", "d"), (1, 0, 2, -1, b"x", "d")]
    df = spark.createDataFrame(rows, "query_id int, probe_idx int, row_id int, seq int, image binary, text string")
    got = {r.row_id: r.score for r in rerank.token_scores(df, _model(), batch=1).collect()}
    assert got == pytest.approx({r: 1 / (1 + np.exp(-(r + (r == 2)))) for r in (0, 1, 2, 4, 6, 7)})  # 3 failed, 5 has no number
    assert rerank.token_scores(df.where("row_id = 3"), _model()).count() == 0  # a batch that failed whole
    with pytest.raises(Exception, match="a token each"):
        rerank.token_scores(df, _model(), yes="long").collect()


def test_crops_from_stored_images(spark, tmp_path):
    from skylattice.operators import images
    from skylattice.plans.model_queries import PixelEncoder
    from skylattice.sources import files

    rng, codec = np.random.default_rng(3), images.Netpbm()
    pictures = {i: rng.integers(0, 256, (60 + 10 * i, 500, 3 if i % 2 else 1)).astype(np.uint8) for i in range(4)}
    name = lambda i: f"file://{tmp_path}/p/{i}.ppm"
    stored = [(name(i), codec.encode(p)) for i, p in pictures.items()] + [(name(7), b"no image"), (name(8), codec.encode(pictures[1])[:300])]
    assert files.write_files(spark.createDataFrame(stored, "path string, content binary")) == 6
    all_ = spark.createDataFrame([(i, name(i)) for i in (0, 1, 2, 3, 7, 8, 9)], "row_id long, path string")
    sizes = {r.row_id: (r.width, r.height) for r in images.image_sizes(all_, images.Netpbm).collect()}
    assert sizes == {**{i: (500, 60 + 10 * i) for i in range(4)}, 8: (500, 70)}
    boxes = [(i, 0, [0.0, 0.0, 1.0, 1.0]) for i in (0, 1, 2, 3, 7, 8, 9)] + [(1, 1, [0.2, 0.2, 0.9, 0.5]), (2, 1, [0.5, 0.5, 0.51, 0.51])]
    crops = spark.createDataFrame(boxes, "row_id long, pos int, box array<double>")
    cut = {(r.row_id, r.pos): codec.decode(r.image) for r in images.cut_crops(crops, all_, images.Netpbm, most=1000).collect()}
    assert set(cut) == {(0, 0), (1, 0), (2, 0), (3, 0), (1, 1)}  # missing, broken and small ones are absent
    whole = pictures[0].astype(float)
    assert cut[0, 0].shape == (40, 336, 1)
    starts = [np.arange(w) * h // w for w, h in ((40, 60), (336, 500))]
    y, x = 17, 200
    want = whole[starts[0][y] : starts[0][y + 1], starts[1][x] : starts[1][x + 1]].mean()
    assert abs(cut[0, 0][y, x, 0] - want) <= 0.5
    vectors = {(r.row_id, r.pos): np.array(r.vec) for r in images.crop_vectors(crops, all_, images.Netpbm, PixelEncoder, 3, batch=2).collect()}
    assert set(vectors) == set(cut)
    for k, v in vectors.items():
        own = PixelEncoder().encode([cut[k]])[0]
        assert np.allclose(v, own / np.linalg.norm(own), atol=1e-6)


def test_images_are_dealt_over_tasks(spark):
    """A few bytes of paths are hours of decoding: neither one scan nor adaptive execution may leave them to one task."""
    from skylattice.operators import images

    rows = spark.range(400).coalesce(1).select(F.col("id").alias("row_id"), F.format_string("file:///nowhere/%d.ppm", "id").alias("path"))
    crops = rows.select("row_id", F.lit(0).alias("pos"), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("box"))
    least = 2 * spark.sparkContext.defaultParallelism
    assert images.image_sizes(rows, images.Netpbm).rdd.getNumPartitions() >= least
    assert images.planned(crops, rows, images.Netpbm).rdd.getNumPartitions() >= least
