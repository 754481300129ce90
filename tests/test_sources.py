import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skylattice.sources import files, readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_ocr(spark, tmp_path):
    lines = [{"video_id": "A", "n": 1, "text_ascii_folded": " mot ", "text_raw": "một", "shot_id": 4}, {"video_id": "A", "n": 1, "text_ascii_folded": "hai", "text_normalized": " "}, {"video_id": "A", "n": 2, "text_ascii_folded": "  "}]
    put(tmp_path / "o.jsonl", "\n\n".join(json.dumps(x) for x in lines))
    assert [(r.n, r.text) for r in readers.ocr_text(spark, str(tmp_path / "o.jsonl")).collect()] == [(1, "hai")]
    assert [r.shot_id for r in readers.shot_ids(spark, str(tmp_path / "o.jsonl")).collect()] == [4]
    assert [r.text for r in readers.ocr_raw(spark, str(tmp_path / "o.jsonl")).collect()] == ["một"]


def test_frame_tables(spark, tmp_path):
    put(tmp_path / "m/L1_V1.csv", "\ufeff\n\nn,frame_idx,fps,shot_id,shot_start_frame,shot_end_frame\n1,25,25.0,0,0,40\n2,50,25.0,0,9,99\n3,,25.0,1,,\n")
    put(tmp_path / "m/L1_V2.csv", "fps,n,frame_idx\n10,7,30\n")
    t = readers.frame_table(spark, str(tmp_path / "m/*.csv")).cache()
    assert {(r.video_id, r.n, r.ts_ms) for r in readers.frame_times(t).collect()} == {("L1_V1", 1, 1000.0), ("L1_V1", 2, 2000.0), ("L1_V2", 7, 3000.0)}
    assert {(r.video_id, r.n, r.frame_idx) for r in readers.frame_numbers(t).collect()} == {("L1_V1", 1, 25), ("L1_V1", 2, 50), ("L1_V2", 7, 30)}
    assert readers.shot_bounds(t).count() == 2
    assert [tuple(r) for r in readers.video_last_frame(t).collect()] == [("L1_V1", 99)]
    assert {(r.shot_id, r.start, r.end) for r in readers.shot_frames(t).collect() if r.shot_id == 0} == {(0, 0, 40)}


def test_long_frame_tables_are_split(spark, tmp_path):
    """A video's table is several tasks; a shot's first row in the file decides, wherever the splits are, and the header is known in each of them."""
    put(tmp_path / "m/A.csv", "frame_idx,n,shot_id,shot_start_frame\n" + "".join(f"{2 * i},{i},{i // 1500},{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        t = readers.frame_table(spark, str(tmp_path / "m/*.csv"))
        assert t.rdd.getNumPartitions() > 2
        assert sorted((r.n, r.frame_idx) for r in readers.frame_numbers(t).collect()) == [(i, 2 * i) for i in range(3000)]
        assert {(r.shot_id, r.start) for r in readers.shot_frames(t).collect()} == {(0, 0), (1, 1500)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_objects_and_speech(spark, tmp_path):
    put(tmp_path / "obj/A/007.json", json.dumps({"layout_folded": "x", "count_folded": " ", "classes_folded": "y", "classes": ["C"], "detection_class_entities": ["C", "D"], "entities_vi": ["c", "d"], "detection_boxes": [[0, 0, 1, 1], [0, 0, 1, 1]]}))
    o = readers.object_records(spark, str(tmp_path / "obj"))
    assert [(r.video_id, r.n, r.text) for r in readers.object_text(o).collect()] == [("A", 7, "x y")]
    labels, phrase = readers.object_classes(o)
    assert labels.first()["class"] == "C" and {(r["class"], r.phrase) for r in phrase.collect()} == {("C", "c"), ("D", "d")}
    put(tmp_path / "asr/B.json", json.dumps({"segments": [{"start_ms": 1, "end_ms": 2, "text": " a "}, {"start_ms": 3, "end_ms": 4, "text": " "}]}))
    assert [tuple(r) for r in readers.speech(spark, str(tmp_path / "asr/*.json")).collect()] == [("B", 1, 2, "a")]


def test_object_records_are_those_of_videos(spark, tmp_path):
    """root/video/n.json and nothing else, whatever folders are called."""
    for name in ("A/1.json", "_B/02.json", "video_id=3/3.json", "4.json", "A/deep/5.json", "A/k=v/6.json", "A/7.txt"):
        put(tmp_path / "obj" / name, json.dumps({"layout_folded": name, "classes": ["C"]}))
    for root in (str(tmp_path / "obj"), f"file://{tmp_path}/obj/", f"file:{tmp_path}/o*"):
        got = {(r.video_id, r.n, r.layout_folded) for r in readers.object_records(spark, root).collect()}
        assert got == {("A", 1, "A/1.json"), ("_B", 2, "_B/02.json"), ("3", 3, "video_id=3/3.json")}


def test_small_files_are_written_by_many_tasks(spark, monkeypatch):
    """A few bytes a file do not make one task of all files."""
    from skylattice.plans import source_queries
    from skylattice.plans.binding import Tables

    seen, write = [], source_queries.files.write_files
    monkeypatch.setattr(source_queries.files, "write_files", lambda rows: seen.append(rows.rdd.getNumPartitions()) or write(rows))
    for name in ("read_object_text", "read_object_classes", "read_class_phrases", "find_images", "manifest_round_trip"):
        source_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 5 and min(seen) >= 2 * spark.sparkContext.defaultParallelism


def test_queries_and_submissions(spark, tmp_path):
    put(tmp_path / "q/01-qa-x.txt", " a\n b ")
    put(tmp_path / "q/02.txt", "E1: a E2: b")
    put(tmp_path / "q/03.txt", " \n")
    assert {(r.query_id, r.text, r.kind) for r in readers.query_files(spark, str(tmp_path / "q/*.txt")).collect()} == {("01-qa-x", "a b", "qa"), ("02", "E1: a E2: b", "trake")}
    put(tmp_path / "s/run-q1.csv", 'A,5\nB,7,8\nC,9,"yes, ""no"""\n')
    got = readers.submission_files(spark, str(tmp_path / "s/*.csv")).orderBy("rank").collect()
    assert [(r.rank, r.video_id, r.frames, r.answer) for r in got] == [(1, "A", [5], None), (2, "B", [7, 8], None), (3, "C", [9], 'yes, "no"')]
    assert spark.createDataFrame([("run-q1",)], "t string").select(readers.task_query(F.col("t"))).first()[0] == "q1"


def test_truth_archives_images(spark, tmp_path):
    put(tmp_path / "gt.jsonl", json.dumps({"query_id": "q", "query_type": "t", "positive_shots": [{"shot_id": "a"}], "partial_shots": [{"shot_id": "a"}, {"shot_id": "b"}]}))
    assert {(r.shot_id, r.relevance) for r in readers.shot_truth(spark, str(tmp_path / "gt.jsonl")).collect()} == {("a", 2), ("b", 1)}
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/k.zip", "w") as z:
        z.writestr("keyframes/A/012.webp", b"x")
        z.writestr("readme.txt", b"x")
    for where in ("z/*.zip", "z", "z/k.zip"):
        assert [(r.video_id, r.n, r.member) for r in files.archive_members(spark, str(tmp_path / where)).collect()] == [("A", 12, "keyframes/A/012.webp")]
    for root in ("r1", "r2"):
        put(tmp_path / root / "A/001.webp", root)
    put(tmp_path / "r2/A/002.webp", "r2")
    got = {r.n: r.path for r in readers.image_files(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")]).collect()}
    assert "/r1/" in got[1] and "/r2/" in got[2]


def test_sinks(spark, tmp_path):
    tasks = spark.createDataFrame([("q1", "qa", 1)], "task_id string, task_type string, n_moments int")
    answers = spark.createDataFrame([("q1", 1, "A", [5], 'a, "b"', 1.0), ("q1", 2, "B", [6], "c", 0.5)], "task_id string, rank int, video_id string, frames array<int>, answer string, score double")
    writers.submission_csv(answers, str(tmp_path / "csv"))
    (f,) = (tmp_path / "csv/task_id=q1").glob("part*")
    assert f.read_text() == 'A,5,"a, ""b"""\nB,6,c\n'
    writers.predictions_json(tasks, answers, str(tmp_path / "json"))
    assert len(spark.read.json(str(tmp_path / "json")).first().results) == 2
    with pytest.raises(ValueError, match="not valid"):
        writers.predictions_json(tasks, answers.unionByName(answers), str(tmp_path / "json"))
    report = writers.RunReport(top=5)
    with report.stage("x"):
        pass
    report.write(spark, str(tmp_path / "report"))
    assert "timing_s" in spark.read.json(str(tmp_path / "report")).columns
    found = writers.provenance(spark, str(tmp_path / "csv"))
    stated = found.select("path", "sha256").unionByName(spark.createDataFrame([("none", "x"), ("free", None)], "path string, sha256 string"))
    assert {r.status for r in writers.verified(found, stated).collect()} == {"verified", "unverifiable", "not_applicable"}
    queries = spark.createDataFrame([("A", 1, 25, "one two three four five six seven eight", "vision"), ("A", 2, 50, "short", "vision")], "video_id string, n int, frame_idx int, text string, query_type string")
    writers.generated_queries(queries, str(tmp_path / "gen"))
    assert spark.read.json(str(tmp_path / "gen/truth")).first().query_id == "h_A_1"
    frames = spark.createDataFrame([("A", 1, [1.0, 0.0])], "video_id string, n int, emb array<float>")
    writers.frame_index(frames, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).columns[-1] == "emb_head"


def test_archive_directories_are_read_by_seek(spark, tmp_path):
    """However large its members, the end and the directory of an archive are all that is read."""

    class Counted:
        def __init__(self, path):
            self.f, self.n = open(path, "rb"), 0

        def read(self, *a):
            got = self.f.read(*a)
            self.n += len(got)
            return got

        def __getattr__(self, name):
            return getattr(self.f, name)

    read = []
    for size in (10, 20_000_000):
        with zipfile.ZipFile(tmp_path / f"{size}.zip", "w") as z:
            for n in range(50):
                z.writestr(f"keyframes/V/{n:03d}.jpg", b"x" * (size // 50))
        f = Counted(tmp_path / f"{size}.zip")
        assert [m[1] for m in files.keyframes(f, "a")] == list(range(50))
        read.append(f.n)
    assert read[1] < read[0] + 2000 < 100_000
    df = files.archive_members(spark, f"file://{tmp_path}/*.zip")
    assert df.count() == 100 and df.rdd.getNumPartitions() == 2


def test_archives_written_by_tasks(spark, tmp_path):
    rows = [(f"file://{tmp_path}/d/{a}.zip", f"{a}/{n:03d}.png", bytes([n])) for a in "AB" for n in range(30)]
    assert files.write_archives(spark.createDataFrame(rows, "archive string, member string, content binary")) == 2
    with zipfile.ZipFile(tmp_path / "d/A.zip") as z:
        assert z.namelist() == [f"A/{n:03d}.png" for n in range(30)] and z.read("A/007.png") == b"\x07"
    assert files.archive_members(spark, f"file://{tmp_path}/d").count() == 60
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["A.zip", "B.zip"]


def test_every_cell_of_an_answer(spark, tmp_path):
    from skylattice.sources import readers

    (tmp_path / "task-1.csv").write_text("v1," + ",".join(map(str, range(1500))) + "\n")
    (r,) = readers.submission_files(spark, str(tmp_path / "*.csv")).collect()
    assert r.frames == list(range(1500))
