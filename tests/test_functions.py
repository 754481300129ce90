import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions import numbers as n
from skylattice.functions import text as t
from skylattice.functions import vectors as v


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def said(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").orderBy("i").select(f(F.col("s"))).collect()]


def test_fold_and_tokenize(spark):
    assert said(spark, t.fold, "Đốt CHÁY", "Sàn", "Café", None) == ["dot chay", "san", "cafe", None]
    assert said(spark, t.tokenize, "HTV-News, 06:30:11!", "") == [["htv", "news", "06", "30", "11"], []]
    assert said(spark, t.looks_unfolded, "CHÁY", "chay") == [True, False]


def test_events(spark):
    assert said(spark, t.split_events, "Lead in. E1: one thing E2: two things", "A first. Sau đó second one. Tail.", "Cảnh một, sau đó hai.", "E1: alone", "lần lượt một. Đầu tiên hai.", "  ") == [
        ["one thing", "two things"], ["A first.", "Sau đó second one. Tail."], ["Cảnh một, sau đó hai."], ["E1: alone"], ["lần lượt một. Đầu tiên hai."], [],
    ]
    (p,) = said(spark, t.probes, 'E1: says "PHÚ XUÂN" here E2: and “Nà Ní” “Nà Ní” "x"')
    assert [(x.probe_idx, x.quoted) for x in p] == [(0, ["PHÚ XUÂN"]), (1, ["Nà Ní"])]
    assert said(spark, t.sentences, "One. Two!  Three, four?") == [["One.", "Two!", "Three, four?"]]


def test_declarativize(spark):
    cases = {
        "Có bao nhiêu người đứng trên sân khấu?": "người đứng trên sân khấu", "Con mèo màu gì?": "Con mèo màu gì?", "Biển số của chiếc xe màu đỏ là gì?": "Biển số của chiếc xe màu đỏ",
        "Hãy cho biết chiếc thuyền nhỏ  đang neo ở đâu ?": "chiếc thuyền nhỏ đang neo", "Mấy con bò đang ăn cỏ?": "con bò đang ăn cỏ", "Trong khung hình đầu, hai đứa trẻ đang cầm mấy quả?": "hai đứa trẻ đang cầm",
        "Trong video, ba người thợ đang làm việc có bao nhiêu chiếc?": "ba người thợ đang làm việc", "Trong vườn, ba cây hoa mai": "Trong vườn, ba cây hoa mai", "Gì?": "Gì?", "?": "?", None: "", "": "",
    }
    assert said(spark, t.declarativize, *cases) == list(cases.values())


def test_answers_go_through_python_only_beyond_ascii(spark):
    assert said(spark, t.normalize_answer, "ABC  d", "E\u0301a", "Straße", "İx", None) == ["abc d", "éa", "strasse", "i\u0307x", None]


def test_answers_seeds_keys(spark):
    assert said(spark, t.normalize_answer, "  Màu   Xanh ", None) == ["màu xanh", None]
    assert one(spark, t.answer_matches(F.lit("  Màu   Xanh "), F.array(F.lit("màu xanh"))))
    assert said(spark, t.stable_seed, "q_0001", "") == [2435255333, 0]
    assert said(spark, t.cache_key, "abc") == ["a9993e364706816a"]


def test_kinds(spark):
    rows = [("q-TRAKE-1", "x"), ("03-qa", "x"), ("kis9", "E1: x"), ("z", "E1: x"), ("z", "x")]
    got = spark.createDataFrame(rows, "n string, s string").select(t.query_kind(F.col("n"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["trake", "qa", "kis", "trake", "kis"]
    assert one(spark, t.coerced_kind(F.lit("qa"), F.lit(2))) == "trake"


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, v.l2_normalize(arr(3.0, 4.0))) == [0.6, 0.8] and one(spark, v.l2_normalize(arr(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, v.truncate_and_normalize(arr(3.0, 4.0, 12.0), 2)) == [0.6, 0.8]
    assert one(spark, v.is_unit(arr(0.0, 0.0))) and not one(spark, v.is_unit(arr(2.0, 0.0)))
    with pytest.raises(ValueError):
        v.truncate_and_normalize(F.col("x"), 0)
    with pytest.raises(Exception, match="shorter"):
        one(spark, v.truncate_and_normalize(arr(1.0), 2))
    with pytest.raises(Exception, match="differ"):
        one(spark, v.dot(arr(1.0), arr(1.0, 2.0)))


def test_windows(spark):
    i = F.lit
    assert one(spark, n.uniform_grid(i(1000), 5, 10)) == [980, 990, 1000, 1010, 1020]
    assert one(spark, n.uniform_grid(i(10), 4, 5, i(0), i(19))) == [5, 10, 15, 19]
    assert n.half_widths(11) == (5, 5) and n.half_widths(10) == (4, 5)
    spread = one(spark, n.spread_in_window(i(1000), i(950), i(1050), i(7)))
    assert spread[0] == 1000 and len(set(spread)) == 7 and [abs(f - 1000) for f in spread] == sorted(abs(f - 1000) for f in spread)
    assert one(spark, n.spread_in_window(i(5), i(5), i(5), i(4))) == [5] and one(spark, n.spread_in_window(i(5), i(1), i(9), i(1))) == [5]
    assert [one(spark, n.adaptive_m(i(0), i(hi))) for hi in (43, 8, 120, 900)] == [5, 3, 13, 20]
    assert [one(spark, n.slot_weight(i(r))) for r in (1, 2, 6, 21, 51)] == [1, 0.8, 0.6, 0.4, 0.2]
    assert one(spark, n.grid_hits(F.array(i(3), i(9)), i(5), i(9))) and not one(spark, n.grid_hits(F.array(i(3)), i(5), i(9)))
    assert math.isclose(one(spark, n.lpt_bound(i(10))), 4 / 3 - 1 / 30)


def test_boxes_and_costs(spark):
    box = F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    assert tuple(one(spark, n.pixel_box(box, F.lit(640), F.lit(480)))) == (0, 0, 640, 480)
    assert one(spark, n.box_area(box)) == 1
    cost = one(spark, n.projected_cost(F.lit(3600), F.lit(10.0), F.lit(2.0), F.lit(10)))
    assert tuple(cost) == (360.0, 36.0, 0.2, 0.05556)
    pick = lambda *x: one(spark, n.choose_device(*map(F.lit, x)))
    assert pick(2.0, 10.0, 1.0, 9.0) == "gpu" and pick(1.0, 30.0, 2.0, 10.0) == "gpu" and pick(1.0, 20.0, 2.0, 10.0) == "cpu"


def test_small_text_rules(spark):
    assert said(spark, t.clean_generated, 'Truy vấn: "một con mèo"') == ["một con mèo"]
    assert said(spark, t.class_query, "xe hơi / ô tô", "các bạn") == ["một xe hơi", "các bạn"]
    video, number = t.shot_parts(F.lit("L21_V001_shot_012"))
    assert one(spark, video) == "L21_V001" and one(spark, number) == 12
    kind = lambda o, a: one(spark, t.evidence_type(F.lit("o" * o), F.lit("a" * a)))
    assert [kind(30, 70), kind(30, 5), kind(0, 70), kind(0, 0), kind(15, 0)] == ["vision+ocr+asr", "vision+ocr", "vision+asr", "vision", None]


def test_split_events_keeps_every_mark(spark):
    from pyspark.sql import functions as F

    from skylattice.functions import text

    query = " ".join(f"E{i}: event {i}" for i in range(10_050))
    (r,) = spark.createDataFrame([(query,)], "q string").select(F.size(text.split_events(F.col("q"))).alias("n")).collect()
    assert r.n == 10_050
