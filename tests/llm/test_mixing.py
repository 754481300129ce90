import random
from collections import Counter, defaultdict

from skylattice.llm import mixing


def _brute(sizes: dict, epochs=3) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in clamped]
        level = (total - sum(epochs * sizes[s] for s in clamped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else level * w[s] for s in names}
        clamped |= over


def test_targets_and_takes(spark):
    rng = random.Random(4)
    rows = []
    for s, n in (("a", 600), ("b", 40), ("c", 5), ("é", 200), (None, 100), ("empty", 3)):
        for _ in range(n):
            k = len(rows)
            rows.append((k, None if s == "empty" else "\t".join(["w"] * rng.randint(1, 30)), s, 9, "x"))
    rows += [(rows[0][0], rows[0][1], rows[0][2], 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, whole int, _b1 string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    source = {r[0]: r[2] for r in rows}
    for d, t, s, *_ in rows:
        sizes[s] += len(t.split()) if t else 0
    want = _brute(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] += r.taken
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s, v in taken.items():
        assert abs(v - want[s]) <= 31
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    often = Counter(r.doc_id for r in mixing.repeated(docs).collect())
    assert mixing.repeated(docs).columns == docs.columns
    for r in got:
        if r.size and r.doc_id != rows[0][0]:
            assert often[r.doc_id] == r.taken // r.size


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0 and mixing.repeated(docs).count() == 0
    only = spark.createDataFrame([(1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(only).collect()] == [0, 0]
