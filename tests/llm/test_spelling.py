import random
import re
import zlib
from collections import Counter

import pytest

from skylattice.llm import spelling


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len, reverse=True)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[k + 1 :] == (b[k:] if len(a) > len(b) else b[k + 1 :])


def _brute(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if _near(w, v)]
        best = min(near, default=None)
        good = best is not None and -best[0] >= 2 * n
        out[w] = [best[1] if good else None, n, len(near), -best[0] if good else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {(w, f, r, n, k, m) for w, (f, n, k, m, r) in out.items()}


def _words(rng, count, letters="abé", most=9):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(5, most))) for _ in range(count)}


@pytest.mark.parametrize("limit", [2000, 40, 1])
def test_variants_against_all_pairs(spark, limit):
    rng = random.Random(limit)
    words = _words(rng, 500) | {"x" * n for n in range(5, 40)} | {"shared" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(150)} | {"y" * 3000, "y" * 3001, "y" * 1500 + "z" + "y" * 1500}
    counts = {w: rng.choice([3, 3, 4, 6, 12, 24, 50, 100, 400]) for w in words}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(vocab, limit).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == _brute(counts)


def test_pairs_come_once_from_each_end(spark):
    words = sorted(_words(random.Random(2), 300, "ab", 8))
    pairs = [(r.word, r.near) for r in spelling.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 5).collect()]
    assert sorted(pairs) == sorted((a, b) for a in words for b in words if _near(a, b))


def test_roots_of_long_ways(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(63)] + [("w63", None), ("alone", None)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{k}": "w63" for k in range(63)}


def _text_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_grouped_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 40)
    rng = random.Random(9)
    words = ["quality", "qualitys", "Qualiti", "ÉCOLE", "école", "×times÷", "straße", "naïve", "a", "I", "internationalisation"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)) + rng.choice([".", "1", "日", "\n"])) for k in range(150)]
    rows += [(None, None), (5, ""), (6, "1 2 !"), (None, "quality " * 5), rows[0], rows[0], (900, "longword" * 40)] * 3
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    got = spelling.grouped(docs.repartition(4)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == _brute(_text_words(rows)) and len(got) > 10
    assert any(r.form for r in got)
    assert spelling.grouped(docs.limit(0)).count() == 0


def test_whole_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.grouped(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert set(map(tuple, got)) == _brute(_text_words(rows))
