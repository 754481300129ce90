import hashlib
import random
import re

from skylattice.llm import fill_middle

ODD = [None, "", "x", "a<P>b", "<S>", "tail <M>", "<P", "S> <", "\n\n", "🦆🦆é日本", "line\r\nline ", "word " * 900, "é" * 128, "é" * 129, "🦆" * 256 + "z", "<" * 300]


def _plain(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rows():
    rng = random.Random(5)
    texts = ODD * 12 + ["".join(rng.choice("ab<PSM> \né🦆") for _ in range(rng.choice([1, 5, 127, 128, 129, 400, 3000]))) for _ in range(200)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + rows[:20] + [(None, "no id"), (None, "no id"), (None, "another"), (7, "a second text of one id"), (-(2**63), "least"), (2**63 - 1, "long " * 50_000)]


def test_against_slices(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, key string, n int, offsets string")
    got = fill_middle.digests(docs.repartition(5)).collect()
    want = []
    for d, t in rows:
        n, form, p, m, out = _plain(d, t)
        want.append((d, n, form, p, m, _sha(out), _sha(t or "")))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_units_of_any_pattern(spark):
    """Words with the blanks behind them; what no match covers is a unit for each code point."""
    pattern, rng = r"[a-zé]+ *", random.Random(6)
    texts = ["", "one", "...", "a b  c, d!", "x " * 700, "🦆 duck 🦆"] + ["".join(rng.choice("ab  ,.é") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    unit = re.compile(f"(?s)(?:{pattern}|.)")
    rows = []
    for k, t in enumerate(texts):
        n = len(unit.findall(t))
        rows.append((k.to_bytes(4, "big"), t, sorted({0, n, *(rng.randint(0, n) for _ in range(5))})))
    cuts = spark.createDataFrame(rows, "key binary, text string, ordinals array<long>")
    got = {bytes(r.key): r.offsets for r in fill_middle.cut_offsets(cuts.union(cuts), pattern).collect()}
    counts = {bytes(r.key): r.n for r in cuts.select("key", fill_middle.unit_count(cuts["text"], pattern).alias("n")).collect()}
    for key, text, ordinals in rows:
        ends = [0, *(m.end() for m in unit.finditer(text))]
        assert counts[key] == len(ends) - 1
        assert got.get(key, {}) == {w: ends[o] for w, o in enumerate(ordinals) if o}


def test_restored(spark):
    rows = [(t,) for t in ODD if t]
    made = fill_middle.fill_in_middle(spark.createDataFrame([(k, t) for k in range(40) for (t,) in rows], "doc_id long, text string"))
    back = made.select("doc_id", fill_middle.restored(made["output"], made["form"]).alias("text")).collect()
    assert sorted(map(tuple, back)) == sorted((k, t) for k in range(40) for (t,) in rows)


def test_text_moves_in_blocks_only(spark):
    """Neither single units nor whole texts go through the windows: long texts make block rows, and some units."""
    rows = [(k, "ab cd " * 5000) for k in range(3)]
    cuts = spark.createDataFrame([(k.to_bytes(4, "big"), t, [100, 29_000]) for k, t in rows], "key binary, text string, ordinals array<long>")
    got = fill_middle.cut_offsets(cuts)
    assert [r.offsets for r in got.collect()] == [{0: 100, 1: 29_000}] * 3
