import zlib

import numpy as np
from pyspark.sql import functions as F

from skylattice.llm import language, quality
from skylattice.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op5_language"](spark, SF).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r.held_out and truth[r.doc_id][0] is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(1, "the house and the garden of it", "en", 1.0), (2, "das haus und der garten von ihm", "de", 1.0), (3, None, "en", 1.0), (4, "", None, 1.0), (5, "123 !!", "de", 1.0), (None, "the house", "en", 1.0), (6, "haus " * 50_000, None, 1.0), (1, "the house and the garden of it", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.learn(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und" and by[3].score == 0
    assert by[1].lang_pred == "en" and by[2].lang_pred == "de" and by[6].lang_pred == "de"
    none = language.learn(docs.where("false"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0


def test_prediction_does_not_depend_on_the_batch():
    texts = ["the house of the man", "das haus des mannes", "x", "élève à l'école"]
    model = language.fit(np.stack([np.append(language.gram_shares(t), np.float32(1)) for t in texts]), ["en", "de", "en", "fr"])
    together = model.predict(texts * 50)
    for i, t in enumerate(texts):
        lang, score = model.predict([t])
        assert (lang[0], score[0]) == (together[0][i], together[1][i])


def test_quality_held_out(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op6_quality"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    out = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    good, bad = [s for s, y in out if y == 1], [s for s, y in out if y == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "Fine words here.", 5), (2, None, 5), (3, "", 5), (4, "BAD!! " * 40_000, 5), (1, "Fine words here.", 5), (None, "x", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (2, None, 0), (3, 7, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    unlearned = quality.learn(docs, labels.where("false"))
    assert {round(r.score, 6) for r in quality.score(docs, unlearned).collect()} == {0.5}
    assert quality.score(docs.where("false"), unlearned).count() == 0


def test_forest_arrays_equal_walking():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(quality.FEATURES))).astype(np.float32)
    y = (x[:, 3] + x[:, 7] * x[:, 9] > 0).astype(float)
    m = quality.boost(x, y, trees=12)
    for row, s in zip(x[:40], m.score(x[:40]), strict=True):
        total = m.base
        for f, c, v in zip(m.feature, m.cut, m.value, strict=True):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > c[i])
            total += v[i - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9
    assert ((m.score(x) > 0.5) == y).mean() > 0.85


def test_held_out_column(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", language.held_out(4, 2)).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_learns_without_spread_ids(spark):
    """Null and repeated doc_ids teach; rows that repeat as a whole teach once; the sample stays bounded."""
    says = {"en": "the house of the man and the garden near the old mill", "de": "das haus des mannes und der garten bei der alten mühle"}
    rows = [(d, f"{says[k]} {i}", k, 1, "x") for k in says for i in range(400) for d in ((None, 7)[i % 2],)] + [(7, says["en"], "en", 1, "x")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, d int, share string")
    model = language.learn(docs, sample=50)
    assert model.families == ["germanic"] and model.members == [["de", "en"]]
    assert model.predict([says["en"], says["de"]])[0] == ["en", "de"]
    only = language.learn(docs.where("doc_id = 7 and lang = 'en' and text not like '%0'"), sample=5)
    assert only.predict([says["en"]]) == (["en"], [1.0])


def _plain_counts(text):
    """Shares of hashed n-grams, byte by byte."""
    raw = [b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode()]
    squeezed = [32]
    for b in [*raw, 32]:
        if b != 32 or squeezed[-1] != 32:
            squeezed.append(b)
    out = np.zeros(1 << language.BUCKETS)
    for n in language.ORDERS:
        for i in range(len(squeezed) - n + 1):
            h = 0
            for b in squeezed[i : i + n]:
                h = h << 8 | b
            out[(h * language._MULTIPLIER[n] & 0xFFFFFFFF) >> (32 - language.BUCKETS)] += 1
    return out


def test_language_against_a_plain_version(monkeypatch):
    """n-gram shares, family choice, votes and scores recomputed plainly; weights that do better than their neighbours."""
    texts = ["The house, the man!", "das Haus und der Mann", "la maison de l'été", "la casa de la niña", "x", "ß 12 Ω", "a" * 5000]
    monkeypatch.setattr(language, "SLICE", 1000)  # the long text goes in slices
    for text, counts in zip(texts, language.gram_counts(texts), strict=True):
        assert (counts == _plain_counts(text)).all()
    langs = ["en", "de", "fr", "es", "en", "de", "es"]
    shares = np.stack([np.append(language.gram_shares(t), np.float32(1)) for t in texts])
    model = language.fit(shares.copy(), langs)
    for text, lang, score in zip(texts, *model.predict(texts), strict=True):
        share = _plain_counts(text)
        margins = share / share.sum() @ model.table + model.bias
        family = np.exp(2 * margins[: len(model.families)])
        k = int(family.argmax())
        votes = {n: [0, 0.0] for n in model.members[k]}
        for j, (f, a, b) in enumerate(model.pairs):
            if f == k:
                m = margins[len(model.families) + j]
                p = 1 / (1 + np.exp(-2 * m))
                winner = model.members[k][a if m >= 0 else b]
                votes[winner][0] += 1
                votes[model.members[k][a]][1] += p
                votes[model.members[k][b]][1] += 1 - p
        top = max(votes, key=lambda n: (*votes[n], -model.members[k].index(n)))
        assert lang == top and abs(score - family[k] / family.sum() * (votes[top][1] / (len(votes) - 1) if len(votes) > 1 else 1)) < 1e-9

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 5)), np.ones((60, 1))], axis=1).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.2, 1, -1).astype(np.float32)
    w = language._svm(x, y, penalty=1e-2, rounds=4000)

    def loss(w):
        each = np.maximum(0, 1 - y * (x @ w)) ** 2
        return 0.5 * each[y > 0].mean() + 0.5 * each[y < 0].mean() + 0.005 * (w * w).sum()

    least = loss(w)
    assert all(loss(w + step * e) >= least - 1e-6 for e in np.eye(6) for step in (0.02, -0.02))


def test_quality_statistics_against_a_plain_version():
    """Every statistic from its definition."""
    import math
    from collections import Counter

    def plain(text):
        raw, words = text.encode(), text.split()
        kinds = Counter(quality._NAMES[quality._byte_class(b)] for b in raw)
        share = [kinds[n] / max(1, len(raw)) for n in quality._NAMES]
        if not words:
            return [0.0] * 3 + share + [0.0] * (len(quality.FEATURES) - 3 - len(share))
        n, lines = len(words), [s for s in text.split("\n") if s.strip()]
        mean = sum(map(len, words)) / n
        seen, own, pairs = Counter(words), Counter(lines), Counter((words[i], words[i + 1]) for i in range(n - 1))
        return [
            math.log1p(len(raw)), math.log1p(n), math.log1p(len(lines)), *share, mean, math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n), sum(len(w) <= 3 for w in words) / n, sum(len(w) > 12 for w in words) / n,
            len(seen) / n, max(seen.values()) / n, len(own) / len(lines), max(own.values()) / len(lines), math.log1p(len(text) / len(lines)), sum(s.rstrip()[-1] in ".!?" for s in lines) / len(lines),
            -sum(p * math.log2(p) for p in share if p), len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / max(1, n - 1), math.log1p(n / (1 + kinds["stop"])), sum(w.istitle() for w in words) / n, sum(w.isdigit() for w in words) / n,
        ]

    texts = ["", " \n", "One", "Fine words here. And MORE of it!\nFine words\n\nFine words", "a b a b a b 12 7", "Überraschung <b>x</b> {y} $5 a/b 'q'? \x01", "word " * 500]
    assert np.allclose(quality.statistics(texts), [plain(t) for t in texts], rtol=1e-5, atol=1e-6)
    assert (quality.statistics([None]) == 0).all()


def test_quality_clashing_columns(spark):
    """Other columns of both tables may have the names of those that are learned from, and repeated doc_ids teach once."""
    docs = spark.createDataFrame([(i, f"Fine words number {i}." if i % 2 else "BAD!! " * (i + 1), 5, 0.5, "s", 1, 2.0) for i in range(40)] * 3, "doc_id long, text string, quality int, d double, stats string, _draw int, one double")
    labels = spark.createDataFrame([(i, i % 2, "t", 9) for i in range(40)], "doc_id long, quality int, text string, d int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model, ("doc_id", "quality", "d")).collect()
    assert len(got) == 120 and all((r.score > 0.5) == bool(r.doc_id % 2) for r in got)


def test_peak_memory_of_long_texts():
    """256 texts of 120,000 characters: what a step holds beside them is bounded by a slice, not by the batch."""
    import tracemalloc

    import pyarrow as pa

    from skylattice.llm.common import slices

    text = " ".join(f"wort{i % 5000}" for i in range(14_000))[:120_000]
    batch = pa.RecordBatch.from_arrays([pa.array([text[: 120_000 - i] for i in range(256)])], ["text"])
    model = language.fit(np.stack([np.append(language.gram_shares(t), np.float32(1)) for t in ("the house", "das haus", "la maison", "la casa")]), ["en", "de", "fr", "es"])
    for work in (model.predict, quality.statistics):
        tracemalloc.start()
        for part in slices(batch, 0):
            work(part.column(0).to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6, (work, peak)
