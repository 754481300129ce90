import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from skylattice.llm import fingerprints as fp
from skylattice.llm import search


def _bm25(rows, asked, k):
    docs = [(-(2**63) if d is None else d, search.tokens(t)) for d, t in rows]
    merged = {}
    for q, text in asked:
        merged.setdefault(q, set()).update(search.tokens(text))
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    out = []
    for q, terms in merged.items():
        scores = []
        for d, t in docs:
            tf = Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in sorted(terms) if tf[w])
            if s > 0:
                scores.append((round(-s, 9), d))
        out += [(q, i, None if d == -(2**63) else d, round(-s, 6)) for i, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(300)], k=rng.randint(0, 60)))) for i in range(900)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (5, rows[5][1]), (None, "w1 w299"), (1002, None), (1003, ""), (1004, "w3 " * 30_000)]
    asked = [(1, rows[5][1]), (2, "w0 w1 w2 w3"), (3, "unknown"), (4, ""), (5, None), (6, " ".join(words)), (7, "w5"), (7, "w5"), (7, "w6 w5"), (None, "w2"), (None, "w4 w7")]
    asked += [(100 + i, " ".join(rng.choices(words, k=120))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, score int")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = _bm25(rows, asked, 7)
    for terms, places, together, chunk, shard in ((10**6, 10**6, 256, 256, 10**5), (700, 10**6, 7, 16, 40), (10**6, 100, 16, 64, 1)):
        for name, value in (("PASS_TERMS", terms), ("PASS_PLACES", places), ("TOGETHER", together), ("CHUNK", chunk), ("SHARD_TOKENS", 3000), ("SHARD_DOCS", shard)):
            monkeypatch.setattr(search, name, value)
        got = [(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.bm25_topk(docs.repartition(5), queries, 7).collect()]
        assert sorted(got, key=str) == want
    assert search.bm25_topk(docs.where("false"), queries).count() == 0
    assert search.bm25_topk(docs, queries.where("false")).count() == 0


def test_copies_are_scored_once(spark, monkeypatch):
    """Each of 20 copies has its rows, as a document and as a query, but one text meets one query once for all of them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 20))) for _ in range(25)] + ["", None]
    rows = [(i * 100 + j, text) for i in range(20) for j, text in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[0]), (3, texts[0]), (3, texts[3]), (5000, texts[1].upper())]
    asked = [*rows[:60], (-1, " ".join(reversed(texts[2].split()))), (None, texts[4]), (-2, "w1"), (-3, "w1 w1")]
    made, real = {}, search.written

    def seen(df, name):
        made.setdefault(name, []).append(out := real(df, name))
        return out

    monkeypatch.setattr(search, "written", seen)
    monkeypatch.setattr(search, "SHARD_DOCS", 37)
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "query_id long, text string")
    for k in (1, 4, 30):
        got = [(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.bm25_topk(docs, queries, k).collect()]
        assert sorted(got, key=str) == sorted(_bm25(rows, asked, k), key=str)
        (found,) = made.pop("search-pass")
        assert found.select("query_id").distinct().count() == 26  # 25 texts and w1
        assert found.groupBy("query_id", "high", "low").count().where("count > 1").isEmpty()


def test_shards_meet_queries_exactly(monkeypatch):
    """Long and short queries against shards one after the other, for several sizes of blocks, against all scores."""
    rng = np.random.default_rng(3)
    weights = 1 / np.arange(1, 1501)
    shards, every = [], []
    for shard in range(3):
        lengths = rng.integers(0, 90, 700)
        words = rng.choice(1500, lengths.sum(), p=weights / weights.sum())
        spelled, number = np.unique(words, return_inverse=True)
        names = (np.arange(700) * 3 + shard).tolist()
        rows = pa.Table.from_batches([search._shard_rows(shard, {f"w{w}": i for i, w in enumerate(spelled)}, number.astype(np.int64), lengths, names)])
        shards.append(rows.append_column("ids", pa.array([[int(t[1:]) * 7 for t in ts] for ts in rows["terms"].to_pylist()], pa.list_(pa.int64()))))
        every += [(name, words[hi - n : hi]) for name, n, hi in zip(names, lengths, np.cumsum(lengths), strict=True)]
    mean = sum(len(w) for _, w in every) / len(every)
    df = np.bincount(np.concatenate([np.unique(w) for _, w in every]), minlength=1500)
    idf = np.log(1 + (len(every) - df + 0.5) / (df + 0.5))
    part = np.zeros((len(every), 1500))
    for i, (_, w) in enumerate(every):
        tf = np.bincount(w, minlength=1500)
        part[i] = np.where(tf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean)), 0)
    asked = [np.unique(rng.choice(1500, n, p=weights / weights.sum())) for n in rng.integers(1, 400, 60)]
    queries = search._Pass(list(range(60)), np.concatenate([[0], np.cumsum([len(a) for a in asked])]), np.concatenate(asked).astype(np.int32), np.arange(1500) * 7, idf)
    names = np.array([n for n, _ in every])
    for scores, together, chunk, dense in ((1 << 22, 256, 256, 1 / 32), (5000, 7, 16, 0.2), (1, 16, 64, 2.0), (1 << 22, 64, 32, 0.0)):
        for name, value in (("SCORES", scores), ("TOGETHER", together), ("CHUNK", chunk), ("DENSE", dense)):
            monkeypatch.setattr(search, name, value)
        best = search._Best(60, 10)
        for rows in shards:
            search._Shard(rows, queries, mean).answer(queries, best)
        for i, a in enumerate(asked):
            score = np.round(part[:, a].sum(axis=1), 9)
            order = [j for j in np.lexsort((names, -score))[:10] if score[j] > 0]
            assert best.doc[i][best.score[i] > 0].tolist() == names[order].tolist()
            assert np.allclose(best.score[i][best.score[i] > 0], score[order], atol=2e-9)


def test_blocks_are_skipped_by_their_bounds(monkeypatch):
    """A rare term's few documents lift the floor; blocks without them are never scored for that query."""
    lengths = np.full(4096, 10)
    words = np.concatenate([np.array([1] * 10 if d in (5, 70, 4000) else [0] * 10) for d in range(4096)])
    rows = pa.Table.from_batches([search._shard_rows(0, {"common": 0, "rare": 1}, words, lengths, list(range(4096)))])
    rows = rows.append_column("ids", pa.array([[{"common": 3, "rare": 9}.get(t) for t in ts] for ts in rows["terms"].to_pylist()], pa.list_(pa.int64())))
    asked = search._Pass([1], np.array([0, 2]), np.array([0, 1], np.int32), np.array([3, 9]), np.array([0.01, 7.0]))
    shard, best, entered = search._Shard(rows, asked, 10.0), search._Best(1, 2), []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **b: entered.append(x.shape) or real(x, *a, **b))
    shard.answer(asked, best)
    assert best.doc[0].tolist() == [5, 70] and len(entered) < 4


def test_texts_without_terms(spark, monkeypatch):
    """Alone in a table, in a partition or in a shard, they are documents of no tokens."""
    nothing = [(1, ""), (2, None), (3, "!!!")]
    queries = spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    schema = "doc_id long, text string"
    assert search.bm25_topk(spark.createDataFrame(nothing, schema), queries).count() == 0
    rows = [*nothing, (4, "cat"), (5, "cat dog"), (6, "bird")]
    for shard in (1, 2, 100):
        monkeypatch.setattr(search, "SHARD_DOCS", shard)
        for parts in (1, 6):
            docs = spark.createDataFrame(rows, schema).repartitionByRange(parts, "doc_id")
            got = [(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.bm25_topk(docs, queries).collect()]
            assert sorted(got, key=str) == _bm25(rows, [(1, "cat dog")], 10)


def test_many_short_texts_take_little_memory():
    import tracemalloc

    n = search.SHARD_DOCS
    rows = pa.Table.from_batches([search._shard_rows(0, {"a": 0, "b": 1}, np.arange(n) % 2, np.ones(n, np.int64), list(range(n)))])
    rows = rows.append_column("ids", pa.array([[{"a": 1, "b": 2}[t] for t in ts] for ts in rows["terms"].to_pylist()], pa.list_(pa.int64())))
    asked = search._Pass(list(range(1000)), np.arange(1001), np.arange(1000, dtype=np.int32) % 2, np.array([1, 2]), np.array([0.5, 0.6]))
    tracemalloc.start()
    search._Shard(rows, asked, 1.0).answer(asked, search._Best(1000, 10))
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_entropy_and_features():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefg hij") for _ in range(n)).encode() for n in (0, 1, 20, 31, 32, 33, 64, 500, 3000)]
    x = np.frombuffer(texts[-1], np.uint8)
    for i, level in list(enumerate(fp.entropy_levels(x)))[::50]:
        c = Counter(x[i : i + fp.WINDOW].tolist())
        h = -sum(v / fp.WINDOW * math.log2(v / fp.WINDOW) for v in c.values())
        assert abs(level - h / math.log2(fp.WINDOW) * fp.LEVELS) <= 1
    rank = fp.rank_levels(fp.level_counts(texts))
    together = fp.features(texts, rank)
    assert all((a == fp.features([t], rank)[0]).all() for a, t in zip(together, texts, strict=True))
    assert len(together[0]) == 0 and all(len(f) for f in together[1:])


def test_segments_agree(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefg hij\n") for _ in range(20_000)).encode()
    counts = fp.level_counts([text])
    rank = fp.rank_levels(counts)
    whole = fp.features([text], rank)[0]
    monkeypatch.setattr(fp, "SEGMENT", 1500)
    assert (fp.level_counts([text]) == counts).all() and (fp.features([text], rank)[0] == whole).all()


def test_likeness():
    rng = random.Random(10)
    words = [f"x{i}" for i in range(2000)]
    a = " ".join(rng.choices(words, k=900))
    b, c = a[: len(a) // 2] + " ".join(rng.choices(words, k=450)), " ".join(rng.choices(words, k=900))
    rank = fp.rank_levels(fp.level_counts([a.encode(), c.encode()]))
    p = fp.fingerprint([a, b, c, ""], rank)
    assert fp.likeness(p[0], p[0]) == 1 and fp.likeness(p[3], p[3]) == 1 and fp.likeness(p[0], p[3]) == 0
    assert 0.3 < fp.likeness(p[0], p[1]) < 0.8 and fp.likeness(p[0], p[2]) < 0.2
    assert fp.likeness(p[0], p[1]) == fp.likeness(p[1], p[0])
    assert (fp.unspell(fp.spell(p[0])) == p[0]).all()


def _neighbours(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] is not None, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        out.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    return out


def test_neighbours(spark):
    rng = random.Random(11)
    rows = [(i * 13 % 997, "".join(rng.choice("abc dé\n") for _ in range(rng.choice([0, 1, 40, 300])))) for i in range(300)]
    rows += [(5000, None), (-7, "least"), (rows[0][0], rows[0][1]), (None, "nobody"), (4000, "long words " * 20_000)]
    for part in (rows, rows[:1], rows[:2]):
        docs = spark.createDataFrame([(d, t, "x") for d, t in part], "doc_id long, text string, ghost string").repartition(3)
        for parts in (1, 5):
            got = fp.against_neighbours(docs, parts).collect()
            assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(_neighbours(part))
            assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.against_neighbours(docs.where("false"), 3).count() == 0


def test_whole_documents_are_queries(spark):
    """Every document with doc_id % 20 = 0, whole, against all documents."""
    from skylattice.llm import registry
    from skylattice.llm.common import read

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    asked = [r for r in rows if r[0] % 20 == 0]
    assert len(asked) == 10 and max(len(set(search.tokens(t))) for _, t in asked) > 50
    got = sorted(((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in registry.QUERIES["op9_bm25_documents"](spark, sf).collect()), key=str)
    assert got == sorted([(*r[:3], round(r[3], 5)) for r in _bm25(rows, asked, 10)], key=str)
    assert {q for q, rank, d, _ in got if rank == 1 and rows[q][1] == dict(rows)[d]} == {q for q, _ in asked}


def test_long_queries_add_up(spark, monkeypatch):
    """Blocks, ties and queries in several passes."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(200)], k=rng.randint(0, 80)))) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    queries = docs.where("doc_id % 20 = 0").selectExpr("doc_id as query_id", "text")
    monkeypatch.setattr(search, "PASS_TERMS", 300)
    got = sorted(((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in search.bm25_topk(docs, queries, 7).collect()), key=str)
    assert got == _bm25(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_words_of_any_script(spark):
    assert search.tokens("Élan_né café 2² Straße") == ["élan", "né", "café", "2²", "straße"]
    rows = [(1, "où est l'été"), (2, "ou est l t"), (3, "Привет, мир"), (4, "καλημέρα κόσμε"), (5, "مرحبا بالعالم"), (6, "你好 世界"), (7, "हिन्दी भाषा"), (8, "plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    best = {r.query_id: r.doc_id for r in search.bm25_topk(docs, docs.selectExpr("doc_id as query_id", "text")).where("rank = 1").collect()}
    assert best == {d: d for d, _ in rows}


def test_documents_equal_sql(spark):
    import duckdb

    from skylattice.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT query_id, rank, doc_id, score FROM ({registry.ORACLES['op9_bm25_documents']})").fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["op9_bm25_documents"](spark, sf).select("query_id", "rank", "doc_id", "score").collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_features_and_likeness_against_a_plain_version():
    """Which windows are features, what the chain holds and how alike two chains are, from their definitions."""
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdefgh ij\n") for _ in range(n)).encode() for n in (32, 33, 70, 400, 1500)]
    rank = fp.rank_levels(fp.level_counts(texts))
    for text, found in zip(texts, fp.features(texts, rank), strict=True):
        x = np.frombuffer(text, np.uint8)
        key = [(int(rank[level]), i) for i, level in enumerate(fp.entropy_levels(x))]
        spans = max(len(key) - fp.SPAN, 0) + 1
        wins = Counter(min(key[s : s + fp.SPAN])[1] for s in range(spans))
        places = sorted(i for i, n in wins.items() if n >= min(fp.POPULAR, spans))
        windows = list(dict.fromkeys(text[i : i + fp.WINDOW] for i in places))
        assert len(found) == len(windows)
        again = {}
        for w, h in zip(windows, found.tolist(), strict=True):
            assert again.setdefault(w, h) == h
        bits = fp.chain(found)
        for k in range(0, len(found), fp.PER_FILTER):
            want = {(int(h) >> 11 * j) % fp.BITS for h in found[k : k + fp.PER_FILTER] for j in range(fp.HASHES)}
            assert set(np.flatnonzero(np.unpackbits(bits[k // fp.PER_FILTER])).tolist()) == want
    a, b = fp.fingerprint([texts[3].decode(), (texts[3][:300] + texts[4][:600]).decode()], rank)
    row, others = np.unpackbits(a[0]).astype(int), [np.unpackbits(r).astype(int) for r in b]
    best = 0.0
    for o in others:
        chance = row.sum() * o.sum() / fp.BITS
        best = max(best, min(1.0, max(0.0, ((row & o).sum() - chance) / (min(row.sum(), o.sum()) - chance))))
    assert len(a) == 1 and abs(fp.likeness(a, b) - best) < 1e-12
