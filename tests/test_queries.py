"""Every registered query that has SQL agrees with it, and results do not depend on the number of partitions."""

import duckdb
import pytest

import __spark_entry__
from skylattice import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cells):
    return sorted(map(str, cells))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["hybrid_kis", "kbest_viterbi", "dante_n3", "rank_normalize", "pool_cap"])
def test_partitions_do_not_matter(spark, name):
    got = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(map(tuple, catalog.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _schemas(df):
    """Columns that a plan's scans read."""
    import re

    return re.findall(r"ReadSchema: struct<([^\n]*)>", df._jdf.queryExecution().executedPlan().toString())


def test_plan_prunes(spark):
    """Scans read the columns that a query needs: texts, vectors for scans alone, postings without their entries for bounds."""
    from skylattice.operators import lexical, nearest
    from skylattice.plans.binding import Tables
    from skylattice.plans.retrieval_queries import _index

    assert _schemas(catalog.QUERIES["fold_tokenize"](spark, SF)) == ["doc_id:bigint,text:string"]
    t = Tables(spark, SF)
    best = nearest.best_rows(t.frames, t.asked, 5)
    assert all(s == "row_id:bigint,emb:array<float>" for s in _schemas(best))
    index, asked = _index(t), t.benchmark.selectExpr("item_id AS query_id", "0 AS probe_idx", "text")
    known = lexical._asked(index, asked, False)
    bounds = lexical._meet(known, 1, index.blocks.drop("entries")).select("bucket", "most_tf")
    assert any("most_tf" in s and "entries" not in s for s in _schemas(bounds))
    moments = nearest.folded(t.frames, t.asked)
    assert all(s == "emb:array<float>" for s in _schemas(moments))
    pool = catalog.QUERIES["pool_quota"](spark, SF)
    assert pool.columns == ["query_id", "source", "row_id", "nth"] and not any("emb" in s for s in _schemas(pool))


def test_whole_texts_reach_the_operators(spark, con):
    """Pieces of probes and quotes make up the whole text again."""
    got = {}
    for r in catalog.QUERIES["quoted_whole"](spark, SF).orderBy("item_id", "quote_idx").collect():
        assert len(r.quoted) <= 80
        got.setdefault(r.item_id, []).append(r.quoted)
    passages = dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    assert {k: "".join("".join(v).split()) for k, v in got.items()} == {k: "".join(t.translate(dict.fromkeys(map(ord, "\"“”'"))).split()) for k, t in passages.items()}
    probes = {}
    for r in catalog.QUERIES["probe_split_whole"](spark, SF).collect():
        probes[r.doc_id] = max(probes.get(r.doc_id, 0), len(r.probe))
    longest = con.execute("SELECT doc_id FROM documents ORDER BY length(text) DESC LIMIT 1").fetchone()[0]
    assert probes[longest] > 40
