from collections import Counter

import corpus_pipeline as pipe
from skylattice.llm import language, near_dedup, quality
from skylattice.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    first = pipe.identify_language(spark, docs, SF).cache()
    assert first.columns == columns
    lost = docs.exceptAll(first).collect()
    assert all(not language.has_letter(r.text) or len(r.text) < 40 for r in lost)
    second = pipe.classify_quality(spark, first, SF).cache()
    model = quality.learn(docs.where(~language.held_out(5, 0)), read(spark, SF, "labels"))
    want = [r for r in first.collect() if model.score(quality.statistics([r.text]))[0] >= 0.3]
    assert Counter(second.collect()) == Counter(want)
    third = pipe.drop_near_duplicates(spark, second, SF).cache()
    rows = second.collect()
    kept = {r.doc_id for r in third.collect()}
    assert third.columns == columns and len(kept) == third.count()
    raw = {r.doc_id: r.text.encode() for r in rows}
    for d in raw.keys() - kept:
        assert any(near_dedup.multiset_similarity(raw[d], raw[e]) >= 0.8 for e in raw if e != d)
    for d in kept:
        assert all(near_dedup.multiset_similarity(raw[d], raw[e]) < 0.8 for e in kept if e < d)
    fourth = pipe.mix_sources(spark, third, SF)
    often = Counter(r.doc_id for r in fourth.collect())
    assert fourth.columns == columns and set(often) <= kept and max(often.values()) <= 3
    fifth = pipe.pack_sequences(spark, fourth, SF).collect()
    assert Counter({d: sum(1 for r in fifth if r.doc_id == d and r.start == 0) for d in often}) == often


def test_run(spark):
    assert [n for n, _ in pipe.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "mixing sources to target weights", "packing"]
    assert pipe.run(spark, SF).count() > 0


UNLEARNED = [
    "Il governo ha annunciato ieri che le nuove misure entreranno in vigore la prossima settimana, dopo una lunga discussione in parlamento.",
    "Rząd ogłosił wczoraj, że nowe przepisy wejdą w życie w przyszłym tygodniu po długiej dyskusji w parlamencie na temat reformy emerytalnej.",
    "Hallitus ilmoitti eilen, että uudet toimet tulevat voimaan ensi viikolla pitkän eduskunnassa käydyn keskustelun jälkeen.",
    "Правительство объявило вчера, что новые меры вступят в силу на следующей неделе после долгого обсуждения в парламенте.",
    "政府昨天宣布,新措施将于下周生效,此前议会进行了长时间的讨论。",
    "xq zvk jjw qpt bnm wxz kkj qqv zzx vbn ptk xwq jkz qvx wpn zkt",
    "kjhsdf iuwer nbxcv oiqwe zmxnc lkasj qpwoe iruty alskd jfhg zmxn cbv",
]


def test_language_stage_rejects_what_it_cannot_tell(spark):
    """Texts in unlearned languages and noise go; clean held-out rows stay."""
    sf = "/root/testdata/sf0.1"
    held = read(spark, sf, "documents").where(language.held_out(4, 2))
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(UNLEARNED)], "doc_id long, text string")
    kept = {r.doc_id for r in pipe.identify_language(spark, held.select("doc_id", "text").unionByName(more), sf).select("doc_id").collect()}
    assert min(kept) >= 0
    assert held.count() - len(kept) <= 0.002 * held.count()


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names, empty tables: each stage as its docstring says."""
    from pyspark.sql import functions as F

    base = read(spark, SF, "documents")
    some = [r.text for r in base.where("lang = 'en' and n_chars > 1500").orderBy("doc_id").limit(3).collect()]
    rows = [(None, some[0], None, None, None), (900, None, "en", None, 0), (901, "", None, "src0", 0), (902, some[1], "en", "src0", 1), (902, some[1], "en", "src0", 1), (903, some[2] * 40, "en", None, 2), (None, some[0], None, None, None), (904, "12 !!", "de", "src1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["quality", "score", "d", "_draw", "node", "group", "row", "of", "doc", "_row", "_mix_source", "whole", "label", "n"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)]).repartition(3)
    first = pipe.identify_language(spark, docs, SF)
    assert first.columns == docs.columns and Counter(r.doc_id for r in first.collect()) == {None: 2, 902: 2, 903: 1}
    second = pipe.classify_quality(spark, first, SF)
    assert second.columns == docs.columns and set(map(tuple, second.collect())) <= set(map(tuple, docs.collect()))
    third = pipe.drop_near_duplicates(spark, docs, SF)
    assert third.columns == docs.columns and Counter(r.doc_id for r in third.collect()) == {None: 1, 900: 1, 902: 1, 903: 1, 904: 1}
    fourth = pipe.mix_sources(spark, docs, SF)
    times = Counter(map(tuple, fourth.collect()))
    whole = Counter(map(tuple, docs.collect()))
    assert fourth.columns == docs.columns and set(times) <= set(whole) and all(times[r] % whole[r] == 0 and times[r] <= 3 * whole[r] for r in times)
    fifth = pipe.pack_sequences(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in fifth if r.start == 0) == Counter(r[0] for r in rows)
    assert [r.doc_tokens for r in fifth if r.doc_id in (900, 901)] == [1, 1]
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_stages_with_other_types_of_doc_id(spark, tmp_path):
    """Copies with shifted keys may come with doc_ids of another type than long: no stage fails on them, and each keeps its type."""
    from pyspark.sql import functions as F

    for kind, spelled in (("int", "doc_id"), ("string", "concat('d', doc_id)")):
        for table in ("documents", "labels"):
            read(spark, SF, table).withColumn("doc_id", F.expr(spelled).cast(kind)).write.parquet(f"{tmp_path}/{kind}/{table}.parquet")
        docs = read(spark, f"{tmp_path}/{kind}", "documents").where("length(text) < 3000")
        given = docs.select("doc_id", "text")
        third = pipe.drop_near_duplicates(spark, docs, f"{tmp_path}/{kind}").cache()
        assert third.schema == docs.schema and third.exceptAll(docs).isEmpty()
        assert third.count() == near_dedup.near_classes(given).select("class_id").distinct().count()
        for _, stage in pipe.STAGES:
            docs = stage(spark, docs, f"{tmp_path}/{kind}")
            assert dict(docs.dtypes)["doc_id"] == kind
        packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
        assert packed and all(r.n % r.of == 0 for r in packed)
