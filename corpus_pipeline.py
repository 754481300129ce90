"""The corpus pipeline: language, quality, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of `documents`. run() writes every stage's rows to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import language, mixing, near_dedup, packing, quality
from skylattice.llm.common import kept_rows, read, tokenizer_path, written

#: A document goes if its language can't be told: its score must be this power of a guess's, half the way from a guess to certainty in logarithms.
LEAST_LANGUAGE_POWER = 0.5
#: Pieces of text that a worker remembers while it packs: five stages share its memory.
MEMO = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told from their text.

    Only `text` is looked at. A null text, or one without a letter, goes; an empty one too. A text of any length is judged whole. Rows
    that repeat are judged alike; null doc_ids do not matter. Nothing is kept of an empty table, and nothing if no language was learned.
    Extra columns of any name stay as they are."""
    teach = read(spark, sf_dir, "documents").where(~language.held_out(4, 2))
    model = language.learn(teach)
    least = {lang: guess**LEAST_LANGUAGE_POWER for lang, guess in model.guesses().items()}

    def told(texts: list[str | None]) -> list[bool]:
        return [lang != language.UNDETERMINED and score >= least[lang] for lang, score in zip(*model.predict(texts), strict=True)]

    return kept_rows(docs, told)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier predicts to be of quality 1.

    Only `text` is looked at; a null or empty one has all statistics zero and is judged by them. A score at the threshold stays. Rows that repeat
    are judged alike, null doc_ids do not matter, and without any label every document has the score 0.5 and stays. Nothing is kept
    of an empty table. Extra columns of any name stay as they are."""
    teach = read(spark, sf_dir, "documents").where(~language.held_out(5, 0))
    model = quality.learn(teach, read(spark, sf_dir, "labels"))
    return kept_rows(docs, lambda texts: (model.score(quality.statistics(texts)) >= quality.THRESHOLD).tolist())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class: the one with the least doc_id.

    Null and empty texts are one class. Of rows that repeat, or that share the least doc_id and their words, one stays; null doc_ids come
    after all others. Texts below five words are alike only if equal. A text of any length counts whole. An empty table stays empty.
    Extra columns of any name stay as they are."""
    return near_dedup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, maybe never.

    A null text has no words and takes no room; it stays as often as its source does. A null source is one of its own, named last. Rows that repeat,
    or share a doc_id (or have none), share their fate; ties in the seeded hash are taken together. An empty table stays empty, and a
    source without words is taken whole repetitions of zero, so never. Extra columns of any name stay as they are."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a document that comes twice is packed twice.

    Null and empty texts are an end id alone; a text beyond a sequence is cut. Null doc_ids keep their rows. Ties in length go in order of
    the rows. An empty table has no pieces. Other columns than doc_id and text end here."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), memo=MEMO)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]
#: Models and a tokenizer decide; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
