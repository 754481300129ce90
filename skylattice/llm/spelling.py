"""Spelling variants: words of a vocabulary at edit distance one, grouped under their commonest form.

The vocabulary joins itself on tries with active-node sets. A trie holds the words of one part of the vocabulary. Going down it, each node keeps
the nodes whose strings are at most one edit away from its own; a child's set follows from its parent's, and a terminal node
pairs with the terminal nodes of its set.

Parts are prefixes, so that a task holds a small trie: of two words one edit apart, the longer of length M, all
before the edit and all behind it is equal. A part has a window of places in words of length M and what stands before and behind the
window; its members are the words of length M and M - 1 that agree with that. The first windows are the halves (a prefix for edits in the second half,
an ending for those in the first), so a word is in four parts. Parts above LIMIT words are split by halving
their windows, until a window is one place: there at most one word for each letter fits, and one without.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import SMALL
from .common import ship, tidy, written

#: Letters of a word (fixed value), the divisor of the draw that drops a letter, and what a word of the vocabulary needs.
LETTERS, DROPPED, LEAST_LENGTH, LEAST_COUNT = "[A-Za-zÀ-ÿ]", 97, 5, 3
#: A form is at least so many times as frequent.
DOMINANCE = 2
#: Words of one trie.
LIMIT = 2000
#: Code points of a text that are cut into words together; a stretch ends where a word ends.
STRETCH = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["longer", "lo", "hi", "around"]


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, word) for every run of letters in docs(doc_id, text), A to Z in lower case."""
    stretches = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}{LETTERS}*+"), F.lit(0))).alias("stretch"))
    runs = stretches.select("doc_id", F.explode(F.regexp_extract_all("stretch", F.lit(f"{LETTERS}+"), F.lit(0))).alias("run"))
    return runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("word"))


def with_slips(words: DataFrame) -> DataFrame:
    """(word): where the crc32 of doc_id and word says so, without one of its code points."""
    drawn = words.select("word", F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    return drawn.select(F.when(F.col("h") % DROPPED == 0, less).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n) of words that are long and frequent enough; counted before they are shuffled."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _members(words: DataFrame, windows: Column) -> DataFrame:
    """A row for each window (longer, lo, hi) of each word, with the key of its part."""
    each = words.withColumn("w", F.explode(windows))
    longer, lo, hi, size = F.col("w.longer"), F.col("w.lo"), F.col("w.hi"), F.length("word")
    behind = longer - hi
    around = F.concat(F.col("word").substr(F.lit(1), lo), F.col("word").substr(size - behind + 1, behind))
    return each.select(longer.alias("longer"), lo.alias("lo"), hi.alias("hi"), around.alias("around"), "word", "n")


def _window(longer: Column, lo: Column, hi: Column) -> Column:
    return F.struct(longer.cast("int").alias("longer"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _halves(longer: Column, lo: Column, hi: Column) -> list[Column]:
    mid = F.floor((lo + hi) / 2)
    return [_window(longer, lo, mid), _window(longer, mid, hi)]


def trie_pairs(words: list[str], lo: int, behind: int, longer: int) -> Iterator[tuple[int, int]]:
    """Places (a, b), both ways, of the words of one part that are one edit apart within its window.

    Two words of the shorter length are no pair here, they have a part of their own; a letter that could be
    left out within several windows counts in the one where the words first differ."""
    parts = [w[lo : len(w) - behind] for w in words]
    child: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    for k, part in enumerate(parts):
        node = 0
        for c in part:
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
            node = child[node][c]
        ends[node] = k
    below = [(0, set(child[0].values()))]  # a node and the nodes one edit away from it
    while below:
        node, active = below.pop()
        if node in ends:
            a = ends[node]
            for other in active.intersection(ends):
                b = ends[other]
                one, two = (a, b) if len(words[a]) >= len(words[b]) else (b, a)
                if len(words[one]) == longer and (len(words[two]) == longer or not behind or parts[one] != parts[two] + words[one][longer - behind]):
                    yield a, b
        for c, down in child[node].items():
            near = {node, *child[node].values(), *child[down].values()}  # a letter less, another letter, a letter more
            near.update(step for other in active if (step := child[other].get(c)) is not None)
            near.discard(down)
            below.append((down, near))


def near_words(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, near, near_n), both ways, for all words of vocab(word, n) at edit distance exactly one.

    A part is counted before its words meet; the parts that are too large, few, go on by halves."""
    ship(vocab.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts = None, [], []
        out: tuple[list, ...] = ([], [], [], [])

        def joined() -> None:
            if len(words) > 1:
                longer, lo, hi, _ = key
                for a, b in trie_pairs(words, lo, longer - hi, longer):
                    for column, value in zip(out, (words[a], counts[a], words[b], counts[b]), strict=True):
                        column.append(value)

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "near", "near_n"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for *k, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    joined()
                    key, words, counts = k, [], []
                    if len(out[0]) > 4096:
                        yield rows()
                words.append(word)
                counts.append(n)
        joined()
        yield rows()

    size = F.length("word")
    first = [w for longer in (size, size + 1) for w in _halves(longer, F.lit(0), longer)]
    members, tries = written(_members(vocab, F.array(*first)), "spelling-parts"), []
    while True:
        sizes = written(members.groupBy(*KEY).agg(F.count("*").alias("size")).where("size > 1"), "spelling-sizes")
        large = sizes.where((F.col("size") > limit) & (F.col("hi") - F.col("lo") > 1)).select(*KEY)
        n_large = large.count()
        fit = sizes.join(large, KEY, "left_anti") if n_large else sizes
        tries.append(members.join(fit.select(*KEY), KEY, "left_semi"))
        if not n_large:
            break
        held = members.join(F.broadcast(large) if n_large <= SMALL else large, KEY, "left_semi")
        members = written(_members(held.select("word", "n", *[F.col(k).alias(f"of_{k}") for k in KEY[:3]]), F.array(*_halves(F.col("of_longer"), F.col("of_lo"), F.col("of_hi")))), "spelling-parts")
    together = tries[0]
    for t in tries[1:]:
        together = together.unionByName(t)
    sorted_parts = together.select(*KEY, "word", "n").repartition(*KEY).sortWithinPartitions(*KEY)
    return sorted_parts.mapInArrow(tidy(run), "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of forms(word, form) that has a form: the last word that its forms lead to.

    Every round goes twice as far as the one before. A form is at least DOMINANCE times as frequent, so there are no circles and
    a way has at most as many steps as a count can double: some six rounds are the most."""
    steps = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("of"), F.col("root").alias("further"))
        moved = written(steps.join(on, steps["root"] == on["of"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of vocab(word, n).

    form: the near word of greatest n (then the least in code points), if it is DOMINANCE times as frequent; root: where forms lead, the word itself without one.
    An empty vocabulary gives an empty result."""
    vocab = written(vocab, "spelling-vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocab, limit).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    common = F.col("form_n") >= DOMINANCE * F.col("n")
    found = written(found.withColumns({c: F.when(common, F.col(c)) for c in ("form", "form_n")}), "spelling-forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words in docs(doc_id, text), a row for each word of the vocabulary.

    Null and empty texts have no words. A null doc_id has empty decimals in its draws. Repeated rows count each time. A long text is cut
    into words a stretch at a time; a word of any length goes through. An empty table gives an empty result; other columns are ignored."""
    return variants(vocabulary(with_slips(words_of(docs))))
