"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, written, tidy

THRESHOLD = 0.3
#: Labelled rows learned from, at most: those with the least hashes.
SAMPLE = 40_000

#: Byte classes counted in each text.
_NAMES = ["lower", "upper", "digit", "blank", "line", "control", "stop", "comma", "bang", "query", "quote", "bracket", "markup", "symbol", "slash", "lead", "trail"]
_GROUPS = {"blank": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "bang": b"!", "query": b"?", "quote": b"'\"`", "bracket": b"()[]{}", "markup": b"<>&=|", "symbol": b"#$%*+@^_~-", "slash": b"/\\"}


def _byte_class(b: int) -> int:
    for name, group in _GROUPS.items():
        if b in group:
            return _NAMES.index(name)
    kind = "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "lead" if b >= 192 else "trail" if b >= 128 else "control"
    return _NAMES.index(kind)


_CLASS = np.array([_byte_class(b) for b in range(256)], np.uint8)
FEATURES = [
    "bytes", "words", "lines", *[f"{n}_share" for n in _NAMES], "word_length", "word_spread", "short_words", "long_words", "distinct_words", "top_word",
    "distinct_lines", "top_line", "line_length", "ends_closed", "entropy", "distinct_pairs", "top_pair", "words_a_sentence", "capital_words", "numeric_words",
]


def _class_counts(raw: bytes) -> np.ndarray:
    out, step = np.zeros(len(_NAMES), np.int64), 1 << 20
    for lo in range(0, len(raw), step):
        out += np.bincount(_CLASS[np.frombuffer(raw, np.uint8, min(step, len(raw) - lo), lo)], minlength=len(_NAMES))
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; an empty or null one has zeros. One text is looked at a time."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            row[:] = _text_statistics(text)
    return out


def _text_statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    counts, size = _class_counts(raw), len(raw)
    shares = counts / max(1, size)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 3 + shares.tolist() + [0.0] * (len(FEATURES) - 3 - len(_NAMES))
    some = shares[shares > 0]
    lengths = np.fromiter(map(len, words), np.int64, n)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [s for s in text.split("\n") if s.strip()]
    own = Counter(lines)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_counts=True)[1]
    return [
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), *shares,
        lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths > 12).mean(), len(number) / n, np.bincount(ids).max() / n, len(own) / len(lines), max(own.values()) / len(lines),
        np.log1p(len(text) / len(lines)), sum(s.rstrip()[-1] in ".!?" for s in lines) / len(lines), -(some * np.log2(some)).sum(),
        len(pairs) / max(1, n - 1), pairs.max(initial=0) / max(1, n - 1), np.log1p(n / (1 + counts[_NAMES.index("stop")])),
        sum(map(str.istitle, words)) / n, sum(map(str.isdigit, words)) / n,
    ]


@dataclass
class Forest:
    """Trees flattened into arrays: node i of tree t tests feature[t, i] <= cut[t, i] and goes to
    2i + 1 or 2i + 2; the leaves of the last level hold values. All trees are full, so a whole batch goes down together."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner if len(x) else False:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, smooth: float = 4.0) -> Forest:
    """Second-order boosting of the logistic loss; splits are chosen on histograms of binned features."""
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    if not len(y):
        return Forest(feature[:0], cut[:0], value[:0], 0.0)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")).astype(np.float32) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * bins
    f = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for n in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == n)
                if len(rows):
                    at = flat[rows].ravel()
                    size = x.shape[1] * bins
                    gs = np.bincount(at, np.repeat(g[rows], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    hs = np.bincount(at, np.repeat(h[rows], x.shape[1]), size).reshape(-1, bins).cumsum(axis=1)
                    all_g, all_h = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + smooth) + (all_g - gs) ** 2 / (all_h - hs + smooth) - all_g**2 / (all_h + smooth)
                    gain[(hs < 1) | (all_h - hs < 1)] = 0
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        feature[t, n], cut[t, n] = j, edges[j][b]
                        node[rows] = 2 * n + 1 + (binned[rows, j] > b)
                        continue
                node[rows] = 2 * n + 1
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        f += value[t][leaf]
    return Forest(feature, cut, value, base)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the statistics of every row's whole text, as array `stats`."""
    ship(docs.sparkSession)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                s = statistics(part.column(part.num_columns - 1).to_pylist())
                lists = pa.ListArray.from_arrays(np.arange(0, s.size + 1, width, dtype=np.int32), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*part.schema.names[:-1], "stats"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_looked_at")).mapInArrow(tidy(run), f"{schema}, stats array<float>")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on the rows of docs(doc_id, text) that labels(doc_id, quality) marks: at most `sample` of them, those with the least hashes of doc_id.

    Null and other labels than 0 and 1 teach nothing; a doc_id with several labels counts once with their mean, and one with
    several texts with the one of the least hash. Null doc_ids are not marked. Other columns of both tables may have any names.

    The drawn marks (at most about 1.1 times the sample, three numbers each) are written and broadcast, so texts are not shuffled;
    one row of statistics for each mark is, and reaches the driver."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(F.avg("quality").alias("_quality"))
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("_of")), F.lit(1_000_003)) / 1_000_003.0
    marks = written(marks.withColumn("_draw", draw).where(F.col("_draw") < (1.1 * sample + 100) / max(1, n)), "quality-marks")
    if (drawn := marks.count()) > 2 * sample + 1000:
        raise ValueError(f"{drawn} marks drawn for a sample of {sample}")
    named = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), "text").join(F.broadcast(marks), F.col("_doc") == F.col("_of"))
    seen = measure(named, ("_of", "_quality", "_draw", "_hash")).groupBy("_of").agg(F.min(F.struct("_hash", "_quality", "_draw", "stats")).alias("one"))
    rows = seen.select("_of", "one.*").toArrow()
    if not rows.num_rows:
        return boost(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x = rows["stats"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    order = np.lexsort((rows["_of"].to_numpy(), rows["_draw"].to_numpy()))[:sample]
    return boost(x[order], rows["_quality"].to_numpy()[order])


def score(docs: DataFrame, model: Forest, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score (0 to 1) and predicted (1 from the threshold up) of every row; only `text` is looked at.

    A null or empty text has all statistics zero and is scored by them. A long text is looked at whole, alone in its slice; repeated rows get equal
    results, an empty table an empty one."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 512):
                s = model.score(statistics(part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names[:-1], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_looked_at")).mapInArrow(tidy(run), f"{schema}, score double, predicted int")
