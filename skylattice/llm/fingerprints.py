"""Document fingerprints from improbable features.

Every window of bytes has an entropy; entropies that are rare in the corpus make a window
improbable. The windows that are locally the most improbable are a text's features.
They fill a chain of Bloom filters, and two chains are alike by the bits they share
beyond what chance would share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, ship, slices, tidy

WINDOW = 32  # bytes of a feature
SPAN = 32  # window positions that compete
POPULAR = 8  # spans a position must win
LEVELS = 1000  # entropy is ranked in so many steps
BITS, HASHES, PER_FILTER = 2048, 5, 160
BLOCK = 1 << 18  # bytes looked at together
SEGMENT = 1 << 20  # longer texts are looked at in overlapping parts
_MARGIN = WINDOW + 2 * SPAN

_SCALE = 1 << 20
_counts = np.arange(WINDOW + 1)
_G = np.round(_counts * np.log2(np.maximum(_counts, 1)) * _SCALE).astype(np.int64)
_DG = np.diff(_G, prepend=0)
_TOP = WINDOW * int(np.log2(WINDOW)) * _SCALE
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MI = np.uint64(pow(int(_M), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _M), ("down", _MI)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """Entropy step (0 to LEVELS) of the window at each position of x, exact by increments."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
    for d in range(1, WINDOW):
        same = (x[:-d] == x[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = _G[np.bincount(x[:WINDOW])].sum()
    steps = _DG[behind[WINDOW:]] - _DG[ahead[: n - 1]]
    sums = np.concatenate([[first], first + np.cumsum(steps)])
    return (_TOP - sums) * LEVELS // _TOP


def _parts(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Blocks of (text number, bytes, first and last position to answer for)."""
    block, size = [], 0
    for k, t in enumerate(texts):
        if len(t) <= SEGMENT:
            parts = [(k, t, 0, len(t))]
        else:
            parts = [(k, t[max(0, a - _MARGIN) : a + SEGMENT + _MARGIN], min(a, _MARGIN), min(a, _MARGIN) + SEGMENT) for a in range(0, len(t), SEGMENT)]
        for p in parts:
            if block and size + len(p[1]) > BLOCK:
                yield block
                block, size = [], 0
            block.append(p)
            size += len(p[1])
    if block:
        yield block


def level_counts(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(LEVELS + 1, np.int64)
    for block in _parts(texts):
        x = np.frombuffer(b"".join(p[1] for p in block), np.uint8)
        levels, at = entropy_levels(x), 0
        keep = np.zeros(len(levels), bool)
        for _, t, lo, hi in block:
            keep[at + lo : max(at + lo, min(at + hi, at + len(t) - WINDOW + 1))] = True
            at += len(t)
        out += np.bincount(levels[keep], minlength=LEVELS + 1)
    return out


def rank_levels(counts: np.ndarray) -> np.ndarray:
    """Place of each entropy step by rarity: the rarest seen first, the unseen before all.

    Steps of the lowest fifth (runs of few bytes, which say nothing) come last."""
    order = np.argsort(counts, kind="stable")
    order = np.concatenate([order[order >= LEVELS // 5], order[order < LEVELS // 5]])
    rank = np.empty(LEVELS + 1, np.int64)
    rank[order] = np.arange(LEVELS + 1)
    return rank


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features in order of place, each once."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for block in _parts(texts):
        x = np.frombuffer(b"".join(p[1] for p in block) + bytes(SPAN + WINDOW), np.uint8)
        levels = entropy_levels(x)
        lengths = np.array([len(p[1]) for p in block], np.int64)
        starts = np.cumsum(lengths) - lengths
        places = np.maximum(lengths - WINDOW + 1, 0)
        key = (rank[levels] << 32) | np.arange(len(levels))
        valid = np.zeros(len(levels) + 1, np.int64)
        np.add.at(valid, starts[places > 0], 1)
        np.add.at(valid, (starts + places)[places > 0], -1)
        key[np.cumsum(valid[:-1]) == 0] = np.iinfo(np.int64).max
        least = key
        for shift in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-shift], least[shift:])
        spans = np.where(places > 0, np.maximum(places - SPAN, 0) + 1, 0)
        total = int(spans.sum())
        begin = np.repeat(starts - (np.cumsum(spans) - spans), spans) + np.arange(total)
        wins = np.bincount(least[begin] & 0xFFFFFFFF, minlength=len(levels))
        some = np.flatnonzero(wins)
        of = np.searchsorted(starts, some, "right") - 1
        local = some - starts[of]
        lo, hi = np.array([p[2] for p in block]), np.array([p[3] for p in block])
        good = (wins[some] >= np.minimum(POPULAR, spans[of])) & (local >= lo[of]) & (local < hi[of])
        some, of = some[good], of[good]
        up, down = _power(len(x))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) * up + up)])
        hashes = _mix((sums[some + WINDOW] - sums[some]) * down[some])
        edges = np.searchsorted(of, np.arange(len(block) + 1))
        for j, (k, t, _, _) in enumerate(block):
            if places[j]:
                found[k].append(hashes[edges[j] : edges[j + 1]])
            elif t and not found[k]:
                found[k].append(np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), np.uint64))
    out = []
    for parts in found:
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        out.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return out


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters (rows of bytes) that hold the features in order, PER_FILTER each."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def spell(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def unspell(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap with one of the other, beyond
    chance and as a part of what is possible; their mean. Two empty chains are alike, one isn't."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    n_a, n_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    if (len(b), n_b.sum(), b.tobytes()) < (len(a), n_a.sum(), a.tobytes()):
        a, b, n_a, n_b = b, a, n_b, n_a
    total = 0.0
    for row, n in zip(a, n_a, strict=True):
        both = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(n, n_b), n * n_b / BITS
        total += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def corpus_ranks(docs: DataFrame, column: str = "text") -> np.ndarray:
    """Rarity ranks over every window of every text; LEVELS + 1 sums reach the driver."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += level_counts([(t or "").encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in docs.select(column).mapInArrow(tidy(run), "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    return rank_levels(counts)


def fingerprint(texts: list[str], rank: np.ndarray) -> list[np.ndarray]:
    return [chain(h) for h in features([t.encode("utf-8", "surrogatepass") for t in texts], rank)]


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """docs in `parts` ranges of doc_id, descending within each, with a ghost of the row that follows the last.

    Range bounds and each range's greatest id reach the driver (two numbers a partition); the text is shuffled once.
    Null doc_ids come last."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    ids = docs.select(key.alias("k"))
    at = [float(i) / parts for i in range(1, parts)]
    bounds = sorted(set(ids.agg(F.percentile_approx("k", at, 100 * parts)).first()[0] or [])) if at else []
    step = max(1, int(len(bounds) ** 0.5))

    def bucket(c):
        if not bounds:
            return F.lit(0)
        every, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[step - 1 :: step]))
        below = lambda xs: F.size(F.filter(xs, lambda b: b < c))
        i = below(coarse) * step
        return i + below(F.slice(every, i + 1, F.lit(step)))

    most = {r["b"]: r["m"] for r in ids.groupBy(bucket(F.col("k")).alias("b")).agg(F.max("k").alias("m")).collect()}
    full = sorted(most)
    follows = dict(zip(full, full[1:] + full[:1], strict=True))  # where the greatest of a range is the ghost
    tops = F.array(*[F.lit(most.get(b, 0)).cast("long") for b in range(len(bounds) + 1)])
    into = F.array(*[F.lit(follows.get(b, 0)) for b in range(len(bounds) + 1)])
    placed = docs.select("doc_id", "text", key.alias("k")).withColumn("b", bucket(F.col("k")))
    where = F.when(F.element_at(tops, F.col("b") + 1) == F.col("k"), F.array("b", F.element_at(into, F.col("b") + 1))).otherwise(F.array("b"))
    dealt = placed.select("doc_id", "text", "k", F.posexplode(where).alias("ghost", "to"))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("to"))
    return dealt.sortWithinPartitions(F.col("ghost"), F.col("k").desc(), F.col("text")).select("doc_id", "text", "ghost")


PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): see PAIRED. The next document is the one with the next smaller doc_id
    (after the last, the first); the edited text is the document with its last half (rounded down)
    replaced by as many first characters of the next.

    Null text: empty, with an empty fingerprint. Repeated doc_ids follow each other by text. A single row is
    its own next. Texts below WINDOW bytes are one feature. A long text is looked at whole, in overlapping parts. An empty
    table gives an empty result. Other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    rank = corpus_ranks(docs)

    def answer(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [following]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts[:-1], texts[1:], strict=True)]
        prints = fingerprint(texts + edited, rank)
        own, other = prints[: len(texts)], prints[len(texts) :]
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([spell(p) for p in own[:-1]]), pa.array([spell(p) for p in other]),
            pa.array([likeness(p, q) for p, q in zip(own[:-1], other, strict=True)], pa.float64()),
            pa.array([likeness(p, q) for p, q in zip(own[:-1], own[1:], strict=True)], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, over = 0, False
        for part in (p for batch in batches for p in slices(batch, 1)):
            if over:
                continue
            for doc, text, ghost in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if ghost:
                    yield answer(rows, text or "")
                    over = True
                    break
                if len(rows) >= 128 or held > SLICE:
                    yield answer(rows, text or "")
                    rows, held = [], 0
                rows.append((doc, text or ""))
                held += len(text or "")

    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _in_order(docs, parts).mapInArrow(tidy(run), PAIRED)
