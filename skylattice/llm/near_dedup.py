"""Near-duplicates by BagMinHash signatures of word shingles, banded and verified.

A text is the multiset of its runs of five words. Each shingle carries Poisson processes, one for
each dyadic block of counts (up to 1, 2, 4, ...); the points of a block are spread over its unit levels,
and a text with the count c has those up to c. Every point falls on one register, which keeps
the earliest. Two registers agree with the probability of the weighted Jaccard similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, cuts, ship, slices, written, tidy
from .components import components

SHINGLE, SIMILAR = 5, 0.8
#: A pair at 0.8 shares no band with a probability of 6e-6.
BANDS, ROWS = 40, 6
#: A pair is compared by its texts unless its estimate is five standard errors below the threshold.
ERRORS = 5.0
#: Members of a bucket that are compared at once; larger buckets are cut into blocks and all pairs of blocks.
BLOCK = 512
#: The same for texts.
TEXT_BLOCK = 128
REGISTERS = BANDS * ROWS
#: Pairs of a bucket's central node that one copy of its text serves.
SALTED = 512
#: Rows of two numbers that are broadcast to a join, at most.
FEW = 200_000

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_U = np.uint64
_BASE = _U(0xD1B54A32D192ED03)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, 1 << 20), base, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of each distinct shingle of each text.

    Words are runs of other bytes than ASCII blanks. A text of fewer than SHINGLE words is one shingle."""
    x = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    stops = np.cumsum([len(r) + 1 for r in raw])
    blank = _BLANK[x]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(x) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((x.astype(_U) + _U(1)) * up[:-1])])
    word = _mix((sums[end] - sums[begin]) * down[begin])
    of = np.searchsorted(stops, begin, "right")
    n_words = np.bincount(of, minlength=len(raw))
    first = np.cumsum(n_words) - n_words
    width = np.minimum(n_words, SHINGLE)
    n_shingles = np.where(n_words > 0, n_words - width + 1, 0)
    text = np.repeat(np.arange(len(raw)), n_shingles)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    h = np.full(len(text), 0x51ED270B, _U)
    last = max(0, len(word) - 1)
    for k in range(SHINGLE):
        h = np.where(k < width[text], _mix(h * _U(0x2545F4914F6CDD1D) + word[np.minimum(at + k, last)]) if len(word) else h, h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    where = np.flatnonzero(new)
    return text[where], h[where], np.diff(np.append(where, len(h)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(raw: list[bytes], registers: int = REGISTERS) -> np.ndarray:
    """float32 registers, a row for each text (infinite for a text without words)."""
    text, h, count = shingles(raw)
    best = np.full(len(raw) * registers, np.inf)
    # one item for each block of counts that a shingle reaches: levels low + 1 to 2 * low (0 to 1 first)
    items = []
    low, which = 0, np.arange(len(h))
    while len(which):
        items.append((text[which], _mix(h[which] + _U(low * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), np.full(len(which), low), count[which]))
        low = max(1, 2 * low)
        which = which[count[which] > low]
    if not items:
        return best.reshape(-1, registers).astype(np.float32)
    text, seed, low, count = (np.concatenate(c) for c in zip(*items, strict=True))
    weight = np.bincount(text, np.minimum(count, np.maximum(2 * low, 1)) - low, len(raw))
    need = 1.3 * registers * (np.log(registers) + 0.6) / np.maximum(weight, 1)
    ahead = (1 << np.ceil(np.log2(np.clip(need, 1, 2048))).astype(np.int64))[text]
    time, step = np.zeros(len(text)), np.zeros(len(text), np.int64)
    while len(text):
        for q in np.unique(ahead):
            group = np.flatnonzero(ahead == q)
            for lo in range(0, len(group), max(1, (1 << 18) // int(q))):
                g = group[lo : lo + max(1, (1 << 18) // int(q))]
                k = step[g, None] + np.arange(q)
                r = _mix(seed[g, None] + (k.astype(_U) + _U(1)) * _U(0xA0761D6478BD642F))
                size = np.maximum(low[g], 1)[:, None]
                t = np.concatenate([time[g, None], -np.log(_uniform(r)) / size], axis=1).cumsum(axis=1)[:, 1:]
                r = _mix(r + _U(0xE7037ED1A0B428DB))
                level = low[g, None] + 1 + ((r >> _U(40)).astype(np.int64) * size >> 24)
                where = text[g, None] * registers + ((r & _U(0xFFFFFFFF)) * _U(registers) >> _U(32)).astype(np.int64)
                kept = level <= count[g, None]
                np.minimum.at(best, where[kept], t[kept])
                time[g], step[g] = t[:, -1], k[:, -1] + 1
        still = time < best.reshape(-1, registers).max(axis=1)[text]
        text, seed, low, count, time, step = text[still], seed[still], low[still], count[still], time[still], step[still]
        ahead = np.maximum(1, ahead[still] // 2)
    return best.reshape(-1, registers).astype(np.float32)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint32).astype(_U).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), bits.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * _U(0x2545F4914F6CDD1D) + bits[:, :, r])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """A byte of each register: enough to estimate a similarity before texts are fetched."""
    return (_mix(np.ascontiguousarray(signature).view(np.uint32).astype(_U) + _U(1)) >> _U(56)).astype(np.uint8)


def alike(sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of a to each of b; bytes agree by chance once in 256."""
    out = np.empty((len(sketch_a), len(sketch_b)))
    for i, row in enumerate(sketch_a):
        out[i] = (sketch_b == row).sum(axis=1)
    return (out / sketch_a.shape[1] - 1 / 256) / (1 - 1 / 256)


def shingle_bag(raw: bytes) -> Counter:
    words = raw.split()
    return Counter(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))) if words else Counter()


def multiset_similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two texts' shingles, from the words themselves."""
    x, y = shingle_bag(a), shingle_bag(b)
    both = sum(min(n, y[k]) for k, n in x.items() if k in y)
    all_ = sum(x.values()) + sum(y.values()) - both
    return both / all_ if all_ else 1.0


def _alike_pairs(xs: list[bytes], ys: list[bytes], similar: float) -> np.ndarray:
    """Whether the weighted Jaccard similarity of the shingles of each x and its y reaches `similar`; each different text is cut once."""
    number: dict[bytes, int] = {}
    pairs = [(number.setdefault(x, len(number)), number.setdefault(y, len(number))) for x, y in zip(xs, ys, strict=True)]
    text, h, count = shingles(list(number))
    edge = np.searchsorted(text, np.arange(len(number) + 1)).tolist()
    weight = np.bincount(text, count, len(number))
    out = np.zeros(len(pairs), bool)
    for i, (x, y) in enumerate(pairs):
        own, other = h[edge[x] : edge[x + 1]], h[edge[y] : edge[y + 1]]
        if len(own) and len(other):
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            both = np.where(own[at] == other, np.minimum(count[edge[x] : edge[x + 1]][at], count[edge[y] : edge[y + 1]]), 0).sum()
            out[i] = both / (weight[x] + weight[y] - both) >= similar
        else:
            out[i] = len(own) == len(other)
    return out


def _node(words: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _signed(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                signed = signatures(raw)
                keys, sketch = band_keys(signed), sketches(signed)
                words = [r.split() for r in raw]
                nodes = [_node(w) for w in words]
                bands = [k if w else k[:0] for k, w in zip(keys, words, strict=True)]
                weight = [len(w) if len(w) < SHINGLE else len(w) - SHINGLE + 1 for w in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array(weight, pa.int64())],
                    ["doc_id", "node", "bands", "sketch", "weight"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>, sketch binary, weight long")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), once for each of nodes(node, least): the text of a row with that doc_id and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([_node((t or "").encode("utf-8", "surrogatepass").split()) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield batch.filter(kept)

    found = docs.select("doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("least")))
    return found.select("node", "text").mapInArrow(tidy(run), "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) after links(a, b) join components."""
    one, two = (labels.select(F.col("node").alias(n), F.col("label").alias(m)) for n, m in (("a", "la"), ("b", "lb")))
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    higher = components(between, "dedup-components").select(F.col("node").alias("old"), F.col("label").alias("new"))
    moved = labels.join(higher, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    added = higher.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
    return written(moved.unionByName(added), "dedup-components")


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of the pairs(of, to, salt) whose texts are alike.

    `to` may stand in very many pairs: its text is laid out once for each of its salts, so its pairs are
    spread over as many tasks. `of` stands in a pair for each of its buckets at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([t.encode("utf-8", "surrogatepass") for t in batch.column(i).to_pylist()] for i in (2, 3))
            for lo, hi in cuts([len(p) + len(q) for p, q in zip(x, y, strict=True)], 512, 2 * SLICE):
                part = batch.slice(lo, hi - lo).filter(pa.array(_alike_pairs(x[lo:hi], y[lo:hi], similar)))
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"])

    own = texts.select(F.col("node").alias("of"), F.col("text").alias("x"))
    hubs = pairs.select("to", "salt").distinct().join(texts.select(F.col("node").alias("to"), F.col("text").alias("y")), "to")
    return pairs.join(own, "of").join(hubs, ["to", "salt"]).select("of", "to", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _block_groups(members: DataFrame, key: str, size: int, columns: list[str]) -> DataFrame:
    """members(key, node, n, ...) dealt into groups (key, i, j): the blocks of a key's members against
    themselves and each other, `size` members a block. `side` tells the two blocks of a group apart."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", (F.col("own") > F.col("other")).cast("int").alias("side"), *columns)
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")


def _by_group(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that work finds in each group of rows with the same (key, i, j), which stand together."""
    held = None

    def found(t: pa.Table) -> pa.RecordBatch:
        names = np.stack([t.column(c).to_numpy() for c in (key, "i", "j")])
        edges = np.flatnonzero(np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(axis=0), [True]])).tolist()
        parts = [work(t.slice(lo, hi - lo)) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi - lo > 1]
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + [p[k] for p in parts])) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = np.logical_and.reduce([held.column(c).to_numpy() == held.column(c)[-1].as_py() for c in (key, "i", "j")])
            if cut := int(last.argmax()):  # the last group may go on in the next batch
                yield found(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None:
        yield found(held)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric adjacency."""
    new, out = np.ones(len(near), bool), []
    for root in np.flatnonzero(near.any(axis=1)).tolist():
        if new[root]:
            new[root] = False
            front = [root]
            while front:
                reach = near[front] & new
                found = np.flatnonzero(reach.any(axis=0))
                out += [(front[k], y) for y, k in zip(found.tolist(), reach[:, found].argmax(axis=0).tolist(), strict=True)]
                new[found] = False
                front = found.tolist()
    return out


def _likely(members: DataFrame, similar: float, errors: float | None) -> DataFrame:
    """Links (a, b) that span what may be alike: nodes of one bucket in members(bucket, node, n, label, sketch,
    weight) with different labels, whose weights and sketches allow the similarity. Fewer links than members a group."""
    least = -1.0 if errors is None else similar - errors * (similar * (1 - similar) / REGISTERS) ** 0.5

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, label, side, weight = (t.column(c).to_numpy() for c in ("node", "label", "side", "weight"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        names, size = np.unique(label, return_counts=True)
        near = np.zeros((len(node), len(node)), bool)
        for i in np.flatnonzero(label != names[size.argmax()]).tolist():  # the largest component is not compared with itself
            good = (label != label[i]) & (np.minimum(weight, weight[i]) >= similar * np.maximum(weight, weight[i]))
            if side.any():  # two blocks
                good &= side != side[i]
            other = np.flatnonzero(good)
            if len(other):
                near[i, other[alike(sketch[i : i + 1], sketch[other])[0] >= least]] = True
        edges = np.array(_forest(near | near.T), np.int64).reshape(-1, 2)
        return node[edges[:, 0]], node[edges[:, 1]]

    dealt = _block_groups(members, "bucket", BLOCK, ["label", "sketch", "weight"])
    return dealt.mapInArrow(tidy(lambda batches: _by_group(batches, "bucket", work)), "a long, b long").distinct()


def _exact(members: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between different labels of members(cluster, node, n, label, text), every pair of a cluster
    compared by its whole multisets of shingles; only links that join something new in their group are kept."""

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, label, side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
        raw = [(text or "").encode("utf-8", "surrogatepass") for text in t.column("text").to_pylist()]
        parts = []
        for lo, hi in cuts(list(map(len, raw))):
            of, h, count = shingles(raw[lo:hi])
            parts.append((of + lo, h, count))
        of, h, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        seen, flat = np.unique(h, return_inverse=True)
        size = np.bincount(of, minlength=len(raw))
        begin = np.cumsum(size) - size
        weight = np.bincount(of, count, len(raw)).astype(np.int64)
        group = np.unique(label, return_inverse=True)[1]
        own = np.zeros(len(seen), np.int64)
        out = []
        for x in range(len(node) - 1):
            other = np.flatnonzero((group[x + 1 :] != group[x]) & (np.minimum(weight[x + 1 :], weight[x]) >= similar * np.maximum(weight[x + 1 :], weight[x]))) + x + 1
            if side.any():
                other = other[side[other] != side[x]]
            if not len(other) or not size[x]:
                continue
            mine = slice(begin[x], begin[x] + size[x])
            own[flat[mine]] = count[mine]
            where = np.repeat(begin[other] - np.cumsum(size[other]) + size[other], size[other]) + np.arange(size[other].sum())
            both = np.add.reduceat(np.minimum(own[flat[where]], count[where]), np.cumsum(size[other]) - size[other])
            own[flat[mine]] = 0
            for y in other[both / (weight[x] + weight[other] - both) >= similar].tolist():
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    out.append((node[x], node[y]))
        edges = np.array(out, np.int64).reshape(-1, 2)
        return edges[:, 0], edges[:, 1]

    dealt = _block_groups(members, "cluster", TEXT_BLOCK, ["label", "text"])
    return dealt.mapInArrow(tidy(lambda batches: _by_group(batches, "cluster", work)), "a long, b long")


def near_classes(docs: DataFrame, similar: float = SIMILAR, errors: float | None = ERRORS) -> DataFrame:
    """(doc_id, node, group, class_id) for every row of docs(doc_id, text): class_id is the least doc_id of
    all texts that chains of links reach, which are a group; a link joins texts with a shingle similarity of `similar` or more.

    Texts of equal words are one node. A bucket's nodes are first compared with its most central node (the one whose
    buckets hold the most nodes): large groups of near copies join by one comparison a member and bucket.
    Then, in the buckets that still hold several components, every pair of nodes of different components is
    looked at by weight and sketch, in blocks; what likely pairs connect is a cluster, and all pairs of a
    cluster are compared by their texts, in blocks. No step makes a row for each pair. `errors` is how many standard errors
    below the threshold a sketch may estimate a pair that is still compared by texts; None compares whatever shares a band.

    Null and empty texts are one node without links to others; null doc_ids join classes but do not name
    them, unless there is no other. Texts below five words are alike only if equal. A long text is signed whole, by
    the counts of its shingles. A doc_id may be of any type that has an order. An empty table gives an empty result. Other columns are ignored."""
    signed = written(_signed(docs), "dedup-signed")
    distinct = written(signed.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("bands", "sketch", "weight")]), "dedup-nodes")
    members = distinct.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(shared, "bucket"), "dedup-members")
    texts = written(_texts_of(docs, members.select("node").distinct().join(distinct.select("node", "least"), "node")), "dedup-texts")
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    members = written(members.join(central, "node"), "dedup-members")
    lead = members.groupBy("bucket").agg(F.max_by("node", F.struct("central", "node")).alias("to"))
    pairs = members.join(lead, "bucket").where("node <> to").groupBy(F.col("node").alias("of"), "to").agg(F.max("n").alias("n"))
    tried = written(pairs.select("of", "to", F.pmod(F.xxhash64("of"), F.ceil(F.col("n") / SALTED)).alias("salt")), "dedup-pairs")
    labels = components(written(_verified(tried, texts, similar), "dedup-links"), "dedup-components")
    now = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("bucket", "n")
    now = now.join(mixed, "bucket").join(distinct.select("node", "sketch", "weight"), "node")
    likely = components(_likely(now, similar, errors), "dedup-likely").select("node", F.col("label").alias("cluster"))
    size = likely.groupBy("cluster").agg(F.count("*").alias("n"))
    held = likely.join(size, "cluster").join(labels, "node", "left").select("cluster", "node", "n", F.coalesce("label", "node").alias("label")).join(texts, "node")
    links = written(_exact(held, similar), "dedup-links")
    if not links.isEmpty():
        labels = _merged(labels, links)
    nodes = distinct.select("node", F.col("node").alias("group"), F.col("least").alias("class_id"))
    named = distinct.join(labels, "node").groupBy("label").agg(F.min("least").alias("least"))
    classes = written(labels.join(named, "label").select("node", "label", F.col("least").alias("named")), "dedup-classes")
    nodes = nodes.join(classes, "node", "left").select("node", F.coalesce("label", "group").alias("group"), F.coalesce("named", "class_id").alias("class_id"))
    return signed.select("doc_id", "node").join(written(nodes, "dedup-named"), "node").select("doc_id", "node", "group", "class_id")


def representatives(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs, all columns, that stand for their groups: one each, that of the least doc_id.

    Among rows of that doc_id the least node goes first; of rows that repeat in both, one stays. A doc_id that
    one row has tells that row; where several have it (or none, if null), their words are looked at again."""
    rows = written(near_classes(docs, similar), "dedup-rows")
    chosen = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col("node").alias("of"))).alias("c")).select("c.doc", "c.of")
    times = rows.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("times"))
    chosen = written(chosen.join(times, F.col("doc").eqNullSafe(F.col("id"))).select("doc", "of", (F.col("times") == 1).alias("alone")), "dedup-chosen")
    alone, shared = chosen.where("alone").select("doc"), chosen.where("not alone").select("doc", "of")
    if shared.count() <= FEW:
        shared = F.broadcast(shared)
    first = docs.join(alone, docs["doc_id"].eqNullSafe(alone["doc"]), "left_semi")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    found = held.join(shared, F.col("doc_id").eqNullSafe(F.col("doc"))).select("row", "text", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_node((t or "").encode("utf-8", "surrogatepass").split()) == n for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

    one = found.mapInArrow(tidy(run), found.schema).groupBy("of", F.col("row.doc_id").alias("doc")).agg(F.first("row").alias("row"))
    return first.unionByName(one.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
