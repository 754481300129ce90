import random
from collections import Counter

import numpy as np

from skylattice.llm import near_dedup as nd
from skylattice.llm.components import components


def _edit(words, n, rng, pool):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(pool)
    return words


def test_signatures_are_unbiased():
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(3000)]
    base = [rng.choice(pool) for _ in range(300)]
    for other in (_edit(base, 3, rng, pool), _edit(base, 20, rng, pool), base + base[:100], (base[:20] * 9) + base):
        a, b = " ".join(base).encode(), " ".join(other).encode()
        s = nd.signatures([a, b], registers=2400)
        assert abs((s[0] == s[1]).mean() - nd.multiset_similarity(a, b)) < 0.05
    alone, batch = nd.signatures([b"x y"]), nd.signatures([a, b"x y", b""])
    assert (alone[0] == batch[1]).all() and np.isinf(batch[2]).all()


def _classes(rows):
    raw = [(t or "").encode() for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if raw[i].split() == raw[j].split() or (raw[i].split() and raw[j].split() and nd.multiset_similarity(raw[i], raw[j]) >= 0.8):
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, least.get(top(i))) for i, (d, _) in enumerate(rows))


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one", "one", "one two", "a b c d", "a  b\nc d"]
    shared = [rng.choice(pool) for _ in range(30)]
    for _ in range(8):
        base = [rng.choice(pool) for _ in range(rng.choice([8, 60, 200]))]
        texts += [" ".join(_edit(base, k, rng, pool)) for k in (0, 0, 1, 2, 4, 9)]
    texts += [" ".join([rng.choice(pool) for _ in range(25)] + shared) for _ in range(20)]
    hub = [rng.choice(pool) for _ in range(150)]
    texts += [" ".join(_edit(hub, 2, rng, pool)) for _ in range(25)]
    texts += ["long " * 30_000, "long " * 30_001]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "one"), (3, texts[10]), (3, "another text with the same number")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bucket int, label string")
    got = nd.near_classes(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == _classes(rows)
    kept = nd.representatives(docs).collect()
    assert nd.representatives(docs).columns == docs.columns
    assert len(kept) == len({r.group for r in got})


def test_blocks_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    base = [rng.choice(pool) for _ in range(120)]
    texts = [" ".join(_edit(base, 3, rng, pool)) for _ in range(60)]
    monkeypatch.setattr(nd, "BLOCK", 7)
    monkeypatch.setattr(nd, "TEXT_BLOCK", 5)
    rows = list(enumerate(texts))
    got = nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == _classes(rows)


def test_nothing_alike_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in nd.near_classes(docs).collect()} == {(1, 1), (2, 2)}
    assert nd.near_classes(docs.where("false")).count() == 0
    assert nd.representatives(docs).count() == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and got[9] == got[7] == 3


def test_classes_of_a_whole_table(spark):
    """The classes of all documents of sf0.01 against all pairs, with and without the estimate before texts are compared."""
    from skylattice.llm.common import read

    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    raw = [(t or "").encode() for _, t in rows]
    bags, weight = [nd.shingle_bag(r) for r in raw], [len(r.split()) for r in raw]
    holders = {}
    for i, bag in enumerate(bags):
        for k in bag:
            holders.setdefault(k, []).append(i)
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = 0
    for i, bag in enumerate(bags):
        shared = Counter()
        for k, n in bag.items():
            for j in holders[k]:
                if j < i:
                    shared[j] += min(n, bags[j][k])
        for j, both in shared.items():
            if both / (sum(bag.values()) + sum(bags[j].values()) - both) >= nd.SIMILAR:
                pairs += 1
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    want = Counter((d, least[top(i)]) for i, (d, _) in enumerate(rows))
    assert pairs > 50
    for errors in (nd.ERRORS, None):
        assert Counter((r.doc_id, r.class_id) for r in nd.near_classes(docs, errors=errors).collect()) == want


def test_pairs_by_hashes_equal_pairs_by_words():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(40)]
    texts = ["", "a", "a b", "a b c d e"] + [" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(20)]
    texts += [" ".join(_edit(t.split() or ["x"], 1, rng, pool)) for t in texts]
    xs, ys = [x.encode() for x in texts for _ in texts], [y.encode() for _ in texts for y in texts]
    for similar in (0.8, 0.5):
        assert nd._alike_pairs(xs, ys, similar).tolist() == [nd.multiset_similarity(x, y) >= similar for x, y in zip(xs, ys, strict=True)]


def test_one_bucket_of_very_many(spark):
    """20,000 near copies of one text: no text stands in more than a bounded number of compared pairs, and all are one class."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = nd.near_classes(docs)
    assert got.select("class_id").distinct().count() == 1
