import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from skylattice.llm import packing, token_store  # noqa: E402
from skylattice.llm.chunk_encoder import ChunkEncoder  # noqa: E402

ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "\n\nfoo  \n bar", "a\t b c", "É́ á", "it's we're 'S", "<|endoftext|> x<|endoftext|>y", "hello <|endoftext|> world", "<|StartOfText|>a <|endoftext|", "a<| b|>", "ΑΣ ΣΑΣ", "\n", "1 23x", "İx İ.", "ªb²c", "a\x85b", "日本語 x"]


@pytest.mark.parametrize("name,blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_memo_equals_library(name, blanks):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("İ²\xa0ab '\n.1é\t!s") for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["word " * 3000]
    e = ChunkEncoder(P.path(name), blanks, limit=50)
    fresh = Tokenizer.from_file(P.path(name))
    want = [np.array(x.ids, np.uint32) for x in fresh.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        flat, counts = e.encode(texts)
        assert counts.tolist() == [len(w) for w in want]
        assert (flat == np.concatenate(want)).all()


def test_unknown_rules_go_through_the_library(tmp_path):
    """A file whose pretokenizer or normaliser differs is never cut by the rules of another."""
    import json

    said = json.load(open(P.path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {}):
        (tmp_path / "t.json").write_text(json.dumps(said | change))
        e = ChunkEncoder(str(tmp_path / "t.json"), True)
        assert e.proven == (not change)
        texts = ["The Cat sat", "two  blanks", "x"]
        assert (e.encode(texts)[0] == np.concatenate(e._direct(texts))).all()
    assert not ChunkEncoder(P.path("word_bpe_49k.json"), True).proven and not ChunkEncoder(P.path("byte_bpe_50k.json"), False).proven


def test_codes_random_access():
    rng = np.random.default_rng(2)
    for n, top in ((0, 2), (1, 2), (9, 300), (5000, 50_000), (3000, 1 << 32)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        c = token_store.Codes(token_store.pack(ids))
        assert len(c) == n and (c.span(0, n) == ids).all()
        for i in rng.integers(0, max(n, 1), 30) if n else []:
            assert c[int(i)] == ids[i]
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (c.span(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        c[3000]


ROWS = [(5, "the cat", 1), (1, None, 2), (3, "", 3), (7, "a b c " * 2000, 4), (3, "twice", 5), (None, "no id", 6), (5, "the cat", 7)]


def _docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, start long")


def test_store_digest(spark):
    got = token_store.store_digest(_docs(spark).repartition(3), P.path("word_bpe_49k.json")).collect()
    lib = ChunkEncoder(P.path("word_bpe_49k.json"), False)
    start = 0
    want = []
    for d, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(lib._direct([t or ""])[0], np.uint32(1))
        want.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_store.store_digest(_docs(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_assign_covers_and_balances():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.choice([1, 5, 300, 1023, 1024, 1025, 5000]) for _ in range(rng.randint(0, 60))]
        pieces = packing.assign(lengths)
        by_item, by_seq = {}, {}
        for item, at, n, seq, offset in pieces:
            by_item.setdefault(item, []).append((at, n))
            by_seq.setdefault(seq, []).append((offset, n))
        for item, n in enumerate(lengths):
            at = 0
            for a, m in sorted(by_item[item]):
                assert a == at
                at += m
            assert at == n
        for parts in by_seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        assert len(by_seq) * 1024 - sum(lengths) < 1024


def test_assign_takes_the_cheapest_sequence_with_room():
    """Against a plain scan of all open sequences."""
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.choice([1, 7, 40, 90, 300, 512, 700, 1000]) for _ in range(rng.randint(1, 50))]
        n_open = -(-sum(lengths) // 1024)
        room, cost, want, late = [1024] * n_open, [0.0] * n_open, {}, []
        for n, item in sorted((-n, i) for i, n in enumerate(lengths)):
            n = -n
            fit = [s for s in range(n_open) if room[s] >= n]
            if not fit:
                late.append(item)
                continue
            s = min(fit, key=lambda s: (cost[s], s))
            want[item] = (s, 1024 - room[s])
            room[s], cost[s] = room[s] - n, cost[s] + packing.LINEAR * n + packing.QUADRATIC * n * n
        got = {}
        for item, at, n, seq, offset in packing.assign(lengths):
            got.setdefault(item, []).append((seq, offset))
        assert {i: got[i][0] for i in want} == want and all(len(got[i]) == 1 for i in want)
        for item in late:
            assert len(got[item]) >= 1


def test_pack(spark):
    got = packing.pack(_docs(spark).repartition(2), P.path("byte_bpe_50k.json")).collect()
    lib = ChunkEncoder(P.path("byte_bpe_50k.json"), True)
    assert sum(r.length for r in got) == sum(len(lib._direct([t or ""])[0]) + 1 for _, t, _ in ROWS)
    ids = np.append(lib._direct([ROWS[3][1]])[0], np.uint32(0))
    for r in got:
        if r.doc_id == 7:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
    assert packing.pack(_docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0
