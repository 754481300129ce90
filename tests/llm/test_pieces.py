import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from skylattice.llm import pieces  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  ", "a  b   c", "▁", "▁▁ a▁b", "\n", "a\nb\n\n c", "\t\t", "日本語 テキスト", "🦆 é ÿ", "\x00x\x7f", "<s></s><unk><0x41>", "x" * 5000, "aaaa " * 300, "Ünïcödé “quotes”—dash…", "İıſß", "العربية हिन्दी", "(((" * 40, "1234567890" * 30, "﻿bom ​zero", "é combining"]


def test_odd_texts_equal_the_library():
    p = pieces.Pieces(MODEL, limit=200)
    for _ in range(2):
        for text in ODD:
            ids, good = p.encode(text)
            assert good and list(ids) == p.lib.encode(text), text
            assert p.decode(ids) == p.lib.decode(list(ids)), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab t▁ he\nin.é🦆", max_size=200))
def test_any_text_equals_the_library(text):
    p = pieces.pieces(MODEL)
    ids, good = p.encode(text)
    assert good and list(ids) == p.lib.encode(text) and p.decode(ids) == p.lib.decode(list(ids))


def test_long_texts_are_cut_at_words(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 50)
    rng, p = random.Random(3), pieces.Pieces(MODEL)
    for k in range(100):
        text = "".join(rng.choice(["the", " ", "  ", "quick", "\n", "é", "▁"] if k % 2 else ["the ", "of, ", "²., ", "a.b ", "\n"]) for _ in range(200))
        assert list(p.encode(text)[0]) == p.lib.encode(text)


def test_other_vocabularies_are_cut_less(tmp_path):
    """Pieces over letters and signs, or with a mark inside, are found: words are cut where that vocabulary allows."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    for more in (["a.", "a.b"], ["a▁b", "a▁"]):
        model = pb.ModelProto.FromString(open(MODEL, "rb").read())
        for k, piece in enumerate(more):
            model.pieces.add(piece=piece, score=5.0 + k, type=1)
        (tmp_path / "m.model").write_bytes(model.SerializeToString())
        p = pieces.Pieces(str(tmp_path / "m.model"))
        for text in ["a.b ca.b a b", "a a. b", "xa  b.a.b" * 40, *ODD]:
            assert p.encode(text)[1] and list(p.encode(text)[0]) == p.lib.encode(text), text


def test_difference_is_told_and_the_library_counts():
    p = pieces.Pieces(MODEL)
    real = p.word
    p.word = lambda w: (0,) if w == "▁cat" else real(w)
    ids, good = p.encode("the cat sat")
    assert not good and list(ids) == p.lib.encode("the cat sat")
    assert p.encode("the dog sat")[1] and not p.encode("a cat")[1]


def test_rows(spark):
    texts = [*ODD, None, "the same", "the same"]
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, 5, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids int, agrees string")
    lib = pieces.pieces(MODEL).lib
    for whole in (False, True):
        got = pieces.encode(docs.repartition(3), MODEL, whole).collect()
        assert all(r.agrees for r in got)
        want = [(None if k == 3 else k // 2, lib.encode(t or ""), lib.decode(lib.encode(t or ""))) for k, t in enumerate(texts)]
        assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=str) == sorted(want, key=str)
    digest = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, MODEL).collect()}
    assert digest == {(d, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t in want}
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_whole_table_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert pieces.encode(docs, MODEL, whole=True).where("not agrees").count() == 0


def test_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(open(MODEL, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "m.model"))
