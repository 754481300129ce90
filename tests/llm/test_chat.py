import hashlib

from skylattice.llm import chat

TEXTS = ["hi", "", None, "</s>[INST] ok [/INST]", "a\\l<|x|>\nb", "<", "tail\\", "<|user|>\n", "long " * 2000, "é" * 700]


def _rows():
    rows = []
    for conv in range(12):
        rows.append((conv, 0, "system", f"rules {conv} <s>", 1))
        for i in range(conv * 3):
            rows.append((conv, i + 1, ["user", "assistant", None, "to|ol\n"][i % 4], TEXTS[(conv + i) % len(TEXTS)], 1))
    return [*rows, (None, 0, "assistant", "no id", 1), (3, 1, "user", TEXTS[3], 1), (3, 1, "user", TEXTS[3], 1)]


def test_escapes_round_trip():
    for t in TEXTS:
        if t is not None:
            e = chat.escape(t)
            assert chat.unescape(e) == t and "</s>" not in e and "[INST]" not in e and "<|" not in e
            assert chat.unescape(chat.escape_role(t)) == t


def test_digest(spark):
    rows = _rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(turns.repartition(3))).collect()}
    by = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == by.keys()
    for c, said in by.items():
        learned = "".join(x for r, x in said if r == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
        assert got[c].loss_chars == len(learned) and got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "assistant" if i % 2 == 0 else "user", "word " * 40) for i in range(1, 40)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=300, history=120).collect()
    assert len(windows) > 3
    for w in windows:
        said = chat.parse(w.text)
        assert chat.estimated_tokens(w.text) <= 320 and said[0][:2] == ("system", "be brief") and len(said) == w.n_turns
        assert w.window == 0 or w.repeated > 1
    assert sum(w.n_turns - w.repeated for w in windows) == len(rows)


def test_tokens_are_counted_by_the_library(spark):
    """Windows of written files keep a budget of real tokens; turns are counted piece by piece."""
    import pytest

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from skylattice.llm.common import written

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    turns = spark.createDataFrame(_rows(), "conv_id long, turn long, role string, text string, window int")
    windows = written(chat.format_windows(turns, P.path("byte_bpe_50k.json"), budget=200, history=60).repartition(5), "test-windows")
    for w in windows.collect():
        parts = [(chat.OPEN + chat.escape_role(r) + chat.CLOSE, chat.escape(t)) for r, t, _, _ in chat.parse(w.text)]
        total = sum(count(h) + count(t) + count(chat.END) for h, t in parts)
        assert total <= 200 or w.n_turns - w.repeated == 1 and w.repeated <= 1
    again = sorted(map(tuple, chat.read_back(windows).collect()), key=str)
    assert [r[:5] for r in again] == [r[:5] for r in sorted(map(tuple, chat.read_back(chat.format_windows(turns)).collect()), key=str)]


def test_probe_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(empty)).count() == 0
    (r,) = chat.read_back(chat.format_windows(chat.with_probe(empty))).collect()
    assert r.conv_id == -1 and r.n_turns == 2 and r.loss_chars == len(chat.PROBE)


def test_history_makes_room_for_a_new_turn(spark):
    """Only a turn that does not fit with the system turn passes the budget, and it has no history."""
    rows = [(1, 0, "system", "be brief")] + [(1, i, "assistant" if i % 2 == 0 else "user", "word " * (20, 220, 60, 400)[i % 4]) for i in range(1, 30)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=300, history=120).collect()
    over = [w for w in windows if chat.estimated_tokens(w.text) > 300]
    assert over and all(w.repeated == 1 and w.n_turns == 2 and len(w.text) > 2000 for w in over)
    assert sum(w.n_turns - w.repeated for w in windows) == len(rows)
