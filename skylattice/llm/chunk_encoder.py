"""Exact tokenizer ids at dictionary speed.

Both vocabularies cut a text into pretokens before they merge, and no pretoken
crosses from a visible character to a following blank. So a text is cut at its
blanks, each distinct piece is cut into pretokens, and each distinct pretoken
goes through the library's model once; bounded memos hold both. Texts with
characters beyond U+024F, odd blanks or special strings go through the library
as they are, for there the rules below aren't proven equal to its own.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import repeat

import numpy as np

#: Beyond the characters whose classes the patterns below know; blanks other than
#: the two that the cut is proven for; what may be a special token.
_DIRECT = re.compile(r"[^\x00-\u024f]|[^\S \n]|<\|")
_LETTER, _NUMBER, _OTHER = r"[^\W\d_²³¹¼½¾]", r"[\d²³¹¼½¾]", r"(?:[^\s\w]|_)"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pretokens of the two vocabularies (fixed by their files), for keep_blanks False and True.
_PRETOKEN = {
    False: re.compile(f"{_LETTER}+|{_SHORT}|{_NUMBER}|{_OTHER}+"),
    True: re.compile(rf" ?{_LETTER}+|{_SHORT}| ?{_NUMBER}+| ?{_OTHER}+|\s+(?!\S)|\s+"),
}
#: How the two kinds of vocabulary files normalise and cut (fixed values), for keep_blanks False and True; the rules here hold for them alone.
_RULES = {
    False: {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    },
    True: {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
}
_ENDS = frozenset(".,;:!?")
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _plain(text: str) -> bool:
    """Whether _DIRECT finds nothing; fast where Latin-1 holds the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _DIRECT.search(text)
    return "<|" not in text and not any(c in text for c in _ODD)


_loaded: dict[tuple[str, bool, int], ChunkEncoder] = {}


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself if visible, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_STAND_IN = _byte_chars()


class ChunkEncoder:
    """keep_blanks: the vocabulary has tokens for blanks (byte-level), so a piece
    keeps the blank before it. limit: pieces in the memo before both memos start anew.

    Special strings in a text are found as the library finds them. A file with other rules than _RULES, or a model that draws at random, goes through the library text by text."""

    def __init__(self, path: str, keep_blanks: bool, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.keep_blanks, self.limit = keep_blanks, limit
        said = json.loads(self.lib.to_str())
        marks = all("<|" in t["content"] for t in said["added_tokens"])  # texts that may hold one are not cut here
        self.proven = marks and all(said[k] == v for k, v in _RULES[keep_blanks].items()) and said["model"]["type"] == "BPE" and not said["model"]["dropout"] and not said["truncation"]
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretoken(self, piece: str) -> tuple[int, ...]:
        ids = self.known[piece] = tuple(self._tokenize(piece))
        return ids

    def _tokenize(self, piece: str) -> list[int]:
        if piece.isascii():  # a blank is all that is spelled otherwise in a word
            spelled = "\u0120" + piece[1:] if piece[0] == " " and piece[1:].isalpha() else piece if piece.isalnum() else piece.translate(_STAND_IN)
        else:
            spelled = piece.encode().decode("latin-1").translate(_STAND_IN)
        return [t.id for t in self.model.tokenize(spelled)]

    def _learn(self, keys: list[str]) -> None:
        gc.disable()  # its passes over the growing memo cost more than the learning
        cut, known, new, once = _PRETOKEN[self.keep_blanks].findall, self.known, self._pretoken, self._tokenize
        flat, sizes = [], []
        for k in keys:
            before = len(flat)
            # a key with a blank in front is the head of a text; see _pieces
            raw = (k[1:] if k[:1] == " " else " " + k) if self.keep_blanks else k.lower()
            bare = k if self.keep_blanks else raw
            if bare.isalpha():  # one pretoken, with the blank before it; the memo of pieces holds it
                flat += once(raw)
            elif bare[-1:] in _ENDS and bare[:-1].isalpha():
                flat += once(raw[:-1])
                flat += known.get(raw[-1]) or new(raw[-1])
            else:
                for piece in cut(raw):
                    flat += known.get(piece) or new(piece)
            sizes.append(len(flat) - before)
        at, end = len(self.slot), self.used + len(flat)
        while at + len(keys) > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, self.begin * 0]), np.concatenate([self.length, self.length * 0])
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        self.pool[self.used : end] = flat
        size = np.array(sizes, np.int64)
        self.begin[at : at + len(keys)] = self.used + np.cumsum(size) - size
        self.length[at : at + len(keys)] = size
        self.slot.update(zip(keys, range(at, at + len(keys)), strict=True))
        self.used = end
        gc.enable()

    def _pieces(self, text: str) -> list[str] | None:
        """Keys of a text's pieces; None if the cut isn't safe."""
        if not self.proven or not _plain(text) or self.keep_blanks and ("  " in text or "\n " in text):
            return None
        parts = text.split(" ")
        if self.keep_blanks:
            if parts[0]:
                parts[0] = " " + parts[0]
            else:  # the text starts with a blank, which goes with the next piece
                parts = parts[1:]
        return parts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's count."""
        if len(self.slot) > self.limit:
            self._reset()
        cut = [self._pieces(t) for t in texts]
        keys = [k for parts in cut if parts for k in parts]
        slots = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        if len(unknown := np.flatnonzero(slots < 0)):
            new = [keys[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(new)))
            slots[unknown] = np.fromiter(map(self.slot.__getitem__, new), np.int64, len(new))
        sizes = self.length[slots]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(self.begin[slots] - (ends - sizes), sizes) + np.arange(total)]
        n_parts = np.fromiter((len(p) if p else 0 for p in cut), np.int64, len(cut))
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_parts)])]
        counts = np.diff(edge)
        if any(p is None for p in cut):
            odd = [i for i, p in enumerate(cut) if p is None]
            each = np.split(flat, edge[1:-1])
            for i, ids in zip(odd, self._direct([texts[i] for i in odd]), strict=True):
                each[i], counts[i] = ids, len(ids)
            flat = np.concatenate(each) if each else flat
        return flat, counts


def chunk_encoder(path: str, keep_blanks: bool, limit: int = 1_000_000) -> ChunkEncoder:
    """One encoder for each worker process, kept between tasks."""
    key = (path, keep_blanks, limit)
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(path, keep_blanks, limit)
    return _loaded[key]
