"""SentencePiece ids by a score-ordered agenda.

A text is written with a mark for each blank and one in front. Its symbols are code points at first; an agenda holds the
adjacent pairs whose joined string the vocabulary has, best score first, then the leftmost. The best pair is joined, its new
neighbours enter the agenda, and pairs whose symbols have changed since are passed over when they come up.
What the vocabulary has not is spelled in bytes.

No piece has a mark behind another character, or letters beside anything else but a mark before them (this is looked up in the vocabulary),
so nothing is ever joined across the bounds of a word: each different word goes through an agenda of its own, and a bounded memo keeps its
ids. Every word that is new to the memo is checked against the library, a batch of words in one call.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, ship, slices, tidy

MARK = "▁"
_LETTER = r"[^\W\d_²³¹¼½¾]"
#: A word begins at its marks; it is letters, or what stands between letters. Without letters told apart, all up to the next mark.
_WORD = re.compile(f"{MARK}*(?:{_LETTER}+|(?:(?!{_LETTER})[^{MARK}])+)|{MARK}+")
_UPTO_MARK = re.compile(f"{MARK}+[^{MARK}]*")
_BOUND = re.compile(f"(?<=[^{MARK}]){MARK}")
#: Words above this length are cut wherever no piece spans two neighbours, before they have an agenda.
LONG = 64
#: A character that no piece of such a vocabulary holds (checked), so that nothing joins it.
BREAK = "\x00"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_loaded: dict[tuple[str, int], Pieces] = {}


class Pieces:
    """A merge-type vocabulary with byte fallback and plain text rules; others are refused, for their rules are not these.

    limit: code points of the words in the memo before it starts anew."""

    def __init__(self, path: str, limit: int = 12_000_000):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.lib, self.limit = SentencePieceProcessor(model_file=path), limit
        model = sentencepiece_model_pb2.ModelProto.FromString(self.lib.serialized_model_proto())
        rules, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap and not model.denormalizer_spec.precompiled_charsmap
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or not plain or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or any(p.type == _NORMAL and BREAK in p.piece for p in model.pieces):
            raise ValueError("not a merge-type vocabulary with byte fallback and plain text rules")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == _NORMAL]
        self.known = {p.piece: i for i, p in normal}
        scores = sorted({p.score for _, p in normal}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        #: a piece's place by score, and its length, in one number: places of the agenda are such numbers
        self.rank = {p.piece: place[p.score] << 8 | len(p.piece) for _, p in normal if len(p.piece) < 256}
        self.first_byte = kinds.index(_BYTE)
        self.surface = [p.piece if t == _NORMAL else model.trainer_spec.unk_surface if t == _UNKNOWN else "" for p, t in zip(model.pieces, kinds, strict=True)]
        self.bytes = {i: i - self.first_byte for i, t in enumerate(kinds) if t == _BYTE}
        #: neighbours that occur within a piece; between all others nothing is ever joined
        self.pairs = {p[k : k + 2] for p in self.known for k in range(len(p) - 1)}
        letter = re.compile(_LETTER).match
        self.cuts_at_words = not any(pair[1] == MARK != pair[0] for pair in self.pairs)
        apart = not any(bool(letter(a)) != bool(letter(b)) and a != MARK for a, b in self.pairs)
        self.words = (_WORD if apart else _UPTO_MARK).findall
        #: what the library makes of a break alone: words that begin without a mark are checked behind one
        self.broken = tuple(self.lib.encode(BREAK))
        self._reset()

    def _reset(self) -> None:
        #: ids of what stands between blanks, with the mark before it; and of words in any other place
        self.parts: dict[str, tuple[int, ...]] = {"": self.word(MARK)}
        self.others: dict[str, tuple[int, ...]] = {MARK: self.word(MARK)}
        self.wrong: set[str] = set()
        self.held = 0

    def _merged(self, symbols: list[str]) -> list[str]:
        """The symbols that are left when no adjacent pair can be joined any more."""
        rank, n = self.rank.get, len(symbols)
        after, before, bits = list(range(1, n + 1)), list(range(-1, n - 1)), n.bit_length()
        # an entry is score, left end and length of the pair's string, so the least entry is the best, then the leftmost
        agenda = [(r >> 8 << bits | k) << 8 | r & 255 for k in range(n - 1) if (r := rank(symbols[k] + symbols[k + 1]))]
        heapify(agenda)
        mask = (1 << bits) - 1
        while agenda:
            entry = heappop(agenda)
            left = entry >> 8 & mask
            right = after[left]
            one = symbols[left]
            if not one or right >= n or len(one) + len(symbols[right]) != entry & 255:
                continue  # one of its symbols has gone, or has grown since
            one = symbols[left] = one + symbols[right]
            symbols[right] = ""
            further, nearer = after[right], before[left]
            after[left] = further
            if further < n:
                before[further] = left
                if r := rank(one + symbols[further]):
                    heappush(agenda, (r >> 8 << bits | left) << 8 | r & 255)
            if nearer >= 0 and (r := rank(symbols[nearer] + one)):
                heappush(agenda, (r >> 8 << bits | nearer) << 8 | r & 255)
        return [s for s in symbols if s]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a string with its marks; a long one by agendas over the stretches that pieces can span."""
        parts = [word]
        if len(word) > LONG:
            cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.pairs), len(word)]
            parts = [word[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        ids: list[int] = []
        for part in parts:
            for s in self._merged(list(part)) if len(part) > 1 else part:
                if (i := self.known.get(s)) is not None:
                    ids.append(i)
                else:
                    ids += [self.first_byte + b for b in s.encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def _known(self, word: str) -> tuple[int, ...] | None:
        return self.parts.get(word[1:]) if word[0] == MARK and word[1:2] != MARK else self.others.get(word)

    def _learn(self, words: list[str]) -> None:
        """Words that the memo has not, each checked by the library; a difference is noted, and the library's ids count.

        The library puts a mark before what it encodes; a word without one is checked behind a break, which nothing joins."""
        spelled = [w[1:].replace(MARK, " ") if w[0] == MARK else BREAK + w.replace(MARK, " ") for w in words]
        for w, theirs in zip(words, self.lib.encode(spelled, num_threads=1), strict=True):
            ids = self.word(w)
            theirs = tuple(theirs) if w[0] == MARK else tuple(theirs[len(self.broken) :])
            if ids != theirs:
                ids = theirs
                self.wrong.add(w)
            if w[0] == MARK and w[1:2] != MARK:
                self.parts[w[1:]] = ids
            else:
                self.others[w] = ids
            self.held += len(w)

    def _ids(self, words: list[str]) -> tuple[list[tuple[int, ...]], bool]:
        """Ids of each word, and whether agenda and library agreed on all."""
        if new := {w for w in words if self._known(w) is None}:
            self._learn(list(new))
        return [self._known(w) for w in words], not self.wrong or self.wrong.isdisjoint(words)

    def _stretches(self, text: str) -> Iterator[tuple[list[tuple[int, ...]], bool]]:
        """The ids of a text's words, a bounded stretch of it at a time."""
        if self.cuts_at_words and MARK not in text and "  " not in text and text[0] != " ":
            begin = 0
            while begin <= len(text):  # one blank between parts: each stands in the memo with its mark
                if self.held > self.limit:
                    self._reset()
                end = text.find(" ", begin + SLICE)
                end = len(text) if end < 0 else end
                parts = text[begin:end].split(" ")
                found, good = list(map(self.parts.get, parts)), True
                if None in found:
                    gc.disable()  # its passes over the growing memo cost more than they free
                    new = {x: self.words(MARK + x) for x, ids in zip(parts, found, strict=True) if ids is None}
                    good = self._ids([w for words in new.values() for w in words])[1]
                    for x, words in new.items():
                        if len(words) > 1:
                            self.parts[x] = tuple(chain.from_iterable(map(self._known, words)))
                            self.held += len(x)
                    found = list(map(self.parts.__getitem__, parts))
                    gc.enable()
                yield found, good and (not self.wrong or self.wrong.isdisjoint(w for x in parts for w in self.words(MARK + x)))
                begin = end + 1
            return
        marked = MARK + text.replace(" ", MARK)
        begin = 0
        while begin < len(marked):
            if self.held > self.limit:
                self._reset()
            bound = _BOUND.search(marked, begin + SLICE) if self.cuts_at_words else None
            end = bound.start() if bound else len(marked)
            yield self._ids(self.words(marked, begin, end) if self.cuts_at_words else [marked])
            begin = end

    def encode(self, text: str) -> tuple[array, bool]:
        """All ids of a text, and whether agenda and library agreed on each word."""
        out, agreed = array("i"), True
        for ids, good in self._stretches(text) if text else ():
            out.extend(chain.from_iterable(ids))
            agreed = agreed and good
        return out, agreed

    def decode(self, ids: array | list[int]) -> str:
        """The text of ids: surfaces one after another, runs of byte pieces as UTF-8, without the mark in front."""
        if self.bytes.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.bytes:
                    run.append(self.bytes[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(self.surface[i])
            text = "".join(parts) + run.decode("utf-8", "replace")
        return text.removeprefix(MARK).replace(MARK, " ")


def pieces(path: str, limit: int = 12_000_000) -> Pieces:
    """One for each worker process, kept between tasks."""
    if (path, limit) not in _loaded:
        _loaded[path, limit] = Pieces(path, limit)
    return _loaded[path, limit]


def encode(docs: DataFrame, model: str, whole: bool = False) -> DataFrame:
    """doc_id, ids, decoded, agrees for every row of docs(doc_id, text): the ids of the whole text, the text that the library decodes them
    to, and whether it agrees with the ids. Words are checked when they are new to the memo; `whole` has every whole text encoded
    by the library too, and the ids decoded by Pieces. Where it does not agree, its result is given and agrees is false.

    Null and empty texts have no ids and decode to an empty text. Rows that repeat, null doc_ids, an empty table and other columns
    (ignored) need no care: each row is by itself and nothing is shuffled. A long text is cut into words a stretch at a time;
    a word without an end is held whole, like its text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for part in (s for batch in batches for s in slices(batch, 1)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, good = (list(x) for x in zip(*map(p.encode, texts), strict=True))
            if whole:
                for k, theirs in enumerate(p.lib.encode(texts, num_threads=1)):
                    if list(ids[k]) != theirs:
                        ids[k], good[k] = array("i", theirs), False
            decoded = [p.lib.decode(x.tolist()) for x in ids]
            if whole:
                good = [g and p.decode(x) == d for g, x, d in zip(good, ids, decoded, strict=True)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(x, np.int32) for x in ids])))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string()), pa.array(good, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(tidy(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string, agrees boolean")


def digests(docs: DataFrame, model: str) -> DataFrame:
    spelled = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
