"""Packing documents into training sequences, balanced by estimated cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunk_encoder import chunk_encoder
from .common import ship, slices, tidy

CAPACITY = 1024
END_ID = 0
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, the second for its attention.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Roomiest:
    """Open sequences by the tokens they still take; finds the cheapest that takes n.

    A tree of minima over the room left; each room keeps its sequences in a heap."""

    def __init__(self, capacity: int):
        import heapq

        self.push_, self.pop_ = heapq.heappush, heapq.heappop
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.width)]
        self.least: list = [(np.inf, -1)] * (2 * self.width)

    def _update(self, room: int) -> None:
        at, least = self.width + room, self.least
        least[at] = self.heaps[room][0] if self.heaps[room] else (np.inf, -1)
        at //= 2
        while at:
            least[at] = min(least[2 * at], least[2 * at + 1])
            at //= 2

    def add(self, room: int, cost: float, seq: int) -> None:
        if room > 0:
            self.push_(self.heaps[room], (cost, seq))
            self._update(room)

    def take(self, need: int) -> tuple[int, float, int] | None:
        """The cheapest open sequence with room for need tokens, removed; else None."""
        lo, hi, best = self.width + need, 2 * self.width, (np.inf, -1)
        while lo < hi:
            if lo & 1:
                best = min(best, self.least[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.least[hi])
            lo, hi = lo // 2, hi // 2
        if best[1] < 0:
            return None
        room = self.room_of[best[1]]
        self.pop_(self.heaps[room])
        self._update(room)
        return room, best[0], best[1]

    room_of: dict[int, int]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items of the given lengths.

    As many sequences as the tokens fill. Items are cut at the capacity; the ends left over go in
    descending length to the cheapest sequence with room for them. What fits in none is cut
    to fill the roomiest sequences, so less than one sequence of padding is left in all."""
    cost = lambda n: LINEAR * n + QUADRATIC * n * n
    out, seq, ends = [], 0, []
    for item, n in enumerate(lengths):
        for at in range(0, n - n % capacity, capacity):
            out.append((item, at, capacity, seq, 0))
            seq += 1
        if n % capacity:
            ends.append((n % capacity, item, n - n % capacity))
    ends.sort(key=lambda e: (-e[0], e[1]))
    open_ = _Roomiest(capacity)
    n_open = -(-sum(e[0] for e in ends) // capacity)
    open_.room_of = dict.fromkeys(range(seq, seq + n_open), capacity)
    if n_open:
        open_.heaps[capacity] = [(0.0, s) for s in range(seq, seq + n_open)]
        open_._update(capacity)

    def put(item: int, at: int, n: int, got: tuple[int, float, int]) -> None:
        room, spent, s = got
        out.append((item, at, n, s, capacity - room))
        open_.room_of[s] = room - n
        open_.add(room - n, spent + cost(n), s)

    late = []
    for n, item, at in ends:
        if (got := open_.take(n)) is None:
            late.append((n, item, at))
        else:
            put(item, at, n, got)
    for n, item, at in late:
        while n:
            if (got := open_.take(n)) is None:
                room = max(r for r, h in enumerate(open_.heaps) if h)
                got = open_.take(room)
            size = min(n, got[0])
            put(item, at, size, got)
            n, at = n - size, at + size
    return out


def pack(docs: DataFrame, tokenizer: str, keep_blanks: bool = True, capacity: int = CAPACITY, end_id: int = END_ID, group_tokens: int = 2_000_000, memo: int = 1_000_000) -> DataFrame:
    """A row for each piece of each row of docs(doc_id, text); see PIECES. A doc_id keeps its type.

    Each task packs what it scans, in groups of at least group_tokens (and the rest), so nothing is
    shuffled and a group's ids fit in memory; padding is below one sequence a group. The split of the input
    decides the groups: a task that is run again packs the same rows alike. Null text: empty (the end id alone).
    Null and repeated doc_ids keep their rows; a document that occurs twice is packed twice. Among documents of equal length the one scanned first goes first.
    Special strings in a text become the special ids that the library gives them. A long text is a group by itself, cut into sequences; an empty table gives none. `memo` is how many pieces of text a worker
    remembers the ids of: fewer take less memory and more time, and give the same ids."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = chunk_encoder(tokenizer, keep_blanks, memo), TaskContext.get().partitionId() << 32
        names, kind = [], None
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            lengths = [len(x) for x in held]
            pieces = assign(lengths, capacity)
            sums = [zlib.crc32(held[i][a : a + n].astype("<u4").tobytes()) for i, a, n, _, _ in pieces]
            item, start, length, local, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            all_ = pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in item], kind), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.array(lengths, np.int64)[item]), pa.array(seq + local), pa.array(offset),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            seq += int(local.max()) + 1
            names.clear(), held.clear()
            for lo in range(0, len(pieces), 50_000):
                yield all_[lo : lo + 50_000]

        size = 0
        for batch in batches:
            for part in slices(batch, 1):
                flat, counts = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(counts)
                kind = part.column(0).type
                names += part.column(0).to_pylist()
                held += [np.append(flat[a:b], np.uint32(end_id)) for a, b in zip(ends - counts, ends, strict=True)]
                size += len(flat) + len(counts)
                if size >= group_tokens:
                    yield from flush()
                    size = 0
        if names:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES.replace("long", docs.schema["doc_id"].dataType.simpleString(), 1))
