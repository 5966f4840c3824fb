"""Problem 7: the whole corpus as ids of a public byte-level BPE vocabulary.

Pre-tokenisation works on codepoint classes: an associative scan over transition functions finds
the state before each codepoint, from which slice boundaries follow; no regex is run.  The slices
are dictionary-encoded per block, and only slices not met before by the worker go through pair
merging.  There is no shuffle: one narrow pass over the table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import BLANK, LETTER, NUMBER, OTHER, SPACE, Block, blocks, classes, scan

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Slices a worker keeps; beyond it the cache starts anew (ids do not depend on it).
CACHE = 1_000_000

_BEGIN, _LETTERS, _NUMBERS, _OTHERS, _SPACED, _BLANKS, _ONE_MORE, _TWO_MORE, _CLIPPED = range(9)
_NONE = 1 << 40  # no such pair
_SHORT, _LONG = 5, 6  # an apostrophe before s t m d, or before re ve ll


def _automaton() -> np.ndarray:
    """transitions[symbol, state]; symbols 7-13 are symbols 0-6 at the start of a text."""
    to = np.zeros((14, 9), np.uint8)
    to[LETTER] = _LETTERS
    to[LETTER, [_ONE_MORE, _TWO_MORE]] = _CLIPPED, _ONE_MORE
    to[NUMBER], to[OTHER], to[SPACE], to[BLANK] = _NUMBERS, _OTHERS, _SPACED, _BLANKS
    for symbol, state in ((_SHORT, _ONE_MORE), (_LONG, _TWO_MORE)):
        to[symbol] = state
        to[symbol, [_OTHERS, _SPACED]] = _OTHERS  # within a run, an apostrophe is like any sign
    for symbol in range(7):
        to[7 + symbol] = to[symbol, _BEGIN]
    return to


_TO = _automaton()
#: Same run of the same kind, by state before and class: no boundary.
_RUNS_ON = np.zeros((9, 7), bool)
_RUNS_ON[_LETTERS, LETTER] = _RUNS_ON[_NUMBERS, NUMBER] = True
_RUNS_ON[_OTHERS, [OTHER, _SHORT, _LONG]] = True
_RUNS_ON[_SPACED, [LETTER, NUMBER, OTHER, _SHORT, _LONG]] = True  # a single space belongs to what follows
_RUNS_ON[[_ONE_MORE, _TWO_MORE], LETTER] = True
_RUNS_ON[np.ix_([_SPACED, _BLANKS], [SPACE, BLANK])] = True


def boundaries(block: Block) -> np.ndarray:
    """Positions of codepoints at which a slice begins."""
    cps = block.cps
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind, opens = classes(cps), block.opens()
    symbol = kind.copy()
    marks = np.flatnonzero(cps[:-1] == 0x27)
    marks = marks[~opens[marks + 1]]
    if len(marks):
        one = cps[marks + 1]
        two = np.where(marks + 2 < n, cps[np.minimum(marks + 2, n - 1)], 0)
        two[(marks + 2 < n) & opens[np.minimum(marks + 2, n - 1)]] = 0
        symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _SHORT
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        symbol[marks[np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])]] = _LONG
    after = scan(symbol + 7 * opens.astype(np.uint8), _TO)
    before = np.empty_like(after)
    before[0], before[1:] = _BEGIN, after[:-1]
    start = ~_RUNS_ON[before, symbol] | opens
    white = (kind == SPACE) | (kind == BLANK)
    nearing = np.zeros(n, bool)
    nearing[:-1] = ~white[1:] & ~opens[1:]
    return np.flatnonzero(start | white & nearing)  # the last of several blanks stands for itself


class Merger:
    """Pair merging by rank, with a cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[str, list[int]] = {}
        self.size = max(self.ranks.values()) + 1
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (left id, right id) of all pairs that join to an entry, and the entry of each."""
        if self.table is None:
            ranks, found = self.ranks, {}
            for piece, i in ranks.items():
                for cut in range(1, len(piece)):
                    left = ranks.get(piece[:cut])
                    if left is not None and (right := ranks.get(piece[cut:])) is not None:
                        found[left * self.size + right] = i
            keys = np.fromiter(found, np.int64, len(found))
            order = np.argsort(keys)
            self.table = keys[order], np.fromiter(found.values(), np.int64, len(found))[order]
        return self.table

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, values = self._pairs()
        asked = left * self.size + right
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where((keys[at] == asked) & (left >= 0) & (right >= 0), values[at], _NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Pair merging of many pieces of at most ``width`` bytes side by side, one merge of each a round."""
        parts = np.full((len(pieces), width + 1), -1, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(len(pieces)), lengths)
        parts[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = self.bytes[flat]
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        active = np.arange(len(pieces))
        spread = np.arange(width + 1)
        while len(active):
            own = ranks[active]
            at = own.argmin(1)
            best = own[np.arange(len(active)), at]
            more = best < _NONE
            active, at, best = active[more], at[more], best[more]
            if not len(active):
                break
            shift = np.minimum(spread + (spread > at[:, None]), width)
            p = np.take_along_axis(parts[active], shift, 1)
            p[:, -1] = -1
            each = np.arange(len(active))
            p[each, at] = best
            parts[active] = p
            r = np.take_along_axis(ranks[active], np.minimum(spread[:-1] + (spread[:-1] > at[:, None]), width - 1), 1)
            r[:, -1] = _NONE
            r[each, at] = self._rank(best, p[each, at + 1])
            left = at > 0
            r[each[left], at[left] - 1] = self._rank(p[each[left], at[left] - 1], best[left])
            ranks[active] = r
        return [ids[:n] for ids, n in zip(parts.tolist(), (parts >= 0).sum(1).tolist())]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over linked parts: a slice may be a whole text of one letter."""
        import heapq

        n, ranks = len(piece), self.ranks
        end, prev, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def ids(self, slices: list[str]) -> list[list[int]]:
        cache, ranks = self.cache, self.ranks
        if len(cache) > CACHE:
            cache.clear()
        new: dict[int, list[bytes]] = {}
        for s in slices:
            if s not in cache:
                piece = s.encode()
                if (i := ranks.get(piece)) is not None:
                    cache[s] = [i]
                else:
                    new.setdefault(min(-(-len(piece) // 8), 5), []).append(piece)
        for eights, pieces in new.items():
            found = self.merge_many(pieces, 8 * eights) if eights < 5 else map(self.merge_long, pieces)
            cache.update(zip((p.decode() for p in pieces), found))
        return [cache[s] for s in slices]


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode_block(block: Block, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the place in them where each text begins, and the first byte of each id in its text."""
    starts = boundaries(block)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(block.n + 1, np.int64), np.zeros(0, np.int32)
    coded = block.slices(starts).dictionary_encode()
    of, m = coded.indices.to_numpy(), merger(vocabulary)
    lists = m.ids(coded.dictionary.to_pylist())
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum()))
    begins = np.cumsum(lengths) - lengths
    each = lengths[of]
    total = np.cumsum(each)
    place = np.repeat(begins[of] - (total - each), each) + np.arange(total[-1])
    ids = flat[place]
    size = np.append(0, total)
    per_text = size[np.searchsorted(starts, block.first)]
    return ids, per_text, place


def _widths(vocabulary: str) -> np.ndarray:
    ranks = merger(vocabulary).ranks
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        out[i] = len(piece)
    return out


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row; with ``offsets`` also the first byte of each id.

    Null and empty texts give an empty list.  Every row gives a row: repeated rows repeat, a null
    key stays null, other columns (whatever their names) are left out.  Strings of special tokens
    are ordinary text.  Any text length; an empty table gives an empty table.
    """
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)
    kept = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = kept.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for at, to, block in blocks(batch.column(1)):
                ids, ends, _ = encode_block(block, vocabulary)
                cols = [keys.slice(at, to - at), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    ends_at = np.cumsum(widths()[ids]) if len(ids) else np.zeros(0, np.int64)
                    begin = np.append(0, ends_at)[:-1] if len(ids) else ends_at
                    text_start = np.repeat(block.bytes_at[block.first[:-1]], np.diff(ends))
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(begin - text_start, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["k", "ids", "offsets"][: len(cols)])

    cache: list[np.ndarray] = []

    def widths() -> np.ndarray:
        if not cache:
            cache.append(_widths(vocabulary))
        return cache[0]

    out = kept.mapInArrow(run, f"k {kind}, ids array<int>" + ", offsets array<int>" * offsets)
    return out.withColumnRenamed("k", key)


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    m = merger(vocabulary)
    if not hasattr(m, "pieces"):
        m.pieces = {i: p for p, i in m.ranks.items()}
    return b"".join(m.pieces[i] for i in ids).decode("utf-8", "replace")
