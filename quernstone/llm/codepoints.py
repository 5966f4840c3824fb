"""Arrow string batches as flat codepoint arrays, and the scans that cut them into slices.

All texts of a block are laid end to end; a text's first codepoint carries a reset, so that no
rule looks across texts.  Everything here is vectorised: no regex, no loop over characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are laid out at once.  A longer single text forms a block of its own.
BLOCK_BYTES = 3_000_000

LETTER, NUMBER, SPACE, BLANK, OTHER = range(5)
_UNKNOWN = 255
#: The White_Space property (fixed values of the Unicode standard).
_WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_table = np.full(0x110000, _UNKNOWN, np.uint8)
_table[list(_WHITE)] = BLANK
_table[0x20] = SPACE


def classes(cps: np.ndarray) -> np.ndarray:
    """The class of each codepoint; the table is filled as codepoints are first met."""
    out = _table[cps]
    if (out == _UNKNOWN).any():
        for cp in np.unique(cps[out == _UNKNOWN]).tolist():
            major = unicodedata.category(chr(cp))[0]
            _table[cp] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
        out = _table[cps]
    return out


@dataclass
class Block:
    """Texts laid end to end: ``first`` and ``bytes_at`` have one entry more than texts and codepoints."""

    data: np.ndarray  # UTF-8
    cps: np.ndarray  # uint32
    first: np.ndarray  # first codepoint of each text
    bytes_at: np.ndarray  # first byte of each codepoint

    @property
    def n(self) -> int:
        return len(self.first) - 1

    def opens(self) -> np.ndarray:
        """True at the first codepoint of each text that has any."""
        flags = np.zeros(len(self.cps) + 1, bool)
        flags[self.first[:-1]] = True
        return flags[:-1]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text in which each codepoint position lies."""
        return np.searchsorted(self.first, at, side="right") - 1

    def slices(self, starts: np.ndarray) -> pa.Array:
        """The slices between the given codepoint positions (and the end), without a copy of the text."""
        offsets = np.append(self.bytes_at[starts], self.bytes_at[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(self.data))


def block_of(texts: pa.Array) -> Block:
    """Null texts count as empty."""
    texts = texts.cast(pa.string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    starts = (data & 0xC0) != 0x80
    if int(starts.sum()) != len(cps):  # bytes that are no UTF-8 were replaced
        parts = [t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
        return block_of(pa.array(parts, pa.string()))
    bytes_at = np.append(np.flatnonzero(starts), len(data))
    return Block(data, cps, np.searchsorted(bytes_at, offsets), bytes_at)


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, last row + 1, block) over all rows, each block of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield at, to, block_of(texts.slice(at, to - at))
        at = to


def scan(symbols: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The state after each symbol: an associative scan over composed transition functions.

    ``transitions[symbol, state]`` is an automaton; functions that arise are numbered as met and
    composed through a table, doubling the reach until every function is constant.  An automaton
    of bounded memory is done after a few doublings, whatever the length.
    """
    n_states = transitions.shape[1]
    known: dict[tuple[int, ...], int] = {}
    functions: list[tuple[int, ...]] = []

    def number(f: tuple[int, ...]) -> int:
        if f not in known:
            known[f] = len(functions)
            functions.append(f)
        return known[f]

    first = np.array([number(tuple(t)) for t in transitions.tolist()], np.int16)
    reach, at = 1, first[symbols]
    while True:
        table = np.array(functions, np.uint8)
        constant = (table == table[:, :1]).all(1)
        used = np.unique(at[reach - 1 :])
        if constant[used].all() or reach > len(at):
            break
        m = len(functions)
        compose = np.array([[number(tuple(functions[f][s] for s in functions[g])) for g in range(m)] for f in range(m)], np.int16)
        later = at.copy()
        later[reach:] = compose[at[reach:], at[:-reach]]
        at, reach = later, 2 * reach
    assert n_states < 256
    return np.array(functions, np.uint8)[at, 0]  # all begin in state 0


def word_slices(block: Block) -> tuple[np.ndarray, pa.DictionaryArray]:
    """First codepoint of each word (longest run of letters and digits), and the words as written."""
    alnum = classes(block.cps) <= NUMBER
    before = np.empty_like(alnum)
    before[:1] = False
    before[1:] = alnum[:-1]
    opens = block.opens()
    starts = np.flatnonzero(alnum & (~before | opens))
    if not len(starts):
        return starts, pa.array([], pa.string()).dictionary_encode()
    after = np.append(~alnum[1:] | opens[1:], True)
    ends = np.flatnonzero(alnum & after) + 1
    cuts = np.empty(2 * len(starts), np.int64)  # word, what follows it, word, ...
    cuts[::2], cuts[1::2] = starts, ends
    both = block.slices(cuts)
    return starts, both.take(pa.array(np.arange(0, len(cuts), 2))).dictionary_encode()
