"""Problem 8: passages of evaluation items inside a corpus.

Spaced seeds: fixed masks of up to twelve word positions of which some are ignored.  The hashes of all
item windows are joined with the hashes of all corpus windows; since no mask is longer than twelve
words, no run of twelve equal ones is missed, and wherever one or two other words stand among twelve
equal ones, a window of some mask avoids them.  Around each hit the item is laid over the text and overlaps are measured, with and without substitutions.

The item side is broadcast in blocks of a checked size; the corpus is read once a block and is
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import Block, block_of, blocks, word_slices

#: Masks over consecutive words; "0" marks a position that is ignored.  None is longer than LEAST, and for
#: any SUBSTITUTIONS positions in LEAST + SUBSTITUTIONS words one fits between (tests enumerate them).
MASKS = ("110110110111", "111011011011", "101101101111", "111010111", "10011001111")
LEAST = 12
#: Other words that an overlap with substitutions may hold.
SUBSTITUTIONS = 2
#: Item words in a broadcast block (each gives a hash of 8 bytes a mask).
BLOCK_WORDS = 500_000
_BITS = 22

_FACTORS = np.random.default_rng(8).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_hashes: dict[str, int] = {}


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each word, its 64-bit hash (lower-cased), and the first word of each text."""
    starts, coded = word_slices(block)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), np.zeros(block.n + 1, np.int64)
    if len(_hashes) > 1_000_000:
        _hashes.clear()
    unique = []
    for w in coded.dictionary.to_pylist():
        if (h := _hashes.get(w)) is None:
            h = _hashes[w] = xxhash.xxh3_64_intdigest(w.lower())
        unique.append(h)
    first = np.searchsorted(starts, block.first)
    return np.repeat(np.arange(block.n), np.diff(first)), np.array(unique, np.uint64)[coded.indices.to_numpy()], first


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window, without the ignored positions."""
    n = len(hashes) - len(mask) + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask if n > 0 else ""):
            if bit == "1":
                out += hashes[i : i + n] * _FACTORS[i]
        return (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def overlaps(equal: np.ndarray, allowed: int) -> tuple[int, int]:
    """Longest run of equal words, and most equal words of a stretch with at most ``allowed`` others."""
    gaps = np.concatenate([[-1], np.flatnonzero(~equal), [len(equal)]])
    run = int(np.diff(gaps).max()) - 1
    k = min(allowed + 1, len(gaps) - 1)
    return run, int((gaps[k:] - gaps[:-k]).max()) - 1 - (k - 1)


class _Items:
    """One block of items as sorted window hashes of each mask, with a bit table before the search."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...]):
        self.keys = [k for k, _ in items]
        block = block_of(pa.array([t for _, t in items], pa.string()))
        _, self.words, self.first = words(block)
        self.lookup = []
        for mask in masks:
            none = np.zeros(0, np.int64)
            h, item, at = [none.view(np.uint64)], [none], [none]
            for i in range(len(items)):
                s = seeds(self.words[self.first[i] : self.first[i + 1]], mask)
                h.append(s), item.append(np.full(len(s), i)), at.append(np.arange(len(s)))
            h, item, at = (np.concatenate(x) for x in (h, item, at))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.lookup.append((mask, h[order], item[order], at[order], bits))


def find(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", least: int = LEAST, masks: tuple[str, ...] = MASKS, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """key, item key, run, overlap: for each text and item that meet, the longest run of equal words
    and the most equal words in a stretch with at most ``substitutions`` other words.

    Rows are all those with ``overlap >= least``, for MASKS as long as ``substitutions`` is not over
    SUBSTITUTIONS; ``run >= least`` says that the run is verbatim.  Null
    texts and null keys leak nothing, items under ``least`` words are not searched, repeated rows count once.  The
    items go to the executors in blocks of BLOCK_WORDS words, one pass over the corpus each.
    """
    if any(len(m) > least for m in masks):
        raise ValueError("a mask is longer than the run that must be found")
    names = [F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")]
    held = items.select(*names).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    docs = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    kinds = [docs.schema["k"].dataType.simpleString(), held.schema["i"].dataType.simpleString()]
    out = None
    for block in _blocks_of(held):
        part = _search(docs, block, kinds, least, masks, substitutions)
        out = part if out is None else out.unionAll(part)
    return out.groupBy("k", "i").agg(F.max("run").alias("run"), F.max("overlap").alias("overlap")).withColumnsRenamed({"k": key, "i": item_key})


def _blocks_of(held: DataFrame) -> Iterator[list[tuple]]:
    """Blocks of items by their summed length: the driver holds one at a time."""
    block, size, any_ = [], 0, False
    for i, t in held.toLocalIterator():
        n = len(t) // 2 + 1  # no more words than that
        if size + n > BLOCK_WORDS and block:
            any_ = True
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    if block or not any_:
        yield block


def _search(docs: DataFrame, items: list[tuple], kinds: list[str], least: int, masks: tuple[str, ...], substitutions: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Items(shared.value, masks)
        for batch in batches:
            rows = []
            for at, _, block in blocks(batch.column(1)):
                of, hashes, first = words(block)
                hits = []
                for mask, known, item, place, bits in held.lookup:
                    s = seeds(hashes, mask)
                    maybe = np.flatnonzero(bits[s >> np.uint64(64 - _BITS)])
                    lo, hi = np.searchsorted(known, s[maybe], "left"), np.searchsorted(known, s[maybe], "right")
                    n = hi - lo
                    pos = np.repeat(maybe, n)
                    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    inside = of[pos] == of[pos + len(mask) - 1] if len(pos) else np.zeros(0, bool)
                    hits.append(np.stack([of[pos], item[entry], pos - place[entry]])[:, inside])
                for d, i, shift in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist():
                    own = held.words[held.first[i] : held.first[i + 1]]
                    lo, hi = max(first[d], shift), min(first[d + 1], shift + len(own))
                    best, near = overlaps(hashes[lo:hi] == own[lo - shift : hi - shift], substitutions)
                    if near >= least:
                        rows.append((at + d, i, best, near))
            doc, item, best, near = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([held.keys[i] for i in item], key_type[0]), pa.array(best, pa.int64()), pa.array(near, pa.int64())],
                names=["k", "i", "run", "overlap"],
            )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    key_type = [to_arrow_type(_parse_datatype_string(kinds[1]))]
    return docs.mapInArrow(run, f"k {kinds[0]}, i {kinds[1]}, run bigint, overlap bigint")
