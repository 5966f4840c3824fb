"""Problem 9: long spans that stand verbatim in more than one text.

Chunks are content-defined.  A gear hash rolls over the codepoints; a position is a cut where its
hash is the least of some window of REACH positions, so cuts depend on nearby content alone and an
insertion elsewhere moves none.  Each cut opens a chunk that closes at the first cut at least
``least`` codepoints on.  With ``least = span - 2 * REACH - 30`` every common span of ``span``
codepoints holds a whole chunk that both texts cut alike: the least hash of the first and of the
last window inside the span are cuts in both, and so is every cut between them.  Chunks are then
deduplicated by digest, and an exact check of the span follows for texts that share a digest.

Equal texts form a class first, so a text delivered a million times is chunked into the shuffle
once a task and checked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .codepoints import Block, block_of, blocks

SPAN = 320
REACH = 64
_GEAR_BITS = 32  # a 32-bit gear hash forgets what is 32 codepoints back

_rng = np.random.default_rng(9)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _mixed(n: int, seed: int) -> np.ndarray:
    """splitmix64 of 0..n-1."""
    z = (np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_GEAR = (_mixed(0x110000, 1) >> np.uint64(32)).astype(np.uint32)
_LETTER = _mixed(0x110000, 7)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverse modulo 2 ** 64, for i up to n."""
    if not _powers or len(_powers[0]) < n + 1:
        inverse = pow(int(_ODD), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_ODD, np.uint64(inverse))]
    return _powers[0], _powers[1]


def gear(cps: np.ndarray) -> np.ndarray:
    """The gear hash at each position, over the 32 codepoints that end there, by doubling."""
    h, reach = _GEAR[cps], 1
    while reach < _GEAR_BITS:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = more, 2 * reach
    return h


def cuts(block: Block, reach: int = REACH) -> np.ndarray:
    """Positions whose gear hash is least in some window of ``reach`` positions within one text.

    Of equal hashes in a window the last counts.  Positions with less than 32 codepoints of their
    own text before them take part in no window.
    """
    n = len(block.cps)
    if n < reach:
        return np.zeros(0, np.int64)
    key = (gear(block.cps).astype(np.uint64) << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    low, have = key, 1
    while have < reach:  # the least of windows that begin at each position
        step = min(have, reach - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    begin = np.arange(len(low))
    of = np.repeat(np.arange(block.n), np.diff(block.first))[: len(low)]
    whole = (begin >= block.first[of] + _GEAR_BITS - 1) & (begin + reach <= block.first[of + 1])
    at = n - (low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


def digests(block: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of slices, from prefix sums of a polynomial."""
    up, down = _power(len(block.cps))
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(_LETTER[block.cps] * up[: len(block.cps)]))
        d = (sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        d = (d ^ (d >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (d ^ (d >> np.uint64(32))).view(np.int64)


def chunks(block: Block, span: int = SPAN, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first position in the block, length and digest of each chunk."""
    least = span - 2 * reach - _GEAR_BITS + 2
    if least < _GEAR_BITS:
        raise ValueError("the span is too short for this reach")
    at = cuts(block, reach)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    of = block.text_of(at)
    closing = np.searchsorted(at, at + least)
    ok = closing < len(at)
    ok[ok] = of[closing[ok]] == of[ok]
    at, of, end = at[ok], of[ok], at[closing[ok]]
    return of, at, end - at, digests(block, at, end)


def _ordered(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    return order, grams[order]


def common(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, span: int, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and in ``b`` at which a span of the other begins; ga and gb are their spans' digests.

    Each run of positions that follow each other in both is compared as written, so a digest that two
    different spans have costs that run alone: its positions are then compared one by one.
    """
    order, held = ordered or _ordered(gb)
    at = np.searchsorted(held, ga)
    hit = held[np.minimum(at, len(held) - 1)] == ga
    ia = np.flatnonzero(hit)
    if not len(ia):
        return ia, ia
    partner = order[at[hit]]  # the first of b's positions with the same digest
    marks = np.zeros(len(held) + 1, np.int64)
    np.add.at(marks, at[hit], 1)
    np.add.at(marks, np.searchsorted(held, ga[ia], side="right"), -1)
    ib = np.sort(order[np.cumsum(marks[:-1]) > 0])
    new = np.append(True, (np.diff(ia) != 1) | (np.diff(partner) != 1))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(ia))
    sound = np.ones(len(ia), bool)
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        n = hi - lo - 1 + span
        if not np.array_equal(a[ia[lo] : ia[lo] + n], b[partner[lo] : partner[lo] + n]):
            for k in range(lo, hi):
                others = np.flatnonzero(gb == ga[ia[k]])
                sound[k] = any(np.array_equal(a[ia[k] : ia[k] + span], b[j : j + span]) for j in others)
    if sound.all():
        return ia, ib
    ia = ia[sound]
    return ia, ib[np.isin(gb[ib], ga[ia])]


def _grams(text: str, span: int) -> tuple[np.ndarray, np.ndarray]:
    block = block_of(pa.array([text], pa.string()))
    at = np.arange(len(block.cps) - span + 1)
    return block.cps, digests(block, at, at + span)


def _intervals(at: np.ndarray, span: int) -> list[tuple[int, int]]:
    breaks = np.flatnonzero(np.diff(at) > span)
    return list(zip(at[np.append(0, breaks + 1)].tolist(), (at[np.append(breaks, len(at) - 1)] + span).tolist()))


#: Classes of texts whose ids may be broadcast (8 bytes each); with more, texts and ids meet in a shuffle.
BROADCAST_CLASSES = 1_000_000
#: Texts that share a chunk and are compared by pairs; of more, spans are.  Larger groups of spans are salted in pieces of this size.
GROUP = 500


def _pairs_of(groups: DataFrame) -> DataFrame:
    """h_a < h_b of each group (of, h, n); a large group is cut into pieces of one side."""
    pieces = F.ceil(F.col("n") / GROUP).cast("int")
    a = groups.select("of", F.col("h").alias("h_a"), F.pmod(F.xxhash64("h"), pieces).cast("int").alias("piece"))
    b = groups.select("of", F.col("h").alias("h_b"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    return a.join(b, ["of", "piece"]).where("h_a < h_b").select("h_a", "h_b").distinct()


class Shared:
    """The steps of the search, each a DataFrame; texts stand for themselves through a 64-bit hash ``h``.

    Null texts and keys and texts under ``span`` codepoints share nothing.  Repeated rows count
    once.  Only the two named columns are read, so others may have any name.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, reach: int = REACH):
        self.key, self.span, self.reach = key, span, reach
        k, t = F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")
        self.texts = df.select(k.alias("k"), F.xxhash64(t).alias("h"), t.alias("t")).where(k.isNotNull() & (F.char_length(t) >= span))
        self._pairs: DataFrame | None = None

    def chunks(self) -> DataFrame:
        """digest, h: once for each chunk and text of a task."""
        span, reach = self.span, self.reach

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done: set[int] = set()
            for batch in batches:
                h = batch.column(0).to_numpy()
                new = np.zeros(len(h), bool)
                for i, x in enumerate(h.tolist()):
                    if x not in done:
                        done.add(x)
                        new[i] = True
                rows = np.flatnonzero(new)
                for at, _, block in blocks(batch.column(1).take(pa.array(rows))):
                    of, _, _, digest = chunks(block, span, reach)
                    pairs = np.unique(np.stack([of, digest]), axis=1) if len(of) and _repeats(of, digest) else np.stack([of, digest])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[1], pa.int64()), pa.array(h[rows[at + pairs[0]]], pa.int64())], names=["digest", "h"])

        return self.texts.select("h", "t").mapInArrow(run, "digest bigint, h bigint")

    def shared_chunks(self) -> DataFrame:
        """digest, h, n: the chunks that stand in more than one text, n texts each."""
        from pyspark.sql import Window

        w = Window.partitionBy("digest")
        found = self.chunks().select("digest", "h", F.min("h").over(w).alias("lo"), F.max("h").over(w).alias("hi"), F.count("*").over(w).alias("n"))
        return found.where("lo < hi").select("digest", "h", "n")

    def candidates(self) -> DataFrame:
        """h_a < h_b: texts with a chunk in common, or with a span if more than GROUP texts have the chunk.

        A chunk is shorter than a span, so many texts may share one and no span: of a chunk that more than
        GROUP texts have, the spans around it are compared by digest instead of the texts by pairs.
        """
        shared = cut(self.shared_chunks())
        few = _pairs_of(shared.where(F.col("n") <= GROUP).withColumnRenamed("digest", "of"))
        many = shared.where(F.col("n") > GROUP)
        if not many.limit(1).count():
            return few
        return few.unionAll(_pairs_of(self._same_spans(many.select("h", "digest")))).distinct()

    def _same_spans(self, many: DataFrame) -> DataFrame:
        """of, h, n: groups of texts with a span in common that holds one of the given chunks; each set of texts once."""
        span, reach = self.span, self.reach

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted = [np.array(w, np.int64) for w in batch.column(2).to_pylist()]
                for at, _, block in blocks(batch.column(1)):
                    of, start, length, digest = chunks(block, span, reach)
                    keep = np.zeros(len(of), bool)
                    first = np.searchsorted(of, np.arange(block.n + 1))  # chunks come text by text
                    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                        keep[lo:hi] = np.isin(digest[lo:hi], wanted[at + i])
                    of, start, length = of[keep], start[keep], length[keep]
                    first = np.maximum(start + length - span, block.first[of])  # spans that hold the chunk begin here
                    n = np.maximum(np.minimum(start, block.first[of + 1] - span) - first + 1, 0)
                    begin = np.unique(np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()))
                    spans = np.unique(np.stack([block.text_of(begin), digests(block, begin, begin + span)]), axis=1) if len(begin) else np.zeros((2, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(spans[1], pa.int64()), batch.column(0).take(pa.array(at + spans[0]))], names=["of", "h"])

        own = many.groupBy("h").agg(F.collect_set("digest").alias("wanted"))  # as many as the text has chunks
        texts = self.texts.select("h", "t").join(own, "h").groupBy("h").agg(F.first("t").alias("t"), F.first("wanted").alias("wanted"))
        spans = cut(texts.mapInArrow(run, "of bigint, h bigint"))
        # spans beside each other mostly stand in the same texts: one of each set of texts is enough
        sets = spans.groupBy("of").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("h", F.lit(1)), 32)).alias("y")).where("n > 1")
        one = sets.groupBy("n", "x", "y").agg(F.min("of").alias("of")).select("of", "n")
        return spans.join(one, "of")

    def classes(self) -> DataFrame:
        """<key>, h: the class (equal text) of each row that takes part; with ``links`` all pairs in short."""
        return self.texts.select(F.col("k").alias(self.key), "h").distinct()

    def links(self) -> DataFrame:
        """h_a < h_b: classes whose texts have a span in common; copies of one text need no pairs among them."""
        return self.verified().select("h_a", "h_b").distinct()

    def verified(self) -> DataFrame:
        """h_a, h_b, of_a, start, end: the stretches of either text that lie in common spans."""
        if self._pairs is None:
            self._pairs = cut(self._verified())
        return self._pairs

    def _verified(self) -> DataFrame:
        span = self.span
        pairs = cut(self.candidates())
        ids = pairs.select(F.explode(F.array("h_a", "h_b")).alias("h")).distinct()
        if pairs.count() <= BROADCAST_CLASSES // 2:  # so at most that many ids
            ids = F.broadcast(ids)
        texts = self.texts.select("h", "t").join(ids, "h", "left_semi")
        one = texts.groupBy("h").agg(F.first("t").alias("t"))
        both = pairs.join(one.select(F.col("h").alias("h_a"), F.col("t").alias("a")), "h_a").join(one.select(F.col("h").alias("h_b"), F.col("t").alias("b")), "h_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                rows = []
                for ha, hb, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                    if len(kept) > 256:
                        kept.clear()
                    for h, t in ((ha, a), (hb, b)):
                        if h not in kept:
                            cps, grams = _grams(t, span)
                            kept[h] = cps, grams, _ordered(grams)
                    (ca, ga, _), (cb, gb, ordered) = kept[ha], kept[hb]
                    ia, ib = common(ca, cb, ga, gb, span, ordered)
                    if len(ia):
                        rows += [(ha, hb, of_a, *x) for of_a, at in ((True, ia), (False, ib)) for x in _intervals(at, span)]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["h_a", "h_b", "of_a", "start", "end"])

        return both.select("h_a", "h_b", "a", "b").mapInArrow(run, "h_a bigint, h_b bigint, of_a boolean, start bigint, end bigint")

    def pairs(self) -> DataFrame:
        """<key>_a < <key>_b: rows whose texts have a span in common, equal texts among them."""
        members = self.texts.select("k", "h").distinct()
        classes = self.links()
        a, b = members.select(F.col("k").alias("ka"), F.col("h").alias("h_a")), members.select(F.col("k").alias("kb"), F.col("h").alias("h_b"))
        unlike = classes.join(a, "h_a").join(b, "h_b").select(F.least("ka", "kb").alias("x"), F.greatest("ka", "kb").alias("y")).where("x < y")
        alike = a.join(b, F.expr("h_a = h_b AND ka < kb")).select("ka", "kb")
        out = unlike.unionAll(alike).distinct()
        return out.toDF(f"{self.key}_a", f"{self.key}_b")

    def report(self) -> DataFrame:
        """<key>, n_chars, shared_chars, share: how much of each text lies in spans that others have too."""
        from pyspark.sql import Window

        own = self.verified().select(F.expr("if(of_a, h_a, h_b)").alias("h"), "start", "end").distinct()
        w = Window.partitionBy("h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        covered = own.withColumn("to", F.coalesce(F.max("end").over(w), F.lit(0))).groupBy("h").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "to"))).alias("part"))
        rows = self.texts.select("k", "h", F.char_length("t").cast("bigint").alias("n_chars")).distinct()
        copies = rows.groupBy("h").agg(F.count_distinct("k").alias("copies"))
        out = rows.join(copies, "h").join(covered, "h", "left")
        shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.col("part"))
        out = out.withColumn("shared_chars", shared).where("shared_chars > 0")
        return out.select(F.col("k").alias(self.key), "n_chars", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("share"))


def _repeats(of: np.ndarray, digest: np.ndarray) -> bool:
    return len(np.unique(digest)) < len(digest)
