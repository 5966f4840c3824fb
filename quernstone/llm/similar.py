"""Problem 6: texts whose word shingles overlap, found without comparing all pairs.

Texts of one shingle set form a class.  Each set is put in one global order, rare shingles first
(by a count sketch of a fixed size over all rows), and only the prefix that any similar set must
meet is indexed.  An index list is kept sorted by set size and position and cut into blocks; a pair
of blocks is skipped whole if sizes or positions rule out the overlap, and the same holds for pairs
inside, where parities of the sets bound their difference too.  Overlaps are then counted on the sets themselves; where two sets that differ little meet
the same third one, the second count is derived from the first by the shingles that differ.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import cut
from .codepoints import blocks
from .leaks import words

#: Defaults for near-duplicates; the query of the problem states its own.
SHINGLE, THRESHOLD, LEAST_WORDS = 5, 0.8, 0
#: Counters of the sketch by which shingles are ordered, and marks that tell shingles of one row alone from
#: others.  Both have a fixed size, whatever the input; collisions cost time, never a result.
SKETCH, MARKS = 1 << 20, 1 << 26
#: Pieces in which sketches travel.
SEGMENTS = 256
#: Entries of an index block.
BLOCK = 128
#: Class ids that may be broadcast (8 bytes each).
BROADCAST_CLASSES = 1_000_000

_BITS = [f"c{i}" for i in range(8)]
_FACTORS = np.random.default_rng(6).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int, least_words: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, hash of the set) of each text with enough words and a shingle."""
    for at, _, block in blocks(texts):
        of, hashes, first = words(block)
        n = len(hashes) - size + 1
        if n < 1:
            continue
        with np.errstate(over="ignore"):
            s = np.zeros(n, np.uint64)
            for i in range(size):
                s += hashes[i : i + n] * _FACTORS[i]
            s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        for i in range(block.n):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= max(size, least_words):
                own = np.unique(s[lo : hi - size + 1].view(np.int64))
                yield at + i, own, xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


class Sketch:
    """In how many rows shingles stand, by ``SKETCH`` counters, and by ``MARKS`` marks whether in more than one.

    With ``parts`` it is one of so many segments of the whole.
    """

    def __init__(self, parts: int = 1):
        self.counts, self.seen = np.zeros(SKETCH // parts, np.int32), np.zeros(MARKS // parts, np.uint8)

    def add(self, sets: list[np.ndarray]) -> None:
        """Counts each of the sets' shingles once a set."""
        if not sets:
            return
        flat = np.concatenate(sets).view(np.uint64)
        bucket, n = np.unique((flat & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
        self.counts[bucket] = np.minimum(self.counts[bucket] + n, _MOST)
        mark, n = np.unique((flat & np.uint64(MARKS - 1)).astype(np.int64), return_counts=True)
        self.seen[mark] = np.minimum(self.seen[mark] + n, 2)

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each shingle, and whether it stands in no other row."""
        flat = own.view(np.uint64)
        return self.counts[(flat & np.uint64(SKETCH - 1)).astype(np.int64)], self.seen[(flat & np.uint64(MARKS - 1)).astype(np.int64)] < 2

    def packed(self) -> bytes:
        return zlib.compress(self.counts.tobytes() + np.packbits(self.seen >= 1).tobytes() + np.packbits(self.seen >= 2).tobytes(), 1)

    @classmethod
    def read(cls, payload: bytes, parts: int = 1) -> Sketch:
        out = cls(parts)
        flat = np.frombuffer(zlib.decompress(payload), np.uint8)
        c, m = 4 * len(out.counts), len(out.seen) // 8
        out.counts[:] = flat[:c].view(np.int32)
        out.seen[:] = np.unpackbits(flat[c : c + m]) + np.unpackbits(flat[c + m :])
        return out

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """The segments that hold anything."""
        c, m = SKETCH // SEGMENTS, MARKS // SEGMENTS
        for i in range(SEGMENTS):
            part = Sketch(SEGMENTS)
            part.counts, part.seen = self.counts[i * c : (i + 1) * c], self.seen[i * m : (i + 1) * m]
            if part.counts.any() or part.seen.any():
                yield i, part.packed()

    def join(self, payload: bytes) -> None:
        other = Sketch.read(payload, SEGMENTS)
        self.counts = np.minimum(self.counts.astype(np.int64) + other.counts, _MOST).astype(np.int32)
        self.seen = np.minimum(self.seen + other.seen, 2)

    def put(self, segment: int, payload: bytes) -> None:
        other = Sketch.read(payload, SEGMENTS)
        c, m = len(other.counts), len(other.seen)
        self.counts[segment * c : (segment + 1) * c] = other.counts
        self.seen[segment * m : (segment + 1) * m] = other.seen


_MOST = 2**31 - 1


def parities(own: np.ndarray, longs: int = 4) -> np.ndarray:
    """64 parity bits a long of a set: two sets differ in at least as many shingles as in bits."""
    bits = 64 * longs
    odd = np.bincount((own.view(np.uint64) >> np.uint64(40) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_overlap(a: int, b: int, threshold: float) -> int:
    """Shingles two sets of such sizes must share."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


class Similar:
    """The steps of the join, each a DataFrame; ``h`` is the 64-bit hash of a shingle set.

    Null keys and texts and texts with fewer words than a shingle or ``least_words`` are like
    none.  Rows delivered twice count once.  Only the two named columns are read.
    """

    def __init__(self, df: DataFrame, key: str, text: str, size: int = SHINGLE, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS):
        self.key, self.size, self.threshold, self.least_words = key, size, threshold, least_words
        self.keys = df.select(F.col(f"`{key}`").cast("string").alias("k")).where("k IS NOT NULL")
        self.rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
        self._classes: DataFrame | None = None
        self._pass: DataFrame | None = None

    def _profile(self) -> DataFrame:
        """One pass over the texts: k, h, n, c0..c7 of each that takes part, and segment, payload of each task's sketch."""
        if self._pass is None:
            size, least = self.size, self.least_words

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sketch = Sketch()
                for batch in batches:
                    found = [(i, h, own) for i, own, h in shingle_sets(batch.column(1), size, least)]
                    sketch.add([own for _, _, own in found])
                    bits = [parities(own, 8) for _, _, own in found]
                    c = np.stack(bits) if bits else np.zeros((0, 8), np.int64)
                    i, m = pa.array([i for i, _, _ in found], pa.int64()), len(found)
                    cols = [batch.column(0).take(i), pa.array([h for _, h, _ in found], pa.int64()), pa.array([len(own) for _, _, own in found], pa.int32()), *(pa.array(c[:, j].copy()) for j in range(8))]
                    yield pa.RecordBatch.from_arrays(cols + [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
                parts = list(sketch.parts())
                m = len(parts)
                none = [pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *(pa.nulls(m, pa.int64()) for _ in range(8))]
                yield pa.RecordBatch.from_arrays(none + [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=names)

            names = ["k", "h", "n", *_BITS, "segment", "payload"]
            schema = "k string, h bigint, n int, " + ", ".join(f"{c} bigint" for c in _BITS) + ", segment int, payload binary"
            self._pass = cut(self.rows.mapInArrow(run, schema))
        return self._pass

    def classes(self) -> DataFrame:
        """k, h, n, c0..c7 of each text that takes part: the set's hash, size and 512 parities."""
        if self._classes is None:
            self._classes = cut(self._profile().where("segment IS NULL").drop("segment", "payload").dropDuplicates(["k", "h"]))
        return self._classes

    def sketch(self) -> Sketch:
        """The sketch of all rows; segments are put together as they come, none of their parts is kept."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole: dict[int, Sketch] = {}
            for batch in batches:
                for segment, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    whole.setdefault(segment, Sketch(SEGMENTS)).join(payload)
            yield pa.RecordBatch.from_arrays([pa.array(list(whole), pa.int32()), pa.array([w.packed() for w in whole.values()], pa.binary())], names=["segment", "payload"])

        parts = self._profile().where("segment IS NOT NULL").select("segment", "payload").repartition("segment")
        out = Sketch()
        for segment, payload in zip(*(c.to_pylist() for c in parts.mapInArrow(run, "segment int, payload binary").toArrow().columns)):
            out.put(segment, payload)
        return out

    def index(self) -> DataFrame:
        """token, h, n, pos, b0..b3: the prefix of each set in the global order, once a set and task, with its parities."""
        size, least, threshold = self.size, self.least_words, self.threshold
        counts = self.rows.sparkSession.sparkContext.broadcast(self.sketch().packed())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketch, done = Sketch.read(counts.value), set()
            for batch in batches:
                tokens, hs, ns, places, bits = [], [], [], [], []
                for _, own, h in shingle_sets(batch.column(0), size, least):
                    if h in done:
                        continue
                    done.add(h)
                    n = len(own)
                    of, alone = sketch.of(own)
                    ranked = np.lexsort((own, of))[: n - math.ceil(threshold * n - 1e-9) + 1]
                    pos = np.flatnonzero(~alone[ranked])  # what stands in one row alone leads nowhere
                    tokens.append(own[ranked[pos]]), places.append(pos), hs.append(np.full(len(pos), h)), ns.append(np.full(len(pos), n)), bits.append(np.tile(parities(own), (len(pos), 1)))
                cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, hs, ns, places)]
                b = np.concatenate(bits) if bits else np.zeros((0, 4), np.int64)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(b[:, i].copy()) for i in range(4)], names=["token", "h", "n", "pos", "b0", "b1", "b2", "b3"])

        return self.rows.select("t").mapInArrow(run, "token bigint, h bigint, n int, pos int, b0 bigint, b1 bigint, b2 bigint, b3 bigint")

    def candidates(self) -> DataFrame:
        """h_a < h_b: sets that share a prefix shingle and whose sizes and positions allow the overlap."""
        t = self.threshold
        of = Window.partitionBy("token")
        entries = self.index().select("*", F.min("h").over(of).alias("lo"), F.max("h").over(of).alias("hi"), F.ceil(F.count("*").over(of) / BLOCK).alias("blocks")).where("lo < hi")
        entries = entries.withColumn("block", F.floor((F.row_number().over(of.orderBy("n", "pos", "h")) - 1) / BLOCK))
        lists = cut(entries.groupBy("token", "block").agg(F.first("blocks").alias("blocks"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.collect_list(F.struct("h", "n", "pos", "b0", "b1", "b2", "b3")).alias("list")))
        # b's sizes are not under a's; of a pair of blocks the least sizes and positions bound the overlap
        need = lambda na, nb: F.ceil(F.lit(t / (1 + t)) * (na + nb) - 1e-9)
        a, b = (lists.where("blocks > 1").select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "n0", "n1", "p0", "list")]) for side in "ab")
        pairs = a.join(b, "token").where((F.col("block_a") < F.col("block_b")) & (F.col("n0_b") * t <= F.col("n1_a") + 1e-9) & (F.least(F.col("n1_a") - F.col("p0_a"), F.col("n1_b") - F.col("p0_b")) >= need(F.col("n0_a"), F.col("n0_b"))))
        names = ["h", "n", "p", "0", "1", "2", "3"]
        one, two = [f"{x}a" for x in names], [f"{x}b" for x in names]
        across = pairs.select("list_b", F.inline("list_a").alias(*one)).select(*one, F.inline("list_b").alias(*two))
        # the pairs within a block need no join, and nearly all lists are one block: each entry with those behind it
        behind = F.slice("list", F.col("i") + 2, F.greatest(F.size("list") - F.col("i") - 1, F.lit(0)))
        within = lists.where("size(list) > 1").select("list", F.posexplode("list").alias("i", "e")).select("e.*", behind.alias("rest")).toDF(*one, "rest")
        each = across.unionAll(within.select(*one, F.inline("rest").alias(*two)))
        differ = sum((F.bit_count(F.col(f"{i}a").bitwiseXOR(F.col(f"{i}b"))) for i in range(4)), F.lit(0))
        fits = (F.col("na") >= F.col("nb") * t - 1e-9) & (F.col("nb") >= F.col("na") * t - 1e-9) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need(F.col("na"), F.col("nb")))
        fits &= differ <= F.col("na") + F.col("nb") - 2 * need(F.col("na"), F.col("nb"))
        each = each.where((F.col("ha") != F.col("hb")) & fits)
        found = each.select(F.least("ha", "hb").alias("h_a"), F.greatest("ha", "hb").alias("h_b")).distinct()
        # more parities, kept a class and not an index entry, before any set is fetched
        one = self.classes().drop("k").dropDuplicates(["h"])
        for x in "ab":
            found = found.join(one.withColumnsRenamed({c: f"{c}_{x}" for c in one.columns}), f"h_{x}")
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _BITS), F.lit(0))
        return found.where(differ <= F.col("n_a") + F.col("n_b") - 2 * need(F.col("n_a"), F.col("n_b"))).select("h_a", "h_b")

    def links(self) -> DataFrame:
        """h_a, h_b, similarity: classes that reach the threshold."""
        size, least, threshold = self.size, self.least_words, self.threshold
        pairs = cut(self.candidates())
        ids = pairs.select(F.explode(F.array("h_a", "h_b")).alias("h")).distinct()
        reps = self.classes().groupBy("h").agg(F.min("k").alias("k")).join(ids, "h", "left_semi")
        if pairs.count() <= BROADCAST_CLASSES // 2:
            reps = F.broadcast(reps)
        texts = self.rows.join(reps, "k").select("h", "t")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, own) for i, own, _ in shingle_sets(batch.column(1), size, least)]
                i, own = zip(*found) if found else ((), ())
                ends = np.cumsum([0, *map(len, own)])
                flat = np.concatenate(own) if own else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["h", "s"])

        held = texts.mapInArrow(sets, "h bigint, s array<bigint>").groupBy("h").agg(F.first("s").alias("s"))
        both = pairs.join(held.select(F.col("h").alias("h_a"), F.col("s").alias("a")), "h_a").join(held.select(F.col("h").alias("h_b"), F.col("s").alias("b")), "h_b")
        both = both.select("h_a", "h_b", "a", "b").sortWithinPartitions("h_b", F.element_at("a", 1), "h_a")  # alike sets of one b follow each other

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            apart: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            last_b, last_a, last_set, last_n = None, None, None, 0
            for batch in batches:
                out = ([], [], [])
                flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
                for i, (ha, hb) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    a, b = (v[o[i] : o[i + 1]] for v, o in flat)
                    derived = None
                    if hb == last_b and abs(len(a) - len(last_set)) * 8 <= len(a) and a[0] == last_set[0]:
                        if (last_a, ha) not in apart:
                            if len(apart) > 20_000:
                                apart.clear()
                            apart[last_a, ha] = np.setdiff1d(last_set, a, True), np.setdiff1d(a, last_set, True)
                        gone, new = apart[last_a, ha]
                        if (len(gone) + len(new)) * 4 <= len(a):
                            derived = last_n - _inside(gone, b) + _inside(new, b)
                    n = _inside(a, b) if derived is None else derived
                    last_b, last_a, last_set, last_n = hb, ha, a.copy(), n
                    if n >= threshold * (len(a) + len(b) - n) - 1e-9:
                        for col, x in zip(out, (ha, hb, n / (len(a) + len(b) - n))):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["h_a", "h_b", "similarity"])

        return both.mapInArrow(verify, "h_a bigint, h_b bigint, similarity double")

    def pairs(self) -> DataFrame:
        """id_a < id_b: rows that are alike, those of one class among them."""
        members, links = self.classes().select("k", "h"), self.links()
        a, b = members.select(F.col("k").alias("ka"), F.col("h").alias("h_a")), members.select(F.col("k").alias("kb"), F.col("h").alias("h_b"))
        unlike = links.join(a, "h_a").join(b, "h_b").select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).where("id_a < id_b")
        alike = a.join(b, F.expr("h_a = h_b AND ka < kb")).select(F.col("ka").alias("id_a"), F.col("kb").alias("id_b"))
        return unlike.unionAll(alike).distinct()

    def groups(self) -> DataFrame:
        """<key>, group_id, n_links of each row: connected classes; a group is named by its least class.

        A row that takes no part (too few words, blank or null text) is a class of its own without links.
        Labels spread by hooking each root to the least neighbour's and halving paths, so rounds
        grow with the logarithm of a group's diameter; nothing is collected.
        """
        links = cut(self.links().select("h_a", "h_b"))
        both = cut(links.unionAll(links.select(F.col("h_b").alias("h_a"), F.col("h_a").alias("h_b"))))
        label = cut(both.select(F.col("h_a").alias("h"), F.col("h_a").alias("root")).distinct())
        while True:
            near = both.join(label.select(F.col("h").alias("h_b"), F.col("root").alias("r")), "h_b").groupBy(F.col("h_a").alias("h")).agg(F.min("r").alias("r"))
            # each root takes the least label next to any of its members
            hook = label.join(near, "h").groupBy("root").agg(F.min("r").alias("to"))
            hooked = label.join(hook, "root").select("h", F.least("root", "to").alias("p"))
            parents = hooked.select(F.col("h").alias("p"), F.col("p").alias("pp"))
            after = cut(hooked.join(parents, "p", "left").select("h", F.coalesce("pp", "p").alias("root")))
            moved = after.join(label.select("h", F.col("root").alias("old")), "h").where("root <> old").limit(1).count()
            label = after
            if not moved:
                break
        degree = both.groupBy(F.col("h_a").alias("h")).agg(F.count("*").alias("n"))
        classed = self.classes().select("k", "h").join(label, "h", "left").join(degree, "h", "left")
        out = self.keys.distinct().join(classed, "k", "left")
        return out.select(F.col("k").alias(self.key), F.coalesce("root", "h", F.xxhash64("k")).alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))


def _inside(a: np.ndarray, b: np.ndarray) -> int:
    """How many of ``a`` stand in sorted ``b``."""
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
