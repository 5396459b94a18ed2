"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

A text's set holds the 64-bit hashes of its distinct word n-grams. Equal sets
are one class from the start.

Tiles. Sizes are cut into bands so wide that linked sets lie in the same or
neighbouring bands. In a band whose sets differ by at most k elements when
linked, the hash space is cut into k + c parts, so two linked sets agree
wholly in at least c of them. A tile is (band, part, what the set holds
there). If one of the two has fewer than c empty parts, they meet in a tile
that isn't empty; c is chosen so that almost every set of the band has fewer,
and the few others of a band have one tile more, which is common to them. So
no link is missed, and a passage that many texts share makes few tiles,
because other elements fall into the same parts.

Links. Every set is compared with the first and the last set of its tiles, and
components are formed. Tiles that still hold several components are compared whole, in pairs of blocks of bounded
bytes, by bitmaps alone: each set gets its nearest one of another component that the bitmaps can't rule out, at
most one row a set and block. Of these the nearest over all tiles is compared exactly, and components join, as long as that finds many links.
Sets that still have someone near meet again in their blocks: the pairs that bitmaps can't rule out are compared
exactly if a block has few for its size; in a block with many, a union-find over the arrays of all its sets
decides which components join, and its links, fewer than it has sets, become rows. So all pairs of a tile that could join
two components are compared exactly, and a group of copies costs rows in proportion to its size. A comparison bounds the overlap from above by bit counts of two
bitmaps (each bit that only one set has stands for an element that only it
has) and intersects the arrays of the pairs left. Fresh links join roots, and only those are given to the next stars.

Two filters (tiles with several sets, texts that are candidates) are hashed
bitmaps of fixed size, built in Spark; what they let through by chance is
dropped by joins.

Defined results: texts without words (null, empty) have size 0 and are linked
with nothing; repeated rows keep their rows; a null id is never a component's
id unless all ids are null; input columns other than id and text are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from merchlens.llm.components import components
from merchlens.llm.shared import Scratch, release_memory, small_batches, written
from merchlens.llm.words import SPACED, hash_words, mix, rolling, text_chunks, word_counts
from merchlens.operators.bloom import bloom_filter, bloom_probe, words_for

# A set's bitmap has 16 bits an element up to 2**FINE_BITS bits and two bits an element
# beyond, rounded up to a power of two between 2**LEAST_BITS and 2**MOST_BITS.
LEAST_BITS, FINE_BITS, MOST_BITS = 9, 12, 16
FILTER_BITS = 1 << 26  # of each hashed filter: 8 MB
ASKED_WORDS = 1 << 19  # of the filter of sets whose arrays are sent, at most (8 MB)
FEW = 2  # rounds end when they find fewer links than one in so many sets with someone near
PAIRS = 4  # for each set of a block that become rows, at most; else its arrays meet
BLOCK = 1024  # sets of a tile that are compared with each other in one group, at most
BLOCK_ELEMENTS = 1 << 19  # and their elements, roughly (4 MB)


class Bands:
    """Size bands and parts for the threshold a / b."""

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        self.lows = [-(-b // (b - a))]  # below it, linked sets are equal
        self.sizes: list[tuple[int, int]] = []

    def low(self, i: int) -> int:
        while len(self.lows) <= i:  # two steps of the threshold a band
            last = self.lows[-1]
            self.lows.append(max(last + 1, -(-last * self.b * self.b // (self.a * self.a))))
        return self.lows[i]

    def parts(self, i: int) -> tuple[int, int]:
        """k + c parts and the surplus c: more than the empty parts of the band's smallest set by four deviations."""
        while len(self.sizes) <= i:
            at = len(self.sizes)
            k, c = 2 * (self.low(at + 1) - 1) * (self.b - self.a) // (self.b + self.a), 1
            for _ in range(100):
                full = self.low(at) / (k + c)  # elements a part
                empty = (k + c) * math.exp(-full)
                most = empty + 4 * math.sqrt(empty * (1 - (1 + full) * math.exp(-full)))
                if c > most:
                    break
                c = int(most) + 1
            self.sizes.append((k + c, c))
        return self.sizes[i]

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, parts, surplus) of the tiles of a set of n elements."""
        i = 0
        while n >= self.low(i + 1):
            i += 1
        own = [i] if n >= self.low(0) else []
        after = i + 1 if own else 0
        return [(x, *self.parts(x)) for x in own + ([after] if n * self.b >= self.a * self.low(after) else [])]


@lru_cache(maxsize=4096)
def _edges(parts: int) -> np.ndarray:
    return np.array([-(-(j << 64) // parts) for j in range(1, parts)], np.uint64)


@lru_cache(maxsize=4096)
def _salts(band: int, parts: int) -> np.ndarray:
    return mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40))


def tile_keys(elements: np.ndarray, sums: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles of a sorted set; ``sums``: running sums of its mixed elements, from 0."""
    out = []
    for band, parts, surplus in bands.of(len(elements)):
        at = np.concatenate([[0], np.searchsorted(elements, _edges(parts)), [len(elements)]])
        salts = _salts(band, parts)
        full = at[1:] > at[:-1]
        with np.errstate(over="ignore"):
            out.append(mix((sums[at[1:]] - sums[at[:-1]] + salts)[full]))
        if parts - np.count_nonzero(full) >= surplus:
            out.append(mix(np.array([band + 1], np.uint64) << np.uint64(20)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted set of each text of a chunk."""
    hashes, starts, _ = hash_words(data, bounds, SPACED)
    counts = word_counts(starts, bounds)
    grams, at = rolling(hashes, n), 0
    for words in counts.tolist():
        if words >= n:
            yield np.unique(grams[at:at + words - n + 1])
        else:
            yield rolling(hashes[at:at + words], words) if words else np.zeros(0, np.uint64)
        at += words


def _sums(elements: np.ndarray) -> np.ndarray:
    out = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(mix(elements ^ np.uint64(0xA0761D6478BD642F)), out=out[1:])
    return out


def _set_id(elements: np.ndarray, sums: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(sums[-1:] + np.uint64(len(elements)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])


def _set_pass(n: int):
    """Size and id of every row's set."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column(2)):
                sets = list(text_sets(data, bounds, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_set_id(s, _sums(s)) if len(s) else None for s in sets], pa.int64())], names=["id", "text_key", "n", "set_id"])
    return run


def _tile_pass(n: int, a: int, b: int, wanted=None):
    """Rows (tile, set id), of the tiles that ``wanted`` lets through; a task sends the tiles of equal sets once."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        bands, seen = Bands(a, b), set()
        for batch in batches:
            for _, _, data, bounds in text_chunks(batch.column(0)):
                tiles, ids = [], []
                for elements in text_sets(data, bounds, n):
                    sums = _sums(elements)
                    if not len(elements) or (key := _set_id(elements, sums)) in seen:
                        continue
                    seen.add(key)
                    keys = tile_keys(elements, sums, bands).view(np.int64)
                    if wanted is not None:
                        keys = keys[wanted.value(keys)]
                    tiles.append(keys)
                    ids.append(np.full(len(keys), key))
                if tiles:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(ids).astype(np.int64))], names=["tile", "set_id"])
    return run


def _bitmap(elements: np.ndarray) -> np.ndarray:
    """Bits of the elements by their middle hash bits, as 64-bit words."""
    n = len(elements)
    size = 1 << min(max((2 * n - 1).bit_length(), min((16 * n - 1).bit_length(), FINE_BITS), LEAST_BITS), MOST_BITS)
    bits = np.zeros(size, bool)
    bits[(elements >> np.uint64(20)) & np.uint64(size - 1)] = True
    return np.packbits(bits).view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set in fewer words: halves laid over each other."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def _second_pass(n: int, wanted):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen = set()
        for batch in batches:
            picked = batch.filter(pa.array(wanted.value(batch.column(0).to_numpy())))
            for _, _, data, bounds in text_chunks(picked.column(1)):
                rows = []
                for elements in text_sets(data, bounds, n):
                    if not len(elements) or (key := _set_id(elements, _sums(elements))) in seen:
                        continue
                    seen.add(key)
                    rows.append((key, len(elements), _bitmap(elements).tobytes(), elements.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["set_id", "n", "bits", "elements"])
    return run


class HashedFilter:
    """A bitmap over the low bits of keys: says yes to all it was built from, and to some others by chance."""

    def __init__(self, buckets: dict[int, bytes]):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for number, part in buckets.items():
            self.bits[(number - 1) * len(part):number * len(part)] = np.frombuffer(part, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (FILTER_BITS - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def hashed_filter(keys: DataFrame, column: str):
    """Broadcast ``HashedFilter`` of a bigint column: at most FILTER_BITS / 8 bytes however many keys there are."""
    at = keys.select((F.col(column).bitwiseAND(FILTER_BITS - 1) + 1).alias("at"))  # Spark numbers positions from 1
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    return keys.sparkSession.sparkContext.broadcast(HashedFilter({r["number"]: bytes(r["bits"]) for r in rows}))


GROUP = "tile", "i", "j"
PAIR = "ra bigint, rb bigint, a bigint, b bigint"


def _words(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit words of each value of a binary column, without a copy."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None:
        return [np.zeros(0, np.uint64)] * len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1].tolist()
    return [np.frombuffer(data, np.uint64, (hi - lo) // 8, lo) for lo, hi in zip(at, at[1:], strict=False)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def _overlap(a: int, b: int):
    """The pairs whose sets are linked."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            keep = [(a + b) * _common(x, y) >= a * (len(x) + len(y)) for x, y in zip(_words(batch.column(4)), _words(batch.column(5)), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["ra", "rb", "a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _could_link(a: int, b: int):
    """Drops the pairs whose bitmaps bound their overlap below the threshold."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            keep = np.zeros(len(na), bool)
            for i, (x, y) in enumerate(zip(_words(batch.column(6)), _words(batch.column(7)), strict=True)):
                words = min(len(x), len(y))
                x, y = _folded(x, words), _folded(y, words)
                most = min(na[i] - int(np.bitwise_count(x & ~y).sum()), nb[i] - int(np.bitwise_count(y & ~x).sum()))
                keep[i] = (a + b) * most >= a * (na[i] + nb[i])
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["ra", "rb", "a", "b"]).filter(pa.array(keep))
    return run


def _asked(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """``sets``, without most of those that aren't in ``ids(set_id)``, a stored table: their arrays needn't be sent to the join that follows."""
    words = min(ASKED_WORDS, words_for(ids.count()))
    return bloom_probe(sets, bloom_filter(ids, "set_id", words), "set_id", words)


def _linked(pairs: DataFrame, sets: DataFrame, a: int, b: int, scratch: Scratch, bounded: bool = False) -> DataFrame:
    """The pairs (ra, rb, a, b: components and sets) whose sets are linked; ``bounded``: ``pairs`` is stored, without those that bitmaps rule out."""
    def side(sets: DataFrame, name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), *[F.col(c).alias(f"{c}{name}") for c in columns])

    if not bounded:
        bitmaps = pairs.join(side(sets, "a", "n", "bits"), "a").join(side(sets, "b", "n", "bits"), "b").select("ra", "rb", "a", "b", "na", "nb", "bitsa", "bitsb")
        pairs = scratch.written(bitmaps.mapInArrow(_could_link(a, b), PAIR), "could")
    few = _asked(sets, pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")))
    whole = pairs.join(side(few, "a", "elements"), "a").join(side(few, "b", "elements"), "b").select("ra", "rb", "a", "b", "elementsa", "elementsb")
    return whole.mapInArrow(_overlap(a, b), PAIR)


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group of equal first columns, which follow each other, also across batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        values = [table.column(c).to_numpy() for c in range(keys)]
        edges = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([v[1:] != v[:-1] for v in values])])).tolist()
        for x, y in zip(edges, edges[1:], strict=False):
            yield table.slice(x, y - x)
        held = table.slice(edges[-1])  # the last group may go on
    if held is not None and held.num_rows:
        yield held


def _block_members(group: pa.Table):
    """Block, set ids, roots, sizes and bitmaps (of one width) of a group of two blocks, or of one with itself."""
    block, ids, roots, n = (group.column(c).to_numpy() for c in range(3, 7))
    bitmaps = _words(group.column(7).combine_chunks())
    words = min(map(len, bitmaps))
    return block, ids, roots, n, np.stack([_folded(m, words) for m in bitmaps])


def _meets(block: np.ndarray):
    """For each member of the first block, those it is compared with."""
    one = block == block.min()
    left, right = np.flatnonzero(one), np.flatnonzero(one if one.all() else ~one)
    for i in left.tolist():
        yield i, right[right > i] if one.all() else right


def _bounds(i: int, others: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of ``i`` with ``others``, by bitmaps."""
    only = n[i] - np.bitwise_count(bits[i] & ~bits[others]).sum(1, dtype=np.int64)
    other = n[others] - np.bitwise_count(bits[others] & ~bits[i]).sum(1, dtype=np.int64)
    return np.minimum(only, other)


def _alone(group: pa.Table) -> bool:
    """Whether only one of the two blocks of a group is there, or one component."""
    i, j, block, roots = (group.column(c).to_numpy() for c in (1, 2, 3, 5))
    return (roots == roots[0]).all() or (i[0] != j[0] and (block == block[0]).all())


NEAREST = "tile bigint, i int, j int, block int, set_id bigint, root bigint, partner bigint, partner_root bigint, nearness double"


def _nearest(a: int, b: int):
    """Members of a group that the bitmaps can't rule out as links to another component, with the nearest one of these."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for group in _groups(batches, 3):
            if _alone(group):
                continue
            block, ids, roots, n, bits = _block_members(group)
            best, partner = np.zeros(len(roots)), np.full(len(roots), -1)
            for i, others in _meets(block):
                others = others[roots[others] != roots[i]]
                if not len(others):
                    continue
                most = _bounds(i, others, n, bits)
                can = (a + b) * most >= a * (n[i] + n[others])
                near, share = others[can], (most / (n[i] + n[others]))[can]
                if len(near):
                    closer = share > best[near]
                    best[near[closer]], partner[near[closer]] = share[closer], i
                    at = int(share.argmax())
                    if share[at] > best[i]:
                        best[i], partner[i] = share[at], near[at]
            met = np.flatnonzero(partner >= 0)
            if len(met):
                out = group.select([0, 1, 2, 3, 4, 5]).take(pa.array(met)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in out.columns), pa.array(ids[partner[met]]), pa.array(roots[partner[met]]), pa.array(best[met])],
                                                 names=["tile", "i", "j", "block", "set_id", "root", "partner", "partner_root", "nearness"])
    return run


def _pairs_or_members(a: int, b: int):
    """Pairs of different components that the bitmaps can't rule out, or the members (without a partner) of a group with many."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for group in _groups(batches, 3):
            if _alone(group):
                continue
            block, ids, roots, n, bits = _block_members(group)
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, others in _meets(block):
                others = others[roots[others] != roots[i]]
                if len(others):
                    near = others[(a + b) * _bounds(i, others, n, bits) >= a * (n[i] + n[others])]
                    one.append(np.full(len(near), i))
                    two.append(near)
                    if sum(map(len, two)) > PAIRS * len(ids):
                        break
            x, y = np.concatenate(one), np.concatenate(two)
            if len(x) > PAIRS * len(ids):
                x, y = np.arange(len(ids)), None
            if len(x):
                keys = group.select([0, 1, 2, 3]).take(pa.array(x)).combine_chunks()
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keys.columns), pa.array(ids[x]), pa.array(roots[x]),
                                                  none if y is None else pa.array(ids[y]), none if y is None else pa.array(roots[y])],
                                                 names=["tile", "i", "j", "block", "set_id", "root", "partner", "partner_root"])
    return run


def _block_links(a: int, b: int):
    """Exact links between the components of a group, fewer than it has members."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for group in _groups(batches, 3):
            if _alone(group):
                continue
            block, ids, roots, n, bits = _block_members(group)
            elements = _words(group.column(8).combine_chunks())
            now, links = roots.copy(), []
            for i, others in _meets(block):
                others = others[now[others] != now[i]]
                for j in others[(a + b) * _bounds(i, others, n, bits) >= a * (n[i] + n[others])].tolist() if len(others) else ():
                    if now[j] != now[i] and (a + b) * _common(elements[i], elements[j]) >= a * (n[i] + n[j]):
                        links.append((roots[i], roots[j], ids[i], ids[j]))
                        now[now == max(now[i], now[j])] = min(now[i], now[j])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["ra", "rb", "a", "b"])
    return run


def _near_rows(left: DataFrame, sets: DataFrame, a: int, b: int) -> DataFrame:
    """``_nearest`` of all rows of ``left(tile, set_id, root, place, held, most)``: tiles as pairs of blocks."""
    size = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_ELEMENTS) / F.col("most"))))
    block = F.floor((F.col("place") - 1) / size).cast("int")
    blocks = F.floor((F.col("held") - 1) / size).cast("int")
    # A set meets the blocks of its tile; a tile of one block is one group.
    dealt = left.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), blocks)))
    keyed = dealt.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    rows = keyed.join(sets.select("set_id", "n", "bits"), "set_id").select(*GROUP, "block", "set_id", "root", "n", "bits")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_nearest(a, b), NEAREST)


def _rest_links(near: DataFrame, roots: DataFrame, sets: DataFrame, a: int, b: int, scratch: Scratch) -> DataFrame:
    """Links (ra, rb, a, b) between components among all the sets of each group of ``near``."""
    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)

    met = near.select(*GROUP, "block", "set_id").join(roots.select("set_id", "root"), "set_id")
    open_groups = met.groupBy(*GROUP).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(*GROUP)
    rows = met.join(open_groups, list(GROUP)).join(sets.select("set_id", "n", "bits"), "set_id").select(*GROUP, "block", "set_id", "root", "n", "bits")
    found = scratch.written(grouped(rows).mapInArrow(_pairs_or_members(a, b), NEAREST.rsplit(",", 1)[0]), "pairs")
    pairs = found.where("partner IS NOT NULL").select(F.greatest("root", "partner_root").alias("ra"), F.least("root", "partner_root").alias("rb"),
                                                      F.greatest("set_id", "partner").alias("a"), F.least("set_id", "partner").alias("b")).distinct()
    pairs = scratch.written(pairs, "open")
    members = found.where("partner IS NULL").select(*GROUP, "block", "set_id", "root")
    members = members.join(_asked(sets, members.select("set_id")), "set_id")
    whole = members.select(*GROUP, "block", "set_id", "root", "n", "bits", "elements")
    return _linked(pairs, sets, a, b, scratch, bounded=True).unionByName(grouped(whole).mapInArrow(_block_links(a, b), PAIR))


def _open_tiles(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (tile, set_id, root, held, most, place) of the tiles that hold several components: how many sets, the largest one's size, and the set's place.

    Sets that are alike share many tiles: of tiles with the same members (told by their number and two 64-bit hashes) one stays, in which they all meet."""
    named = members.select("tile", "set_id").join(roots, "set_id")
    several = (named.groupBy("tile").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("held"), F.max("n").alias("most"),
                                         *[F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(f"x{seed}") for seed in (0, 1)])
               .where("r0 <> r1").groupBy("held", "most", "x0", "x1").agg(F.min("tile").alias("tile")).select("tile", "held", "most"))
    place = F.row_number().over(Window.partitionBy("tile").orderBy("set_id"))
    return named.join(several, "tile").select("tile", "set_id", "root", "held", "most", place.alias("place"))


def _merged(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots(set_id, n, root)`` after the links (ra, rb) between roots."""
    with Scratch(roots.sparkSession, "components") as inner:
        joined = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), inner).select(F.col("node"), F.col("root").alias("new"))
        moved = roots.join(joined, roots["root"] == joined["node"], "left")
        return scratch.written(moved.select("set_id", "n", F.coalesce("new", "root").alias("root")), "roots")


def jaccard_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """Per row: id, ``text_key`` (hash of the text), ``n_shingles``, ``component_id`` (least id of the texts reachable by links)."""
    small_batches(docs.sparkSession)
    a, b = threshold
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]
    # Texts are hashed again for each pass: that costs less than keeping the tiles of all sets.
    found = written(rows.mapInArrow(_set_pass(n), f"id {kind}, text_key bigint, n bigint, set_id bigint"), "jaccard-sets")
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        roots = written(_roots(rows, found, n, a, b, scratch).select("set_id", "root"), "jaccard-roots")
    classes = found.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("id").alias("least"))
    rooted = classes.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("set_id", "component")
    out = found.select("id", "text_key", "n", "set_id").join(named, "set_id", "left")
    return out.select(F.col("id").alias(id), "text_key", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _roots(rows: DataFrame, found: DataFrame, n: int, a: int, b: int, scratch: Scratch) -> DataFrame:
    """Component (``root``) of every set that shares a tile with another one."""
    tiles = "tile bigint, set_id bigint"
    shared = scratch.written(rows.select("text").mapInArrow(_tile_pass(n, a, b), tiles).groupBy("tile").agg(
        F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high"), "tiles")
    members = rows.select("text").mapInArrow(_tile_pass(n, a, b, hashed_filter(shared, "tile")), tiles).join(shared, "tile").groupBy("tile", "set_id").agg(
        F.first("low").alias("low"), F.first("high").alias("high"))
    members = scratch.written(members, "members")
    scratch.forget("tiles")
    leaders = scratch.written(members.groupBy("set_id").agg(F.min("low").alias("low"), F.max("high").alias("high")), "leaders")
    wanted = hashed_filter(found.join(leaders.select("set_id"), "set_id", "left_semi").select("text_key"), "text_key")
    arrays = rows.select("text_key", "text").mapInArrow(_second_pass(n, wanted), "set_id bigint, n bigint, bits binary, elements binary")
    sets = scratch.written(arrays.join(leaders.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "arrays")

    roots = sets.select("set_id", "n", F.col("set_id").alias("root"))
    sided = leaders.select(F.col("set_id").alias("x"), F.explode(F.array("low", "high")).alias("y")).where("x <> y")
    first = sided.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().select(F.col("a").alias("ra"), F.col("b").alias("rb"), "a", "b")
    roots = _merged(roots, scratch.written(_linked(first, sets, a, b, scratch), "links"), scratch)
    left = members
    while True:
        left = scratch.written(_open_tiles(left, roots), "left")
        near = scratch.written(_near_rows(left, sets, a, b), "near")
        nearest = near.groupBy("set_id").agg(F.max(F.struct("nearness", "partner", "partner_root", "root")).alias("p"))
        edges = nearest.select(F.greatest("p.root", "p.partner_root").alias("ra"), F.least("p.root", "p.partner_root").alias("rb"),
                               F.greatest("set_id", "p.partner").alias("a"), F.least("set_id", "p.partner").alias("b")).distinct()
        edges = scratch.written(edges, "edges")
        asked = edges.count()
        if not asked:
            return roots
        fresh = scratch.written(_linked(edges, sets, a, b, scratch, bounded=True), "links")
        found_now = fresh.count()
        if found_now:
            roots = _merged(roots, fresh, scratch)
        if found_now <= asked // FEW:
            rest = scratch.written(_rest_links(near, roots, sets, a, b, scratch), "links")
            return roots if rest.isEmpty() else _merged(roots, rest, scratch)
        # Whoever has no one near now never will: components only grow.
        left = near.select("tile", "set_id").distinct()
