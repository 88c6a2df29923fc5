"""Near-duplicate questions across splits: Jaccard similarity of character trigrams within a family.

Texts become trigram sets in one pass, packed to a byte or so a trigram, with a sketch beside each: the parities of the trigrams in
each of a power of two of buckets. Two sets differ in at least as many trigrams as their sketches differ in bits, and similar sets in
few, so a family's texts are compared by array steps over sketches, and pairs that these leave open are checked exactly, whole lists of them in a task and by array steps
over the sets: long texts of one small vocabulary are all similar, so sets are unpacked once for many pairs. Only similar pairs are written.
Equal texts of a family and split are compared once. A sketch has as many bits as its set has trigrams, or more; half of them rule out most
pairs. One of twice the bits is folded to compare it.

The texts of a family are a list, compared by size: only sets of similar sizes meet. A long list is cut into blocks by the size of
the sets and its pairs of blocks are dealt out; two blocks whose sizes are too far apart are no pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key
from ..scratch import materialize
from .skew import below, parts_of, spread_join, time_cuts

THRESHOLD = 0.84
#: Texts of a list that are compared in one task.
BLOCK = 16384
#: Blocks of one list at most; the blocks of a list beyond MOST_BLOCKS * BLOCK entries grow.
MOST_BLOCKS = 1024
#: Numbers of one array step.
TILE = 1 << 16
#: Pairs that sketches leave open and that are checked at once.
OPEN = 1 << 23
#: Trigrams told by bits at most.
HEAD = 8192
#: Rows of a file of pairs: these are told by few bytes, and Spark deals files by their bytes.
PAIRS = 1 << 19


def gram_sets(texts: list[str]) -> list[np.ndarray]:
    """For each folded text its sorted distinct trigrams with two spaces before and behind: 21 bits a character."""
    out = []
    for t in texts:
        c = np.frombuffer(f"  {t}  ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        out.append(np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    return out


def pack(grams: np.ndarray) -> bytes:
    """Sorted trigrams by planes of bytes, deflated."""
    points = np.concatenate([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]).astype("<u4")
    return zlib.compress(points.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8)
    first, second, third = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").astype(np.int64).reshape(3, -1)
    return first << 42 | second << 21 | third


def sketch(grams: np.ndarray) -> bytes:
    """The parities of a set in buckets, as 64-bit words: a power of two of them, with a bit for each trigram at least."""
    bits = max(1 << (len(grams) - 1).bit_length(), 64)
    mixed = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    at = (mixed >> np.uint64(32)).astype(np.int64) & (bits - 1)
    return np.packbits(np.bincount(at, minlength=bits) & 1 == 1, bitorder="little").tobytes()


def _sets(base: DataFrame) -> DataFrame:
    """(node, id, f, split, h, m, sketch, grams): a numbered row for each text; ``h`` is a digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = gram_sets(b.column("k").to_pylist())
            made = [pa.array([len(s) for s in sets], pa.int32()), *[pa.array([of(s) for s in sets], pa.binary()) for of in (sketch, pack)]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "f", "split", "h")], *made], ["id", "f", "split", "h", "m", "sketch", "grams"])

    kind = {c: base.schema[c].dataType.simpleString() for c in ("id", "f")}
    made = base.mapInArrow(run, f"id {kind['id']}, f {kind['f']}, split string, h binary, m int, sketch binary, grams binary")
    return materialize(made.withColumn("node", F.monotonically_increasing_id()))


def block_pairs(entries: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(list, inner, at, node, side, m and what else they have): ``entries`` once for each pair of blocks of their list that they take part in; ``inner``
    where a block meets itself, ``at`` is the entry's own block. A list of up to ``block`` entries is one block.

    Blocks are ranges of set sizes; blocks i < j meet only where the largest set of i can be similar to the smallest of j.
    """
    more = [c for c in entries.columns if c not in ("f", "g")]
    entries = entries.withColumn("key", F.struct("f", "g"))
    cuts = time_cuts(entries, "key", "m", entries.count(), MOST_BLOCKS, block)
    if cuts.isEmpty():
        wide = entries.withColumns({"at": F.lit(0), "other": F.lit(0)})
    else:
        wide = spread_join(entries, cuts.select(F.col("__key").alias("key"), "__cuts"), ["key"], F.xxhash64("node"))
        low, high = (below(F.col("__cuts"), F.col("m"), MOST_BLOCKS, equal) for equal in (False, True))
        at = low + F.pmod(F.xxhash64("node"), high - low + 1).cast("int")
        wide = wide.withColumn("at", F.when(F.col("__cuts").isNull(), 0).otherwise(at))

        def meets(other: Column) -> Column:
            i, j = F.least("at", other), F.greatest("at", other)
            return (i == j) | (F.get("__cuts", i) >= F.lit(threshold) * F.get("__cuts", j - 1) - 1e-9)

        wide = wide.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.coalesce(F.size("__cuts"), F.lit(0))), meets)))
    pair = F.least("at", "other"), F.greatest("at", "other")
    return wide.select(F.xxhash64("f", "g", *pair).alias("list"), (F.col("at") == F.col("other")).cast("int").alias("inner"), "at", *more)


def close_pairs(inner: np.ndarray, at: np.ndarray, node: np.ndarray, side: np.ndarray, m: np.ndarray, sketches: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Of one list in order of size: pairs of nodes of different sides whose sizes and sketches leave them open, each once; the pairs of one node come together."""
    words = np.array([len(x) // 8 for x in sketches])
    rest = (1 - threshold) / (1 + threshold)
    for width in np.unique(words):
        # Sets behind a set may be larger by 1 / threshold: of its own width or of a wider one, which is folded.
        own = np.flatnonzero(words >= width)
        own = own[m[own] <= m[words == width].max() / threshold + 1e-9]
        planes = np.empty((width, len(own)), np.uint64)
        for i, x in enumerate(own):
            planes[:, i] = np.bitwise_xor.reduce(np.frombuffer(sketches[x], "<u8").reshape(-1, width), axis=0)
        half = planes[: width // 2] ^ planes[width // 2 :] if width > 1 else planes
        small = words[own] == width
        # A set meets those of other sides; in a list of two blocks, those of the other block.
        group = np.unique(np.stack([side[own], np.where(inner[own] == 1, -1, at[own])]), axis=1, return_inverse=True)[1].reshape(-1)
        for g in np.unique(group[small]):
            first = np.flatnonzero((group == g) & small)
            x = own[first[0]]
            other = np.flatnonzero((side[own] != side[x]) & ((inner[x] == 1) | (at[own] != at[x])))
            theirs, sizes, names = np.ascontiguousarray(half[:, other]), m[own[other]], node[own[other]]
            mine, me = m[own[first]], node[own[first]]
            low = np.searchsorted(sizes, mine, "left")
            high = np.searchsorted(sizes, np.floor(mine / threshold + 1e-9), "right")
            i = 0
            while i < len(first):
                # Some sets at once, against all that any of them can meet: first by sketches of half the bits, what is left by whole ones.
                a = low[i]
                j = i + max(1, min(TILE // max(high[i] - a, 1), 64, len(first) - i))
                b = high[j - 1]
                tile, i = slice(i, j), j
                if a == b:
                    continue
                apart = np.zeros((j - tile.start, b - a), np.uint16 if len(half) < 1024 else np.int32)
                bits, some, one = np.empty(apart.shape, np.uint64), *np.empty((2, *apart.shape), np.uint8)
                for w in range(len(half)):
                    np.bitwise_xor(theirs[w, a:b], half[w, first[tile], None], out=bits)
                    np.bitwise_count(bits, out=one if w % 3 else some)
                    if w % 3:
                        some += one
                    if w % 3 == 2 or w == len(half) - 1:  # three counts fit into a byte
                        apart += some
                most = np.minimum(rest * (mine[j - 1] + sizes[a:b]) + 1e-6, np.iinfo(apart.dtype).max).astype(apart.dtype)
                left = apart <= most
                for k in np.flatnonzero(left.any(axis=1)):
                    s = tile.start + k
                    near = np.flatnonzero(left[k, low[s] - a : high[s] - a]) + low[s]
                    near = near[apart[k, near - a] <= rest * (mine[s] + sizes[near]) + 1e-6]
                    near = near[(sizes[near] > mine[s]) | (names[near] > me[s])]  # of equal sizes, either finds the other
                    if width > 1 and len(near):
                        whole = np.bitwise_count(planes[:, other[near]] ^ planes[:, first[s], None]).sum(axis=0, dtype=np.int32)
                        near = near[whole <= rest * (mine[s] + sizes[near]) + 1e-6]
                    if len(near):
                        yield np.stack([np.full(len(near), me[s]), names[near]])


def shared(sets: Callable[[int], np.ndarray], pairs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """How many trigrams the sets of each pair share, exactly: ``sets`` gives the trigrams of a number; the first of all pairs of an array is the same.

    The trigrams that several of some sets have are bits, told by and; all others are found by lists of the sets that have them. Which are which
    changes nothing but the work.
    """
    used = np.unique(np.concatenate([p.reshape(-1) for p in pairs]))
    seen, often = np.unique(np.concatenate([sets(x) for x in used[:: -(-len(used) // 256)]]), return_counts=True)
    head = np.argsort(-often, kind="stable")[:HEAD]
    head = np.sort(seen[head[often[head] > 1]])
    width = len(head) // 64 + 1
    bits, rare, of = np.zeros((len(used), width), np.uint64), [], []
    for i, x in enumerate(used):
        own = sets(x)
        spot = np.searchsorted(head, own)
        known = spot < len(head)
        known[known] = head[spot[known]] == own[known]
        row = np.zeros(64 * width, bool)
        row[spot[known]] = True
        bits[i] = np.packbits(row, bitorder="little").view("<u8")
        rare.append(own[~known])
        of.append(np.full(len(rare[-1]), i, np.int32))
    planes = np.ascontiguousarray(bits.T)
    rare, of = np.concatenate(rare), np.concatenate(of)
    begin = np.searchsorted(of, np.arange(len(used) + 1))
    order = np.argsort(rare, kind="stable")
    listed, ordered = of[order], rare[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    length = np.diff(starts, append=len(rare))
    name = np.empty(len(rare), np.int64)
    name[order] = np.repeat(np.arange(len(starts)), length)
    for p in pairs:
        x, others = np.searchsorted(used, p[0, 0]), np.searchsorted(used, p[1])
        found = np.empty(len(others), np.int64)
        step = max(1, 8 * TILE // width)
        for i in range(0, len(others), step):
            both = planes[:, others[i : i + step]]
            both &= bits[x][:, None]
            found[i : i + step] = np.bitwise_count(both).sum(axis=0, dtype=np.int32)
        own = name[begin[x] : begin[x + 1]]
        own = own[length[own] > 1]
        if len(own):
            n = length[own]
            at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found += np.bincount(listed[at], minlength=len(used))[others]
        yield found


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
    """List by list the rows that come sorted by list and size, and their numbers: those that ``close_pairs`` takes. Lists of one split are left out."""

    def cut(rows: pa.Table) -> Iterator[tuple[pa.Table, dict[str, np.ndarray]]]:
        lists = rows.column("list").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1), len(lists)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            own = rows.slice(i, j - i)
            names, side = np.unique(own.column("split").to_numpy(), return_inverse=True)
            if len(names) > 1:
                given = {c: own.column(c).to_numpy() for c in ("inner", "at", "m")}
                yield own, given | {"node": np.arange(j - i), "side": side, "sketches": np.array([*own.column("sketch").to_pylist(), None], object)[:-1]}

    held = []  # the last list, which may go on in the next batch
    for b in batches:
        if b.num_rows == 0:
            continue
        own = b.column("list").to_numpy()
        edge = int(np.flatnonzero(np.diff(own, prepend=own[0]))[-1]) if own[0] != own[-1] else 0
        if edge or (held and own[0] != held[-1].column("list")[-1].as_py()):
            yield from cut(pa.Table.from_batches([*held, b.slice(0, edge)]))
            held = []
        held.append(b.slice(edge))
    if held:
        yield from cut(pa.Table.from_batches(held))


def _dealt(lists: DataFrame, more: list[str], tasks: int) -> DataFrame:
    """Whole lists, in a fixed number of tasks: the work of a list grows with the pairs in it, not with its bytes."""
    numbers = [F.col(c).cast("long").alias(c) for c in ("inner", "at", "node", "m")]
    return lists.select("list", *numbers, "split", "sketch", *more).repartition(tasks, "list").sortWithinPartitions("list", "m")


def _open(lists: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """(list, inner, at, node): of each list the entries that sketches leave a pair of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, given in _whole(batches):
            some = np.zeros(rows.num_rows, bool)
            for p in close_pairs(**given, threshold=threshold):
                some[p] = True
            yield from rows.select(["list", "inner", "at", "node"]).filter(pa.array(some)).to_batches()

    return _dealt(lists, [], tasks).mapInArrow(run, "list long, inner long, at long, node long")


def _near(lists: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """(left_id, right_id, l, r, score): similar entries of different splits; ``l`` and ``r`` are the nodes of those that stand for several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, given in _whole(batches):
            rows, m, side = rows.combine_chunks(), given["m"], given["side"]
            grams, many = rows.column("grams"), pa.compute.if_else(pa.compute.greater(rows.column("n"), 1), rows.column("node"), pa.scalar(None, pa.int64()))

            def made(hits: list[tuple[np.ndarray, np.ndarray]], ids: pa.ChunkedArray = rows.column("id"), many: pa.ChunkedArray = many) -> pa.RecordBatch:
                left, right = (pa.array(x) for x in np.concatenate([p for p, _ in hits], axis=1))
                columns = [c.take(x).combine_chunks() for c, x in ((ids, left), (ids, right), (many, left), (many, right))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([s for _, s in hits]))], ["left_id", "right_id", "l", "r", "score"])

            for pairs in gathered(close_pairs(**given, threshold=threshold), OPEN):
                hits = []
                for p, both in zip(pairs, shared(lambda x, grams=grams: unpack(grams[x].as_py()), pairs), strict=True):
                    score = both / (m[p[0]] + m[p[1]] - both)
                    p, score = p[:, score >= threshold], score[score >= threshold]
                    hits.append((np.where(side[p[0]] < side[p[1]], p, p[::-1]), score))
                yield from map(made, gathered(hits, TILE, lambda h: len(h[1])))

    kind = lists.schema["id"].dataType.simpleString()
    return _dealt(lists, ["n", "id", "grams"], tasks).mapInArrow(run, f"left_id {kind}, right_id {kind}, l long, r long, score double")


def gathered(parts: Iterable, most: int, size: Callable = lambda p: p.shape[1]) -> Iterator[list]:
    """``parts`` in lists of ``most`` pairs or some more."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += size(p)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def cross_split_near_duplicates(rows: DataFrame, family: str = "query_id", split: str = "split", key: str = "id", text: str = "input", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(left_id, right_id, score): pairs of one family from two splits with similarity of ``threshold`` or more.

    ``left_id`` is the row of the split that comes first in train, val, test (other splits by name).
    """
    rank = F.when(F.col(split) == "train", "0").when(F.col(split) == "val", "1").when(F.col(split) == "test", "2").otherwise(F.col(split))
    texts = rows.select(F.col(key).alias("id"), F.col(family).alias("f"), rank.alias("split"), F.coalesce(text_key(F.col(text)), F.lit("")).alias("k"))
    sets = _sets(texts.where("f IS NOT NULL AND split IS NOT NULL").withColumn("h", F.unhex(F.md5("k"))))
    # One representative for equal texts of a family and split; pairs of texts that occur once are whole, the others meet the members.
    first = sets.groupBy("f", "split", "h").agg(F.min(F.struct("node", "id", "m", "sketch", "grams")).alias("r"), F.count(F.lit(1)).alias("n"))
    entries = materialize(first.select("f", F.lit(0).alias("g"), "split", "h", "n", "r.*"))
    tasks = min(parts_of(rows.sparkSession), 1 + entries.count() // 256)
    # Sketches alone go to all lists; whole sets only to those where they are open with another.
    lists = block_pairs(entries.select("f", "g", "node", "split", "m", "sketch"), threshold, block)
    lists = _open(lists, threshold, tasks).join(entries.select("node", "id", "n", "split", "m", "sketch", "grams"), "node")
    pairs = materialize(_near(lists, threshold, tasks), most=PAIRS)
    members = sets.select("f", "split", "h", "id").join(entries.where("n > 1").select("f", "split", "h", "node"), ["f", "split", "h"]).select("node", "id")
    for at, name in (("l", "left_id"), ("r", "right_id")):
        copies = members.select(F.col("node").alias(at), F.col("id").alias(name))
        pairs = pairs.where(F.col(at).isNull()).drop(at).unionByName(pairs.where(F.col(at).isNotNull()).drop(name).join(copies, at).drop(at))
    return pairs.select("left_id", "right_id", "score")
