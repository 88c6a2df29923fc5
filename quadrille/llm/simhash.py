"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance, compared bit-sliced.

Equal fingerprints are one node. Nodes that can be within the radius agree on two of radius + 2 bands of bits, so a node is
sent to one group for each pair of bands. A group of more than LIMIT nodes is cut further by the bits that it leaves open: two
nodes within the radius agree on one of radius + 1 parts of these. After at most three cuts so few bits are open that
LIMIT nodes can't be passed, so no task ever holds a large group and every node is compared with a bounded number of others.

Within a group the nodes' bits are stored as planes: one 64-bit word holds one bit of 64 nodes. The distances of a node to 64
others grow together by carry-save addition, and a block of 64 is abandoned once all its counters have passed the radius.
What leaves a task is a forest of links, not all pairs.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like others. Texts of fewer words than a shingle
have the whole sequence as one. Rows may repeat, ids too; a component's id is its smallest id that is not null.
Long texts are hashed in pieces. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_join, components, materialize, released, skew_join
from .wordhash import ragged

BITS = 64
RADIUS = 2
WIDTH = 3  # words of a shingle
LIMIT = 1024  # nodes of a group that is compared
SEED = 42
TEXTS, PIECE = 256, 1 << 16
#: Lanes compared at a time (a node with one other is a lane), but for a group's own.
LANES = 1 << 21

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = WIDTH) -> tuple[int, int]:
    """(fingerprint, number of shingles): a bit is set when it is set in over half the hashes of the shingles."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return 0, 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(len(words) - width + 1, 1)
    starts, stops = np.append(0, ends)[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for low in range(0, n, PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + PIECE], stops[low : low + PIECE], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]), n


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n_shingles) of every row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                b = whole.slice(low, TEXTS)
                found = [fingerprint(t, width) for t in b.column("text").to_pylist()]
                fp = pa.array(np.array([f for f, _ in found], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp, pa.array([n for _, n in found], pa.int64())], ["doc_id", "fp", "n_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), f"doc_id {kind}, fp long, n_shingles long")


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of so many parts of the bits, as signed numbers."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def group_masks(radius: int) -> list[int]:
    """Two nodes within the radius agree on all bits of one of these masks at least: on two of radius + 2 bands."""
    return [a | b for a, b in combinations(_cut(list(range(BITS)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """Two nodes that agree on ``mask`` and are within the radius agree on one of these, too."""
    return [mask | part for part in _cut([b for b in range(BITS) if not mask >> b & 1], radius + 1)]


def _keyed(rows: DataFrame, masks: dict[int, list[int]] | list[int]) -> DataFrame:
    """(mask, value, fp): each row once for each mask; a dict gives the masks that follow a row's present one."""
    if isinstance(masks, dict):
        table = [(_signed(old), [_signed(m) for m in new]) for old, new in masks.items()]
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, "mask long, following array<long>")), "mask")
        following = F.col("following")
    else:
        following = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
    return rows.select("fp", F.explode(following).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def near_lanes(fps: np.ndarray, ends: np.ndarray, planes: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j < ends[i], of rows within the radius, looking at the given bits only; by bit planes.

    Counters start where the radius + 1st difference overflows them. Every eight planes the blocks whose lanes have all overflowed are left out.
    """
    m = len(fps)
    lanes = np.zeros((BITS, -(-m // 64) * 64), np.uint8)
    lanes[:, :m] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little").T
    vertical = np.packbits(lanes, axis=1, bitorder="little").view("<u8").astype(np.uint64)
    rows = np.arange(m)
    first, last = (rows + 1) // 64, (ends - 1) // 64
    counts = np.where(rows + 1 < ends, last - first + 1, 0)
    q, w = np.repeat(rows, counts), ragged(first, counts)
    # Lanes up to the row itself and behind its group count as passed.
    low, high = np.clip(q + 1 - 64 * w, 0, 64).astype(np.uint64), np.clip(ends[q] - 64 * w, 0, 64).astype(np.uint64)
    below = lambda n: np.where(n < 64, (_ONE << np.minimum(n, np.uint64(63))) - _ONE, _ALL)
    over = ~(below(high) & ~below(low))
    size = (radius + 1).bit_length()
    start = (1 << size) - 1 - radius
    counters = [np.full(len(q), _ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
    for step, bit in enumerate(planes):
        asked = np.uint64(0) - ((fps[q] >> np.uint64(bit)) & _ONE)
        carry = vertical[bit][w] ^ asked
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if step % 8 == 7 and not (open_ := over != _ALL).all():
            q, w, over, counters = q[open_], w[open_], over[open_], [c[open_] for c in counters]
    pair, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[pair], 64 * w[pair] + lane


def _leaders(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it reaches by the pairs."""
    lead = np.arange(m)
    while len(i):
        least = np.minimum(lead[i], lead[j])
        new = lead.copy()
        np.minimum.at(new, i, least), np.minimum.at(new, j, least)
        new = new[new]
        if (new == lead).all():
            break
        lead = new
    return lead


def _compare(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b) for rows (mask, value, fp): in each group a node and the first node that it reaches within the group."""

    def found(mask: int, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All rows are of one mask; groups lie together and are whole."""
        edge = np.flatnonzero(np.diff(value, prepend=~value[:1]))
        sizes = np.diff(np.append(edge, len(value)))
        edge, sizes = edge[sizes > 1], sizes[sizes > 1]
        planes, at = [b for b in range(BITS) if not mask >> b & 1], 0
        work = np.cumsum(sizes * sizes)
        while at < len(edge):
            stop = max(int(np.searchsorted(work, (work[at - 1] if at else 0) + LANES, "right")), at + 1)
            own = ragged(edge[at:stop], sizes[at:stop])
            f, ends = fp[own].view(np.uint64), np.repeat(np.cumsum(sizes[at:stop]), sizes[at:stop])
            lead = _leaders(len(f), *near_lanes(f, ends, planes, radius))
            moved = lead != np.arange(len(f))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(f[moved].view(np.int64)), pa.array(f[lead[moved]].view(np.int64))], ["a", "b"])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # the last group, which may go on in the next batch
        for b in batches:
            held = [np.concatenate([h, b.column(n).to_numpy(zero_copy_only=False)]) for h, n in zip(held, ("mask", "value", "fp"), strict=True)]
            if not len(held[0]):
                continue
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            whole = int(new[-1]) if len(new) else 0
            yield from by_mask(*[h[:whole] for h in held])
            held = [h[whole:] for h in held]
        yield from by_mask(*held)

    def by_mask(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(mask)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(mask)], strict=True):
            if hi > lo:
                yield from found(int(mask[lo]) & int(_ALL), value[lo:hi], fp[lo:hi])

    return groups.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(released(run), "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(a, b) over distinct fingerprints ``nodes`` (fp): enough links within the radius to connect all that are connected."""
    n, limit = nodes.count(), max(limit, 1 << radius)  # so many nodes differ in as many bits as the radius has at most
    masks = group_masks(radius)
    groups, out = _keyed(nodes, masks), None
    while True:
        big = materialize(groups.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("mask", "value", F.lit(True).alias("big")))
        some = big.limit(1).count() > 0
        marked = bounded_join(groups, big, ["mask", "value"], F.xxhash64("fp"), n * len(masks)) if some else groups
        near = _compare((marked.where("big IS NULL") if some else marked).select("mask", "value", "fp"), radius)
        out = near if out is None else out.unionByName(near)
        if not some:
            return out
        finer = {m: finer_masks(m, radius) for m in masks}
        groups = materialize(_keyed(marked.where("big"), finer).distinct())  # two masks may become one
        masks = sorted({m for ms in finer.values() for m in ms})


def similar_fingerprints(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, n_shingles, component_id) of every row: component_id is the smallest id reachable by links."""
    rows = materialize(fingerprints(docs, width).withColumn("row", F.monotonically_increasing_id()))
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(nodes.select("fp"), radius, limit))
    label = materialize(label.withColumnRenamed("node", "fp").join(nodes, "fp"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = skew_join(label, least, ["component"], F.xxhash64("fp"), label.count()).select("fp", "component_id")
    own = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    found = skew_join(rows, own, ["fp"], F.xxhash64("row"), rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component, that of its component id; ids must be unique."""
    kept = similar_fingerprints(docs, **how).where("doc_id = component_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
