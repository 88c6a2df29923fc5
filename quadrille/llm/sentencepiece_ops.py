"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece reaches across. Every distinct unit of the corpus is encoded once: its substrings of
bounded length are exploded and equi-joined to the piece table (broadcast: as large as the vocabulary file), the edges
are grouped by unit, and a fold with Spark's ``aggregate`` takes the best path (Viterbi).

Units and ids travel in packed form. A chunk of documents sends each of its distinct units once, to the bucket of its
hash; a bucket lists its distinct units and says which of them each chunk has; the ids come back by chunk. So no
document is shuffled as text, and no unit of any frequency is a row for each of its places.

The public model file is of the BPE kind. Its segmentation is made by merges and is no best path of any score, so the best path
under its scores gives other ids for some units. ``method="merges"`` gives the library's ids by merging each distinct unit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, materialize, released, setting
from .wordhash import EXACT, mix, ragged, same_spans, span_hashes

SPACE = "▁"
#: Units of a chunk, bytes of text cut at a time, documents to a bucket and buckets at least.
CHUNK, BATCH, DOCS_A_BUCKET, BUCKETS = 1 << 20, 1 << 22, 4096, 64
#: Units up to this many characters take the lattice, so many of them in a task; longer ones take the same fold in a loop.
LONG, UNITS_A_TASK = 64, 5_000
STOPS = b".,;:!?"
RUN = 4  # stops looked back over one by one
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(STOPS)] = True
_ALONE = np.zeros(256, dtype=bool)  # control characters but the carriage return
_ALONE[0:32] = _ALONE[127] = True
_ALONE[13] = False


class Model:
    """Pieces of a model file: (id, piece, score), and where bytes begin."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte0 = next((i for i in range(n) if sp.is_byte(i)), -1)
        self.unknown, self.size = sp.unk_id(), n
        self.longest = max(len(p) for _, p, _ in self.pieces)
        self.worst = min(s for *_, s in self.pieces if s > -1e8) - 10.0
        across = rf"[^{SPACE}]{SPACE}|.[\x00-\x0c\x0e-\x1f\x7f]|[\x00-\x0c\x0e-\x1f\x7f].|[A-Za-z][{re.escape(STOPS.decode())}]"
        if any(re.search(across, p, re.DOTALL) for _, p, _ in self.pieces):
            raise ValueError("pieces reach across units")
        self.raw = [b""] * n
        for i, p, _ in self.pieces:
            self.raw[i] = p.replace(SPACE, " ").encode("utf-8")
        if self.byte0 >= 0:
            self.raw[self.byte0 : self.byte0 + 256] = [bytes([b]) for b in range(256)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i, float(s)) for i, p, s in self.pieces], "piece string, id int, score double")

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte0 + b for b in char.encode("utf-8")] if self.byte0 >= 0 else [self.unknown]


def cut_units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, units of each text): the texts in UTF-8, each with a space before it, cut before each run of spaces, around
    control characters and before the stops that end a unit after a letter. Null and empty texts have no unit."""
    raw = [b" " + t.encode("utf-8", "replace").replace(SPACE.encode(), b" ") if t else b"" for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    space, alone = buffer == 32, _ALONE[buffer]
    begin = (space & ~np.append(False, space[:-1])) | alone | np.append(False, alone[:-1])
    begin[offsets[:-1][offsets[:-1] < len(buffer)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(buffer))[: len(starts)]
    # Where the stops at a unit's end begin, if a letter stands before them.
    at = ends[_STOP[buffer[ends - 1]]] - 1
    for _ in range(RUN):
        at = at - _STOP[buffer[at - 1]]
    if _STOP[buffer[at - 1]].any():  # longer runs: the last other byte before each place
        at = np.maximum.accumulate(np.where(_STOP[buffer], 0, np.arange(len(buffer))))[at] + 1
    begin[at[_LETTER[buffer[at - 1]]]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(buffer))[: len(starts)]
    return buffer, starts, ends, np.diff(np.searchsorted(starts, offsets))


def units(text: str | None) -> list[str]:
    """The units of a text, spaces shown as ▁."""
    buffer, starts, ends, _ = cut_units([text])
    return [buffer[i:j].tobytes().decode("utf-8").replace(" ", SPACE) for i, j in zip(starts, ends, strict=True)]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.compress(np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts), 3)


def _unpack(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    ends = 8 * n + np.cumsum(np.frombuffer(raw, "<i8", n))
    return [raw[i:j] for i, j in zip([8 * n, *ends.tolist()], ends.tolist(), strict=False)]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes as their first bytes, then the second ones and so on: the upper bytes of small numbers pack to nothing."""
    return np.ascontiguousarray(numbers.astype("<i4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, batch: int) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, rows, bytes, starts and ends of the distinct units in order of their hash, hashes, which unit each place has, units of each row).

    Which rows make a chunk follows from the order of the rows of a task alone."""
    number, waiting, held = TaskContext.get().partitionId() << 33, 0, []

    def out():
        rows = pa.Table.from_batches([b for b, *_ in held])
        shift = np.cumsum([0, *[len(c[0]) for _, c in held]])
        buffer = np.concatenate([c[0] for _, c in held])
        starts, ends = (np.concatenate([c[k] + s for (_, c), s in zip(held, shift, strict=False)]) for k in (1, 2))
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        for _, c in held:
            hashes[at : at + len(c[1])] = span_hashes(c[0], c[1], c[2], EXACT)
            at += len(c[1])
        kinds, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        if not same_spans(buffer, starts, ends - starts, some, which):
            some = np.argsort(hashes, kind="stable")
            kinds, which = hashes[some], np.argsort(some)
        counts = np.concatenate([c[3] for _, c in held])
        held.clear()
        return number, rows, buffer, starts[some], ends[some], kinds, which, counts

    for whole in batches:
        texts, low, size = whole.column("text").to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= batch or i == len(texts) - 1:
                cut = cut_units(texts[low : i + 1])
                held.append((whole.slice(low, i + 1 - low), cut))
                waiting, low, size = waiting + len(cut[1]), i + 1, 0
                if waiting >= chunk:
                    yield out()
                    number, waiting = number + 1, 0
    if held:
        yield out()


def _buckets(rows: int) -> int:
    n = BUCKETS
    while n * DOCS_A_BUCKET < rows:
        n *= 2
    return n


def _proof(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each stretch of a chunk's distinct units a sum over their hashes, by which a second reading shows that it is the same chunk."""
    return np.add.reduceat(mix(kinds), first).view(np.int64) if len(first) else np.empty(0, np.int64)


def _asked(docs: DataFrame, buckets: int, chunk: int, batch: int) -> DataFrame:
    """Two kinds of rows: (bucket, no, unit) has the distinct units, numbered within their bucket; (bucket, chunk, has, proof) the packed numbers of a
    chunk's units there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, buffer, starts, ends, kinds, *_ in _chunks(batches, chunk, batch):
            part = (kinds >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            sizes = ends - starts
            blobs = []
            for i, j in zip(first, np.append(first[1:], len(part)), strict=False):
                blobs.append(_pack(_planes(sizes[i:j]), buffer[ragged(starts[i:j], sizes[i:j])]))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(first), pa.int64()), pa.array(part[first], pa.int32()), pa.array(blobs, pa.binary()), pa.array(_proof(kinds, first))], ["chunk", "bucket", "units", "proof"])

    def number(bucket: pa.Table) -> pa.Table:
        blobs = [_unpack(x, 2) for x in bucket.column("units").to_pylist()]
        sizes = [_from_planes(x).astype(np.int64) for x, _ in blobs]
        buffer, size = np.frombuffer(b"".join([raw for _, raw in blobs]), np.uint8), np.concatenate(sizes)
        starts = np.cumsum(size) - size
        _, some, which = np.unique(span_hashes(buffer, starts, starts + size, EXACT), return_index=True, return_inverse=True)
        if not same_spans(buffer, starts, size, some, which):
            some = which = np.arange(len(size))
        # Units are numbered in order of their hash, as each chunk has them: steps from one to the next are small.
        ends = np.cumsum([0, *map(len, sizes)]).tolist()
        has = [_pack(_planes(np.diff(which[i:j], prepend=0))) for i, j in zip(ends, ends[1:], strict=False)]
        units = [buffer[i : i + n].tobytes().decode("utf-8").replace(" ", SPACE) for i, n in zip(starts[some].tolist(), size[some].tolist(), strict=True)]
        b, n, m = bucket.column("bucket")[0].as_py(), len(units), len(has)
        return pa.table({
            "bucket": pa.array([b] * (n + m), pa.int32()), "no": pa.array([*range(n), *[None] * m], pa.int32()), "unit": pa.array([*units, *[None] * m], pa.string()),
            "chunk": pa.array([*[None] * n, *bucket.column("chunk").to_pylist()], pa.int64()), "has": pa.array([*[None] * n, *has], pa.binary()), "proof": pa.array([*[None] * n, *bucket.column("proof").to_pylist()], pa.int64()),
        })

    asked = docs.mapInArrow(released(ask), "chunk long, bucket int, units binary, proof long")
    return asked.groupBy("bucket").applyInArrow(number, "bucket int, no int, unit string, chunk long, has binary, proof long")


def best_path(unit: str, model: Model, table: dict[str, tuple[int, float]]) -> list[int]:
    """The ids of the path of the highest score through all pieces of a unit; of equal ones that of the longer last piece."""
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]
    for e in range(1, len(unit) + 1):
        top = None
        for s in range(max(0, e - model.longest), e):
            i, score = table.get(unit[s:e], (-1, model.worst if e - s == 1 else 0.0))
            if (i >= 0 or e - s == 1) and (top is None or best[s][0] + score > top[0]):
                top = (best[s][0] + score, s, i)
        best.append(top)
    out, e = [], len(unit)
    while e:
        _, s, i = best[e]
        out.append([i] if i >= 0 else model.bytes_of(unit[s:e]))
        e = s
    return [i for ids in reversed(out) for i in ids]


def _fold(edges: Column, n: Column) -> Column:
    """The ids of :func:`best_path`, -1 - place for a character without a piece, from the edges in order of (end, start)."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(-1).alias("id")))

    def step(best: Column, x: Column) -> Column:
        # Of equal scores the edge from furthest back stays.
        score = F.get(best, x["s"])["score"] + x["score"]
        here = F.array(F.struct(score.alias("score"), x["s"].alias("s"), x["id"].alias("id")))
        return F.when(F.size(best) == x["e"], F.concat(best, here)).when(score > F.get(best, x["e"])["score"], F.concat(F.slice(best, F.lit(1), x["e"]), here)).otherwise(best)

    def back(best: Column) -> Column:
        none = F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids"))

        def one(acc: Column, _: Column) -> Column:
            take = lambda x: F.struct(x["s"].alias("at"), F.concat(F.array(F.when(x["id"] >= 0, x["id"]).otherwise(-1 - x["s"])), acc["ids"]).alias("ids"))
            return F.when(acc["at"] == 0, acc).otherwise(take(F.get(best, acc["at"])))

        return F.aggregate(F.sequence(F.lit(1), n), none, one)["ids"]

    return let(F.aggregate(edges, start, step), back)


def lattice_ids(distinct: DataFrame, model: Model) -> DataFrame:
    """``distinct`` (unit and other columns, each unit once) with ids: explode, join, group and fold."""
    rest = [c for c in distinct.columns if c != "unit"]
    n = F.length("unit")
    # Ends, then lengths, are rows of their own, so that all of this is compiled.
    ends = distinct.select("unit", *rest, F.explode(F.sequence(F.lit(1), n)).alias("e"))
    spans = ends.select("unit", *rest, "e", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("e")))).alias("k"))
    spans = spans.select("unit", *rest, "e", "k", F.substring("unit", F.col("e") - F.col("k") + 1, F.col("k")).alias("piece"))
    edges = spans.join(F.broadcast(model.table(distinct.sparkSession)), "piece", "left").where(F.col("id").isNotNull() | (F.col("k") == 1))
    edge = F.struct("e", (F.col("e") - F.col("k")).alias("s"), F.coalesce("score", F.lit(model.worst)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    found = edges.groupBy("unit").agg(*[F.first(c).alias(c) for c in rest], F.sort_array(F.collect_list(edge)).alias("edges"))

    def char(i: Column) -> Column:
        if model.byte0 < 0:
            return F.array(F.lit(model.unknown))
        raw = F.encode(F.substring(F.col("unit"), -i, F.lit(1)), "UTF-8")
        return F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10).cast("int") + model.byte0)

    spelled = lambda ids: F.when(F.exists(ids, lambda i: i < 0), F.flatten(F.transform(ids, lambda i: F.when(i >= 0, F.array(i)).otherwise(char(i))))).otherwise(ids)
    return found.select("unit", *rest, let(_fold(F.col("edges"), n), spelled).alias("ids"))


def _each(distinct: DataFrame, encode) -> DataFrame:
    """``distinct`` with ids by a function of the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([encode(u) for u in b.column("unit").to_pylist()], pa.list_(pa.int32()))], [*b.schema.names, "ids"])

    return distinct.mapInArrow(run, T.StructType([*distinct.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_units(distinct: DataFrame, model: Model, method: str = "viterbi") -> DataFrame:
    """``distinct`` (unit and other columns) with ids, by the lattice or by merges."""
    if method == "merges":
        rank = {s: r for r, s in enumerate(sorted({s for *_, s in model.pieces}, reverse=True))}
        table = {p: (i, rank[s]) for i, p, s in model.pieces}
        return _each(distinct, lambda u: merged(u, table, model))
    if method != "viterbi":
        raise ValueError(f"unknown method {method!r}")
    spark, tasks = distinct.sparkSession, max(1, -(-distinct.count() // UNITS_A_TASK))
    short = distinct.where(F.length("unit") <= LONG).repartition(tasks, "unit")
    table = {p: (i, s) for i, p, s in model.pieces}
    # Lists of a task's units are held side by side; sorting them would cost more than the fold.
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * UNITS_A_TASK)):
        found = materialize(lattice_ids(short, model).select(*distinct.columns, "ids"))
    return found.unionByName(_each(distinct.where(F.length("unit") > LONG), lambda u: best_path(u, model, table)))


def merged(unit: str, table: dict[str, tuple[int, int]], model: Model) -> list[int]:
    """The library's ids of one unit of a BPE model, by a heap of adjacent pairs in order of (rank, place)."""
    part: list[str | None] = list(unit)
    left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
    heap: list[tuple[int, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0:
            both = part[i] + part[right[i]]
            if both in table:
                heapq.heappush(heap, (table[both][1], i, both))

    for i in range(len(part)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i] if part[i] is not None else -1
        if j < 0 or part[j] is None or part[i] + part[j] != both:
            continue
        part[i], part[j], right[i] = both, None, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out: list[int] = []
    for p in part:
        if p is not None:
            out += [table[p][0]] if p in table else model.bytes_of(p)
    return out


def _spelling(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, and where each one's begin and how many they are."""
    sizes = np.array([len(r) for r in model.raw], dtype=np.int64)
    return np.frombuffer(b"".join(model.raw), np.uint8), np.cumsum(sizes) - sizes, sizes


def _spelt(spelling: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """The texts of id sequences that end at ``ends`` (from 0), without the space put before each."""
    raw, first, sizes = spelling
    spelt = raw[ragged(first[ids], sizes[ids])].tobytes()
    at = np.append(0, np.cumsum(sizes[ids]))[ends].tolist()
    return [spelt[i + (spelt[i : i + 1] == b" ") : j].decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)]


def encode_documents(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", method: str = "viterbi", decoded: bool = False, chunk: int = CHUNK, batch: int = BATCH) -> DataFrame:
    """(doc_id, text_sha256, ids): the whole token sequence of every row, with the digest (binary) of its text in UTF-8; with
    ``decoded`` also the text that :func:`decode` makes of the ids.

    ``docs`` is read twice and must come in the same order both times, as files do; a chunk that has other units at the second
    reading is an error (their hashes are summed and compared). ``chunk`` and ``batch`` bound what a task holds: units of a chunk, characters cut at once.
    Null and empty texts have no ids. Rows without an id and repeated rows are encoded each. Texts are cut whole, however
    long; a unit beyond LONG characters takes the same fold in a loop. An empty table gives an empty table. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_sha256"), text.alias("text"))
    buckets = _buckets(docs.count())
    asked = materialize(_asked(docs, buckets, chunk, batch))
    known = materialize(encode_units(asked.where("unit IS NOT NULL").select("bucket", "no", "unit"), model, method).select("bucket", "no", "ids"))
    kind = "<u2" if model.size <= 1 << 16 else "<u4"

    def reply(has: pa.Table, ids: pa.Table) -> pa.Table:
        number = ids.column("no").to_numpy()
        lists = ids.column("ids").combine_chunks()
        flat, offsets = lists.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
        place = np.empty(len(number), np.int64)
        place[number] = np.arange(len(number))
        counts = np.diff(offsets)
        blobs = []
        for blob in has.column("has").to_pylist():
            at = place[np.cumsum(_from_planes(_unpack(blob, 1)[0]))]
            blobs.append(_pack(_planes(counts[at]), flat[ragged(offsets[at], counts[at])].astype(kind)))
        return pa.table({"chunk": has.column("chunk"), "bucket": has.column("bucket"), "ids": pa.array(blobs, pa.binary()), "proof": has.column("proof")})

    replies = asked.where("unit IS NULL").select("bucket", "chunk", "has", "proof").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(reply, "chunk long, bucket int, ids binary, proof long")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, _, _, _, kinds, which, counts in _chunks(batches, chunk, batch):
            sink = pa.BufferOutputStream()
            with ipc.new_stream(sink, rows.select(["doc_id", "text_sha256"]).schema) as writer:
                writer.write_table(rows.select(["doc_id", "text_sha256"]))
            # Units are named by their rank in frequency, most names are small then; ``order`` leads back.
            order = np.argsort(-np.bincount(which, minlength=len(kinds)), kind="stable")
            rank = np.empty(len(kinds), np.int64)
            rank[order] = np.arange(len(kinds))
            packed = _pack(_planes(rank[which]), _planes(order), _planes(counts), sink.getvalue().to_pybytes())
            proof = pa.array(_proof(kinds, np.zeros(min(len(kinds), 1), np.int64)).tolist() or [0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(kinds)], pa.int64()), proof, pa.array([packed], pa.binary())], ["chunk", "kinds", "proof", "coded"])

    coded = docs.mapInArrow(released(code), "chunk long, kinds long, proof long, coded binary")
    held = docs.sparkSession.sparkContext.broadcast(_spelling(model)) if decoded else None

    def fill(own: pa.Table, heard: pa.Table) -> pa.Table:
        which, order, counts, rows = _unpack(own.column("coded")[0].as_py(), 4)
        parts = [_unpack(x, 2) for _, x in sorted(zip(heard.column("bucket").to_pylist(), heard.column("ids").to_pylist(), strict=True))]
        size = np.concatenate([np.empty(0, "<i4"), *[_from_planes(p[0]) for p in parts]]).astype(np.int64)
        ids = np.concatenate([np.empty(0, kind), *[np.frombuffer(p[1], kind) for p in parts]])
        proof = heard.column("proof").to_numpy().astype(np.int64).sum(dtype=np.int64)
        if len(size) != own.column("kinds")[0].as_py() or proof != own.column("proof")[0].as_py():
            raise RuntimeError("a chunk was cut in two ways: its rows come in no fixed order")
        which, counts = _from_planes(order)[_from_planes(which)], _from_planes(counts).astype(np.int64)
        got = ids[ragged((np.cumsum(size) - size)[which], size[which])].astype(np.int32)
        ends = np.append(0, np.cumsum(size[which]))[np.append(0, np.cumsum(counts))]
        table = ipc.open_stream(rows).read_all().append_column("ids", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got, pa.int32())))
        return table if held is None else table.append_column("decoded", pa.array(_spelt(held.value, got, ends), pa.string()))

    return coded.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(fill, "doc_id long, text_sha256 binary, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: their pieces' bytes, spaces for ▁, without the space put before the text.

    Ids of no piece and null lists give nothing. Bytes that make no character are replaced."""
    held = encoded.sparkSession.sparkContext.broadcast(_spelling(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column(ids_col)), 0).to_numpy()
            texts = _spelt(held.value, b.column(ids_col).flatten().to_numpy(), np.append(0, np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    return encoded.mapInArrow(released(run), T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


def document_codes(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", method: str = "viterbi") -> DataFrame:
    """Per row: doc_id, n_tokens, n_bytes (ids of byte pieces), ids_sha256 of the id sequence written with commas, decoded_sha256 of
    the text decoded from it, exact: whether that is the text. A text that holds ▁ itself decodes with a space there, as in the library.

    The ids are those of :func:`encode_documents`, the text is that of :func:`decode`. Null texts count as empty. Repeated rows stay.
    """
    decoded = encode_documents(docs, model, text_col, id_col, method, decoded=True)
    is_byte = (lambda x: (x >= model.byte0) & (x < model.byte0 + 256)) if model.byte0 >= 0 else (lambda x: F.lit(False))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    got = decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.size(F.filter("ids", is_byte)).cast("long").alias("n_bytes"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "text_sha256")
    return got.select("doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", (F.col("decoded_sha256") == F.lower(F.hex("text_sha256"))).alias("exact"))
