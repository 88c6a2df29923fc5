"""Dedup of repeated passages by content-selected windows, exact for every run of MIN_WORDS words.

Every run of MIN_WORDS words has a minimiser: its smallest GRAM-word hash. Equal runs have equal minimisers, so only runs
whose minimiser gram occurs again are looked at. Their 64-bit hashes are dealt by value in packed form: a chunk of documents
sends each distinct hash once, hears which of them another chunk has too, and marks its runs. A run that occurs again is a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flag_ids, id_filter, keep_ids, materialize, released, skew_join
from .wordhash import rolled, word_hashes

MIN_WORDS, GRAM = 50, 10
BLOCK, BLOCKS = 32768, 8192
BUCKETS = 256  # parts the hashes are dealt into, at least
CHUNK = 1 << 20  # runs of a chunk, but for its last document's
TEXTS = 128


def _places(g: np.ndarray) -> np.ndarray:
    """For each run of MIN_WORDS words the place of its minimiser among the gram hashes ``g``; the leftmost of equal ones counts."""
    span = MIN_WORDS - GRAM + 1
    return np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)


def minimisers(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers, and their gram hashes."""
    if len(w) < MIN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = rolled(w, GRAM)
    at = np.unique(_places(g))
    return at, g[at]


def _grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, TEXTS):
                found = [minimisers(w)[1] for w in word_hashes(b.column("text").slice(low, TEXTS).to_pylist(), False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["gram"])

    return docs.select("text").mapInArrow(released(run), "gram long")


def _filter_bits(grams: DataFrame) -> np.ndarray:
    """A bitmap of the grams that occur again; at most BLOCKS blocks of 4 KB whatever the input."""
    again = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    rows, blocks = again.count(), 1
    while blocks * BLOCK < 16 * rows and blocks < BLOCKS:
        blocks *= 2
    # Powers of two, so that signed and unsigned remainders agree.
    slots = again.select(F.pmod(F.col("gram"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.shiftright("gram", 20), F.lit(BLOCK)).cast("int").alias("p"))
    bits = np.zeros(blocks * (BLOCK // 8), dtype=np.uint8)
    for r in slots.groupBy("block").agg(F.bitmap_construct_agg(F.col("p")).alias("bits")).toLocalIterator():
        bits[r["block"] * (BLOCK // 8) : (r["block"] + 1) * (BLOCK // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


_CHUNKS = "chunk long, bucket int, hashes binary, docs binary, texts binary, starts binary, lengths binary, which binary, twice binary"


def _chunks(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Chunks of runs whose minimiser gram occurs again. For each chunk one row a bucket with its distinct hashes, in order, and
    one row of bucket -1: stretches of runs (document, hash of its text, start, length), which distinct hash each run has, and which occur twice here."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    buckets = max(BUCKETS, len(bits) // (BLOCK // 8))
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        blocks = np.uint64(len(bits) // (BLOCK // 8))
        number = TaskContext.get().partitionId() << 33
        hashes: list[np.ndarray] = []
        stretches: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            distinct, which, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            part = (distinct >> shift).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            n = len(first)
            packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(first, len(distinct)) * 8), pa.py_buffer(distinct.tobytes())]).cast(pa.binary())
            own = [np.concatenate([s[k] for s in stretches]).astype(np.int64 if k < 2 else np.int32).tobytes() for k in range(4)]
            own += [which.astype(np.int32).tobytes(), np.packbits(times > 1).tobytes()]
            columns = [pa.array([number] * (n + 1), pa.int64()), pa.array([*part[first].tolist(), -1], pa.int32()), pa.concat_arrays([packed, pa.nulls(1, pa.binary())])]
            columns += [pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([x], pa.binary())]) for x in own]
            hashes.clear(), stretches.clear()
            return pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "hashes", "docs", "texts", "starts", "lengths", "which", "twice"])

        waiting = 0
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                b = whole.slice(low, TEXTS)
                for doc, text, w in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), word_hashes(b.column("text").to_pylist(), False), strict=True):
                    if len(w) < MIN_WORDS:
                        continue
                    g = rolled(w, GRAM)
                    p = (g >> np.uint64(20)) % np.uint64(BLOCK)
                    again = (bits[((g % blocks) * np.uint64(BLOCK // 8) + p // np.uint64(8)).astype(np.int64)] >> (p % np.uint64(8)).astype(np.uint8)) & 1 == 1
                    hit = again[_places(g)]
                    edge = np.flatnonzero(np.diff(hit.view(np.int8), prepend=0, append=0))
                    if not len(edge):
                        continue
                    hashes.append(rolled(w, MIN_WORDS)[hit])
                    stretches.append((np.full(len(edge) // 2, doc), np.full(len(edge) // 2, text), edge[::2], edge[1::2] - edge[::2]))
                    waiting += len(hashes[-1])
                    if waiting >= CHUNK:
                        yield out()
                        number, waiting = number + 1, 0
        if waiting:
            yield out()

    return docs.mapInArrow(released(run), _CHUNKS)


def _shared(bucket: pa.Table) -> pa.Table:
    """(chunk, bucket, hashes) of one bucket with, in place of the hashes, a bit for each: whether another chunk has it too."""
    rows = [np.frombuffer(x, np.uint64) for x in bucket.column("hashes").to_pylist()]
    h = np.concatenate(rows)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(len(h), dtype=bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    at = np.cumsum([0, *map(len, rows)])
    bits = [np.packbits(found[i:j]).tobytes() for i, j in zip(at, at[1:], strict=False)]
    return pa.table({"chunk": bucket.column("chunk"), "bucket": bucket.column("bucket"), "size": pa.array(np.diff(at), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _spans(chunk: pa.Table) -> pa.Table:
    """(doc_id, text_hash, start_word, end_word) of the marked runs of one chunk: its own row and the bits of its buckets."""
    rows = sorted(chunk.to_pylist(), key=lambda r: r["bucket"])
    own = rows[0]
    read = lambda name, kind: np.frombuffer(own[name], kind)
    marked = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["size"]) for r in rows[1:]])
    marked = marked | np.unpackbits(read("twice", np.uint8), count=len(marked))
    docs, texts, starts, lengths = read("docs", np.int64), read("texts", np.int64), read("starts", np.int32).astype(np.int64), read("lengths", np.int32).astype(np.int64)
    # One unmarked place between stretches, so that marks of two documents don't meet.
    begin = np.cumsum(lengths + 1) - lengths - 1
    stretch = np.repeat(np.arange(len(lengths)), lengths)
    line = np.zeros(int((lengths + 1).sum()), dtype=np.int8)
    line[np.arange(len(stretch)) + stretch] = marked[read("which", np.int32)]
    edge = np.flatnonzero(np.diff(line, prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    at = np.searchsorted(begin, first, side="right") - 1
    start = starts[at] + first - begin[at]
    return pa.table({"doc_id": pa.array(docs[at], pa.int64()), "text_hash": pa.array(texts[at], pa.int64()), "start_word": pa.array(start, pa.int64()), "end_word": pa.array(start + (last - first) + MIN_WORDS - 1, pa.int64())})


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and adjoining spans of a document become one."""
    w = Window.partitionBy("doc_id", "text_hash").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.distinct().withColumn("__new", F.when(F.coalesce(F.col("start_word") <= reach, F.lit(False)), 0).otherwise(1))
    return cut.withColumn("__k", F.sum("__new").over(w)).groupBy("doc_id", "text_hash", "__k").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("__k")


def repeated_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, start_word, end_word): maximal spans of words that lie in a repeated passage, every occurrence.

    Words are cut at ASCII white space. A repeat within one document counts. Null texts and
    texts below MIN_WORDS words have none; rows without an id are left out. An empty table gives none. Rows of one id with
    different texts are different documents, told apart by ``text_hash``; rows that agree in both have the same spans, once.
    Texts of any length are taken whole. Other columns are not looked at.
    """
    docs = _keyed(docs, text_col, id_col).where("doc_id IS NOT NULL")
    chunks = materialize(_chunks(docs, _filter_bits(_grams(docs))))
    shared = chunks.where("bucket >= 0").select("chunk", "bucket", "hashes").groupBy("bucket").applyInArrow(_shared, "chunk long, bucket int, size int, bits binary")
    own = chunks.where("bucket < 0").drop("hashes")
    return merge_spans(own.unionByName(shared, allowMissingColumns=True).groupBy("chunk").applyInArrow(_spans, "doc_id long, text_hash long, start_word long, end_word long"))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text_hash, text)"""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def _windows(marked: DataFrame) -> DataFrame:
    """(hash, doc_id, text_hash, start) of each run of MIN_WORDS words inside the spans of (doc_id, text_hash, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, row, start = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, (w, spans) in enumerate(zip(word_hashes(b.column("text").to_pylist(), False), b.column("spans"), strict=True)):
                h = rolled(w, MIN_WORDS)
                for s in spans.as_py():
                    at = np.arange(s["start_word"], s["end_word"] - MIN_WORDS + 1)
                    hashes.append(h[at]), row.append(np.full(len(at), i)), start.append(at)
            of = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), b.column("doc_id").take(of), b.column("text_hash").take(of), pa.array(np.concatenate(start))], ["hash", "doc_id", "text_hash", "start"])

    return marked.mapInArrow(released(run), "hash long, doc_id long, text_hash long, start long")


def later_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, start_word, end_word): words of found passages whose MIN_WORDS-word run occurs earlier, by (doc_id, text_hash, place).

    Rows that agree in id and text count as one document, of which no row is later than another."""
    of, place = ["doc_id", "text_hash"], F.struct("doc_id", "text_hash", "start")
    spans = materialize(repeated_passages(docs, text_col, id_col).groupBy(*of).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")))
    marked = keep_ids(_keyed(docs, text_col, id_col), "doc_id", spans.select("doc_id").distinct()).join(spans, of).dropDuplicates(of)
    runs = materialize(_windows(marked))
    first = runs.groupBy("hash").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = skew_join(runs, first, ["hash"], F.xxhash64("doc_id", "start"), runs.count(), "inner").where(place != F.col("f"))
    return merge_spans(later.select(*of, F.col("start").alias("start_word"), (F.col("start") + MIN_WORDS).alias("end_word")))


def _without(text: str, spans: list[dict]) -> str:
    """``text`` without the words of ``spans``; white space before a removed word goes with it."""
    import re

    gone = np.zeros(max(s["end_word"] for s in spans), dtype=bool)
    for s in spans:
        gone[s["start_word"] : s["end_word"]] = True
    out, last = [], 0
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if i >= len(gone) or not gone[i]:
            out.append(text[last : m.end()])
        last = m.end()
    return "".join([*out, text[last:]]).strip(" \t\n\x0b\x0c\r")


def drop_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with later copies of repeated passages cut out of the texts; columns unchanged.

    A document left without a word goes; all others stay, those without a copy untouched and unshuffled.
    Rows without an id stay untouched; rows of one id with different texts are cut each by its own spans. Where the table has a column n_chars it is set anew for cut texts.
    """
    found = later_copies(docs, text_col, id_col).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"))
    spans = materialize(found.agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans")))
    flagged = flag_ids(docs.withColumn("__id", F.col(id_col).cast("long")), "__id", id_filter(spans.select("__id"), spans.count()))
    same = flagged.where(~F.col("__hit")).select(*docs.columns)
    hit = flagged.where("__hit").withColumn("__text", F.xxhash64(text_col)).join(spans, ["__id", "__text"], "left").select(*docs.columns, "__spans")
    at, size = docs.columns.index(text_col), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns[:-1]
            found = [t if s is None or t is None else _without(t, s) for t, s in zip(columns[at].to_pylist(), b.column("__spans").to_pylist(), strict=True)]
            kept = pa.array([s is None or t != "" for t, s in zip(found, b.column("__spans").to_pylist(), strict=True)], pa.bool_())
            if size is not None:
                n = [c if s is None else len(t or "") for t, c, s in zip(found, columns[size].to_pylist(), b.column("__spans").to_pylist(), strict=True)]
                columns[size] = pa.array(n, columns[size].type)
            columns[at] = pa.array(found, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(kept)

    return same.unionByName(hit.mapInArrow(released(cut), docs.schema))
