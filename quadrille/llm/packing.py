"""Best-fit packing: documents become token ids, and pieces of them fill sequences of a fixed length.

Bounded-space online best-fit: each task keeps a fixed number of open bins in a bitset keyed by free
space. A piece goes to the open bin with the least space that holds it; when a bin too many is open the
fullest closes. What a task leaves underfull is packed again, as whole bins, by ever fewer tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, released
from .wordhash import EXACT, joined, ragged, same_spans, span_hashes, words_of

MAX_LEN = 4096
END_ID = 1
OPEN_BINS = 64
#: Bins filled beyond this share of the length are final after a round.
FULL_SHARE = 0.97
#: Items a task packs in the rounds after the first.
ROUND_ITEMS = 100_000
#: Characters encoded at a time, pieces merged in one call, and the longest of them in bytes.
BATCH, ROWS, LONG = 1 << 21, 4096, 40
#: Fixed value: the pattern of pieces of the tokenizers that are encoded here; any other is left to the library.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Merges:
    """Byte pair merges of many short pieces at once: a row a piece, each step merging every row's best pair."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        seen, spare = {}, 256
        for b in range(256):  # bytes that print stand for themselves, the others for what follows
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
                seen[b] = chr(b)
            else:
                seen[b], spare = chr(spare), spare + 1
        first = np.array([vocab[seen[b]] for b in range(256)] + [vocab[seen[b] + suffix] for b in range(256)], dtype=np.int64)
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.first, self.keys, self.rank = first.astype(np.int32), keys[order], order.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in merges], dtype=np.int32)
        # Ranks of two bytes side by side, the second one within a piece or its last.
        self.start = self._ranks(np.repeat(first[:256], 512), np.tile(first, 256))

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) << 20 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(len(self.keys)))

    def rows(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one piece after the other, number of ids of each) for pieces of ``size`` bytes, rows of the matrix ``raw``."""
        (n, width), none = raw.shape, np.int32(len(self.keys))
        cols = np.arange(width + 1)
        at = raw.astype(np.int32)
        at[np.arange(n), size - 1] += 256
        ids = np.full((n, width + 1), -1, dtype=np.int32)
        ids[:, :width] = self.first[at]
        ids[cols >= size[:, None]] = -1
        rank = np.full((n, width + 1), none, dtype=np.int32)
        rank[:, : width - 1] = self.start[(at[:, :-1] & 255) * 512 + at[:, 1:]]
        rank[cols >= size[:, None] - 1] = none
        done, which = ids.copy(), np.arange(n)
        while len(which):
            row = np.arange(len(which))
            at = rank.argmin(axis=1)
            best = rank[row, at]
            go = best < none
            if not go.all():
                done[which[~go]] = ids[~go]
                ids, rank, which, at, best = ids[go], rank[go], which[go], at[go], best[go]
                row = row[: len(which)]
            tail = (cols > at[:, None])[:, :-1]
            for x, end in ((ids, -1), (rank, none)):
                x[:, :-1] = np.where(tail, x[:, 1:], x[:, :-1])
                x[:, -1] = end
            ids[row, at] = self.made[best]
            rank[row, at] = self._ranks(ids[row, at], ids[row, np.minimum(at + 1, width)])
            before = np.maximum(at - 1, 0)
            rank[row, before] = np.where(at > 0, self._ranks(ids[row, before], ids[row, at]), rank[row, before])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)


class _Encoder:
    """Ids of words of one tokenizer, each distinct word of a batch encoded once.

    Words of ASCII and Latin-1 letters, digits and ASCII marks are cut into pieces by byte classes as the tokenizer's
    file says, and the distinct pieces merged by :class:`_Merges`. All other words, and long pieces, go to the library.
    """

    #: Byte classes: letter, digit, mark, first byte of a Latin-1 letter, its second byte, anything else.
    _LETTER, _DIGIT, _MARK, _LEAD, _NEXT, _ODD = range(6)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        model, cut = form["model"], form["pre_tokenizer"]
        known = [x["type"] for x in form["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut["pretokenizers"]] == ["Split", "ByteLevel"]
        known = known and cut["pretokenizers"][0]["pattern"]["Regex"] == PIECES and model["type"] == "BPE" and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
        self.merges = _Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]) if known else None
        self.marked = any(x["content"][:2] != "<|" for x in form["added_tokens"])
        kind = np.full(256, self._ODD, dtype=np.uint8)
        kind[33:127] = self._MARK
        kind[48:58], kind[97:123], kind[0xC3], kind[0x80:0xC0] = self._DIGIT, self._LETTER, self._LEAD, self._NEXT
        kind[ord("'")] = self._ODD  # it may begin a piece with letters
        self.kind = kind
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(words), ROWS):
            out += [np.asarray(e.ids, dtype=np.int32) for e in self.tok.encode_batch_fast([w.decode("utf-8") for w in words[i : i + ROWS]], add_special_tokens=False)]
        return out

    def _words(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many) for words of ``buffer``."""
        odd = np.ones(len(starts), dtype=bool)
        ids, count, first = np.empty(0, np.int32), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if self.merges is not None:
            raw = self.lower[buffer[ragged(starts, sizes)]]
            word = np.repeat(np.arange(len(starts)), sizes)
            begins = np.cumsum(sizes) - sizes
            kind = self.kind[raw]
            after = np.append(raw[1:], 0).astype(np.uint8)
            lead = kind == self._LEAD
            bad = (kind == self._ODD) | (lead & ((after == 0x97) | (after == 0xB7))) | ((kind == self._NEXT) & ~np.append(False, lead[:-1])) | ((raw == ord("<")) & (after == ord("|")))
            second = np.append(False, lead[:-1])
            raw[second & (raw >= 0x80) & (raw <= 0x9E)] += 0x20
            kind[lead | second] = self._LETTER
            # A piece begins with its word, at a change of class and at every digit.
            cut = np.append(True, kind[1:] != kind[:-1]) | (kind == self._DIGIT)
            cut[begins] = True
            at = np.flatnonzero(cut)
            size = np.diff(np.append(at, len(raw)))
            bad[at[size > LONG]] = True
            odd = np.bincount(word[bad], minlength=len(starts)) > 0
            of = word[at]
            at, size, of = at[~odd[of]], size[~odd[of]], of[~odd[of]]
            _, some, which = np.unique(span_hashes(raw, at, at + size, EXACT), return_index=True, return_inverse=True)
            if not same_spans(raw, at, size, some, which):
                some = which = np.arange(len(at))
            order = np.argsort(size[some], kind="stable")
            parts, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
            padded = np.append(raw, np.zeros(LONG, np.uint8))
            for i in range(0, len(order), ROWS):
                few = some[order[i : i + ROWS]]
                found, n = self.merges.rows(padded[at[few][:, None] + np.arange(size[few[-1]])], size[few])
                parts.append(found), counts.append(n)
            n = np.concatenate(counts)
            of_piece, begin = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
            of_piece[order], begin[order] = n, np.cumsum(n) - n
            ids = np.concatenate(parts)[ragged(begin[which], of_piece[which])]
            count = np.bincount(of, weights=of_piece[which], minlength=len(starts)).astype(np.int64)
            first = np.cumsum(count) - count
        left = np.flatnonzero(odd)
        more = self._library([buffer[starts[i] : starts[i] + sizes[i]].tobytes() for i in left])
        count[left] = [len(x) for x in more]
        first[left] = len(ids) + np.cumsum(count[left]) - count[left]
        return np.concatenate([ids, *more]), first, count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids (little-endian unsigned 32-bit) followed by END_ID.

        The ids of a text are those of its words one after the other: words are cut at ASCII white space
        only, where no token, no composition of characters and no case rule reaches across.
        """
        buffer, offsets = joined(texts)
        exact = self.marked or b"<|" in buffer.tobytes()
        starts, ends, hashes = words_of(buffer, not exact)
        _, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = ends - starts
        if not same_spans(buffer if exact else self.lower[buffer], starts, sizes, some, which):
            some = which = np.arange(len(starts))
        ids, first, count = self._words(buffer, starts[some], sizes[some])
        found = ids[ragged(first[which], count[which])].astype("<u4").tobytes()
        at = np.append(0, np.cumsum(count[which]))[np.searchsorted(starts, offsets)] * 4
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        return [found[i:j] + end for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_loaded: dict[str, _Encoder] = {}


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """For each text its ids (little-endian unsigned 32-bit) followed by END_ID."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = _Encoder(path)
    return _loaded[path].encode(texts)


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about BATCH characters."""
    low = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH:
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without the text, one per piece: piece, start, length and ids (packed bytes).

    Only documents longer than ``max_len`` ids are cut. Null and empty texts are one piece of one id.
    """
    rest = [f for f in docs.schema.fields if f.name not in {text_col, "piece", "start", "length", "ids"}]
    schema = T.StructType([*rest, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    names = [f.name for f in rest]
    width = 4 * max_len

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(text_col).to_pylist()
            for low, high in _batches(texts):
                b = whole.slice(low, high - low)
                row, piece, start, length, ids = [], [], [], [], []
                for i, packed in enumerate(encode_texts(texts[low:high], tokenizer_path)):
                    for k, lo in enumerate(range(0, len(packed), width)):
                        part = packed[lo : lo + width]
                        row.append(i), piece.append(k), start.append(lo // 4), length.append(len(part) // 4), ids.append(part)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(n).take(take) for n in names], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    [*names, "piece", "start", "length", "ids"],
                )

    return docs.select(*names, text_col).mapInArrow(released(cut), schema)


class OpenBins:
    """The open bins of one task. ``bits`` has bit f set while a bin with f free places is open."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next, self.count, self.bits = size, most, first, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _push(self, free: int, name: int) -> None:
        self.by_free.setdefault(free, []).append(name)
        self.bits |= 1 << free
        self.count += 1

    def _pop(self, free: int) -> int:
        names = self.by_free[free]
        name = names.pop()
        if not names:
            self.bits &= ~(1 << free)
        self.count -= 1
        return name

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            name = self._pop(free)
        else:
            free, name = self.size, self.next
            self.next += 1
        if free > length:
            self._push(free - length, name)
            if self.count > self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return name, self.size - free


def best_fit(items: DataFrame, size: int, open_bins: int = OPEN_BINS, level: int = 0) -> DataFrame:
    """``items`` (with a ``length``) with ``bin`` and ``offset``, packed within each partition in its order."""
    schema = T.StructType([*items.schema.fields, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(size, open_bins, (level << 56) | (TaskContext.get().partitionId() << 32))
        for b in batches:
            at = [bins.place(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64())], [*b.schema.names, "bin", "offset"])

    return items.mapInArrow(run, schema)


def pack(pieces: DataFrame, size: int = MAX_LEN, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``size``) with sequence_id and a gapless offset in it.

    The order in a task is by a hash of the row, so it is the same when a lost task runs again.
    """
    columns = [c for c in pieces.columns if c not in ("bin", "offset", "sequence_id")]
    order = F.xxhash64(*columns)
    placed = materialize(best_fit(pieces.select(*columns).repartition(order).sortWithinPartitions(order, *columns), size, open_bins))
    moved: DataFrame | None = None
    level = 1
    left = placed.groupBy("bin").agg(F.sum("length").alias("length"))
    while True:
        left = materialize(left.where(F.col("length") <= int(FULL_SHARE * size)))
        count = left.count()
        if count < 2:
            break
        tasks = -(-count // ROUND_ITEMS)
        shuffled = (left.repartition(tasks, F.xxhash64("bin")) if tasks > 1 else left.coalesce(1)).sortWithinPartitions(F.xxhash64("bin"), "bin")
        step = materialize(best_fit(shuffled.withColumnRenamed("bin", "was"), size, open_bins, level))
        left = step.groupBy("bin").agg(F.sum("length").alias("length"))
        step = step.select("was", "bin", F.col("offset").alias("base"))
        if moved is not None:
            later = step.select(F.col("was").alias("bin"), F.col("bin").alias("__to"), F.col("base").alias("__add"))
            step = moved.join(later, "bin", "left").select("was", F.coalesce("__to", "bin").alias("bin"), (F.col("base") + F.coalesce("__add", F.lit(0))).alias("base"))
        moved = materialize(step)
        if tasks == 1:
            break
        level += 1
    if moved is None:
        return placed.withColumnRenamed("bin", "sequence_id").select(*columns, "sequence_id", "offset")
    to = moved.select(F.col("was").alias("bin"), F.col("bin").alias("__to"), F.col("base").alias("__add"))
    return placed.join(to, "bin", "left").select(*columns, F.coalesce("__to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("__add", F.lit(0))).alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, text_col: str = "text", id_col: str = "doc_id", open_bins: int = OPEN_BINS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each on their own; a null id stays null. An empty table gives none.
    """
    made = token_pieces(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), tokenizer_path, max_len, "__text")
    pieces = materialize(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(pieces, max_len, open_bins)
