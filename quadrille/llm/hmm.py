"""LM scoring by a hidden Markov model trained with Baum-Welch over all training documents.

A token's probability is that of its symbol in the hidden Markov model times that of the word within its symbol.
The OWN_WORDS most frequent words and the end of text are symbols of their own; all other words share
symbols by their ending and length, with exact corpus counts inside each. Expected counts of a Baum-Welch step are
summed per task, then across tasks in fixed-point integers (so the model is the same in every run), and
only the bounded table (state, symbol) reaches the driver. The score is the exact likelihood by the
scaled forward recursion over the whole text.

Word counts are exact over all training documents. A bounded table of the most frequent words goes to every
task; the counts of all others are joined by a shuffle, in which no word is hot: one that is not among the 2^17 most
frequent of training has less than 1 / 2^17 of its tokens, and documents are held out by a hash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released

STATES = 6
STEPS = 3
STAY = 0.95
FOLDS, HELD_OUT = 5, 1
FREQUENT_WORDS = 1 << 17  # at most so many words are broadcast
OWN_WORDS = 2048
SHARED = 1024
SYMBOLS = 1 + OWN_WORDS + SHARED  # symbol 0 is the end of a text
#: Tokens of a longer sequence that training holds at a time; messages are carried across, so nothing is cut.
SEGMENT = 1 << 16
CELLS = 1 << 19
FIXED = 1 << 24  # fixed-point unit of summed counts
FLUSH = 300_000
SEED = 7


def tokens(text: str | None) -> list[bytes]:
    """Words cut at ASCII white space, A-Z in lower case, without the end."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shared_symbol(word: bytes) -> int:
    return 1 + OWN_WORDS + zlib.crc32(b"%d %b" % (min(len(word), 15), word[-2:])) % SHARED


def _partial_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return b

        for b in batches:
            for t in b.column("text"):
                seen.update(tokens(t.as_py()))
                if len(seen) > FLUSH:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(released(run), "word binary, c long")


def _most_frequent(counts: DataFrame) -> list:
    """Rows (word, c) of words of a count that at most FREQUENT_WORDS words reach, most frequent first."""
    level = F.floor(F.log2("c") * 16).alias("s")
    total, least = 0, None
    for r in counts.groupBy(level).count().orderBy(F.desc("s")).collect():
        total += r["count"]
        if total > FREQUENT_WORDS:
            break
        least = r["s"]
    if least is None:
        return []
    rows = counts.where(F.floor(F.log2("c") * 16) >= least).toArrow()
    found = sorted(zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return found


_tables: dict[int, dict[bytes, int]] = {}


def _table(words: list[bytes], key: int) -> dict[bytes, int]:
    """Word -> rank, built once for a worker process."""
    if key not in _tables:
        _tables.clear()
        _tables[key] = {w: i for i, w in enumerate(words)}
    return _tables[key]


_DOC = "uid long, doc_id long, held_out boolean, n_tokens long, known long, own_sum double, class_sum double, class_norm double, symbols binary, words array<binary>, times array<int>"


def _encode(docs: DataFrame, frequent: list, ends: int, norms: np.ndarray) -> DataFrame:
    """One row per document: symbols, sums over frequent words, and the other words with their numbers."""
    held = docs.sparkSession.sparkContext.broadcast(([w for w, _ in frequent], np.array([c for _, c in frequent], dtype=np.int64), norms))
    key = held._jbroadcast.id() if held._jbroadcast is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, norms = held.value
        rank = _table(words, key)
        logs = np.append(np.log10(c + 0.5), 0.0)
        symbol = np.array([1 + i if i < OWN_WORDS else shared_symbol(w) for i, w in enumerate(words)] + [0], dtype="<u2")
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                b = whole.slice(low, 1000)
                cols: list[list] = [[] for _ in range(9)]
                for t in b.column("text"):
                    ws = tokens(t.as_py())
                    at = np.fromiter((rank.get(w, -1) for w in ws), np.int64, len(ws))
                    syms = np.zeros(len(ws) + 1, dtype="<u2")
                    syms[:-1] = symbol[at]
                    rare = np.flatnonzero(at < 0)
                    other = Counter(ws[i] for i in rare)
                    kind = {w: shared_symbol(w) for w in other}
                    syms[rare] = [kind[ws[i]] for i in rare]
                    own = (at >= 0) & (at < OWN_WORDS)
                    cls = at >= OWN_WORDS
                    for col, v in zip(cols, (uid, len(ws) + 1, int((at >= 0).sum()) + (ends > 0), float(logs[at[own]].sum()) + float(np.log10(ends + 0.5)), float(logs[at[cls]].sum()), float(norms[syms[:-1][~own]].sum()), syms.tobytes(), list(other.keys()), list(other.values())), strict=True):
                        col.append(v)
                    uid += 1
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                a = [pa.array(x, t) for x, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([a[0], b.column("doc_id"), b.column("held_out"), *a[1:]], [x.split()[0] for x in _DOC.split(", ")])

    return docs.mapInArrow(released(run), _DOC)


class Model:
    """start (K), move (K, K) and emit (SYMBOLS, K) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, symbol_counts: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        emit = (symbol_counts[:, None] + 0.5) * rng.uniform(0.1, 1.9, (SYMBOLS, STATES))
        # States that tend to stay: a text keeps its language and style.
        move = STAY * np.eye(STATES) + (1 - STAY) * rng.uniform(0.5, 1.5, (STATES, STATES)) / STATES
        return cls(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, symbol_counts: np.ndarray) -> Model:
        """Re-estimated; each state keeps a little of the corpus distribution, so that nothing has probability 0."""
        prior = (symbol_counts + 0.5) / (symbol_counts + 0.5).sum()
        start, move, emit = start + 0.1, move + 0.1, emit + 10.0 * prior[:, None]
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _chunks(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length together: (their numbers, symbols (T, B), how many are alive at each step)."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        t = len(seqs[order[at]])
        take = order[at : at + max(1, min(1024, CELLS // max(t, 1)))]
        at += len(take)
        m = np.zeros((t, len(take)), dtype=np.int64)
        for j, i in enumerate(take):
            m[: len(seqs[i]), j] = seqs[i]
        lengths = np.array([len(seqs[i]) for i in take])
        yield take, m, np.searchsorted(-lengths, -np.arange(t), side="left")


def log10_likelihoods(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each whole sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    for take, m, alive in _chunks(seqs):
        total = np.zeros(len(take))
        a = None
        for t in range(len(m)):
            n = alive[t]
            a = (model.start if a is None else a[:n] @ model.move) * model.emit[m[t, :n]]
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:n] += np.log10(s)
        out[take] = total
    return out


def _forward(model: Model, seq: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward messages (T, K) and scales of a stretch of one sequence; ``before`` is the message that it follows."""
    alpha, scale = np.empty((len(seq), len(model.start))), np.empty(len(seq))
    for t, x in enumerate(seq):
        a = (model.start if before is None else before @ model.move) * model.emit[x]
        scale[t] = a.sum()
        before = alpha[t] = a / scale[t]
    return alpha, scale


def _long_counts(model: Model, seq: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The expectations of one long sequence, ``size`` tokens held at a time: forward messages are kept at the
    stretches' begins only, and each stretch is run forward again when the backward messages reach it."""
    k = len(model.start)
    move, emit = np.zeros((k, k)), np.zeros((len(model.emit), k))
    parts = [seq[i : i + size] for i in range(0, len(seq), size)]
    before: list[np.ndarray | None] = [None]
    for part in parts[:-1]:
        before.append(_forward(model, part, before[-1])[0][-1])
    ahead = None  # what the next token sends back
    for part, entry in zip(reversed(parts), reversed(before), strict=True):
        alpha, scale = _forward(model, part, entry)
        for t in range(len(part) - 1, -1, -1):
            beta = np.ones(k) if ahead is None else model.move @ ahead
            if ahead is not None:
                move += np.outer(alpha[t], ahead)
            ahead = model.emit[part[t]] * beta / scale[t]
            alpha[t] *= beta
        for j in range(k):
            emit[:, j] += np.bincount(part, weights=alpha[:, j], minlength=len(emit))
    return alpha[0], move * model.move, emit


def expected_counts(model: Model, seqs: list[np.ndarray], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expectations of starts (K), moves (K, K) and emissions (SYMBOLS, K); sequences beyond ``size`` are run in stretches."""
    k = len(model.start)
    total = [np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))]
    for s in seqs:
        if len(s) > size:
            for x, y in zip(total, _long_counts(model, s, size), strict=True):
                x += y
    for x, y in zip(total, _short_counts(model, [s for s in seqs if len(s) <= size]), strict=True):
        x += y
    return tuple(total)


def _short_counts(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k))
    for _, m, alive in _chunks(seqs):
        steps, width = m.shape
        alpha, scale = np.zeros((steps, width, k)), np.ones((steps, width))
        for t in range(steps):
            n = alive[t]
            a = (model.start if t == 0 else alpha[t - 1, :n] @ model.move) * model.emit[m[t, :n]]
            s = a.sum(axis=1)
            alpha[t, :n] = a / s[:, None]
            scale[t, :n] = s
        beta = np.ones((width, k))
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            if t < steps - 1:
                more = alive[t + 1]
                ahead = model.emit[m[t + 1, :more]] * beta[:more] / scale[t + 1, :more, None]
                move += alpha[t, :more].T @ ahead
                beta[:more] = ahead @ model.move.T
            alpha[t, :n] *= beta[:n]  # now the posterior of the states
        start += alpha[0].sum(axis=0)
        live = np.arange(width)[None, :] < alive[:, None]
        syms, post = m[live], alpha[live]
        for j in range(k):
            emit[:, j] += np.bincount(syms, weights=post[:, j], minlength=len(emit))
    return start, move * model.move, emit


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def _step(train: DataFrame, model: Model, symbol_counts: np.ndarray) -> Model:
    """One Baum-Welch step over all of ``train`` (symbols)."""
    held = train.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        total = np.zeros(STATES + STATES * STATES + SYMBOLS * STATES)
        for b in batches:
            if b.num_rows:
                total += np.concatenate([x.ravel() for x in expected_counts(model, _symbols(b.column("symbols")))])
        fixed = np.rint(total * FIXED).astype(np.int64)
        at = np.flatnonzero(fixed)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(fixed[at])], ["cell", "v"])

    sums = train.select("symbols").mapInArrow(run, "cell int, v long").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toArrow()
    total = np.zeros(STATES + STATES * STATES + SYMBOLS * STATES)
    total[sums.column("cell").to_numpy()] = [float(x) / FIXED for x in sums.column("v").to_pylist()]
    a, b = STATES, STATES + STATES * STATES
    return Model.from_counts(total[:a], total[a:b].reshape(STATES, STATES), total[b:].reshape(SYMBOLS, STATES), symbol_counts)


def _likelihoods(coded: DataFrame, model: Model) -> DataFrame:
    held = coded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    columns = ["uid", "doc_id", "held_out", "n_tokens", "known", "own_sum", "class_sum", "class_norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(log10_likelihoods(model, _symbols(b.column("symbols"))))], [*columns, "ll"])

    return coded.select(*columns, "symbols").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, own_sum double, class_sum double, class_norm double, ll double")


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: one token, the end. A null id counts as training. Repeated rows are counted and
    scored each. Texts are learnt from and scored whole, however long. Other columns are not looked at. With no training document every base score is 0 and the model is as first drawn. An
    empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False)))
    train = docs.where(~F.col("held_out"))
    counts = materialize(_partial_counts(train).groupBy("word").agg(F.sum("c").alias("c")))
    ends = train.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    frequent = _most_frequent(counts)
    # Counts and words per symbol: ranks below OWN_WORDS have their own; all others share.
    own = {w for w, _ in frequent[:OWN_WORDS]}
    kept = docs.sparkSession.sparkContext.broadcast(own)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SYMBOLS), dtype=np.int64)
        for b in batches:
            words, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            s = np.fromiter((-1 if w in kept.value else shared_symbol(w) for w in words), np.int64, len(words))
            sums[0] += np.bincount(s[s >= 0], weights=c[s >= 0], minlength=SYMBOLS).astype(np.int64)
            sums[1] += np.bincount(s[s >= 0], minlength=SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), pa.array(sums[0]), pa.array(sums[1])], ["s", "c", "v"])

    symbol_counts, kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for r in counts.mapInArrow(classes, "s long, c long, v long").groupBy("s").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():
        symbol_counts[r["s"]], kinds[r["s"]] = r["c"], r["v"]
    norms = np.log10(symbol_counts + 0.5 * (kinds + 1))
    symbol_counts[0] = ends
    symbol_counts[1 : 1 + len(frequent[:OWN_WORDS])] = [c for _, c in frequent[:OWN_WORDS]]
    coded = materialize(_encode(docs, frequent, ends, norms))
    model = Model.first(symbol_counts)
    if ends:
        for _ in range(STEPS):
            model = _step(coded.where(~F.col("held_out")), model, symbol_counts)
    rare = coded.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    sums = rare.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("times") * log).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    found = _likelihoods(coded, model).join(sums, "uid", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("own_sum") + F.col("class_sum") + rare_sum - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"),
        (F.col("ll") + F.col("class_sum") + rare_sum - F.col("class_norm")).alias("score"),
    )
