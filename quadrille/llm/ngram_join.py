"""N-gram Jaccard join over word shingles: every link of similarity 0.8 or more, by a token-group matrix.

1. Equal texts collapse to one node each.
2. Of each node's tokens, in order of their hash, those that a link cannot miss altogether are dealt out by hash. A node
   that holds too few of them in common with others has no link, and its text is not looked at again.
3. The whole sets of the nodes left are written once. Their tokens are counted exactly, and each set is put in
   one fixed order, rare tokens first. A token at place i of a set of m can only be the first that a link shares when
   m - i tokens make its overlap; that bounds the sizes of the partners, and only tokens before the bound are posted.
4. Nodes are linked with one central leader each by minhash bands, checked on whole sets. What is linked so far is
   cut into groups of like size, GROUP members at most.
5. The token-group matrix is a relation (token, group) of the union of the members' posted tokens, with the sizes and bounds
   of those members. A node of another component qualifies for a group by a token of the matrix whose bounds both
   allow. Qualifying groups are opened: the node's set against the union, then against the members. One link joins the
   components, so none is given twice. No link between components is lost, whatever the groups are.

Tokens are 64-bit hashes of the words. Whatever is dealt goes in packed form: a chunk of documents sends a distinct token once
and hears how often it occurs, so no list of a token's documents meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_ids, flag_ids, id_filter, materialize, released, skew_join
from .wordhash import mix, rolled, word_hashes

WORDS = 5
#: Similarity as a fraction, so that ties are decided in integers.
NUM, DEN = 80, 100
BANDS, ROWS = 4, 2
_SEEDS = np.array([xxhash.xxh64_intdigest(b"band", seed=i) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
#: Members of a group, and nodes that one task compares with it, at most.
GROUP, QUERIES = 64, 256
#: Texts hashed at a time; tokens and documents of a chunk; documents to a bucket of dealt tokens, and buckets at least.
BATCH, CHUNK, CHUNK_DOCS, DOCS_A_BUCKET, BUCKETS = 256, 1 << 20, 60_000, 4096, 128
#: Bytes of a dealt token beside its bucket. A false match there keeps a node for the exact steps, no more.
DEALT_BYTES = 5
_MANY = 65535


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z in lower case; with fewer words the
    whole sequence as one, without words none."""
    return [np.unique(rolled(w, min(k, len(w)))) if len(w) else w for w in word_hashes(texts, True)]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            part = whole.slice(at, BATCH)
            yield part.column("node").to_pylist(), shingle_sets(part.column("text").to_pylist())


def least_partner(m):
    """The smallest set that can link with one of m tokens, which is also the least overlap."""
    return -(-NUM * m // DEN)


def prefix_length(m):
    """A link shares one of the first so many tokens, in any fixed order."""
    return m - least_partner(m) + 1


def dealt_length(m):
    """Tokens dealt of a set: so many more than its prefix that a link shares :func:`least_shared` of them."""
    return np.minimum(m, m - least_partner(m) + (DEN - NUM) * m // DEN + 1)


def least_shared(m):
    """The first k tokens that two linked sets of sizes m and n share lie in the dealt parts of both for
    k = (DEN - NUM) * min(m, n) // DEN + 1, and n is at least :func:`least_partner`."""
    return (DEN - NUM) * least_partner(m) // DEN + 1


def _bands(s: np.ndarray) -> list[int]:
    low = np.array([mix(s * seed).min() for seed in _SEEDS]).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in low]


def _buckets(rows: int) -> int:
    n = BUCKETS
    while n * DOCS_A_BUCKET < rows:
        n *= 2
    return n


def _cut(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first place) of each stretch of a bucket in sorted ``tokens``: the high bits name it."""
    part = (tokens >> np.uint64(65 - buckets.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return part[first], first


def _shares(nodes: DataFrame, buckets: int) -> DataFrame:
    """(node, m, n): the size of each node's set, and how many of its dealt tokens another node has dealt too."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 33, 0
        ids: list[int] = []
        sets: list[np.ndarray] = []
        sizes: list[int] = []

        def out() -> pa.RecordBatch:
            tokens, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(tokens)
            tokens, own = tokens[order], own[order]
            same = tokens[1:] == tokens[:-1]
            twice = np.append(same, False) | np.append(False, same)
            here = np.bincount(own[twice], minlength=len(ids)).astype("<u4")
            first = ~np.append(False, same)[: len(tokens)]
            tokens, own = tokens[first], np.where(twice[: len(first)], _MANY, own)[first].astype("<u2")
            parts, at = _cut(tokens, buckets)
            if not len(at):
                parts, at = np.zeros(1, np.int64), np.zeros(1, np.int64)
            # The bytes below the bucket's bits.
            low = ((tokens << np.uint64(buckets.bit_length() - 1)).byteswap().view(np.uint8).reshape(-1, 8)[:, :DEALT_BYTES]).tobytes()
            ends = np.append(at, len(tokens)).tolist()
            mine = [np.asarray(ids, "<i8").tobytes(), np.asarray(sizes, "<u4").tobytes(), here.tobytes()]
            cols = [pa.array([number] * len(at), pa.int64()), pa.array(parts.tolist(), pa.int32())]
            cols += [pa.array([low[DEALT_BYTES * i : DEALT_BYTES * j] for i, j in zip(ends, ends[1:], strict=False)], pa.binary())]
            cols += [pa.array([own[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())]
            # The chunk's own lists go with one of its rows, another for each chunk.
            lead = (number + (number >> 33)) % len(at)
            cols += [pa.array([x if i == lead else None for i in range(len(at))], pa.binary()) for x in mine]
            ids.clear(), sets.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(cols, ["chunk", "bucket", "tokens", "owners", "nodes", "sizes", "here"])

        for names, found in _each(batches):
            for node, s in zip(names, found, strict=True):
                ids.append(node), sizes.append(len(s)), sets.append(s[: int(dealt_length(len(s)))])
                waiting += len(sets[-1])
            if waiting >= CHUNK or len(ids) >= CHUNK_DOCS - BATCH:
                yield out()
                number, waiting = number + 1, 0
        if ids:
            yield out()

    def hear(bucket: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint8).reshape(-1, DEALT_BYTES) for x in bucket.column("tokens").to_pylist()]
        wide = np.zeros((sum(map(len, rows)), 8), np.uint8)
        wide[:, :DEALT_BYTES] = np.concatenate(rows)
        tokens = wide.view(">u8").ravel().astype(np.uint64)
        order = np.argsort(tokens)
        same = tokens[order][1:] == tokens[order][:-1]
        again = np.zeros(len(tokens), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        which, times, at = [], [], 0
        for row, owners in zip(rows, bucket.column("owners").to_pylist(), strict=True):
            own = np.frombuffer(owners, "<u2")[again[at : at + len(row)]]
            docs, n = np.unique(own[own != _MANY], return_counts=True)
            which.append(docs.tobytes()), times.append(n.astype("<u4").tobytes())
            at += len(row)
        return pa.table({**{c: bucket.column(c) for c in ("chunk", "nodes", "sizes", "here")}, "which": pa.array(which, pa.binary()), "times": pa.array(times, pa.binary())})

    def add(chunk: pa.Table) -> pa.Table:
        own = next(r for r in chunk.select(["nodes", "sizes", "here"]).to_pylist() if r["nodes"] is not None)
        n = np.frombuffer(own["here"], "<u4").astype(np.int64)
        for which, times in zip(chunk.column("which").to_pylist(), chunk.column("times").to_pylist(), strict=True):
            n[np.frombuffer(which, "<u2")] += np.frombuffer(times, "<u4")
        return pa.table({"node": np.frombuffer(own["nodes"], "<i8"), "m": np.frombuffer(own["sizes"], "<u4").astype(np.int64), "n": n})

    dealt = nodes.mapInArrow(released(deal), "chunk long, bucket int, tokens binary, owners binary, nodes binary, sizes binary, here binary")
    heard = dealt.groupBy("bucket").applyInArrow(hear, "chunk long, nodes binary, sizes binary, here binary, which binary, times binary")
    return heard.groupBy("chunk").applyInArrow(add, "node long, m long, n long")


def _sets(nodes: DataFrame) -> DataFrame:
    """(chunk, node, m, tokens): whole sets, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 33, 0
        for names, sets in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["chunk", "node", "m", "tokens"])
            waiting += sum(map(len, sets))
            if waiting >= CHUNK // 4:
                number, waiting = number + 1, 0

    return nodes.mapInArrow(released(run), "chunk long, node long, m int, tokens binary")


def _read(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _posted(sets: DataFrame, buckets: int) -> DataFrame:
    """(part, key, node, m, pos). Part -1 has the tokens of a node's prefix that another node has too, with their places in
    its order; parts from 0 have its minhash bands, with how rare its tokens are. Nodes with too many tokens of their own to link are left out."""

    def deal(chunk: pa.Table) -> pa.Table:
        tokens, times = np.unique(np.concatenate(_read(chunk.column("tokens"))), return_counts=True)
        parts, at = _cut(tokens, buckets)
        ends = np.append(at, len(tokens)).tolist()
        number = chunk.column("chunk")[0].as_py()
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
        return pa.table({"chunk": pa.array([number] * len(at), pa.int64()), "bucket": pa.array(parts, pa.int32()), "tokens": cut(tokens), "times": cut(times.astype("<u4"))})

    def count(bucket: pa.Table) -> pa.Table:
        rows = _read(bucket.column("tokens"))
        times = np.concatenate([np.frombuffer(x, "<u4") for x in bucket.column("times").to_pylist()])
        _, which = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(which, weights=times)
        # Eight classes for each doubling; 0 is a token of one node.
        kind = np.where(total > 1, 1 + np.minimum(8 * np.log2(np.maximum(total, 1)), 253), 0).astype(np.uint8)[which]
        ends = np.cumsum([0, *map(len, rows)]).tolist()
        return pa.table({"chunk": bucket.column("chunk"), "bucket": bucket.column("bucket"), "kinds": pa.array([kind[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())})

    def order(chunk: pa.Table, heard: pa.Table) -> pa.Table:
        sets = _read(chunk.column("tokens"))
        m = np.array([len(s) for s in sets])
        tokens, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), m)
        _, which = np.unique(tokens, return_inverse=True)
        rows = sorted(zip(heard.column("bucket").to_pylist(), heard.column("kinds").to_pylist(), strict=True))
        kind = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(k, np.uint8) for _, k in rows]])[which]
        fit = np.bincount(own[kind > 0], minlength=len(sets)) >= least_partner(m)
        at = np.lexsort((tokens, kind, own))
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(m) - m, m)
        take = (kind[at] > 0) & fit[own] & (pos < prefix_length(m)[own])
        at, pos = at[take], pos[take]
        nodes = chunk.column("node").to_numpy()
        good = np.flatnonzero(fit)
        bands = np.array([_bands(sets[i]) for i in good], dtype=np.int64).reshape(-1, BANDS)
        # How rare a node's tokens are on the whole: the text that others were made from has the least rare ones.
        rare = -(100 * np.bincount(own, weights=kind, minlength=len(sets)) / m).astype(np.int32)[good]
        node = np.concatenate([nodes[own[at]], np.repeat(nodes[good], BANDS)])
        size = np.concatenate([m[own[at]], np.repeat(m[good], BANDS)])
        part = np.concatenate([np.full(len(at), -1), np.tile(np.arange(BANDS), len(good))])
        return pa.table({"part": part.astype(np.int32), "key": np.concatenate([tokens[at].view(np.int64), bands.ravel()]), "node": node.astype(np.int64), "m": size.astype(np.int32), "pos": np.concatenate([pos, np.repeat(rare, BANDS)]).astype(np.int32)})

    grouped = sets.where("m > 0").groupBy("chunk")
    heard = grouped.applyInArrow(deal, "chunk long, bucket int, tokens binary, times binary").groupBy("bucket").applyInArrow(count, "chunk long, bucket int, kinds binary")
    return grouped.cogroup(heard.groupBy("chunk")).applyInArrow(order, "part int, key long, node long, m int, pos int")


def _of_ids(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, m, tokens) of the sets whose node is among ``ids`` (a few others beside); nothing is shuffled."""
    ids = materialize(ids.distinct())
    return flag_ids(sets, "node", id_filter(ids, ids.count())).where("__hit").select("node", "m", "tokens")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by intersection of their whole sets."""
    rows = pairs.count()
    hit = lambda side: _of_ids(sets, pairs.select(side)).select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}"))
    both = skew_join(pairs, hit("b"), ["b"], F.xxhash64("a"), rows, "inner")
    both = skew_join(both, hit("a"), ["a"], F.xxhash64("b"), rows, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for s, t in zip(_read(x.column("ta")), _read(x.column("tb")), strict=True):
                inter = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(DEN * inter >= NUM * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(released(run), "a long, b long")


def _sizes_fit(x: str, y: str) -> Column:
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def _largest_partner(m: str, pos: str) -> Column:
    """The largest set for which a token at ``pos`` can be the first one shared: what is shared lies from there on."""
    return F.least(F.floor(F.lit(NUM + DEN) * (F.col(m) - F.col(pos)) / NUM) - F.col(m), F.floor(F.lit(DEN) * F.col(m) / NUM))


def _leaders(posted: DataFrame) -> DataFrame:
    """(a, b): each node with one leader, that of most of its bands; a band's leader is the node with the least rare tokens, so
    the middle of a family of edited copies. What this misses the matrix finds."""
    bands = posted.where("part >= 0").select("part", "key", "node", "m", "pos")
    lead = bands.groupBy("part", "key").agg(F.min(F.struct("pos", "node", "m")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    near = skew_join(bands, lead, ["part", "key"], F.xxhash64("node"), bands.count(), "inner").where((F.col("node") != F.col("l.node")) & _sizes_fit("m", "l.m"))
    near = near.groupBy(F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return near.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("minus"))).alias("x")).select("a", (-F.col("x.minus")).alias("b"))


_GROUP = ["comp", "size", "sub"]


def _places(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, comp, members, size, sub): the component of each node, how many it has, and the node's group in it."""
    nodes = posted.where("part = 0").select("node", "m").join(labels, "node", "left").select("node", F.floor(F.log("m") / float(np.log(1.05))).cast("int").alias("size"), F.coalesce("component", "node").alias("comp"))
    nodes = materialize(nodes)
    n = nodes.groupBy("comp", "size").agg(F.count(F.lit(1)).alias("k"))
    n = n.join(n.groupBy("comp").agg(F.sum("k").alias("members")), "comp").withColumn("subs", F.ceil(F.col("k") / GROUP).cast("int")).drop("k")
    return skew_join(nodes, n, ["comp", "size"], F.xxhash64("node"), nodes.count(), "inner").select("node", "comp", "members", "size", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int").alias("sub"))


def _qualifying(posted: DataFrame, places: DataFrame) -> DataFrame:
    """(a, group): nodes and groups of other components that the token-group matrix cannot rule out. Of two components the
    smaller one asks."""
    rows = materialize(posted.where("part < 0").select("key", "node", "m", _largest_partner("m", "pos").alias("most")).join(places, "node"))
    matrix = rows.groupBy("key", "members", *_GROUP).agg(F.min("m").alias("low"), F.max("m").alias("high"), F.max("most").alias("reach"))
    matrix = matrix.select("key", F.col("members").alias("their"), *[F.col(c).alias(f"to_{c}") for c in _GROUP], "low", "high", "reach")
    asking = rows.where(F.col("most") >= F.ceil(F.lit(NUM) * F.col("m") / DEN)).select("key", F.col("node").alias("a"), "m", "most", "members", "comp")
    met = skew_join(asking, matrix, ["key"], F.xxhash64("a"), rows.count(), "inner").where(
        (F.struct("members", "comp") < F.struct(F.col("their").alias("members"), F.col("to_comp").alias("comp")))
        & (F.col("low") <= F.col("most")) & (F.col("m") <= F.col("reach")) & (DEN * F.col("high") >= NUM * F.col("m"))
    )
    return met.select("a", *[F.col(f"to_{c}").alias(c) for c in _GROUP]).distinct()


def _open(asked: DataFrame, places: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each node and qualifying group the first member that links, if any does."""
    keys = [*_GROUP, "part"]
    parts = materialize(asked.groupBy(*_GROUP).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")))
    dealt = skew_join(asked, parts, _GROUP, F.xxhash64("a"), asked.count(), "inner").select(F.col("a").alias("node"), *_GROUP, F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    asking = dealt.join(_of_ids(sets, asked.select(F.col("a").alias("node"))), "node")
    within = materialize(places.join(parts, _GROUP).select("node", *_GROUP, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    members = within.join(_of_ids(sets, within.select("node")), "node").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("node").alias("b"), F.col("tokens").alias("held"))

    def run(queries: pa.Table, group: pa.Table) -> pa.Table:
        a, b = [], []
        if queries.num_rows and group.num_rows:
            held, names = _read(group.column("held")), group.column("b").to_pylist()
            sizes = np.array([len(s) for s in held])
            union, cell = np.unique(np.concatenate(held), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            for node, s in zip(queries.column("node").to_pylist(), _read(queries.column("tokens")), strict=True):
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                at = at[union[at] == s]
                if (NUM + DEN) * len(at) < NUM * (len(s) + sizes.min()):
                    continue  # the union's overlap bounds that of every member
                has = np.zeros(len(union), dtype=np.int64)
                has[at] = 1
                inter = np.add.reduceat(has[cell], starts)
                link = np.flatnonzero(DEN * inter >= NUM * (len(s) + sizes - inter))
                if len(link):
                    a.append(node), b.append(names[link[0]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asking.groupBy(*keys).cogroup(members.groupBy(*[f"of_{k}" for k in keys])).applyInArrow(run, "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of linked nodes."""
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")) if links.isEmpty() else materialize(components(links))


def _nodes(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, text) of one document for each text, without a shuffle of texts, and (node, of) of its copies.

    ``docs`` is (node, text), ``keys`` (node, text_key). A filter of the copies flags rows to leave out; the few
    that it flags falsely are in a second filter. A copy that both let through is one more node, linked with its like.
    """
    first = keys.groupBy("text_key").agg(F.min("node").alias("of"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    copies = materialize(skew_join(keys, first, ["text_key"], F.xxhash64("node"), keys.count(), "inner").where("node <> of").select("node", "of"))
    n = copies.count()
    if not n:
        return docs, copies
    gone = id_filter(copies.select("node"), n)
    false = materialize(flag_ids(keys.select("node"), "node", gone).where("__hit").select("node").join(copies, "node", "left_anti"))
    flagged = flag_ids(flag_ids(docs, "node", gone), "node", id_filter(false, false.count()), "__false")
    return flagged.where("NOT __hit OR __false").select("node", "text"), copies


def _labels(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, m, component) of every node of ``docs`` (node, text)."""
    nodes, copies = _nodes(docs, keys)
    shares = materialize(_shares(nodes, _buckets(keys.count())))
    apart = F.floor(F.lit(DEN - NUM) * F.ceil(F.lit(NUM) * F.col("m") / DEN) / DEN) + 1  # least_shared
    some = materialize(shares.where((F.col("m") > 0) & (F.col("n") >= apart)).select("node"))
    left = some.count()
    found = shares.select("node", "m", F.col("node").alias("component"))
    if left:
        sets = materialize(_sets(flag_ids(nodes, "node", id_filter(some, left)).where("__hit").select("node", "text")))
        posted = materialize(_posted(sets, _buckets(left)))
        near = materialize(_leaders(posted))
        links = near if near.isEmpty() else materialize(_verify(near, sets))
        places = materialize(_places(posted, _components(links)))
        asked = materialize(_qualifying(posted, places))
        if not asked.isEmpty():
            links = materialize(links.union(_open(asked, places, sets)))
        found = shares.join(_components(links), "node", "left").select("node", "m", F.coalesce("component", "node").alias("component"))
    found = materialize(found)
    more = skew_join(copies, found.withColumnRenamed("node", "of"), ["of"], F.xxhash64("node"), keys.count(), "inner")
    return found.union(more.select("node", "m", "component")).groupBy("node").agg(F.max("m").alias("m"), F.min("component").alias("component"))


def similar_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null and texts without a word have an empty set, no link, and are their own component. Rows with
    a null id take no part in links of others and keep a null component. Rows of one id are one document: each has
    its own set, and the document has the links of all of them. An empty table gives an empty table. Texts are hashed whole,
    however long. Other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    full = docs.where(F.col("doc_id").isNotNull())
    keys = materialize(full.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.unhex(F.md5("text")).alias("text_key")))
    repeats = not keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    if not repeats:
        label = _labels(full.select(F.col("doc_id").alias("node"), "text"), keys.select(F.col("doc_id").alias("node"), "text_key"))
        found = label.select(F.col("node").alias("doc_id"), F.col("m").alias("n_shingles"), F.when(F.col("m") > 0, F.col("component")).otherwise(F.col("node")).alias("component_id"))
    else:
        rows = full.dropDuplicates(["doc_id", "text"]).select(F.xxhash64("doc_id", "text").alias("node"), "text")
        label = materialize(_labels(rows, keys.select(F.col("row").alias("node"), "text_key").distinct()))
        every = materialize(keys.select("doc_id", F.col("row").alias("node")).join(label, "node"))
        # A document stands for the components of its sets, and these for the smallest document.
        part = every.where("m > 0").select("doc_id", "component").distinct()
        edges = part.select((F.col("component").cast("decimal(20,0)") * 2).alias("a"), (F.col("doc_id").cast("decimal(20,0)") * 2 + 1).alias("b"))
        whole = materialize(components(edges))
        named = whole.where("node % 2 <> 0").select(((F.col("node") - 1) / 2).cast("long").alias("doc_id"), "component")
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = skew_join(named, least, ["component"], F.xxhash64("doc_id"), named.count(), "inner").select("doc_id", "component_id")
        found = every.join(named, "doc_id", "left").select("doc_id", F.col("m").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each(batches):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    nameless = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").alias("node"), "text").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")
    return found.unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the smallest id stays, columns unchanged."""
    found = similar_components(docs, text_col, id_col)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id").distinct())
    return drop_ids(docs, id_col, gone).select(*docs.columns)
