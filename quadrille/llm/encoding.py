"""Time-ordered target encoding: what a value's earlier rows say about a flag, folds of their own left out, with smoothing.

A row's history is all rows of other folds with a strictly earlier time. Counts and flagged counts of a key are pivoted by fold
into a vector for each of its times and summed up along time; a row takes the total of its latest strictly earlier vector less the
component of its own fold. The scan goes by chunks: a key with few rows is one chunk; a key with more than 1 / parts of
all rows is cut by quantiles of its times (a single time that holds many rows is spread over several chunks), and what lies before
a chunk enters it as a few carried rows. So no task gets a whole large key, and what is broadcast is at most ``parts`` rows.

Columns of few values (and the column of all rows) share one scan by chunks of time. Rows of a chunk are sorted once a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, skew_join

FOLDS = 5
PRIOR, WEIGHT, SCALE = 500_000, 50, 1_000_000
UNKNOWN = -1
#: Before all times, with room for a frame's bound.
START = -(1 << 61)


def _parts(spark: SparkSession) -> int:
    return max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(id_: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)).cast("int")


def _below(bounds: Column, t: Column, parts: int, equal: bool) -> Column:
    """How many of the sorted bounds lie below ``t`` (or equal it), by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])

    def go(at: Column, step: Column) -> Column:
        bound = F.get(bounds, at + step - 1)
        return F.when((at + step <= F.size(bounds)) & ((bound <= t) if equal else (bound < t)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), go)


def _placed(rows: DataFrame, time: str, bounds: Column, spread: Column, parts: int) -> DataFrame:
    """``rows`` with their chunk (__sub) and, where their time is a bound, that time (__tie). Rows at a bound may lie on either side."""
    rows = rows.withColumn("__low", F.when(bounds.isNull(), F.lit(0)).otherwise(_below(bounds, F.col(time), parts, False)))
    rows = rows.withColumn("__tie", F.when(F.get(bounds, F.col("__low")) == F.col(time), F.col(time)))
    high = F.when(F.col("__tie").isNull(), F.col("__low")).otherwise(_below(bounds, F.col(time), parts, True))
    return rows.withColumn("__sub", F.col("__low") + F.pmod(spread, high - F.col("__low") + 1).cast("int")).drop("__low")


def _quantiles(time: str | Column, parts: int) -> Column:
    return F.percentile_approx(time, [i / parts for i in range(1, parts)], 10 * parts)


def _before(totals: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """``asks`` (keys, __sub, ...) with the sums n and s of ``totals`` in the chunks before, by a running sum over chunks."""
    chunks = Window.partitionBy(*keys).orderBy("__sub").rangeBetween(Window.unboundedPreceding, -1)
    both = totals.select(*keys, "__sub", "n", "s").unionByName(asks.withColumns({"n": F.lit(0), "s": F.lit(0), "__asks": F.lit(True)}), allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.sum(c).over(chunks), F.lit(0)) for c in ("n", "s")}).where("__asks").drop("__asks")


def _carried(totals: DataFrame, starts: DataFrame, keys: list[str], time: str, folds: int) -> DataFrame:
    """For each chunk (keys, __sub, __start) after the first what lies before it, by fold: rows at START, and at the chunk's first time
    what other chunks hold of that very time. Both tables have a bounded number of rows."""
    asks = starts.withColumn("fold", F.explode(F.array(*map(F.lit, range(folds)))))
    whole = _before(totals, asks, [*keys, "fold"])
    same = _before(totals.where("__tie IS NOT NULL"), asks.withColumn("__tie", F.col("__start")), [*keys, "fold", "__tie"])
    parts = [whole.withColumn(time, F.lit(START)), same.withColumns({time: F.lit(START), "n": -F.col("n"), "s": -F.col("s")}), same.withColumn(time, F.col("__start"))]
    out = reduce(DataFrame.unionByName, [p.select(*keys, "__sub", time, "fold", "n", "s") for p in parts])
    return out.groupBy(*keys, "__sub", time, "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n <> 0 OR s <> 0")


def _history(window: Window, taken: Column, folds: int) -> tuple[Column, Column]:
    """(n, s) of the latest strictly earlier vector without the row's own fold: vectors are running sums, one a fold."""
    out = []
    for c in ("n", "s"):
        vector = [F.coalesce(F.sum(F.when(taken & (F.col("fold") == f), F.col(c))).over(window), F.lit(0)) for f in range(folds)]
        own = reduce(lambda rest, f: F.when(F.col("fold") == f, vector[f]).otherwise(rest), range(folds), F.lit(0))
        out.append(reduce(Column.__add__, vector) - own)
    return out[0], out[1]


def key_history(rows: DataFrame, key: str, name: str, spread: Column, about: DataFrame | None = None, attribute: str | None = None, folds: int = FOLDS, time: str = "time") -> DataFrame:
    """``rows`` (key, time, fold, n, s, ...) with ``name``_n and ``name``_s of the key's history.

    ``about`` (key, attribute) travels with the key's rows and gives them the attribute, null where the key is unknown; of several
    the largest. Null keys are one value. ``rows`` is read several times and should be a written table.
    """
    spark = rows.sparkSession
    parts = _parts(spark)
    share = max(rows.count() // parts, 100)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > share)
    hot = materialize(hot.withColumn("__cuts", F.least(F.ceil(F.col("__rows") / share), F.lit(parts)).cast("int")).select(F.col(key).alias("__key"), "__cuts"))
    found = hot.count()  # at most parts
    if found:
        # Rows of other keys have neither pieces nor times here and count as one key without quantiles.
        known = rows.select(key, time).join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left")
        own = F.when(F.col("__cuts").isNotNull(), F.col(time))
        quantiles = known.groupBy(F.when(F.col("__cuts").isNotNull(), F.struct(F.col(key).alias("k"))).alias("g")).agg(F.max("__cuts").alias("__cuts"), _quantiles(own, parts).alias("q"))
        quantiles = quantiles.where("__cuts IS NOT NULL").select(F.col("g.k").alias("__key"), "__cuts", "q")
        some = F.transform(F.sequence(F.lit(1), F.col("__cuts") - 1), lambda i: F.element_at("q", (i * parts / F.col("__cuts")).cast("int")))
        bounds = materialize(quantiles.select("__key", some.alias("__bounds")))
        wide = lambda df: df.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        placed = _placed(wide(rows), time, F.col("__bounds"), spread, parts)
        # Rows of keys that are not cut count as one group, left out afterwards.
        is_cut = F.col("__bounds").isNotNull()
        group = F.when(is_cut, F.struct(F.col(key).alias("k"), "__sub", "__tie", "fold"))
        totals = placed.groupBy(group.alias("g")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.when(is_cut, 1)).alias("cut")).where("cut IS NOT NULL")
        totals = materialize(totals.select(F.col("g.k").alias(key), "g.__sub", "g.__tie", "g.fold", "n", "s"))
        starts = bounds.select(F.col("__key").alias(key), F.posexplode("__bounds").alias("p", "__start")).select(key, (F.col("p") + 1).alias("__sub"), "__start")
        placed = placed.drop("__bounds", "__tie").withColumn("__own", F.lit(True)).unionByName(_carried(totals, starts, [key], time, folds), allowMissingColumns=True)
    else:
        placed = rows.withColumns({"__sub": F.lit(0), "__own": F.lit(True)})
    if about is not None:
        facts = about.where(F.col(key).isNotNull()).select(key, attribute)
        if found:
            facts = wide(facts).withColumn("__sub", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("__bounds"), F.lit(0))))).drop("__bounds")
        else:
            facts = facts.withColumn("__sub", F.lit(0))
        placed = placed.unionByName(facts.withColumn(time, F.lit(START - 1)), allowMissingColumns=True)
    window = Window.partitionBy(key, "__sub").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    n, s = _history(window, F.lit(True), folds)
    more = {f"{name}_n": n, f"{name}_s": s}
    if about is not None:
        more[attribute] = F.max(attribute).over(window)
    return placed.withColumns(more).where("__own").drop("__own", "__sub")


def column_histories(rows: DataFrame, columns: list[str], spread: Column, folds: int = FOLDS, time: str = "time") -> DataFrame:
    """``rows`` with ``c``_n and ``c``_s of the history for each of the columns, which have few values each, and all_n and all_s of all rows.

    Chunks are ranges of time; before a chunk lies one carried row for each value and fold. ``rows`` is read several times.
    """
    spark = rows.sparkSession
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(_quantiles(time, parts).alias("q")).first()["q"]  # parts - 1 numbers
    if cuts is None:
        return rows.withColumns({f"{c}_{x}": F.lit(0).cast("long") for c in [*columns, "all"] for x in "ns"})
    literal = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    placed = _placed(rows, time, literal, spread, parts)
    totals = materialize(placed.groupBy("__sub", "__tie", "fold", *columns).agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    starts = spark.createDataFrame([(i + 1, t) for i, t in enumerate(cuts)], "__sub int, __start long")
    placed = placed.drop("__tie").withColumn("__for", F.lit(None).cast("string"))
    for c in [*columns, "all"]:
        keys = [c] if c != "all" else []
        own = totals.groupBy(*keys, "__sub", "__tie", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        begun = starts if not keys else starts.crossJoin(totals.select(c).distinct())  # chunks times values of a column
        placed = placed.unionByName(_carried(own, begun, keys, time, folds).withColumn("__for", F.lit(c)), allowMissingColumns=True)
    for c in [*columns, "all"]:
        window = Window.partitionBy("__sub", *([c] if c != "all" else [])).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
        n, s = _history(window, F.col("__for").isNull() | (F.col("__for") == c), folds)
        placed = placed.withColumns({f"{c}_n": n, f"{c}_s": s})
    return placed.where("__for IS NULL").drop("__for", "__sub")


def rate(n: str, s: str, prior: Column, weight: int = WEIGHT, scale: int = SCALE) -> Column:
    """The smoothed rate in ``scale``-ths, rounded down; the prior where there is no history."""
    return F.when(F.col(n) < 1, prior).otherwise(F.call_function("div", F.col(s) * scale + prior * weight, F.col(n) + weight))


def micros(t: Column) -> Column:
    """A time without a zone as a number; no session's zone plays a part."""
    day = F.datediff(t, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def sale_lines_encoded(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, flag: str = "returned", folds: int = FOLDS) -> DataFrame:
    """For each (sale_id, item_id, vendor_id) its own lines and returned lines, and the encodings of item, vendor and client.

    Lines without a sale or without a time of sale are left out. Null items and clients are the id -1; null vendors are one value.
    Where a sale_id has several rows in ``sales`` of different client or time, each gives rows of its own; equal ones count each.
    Null and unknown ids share the null kind, nation and segment. Empty tables give no rows. Other columns are not looked at.
    """
    own = lines.where("sale_id IS NOT NULL").groupBy("sale_id", F.coalesce("item_id", F.lit(UNKNOWN).cast("long")).alias("item_id"), "vendor_id")
    own = materialize(own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("flag") == flag, F.lit(False))).alias("s")))
    sold = sales.where("sale_id IS NOT NULL AND sold_at IS NOT NULL").groupBy("sale_id", F.coalesce("client_id", F.lit(UNKNOWN).cast("long")).alias("client_id"), micros(F.col("sold_at")).alias("time")).agg(F.count(F.lit(1)).alias("times"))
    size = own.groupBy("sale_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_sale = materialize(sold.join(size, "sale_id").withColumns({"n": F.col("n") * F.col("times"), "s": F.col("s") * F.col("times"), "fold": fold_of(F.col("sale_id"), folds)}))
    seen = key_history(by_sale, "client_id", "client", F.xxhash64("sale_id"), clients, "segment", folds).drop("n", "s")
    spread = F.xxhash64("sale_id", "item_id", "vendor_id")
    rows = skew_join(own, seen, ["sale_id"], spread, own.count(), "inner")
    rows = materialize(rows.withColumns({"n": F.col("n") * F.col("times"), "s": F.col("s") * F.col("times")}).drop("times"))
    rows = key_history(rows, "item_id", "item", spread, items, "kind", folds)
    rows = key_history(materialize(rows), "vendor_id", "vendor", spread, vendors, "nation_id", folds)
    rows = column_histories(materialize(rows), ["kind", "nation_id", "segment"], spread, folds)
    base = rate("all_n", "all_s", F.lit(PRIOR).cast("long"))
    rows = rows.withColumn("all_rate", base)
    rows = rows.withColumns({f"{c}_rate": rate(f"{c}_n", f"{c}_s", F.col("all_rate")) for c in ("kind", "nation_id", "segment")})
    rows = rows.withColumns({f"{c}_rate": rate(f"{c}_n", f"{c}_s", F.col(f"{p}_rate")) for c, p in (("item", "kind"), ("vendor", "nation_id"), ("client", "segment"))})
    return rows.select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), *[f"{c}_{x}" for c in ("item", "vendor", "client") for x in ("n", "rate")])
