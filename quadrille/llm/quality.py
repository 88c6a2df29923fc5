"""Quality rules: hard rules on word statistics, then robust multivariate outliers, in DataFrame functions only.

For each language and source the minimum-covariance-determinant (MCD) estimate of location and scatter of a
transformed statistic vector is searched for as usual: STARTS draws of a few rows of a bounded sample, two
concentration steps each on the sample, and the start of least determinant is concentrated further over all
documents that have a word until the determinant falls no more, MAX_STEPS times at most. A concentration step takes the rows
whose distance is among the smallest H_SHARE of their group. A document is rejected when its squared Mahalanobis
distance passes the 0.999 quantile of chi-squared with four degrees of freedom.

Shares over few trials vary more than shares over many, so a document's distance is taken under the
group's scatter plus the sampling variance of its own statistics, which falls with its length. The
scatter of the nearest H_SHARE is blown up by the factor that makes it consistent for Gaussian rows.

A step is two aggregations with map-side partial sums and one small table per group, so no group,
however large, meets in one task. The distance quantile is read from a histogram of
log-distances, which keeps the choice of rows the same in every run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded_join, drop_ids, let, materialize, skew_join

H_SHARE = 0.75
#: Starts of a group, the rows of each, the distinct rows they are drawn from, and their steps before the best is chosen.
STARTS, DRAWN, SAMPLE, FIRST_STEPS = 8, 10, 256, 2
#: Steps over all rows at most, and by how much the logarithm of the determinant falls at least while a group goes on.
MAX_STEPS, STILL = 8, 1e-3
#: Groups with fewer documents than this many take a wider estimate: of their language, or of the table.
MIN_GROUP = 20
#: 0.75 quantile (the H_SHARE) of the chi-squared distribution with four degrees of freedom.
CHI2_SHARE = 5.385269
#: H_SHARE over the chi-squared distribution with six degrees of freedom at CHI2_SHARE.
CONSISTENCY = H_SHARE / (1 - math.exp(-CHI2_SHARE / 2) * (1 + CHI2_SHARE / 2 + CHI2_SHARE**2 / 8))
#: Squared distance beyond which a document is rejected: the 0.999 quantile with four degrees of freedom.
CUTOFF = 18.466827
#: Least standard deviation of each feature: most documents have no symbol and no repeated line,
#: and the estimate must not become singular there.
FLOORS = (0.02, 0.03, 0.05, 0.05)
FEATURES = ("x0", "x1", "x2", "x3")
#: Sampling variance of each feature in its document.
NOISE = ("__v0", "__v1", "__v2", "__v3")
BINS_PER_UNIT = 64
#: Estimates that are broadcast at most; of more, rows meet them by a salted shuffle.
MANY_GROUPS = 50_000
_SPLIT = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_GROUP = ["__lang", "__source"]


def _repeat_words(words: Column) -> Column:
    """Word places covered by 3-word windows that occur twice or more in ``words``."""
    join = lambda a, b: F.concat(a, F.lit(" "), b)
    n = F.size(words)
    triples = lambda f: F.slice(F.zip_with(F.zip_with(words, F.slice(words, 2, n), f), F.slice(words, 3, n), f), F.lit(1), F.greatest(n - 2, F.lit(0)))

    def covered(tri: Column) -> Column:
        # Windows sorted with their places behind: equal ones stand side by side.
        keyed = F.sort_array(F.zip_with(tri, F.sequence(F.lit(0), F.size(tri) - 1), lambda t, i: F.concat(t, F.lit("\n"), F.lpad(i.cast("string"), 10, "0"))))

        def places(k: Column) -> Column:
            def again(g: Column) -> Column:
                here = lambda i: F.coalesce((F.get(g, i - 1) == F.get(g, i)) | (F.get(g, i + 1) == F.get(g, i)), F.get(g, i - 1) == F.get(g, i), F.get(g, i + 1) == F.get(g, i), F.lit(False))
                at = F.transform(F.filter(k, lambda x, i: here(i)), lambda x: F.substring_index(x, "\n", -1).cast("int"))
                return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

            return let(F.transform(k, lambda x: F.substring_index(x, "\n", 1)), again)

        return let(keyed, places)

    # Hashes tell most texts to be without a repeat; the others are looked at word by word.
    alone = let(triples(lambda a, b: F.xxhash64(a, b)), lambda h: F.size(h) == F.size(F.array_distinct(h)))
    return F.when(n < 4, 0).otherwise(F.when(alone, 0).otherwise(let(triples(join), covered)))


def text_statistics(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), all long."""
    text = F.coalesce(text, F.lit(""))

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), _repeat_words(words).cast("long").alias("repeat"))

    w = let(F.filter(F.split(text, _SPLIT), lambda x: x != ""), of_words)
    x = let(F.filter(F.split(text, "\n"), lambda y: F.translate(y, SPACE, "") != ""), lines)
    return F.struct(
        w.alias("w"), x.alias("l"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with the base statistics, base_failed and the statistic vector."""
    rest = [c for c in docs.columns if c != text_col]
    t = docs.select(*rest, text_statistics(F.col(text_col)).alias("__t")).select(
        *rest, F.col("__t.w.n").alias("n_words"), F.col("__t.word_chars").alias("word_chars"), F.col("__t.n_symbols").alias("n_symbols"),
        F.col("__t.l.dup").alias("n_dup_lines"), F.col("__t.w.repeat").alias("n_repeat_words"), F.col("__t.l.n").alias("__lines"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    return t.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x1": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1))),
        "x3": F.sqrt(F.col("n_repeat_words") / words),
        # A word's length has a deviation of about half its mean; the root of a share of n trials has variance 1 / 4n;
        # words repeat six at a time at least (two windows of three).
        "__v0": 0.25 / words,
        "__v1": 0.25 / F.greatest(F.col("word_chars"), F.lit(1)),
        "__v2": 0.25 / F.greatest(F.col("__lines"), F.lit(1)),
        "__v3": 1.5 / words,
    })


def _with_distance(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their squared Mahalanobis distance under the means and covariances in struct __p and their own noise; __p goes."""
    size = range(len(FEATURES))
    df = rows
    for i in size:
        for j in range(i + 1):
            value = F.col(f"__p.c{i}{j}")
            if i == j:
                value = value + F.lit(FLOORS[i] ** 2) + F.col(NOISE[i])
            for k in range(j):
                value = value - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            df = df.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 100))) if i == j else value / F.col(f"__l{j}{j}"))
        y = F.col(FEATURES[i]) - F.col(f"__p.m{i}")
        for j in range(i):
            y = y - F.col(f"__l{i}{j}") * F.col(f"__y{j}")
        df = df.withColumn(f"__y{i}", y / F.col(f"__l{i}{i}"))
    total = sum((F.col(f"__y{i}") * F.col(f"__y{i}") for i in size[1:]), F.col("__y0") * F.col("__y0"))
    return df.withColumn(name, total).drop("__p", *[f"__y{i}" for i in size], *[f"__l{i}{j}" for i in size for j in range(i + 1)])


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, __n, __p): the number of rows, and their means and covariances times ``factor``."""
    size = range(len(FEATURES))
    means = [F.avg(x).alias(f"m{i}") for i, x in enumerate(FEATURES)]
    prods = [F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i in size for j in range(i + 1)]
    cov = [((F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor).alias(f"c{i}{j}") for i in size for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *means, *prods).select(*keys, "__n", F.struct(*[f"m{i}" for i in size], *cov).alias("__p"))


def _with_log_det(estimates: DataFrame) -> DataFrame:
    """``estimates`` with ``__det``, the logarithm of the determinant of the scatter in __p with its floors."""
    size = range(len(FEATURES))
    df = estimates
    for i in size:
        for j in range(i + 1):
            value = F.col(f"__p.c{i}{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"__l{i}{k}") * F.col(f"__l{j}{k}")
            df = df.withColumn(f"__l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 100))) if i == j else value / F.col(f"__l{j}{j}"))
    return df.withColumn("__det", 2 * sum((F.log(f"__l{i}{i}") for i in size[1:]), F.log("__l00"))).drop(*[f"__l{i}{j}" for i in size for j in range(i + 1)])


def _bin(distance: Column) -> Column:
    return F.floor(F.log1p(distance) * BINS_PER_UNIT).cast("int")


def _quantile_bins(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """For each group the first histogram bin at which ``share`` of its rows are reached."""
    bins = rows.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys)
    run = bins.withColumns({"__run": F.sum("__c").over(w.orderBy("__bin")), "__all": F.sum("__c").over(w)})
    return run.where(F.col("__run") >= F.lit(share) * F.col("__all")).groupBy(*keys).agg(F.min("__bin").alias("__cut"))


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], n: int, many: bool) -> DataFrame:
    """``rows`` with what ``groups`` has of their keys: by broadcast unless there are ``many`` groups."""
    return skew_join(rows, groups, keys, F.xxhash64(*FEATURES), n, "inner") if many else rows.join(F.broadcast(groups), keys)


def _concentrated(stats: DataFrame, estimates: DataFrame, keys: list[str], n: int, many: bool) -> DataFrame:
    """(keys, __p, __det) of the rows nearest under ``estimates`` (keys, __p): one concentration step."""
    far = _with_distance(_met(stats, estimates.select(*keys, "__p"), keys, n, many), "__d")
    far = materialize(far.select(*keys, *FEATURES, _bin(F.col("__d")).alias("__bin")))
    near = _met(far, _quantile_bins(far, keys, H_SHARE), keys, n, many).where(F.col("__bin") <= F.col("__cut"))
    return _with_log_det(materialize(_moments(near, keys, CONSISTENCY).select(*keys, "__p")))


def _best_starts(stats: DataFrame, groups: DataFrame, n: int, many: bool) -> DataFrame:
    """(group, __p, __det): of STARTS draws from a sample of SAMPLE distinct rows a group, the one of least determinant.

    Rows are drawn by hashes of their statistics, so the draws are the same in every run, and copies count once.
    """
    vector = [*FEATURES, *NOISE]
    some = _met(stats, groups, _GROUP, n, many).where(F.pmod(F.xxhash64(*vector, F.lit(-1)), F.lit(1 << 30)) * F.col("__n") < F.lit(SAMPLE << 30)).select(*_GROUP, *vector).distinct()
    keys = [*_GROUP, "__start"]
    each = materialize(some).withColumn("__start", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*vector, "__start"), *vector))
    found = materialize(_moments(each.withColumn("__i", order).where(F.col("__i") <= DRAWN), keys, 1.0))
    for _ in range(FIRST_STEPS):
        found = _concentrated(each, found, keys, STARTS * n, many)
    return materialize(found.groupBy(*_GROUP).agg(F.min_by(F.struct("__p", "__det"), F.struct("__det", "__start")).alias("b")).select(*_GROUP, "b.__p", "b.__det"))


def _estimates(stats: DataFrame, n: int, least: int) -> DataFrame:
    """(__lang, __source, __p): one row per group of ``least`` documents or more."""
    groups = materialize(stats.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least))
    many = groups.count() * STARTS > MANY_GROUPS
    found = _best_starts(stats, groups, n, many)
    found = _concentrated(stats, found, _GROUP, n, many)
    for _ in range(MAX_STEPS):
        after = _concentrated(stats, found, _GROUP, n, many).select(*_GROUP, F.col("__p").alias("__q"), F.col("__det").alias("__now"))
        less = F.col("__now") < F.col("__det") - STILL
        better = materialize(found.join(after, _GROUP, "left").select(*_GROUP, F.when(less, F.col("__q")).otherwise(F.col("__p")).alias("__p"), F.when(less, F.col("__now")).otherwise(F.col("__det")).alias("__det"), F.coalesce(less, F.lit(False)).alias("__less")))
        found = better.drop("__less")
        if better.where("__less").isEmpty():
            break
    return found.select(*_GROUP, "__p")


def mcd_estimates(stats: DataFrame, rows: int) -> DataFrame:
    """(__lang, __source, __p): one row per group that has a document with a word.

    A group of fewer than MIN_GROUP documents takes the estimate of its language, of all sources together; in a
    language of fewer, that of the whole table, however small.
    """
    with_words = stats.where("n_words > 0").select(*_GROUP, *FEATURES, *NOISE)
    own = _estimates(with_words, rows, MIN_GROUP)
    small = materialize(with_words.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < MIN_GROUP).drop("__n"))
    if small.isEmpty():
        return own
    every = F.lit("")
    langs = _estimates(with_words.withColumn("__source", every), rows, MIN_GROUP).drop("__source")
    found = small.join(langs, "__lang", "left")
    if not found.where("__p IS NULL").isEmpty():
        table = _estimates(with_words.withColumns({"__lang": every, "__source": every}), rows, 1).select(F.col("__p").alias("__q"))
        found = found.join(F.broadcast(table), F.lit(True), "left").withColumn("__p", F.coalesce("__p", "__q")).drop("__q")  # one row
    return materialize(own.unionByName(found.select(*own.columns)))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Every row of ``docs`` (without the text) with its statistics, base_failed, distance and kept.

    Null text counts as empty (no words, base_failed); null language or source as ''. Groups too small for an
    estimate are judged by that of their language or of the table. An empty table gives an empty table. Repeated rows are judged
    alike. Texts are read whole, however long. Columns named like the results are replaced; names that begin with two underscores are reserved.
    """
    found = _judged(docs, text_col, lang_col, source_col, cutoff)
    return found.drop("__d", "__lines", *FEATURES, *NOISE, *_GROUP)


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, cutoff: float) -> DataFrame:
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", *FEATURES}
    docs = docs.select(*[c for c in docs.columns if c not in made], F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"))
    stats = materialize(with_statistics(docs, text_col))
    rows = stats.count()
    found = bounded_join(stats, mcd_estimates(stats, rows), _GROUP, F.xxhash64(*FEATURES, *[c for c in ("doc_id",) if c in stats.columns]), rows)
    found = _with_distance(found, "__d").withColumn("distance", F.round("__d", 6))
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, columns unchanged.

    Rows are told apart by hashes of all their columns (96 bits). Statistics are computed once; texts aren't shuffled
    but for the few that two filters of the rejected rows both flag.
    """
    keyed = docs.withColumn("__key", F.struct(F.xxhash64(*docs.columns).alias("a"), F.hash(*docs.columns).alias("b")))
    narrow = keyed.select("__key", F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    verdict = materialize(_judged(narrow, "text", "lang", "source", cutoff).select("__key", "kept"))
    return drop_ids(keyed, "__key", verdict.where(~F.col("kept")).select("__key").distinct(), verdict.select("__key")).select(*docs.columns)
