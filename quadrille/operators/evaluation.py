"""Execution-based evaluation: results of predicted and reference queries compared as multisets of rows.

Distinct query texts of one shape run as one plan; everything after is joins and conditional aggregates.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import NO_INFORMATION_MARKER, execute_select
from ..errors import SparqlError
from ..functions.text import count_of, string_literals
from ..plans.compiler import Compiler
from ..plans.families import CASE, Shape, is_node, parse_shape, plan, signature, value_text, with_shapes
from ..plans.guard import validate_select
from ..plans.solution import column
from ..scratch import materialize, scratch_path
from .constraints import id_differences
from .features import feature_tags, query_features
from .skew import spread_join

METRICS = ("parse", "execution", "answer_exact", "canonical_exact", "marker_exact", "false_acceptance", "safe_rejection", "system_answer_exact")
#: Rows of an answer at most, how many plans run at once, and the most plans whose list is broadcast.
MOST_ROWS, AT_ONCE, MOST_PLANS = 100, 8, 10_000
RESULT = "query string, parse_ok boolean, execution_ok boolean, error string, rows array<array<string>>"
RESULT_COLUMNS = ["query", "parse_ok", "execution_ok", "error", "rows"]
log = logging.getLogger(__name__)


def value_key(c: Column, kind: str) -> Column:
    """A value as type and text; an unbound one as none."""
    return F.when(c.isNull(), F.lit("none:")).otherwise(F.concat(F.lit(f"{kind}:"), c.cast("string")))


def row_key(*values: Column) -> Column:
    """The values of a row, sorted: column names and order do not count."""
    return F.array_sort(F.array(*values))


def run_queries(graph, texts: DataFrame, spark: SparkSession, max_rows: int = MOST_ROWS) -> DataFrame:
    """(query, parse_ok, execution_ok, error, rows) of each distinct text of a one-column table; rows are sorted value keys.

    Texts that differ in constants only are answered by one plan (see plans.families), whose number is that of the shapes
    of texts; the driver holds one text of each shape. AT_ONCE plans run side by side. An answer of more than ``max_rows`` rows is
    an error of its text; rows are counted before they are gathered.
    """
    rows = texts.select(F.col(texts.columns[0]).alias("query")).where("query IS NOT NULL").distinct().withColumn("case", F.monotonically_increasing_id())
    rows = materialize(with_shapes(rows))
    shapes: dict[str, Shape] = {}
    refused: list[tuple[str, str]] = []
    for r in rows.where("problem IS NULL").groupBy("shape").agg(F.min("case").alias("case")).collect():
        try:
            shapes[r["shape"]] = parse_shape(r["shape"])
        except SparqlError:
            try:  # the message of a text as it was written
                validate_select(rows.where(F.col("case") == r["case"]).first()["query"])
                refused.append((r["shape"], "invalid SPARQL"))
            except SparqlError as e:
                refused.append((r["shape"], str(e)))
    path = scratch_path(spark)

    def put(found: DataFrame, name: object) -> None:
        found.select(*RESULT_COLUMNS).write.option("compression", "zstd").parquet(f"{path}/{name}")

    none = F.lit(None).cast("array<array<string>>")
    # The driver holds these lists, so they are broadcast: dealt by shape, all texts of a shape would meet in one task.
    bad = rows.join(F.broadcast(spark.createDataFrame(refused, "shape string, why string")), "shape", "left").where("problem IS NOT NULL OR why IS NOT NULL")
    put(bad.select("query", F.lit(False).alias("parse_ok"), F.lit(False).alias("execution_ok"), F.coalesce("problem", "why").alias("error"), none.alias("rows")), "refused")
    if shapes:
        vary = spark.createDataFrame([(s, sorted(x.slots)) for s, x in shapes.items()], "shape string, vary array<int>")
        signed = rows.join(F.broadcast(vary), "shape").withColumn("signed", signature(F.col("parts"), F.col("vary"), graph.by_name)).drop("vary")
        kinds = materialize(signed.select("shape", "signed").distinct().withColumn("plan", F.monotonically_increasing_id()))
        plans = kinds.toLocalIterator()
        listed = F.broadcast(kinds) if kinds.count() <= MOST_PLANS else kinds
        cut = materialize(signed.join(listed, ["shape", "signed"]).select("plan", "case", "query", "parts").repartition("plan", F.pmod(F.xxhash64("case"), F.lit(16))), by=("plan",))

        def run(p) -> None:
            mine = cut.where(F.col("plan") == p["plan"])
            try:
                put(_answers(graph, shapes[p["shape"]], list(p["signed"]), mine, max_rows), p["plan"])
            except Exception:  # a value that Spark fails on: the texts one by one, so that others keep their answers
                log.exception("a plan failed; its texts run one by one")
                put(spark.createDataFrame([_alone(graph, r["query"], max_rows) for r in mine.toLocalIterator()], RESULT), f"{p['plan']}-alone")

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for _ in pool.map(run, plans):
                pass
    return spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(path)


def _answers(graph, shape: Shape, signed: list[str], rows: DataFrame, max_rows: int) -> DataFrame:
    """The results of all texts of one plan."""
    try:
        tree, slots = plan(shape, signed, rows, graph)
        answer = Compiler(graph.spark, graph).select(tree, slots, CASE)
    except SparqlError as e:
        return rows.select("query", F.lit(True).alias("parse_ok"), F.lit(False).alias("execution_ok"), F.lit(str(e)).alias("error"), F.lit(None).cast("array<array<string>>").alias("rows"))
    names = [n for n in answer.names if n != CASE]
    value = {n: (F.col(column(n)), answer.reps[n]) for n in names}
    # By number in order of names: text in a minimum would be sorted for.
    ranked = sorted(names)
    said_node = [F.when(is_node(*value[n]), ranked.index(n)) for n in names]
    node = F.coalesce(*said_node) if len(names) > 1 else said_node[0]
    said = answer.df.select(F.col(column(CASE)).alias("case"), node.alias("node"), F.array_sort(F.array(*[value_text(*value[n]) for n in names])).alias("row"))
    said = said.groupBy("case", "row", "node").agg(F.count(F.lit(1)).alias("n"))
    sizes = said.groupBy("case").agg(F.sum("n").alias("size"), F.min("node").alias("node"))
    fine = said.join(sizes.where((F.col("size") <= max_rows) & F.col("node").isNull()).select("case"), "case", "left_semi")
    listed = fine.groupBy("case").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("row", F.col("n").cast("int"))))).alias("rows"))
    found = rows.join(sizes, "case", "left").join(listed, "case", "left")
    error = F.when(F.col("size") > max_rows, F.lit(f"the SPARQL result exceeds {max_rows} rows")).when(F.col("node").isNotNull(), F.concat(F.lit("answer column ?"), F.get(F.array(*map(F.lit, ranked)), F.col("node")), F.lit(" holds a graph node: select a label or another literal")))
    none = F.array().cast("array<array<string>>")
    return found.select("query", F.lit(True).alias("parse_ok"), error.isNull().alias("execution_ok"), error.alias("error"), F.when(error.isNull(), F.coalesce("rows", none)).alias("rows"))


def _python_key(v: object) -> str:
    return "none:" if v is None else f"{type(v).__name__}:{v}"


def _alone(graph, query: str, max_rows: int) -> tuple:
    try:
        return query, True, True, None, sorted(sorted(map(_python_key, r.values())) for r in execute_select(graph, query, max_rows=max_rows))
    except SparqlError as e:
        return query, True, False, str(e), None


def multiset_scores(predicted: DataFrame, reference: DataFrame, case: str = "case", row: str = "row") -> DataFrame:
    """(case, predicted, reference, overlap, precision, recall, f1): multiset overlap of the rows of each case.

    Rows of both sides are counted together, per distinct row and within tasks first, so that repeats never multiply and no join holds
    both sides' counts at once. A row is counted under 16 bytes, its digest. A null case or row equals no other.
    """
    digest = F.when(F.col(row).isNotNull(), F.unhex(F.md5(F.to_json(F.struct(row))))).alias("__row")
    side = lambda df, p, r: df.select(F.col(case).alias("__case"), digest, F.lit(p).cast("long").alias("p"), F.lit(r).cast("long").alias("r"))
    both = side(predicted, 1, 0).union(side(reference, 0, 1)).groupBy("__case", "__row").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    equal = F.when(F.col("__case").isNotNull() & F.col("__row").isNotNull(), F.least("p", "r")).otherwise(0)
    sums = both.groupBy(F.col("__case").alias(case)).agg(F.sum("p").alias("predicted"), F.sum("r").alias("reference"), F.sum(equal).alias("overlap"))
    return with_rates(sums)


def with_rates(sums: DataFrame) -> DataFrame:
    precision = F.coalesce(F.try_divide("overlap", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("overlap", "reference"), F.lit(0.0))
    scored = sums.withColumns({"precision": precision, "recall": recall})
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def result_scores(predicted: Column, reference: Column) -> Column:
    """struct(precision, recall, f1) of two arrays of row keys (at most 100 rows each, by the fence)."""
    keys = F.array_distinct(predicted)
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    overlap = F.aggregate(keys, F.lit(0), lambda a, k: a + F.least(count(predicted, k), count(reference, k)))
    p = F.coalesce(F.try_divide(overlap, F.size(predicted)), F.lit(0.0))
    r = F.coalesce(F.try_divide(overlap, F.size(reference)), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def error_category(target: Column, prediction: Column, parse: Column, execution: Column, exact: Column, properties: list[str]) -> Column:
    """The first kind of failure that applies, null for an exact answer."""
    names = lambda q: F.array_distinct(F.regexp_extract_all(q, F.lit("(?<![A-Za-z0-9]):([A-Za-z][A-Za-z0-9]*)"), F.lit(1)))
    known = F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")
    differ = lambda a, b: (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)
    inside, outside = (lambda q: F.array_intersect(names(q), known)), (lambda q: F.array_except(names(q), known))
    return (
        F.when(F.trim(prediction) == NO_INFORMATION_MARKER, "false_rejection")
        .when(~parse, "parse_error").when(~execution, "execution_error").when(exact, None)
        .when(count_of(prediction, " .") < count_of(target, " ."), "missing_branch")
        .when(count_of(prediction, " .") > count_of(target, " ."), "extra_branch")
        .when(differ(string_literals(prediction), string_literals(target)), "wrong_literal")
        .when(differ(inside(prediction), inside(target)), "wrong_property")
        .when(differ(outside(prediction), outside(target)), "wrong_iri")
        .otherwise("semantic_mismatch")
    )


def evaluate_cases(examples: DataFrame, predictions: DataFrame, graph, object_properties: list[str] = (), properties: list[str] = ()) -> DataFrame:
    """One row per example (id, query_id, register, input, target) with its prediction, flags, scores and error category.

    A missing prediction counts as an empty text.
    """
    spark = graph.spark
    cases = materialize(examples.join(predictions.select("id", "prediction"), "id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(""))))
    texts = cases.select(F.explode(F.array_distinct(F.array("target", "prediction"))).alias("q")).where(F.trim(F.col("q")) != NO_INFORMATION_MARKER)
    results = run_queries(graph, texts, spark)
    mine = results.select(F.col("query").alias("prediction"), F.col("parse_ok").alias("p_ok"), F.col("execution_ok").alias("x_ok"), "error", F.col("rows").alias("predicted_rows"))
    theirs = results.select(F.col("query").alias("target"), F.col("rows").alias("reference_rows"))
    # Many cases may have one text. Each text has one result, so the first join keeps the keys of the second as they are.
    total = cases.count()
    c = spread_join(cases, mine, ["prediction"], F.xxhash64("id"), total=total)
    c = spread_join(c, theirs, ["target"], F.xxhash64("id"), total=total, counted=cases)
    marker = F.col("target") == NO_INFORMATION_MARKER
    canonical = F.trim("prediction") == F.col("target")
    none = F.array().cast("array<array<string>>")
    c = c.withColumns({
        "marker": marker, "canonical_exact": canonical, "marker_exact": marker & canonical,
        "parse": F.coalesce("p_ok", F.lit(False)), "execution": F.coalesce("x_ok", F.lit(False)),
        "features": F.when(~marker, query_features(F.col("target"), list(object_properties))),
    })
    exact = F.when(marker, canonical).otherwise(F.col("execution") & F.coalesce(F.col("predicted_rows") == F.col("reference_rows"), F.lit(False)))
    scores = F.when(~marker & F.col("execution"), result_scores(F.coalesce("predicted_rows", none), F.coalesce("reference_rows", none)))
    false_acceptance = marker & ~canonical & F.col("execution") & (F.size(F.coalesce("predicted_rows", none)) > 0)
    c = c.withColumns({"answer_exact": exact, "scores": scores, "false_acceptance": false_acceptance, "safe_rejection": marker & ~false_acceptance})
    category = F.when(marker, F.when(F.col("marker_exact"), None).when(F.col("false_acceptance"), "false_acceptance").otherwise("rejection_mismatch")).otherwise(
        error_category(F.col("target"), F.col("prediction"), F.col("parse"), F.col("execution"), F.col("answer_exact"), list(properties))
    )
    return c.withColumns({
        "system_answer_exact": F.when(F.col("marker"), F.col("safe_rejection")).otherwise(F.col("answer_exact")),
        "result_precision": F.coalesce("scores.precision", F.lit(0.0)), "result_recall": F.coalesce("scores.recall", F.lit(0.0)), "result_f1": F.coalesce("scores.f1", F.lit(0.0)),
        "error_category": category, "tags": F.coalesce(feature_tags(F.col("features")), F.array().cast("array<string>")),
    }).drop("p_ok", "x_ok", "scores", "reference_rows")


def rates() -> list[Column]:
    """The twelve metrics as aggregates over cases; a rate without a denominator is 0."""
    n, of_query, of_marker = F.count(F.lit(1)), F.count_if(~F.col("marker")), F.count_if(F.col("marker"))
    rate = lambda total, by: F.coalesce(F.try_divide(total, by), F.lit(0.0)).cast("double")
    hits = lambda c, when=None: F.count_if(F.col(c) if when is None else F.col(c) & when)
    q = ~F.col("marker")
    return [
        n.alias("count"), rate(hits("parse", q), of_query).alias("parse_rate"), rate(hits("execution", q), of_query).alias("execution_rate"),
        rate(hits("answer_exact"), n).alias("answer_exact_rate"),
        *[rate(F.sum(f"result_{x}"), of_query).alias(f"result_{x}") for x in ("precision", "recall", "f1")],
        rate(hits("canonical_exact"), n).alias("canonical_query_exact_rate"), rate(hits("marker_exact"), of_marker).alias("marker_exact_rate"),
        rate(hits("false_acceptance"), of_marker).alias("false_acceptance_rate"), rate(hits("safe_rejection"), of_marker).alias("safe_rejection_rate"),
        rate(hits("system_answer_exact"), n).alias("system_answer_exact_rate"),
    ]


def scope_rates(cases: DataFrame) -> DataFrame:
    """(scope, metrics): overall, in_domain and out_of_domain, by one grouping-sets aggregate over an array of scopes."""
    scopes = F.array(F.lit("overall"), F.when(F.col("marker"), "out_of_domain").otherwise("in_domain"))
    return cases.withColumn("scope", F.explode(scopes)).groupBy("scope").agg(*rates())


def group_rates(cases: DataFrame) -> DataFrame:
    """(grouping, value, metrics) by register, query feature and family; a case counts for each of its features."""
    one = lambda kind, v: F.struct(F.lit(kind).alias("grouping"), v.alias("value"))
    member = F.concat(F.array(one("register", F.col("register")), one("query_id", F.col("query_id"))), F.transform("tags", lambda t: one("query_feature", t)))
    return cases.withColumn("g", F.explode(member)).groupBy(F.col("g.grouping").alias("grouping"), F.col("g.value").alias("value")).agg(*rates())


def error_counts(cases: DataFrame) -> DataFrame:
    return cases.where("error_category IS NOT NULL").groupBy("error_category").agg(F.count(F.lit(1)).alias("n"))


def evaluate_benchmark(examples: DataFrame, predictions: DataFrame, graph, object_properties: list[str] = (), properties: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The cases of :func:`evaluate_cases`, and (id, problem) of predictions that are missing or belong to no example."""
    return evaluate_cases(examples, predictions, graph, object_properties, properties), id_differences(examples, predictions)


def reference_predictions(examples: DataFrame) -> DataFrame:
    """Predicting the reference itself, for a self-check: every rate is 1."""
    return examples.select("id", F.col("target").alias("prediction"))
