"""Whole-job checks of datasets, releases and benchmarks, their summaries and reports.

A job asks every check for its violations and raises the one that a reader of the rows, top to bottom, would meet first;
checks over a whole release follow in their own order. Rows have id, query_id, register, input, target,
split and _pos, their place in the split. The families are few and live on the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BenchmarkError, DatasetError
from ..functions.text import casefold, normalize_column
from ..scratch import materialize
from . import constraints as chk
from .catalogue import Family, match_targets, slot_coverage, slot_values
from .evaluation import run_queries
from .neardup import cross_split_near_duplicates
from .summary import number_summary

OUT_OF_DOMAIN = "out-of-domain"
#: A split's rows come before those of the next one.
_SPLIT = 1 << 40


def question_key(text: Column) -> Column:
    """What makes two questions the same."""
    return casefold(normalize_column(text))


def _prepared(rows: DataFrame, families: Mapping[str, Family]) -> DataFrame:
    """``rows`` with slots, domain, question key and their order over all splits, written once."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, chk.SPLITS)), F.col("split")), F.lit(0)) * _SPLIT + F.col("_pos")
    domain = F.create_map(*[F.lit(x) for f in families.values() for x in (f.query_id, f.domain)]) if families else F.lit(None).cast("map<string,string>")
    matched = match_targets(rows, families.values())
    return materialize(matched.withColumns({"domain": F.try_element_at(domain, F.col("query_id")), "__key": question_key(F.col("input")), "__at": order}))


def _later(rows: DataFrame, key: str, check: str) -> DataFrame:
    """Rows of a split that repeat the ``key`` of an earlier one, found by a map-side minimum."""
    keyed = rows.withColumn("__row", F.struct("__at", "id"))
    first = keyed.groupBy("split", key).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    again = keyed.join(first, ["split", key]).where(F.col("__row") != F.col("__first"))
    return chk.violations(again, check, F.col("id"), F.col("__first.id"), F.col("__at"))


def answerless(rows: DataFrame, graph) -> DataFrame:
    """(target, problem): in-domain targets that the guard refuses, that fail, or that return no row. Each distinct text runs once."""
    texts = rows.where(F.col("domain") != OUT_OF_DOMAIN).select("target").distinct()
    found = run_queries(graph, texts, graph.spark)
    problem = F.when(~F.col("parse_ok") | ~F.col("execution_ok"), F.concat(F.lit("query fails: "), F.col("error"))).when(F.size("rows") == 0, "reference query returns no rows")
    return found.select(F.col("query").alias("target"), problem.alias("problem")).where("problem IS NOT NULL")


def row_violations(rows: DataFrame, families: Mapping[str, Family], graph, train_keys: DataFrame | None = None) -> list[DataFrame]:
    """The checks of single rows, in the order in which they are made of a row."""
    at = F.col("__at")
    known = rows.where("domain IS NOT NULL")
    found = [
        chk.blank_fields(rows, order="__at"),
        _later(rows, "id", "duplicate id"),
        _later(rows, "__key", "normalized input duplicates"),
        chk.invalid_register(rows, order="__at"),
        chk.violations(rows.where("domain IS NULL"), "unknown query_id", F.col("id"), F.col("query_id"), at),
        chk.unsafe_text(rows, order="__at"),
        chk.violations(known.where("slots IS NULL"), "target does not match query family", F.col("id"), F.col("query_id"), at),
    ]
    if train_keys is None:
        found[2], found[3] = found[3], found[2]
    else:
        leaks = rows.join(train_keys.select("__key").distinct(), "__key", "left_semi")
        found.insert(3, chk.violations(leaks, "question leaks from training data", F.col("id"), F.lit(""), at))
    # Targets run where they fit their family: any other text may be anything.
    fit = known.where("slots IS NOT NULL")
    found.append(chk.violations(fit.where(F.col("domain") != OUT_OF_DOMAIN).join(F.broadcast(answerless(fit, graph)), "target"), "target", F.col("id"), F.col("problem"), at))
    return found


def _require(found: list[DataFrame], error: type[Exception]) -> None:
    bad = chk.first_violation(*found)
    if bad is not None:
        raise error(f"{bad[1] or 'dataset'}: {bad[0]} ({bad[2]})")


def dataset_summary(rows: DataFrame) -> DataFrame:
    """(split, name, key, n): records, queries, targets, and counts by query, register and domain, in one pass."""
    member = lambda name, key: F.struct(F.lit(name).alias("name"), key.alias("key"))
    counts = rows.select("split", F.explode(F.array(member("records", F.lit("")), member("query", F.col("query_id")), member("register", F.col("register")), member("domain", F.col("domain")))).alias("m")).groupBy("split", "m").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("split", "m.name", "m.key", "n")
    distinct = rows.groupBy("split").agg(F.count_distinct("query_id").alias("queries"), F.count_distinct("target").alias("targets"))
    return counts.unionByName(distinct.unpivot("split", ["queries", "targets"], "name", "n").select("split", "name", F.lit("").alias("key"), "n"))


def validate_dataset(rows: DataFrame, families: Mapping[str, Family], graph) -> DataFrame:
    """The summary of a valid split; DatasetError with its first violation otherwise."""
    if rows.isEmpty():
        raise DatasetError("dataset split is empty")
    rows = _prepared(rows, families)
    _require(row_violations(rows, families, graph), DatasetError)
    return dataset_summary(rows)


def _listed(df: DataFrame, *order: str) -> list:
    return [tuple(r) for r in chk.first_listed(df, *order).collect()]


def release_faults(rows: DataFrame, families: Mapping[str, Family], complete: bool) -> Iterable[tuple[str, DataFrame, tuple[str, ...]]]:
    """(message, faults, order of the faults) of the checks over a whole release, in order; made one at a time."""
    spark = rows.sparkSession
    counts = materialize(chk.family_counts(rows, "query_id", "split", "register"))
    checked = spark.createDataFrame([(q,) for q in sorted(families)], "family string") if complete else counts.select("family").distinct()
    yield "query IDs missing from splits", chk.missing_families(counts, checked), ("split",)
    few = chk.sparse_families(counts, checked)
    yield "query IDs have fewer than four train rows", few.where("split = 'train'"), ("family",)
    yield "query IDs have missing train registers", chk.register_gaps(counts, chk.REGISTERS), ("family",)
    for split in chk.SPLITS[1:]:
        yield f"query IDs have fewer than two {split} rows", few.where(F.col("split") == split), ("family",)
        yield f"query IDs must use two distinct {split} registers", chk.few_registers(counts).where(F.col("split") == split), ("family",)
    if complete:
        yield "finite slot values missing from train", slots_of_train(rows, families).where(F.size("missing") > 0).select("query_id", "slot", "missing"), ("query_id", "slot")
    yield "inputs cross splits", chk.crossing(rows, F.col("__key")), ("key",)
    yield "ids cross splits", chk.crossing(rows, F.col("id")), ("key",)
    yield "near-duplicate questions cross splits", near_duplicates(rows), ()


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(left_id, right_id, score), the most similar first, then by ids."""
    return cross_split_near_duplicates(rows).orderBy(F.desc("score"), "left_id", "right_id")


def slots_of_train(rows: DataFrame, families: Mapping[str, Family]) -> DataFrame:
    seen = rows.where("split = 'train'").select("query_id", F.explode("slots").alias("slot", "value"))
    return slot_coverage(slot_values(families.values(), rows.sparkSession), seen)


def validate_release(rows: DataFrame, families: Mapping[str, Family], graph, require_complete_catalogue: bool = True) -> DataFrame:
    """The summaries of all splits; DatasetError with the first violation in the order of the splits, then of the release."""
    splits = sorted(r[0] for r in rows.select("split").distinct().limit(len(chk.SPLITS) + 1).collect())
    if splits != sorted(chk.SPLITS):
        raise DatasetError(f"release must contain exactly {list(chk.SPLITS)}, not {splits}")
    rows = _prepared(rows, families)
    _require(row_violations(rows, families, graph), DatasetError)
    for message, faults, order in release_faults(rows, families, require_complete_catalogue):
        bad = _listed(faults, *order) if order else [tuple(r) for r in faults.limit(1).collect()]
        if bad:
            raise DatasetError(f"{message}: {bad}")
    return dataset_summary(rows)


def validate_benchmark(rows: DataFrame, families: Mapping[str, Family], graph, train: DataFrame | None = None) -> DataFrame:
    """(name, key, n) of a valid benchmark, with ``queries_supported_by_train``; BenchmarkError with its first violation otherwise.

    Questions must not occur in ``train``, families and finite slot values must."""
    if rows.isEmpty():
        raise BenchmarkError("benchmark is empty")
    base = lambda df, split: _prepared(df.drop("split").withColumn("split", F.lit(split)), families)
    rows, learnt = base(rows, "test"), None if train is None else base(train, "train")
    keys = rows.limit(0) if learnt is None else learnt
    _require(row_violations(rows, families, graph, keys), BenchmarkError)
    if learnt is not None:
        absent = rows.select("query_id").distinct().join(learnt, "query_id", "left_anti")
        if bad := _listed(absent, "query_id"):
            raise BenchmarkError(f"query IDs absent from train: {[q for q, *_ in bad]}")
        finite = slot_values(families.values(), rows.sparkSession).select("query_id", "slot").distinct()
        used = lambda df: df.where("slots IS NOT NULL").select("query_id", F.explode("slots").alias("slot", "value")).distinct()
        unseen = used(rows).join(F.broadcast(finite), ["query_id", "slot"]).join(used(learnt), ["query_id", "slot", "value"], "left_anti")
        if bad := _listed(unseen, "query_id", "slot", "value"):
            raise BenchmarkError(f"finite slot values absent from train: {bad}")
    supported = rows.select("query_id").distinct().join(keys, "query_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return dataset_summary(rows).drop("split").where("name <> 'query'").unionByName(supported.select(F.lit("queries_supported_by_train").alias("name"), F.lit("").alias("key"), "n"))


def paired(examples: DataFrame, predictions: DataFrame, order: str = "_pos") -> DataFrame:
    """Examples with the prediction at the same place (0, 1, ... in ``order`` of each); ValueError unless there are as many."""
    both = materialize(examples.join(predictions.select(order, "prediction", F.lit(True).alias("__p")), order, "full"))
    if not both.where(F.col("__p").isNull() | F.col("id").isNull()).isEmpty():
        raise ValueError("examples and predictions must have the same length")
    return both.drop("__p")


def least_ratio(counts: DataFrame, group: str, of: str, to: str, least: float) -> DataFrame:
    """(family, of, to, ratio) of families with fewer rows of kind ``of`` for each of kind ``to`` than asked."""
    wide = counts.groupBy("family").agg(F.sum(F.when(F.col(group) == of, F.col("rows"))).alias("of"), F.sum(F.when(F.col(group) == to, F.col("rows"))).alias("to"))
    wide = wide.select("family", F.coalesce("of", F.lit(0)).alias("of"), F.coalesce("to", F.lit(0)).alias("to"))
    return wide.withColumn("ratio", F.try_divide("of", "to")).where(F.coalesce(F.col("ratio"), F.lit(float("inf"))) < least)


def dataset_report(rows: DataFrame, families: Mapping[str, Family], graph, files: DataFrame, coverage: Mapping | None = None) -> dict:
    """The report of a valid release as plain values: counts, registers, domains, words, contract, slots, ontology and digests of ``files`` (name, sha256)."""
    from .inventory import graph_summary
    from .summary import split_contract

    summary = validate_release(rows, families, graph).collect()
    rows = _prepared(rows, families)
    value = lambda split, name: next((r["n"] for r in summary if r["split"] == split and r["name"] == name), 0)
    of = lambda split, name: {r["key"]: r["n"] for r in sorted(summary, key=lambda r: r["key"] or "") if r["split"] == split and r["name"] == name}
    total = lambda name: reduce(lambda a, s: {k: a.get(k, 0) + s.get(k, 0) for k in sorted({*a, *s})}, [of(s, name) for s in chk.SPLITS], {})
    distinct = rows.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("query_id").alias("query_families"), F.count_distinct("target").alias("targets")).first()
    words = number_summary(rows, F.size(F.split(normalize_column(F.col("input")), " "))).first().asDict()
    return {
        "dataset": distinct.asDict() | {
            "catalogue_families": len(families), "domains": total("domain"), "registers": total("register"), "input_words": words,
            "splits": {s: {"records": value(s, "records"), "query_families": value(s, "queries"), "targets": value(s, "targets"), "domains": of(s, "domain")} for s in chk.SPLITS},
        },
        "in_domain_contract": split_contract(rows, "split", "query_id").first().asDict(),
        "slot_coverage": [r.asDict() for r in slots_of_train(rows, families).orderBy("query_id", "slot").collect()],
        "coverage": dict(coverage or {}),
        "ontology": graph_summary(graph.triples).first().asDict(),
        "sha256": {r["name"]: r["sha256"] for r in files.orderBy("name").collect()},
    }


def eligible_models(reports: DataFrame, records: Mapping[str, int], manifest_sha256: str) -> DataFrame:
    """``reports`` (model, has_config, merged, manifest_sha256, validation_count, benchmark_count) if every model was trained on this
    manifest, merged, and scored on all records of both files; no row otherwise: one failure withholds the report."""
    fine = F.col("has_config") & F.col("merged") & (F.col("manifest_sha256") == manifest_sha256) & (F.col("validation_count") == records["validation"]) & (F.col("benchmark_count") == records["benchmark"])
    every = reports.agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("__all"))
    return reports.join(F.broadcast(every), F.col("__all")).drop("__all")
