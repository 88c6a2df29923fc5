"""The inventory of answerable paths of a graph: which anchors reach which literals, and from what source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_name
from ..plans.ast import RDF_TYPE
from ..plans.parser import NAMESPACE, PREFIXES

OWL = "http://www.w3.org/2002/07/owl#"
LABEL, ALT_LABEL = PREFIXES["rdfs"] + "label", PREFIXES["skos"] + "altLabel"
#: Classes of source text, classes of technical records, and the properties whose targets are followed.
SOURCE_CLASSES = ("Article", "Clause", "Point", "Appendix", "DocumentTable", "DocumentTableRow", "Chapter", "AttachedRegulation")
OPAQUE_CLASSES = ("CertificateConversionRule", "TuitionRate", "PaymentFeeRule", "AcademicPerformanceBand", "GraduationClassificationBand", "StudyYearBand", "DoctoralTuitionDurationRule")
PROVISIONS = ("sourceProvision", "instructionProvision", "eligibilityProvision", "deadlineProvision", "resultProvision", "paymentInstructionProvision")
LABELLED = (
    "sourceDocument", "requiresForm", "submittedTo", "reviewedBy", "decidedBy", "supportsPaymentMethod", "supportsBank",
    "appliesToPaymentMethod", "appliesToProgram", "appliesToDisciplineGroup", "appliesToCourseCategory", "appliesToEducationLevel",
    "appliesToEntryQualification", "appliesToLearnerCategory", "appliesToCertificate", "mapsToCompetencyLevel",
    "grantsCourseExemption", "belongsToDisciplineGroup", "billingUnit", "catalogueEntryForForm", "hasCatalogueEntry",
)
#: Fixed values: (id, anchor, kind, source, reason) of answers that the sources do not support.
EXCLUSIONS = (
    ("ClassAbsenceRequestProcedure-resultProvision", "ClassAbsenceRequestProcedure", "literal", "Decision1052Article17Clause01PointB", "Provision mô tả việc xem xét, không bảo đảm một kết quả."),
    ("CourseExemptionAndBonusProcedure-resultProvision", "CourseExemptionAndBonusProcedure", "literal", "Decision1052Article21Clause05", "Khoản 5 chỉ quy định điều kiện được xem xét, không mô tả kết quả giải quyết."),
    ("StudyResumptionProcedure-resultProvision", "StudyResumptionProcedure", "literal", "Decision1052Article24Clause03", "Khoản 3 chỉ quy định thủ tục và thời hạn nộp đơn, không mô tả kết quả giải quyết."),
    ("SickLeaveProcedure-submittedTo", "SickLeaveProcedure", "label", "Decision1052Article30", "Hai nhánh nghỉ ốm không có một đơn vị nhận hồ sơ chung rõ ràng."),
    ("ArticulationStudyProcedure-requiresForm", "ArticulationStudyProcedure", "label", "Decision1052Article29", "Điều 29 không quy định biểu mẫu cụ thể."),
)
OPAQUE_REASON = "Nhãn của bản ghi kỹ thuật nội bộ; truy vấn bằng điều kiện nghiệp vụ thay vì IRI của bản ghi."
ENTRY = "id string, anchor string, answer_kind string, path array<string>, provenance array<string>, status string, reason string"


def predicate(component: str) -> str:
    return LABEL if component == "rdfs:label" else NAMESPACE + component


def component(p: Column) -> Column:
    return F.when(p == LABEL, "rdfs:label").otherwise(local_name(p))


def type_names(triples: DataFrame) -> DataFrame:
    """(s, types): the sorted local type names of every typed node."""
    return triples.where(F.col("p") == RDF_TYPE).groupBy("s").agg(F.array_sort(F.collect_set(local_name(F.col("o.lex")))).alias("types"))


def is_opaque(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, OPAQUE_CLASSES)))


def semantic_individuals(triples: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(s, types) of named individuals of the namespace that are not pieces of source text."""
    source = F.array(*map(F.lit, SOURCE_CLASSES))
    typed = type_names(triples)
    named = F.array_contains("types", "NamedIndividual")
    return typed.where(named & (F.col("s.k") == 0) & F.startswith(F.col("s.lex"), F.lit(namespace)) & ~F.arrays_overlap("types", source))


def resolve_paths(triples: DataFrame, anchors: DataFrame, path: list[str]) -> DataFrame:
    """(s, values): literals reached from each anchor by ``path``, sorted by text and language.

    An anchor has none when a step before the last meets a literal, or the last meets a node.
    """
    reach = anchors.select("s", F.col("s").alias("n"))
    for i, c in enumerate(path):
        step = triples.where(F.col("p") == predicate(c)).select(F.col("s").alias("n"), F.col("o").alias("m"))
        reach = reach.join(step, "n").select("s", F.col("m").alias("n")).distinct()
        if i < len(path) - 1:
            # A literal in the middle spoils the whole anchor; it is kept as a mark to the end.
            spoilt = reach.groupBy("s").agg(F.max(F.col("n.k") == 2).alias("bad"))
            reach = reach.join(spoilt.where("NOT bad"), "s", "left_semi").where("n.k = 0")
    got = reach.groupBy("s").agg(F.bool_and(F.col("n.k") == 2).alias("fine"), F.array_sort(F.collect_set(F.struct(F.col("n.lex").alias("text"), F.coalesce("n.lang", F.lit("")).alias("lang")))).alias("values"))
    return got.where("fine").select("s", "values")


def provenance(triples: DataFrame, anchors: DataFrame) -> DataFrame:
    """(s, first, provenance): sources by the first step of a path; ``first`` is a provision property, or null for all others:
    then the source provisions, else the source documents, else the anchor itself."""
    sources = triples.where(F.col("p").isin(*[NAMESPACE + x for x in (*PROVISIONS, "sourceDocument")]) & (F.col("o.k") == 0)).groupBy("s", F.col("p").alias("q")).agg(F.array_sort(F.collect_set(local_name(F.col("o.lex")))).alias("names"))
    own = sources.where(F.col("q") != NAMESPACE + "sourceDocument").select("s", local_name(F.col("q")).alias("first"), F.col("names").alias("provenance"))
    provision = sources.where(F.col("q") == NAMESPACE + "sourceProvision").select("s", F.col("names").alias("a"))
    document = sources.where(F.col("q") == NAMESPACE + "sourceDocument").select("s", F.col("names").alias("b"))
    rest = anchors.select("s").join(provision, "s", "left").join(document, "s", "left").select("s", F.lit(None).cast("string").alias("first"), F.coalesce("a", "b", F.array(local_name(F.col("s.lex")))).alias("provenance"))
    return own.unionByName(rest)


def build_inventory(triples: DataFrame) -> DataFrame:
    """(id, anchor, answer_kind, path, provenance, status, reason), unsorted; sort by id to write it."""
    people = semantic_individuals(triples)
    direct = people.join(triples, "s").where((F.col("o.k") == 2) & (F.col("p") != ALT_LABEL)).select("s", "types", F.array(component(F.col("p"))).alias("path"), F.col("p")).distinct()
    # A direct predicate counts only when all its values are literals.
    mixed = triples.where(F.col("o.k") != 2).select("s", "p").distinct()
    direct = direct.join(mixed, ["s", "p"], "left_anti").drop("p")
    hops = [[p, "officialText"] for p in PROVISIONS] + [[p, "rdfs:label"] for p in LABELLED]
    far = [resolve_paths(triples, people, path).select("s", F.array(*map(F.lit, path)).alias("path")) for path in hops]
    reached = reduce(DataFrame.unionByName, far).join(people, "s").select("s", "types", "path")
    found = direct.unionByName(reached)
    opaque = is_opaque(F.col("types")) & (F.col("path") == F.array(F.lit("rdfs:label")))
    first = F.when(F.col("path")[0].isin(*PROVISIONS), F.col("path")[0])
    sources = provenance(triples, people).select(F.col("s").alias("s2"), F.col("first").alias("f2"), "provenance")
    anchor = local_name(F.col("s.lex"))
    rows = found.withColumn("f", first).join(sources, (F.col("s") == F.col("s2")) & F.col("f").eqNullSafe(F.col("f2"))).select(
        F.concat_ws("-", anchor, F.transform("path", lambda c: F.replace(c, F.lit(":"), F.lit("-")))).alias("id"), anchor.alias("anchor"),
        F.when(F.element_at("path", -1) == "rdfs:label", "label").otherwise("literal").alias("answer_kind"), "path", "provenance",
        F.when(opaque, "excluded").otherwise("supported").alias("status"), F.when(opaque, OPAQUE_REASON).alias("reason"),
    )
    spark = triples.sparkSession
    fixed = spark.createDataFrame([(i, a, k, [], [s], "excluded", r) for i, a, k, s, r in EXCLUSIONS], ENTRY)
    return rows.unionByName(fixed)


def graph_summary(triples: DataFrame) -> DataFrame:
    """One row: triples, classes, object_properties, datatype_properties, named_individuals."""
    kind = lambda c: F.count_distinct(F.when((F.col("p") == RDF_TYPE) & (F.col("o.lex") == OWL + c), F.col("s")))
    return triples.distinct().agg(F.count(F.lit(1)).alias("triples"), kind("Class").alias("classes"), kind("ObjectProperty").alias("object_properties"), kind("DatatypeProperty").alias("datatype_properties"), kind("NamedIndividual").alias("named_individuals"))


def missing_labels(triples: DataFrame, nodes: DataFrame, lang: str | None = "vi") -> DataFrame:
    """Nodes (s) without a label, of the language where one is given."""
    labels = triples.where(F.col("p") == LABEL)
    if lang is not None:
        labels = labels.where(F.col("o.lang") == lang)
    return nodes.select("s").distinct().join(labels.select("s"), "s", "left_anti")
