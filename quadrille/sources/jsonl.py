"""JSON Lines readers with strict schemas, and writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BenchmarkError, CurationError, DatasetError
from ..scratch import materialize

FIELDS = ("id", "query_id", "register", "input", "target")
SPLITS = ("train", "val", "test")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_pos, value): lines with their 1-based numbers, blank ones left out. The parts of a folder count on in order of their names.

    A part is read as one split, which gives the line numbers that messages name.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")
    lines = whole.select("file", F.posexplode(cut).alias("i", "value"))
    files = whole.inputFiles()
    if len(files) > 1:
        sizes = whole.select("file", F.size(cut).cast("long").alias("n"))  # a row a part
        before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lines = lines.join(F.broadcast(sizes.select("file", before.alias("before"))), "file")
    else:
        lines = lines.withColumn("before", F.lit(0))
    return lines.select((F.col("before") + F.col("i") + 1).cast("long").alias("_pos"), "value").where(F.trim(F.regexp_replace("value", "\\s+", " ")) != "")


def _checked(lines: DataFrame, fields: tuple[str, ...], error: type[ValueError], what: str) -> DataFrame:
    """The lines as columns, written once; the first line that is no object of exactly these string fields raises ``error``."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    keys = F.json_object_keys("value")
    kinds = F.transform(F.array(*map(F.lit, fields)), lambda f: f)
    parsed = lines.withColumns({"__v": F.try_parse_json("value"), "__r": F.from_json("value", schema)})
    want = F.array_sort(kinds)
    # A line as it should be is told by its schema alone; the others say what is wrong.
    good = F.schema_of_variant("__v") == f"OBJECT<{', '.join(f'{f}: STRING' for f in sorted(fields))}>"
    fault = (
        F.when(good, None).when(F.col("__v").isNull(), "invalid JSON")
        .when(keys.isNull(), "not an object")
        .when(F.array_sort(keys) != want, F.concat(F.lit("fields must be exactly "), F.lit(", ".join(fields))))
        .when(F.exists(F.array(*[F.schema_of_variant(F.try_variant_get("__v", f"$.{f}", "variant")) for f in fields]), lambda k: F.coalesce(k != "STRING", F.lit(True))), "fields must be strings")
    )
    read = materialize(parsed.select("_pos", fault.alias("__f"), "__r.*"))
    bad = read.where("__f IS NOT NULL").orderBy("_pos").select("_pos", "__f").limit(1).collect()
    if bad:
        raise error(f"{what}: line {bad[0][0]}: {bad[0][1]}")
    return read.drop("__f")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Question records in file order (``_pos``)."""
    return _checked(read_lines(spark, path), FIELDS, DatasetError, path)


def load_release(spark: SparkSession, folder: str) -> DataFrame:
    """The three splits of a release as one table with a split column; of a folder with versions, the one that was committed last."""
    folder, out = committed(spark, folder) or folder, None
    for s in SPLITS:
        one = load_dataset(spark, f"{folder}/{s}.jsonl").withColumn("split", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def load_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return _checked(read_lines(spark, path), FIELDS, BenchmarkError, path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction); an id given twice is an error."""
    rows = _checked(read_lines(spark, path), ("id", "prediction"), BenchmarkError, path)
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("p")).where("n > 1").orderBy("p").limit(1).collect()
    if twice:
        raise BenchmarkError(f"{path}: duplicate prediction id: {twice[0]['id']}")
    return rows.drop("_pos")


def load_staging(spark: SparkSession, folder: str, shards: tuple[str, ...]) -> DataFrame:
    """Staged rows with their shard and split; a missing file is an error."""
    out = None
    for shard in shards:
        for split in SPLITS:
            try:
                one = _checked(read_lines(spark, f"{folder}/{shard}/{split}.jsonl"), FIELDS, CurationError, f"{shard}/{split}")
            except CurationError:
                raise
            except Exception as e:
                raise CurationError(f"missing staging file: {shard}/{split}.jsonl") from e
            one = one.withColumns({"shard": F.lit(shard), "split": F.lit(split)})
            out = one if out is None else out.unionByName(one)
    return out


def load_checklist(spark: SparkSession, path: str) -> DataFrame:
    """(class, ids) from a JSON object of lists."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("class", "ids"))
    return pairs


def load_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def training_curves(report: DataFrame) -> DataFrame:
    """(epoch, curve, value) from a report's training_log: loss and answer-exact points, by which key is present."""
    log = report.select(F.explode("training_log").alias("e"))
    names = [f.name for f in log.schema["e"].dataType.fields]
    out = None
    for key in ("loss", "eval_answer_exact_rate"):
        if key in names:
            one = log.where(F.col(f"e.{key}").isNotNull()).select(F.col("e.epoch").cast("double").alias("epoch"), F.lit(key).alias("curve"), F.col(f"e.{key}").cast("double").alias("value"))
            out = one if out is None else out.unionByName(one)
    return out


# Sinks.
def _encoded(df: DataFrame) -> Column:
    """Rows as compact objects, fields in column order, without the columns that only give their order."""
    return F.to_json(F.struct(*[c for c in df.columns if c != "_pos"]), {"ignoreNullFields": "false"}).alias("value")


def write_jsonl(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One compact object a line. Ordered rows are dealt by range, so that parts in order of their names hold the rows in order, and no
    task holds all of them."""
    order = order or ([F.col("_pos")] if "_pos" in df.columns else None)
    rows = df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(_encoded(df)).write.mode("overwrite").text(path)


#: The folder of a release's commits: files named by number and version, put in place by a rename. The last name counts.
COMMITS = "_COMMITS"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and its path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, written beside its place and renamed to it when it is whole."""
    system, aside = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not system.rename(aside, _file_system(spark, path)[1]):
        raise OSError(f"cannot write {path}")


def _commits(spark: SparkSession, folder: str) -> list[str]:
    system, at = _file_system(spark, f"{folder}/{COMMITS}")
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    return sorted(n for n in names if not n.endswith(".tmp"))


def committed(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version of a release that was committed last; None where there is none."""
    names = _commits(spark, folder)
    return f"{folder}/version-{names[-1].partition('-')[2]}" if names else None


def write_release(release: DataFrame, folder: str, order: list[Column] | None = None) -> str:
    """A release (questions with a split column) as a new version of ``folder``; returns that version's folder.

    Splits are written in parallel parts first, then the manifest with counts and the digest of each part, and only then a commit
    names the version. Until that rename readers see the old release whole, after it the new one; a write that dies leaves a
    folder that nothing names. Old versions stay until they are deleted by hand.
    """
    spark, name = release.sparkSession, uuid.uuid4().hex
    release, version = materialize(release), f"version-{name}"
    for split in SPLITS:
        write_jsonl(release.where(F.col("split") == split).drop("split"), f"{folder}/{version}/{split}.jsonl", order)
    parts = file_digests(spark, f"{folder}/{version}/*.jsonl/part-*").withColumn("name", F.concat_ws("/", F.element_at(F.split("path", "/"), -2), "name"))
    _put_text(spark, f"{folder}/{version}/manifest.json", json.dumps(manifest(release, parts), ensure_ascii=False, indent=2) + "\n")
    number = int(last[-1].partition("-")[0]) + 1 if (last := _commits(spark, folder)) else 1
    _file_system(spark, folder)[0].mkdirs(_file_system(spark, f"{folder}/{COMMITS}")[1])
    _put_text(spark, f"{folder}/{COMMITS}/{number:012d}-{name}", version)
    return f"{folder}/{version}"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A document of driver size as one file below ``path``."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("id", "prediction").write.mode("overwrite").json(path)


def inventory_json(entries: DataFrame, namespace: str) -> str:
    """The answer inventory as pretty JSON, sorted by id. An inventory is of driver size."""
    rows = [r.asDict(recursive=True) for r in entries.orderBy("id").collect()]
    return json.dumps({"schema_version": 1, "ontology_namespace": namespace, "entries": [{k: v for k, v in r.items() if v is not None} for r in rows]}, ensure_ascii=False, indent=2) + "\n"


def manifest(release: DataFrame, files: DataFrame) -> dict:
    """Counts per split, digests per file and the contract between splits."""
    from ..operators.summary import split_contract

    counts = release.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("query_id").alias("families"), F.count_distinct("target").alias("targets"))
    contract = split_contract(release, "split", "target").first()
    return {
        "schema_version": 1,
        "splits": {r["split"]: {"records": r["records"], "families": r["families"], "targets": r["targets"]} for r in counts.orderBy("split").collect()},
        "files": {r["name"]: r["sha256"] for r in files.orderBy("name").collect()},
        "targets": contract.asDict(),
    }


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256, path) of the files that ``path`` names; a file is held whole, so of 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "path")
