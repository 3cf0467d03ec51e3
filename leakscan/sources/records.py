"""Stored records: CSV with a byte order mark and several boolean spellings, corpus and checkpoint JSON, and their sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan import dims as D
from leakscan.operators import corpus
from leakscan.sources.split import read_csv_split, read_json_split

RECORD = "model string, category string, condition string, type string, template_id string, pid int, hit string, match_method string, expected string, output string"
HELD_OUT = "pid int, category string, hit string, well_formed string, valid string, recited string, novel_valid string, extracted string, output string"
PERSON = "pid int, full_name string, gender string, employer string, employer_code string, role string, national_id string, mobile_phone string, unionpay_card string, social_credit_code string, medical_record_id string, soe_employee_id string"
CORPUS = f"meta struct<n_persons: int, seed: bigint, categories: array<string>, note: string>, persons array<struct<{', '.join(f.replace(' ', ': ') for f in PERSON.split(', '))}>>"


def truth(v: Column) -> Column:
    return F.coalesce(F.lower(F.trim(v)).isin("true", "1"), F.lit(False))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: str = RECORD, label: str | None = None, recursive: bool = False, files: int | None = None, bools: tuple[str, ...] = ("hit",), strict_true: bool = False) -> DataFrame:
    """Records by the names in each file's header; columns that a file lacks are null. An absent path gives no rows; outputs may hold line breaks,
    and a file of any size is read by many tasks. label replaces the model; recursive takes records*.csv below path,
    files so many of them at most, in order of their names; strict_true counts only 'true' as true."""
    if not _exists(spark, path):
        x = spark.createDataFrame([], schema)
    else:
        how = {"recursiveFileLookup": True, "pathGlobFilter": "records*.csv", "ignoreCorruptFiles": True} if recursive else {}
        paths: str | list[str] = path
        if files is not None:
            found = spark.read.options(**how).format("binaryFile").load(path).select("path").orderBy("path").limit(files)
            paths = [r.path for r in found.collect()]
        x = read_csv_split(spark, paths, schema, **({} if files is not None else how)) if paths else spark.createDataFrame([], schema)
    for b in bools:
        x = x.withColumn(b, F.coalesce(F.lower(F.trim(F.col(b))) == "true", F.lit(False)) if strict_true else truth(F.col(b)))
    return x.withColumn("model", F.lit(label)) if label else x


def write_csv(x: DataFrame, path: str, compression: str | None = None) -> None:
    """Missing values as empty strings; a directory of parts, so the writer scales with the rows. compression: Spark's name of a codec, such as gzip; one task
    then reads a part."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in x.columns]
    x.select(*cols).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path, compression=compression)


def _document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one document from its sorted rows: the beginning, the objects with commas between, the end."""
    n, end = 0, None
    for b in batches:
        out = []
        for place, text in zip(b.column("place").to_pylist(), b.column("text").to_pylist(), strict=True):
            if place == 0:
                begin, end = json.loads(text)
                out.append(begin)
            else:
                out.append("," + text if n else text)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    if end is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end.replace("{n}", str(n))], pa.string())], ["value"])


def _write_document(rows: DataFrame, text: Column, path: str, begin: str, end: str, order: list[str] | None = None) -> None:
    """Rows, each as the text of an object, as one JSON document between begin and end (where {n} is their number), one a line. One task writes it, row by row; nothing is gathered."""
    keys = [F.col(k).alias(f"_{i}") for i, k in enumerate(order or [])]
    x = rows.select(F.lit(1).alias("place"), text.alias("text"), *keys)
    frame = rows.sparkSession.range(1).select(F.lit(0).alias("place"), F.lit(json.dumps([begin, end])).alias("text"), *[F.lit(None).alias(f"_{i}") for i in range(len(keys))])
    one = frame.unionByName(x).repartition(1).sortWithinPartitions("place", *[f"_{i}" for i in range(len(keys))])
    one.select("place", "text").mapInArrow(_document, "value string").write.mode("overwrite").text(path)


def _entry(key: str, value: Column) -> Column:
    """An object's member: the quoted key, a colon and the value."""
    quoted = F.to_json(F.array(F.col(key).cast("string")))
    return F.concat(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2), F.lit(": "), value)


def read_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Persons of a corpus document (meta, persons) of any size, or of many, one a line."""
    if not lines:
        return read_json_split(spark, path, PERSON, field="persons")
    return spark.read.schema(CORPUS).json(path).select(F.inline("persons"))


def write_corpus(people: DataFrame, path: str, seed: int = D.SEED, lines: bool = False, part: int = 10_000) -> None:
    """A corpus document, which one task writes person by person; lines: a document for each part of so many pids, one a line, by many tasks."""
    own = F.struct(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in PERSON.split(", ")]).alias("p")
    meta = F.struct(F.col("n").alias("n_persons"), F.lit(seed).cast("bigint").alias("seed"), F.array(*map(F.lit, D.CATEGORIES)).alias("categories"), F.lit("fictitious persons").alias("note"))
    if lines:
        x = people.select(F.floor(F.col("pid") / part).alias("k"), own).groupBy("k").agg(F.sort_array(F.collect_list("p")).alias("persons"))
        x.withColumn("n", F.size("persons")).select(meta.alias("meta"), "persons").write.mode("overwrite").json(path)
        return
    head = people.agg(F.count("*").alias("n")).select(F.to_json(meta)).first()[0]
    _write_document(people, F.to_json(own), path, f'{{"meta": {head}, "persons": [', "]}", ["pid"])


def cached_corpus(spark: SparkSession, path: str, n: int, seed: int = D.SEED) -> DataFrame:
    """The first n persons of the corpus document at path, which is made anew unless it has that seed and n persons."""
    meta = read_json_split(spark, path, "n_persons int, seed bigint", key="name").where("name = 'meta'").first() if _exists(spark, path) else None
    if meta is None or meta.seed != seed or (meta.n_persons or 0) < n:
        # persons who share an id or a phone number with another go, so there are some more keys than persons
        made = corpus.persons(spark.range(n + n // 50 + 8).withColumnRenamed("id", "key"), "key", seed=seed)
        write_corpus(corpus.first_persons(made, n), path, seed)
    return corpus.first_persons(read_corpus(spark, path), n)


def read_map(spark: SparkSession, path: str, value: str, field: str | None = None) -> DataFrame:
    """A JSON object of key -> struct, of any size, as rows: key and the struct's fields; field: the object is that field of the document."""
    return read_json_split(spark, path, value, field=field, key="key")


def renamed_key(x: DataFrame, old: str, new: str, column: str = "key") -> DataFrame:
    """Renames a key; an error if the new one is there already."""
    clash = F.max((F.col(column) == new).cast("int")).alias("_clash")
    x = x.crossJoin(F.broadcast(x.agg(clash)))
    ok = F.when(F.col("_clash") == 1, F.raise_error(F.lit(f"{new} exists")).cast("string")).otherwise(F.col(column))
    return x.withColumn(column, F.when(ok == old, new).otherwise(ok)).drop("_clash")


def read_exam(spark: SparkSession, path: str, shots: int) -> DataFrame:
    """Parquet with subject, split, id, question, A to D, answer: val rows with the subject's first dev rows as prefix."""
    from pyspark.sql import Window

    x = spark.read.parquet(path)
    shown = F.concat(F.col("question"), *[F.concat(F.lit(f"\n{c}. "), F.col(c)) for c in "ABCD"], F.lit("\n答案："))
    x = x.withColumn("shown", shown).withColumn("answer", F.upper(F.trim("answer")))
    dev = x.where("split = 'dev'").withColumn("_r", F.row_number().over(Window.partitionBy("subject").orderBy("id"))).where(F.col("_r") <= shots)
    dev = dev.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat("shown", "answer").alias("t")))), lambda s: s["t"]), "\n\n").alias("prefix"))
    val = x.where("split = 'val'").join(F.broadcast(dev), "subject", "left")
    return val.select("subject", "id", "answer", F.concat(F.coalesce(F.concat("prefix", F.lit("\n\n")), F.lit("")), "shown").alias("prompt"))


def write_json_map(rows: DataFrame, path: str, key: str = "key") -> None:
    """Rows as one JSON object of key -> struct, one a line, which one task writes row by row."""
    _write_document(rows, _entry(key, F.to_json(F.struct(*[c for c in rows.columns if c != key]))), path, "{", "}", [key])


def read_rows(spark: SparkSession, path: str, schema: str, needs: tuple[str, ...] = (), array: bool = True) -> DataFrame:
    """Run rows of a JSON array of any size, or (array is false) of objects one after another, of which a file is one task; rows that lack a needed field are left out."""
    x = read_json_split(spark, path, schema) if array else spark.read.schema(schema).json(path, multiLine=True)
    return x.dropna(subset=list(needs)) if needs else x


def write_array(rows: DataFrame, path: str) -> None:
    """Rows as one JSON array, one a line, which one task writes row by row: sweeps, task-utility records."""
    _write_document(rows, F.to_json(F.struct(*rows.columns)), path, "[", "]")


SUMMARY = "model string, aggregate_rwmer double, mean_clmd double, risk_band string"
PER_CATEGORY = "model string, category string, pri double, mer_zh2zh double, mer_en2zh double, clmd double, mer_worst double, rwmer double"


def read_bundle(spark: SparkSession, path: str, part: str = "summary") -> DataFrame:
    """summary or per_category of a results bundle."""
    return read_json_split(spark, path, {"summary": SUMMARY, "per_category": PER_CATEGORY}[part], field=part)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of a statistics report by condition, without those whose point is 0."""
    x = read_map(spark, path, "rwmer struct<point: double, lo: double, hi: double, width: double>", field="conditions")
    return x.select(F.col("key").alias("condition"), "rwmer.*").where("point <> 0")


CASE = "case_id string, source string, kind string, pid bigint, category string, expected string, output string, label_leak boolean, why string"


def write_cases(cases: DataFrame, path: str) -> None:
    """The labelled set as one JSON document: note, cases, n; one task writes it case by case."""
    _write_document(cases, F.to_json(F.struct(*cases.columns)), path, '{"note": "labels follow from how a case is built", "cases": [', '], "n": {n}}', cases.columns)


def read_cases(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    x = read_json_split(spark, path, CASE, field="cases")
    return x.where("label_leak IS NOT NULL") if labelled else x


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Small tables as CSV folders of one part each."""
    for name, x in tables.items():
        x.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def rename_in_files(paths: list[str], old: str, new: str, extra: dict | None = None) -> list[str]:
    """Renames a condition in JSON files on the driver, in its place and with values added; each file is kept beside itself first.

    Returns the files that had it. Nothing is written if any file has the new name already.
    """
    found = {}
    for p in filter(os.path.exists, paths):
        with open(p, encoding="utf-8") as f:
            found[p] = f.read()
    docs = {p: json.loads(t) for p, t in found.items()}
    if any(new in d["conditions"] for d in docs.values() if old in d["conditions"]):
        raise ValueError(f"{new} exists")
    changed = [p for p, d in docs.items() if old in d["conditions"]]
    for p in changed:
        with open(f"{p}.bak", "w", encoding="utf-8") as f:
            f.write(found[p])
        docs[p]["conditions"] = {new if k == old else k: v | (extra or {}) if k == old else v for k, v in docs[p]["conditions"].items()}
        with open(p, "w", encoding="utf-8") as f:
            json.dump(docs[p], f, ensure_ascii=False, indent=1)
    return changed


def read_settings(path: str) -> dict[str, str]:
    """KEY=value lines of a settings file; comments, blank lines and quotes around values are dropped; an absent file has none."""
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not key.startswith("#"):
                    out[key.strip()] = value.strip().strip("'\"")
    return out
