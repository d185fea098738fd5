"""Saved artefacts: an index as four Parquet tables, JSON lines in and out."""

from __future__ import annotations

import hashlib
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.index import Index, dictionary_of, stats_of


def save_index(index: Index, path: str) -> None:
    for f in fields(Index):
        getattr(index, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(Index)))


_STORED: dict[tuple, Index] = {}


def stored_index(spark: SparkSession, table: str, zone: str, make) -> Index:
    """An index that is built once for a table's files and read from the warehouse after that, terms sorted in its files."""
    sc = spark.sparkContext
    key = (sc.applicationId, zone, *sorted(spark.read.parquet(table).inputFiles()))
    if key not in _STORED:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/quillstone-{sc.applicationId}/{zone}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        made = make()
        made.postings.repartition("term").sortWithinPartitions("term", "unit").write.mode("overwrite").parquet(f"{path}/postings")
        made.units.write.mode("overwrite").parquet(f"{path}/units")
        postings, units = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "units"))
        dictionary_of(postings).write.mode("overwrite").parquet(f"{path}/dictionary")
        stats_of(units).write.mode("overwrite").parquet(f"{path}/stats")
        _STORED[key] = load_index(spark, path)
    return _STORED[key]


_TABLES: dict[tuple, DataFrame] = {}


def stored_table(spark: SparkSession, table: str | tuple[str, ...], name: str, make) -> DataFrame:
    """A derived table that is written once for a table's files, or those of several tables, and read from the warehouse after that."""
    tables = (table,) if isinstance(table, str) else table
    key = (spark.sparkContext.applicationId, name, *sorted(f for t in tables for f in spark.read.parquet(t).inputFiles()))
    if key not in _TABLES:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/quillstone-{key[0]}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"
        make().write.mode("overwrite").parquet(path)
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line under a stated schema (no pass to infer one); blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgments with a header; only positive ones."""
    return spark.read.csv(path, sep="\t", header=True, schema="qid string, doc_id string, rel int").where("rel > 0")


def keep_judgments(pool: DataFrame, old: DataFrame) -> DataFrame:
    """The pool (qid, unit) with the judgments it already had; null where there is none."""
    return pool.join(old, ["qid", "unit"], "left")


def merge_json(df: DataFrame, path: str, key: str) -> None:
    """Adds rows to a JSON table; a row replaces the one of the same key. The merged rows are written beside the old ones, then take their place."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        df = df.unionByName(spark.read.json(path, schema=df.schema).join(df.select(key), key, "left_anti"))
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    df.write.mode("overwrite").json(path + ".new")
    fs.delete(fs_path, True)
    fs.rename(beside, fs_path)


def save_vectors(df: DataFrame, path: str) -> None:
    """Embeddings as id and array<float>."""
    df.selectExpr("id", "cast(v as array<float>) as v").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, v array<float>").parquet(path)


#: Claims with their evidence: document -> annotated sentence groups.
CLAIMS = "id long, claim string, cited_doc_ids array<long>, evidence map<string, array<struct<label: string, sentences: array<int>>>>"


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, CLAIMS)
