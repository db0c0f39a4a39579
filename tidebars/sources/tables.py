"""Bars and ticks from tables, derived tables kept by fingerprint, and table sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table; with a schema nothing is inferred, and a missing path fails when it is planned."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The source's columns under the library's names: {ours: theirs}."""
    require_columns(df, list(columns.values()))
    return df.select(*[F.col(theirs).alias(ours) for ours, theirs in columns.items()])


def save(df: DataFrame, path: str, overwrite: bool = False, by: Sequence[str] = (), kind: str = "parquet") -> None:
    """Write a table, refusing to replace one unless told to; ``by`` names partition columns."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def save_records(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write one JSON object a row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def fingerprint(df: DataFrame, ordered_by: Sequence[str] = ()) -> DataFrame:
    """One row (rows, hash_sum, hash_xor, digest) of a table's content and schema.

    Without ``ordered_by`` the order of rows does not count; with it, the rank of each row goes into its hash.
    """
    schema = F.lit(df.schema.json())
    rows = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")) if not ordered_by else _ranked(df, ordered_by)
    found = rows.agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))
    return found.withColumn("digest", F.sha2(F.concat_ws("|", schema, F.col("rows").cast("string"), F.coalesce("hash_sum", F.lit("")), F.coalesce(F.col("hash_xor").cast("string"), F.lit(""))), 256))


def _ranked(df: DataFrame, ordered_by: Sequence[str]) -> DataFrame:
    """(h): each row's hash with its rank, numbered inside sorted partitions and moved on by the rows of those before."""
    from pyspark.sql import Window

    path = f"{scratch(df.sparkSession)}/ranked-{uuid.uuid4().hex}"  # sorted once: a second sort may cut its ranges elsewhere
    id_ = F.monotonically_increasing_id()
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    df.orderBy(*ordered_by).select(F.shiftright(id_, 33).alias("part"), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias("i"), whole.alias("row")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(sizes, "part").select(F.xxhash64(F.col("offset") + F.col("i"), "row").alias("h"))


def composite_fingerprint(frames: Sequence[DataFrame], settings: dict) -> str:
    """A digest of several tables and settings."""
    import hashlib

    parts = [f.select("digest").first()[0] for f in map(fingerprint, frames)]
    return hashlib.sha256(json.dumps([parts, settings], sort_keys=True, default=str).encode()).hexdigest()


def scratch(spark: SparkSession) -> str:
    """The folder for derived tables: the cluster's ``spark.checkpoint.dir``; a temporary one only in a local session that names none."""
    import tempfile

    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidebars-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path + "/_SUCCESS")
    return fs.exists(p)


def publish(df: DataFrame, path: str) -> None:
    """Write a table beside ``path`` and rename it there; where another application was first, its table stays."""
    spark = df.sparkSession
    folder, _, name = path.rpartition("/")
    beside = f"{folder}/_{name}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    fs, to = file_system(spark, path)
    if not (not exists(spark, path) and fs.rename(file_system(spark, beside)[1], to)):
        fs.delete(file_system(spark, beside)[1], True)


def states(spark: SparkSession, folder: str) -> list[str]:
    """The complete tables of a folder, in the order of their names."""
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        return []
    found = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [f"{folder}/{n}" for n in found if not n.startswith("_") and exists(spark, f"{folder}/{n}")]


def materialize(spark: SparkSession, path: str, digest: str, plan: Callable[[], DataFrame]) -> DataFrame:
    """A derived table: read if it was built under ``digest``, else built and written.

    Each digest has a folder of its own, written beside and renamed, so a half-written table is
    never read and two applications never write one.
    """
    own = f"{path.rstrip('/')}/{digest}"
    if not exists(spark, own):
        publish(plan(), own)
    return spark.read.parquet(own)


def not_committed(work: DataFrame, committed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``work`` whose keys have no row in ``committed``."""
    return work.join(committed.select(*keys).distinct(), list(keys), "left_anti")


def append_once(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` and those of ``new`` whose keys are not there yet, one for each key."""
    return rows.unionByName(new.dropDuplicates(list(keys)).join(rows.select(*keys).distinct(), list(keys), "left_anti"))
