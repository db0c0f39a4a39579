"""Derived tables that are never stale: content digests as a tree, and rebuilds of what changed alone.

A source's rows are hashed into parts, such as a key's day. Hashes of rows add up, so parts of
several files or builds combine without their rows being seen again, and their digests combine upwards,
part to day to all, to one root. A derived table lies under a folder named by its settings
and by the code of this library, so a change of either builds it anew; inside, a committed
table holds the tree that it was built from. A later state of the source is compared from the root down,
into those nodes alone that differ; only parts whose content changed, and those whose look-back reaches one
that did, are built again and written over theirs. Nothing is decided by times or sizes of folders.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.sources.tables import file_system, publish, states

NUMBER = "decimal(38,0)"
FILE = ("file_path", "file_size", "file_modification_time")
LISTED = 10_000  # changed files that are read by name; beyond, the whole source is read for the same result


def halves(digest: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers of a hex digest."""
    return tuple(F.conv(F.substr(digest, F.lit(at), F.lit(15)), 16, 10).cast(NUMBER) for at in (1, 16))


def canonical(columns: Sequence[Column]) -> Column:
    """A row as text; null differs from any value."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("!")) for c in columns])


def _summed(rows: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("rows").cast("long").alias("rows"), F.sum("a").cast(NUMBER).alias("a"), F.sum("b").cast(NUMBER).alias("b"), *more)


def leaves(df: DataFrame, by: Sequence[str], columns: Sequence[str | Column]) -> DataFrame:
    """(by, rows, a, b): for each part the number of its rows and the sums of their hashes, in any order of rows."""
    a, b = halves(F.md5(canonical([F.col(c) if isinstance(c, str) else c for c in columns])))
    return _summed(df.select(*by, F.lit(1).cast("long").alias("rows"), a.alias("a"), b.alias("b")), by)


def with_digest(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("digest", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "a", "b")])))


def tree(parts: DataFrame, by: Sequence[str]) -> list[DataFrame]:
    """Levels of digests from the parts (keys ``by``) up to the root (no key), each without the last key of the one below.

    A node's sums are those of its children's digests together with their keys.
    """
    levels = [with_digest(_summed(parts, by))]
    for n in range(len(by) - 1, -1, -1):
        a, b = halves(F.md5(canonical([*map(F.col, by[: n + 1]), F.col("digest")])))
        levels.append(with_digest(_summed(levels[-1].select(*by[:n], "rows", a.alias("a"), b.alias("b")), by[:n])))
    return levels


def flat(levels: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """All levels as one table: level 0 is the root, and keys that a level does not have are null."""
    types = dict(levels[0].dtypes)
    rows = [x.select(F.lit(len(by) - k).alias("level"), *[F.col(c) if c in x.columns else F.lit(None).cast(types[c]).alias(c) for c in by], "rows", "digest") for k, x in enumerate(levels)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def changed(before: DataFrame, now: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, was, is_): the parts whose digests differ between two flat trees, found from the root down.

    ``was`` is null for new parts, ``is_`` for parts that are gone.
    """
    found = None
    for level in range(len(by) + 1):
        keys = list(by[:level])
        pair = [t.filter(F.col("level") == level).select(*keys, F.col("digest").alias(n)) for t, n in ((before, "was"), (now, "is_"))]
        if found is not None and level > 1:
            pair = [p.join(found.select(*keys[:-1]), keys[:-1], "left_semi") for p in pair]
        both = pair[0].join(pair[1], keys, "full") if keys else pair[0].withColumn("one", F.lit(1)).join(pair[1].withColumn("one", F.lit(1)), "one", "full").drop("one")
        found = both.filter(~F.col("was").eqNullSafe(F.col("is_")))
    return found


def reached(before: DataFrame, now: DataFrame, stale: DataFrame, by: Sequence[str], order: str, look_back: int, stored_by: Sequence[str]) -> DataFrame:
    """(by, rebuild, read): the parts to build again, and those that building them reads.

    A part is built again if it or one of the ``look_back`` parts before it, in ``order`` and with the other keys alike, is stale or gone, or
    if it is stored with such a part. Read are those and the ``look_back`` parts before each that there are now.
    """
    w = Window.partitionBy(*[c for c in by if c != order]).orderBy(order)
    rows = before.select(*by).union(now.select(*by)).distinct()
    for flag, marks in (("_s", stale), ("_now", now)):
        rows = rows.join(marks.select(*by, F.lit(True).alias(flag)), list(by), "left")
    rows = rows.withColumn("rebuild", F.max("_s").over(w.rowsBetween(-look_back, 0)).isNotNull())
    if set(stored_by) != set(by):
        rows = rows.withColumn("rebuild", F.max("rebuild").over(Window.partitionBy(*stored_by)))
    gone = rows.filter("_now IS NULL AND rebuild").select(*by, "rebuild", F.lit(False).alias("read"))
    rows = rows.filter("_now").withColumn("read", F.max("rebuild").over(w.rowsBetween(0, look_back)))
    return rows.filter("read").select(*by, "rebuild", "read").union(gone)


@lru_cache(1)
def code_version() -> str:
    """A digest of the library's code as this process started with it, the operators of llm apart."""
    top = Path(__file__).resolve().parents[1]
    files = sorted(p for p in top.rglob("*.py") if p.relative_to(top).parts[0] != "llm")
    return hashlib.md5(b"".join(str(p.relative_to(top)).encode() + p.read_bytes() for p in files)).hexdigest()


def settings_digest(*settings: object) -> str:
    return hashlib.md5(json.dumps([code_version(), repr(settings)]).encode()).hexdigest()


# -- a source of files ----------------------------------------------------------------------------


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_size, file_modification_time) of a Parquet source, listed by Spark; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(*[F.col(f"_metadata.{c}").alias(c) for c in FILE]).filter("file_path LIKE '%.parquet'")


def listing_digest(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a source's files: of a few asked for by the driver, of many by a job."""
    fs, p = file_system(spark, path)
    if fs.getContentSummary(p).getFileCount() > LISTED // 10:
        return with_digest(leaves(files(spark, path), [], FILE)).first()["digest"]
    found, held = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        held.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(json.dumps(sorted(held)).encode()).hexdigest()


def source_leaves(spark: SparkSession, path: str, folder: str, read: Callable[[DataFrame], DataFrame], by: Sequence[str], columns: Sequence[str | Column], again: bool = False) -> DataFrame:
    """The parts of a source, kept by file: only files that are new, or changed by name, size or time, are read.

    ``read`` turns the source's rows into ones with the columns of ``by`` and ``columns``, row by
    row. ``again`` reads all files, whatever the listing says.
    """
    listing, known = listing_digest(spark, path), states(spark, folder)
    if known and known[-1].endswith(listing) and not again:
        return spark.read.parquet(known[-1])
    now, kept, fresh = files(spark, path), None, None
    if known and not again:
        before = spark.read.parquet(known[-1])
        kept = before.join(now, list(FILE), "left_semi")
        fresh = [r[0] for r in now.join(before.select(*FILE).distinct(), list(FILE), "left_anti").select("file_path").limit(LISTED + 1).collect()]
    if fresh is not None and len(fresh) <= LISTED:
        source = spark.read.schema(spark.read.parquet(path).schema).parquet(*fresh) if fresh else None
    else:
        source, kept = spark.read.parquet(path), None
    if source is not None:
        rows = read(source.select("*", *[F.col(f"_metadata.{c}").alias(c) for c in FILE]))
        own = leaves(rows, [*FILE, *by], columns)
        kept = own if kept is None else kept.unionByName(own)
    publish(kept, f"{folder}/{len(known):08d}-{uuid.uuid4().hex[:8]}-{listing}")
    return spark.read.parquet(states(spark, folder)[-1])


_ROOTS: dict[str, str] = {}


def root_of(parts: DataFrame, by: Sequence[str], name: str | None = None) -> str:
    """The digest of a whole source, one row to the driver; ``name`` is that of a table that never changes, asked once."""
    if name not in _ROOTS or name is None:
        _ROOTS[name] = tree(parts, by)[-1].first()["digest"]
    return _ROOTS[name]


# -- a derived table ------------------------------------------------------------------------------


def refresh(
    spark: SparkSession, folder: str, parts: DataFrame, by: Sequence[str], build: Callable[[DataFrame | None], DataFrame],
    order: str | None = None, look_back: int = 0, stored_by: Sequence[str] | None = None, root: str | None = None,
) -> dict:
    """Bring a derived table up to the state ``parts`` (by, rows, a, b) of its source; returns what was done.

    ``by``: the keys of a part, from coarse to fine, all of them columns of the table; ``stored_by``, by default all, name its partitions.
    ``build(asked)`` makes the rows of the parts that ``asked`` (by, rebuild, read) marks with ``rebuild`` from those source parts that it marks with
    ``read``; of None it makes all. Rows of a part may depend on the ``look_back`` parts before it, in the order of the key ``order``.
    A run that is lost before it commits is done again by the next one, with the same result.
    """
    stored_by, root = list(stored_by or by), root or root_of(parts, by)
    committed = states(spark, f"{folder}/committed")
    if committed and committed[-1].endswith(root):
        return {"built": 0, "read": 0, "whole": False}
    at = f"{folder}/committed/{len(committed):08d}-{root}"
    now = flat(tree(parts, by), by)
    leaf = lambda t: t.filter(F.col("level") == len(by))
    if not committed:
        build(None).write.mode("overwrite").partitionBy(*stored_by).parquet(f"{folder}/data")
        publish(now.withColumn("gone", F.lit(False)), at)
        n = leaf(spark.read.parquet(at)).count()
        return {"built": n, "read": n, "whole": True}
    before = spark.read.parquet(committed[-1])
    work = f"{folder}/_work-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    try:
        now = kept(now, "now")
        live = leaf(before).filter("digest IS NOT NULL")
        asked = kept(reached(live, leaf(now), changed(before, now, by), by, order or by[-1], look_back, stored_by), "asked")
        counts = asked.agg(F.count_if("rebuild"), F.count_if("read")).first()
        rows = kept(build(asked), "rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*stored_by).parquet(f"{folder}/data")
        # a part without rows any more may have had nothing to be written over with: the reader leaves it out
        again = asked.filter("rebuild").select(*by)
        empty = again.join(rows.select(*by).distinct(), list(by), "left_anti")
        still = leaf(before).filter("gone").select(*by).join(again, list(by), "left_anti")
        marks = empty.union(still).withColumn("gone", F.lit(True))
        leaves_ = leaf(now).drop("level").join(marks, list(by), "full").withColumns({"level": F.lit(len(by)), "gone": F.coalesce("gone", F.lit(False))})
        publish(leaves_.unionByName(now.filter(F.col("level") < len(by)).withColumn("gone", F.lit(False))), at)
        return {"built": counts[0], "read": counts[1], "whole": False}
    finally:
        fs, p = file_system(spark, work)
        fs.delete(p, True)


def current(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame:
    """The rows of a derived table as last committed."""
    held = spark.read.parquet(states(spark, f"{folder}/committed")[-1])
    data, types = spark.read.parquet(f"{folder}/data"), dict(held.dtypes)
    data = data.withColumns({c: F.col(c).cast(types[c]) for c in by if dict(data.dtypes)[c] != types[c]})  # names of folders have no types
    gone = held.filter("gone").select(*by)
    return data if gone.isEmpty() else data.join(gone, list(by), "left_anti")
