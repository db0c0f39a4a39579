"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of all.

The texts are read twice and never shuffled. The first reading writes each row's length and
prefix hash, a dozen bytes. Lengths that occur once are ruled out there, and among the rest
prefixes that occur once. The second reading hashes whole texts only where length and prefix
are shared. Which those are is told by a bitmap of hashed keys, 64 bits a word and at most
``WORDS`` words, so what is broadcast has a fixed bound however many groups survive. A key
that shares a bit with another one only has its text hashed in vain, for groups are made from the
whole hash; with very many survivors the work tends to one hash of each text and one shuffle
of hashes. Groups are counted with partial sums, so a group of any size meets no single task, and the rows of
a large group find their counts in a join that the adaptive skew join may split.

Defined results: a null text counts as empty, and empty texts are equal to each other; A-Z alone are
lower-cased, so É and é differ; of equal texts the row with the largest id stays, null
ids come last, and of rows with the same id one stays, any; every row is returned,
repeated ones too; an empty table gives an empty table; columns other than the id and the text
are read only where ``carry`` names them, under names that cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.durable import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 256  # characters of the prefix
WORDS = 1 << 20  # words of a bitmap


def ascii_lower(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _word(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(WORDS))


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))


def bitmap(keys: DataFrame) -> DataFrame:
    """(word, bits): the hashed keys (key long) as bits of at most ``WORDS`` words."""
    return keys.groupBy(_word(F.col("key")).alias("word")).agg(F.bit_or(_bit(F.col("key"))).alias("bits"))


def marked(rows: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag: false where the key has no bit in the bitmap."""
    held = rows.withColumn("_key", key).withColumn("word", _word(F.col("_key"))).join(F.broadcast(bits), "word", "left")
    return held.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(_bit(F.col("_key"))) != 0, F.lit(False))).drop("_key", "word", "bits")


def shared_keys(rows: DataFrame, *by: str) -> DataFrame:
    """(key): a hash of each combination that occurs more than once."""
    return rows.groupBy(*by).agg(F.count("*").alias("c")).filter("c > 1").select(F.xxhash64(*by).alias("key"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept and what ``carry`` works out from each row): every row with its group of equal texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = F.octet_length(text).alias("n")
    prefix = F.xxhash64(ascii_lower(F.left(text, F.lit(PREFIX)))).alias("p")
    heads = written(docs.select(n, prefix), "heads")
    by_length = marked(heads, F.xxhash64("n"), bitmap(shared_keys(heads, "n")), "open").filter("open")
    open_keys = bitmap(shared_keys(by_length, "n", "p"))
    carried = {f"c{k}": c for k, c in enumerate((carry or {}).values())}
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), n, prefix, *[c.alias(k) for k, c in carried.items()])
    rows = marked(rows, F.xxhash64("n", "p"), open_keys, "open").select("id", F.when(F.col("open"), F.sha2(ascii_lower(F.col("t")), 256)).alias("full"), *carried)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "hashed")
    found = written(rows.filter("full IS NOT NULL").groupBy("full").agg(F.max(F.struct("id", "row")).alias("keep"), F.count("*").alias("size")), "groups")  # a table on either side: the join of a large group can be split
    many = rows.filter("full IS NOT NULL").join(found, "full").select("id", F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), *carried)
    alone = rows.filter("full IS NULL").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carried)
    out = many.union(alone)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", *[F.col(k).alias(name) for k, name in zip(carried, carry or {}, strict=True)])


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs, carry={"text_sha256": F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)})


OP12_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
