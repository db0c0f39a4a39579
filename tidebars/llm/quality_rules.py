"""Quality rules: in-document counts and lines that too many documents of a host share.

Everything is built from SQL functions. The cross-document part hashes each
normalised line, counts the distinct documents of each host (``source``) that hold it,
takes lines above the host's limit out of the documents, and rejects documents of which
too little is left. Documents of one host with equal texts are one document; near copies
count each. A host's size is counted in the same unit.

Defined results: a null or empty text has no words and fails the base rules; a null
source is a host of its own; repeated rows are judged alike and are one witness;
ties do not arise (limits are strict); an empty table gives an empty table; columns
other than doc_id, text and source pass through ``filter_documents`` untouched, whatever
their names (a column with the text's length too); blank lines stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.durable import written
from tidebars.llm.text import BLANK_RUN, BLANKS, words

WINDOW = 5


def _row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _line_hash(line: Column) -> Column:
    """60 bits of the normalised line's MD5: lower case, single blanks."""
    plain = F.regexp_replace(F.lower(F.btrim(line, F.lit(BLANKS))), BLANK_RUN, " ")
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array ``w``.

    Most texts repeat no window, which the hash set behind ``array_distinct`` finds out
    in one pass; only the others sort their windows.
    """
    n = F.size(w)
    at = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        m = F.size(h)
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.aggregate(
            F.array(ranked),  # binds the sorted array once for the lambdas below
            F.lit(0),
            lambda _, s: F.aggregate(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.sequence(F.lit(0), m - 1),
                            lambda j: (F.get(s, j)["h"] == F.get(s, j + 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j - 1)["h"]),
                        ),
                        lambda j: F.get(s, j)["i"],
                    )
                ),
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n")),
            )["n"],
        )

    return F.when(n > WINDOW, F.aggregate(F.array(hashes), F.lit(0), lambda _, h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))).otherwise(0)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, keys of the row and of the text, the counts of the base rules, and the lines with their hashes and words."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    read = docs.select(
        "doc_id",
        "source",
        _row_key().alias("row_key"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        words(F.col("text")).alias("w"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("lines"),
        F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
    )
    counted = read.select(
        "doc_id",
        "source",
        "row_key",
        "text_key",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(_line_hash(x).alias("h"), F.regexp_count(x, F.lit("[^\\x20\\x09-\\x0D]+")).alias("n"))).alias("lines"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def common_lines(seen: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(source, h) of lines that more distinct documents of a host hold than the larger of ``min_docs`` and ``max_share`` of them."""
    # equal texts have equal lines, so the first of a group stands for all
    texts = written(seen.groupBy("source", "text_key").agg(F.first(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")), "quality-texts")
    size = texts.groupBy(F.col("source").alias("host")).agg(F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.count("*")).alias("most"))
    counted = texts.select("source", F.explode("h").alias("h")).groupBy("source", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    return counted.join(size, F.col("source").eqNullSafe(F.col("host"))).filter(F.col("docs") > F.col("most")).select("source", "h")


def _verdicts(docs: DataFrame, min_docs: int = 10, max_share: float = 0.01, min_left: float = 0.3) -> DataFrame:
    """As ``judge``, with ``gone_at``: the sorted places of the document's common lines among its lines, null for none."""
    seen = written(features(docs), "quality-features")  # read three times below
    common = written(common_lines(seen, min_docs, max_share).select(F.col("source").alias("c_source"), F.col("h").alias("c_h")), "quality-common")
    lines = seen.select("doc_id", "row_key", "source", F.posexplode("lines").alias("at", "line")).select("doc_id", "row_key", "source", "at", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    # a set, so that repeated rows are not summed up
    taken = (
        lines.join(common, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("h") == F.col("c_h")))
        .groupBy("doc_id", "row_key")
        .agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("gone"))
        .select(
            F.col("doc_id").alias("t_id"),
            F.col("row_key").alias("t_key"),
            F.transform("gone", lambda x: x["at"]).alias("gone_at"),
            F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("gone"),
        )
    )
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    return (
        seen.drop("lines", "text_key")
        .join(taken, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("row_key") == F.col("t_key")), "left")
        .select(
            "doc_id", "source", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            left.alias("words_left"),
            (~F.col("base_failed") & (left >= 10) & (left >= min_left * F.col("n_words"))).alias("kept"),
            "gone_at",
        )
    )


def judge(docs: DataFrame, **limits: float) -> DataFrame:
    """One row for each row of ``docs``: the counts, base_failed, words_left and kept.

    A document that passes the base rules is kept if the words outside common lines
    number 10 or more and at least ``min_left`` of all.
    """
    return _verdicts(docs, **limits).drop("gone_at")


def without_lines(text: Column, gone_at: Column) -> Column:
    """``text`` without the lines at the sorted places ``gone_at``, counted among its lines that are not blank.

    Slices between those places are put together, so the work is linear in the lines.
    """

    def cut(acc: Column, parts: Column) -> Column:
        n = F.size(parts)
        full = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, i).rlike("[^\\x20\\x09-\\x0D]"))
        edges = F.aggregate(  # binds the places of full lines once
            F.array(full), F.array().cast("array<int>"), lambda _, at: F.concat(F.array(F.lit(-1)), F.transform(gone_at, lambda g: F.get(at, g)), F.array(n))
        )
        return F.aggregate(
            F.array(edges),
            acc,
            lambda _, e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: F.slice(parts, F.get(e, k) + 2, F.get(e, k + 1) - F.get(e, k) - 1))),
        )

    return F.array_join(F.aggregate(F.array(F.split(text, "\n")), F.array().cast("array<string>"), cut), "\n")


def filter_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, each as often as it was there, their texts without the common lines."""
    # written before it is filtered, else the filter is pushed down and the counts are worked out again in it
    verdicts = written(_verdicts(docs, **limits).select("doc_id", "row_key", "kept", "gone_at"), "quality-verdicts")
    good = verdicts.filter("kept").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "gone_at").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), _row_key().alias("own_key"))
    cleaned = F.when(F.col("gone_at").isNotNull(), without_lines(F.col("row.text"), F.col("gone_at"))).otherwise(F.col("row.text"))
    out = rows.join(good, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    return out.select(*[cleaned.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(5) r(k) GROUP BY doc_id
), lh AS (
  SELECT doc_id, source, text, ('0x' || substr(md5(regexp_replace(lower(trim(l, E' \t\n\x0b\x0c\r')), '[\x20\x09-\x0D]+', ' ', 'g')), 1, 15))::BIGINT AS h,
         len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, source, text, unnest(lines) AS l FROM d)
), hosts AS (
  SELECT source, count(DISTINCT text) AS c FROM d GROUP BY source
), common AS (
  SELECT f.source, h FROM (SELECT source, h, count(DISTINCT text) AS c FROM lh GROUP BY source, h) f
  JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source WHERE f.c > greatest(10.0, 0.01 * hosts.c)
), gone AS (
  SELECT doc_id, sum(n) AS gone FROM lh JOIN common c ON lh.source IS NOT DISTINCT FROM c.source AND lh.h = c.h GROUP BY doc_id
), r AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (len(w) - coalesce(gone, 0))::BIGINT AS words_left
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND words_left >= 0.3 * n_words AS kept
FROM r
"""
