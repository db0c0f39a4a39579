"""License scans: MinHash bands over overlapping windows find templates, containment proves them.

Templates fall into length classes, the powers of two of words. For a class of up to w
words a document is cut into windows of 3w/2 words that start every w/2 words, so any w
words in a row lie whole in some window. Shingle hashes are dealt to the class's bins by
their low bits; the least one of a bin is the band of one row that the bin gives (one
permutation hashing). Window and template meet if they agree on a band. A class has so many
bins that a window which holds the threshold of one of its templates misses it with a
probability under ``miss``. A match needs the containment of the template's 5-word shingles
in the window to reach 0.8.

The templates' bands are a table. A window can agree on one only where it holds that very
shingle, so the documents' shingles are joined to that table first, and the bands of the
windows around the hits are worked out then. Templates are a table as well, of any number
and length. Everything is built from SQL functions.

Defined results: a null or empty text, and one with fewer than five words, has no
shingles and no match; repeated rows are one document (their matches are equal), and so
are rows of one id whose texts differ, which keep the best of each; very long texts are cut
whole; a template counts once a document, with its first place and best containment; a
template under five words is refused; an empty table gives an empty table; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.durable import written
from tidebars.llm.text import words

SHINGLE = 5
PERCENT = 80
MISS = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
# Notices and texts to look for.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-grant", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-text", _BSD_2 + _AS_IS),
    (
        "BSD-3-text",
        _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)


def _size_class(text: str) -> int:
    return max(8, 1 << (len(text.split()) - 1).bit_length())


def bins_of(window: int, least: int, miss: float = MISS) -> int:
    """Bins so many that a window with enough of a template of ``least`` or more shingles agrees on none with at most ``miss``.

    A shared shingle is the least of its bin among the u shingles that window and template have
    together with a probability of (B / u) (1 - exp(-u / B)).
    """
    need = -(-PERCENT * least // 100)
    u = window - SHINGLE + 1 + least - need
    b = 2
    while (1 + b / u * math.expm1(-u / b)) ** need > miss:
        b *= 2
    return b


def shingles(text: Column) -> Column:
    """The text's 5-word shingles' hashes in order, A-Z in lower case."""
    w = words(F.translate(text, UPPER, LOWER))
    made = F.aggregate(
        F.array(w),
        F.array().cast("array<bigint>"),
        lambda _, x: F.when(F.size(x) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(x) - SHINGLE), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(SHINGLE)]))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    return F.coalesce(made, F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, text) of a list."""
    return spark.createDataFrame(list(templates), "template string, text string")


def _with_shingles(templates: DataFrame) -> DataFrame:
    """(template, class, t): the templates' length classes and distinct shingles."""
    n = F.size(words(F.col("text")))
    size = F.greatest(F.lit(8.0), F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double"))))).cast("int")
    table = templates.select("template", size.alias("class"), F.array_distinct(shingles(F.col("text"))).alias("t"))
    return table.withColumn("t", F.when(F.size("t") > 0, F.col("t")).otherwise(F.raise_error(F.concat("template", F.lit(f" has fewer than {SHINGLE} words")))))


def template_bands(table: DataFrame, miss: float) -> DataFrame:
    """(template, class, bins, key): the least shingle of each bin of each template."""
    least = {r["class"]: r["least"] for r in table.groupBy("class").agg(F.min(F.size("t")).alias("least")).collect()}  # one row a power of two
    bins = F.create_map(*[F.lit(x) for c, n in least.items() for x in (c, bins_of(c * 3 // 2, n, miss))]) if least else F.create_map().cast("map<int,int>")
    rows = table.select("template", "class", bins[F.col("class")].cast("long").alias("bins"), F.explode("t").alias("h"))
    return rows.groupBy("template", "class", "bins", F.pmod("h", "bins").alias("bin")).agg(F.min("h").alias("key")).drop("bin")


def find_licenses(docs: DataFrame, templates: DataFrame | None = None, miss: float = MISS) -> DataFrame:
    """(doc_id, template, containment, first_word, places) for every template that a document holds; ``templates``: (template, text)."""
    table = written(_with_shingles(template_table(docs.sparkSession) if templates is None else templates), "license-templates")
    bands = written(template_bands(table, miss), "license-bands")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    own = rows.select("doc_id", "row_key", F.posexplode(shingles(F.col("text"))).alias("at", "h"))
    hits = written(own.join(bands, F.col("h") == F.col("key")).select("doc_id", "row_key", "at", "template", "class", "bins", "key"), "license-hits")
    # the windows that hold a hit, each with the keys it holds
    step, size = (F.col("class") / 2).cast("int"), (F.col("class") * 3 / 2).cast("int") - SHINGLE + 1
    begin = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - size) / step) + 1).cast("int"), F.floor(F.col("at") / step).cast("int")))
    met = hits.withColumn("begin", begin).groupBy("doc_id", "row_key", "template", "class", "bins", "begin").agg(F.collect_set("key").alias("keys"))  # one a bin at most
    held = hits.select(F.col("doc_id").alias("h_id"), F.col("row_key").alias("h_key")).distinct()
    texts = rows.join(held, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row_key") == F.col("h_key")), "left_semi").dropDuplicates(["doc_id", "row_key"])
    texts = texts.select(F.col("doc_id").alias("t_id"), F.col("row_key").alias("t_key"), shingles(F.col("text")).alias("sh"))
    met = met.join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("row_key") == F.col("t_key")))
    met = met.select("doc_id", "template", "bins", "keys", (F.col("begin") * step).alias("at"), F.slice("sh", F.col("begin") * step + 1, size).alias("w"))
    agree = F.exists("keys", lambda k: F.array_min(F.filter("w", lambda x: F.pmod(x, F.col("bins")) == F.pmod(k, F.col("bins")))) == k)
    found = met.filter(agree).join(table.select(F.col("template").alias("name"), "t"), F.col("template") == F.col("name"))
    shared = F.array_intersect("t", "w")
    out = found.withColumn("share", F.size(shared) / F.size("t")).filter(100 * F.size(shared) >= PERCENT * F.size("t"))
    place = F.col("at") + F.array_min(F.transform(shared, lambda x: F.array_position("w", x))) - 1
    return out.select("doc_id", "template", "share", place.cast("long").alias("place")).groupBy("doc_id", "template").agg(
        F.max("share").alias("containment"), F.min("place").alias("first_word"), F.countDistinct("place").alias("places")
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "template", "containment", "first_word")


def _sql() -> str:
    quoted = {n: t.replace("'", "''") for n, t in TEMPLATES}
    rows = ", ".join(f"('{n}', {_size_class(t)}, '{t}')" for n, t in quoted.items())
    split = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{U}', '{L}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')".replace("{U}", UPPER).replace("{L}", LOWER)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, class, text)
), tw AS (SELECT template, class, {split} AS w FROM t
), ts AS (SELECT DISTINCT template, class, w[i:i+4] AS s FROM (SELECT template, class, w, unnest(range(1, len(w) - 3)) AS i FROM tw)
), tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template
), d AS (SELECT doc_id, {split} AS w FROM documents
), ds AS (SELECT doc_id, i - 1 AS p, w[i:i+4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), hits AS (SELECT doc_id, template, class, p, s FROM ds JOIN ts USING (s)
), k AS (SELECT *, unnest(range(0, 3)) AS back FROM hits
), win AS (
  SELECT doc_id, template, p, s, (p // (class // 2) - back) * (class // 2) AS beginning FROM k
  WHERE p // (class // 2) - back >= 0 AND p < (p // (class // 2) - back) * (class // 2) + class * 3 // 2 - 4
), m AS (
  SELECT doc_id, template, beginning, count(DISTINCT s) / any_value(n) AS share, min(p) AS place
  FROM win JOIN tn USING (template) GROUP BY doc_id, template, beginning HAVING 100 * count(DISTINCT s) >= 80 * any_value(n)
)
SELECT doc_id, template, max(share)::DOUBLE AS containment, min(place)::BIGINT AS first_word FROM m GROUP BY doc_id, template
"""


OP4_SQL = _sql()
