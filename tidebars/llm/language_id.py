"""Language identification by interpolated Kneser-Ney character models.

Spark counts the 4-grams of all training texts, a language at a time: each task adds up
its own counts, a shuffle adds those. Continuation counts of the lower orders, discounts,
context totals and back-off weights are worked out from all of them, as tables; nothing
is left out, so the model grows with the training texts. For each order there is a table of
grams with their interpolated probability in every language, and one of contexts with their
back-off weights.

Where these tables are small (at most ``MODEL_CELLS`` grams times languages, which is
checked), each Python worker holds them as sorted hash arrays: a gram's key holds four
UTF-16 units, keys are hashed by an odd multiplier. Larger models stay tables: the texts'
grams are looked up in them by joins. Both ways give the same cross-entropies.

A text's language is the one with the lowest cross-entropy a character. The score is the
calibrated probability that it is right, by a logistic fit on a bounded, hash-chosen part
of the training texts that the model is not built from; a text is ``rejected`` if that falls
under ``min_score`` or the cross-entropy exceeds what nearly all rightly named texts have.

Defined results: a text that is null or has no letter is ``und`` with score 0; an empty
table gives an empty table; without training rows everything is ``und``; repeated rows
get equal results and count as often as they are there; texts are read whole; ties go to
the language first in order; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.calibration import platt
from tidebars.llm.durable import written

ORDER = 4
MODEL_CELLS = 8_000_000  # grams times languages that are sent to the workers at most
CALIBRATION_ROWS = 2_000  # training rows that the scores are calibrated on, about, and a tenth of all at most
CALIBRATION_LEAST = 20  # rows that a language must have to give some for that
SLICE = 2_000_000  # characters that are worked on at once
MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKET_BITS = 20


@lru_cache(1)
def _folded() -> np.ndarray:
    """UTF-16 unit -> its lower-case letter, 0 for all that is no letter."""
    table = np.zeros(65536, dtype=np.uint16)
    for c in range(65536):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    return table


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array of units, words apart by one 0, and where each text begins (the end included).

    A text starts with three zeros, which no gram predicts.
    """
    codes = [np.frombuffer((x or "").encode("utf-32-le", "replace"), dtype="<u4") for x in texts]
    sizes = np.array([len(c) + ORDER - 1 + 1 for c in codes], dtype=np.int64)
    out = np.zeros(sizes.sum(), dtype=np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    for c, b in zip(codes, begins, strict=False):
        out[b + ORDER - 1 : b + ORDER - 1 + len(c)] = c
    wide = out > 0xFFFF
    if wide.any():  # beyond the units: letters get a private place, others none
        values = np.unique(out[wide])
        to = np.array([0xE000 + v % 0x1900 if unicodedata.category(chr(v))[0] == "L" else 0 for v in values], dtype=np.uint32)
        folded = _folded()[np.minimum(out, 0xFFFF)]
        folded[wide] = to[np.searchsorted(values, out[wide])]
    else:
        folded = _folded()[out]
    first = np.zeros(len(folded), dtype=bool)
    for k in range(ORDER - 1):
        first[begins[:-1] + k] = True
    keep = (folded != 0) | first
    keep[1:] |= (folded[:-1] != 0) & ~first[:-1]  # the first blank after a letter
    at = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], at[begins]


def keys_of(units: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram keys of the texts one after another, and where each text's begin (the end included)."""
    u = units.astype(np.uint64)
    if len(u) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    key = (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]
    good = np.ones(len(key), dtype=bool)
    for k in range(ORDER - 1):  # grams that reach into the next text
        edge = begins[1:-1] - 1 - k
        good[edge[(edge >= 0) & (edge < len(good))]] = False
    at = np.concatenate([[0], np.cumsum(good)])
    return key[good], at[np.minimum(begins, len(key))]


def _slices(sizes: list[int], most: int = SLICE) -> Iterator[slice]:
    at = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def count_grams(rows: DataFrame, flush: int = 1_500_000) -> DataFrame:
    """(lang, key, n): how often each 4-gram is in the texts of each language, over all rows of (lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def flushed() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                key, n = _merged(parts)
                yield pd.DataFrame({"lang": lang, "key": key.view(np.int64), "n": n})
            held.clear()

        size = 0
        for pdf in batches:
            for lang, own in pdf.groupby("lang", sort=True):
                texts = own["text"].tolist()
                for s in _slices([len(x) for x in texts]):
                    key = np.sort(keys_of(*letters(texts[s]))[0])
                    if not len(key):
                        continue
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    held.setdefault(lang, []).append((key[first], np.diff(np.concatenate([first, [len(key)]]))))
                    if len(held[lang]) >= 8:
                        held[lang] = [_merged(held[lang])]
                size = sum(len(k) for x in held.values() for k, _ in x)
                if size > flush:
                    yield from flushed()
        yield from flushed()

    part = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(run, "lang string, key long, n long")
    return part.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _per_language(df: DataFrame, key: str, value: str, langs: list[str], none: float) -> DataFrame:
    """(key, value array): one entry a language, ``none`` where it has no row."""
    packed = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("m"))  # one entry a language
    return packed.select(key, F.transform(F.array(*map(F.lit, langs)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(none))).alias(value))


class Tables(NamedTuple):
    """The model as written tables, order 1 first: (key, p) with the interpolated probabilities, (context, weight); arrays have an entry a language."""

    langs: list[str]
    floor: float
    grams: list[DataFrame]
    contexts: list[DataFrame]


def model_tables(counts: DataFrame) -> Tables | None:
    """The model of (lang, key, n) counts of 4-grams."""
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # how many different grams of the next order end in each
        short = F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1))
        levels.append(written(levels[-1].groupBy("lang", short.alias("key")).agg(F.count("*").alias("n")), "lang-level"))
    levels.reverse()
    langs = sorted(r["lang"] for r in levels[0].select("lang").distinct().collect())  # one row a language
    if not langs:
        return None
    floor = 1.0 / (levels[0].select("key").distinct().count() + 1)
    grams, contexts = [], []
    for k, level in enumerate(levels, 1):
        ones, twos = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        discount = level.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        level = level.withColumn("context", F.shiftrightunsigned("key", 16))
        totals = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discount, "lang")
        totals = written(totals.withColumn("weight", F.col("d") * F.col("types") / F.col("total")), "lang-contexts")
        weights = written(_per_language(totals, "context", "weight", langs, 1.0), "lang-weights")
        own = level.join(totals, ["lang", "context"]).withColumn("prob", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"))
        own = _per_language(own, "key", "prob", langs, 0.0).withColumn("context", F.shiftrightunsigned("key", 16)).join(weights, "context")
        if k == 1:
            lower = F.transform("weight", lambda w: w * floor)
        else:
            below = grams[-1].select(F.col("key").alias("short"), F.col("p").alias("p_below"))
            own = own.join(below, F.col("key").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)) == F.col("short"))
            lower = F.zip_with("weight", "p_below", lambda w, p: w * p)
        grams.append(written(own.select("key", F.zip_with("prob", lower, lambda a, b: a + b).alias("p")), "lang-grams"))
        contexts.append(weights)
    return Tables(langs, floor, grams, contexts)


class Order(NamedTuple):
    """One order: sorted hashed grams with their probabilities, sorted hashed contexts with their back-off weights, a column a language."""

    grams: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _find(table: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether each is a hit."""
    if not len(table):
        return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
    at = np.minimum(np.searchsorted(table, hashed), len(table) - 1)
    return at, table[at] == hashed


def _sorted(rows: pd.DataFrame, key: str, value: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    hashed = rows[key].to_numpy(dtype=np.int64).view(np.uint64) * MIX
    values = np.stack(rows[value].to_list()).astype(float) if len(rows) else np.zeros((0, width))
    by = np.argsort(hashed)
    return hashed[by], values[by]


class Model(NamedTuple):
    """What the workers hold of all languages: the orders from 1 to 4, and the logarithms of the last."""

    langs: list[str]
    orders: list[Order]
    floor: float
    logs: np.ndarray  # one row a 4-gram, one column a language
    buckets: np.ndarray

    def resolve(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of the last unit after the three before it, in each language."""
        p = np.full((len(keys), len(self.langs)), self.floor)
        for k, o in enumerate(self.orders, 1):
            gram = keys if k == ORDER else keys & np.uint64((1 << 16 * k) - 1)
            # a shorter gram is told from a longer one that starts with zeros by its own table
            at, hit = _find(o.grams, gram * MIX)
            c, known = _find(o.contexts, (gram >> np.uint64(16)) * MIX)
            back = np.where(known[:, None], o.weight[c], 1.0)
            p = np.where(hit[:, None], o.p[at], back * p)
        return np.log(p).astype(np.float32)

    def logs_of(self, keys: np.ndarray) -> np.ndarray:
        """As ``resolve``, from the table of 4-grams; only grams that no language has are worked out."""
        hashes = self.orders[-1].grams
        hashed = keys * MIX
        at = self.buckets[hashed >> np.uint64(64 - BUCKET_BITS)].astype(np.int64)
        last = len(hashes) - 1
        open_ = np.flatnonzero(hashes[np.minimum(at, last)] < hashed)
        while len(open_):  # a bucket holds few
            at[open_] += 1
            open_ = open_[(at[open_] <= last)]
            open_ = open_[hashes[at[open_]] < hashed[open_]]
        at = np.minimum(at, last)
        out = self.logs[at]
        missed = np.flatnonzero(hashes[at] != hashed)
        if len(missed):
            own, back = np.unique(keys[missed], return_inverse=True)
            out[missed] = self.resolve(own)[back]
        return out


def load(tables: Tables) -> Model:
    """The tables as sorted hash arrays."""
    orders = []
    for grams, contexts in zip(tables.grams, tables.contexts, strict=True):
        parts = _sorted(grams.toArrow().to_pandas(), "key", "p", len(tables.langs)), _sorted(contexts.toArrow().to_pandas(), "context", "weight", len(tables.langs))
        orders.append(Order(*parts[0], *parts[1]))
    edges = np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    return Model(tables.langs, orders, tables.floor, np.log(orders[-1].p).astype(np.float32), np.searchsorted(orders[-1].grams, edges).astype(np.int32))


class Trained(NamedTuple):
    """The tables, their arrays where they are small, and the calibration."""

    tables: Tables
    arrays: Model | None
    platt: tuple[float, float] = (1.0, 0.0)
    max_entropy: float = math.inf


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) cross-entropies in nats a character, and the characters scored; no letters: NaN and 0."""
    units, begins = letters(texts)
    keys, at = keys_of(units, begins)
    sizes = np.diff(at)
    out = np.full((len(texts), len(model.langs)), np.nan)
    with_letters = np.add.reduceat(np.concatenate([units != 0, [False]]).astype(np.int64), begins[:-1]) > 0
    scored = np.flatnonzero((sizes > 0) & with_letters)
    if len(scored):
        logs = model.logs_of(keys)
        sums = np.add.reduceat(logs, at[:-1][sizes > 0], axis=0, dtype=np.float64)
        out[sizes > 0] = -sums / sizes[sizes > 0, None]
        out[~with_letters] = np.nan
    return out, np.where(with_letters, sizes, 0)


def train(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS, model_cells: int = MODEL_CELLS) -> Trained | None:
    """The model of all rows of (doc_id, lang, text) that have a language and a text, but for those that it is calibrated on."""
    usable = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("rows")).collect()  # one row a language
    every = max(10, sum(r["rows"] for r in sizes) // calibration_rows)
    # equal texts fall on the same side
    out = (F.pmod(F.xxhash64(F.lit("calibration"), "text"), F.lit(every)) == 0) & F.col("lang").isin([r["lang"] for r in sizes if r["rows"] >= CALIBRATION_LEAST])
    tables = model_tables(written(count_grams(usable.filter(~out)), "lang-counts"))
    if tables is None:
        return None
    cells = len(tables.langs) * sum(t.count() for t in [*tables.grams, *tables.contexts])
    model = Trained(tables, load(tables) if cells <= model_cells else None)
    fit = entropies(usable.filter(out), model, ("lang",)).filter("characters > 0").select("lang", "best", "margin", "entropy", "characters").toPandas()
    return calibrated(model, fit)


def calibrated(model: Trained, fit: pd.DataFrame) -> Trained:
    """With the logistic fit of being right on margin times root of length, and the entropy that 99.5% of the right ones keep under."""
    if len(fit) < 20:
        return model
    x = fit["margin"].to_numpy() * np.sqrt(fit["characters"].to_numpy())
    y = (fit["best"] == fit["lang"]).to_numpy().astype(float)
    right = fit["entropy"][y == 1]
    return model._replace(platt=platt(x, y), max_entropy=float(right.quantile(0.995)) if len(right) else math.inf)


def entropies(docs: DataFrame, model: Trained, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """For every row of ``docs`` the best language, its cross-entropy, its lead over the second, and the characters scored."""
    return _by_arrays(docs, model.arrays, keep) if model.arrays is not None else _by_joins(docs, model.tables, keep)


def _by_arrays(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MODEL_CELLS numbers at most
    types = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in _slices([len(x or "") for x in texts]):
                h, n = score_texts(m, texts[s])
                filled = np.where(np.isnan(h), np.inf, h)
                best = filled.argmin(1)
                low = filled[np.arange(len(best)), best]
                second = np.partition(filled, 1, axis=1)[:, 1] if h.shape[1] > 1 else np.full(len(best), np.inf)
                margin = np.where(n > 0, np.where(np.isfinite(second), second - low, 1.0), 0.0) if len(best) else low
                yield pdf[list(keep)].iloc[s].assign(
                    best=[m.langs[i] if k > 0 else "und" for i, k in zip(best, n, strict=True)], entropy=np.where(n > 0, low, 0.0), margin=np.nan_to_num(margin), characters=n
                )

    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", best string, entropy double, margin double, characters long"
    return docs.select(*keep, "text").mapInPandas(run, schema)


def _by_joins(docs: DataFrame, tables: Tables, keep: tuple[str, ...]) -> DataFrame:
    """Each different 4-gram of the texts is resolved once, in joins with the tables; the rows add up what theirs have."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in _slices([len(x or "") for x in texts]):
                units, begins = letters(texts[s])
                keys, at = keys_of(units, begins)
                grams, size = [], []
                for a, b, own in zip(at, at[1:], (units[x:y].any() for x, y in zip(begins, begins[1:], strict=False)), strict=False):
                    key, n = np.unique(keys[a:b], return_counts=True)
                    size.append(b - a if own else 0)
                    grams.append([{"key": k, "n": c} for k, c in zip(key.view(np.int64).tolist(), n.tolist(), strict=True)] if own else [])
                yield pdf[[*keep, "rid"]].iloc[s].assign(grams=grams, characters=size)

    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", rid long, grams array<struct<key:long,n:long>>, characters long"
    rows = written(docs.select(*keep, "text", F.monotonically_increasing_id().alias("rid")).mapInPandas(run, schema), "lang-rows")
    own = rows.select("rid", F.inline("grams"))
    p = F.array(*[F.lit(tables.floor)] * len(tables.langs))
    found = own.select("key").distinct()
    for k, (grams, contexts) in enumerate(zip(tables.grams, tables.contexts, strict=True), 1):
        gram = F.col("key") if k == ORDER else F.col("key").bitwiseAND(F.lit((1 << 16 * k) - 1))
        found = found.withColumn("gram", gram).join(grams.select(F.col("key").alias("gram"), F.col("p").alias("known")), "gram", "left")
        found = found.withColumn("context", F.shiftrightunsigned("gram", 16)).join(contexts, "context", "left")
        back = F.when(F.col("weight").isNull(), p).otherwise(F.zip_with("weight", p, lambda w, x: w * x))
        found = found.select("key", F.coalesce("known", back).alias("p"))
        p = F.col("p")
    found = written(found.select(F.col("key").alias("k"), F.transform("p", lambda x: F.ln(x)).alias("logs")), "lang-resolved")
    sums = [F.sum(F.col("n") * F.get("logs", F.lit(i))).alias(f"s{i}") for i in range(len(tables.langs))]
    per = own.join(found, F.col("key") == F.col("k")).groupBy(F.col("rid").alias("r")).agg(*sums)
    per = per.select("r", F.array(*[F.struct((-F.col(f"s{i}")).alias("h"), F.lit(i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(tables.langs)]).alias("h"))
    per = per.select("r", F.array_sort("h").alias("h"))
    first, second = F.get("h", F.lit(0)), F.get("h", F.lit(1))
    n = F.col("characters")
    return rows.join(per, F.col("rid") == F.col("r"), "left").select(
        *keep, F.coalesce(first["lang"], F.lit("und")).alias("best"), F.coalesce(first["h"] / n, F.lit(0.0)).alias("entropy"),
        F.when(n > 0, F.coalesce((second["h"] - first["h"]) / n, F.lit(1.0))).otherwise(0.0).alias("margin"), "characters",
    )


def identify(docs: DataFrame, model: Trained | None, keep: tuple[str, ...] = ("doc_id",), min_score: float = 0.5) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1), cross_entropy and rejected for every row."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    a, b = model.platt
    logit = F.lit(a) * F.col("margin") * F.sqrt("characters") + F.lit(b)
    score = F.when(F.col("characters") > 0, 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))).otherwise(0.0)
    return entropies(docs, model, keep).select(
        *keep,
        F.col("best").alias("lang_pred"),
        score.alias("score"),
        F.col("entropy").alias("cross_entropy"),
        ((score < min_score) | (F.col("entropy") > F.lit(model.max_entropy))).alias("rejected"),
    )


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs, model, ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
