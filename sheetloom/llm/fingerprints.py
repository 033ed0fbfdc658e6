"""Document fingerprints: one-permutation MinHash over five-word shingles, in SQL functions alone.

Every shingle is hashed once. The top eight bits of the hash choose one of 256 bins, the smallest hash of a bin stands for it, and
an empty bin borrows from a filled one by optimal densification: it tries up to eight bins drawn independently for that bin, then takes the
filled bin that is first in the empty bin's own random order. Of each bin the low eight bits are stored, eight bins to a long.

Likeness is the share of equal bins, corrected for chance (two different minima agree in eight bits once in 256 times).

Defined results: a missing text counts as empty; a text without words has the empty fingerprint, likeness 1 to another such text
and 0 to all others; a text of fewer than five words is one shingle; words are compared in lower case.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.llm.common import keep, mix, query, table, whole_text, word_hashes

BINS, BITS, WORDS, PROBES = 256, 8, 5, 8
LANES = 64 // BITS
EMPTY = 512  # stands for an empty bin, above all low bits
ROOM = 1024


def _probes() -> Column:
    """For every bin the bins that it tries when empty, as one literal made by a rule."""
    drawn = mix(np.arange(BINS * PROBES, dtype=np.uint64) + np.uint64(1)) >> np.uint64(64 - 8)
    return F.from_json(F.lit(json.dumps(drawn.reshape(BINS, PROBES).tolist())), "array<array<int>>")


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print) for every distinct key: BINS / 8 packed longs, or no long for a text without words.

    Shingles become rows that are aggregated to a minimum per bin at once; where ``df`` is partitioned by the key nothing is shuffled. Each text
    adds one row per bin that loses against any shingle, so that all bins are there afterwards.
    """
    count = F.when(F.size("_w") >= WORDS, F.size("_w") - WORDS + 1).otherwise(F.least(F.size("_w"), F.lit(1)))
    rows = df.select(key, word_hashes(F.lower(text), lower=False).alias("_w")).select(key, "_w", count.alias("_n"))
    rows = rows.select(key, "_w", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") + (BINS - 1))).alias("_i"))
    whole = F.xxhash64(*[F.get("_w", F.col("_i") + j) for j in range(WORDS)])  # words beyond the end of a short text are missing and add nothing
    hashed = rows.select(key, F.when(F.col("_i") < F.col("_n"), whole).alias("_h"), (F.col("_i") - F.col("_n")).alias("_b"))
    of_bin = F.when(F.col("_h").isNull(), F.col("_b").cast("long")).otherwise(F.shiftrightunsigned("_h", 56))
    minima = hashed.select(key, of_bin.alias("_b"), "_h").groupBy(key, "_b").agg(F.min("_h").alias("_h"))
    low = F.coalesce(F.col("_h").bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(EMPTY))
    dense = minima.groupBy(key).agg(F.sort_array(F.collect_list(F.col("_b") * ROOM + low)).alias("_d"))
    dense = dense.select(key, F.transform("_d", lambda v: v % ROOM).alias("_d"))
    dense = dense.withColumn("_filled", F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get("_d", b) < EMPTY))

    def borrowed(b: Column) -> Column:
        nearest = F.array_min(F.transform("_filled", lambda p: F.struct(F.xxhash64(b, p).alias("h"), p.alias("p"))))["p"]
        of = lambda j: F.get("_d", F.get(F.get(_probes(), b), F.lit(j)))
        return reduce(lambda rest, j: F.when(of(j) < EMPTY, of(j)).otherwise(rest), reversed(range(PROBES)), F.get("_d", nearest))

    signed = dense.select(key, "_filled", F.transform("_d", lambda v, b: F.when(v < EMPTY, v).otherwise(borrowed(b))).alias("_s"))
    lane = lambda w: reduce(lambda a, x: a.bitwiseOR(x), [F.shiftleft(F.get("_s", w * LANES + j), BITS * j) for j in range(LANES)])
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lane)
    return signed.select(key, F.when(F.size("_filled") > 0, packed).otherwise(F.array().cast("array<bigint>")).alias("print"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        t = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            t = t.bitwiseOR(F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(mask)))
        return F.bit_count(t.bitwiseAND(F.lit(0x0101010101010101)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def hexadecimal(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key): the next larger key of every distinct key, the smallest after the largest. Only keys move, in ranges."""
    placed = ids.where(F.col(key).isNotNull()).select(key).distinct()
    placed = keep(placed.repartitionByRange(key).select(key, F.spark_partition_id().alias("_range")), "ranges")
    inside = placed.select(key, "_range", F.lead(key).over(Window.partitionBy("_range").orderBy(key)).alias("_next"))
    # One row per range: the table is as small as the number of partitions.
    heads = placed.groupBy("_range").agg(F.min(key).alias("_head"))
    every = Window.orderBy("_head")
    after = heads.select("_range", F.coalesce(F.lead("_head").over(every), F.first("_head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return inside.join(after, "_range").select(key, F.coalesce("_next", "_after").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, print, edited_print, next_print): fingerprints of every text and of its edited text, whose last
    quarter is taken from the start of the next document.

    One row per doc_id. Rows without a doc_id have no place in the order and no row here; of rows with one doc_id the smallest text
    (missing ones as empty) stands. The last document is followed by the first, a lone document by itself.
    """
    base = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(whole_text()).alias("text"))
    order = keep(successors(docs, "doc_id"), "successors")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    main = base.join(order, "doc_id")
    asked = main.select(F.col("next_key").alias("doc_id"), F.col("doc_id").alias("_for"), quarter.alias("_m"))
    given = base.join(asked, "doc_id").select(F.col("_for").alias("doc_id"), F.substring("text", F.lit(1), F.col("_m")).alias("_start"))
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - quarter), "_start")
    both = main.join(given, "doc_id").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    changed = fingerprints(both, "doc_id", "edited").withColumnRenamed("print", "edited_print")
    # Every fingerprint is made once and sent to two rows: its own and that of the document before.
    before = order.select(F.col("next_key").alias("doc_id"), F.col("doc_id").alias("_before"))
    sent = fingerprints(base, "doc_id", "text").join(before, "doc_id")
    sent = sent.select("print", F.explode(F.array(F.struct(F.col("doc_id").alias("to"), F.lit(True).alias("own")), F.struct(F.col("_before").alias("to"), F.lit(False).alias("own")))).alias("_t"))
    prints = sent.groupBy(F.col("_t.to").alias("doc_id")).agg(F.max(F.when(F.col("_t.own"), F.col("print"))).alias("print"), F.max(F.when(~F.col("_t.own"), F.col("print"))).alias("next_print"))
    out = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    return out.join(prints, "doc_id").join(changed, "doc_id")


@query()
def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    out = edited_fingerprints(table(spark, folder, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexadecimal(F.col("print")).alias("fingerprint"),
        hexadecimal(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
