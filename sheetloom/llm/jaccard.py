"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles. Documents with equal sets form a class, and classes are joined:

1. Shingles are ordered from rare to frequent. The frequencies come from a sketch of fixed size over all documents; it decides the
   order alone, so its error costs time and never a link.
2. Two sets that overlap in at least t shingles share the first l of their common shingles within the first n - t + l of each, for every l.
   Each class takes the l that its own prefix makes cheapest: a prefix of frequent shingles is lengthened by l - 1, and a partner then
   has to share l of it before the pair is verified. A pair is held to the smaller l of its two classes.
3. All prefix entries are shuffled once, as lists by parts of the shingles. Those stay whose shingle a class of a size near enough holds in its prefix too.
4. First every class is compared with a few others for each prefix shingle: the holders with the most shared shingles and the first in four random orders.
   The links found so, verified on the whole sets, join groups of near copies without listing their pairs. Pairs are then needed only between different
   components, so a shingle whose holders all lie in one component drops out before any pairs are made, and so does a class that holds fewer
   others than the least that any of their holders asks for.
5. Pairs come from the first prefix shingle that both hold, if what each has left allows the overlap. They are counted by shared prefix shingles, held to l,
   verified on the whole sets, and give the rest of the links that connect components. Texts are moved only for the pairs to be verified.

The join returns the class representatives' components; links between documents of one component that is already connected are not listed.

Defined results: missing and empty texts and texts without words have no shingles and link with nothing; fewer than k words are one shingle;
rows without an id are left out; rows that repeat an id are separate documents of that id, one row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.llm.common import keep, mix, query, release, shingle_sets, signed, table, whole_text
from sheetloom.llm.components import components

BUCKET_BITS = 22
SLICE = 1 << 15
PENDING = 1 << 20
PART_BITS = 10
ID_BITS = 25
HUBS = 8
SIFTED = 64
NEAREST = 8
LEVELS = 8
FILTER_COST, VERIFY_COST = 1.0, 40.0


def _identities(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each set, and a hash of them and its size."""
    sums = []
    with np.errstate(over="ignore"):
        for values in (shingles, mix(shingles ^ np.uint64(0x5851F42D4C957F2D))):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
            sums.append(total[bounds[1:]] - total[bounds[:-1]])
        key = mix(sums[0] * np.uint64(3) + sums[1] + np.diff(bounds).astype(np.uint64))
    return signed(sums[0]), signed(sums[1]), signed(key)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (id, n, first, second, key), and per task the slices of its sketch (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        pending, size = [], 0
        for batch in batches:
            found = []
            for shingles, bounds in shingle_sets(batch.column("text"), k):
                found.append((np.diff(bounds), *_identities(shingles, bounds)))
                pending.append((shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                size += len(shingles)
                if size > 2 * PENDING:
                    counts += np.bincount(np.concatenate(pending), minlength=len(counts))
                    pending, size = [], 0
            columns = [np.concatenate(c) for c in zip(*found)] or [np.empty(0, np.int64)] * 4
            nothing = batch.num_rows
            yield pa.record_batch([batch.column("id"), *map(pa.array, columns), pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary())], names=["id", "n", "first", "second", "key", "slice", "counts"])
        if pending:
            counts += np.bincount(np.concatenate(pending), minlength=len(counts))
        used = [i for i in range(0, len(counts), SLICE) if counts[i : i + SLICE].any()]
        if used:
            empty = pa.nulls(len(used), pa.int64())
            parts = [zlib.compress(counts[i : i + SLICE].astype("<u4").tobytes(), 1) for i in used]
            yield pa.record_batch([empty, empty, empty, empty, empty, pa.array([i // SLICE for i in used], pa.int32()), pa.array(parts, pa.binary())], names=["id", "n", "first", "second", "key", "slice", "counts"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, first long, second long, key long, slice int, counts binary")


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed sketch: 2^22 counters whatever the number of documents. Slices are summed by Spark; one of each comes back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], names=["slice", "sums"])

    total = np.zeros(1 << BUCKET_BITS, np.int64)
    slices = (1 << BUCKET_BITS) // SLICE
    summed = described.where(F.col("slice").isNotNull()).select("slice", "counts").repartition(slices // 8, "slice").mapInArrow(add, "slice int, sums binary")
    for row in summed.collect():
        total[row.slice * SLICE : (row.slice + 1) * SLICE] += np.frombuffer(row.sums, "<i8")
    return total


def _excess(counts: np.ndarray) -> np.ndarray:
    """How often a shingle of a bucket occurs beyond what chance puts there, at least 1.

    Some rare shingles share a bucket with many others and count as frequent; the order stays the same for all documents, so nothing is lost.
    """
    middle = float(np.median(counts))
    return np.clip(counts - middle - 2.0 * np.sqrt(middle + 1.0), 1, 65535).astype(np.uint16)


def _ordered(shingles: np.ndarray, bounds: np.ndarray, excess: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes of sets that are not empty in a row, each in order of rarity; their lengths, and the number l of matches that each asks for."""
    n = np.diff(bounds)
    least = -(-num * n // den)
    often = excess[(shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    longest, base = np.minimum(LEVELS, least), n - least + 1
    lengths = base + longest - 1
    # Sets are sorted, so a stable order by frequency is one by frequency and shingle.
    order = np.concatenate([a + np.argsort(often[a:b], kind="stable")[:m] for a, b, m in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lengths.tolist())])
    begins = np.cumsum(lengths) - lengths
    cost = np.concatenate(([0], np.cumsum(often[order].astype(np.int64) - 1)))
    level = np.arange(1, LEVELS + 1)
    at = (cost[np.minimum((begins + base)[:, None] + level - 1, len(order))] - cost[begins][:, None]).astype(np.float64)
    price = FILTER_COST * (at + base[:, None] + level) + VERIFY_COST * at / level
    chosen = np.argmin(np.where(level <= longest[:, None], price, np.inf), axis=1) + 1
    place = np.arange(len(order)) - np.repeat(begins, lengths)
    return shingles[order[place < np.repeat(base + chosen - 1, lengths)]], base + chosen - 1, chosen


def prefix(shingles: np.ndarray, excess: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set in order of rarity, the level of each of its shingles, and the number l of matches it asks for."""
    n = len(shingles)
    token, _, chosen = _ordered(shingles, np.array([0, n]), excess, num, den)
    return token, np.maximum(1, np.arange(len(token)) - (n + num * -n // den) + 1), int(chosen[0])


def prefixes(docs: DataFrame, k: int, num: int, den: int, excess: np.ndarray) -> DataFrame:
    """(part, token, key, n, spot): the prefix entries of every class, as lists for each part of the shingles. A spot is sixteen times the place and l.

    A task writes a class once, however many copies it meets.
    """
    sent = docs.sparkSession.sparkContext.broadcast(excess)
    bits = min(16, max(PART_BITS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1))

    def lists(entries: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        token, key, n, spot = (np.concatenate(c) for c in zip(*entries))
        part = (token >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        parts, begins = np.unique(part[order], return_index=True)
        offsets = pa.array(np.append(begins, len(order)), pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in (signed(token), key, n, spot)]
        return pa.record_batch([pa.array(parts.astype(np.int32)), *columns], names=["part", "token", "key", "n", "spot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        entries, size = [], 0
        for batch in batches:
            for shingles, bounds in shingle_sets(batch.column("text"), k):
                n, keys = np.diff(bounds), _identities(shingles, bounds)[2]
                new = np.zeros(len(n), bool)
                for i in np.flatnonzero(n).tolist():
                    if (key := int(keys[i])) not in seen:
                        seen.add(key)
                        new[i] = True
                if not new.any():
                    continue
                shingles, n, keys = shingles[np.repeat(new, n)], n[new], keys[new]
                token, lengths, chosen = _ordered(shingles, np.concatenate(([0], np.cumsum(n))), sent.value, num, den)
                place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                entries.append((token, np.repeat(keys, lengths), np.repeat(n, lengths).astype(np.int32), (16 * place + np.repeat(chosen, lengths)).astype(np.int32)))
                size += len(token)
                if size >= PENDING:
                    yield lists(entries)
                    entries, size = [], 0
        if entries:
            yield lists(entries)

    return docs.select("id", "text").mapInArrow(run, "part int, token array<long>, key array<long>, n array<int>, spot array<int>")


def meeting(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(token, key, n, place, matches): the prefix entries, once each, of shingles that a class of a size near enough holds in its prefix as well."""

    def run(table_of: pa.Table) -> pa.Table:
        token, key, n, spot = (table_of.column(c).combine_chunks().flatten().to_numpy() for c in ("token", "key", "n", "spot"))
        order = np.argsort(token)
        again = np.diff(token[order]) == 0
        order = order[np.append(again, False) | np.insert(again, 0, False)] if len(order) else order
        order = order[np.lexsort((key[order], n[order], token[order]))]
        token, key, n, spot = token[order], key[order], n[order], spot[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])
        token, key, n, spot = token[new], key[new], n[new], spot[new]
        # By size, if any holder is near enough in size, the next one is.
        near = np.zeros(len(token) + 1, bool)
        near[1:-1] = (token[1:] == token[:-1]) & (num * n[1:].astype(np.int64) <= den * n[:-1].astype(np.int64))
        held = near[1:] | near[:-1]
        return pa.table({"token": token[held], "key": key[held], "n": n[held], "place": spot[held] >> 4, "matches": spot[held] & 15})

    return entries.groupBy("part").applyInArrow(run, "token long, key long, n int, place int, matches int")


def _each_set(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for shingles, bounds in shingle_sets(column, k):
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield shingles[a:b]


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of some ids and a few others: a bitmap of hashed ids, of fixed size, keeps most other texts from being moved."""
    spot = F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(1 << ID_BITS))
    row, bit = F.shiftright(spot, 15).alias("_row"), (spot % 32768).alias("_bit")
    maps = ids.select(row, bit).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    marked = docs.withColumns({"_row": F.shiftright(spot, 15), "_bit": spot % 32768}).join(F.broadcast(maps), "_row")
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return marked.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(docs.columns)


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of document ids whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_rows = []
            for x, y in zip(_each_set(batch.column("x"), k), _each_set(batch.column("y"), k)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep_rows.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep_rows, pa.bool_()))

    left = docs.select(F.col("id").alias("a"), F.col("text").alias("_x"))
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.col("_x").alias("x"), F.col("_y").alias("y")).mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) for documents (id, text) linked by a Jaccard similarity of num / den or more."""
    docs = docs.where(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).alias("text"))
    described = keep(describe(docs, k), "sets")
    excess = _excess(_sketch(described))
    sets = described.where(F.col("slice").isNull()).select("id", "n", "first", "second", "key")
    classes = keep(sets.where("n > 0").groupBy("key", "first", "second", "n").agg(F.min("id").alias("rep")), "classes")

    shared = keep(meeting(prefixes(docs, k, num, den, excess), num, den), "shared")

    reps = classes.select("key", "rep", F.col("n").alias("size"))
    close = num * F.greatest("size_a", "size_b") <= den * F.least("size_a", "size_b")

    def candidates(pairs: DataFrame, named: Column = F.col("key")) -> DataFrame:
        """Pairs of a key and a key, or what else names the second class, as pairs of representatives whose sizes allow the similarity."""
        out = pairs.join(reps.select(F.col("key").alias("x"), F.col("rep").alias("a"), F.col("size").alias("size_a")), "x")
        out = out.join(reps.select(named.alias("y"), F.col("rep").alias("b"), F.col("size").alias("size_b")), "y")
        return out.where(close & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        texts = keep(_of_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "texts")
        links = keep(verified(pairs, texts, k, num, den), "links")
        release(pairs, texts)
        return links

    # Classes against some holders of a shingle, where a third of the prefix meets there; what this misses, the second pass finds. The holders are those
    # with the most shared shingles, in groups of near copies the least edited ones, and the first in orders by chance: those of the key's first bits with some
    # of them turned over. Of long prefixes some shingles are enough here, and the classes that hold one choose alike.
    sift = F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / SIFTED))).cast("int")
    some = shared.select("token", "key", "n", sift.alias("sift")).where(F.expr("token & (shiftleft(1L, sift) - 1) = 0"))
    central = some.groupBy("key").agg(F.least(F.count("token"), F.lit(32767)).alias("common"))
    name = F.shiftrightunsigned("key", 16)
    turned = [int(x) >> 16 for x in mix(np.arange(1, HUBS + 1, dtype=np.uint64))]
    rank = [F.shiftleft(32767 - F.col("common"), 48) if i < HUBS // 2 else F.lit(0).cast("long") for i in range(HUBS)]
    ranked = some.join(central, "key").groupBy("token").agg(*[F.min(rank[i].bitwiseOR(name.bitwiseXOR(F.lit(x)))).alias(f"_{i}") for i, x in enumerate(turned)])
    holders = ranked.select("token", F.array_distinct(F.array(*[F.col(f"_{i}").bitwiseAND(F.lit((1 << 48) - 1)).bitwiseXOR(F.lit(x)) for i, x in enumerate(turned)])).alias("hubs"))
    hubs = some.join(holders, "token").select("key", "n", "sift", F.explode("hubs").alias("hub")).where(name != F.col("hub"))
    hubs = hubs.groupBy("key", "hub").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n"), F.max("sift").alias("sift"))
    hubs = hubs.where(F.expr(f"shiftleft(met, sift) * {3 * den} >= n * {den - num}")).select(F.col("key").alias("x"), F.col("hub").alias("y"))
    links = linked(keep(candidates(hubs, name), "hubs"))
    first = components(links)

    # A home is the smallest key of a component; a key alone is its own.
    homes = classes.join(first.withColumnRenamed("id", "rep"), "rep").groupBy("key").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("_n"))
    homes = homes.where("_n = 1").select("key", "component")
    homes = homes.join(homes.groupBy("component").agg(F.min("key").alias("home")), "component")
    level = F.greatest(F.lit(1), F.col("place") - F.col("n") + F.ceil(num * F.col("n") / den) + 1)
    placed = shared.join(homes.select("key", "home"), "key", "left").withColumns({"home": F.coalesce("home", "key"), "level": level.cast("int")})
    # A prefix shingle that nobody outside a class's component holds is no part of any overlap that is looked for, and a class asks for at least as many
    # of the others as the least demanding holder of one of them does.
    across = placed.groupBy("token").agg(F.min("home").alias("_low"), F.max("home").alias("_high"), F.min("matches").alias("easy")).where(F.col("_low") != F.col("_high"))
    own = Window.partitionBy("key")
    mixed = placed.join(across.select("token", "easy"), "token").withColumns({"_held": F.count(F.lit(1)).over(own), "_least": F.min("easy").over(own)})
    outside = F.ceil(num * F.col("n") / den) - F.col("matches")  # the set beyond the prefix
    mixed = mixed.where(F.col("_held") >= F.col("_least")).withColumn("reach", F.col("_held") + outside)
    mixed = keep(mixed.withColumn("ahead", F.row_number().over(own.orderBy("place")) - 1).drop("easy", "_held", "_least"), "mixed")
    release(shared)
    # A pair comes from the first shingle that both prefixes hold: not from one where some of the nearest before it are shared as well. A pair that meets again
    # after a longer gap comes twice, which costs a row. What is shared before it is held before it by both; the class whose prefix ends first bounds all.
    nearest = own.orderBy("place").rowsBetween(-NEAREST, -1)
    seeds = mixed.select("token", "key", "n", "home", "reach", "ahead", (F.col("n") - F.col("place")).alias("behind"), F.collect_list("token").over(nearest).alias("nearest"))
    a, b = seeds.alias("a"), seeds.alias("b")
    overlap = F.ceil(num * (F.col("a.n") + F.col("b.n")) / (num + den))
    crossing = (F.col("a.token") == F.col("b.token")) & (F.col("a.home") < F.col("b.home")) & (num * F.greatest("a.n", "b.n") <= den * F.least("a.n", "b.n"))
    crossing &= (F.greatest("a.reach", "b.reach") >= overlap) & (F.least("a.ahead", "b.ahead") + F.least("a.behind", "b.behind") >= overlap)
    pairs = a.join(b, crossing & ~F.arrays_overlap("a.nearest", "b.nearest")).select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()
    held = mixed.groupBy("key").agg(F.first("n").alias("n"), F.first("matches").alias("matches"), F.collect_set(F.struct("token", "level")).alias("held"))
    a, b = held.alias("a"), held.alias("b")
    met = pairs.join(a, F.col("x") == F.col("a.key")).join(b, F.col("y") == F.col("b.key"))
    asked = F.least("a.matches", "b.matches")

    def among(side: str, level: Column | None = None) -> Column:
        entries = F.col(f"{side}.held") if level is None else F.filter(f"{side}.held", lambda e: e["level"] <= level)
        return F.transform(entries, lambda e: e["token"])

    # What neither prefix holds adds at most the rest of the set whose prefix ends first.
    rest = F.greatest(*[F.ceil(num * F.col(f"{s}.n") / den) - F.col(f"{s}.matches") for s in ("a", "b")])
    needed = F.ceil(num * (F.col("a.n") + F.col("b.n")) / (num + den)) - rest
    leading = F.size(F.array_intersect(among("a", asked), among("b", asked)))
    met = met.where((leading >= asked) & (F.size(F.array_intersect(among("a"), among("b"))) >= needed))
    more = linked(keep(candidates(met.select("x", "y")), "crossing"))
    release(mixed)

    final = components(links.unionByName(more))
    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("key", "first", "second", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(named, ["key", "first", "second", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


@query()
def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), whole_text().alias("text"))
    return similar_components(docs, 4, 85, 100).withColumnRenamed("id", "doc_id")
