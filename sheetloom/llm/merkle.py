"""Merkle manifest of a dataset with checkpointed levels.

Rows are leaves. The leaves of a group stand in order; every ``FANOUT`` neighbours are hashed into their parent, up to the group's subroot, and the subroots
in order of their groups are the leaves of one tree more, up to the root. Only every ``STRIDE``-th level is stored. A proof regenerates the levels between
two stored ones: the nodes of an aligned subtree (at most ``FANOUT ** STRIDE`` stored descendants) meet in one task, which rebuilds the interior of the
subtree, emits the siblings of each descendant below the proof of the subtree's own top, and forgets the interior again. Proofs are made from the top level
down, so each stored level is read once.

* Positions come from one range sort by (group, id, leaf) and the row counts of its partitions, so a group may hold any share of the rows.
* A subtree is bounded, and the proof of its top comes to it once, not once a descendant.
* Every stored level is a table in the shared folder. Levels shrink by a factor of 512; the number of jobs is the logarithm of the largest group.

A hash is the lower-case hexadecimal SHA-256 of its concatenated inputs; digests go in as hexadecimal text. A field of a row goes in as ``-`` if it is
missing, else as the length of its UTF-8 bytes, ``:`` and the value.

Defined results: a lone leaf is its subroot, a lone subroot the root; a missing group is a group of its own and comes first; groups go by their UTF-8 bytes;
rows without an id come first, rows of one id in order of their leaves; equal rows are leaves each, one beside the other; empty and very long texts are
hashed like others; an empty table has no rows and no root; columns other than the hashed ones play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.llm.common import CRC_TABLE, LOWER, UPPER, crc32_sql, keep, query, table

FANOUT, STRIDE = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left: string, right: string>"
STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def node_hash(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return node_hash(*map(field, values))


def group_key(group: Column) -> Column:
    """A text in whose byte order a missing group comes first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


@dataclass(frozen=True)
class Manifest:
    """Stored levels 0, STRIDE, 2 * STRIDE … as tables (grp, pos, n, hash); ``n`` counts the group's nodes on that level. Level 0 has the leaves' own columns too."""

    levels: list[DataFrame]
    carried: list[str]
    fanout: int = FANOUT
    stride: int = STRIDE

    @property
    def span(self) -> int:
        return self.fanout**self.stride

    def shape(self) -> Manifest:
        """Without the tables, as tasks take it."""
        return Manifest([], self.carried, self.fanout, self.stride)

    def tops(self) -> DataFrame:
        """(grp, hash): the subroot of every group."""
        parts = [level.where("n = 1").select("grp", "hash") for level in self.levels]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _numbered(leaves: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Leaves (grp, hash, carried) with their position in the group and the group's size; rows of equal order are alike, so a running number may part them."""
    columns = ["grp", "hash", *carried]
    shards = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["grp", *order, "_tie"]
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shards, *by).sortWithinPartitions(*by).select(*columns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for g in batch.column("grp").to_pylist():
                at = at + 1 if g == before else 0
                before = g
                local.append(at)
            yield pa.record_batch([*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*columns, "_part", "_local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", _part int, _local long"
    counted = keep(ranged.mapInArrow(number, schema), "merkle-order")
    # One row for each partition and group in it: a group is cut by partition ends only.
    runs = counted.groupBy("grp", "_part").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("grp")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("n"))
    placed = counted.join(runs, ["grp", "_part"])
    return placed.select("grp", (F.col("_before") + F.col("_local")).alias("pos"), "n", *columns[1:])


def _interior(nodes: list[str], whole: bool, fanout: int, stride: int) -> list[list[str]]:
    """The levels of a subtree from its stored nodes up; the last has one node. A whole tree ends where one node is left."""
    levels = [nodes]
    while len(levels) <= stride and (not whole or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return levels


def build(leaves: DataFrame, order: tuple[str, ...], carried: tuple[str, ...] = (), fanout: int = FANOUT, stride: int = STRIDE) -> Manifest:
    """The manifest of leaves (grp string, hash string, order, carried), which stand by ``order`` in their groups, missing values first."""
    span = fanout**stride

    def parent(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        n = nodes.column("n")[0].as_py()
        top = _interior(nodes.column("hash").to_pylist(), n <= span, fanout, stride)[-1]
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // span)], pa.int64()), "hash": pa.array(top, pa.string())})

    levels = [keep(_numbered(leaves, list(order), list(carried)), "merkle-leaves")]
    largest = levels[0].agg(F.max("n")).first()[0] or 0
    while largest > 1:
        under = levels[-1].where("n > 1").select("grp", F.floor(F.col("pos") / span).cast("long").alias("block"), "pos", "n", "hash")
        levels.append(keep(under.groupBy("grp", "block").applyInArrow(parent, "grp string, pos long, n long, hash string"), "merkle-level"))
        largest = -(-largest // span)
    return Manifest(levels, list(carried), fanout, stride)


def _proven(nodes: pa.Table, tops: pa.Table, manifest: Manifest, carried: list[str]) -> pa.Table:
    """The nodes of one subtree with their proofs: siblings inside the subtree, then the proof of its top."""
    fanout = manifest.fanout
    nodes = nodes.sort_by("pos")
    hashes = nodes.column("hash").to_pylist()
    levels = _interior(hashes, nodes.column("n")[0].as_py() <= manifest.span, fanout, manifest.stride)
    above, subroot = tops.column("proof")[0].as_py(), tops.column("subroot")[0].as_py()
    proofs = []
    for i in range(len(hashes)):
        own = []
        for level in levels[:-1]:
            first = i - i % fanout
            own.append({"left": "".join(level[first:i]), "right": "".join(level[i + 1 : first + fanout])})
            i //= fanout
        proofs.append(own + above)
    columns = [nodes.column(c) for c in ("grp", "pos", "hash", *carried)]
    return pa.table([*columns, pa.array([subroot] * len(hashes), pa.string()), pa.array(proofs, STEPS)], names=["grp", "pos", "hash", *carried, "subroot", "proof"])


def _prover(shape: Manifest, carried: list[str]):
    return lambda nodes, tops: _proven(nodes, tops, shape, carried)


def prove(manifest: Manifest, upper: DataFrame | None = None) -> DataFrame:
    """(grp, pos, hash, carried, subroot, proof) of every leaf; ``upper`` (grp, subroot, proof) continues the proofs above the groups' subroots.

    A proof lists for every level from the leaf up the siblings before and after the node, concatenated.
    """
    span, above, levels, shape = manifest.span, None, manifest.levels, manifest.shape()
    if upper is None:
        upper = manifest.tops().select("grp", F.col("hash").alias("subroot"), F.array().cast(f"array<{STEP}>").alias("proof"))
    for at in range(len(levels) - 1, -1, -1):
        carried = manifest.carried if at == 0 else []
        if at == len(levels) - 1 and at > 0:
            continue  # nothing but tops
        nodes = levels[at] if at == 0 else levels[at].where("n > 1")
        nodes = nodes.select("grp", F.floor(F.col("pos") / span).cast("long").alias("block"), "pos", "n", "hash", *carried)
        # Whole trees take the proof of their group, other subtrees that of their top one stored level above.
        ending = nodes.where((F.col("n") <= span) & (F.col("pos") == 0)).select("grp", F.lit(0).cast("long").alias("block"))
        tops = ending.join(upper, "grp").select("grp", "block", "subroot", "proof")
        if above is not None:
            tops = tops.unionByName(above.select("grp", F.col("pos").alias("block"), "subroot", "proof"))
        tops = tops.select(F.col("grp").alias("of_grp"), F.col("block").alias("of_block"), "subroot", "proof")
        kinds = dict(nodes.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("grp", "pos", "hash", *carried)) + f", subroot string, proof array<{STEP}>"
        above = nodes.groupBy("grp", "block").cogroup(tops.groupBy("of_grp", "of_block")).applyInArrow(_prover(shape, carried), schema)
    return above


def siblings_hash(proof: Column) -> Column:
    """The hash of a proof: all siblings from the leaf's level to the root's, left to right."""
    return node_hash(F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["left"], s["right"]))), ""))


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda below, s: node_hash(s["left"], below, s["right"]))


def manifest_of(rows: DataFrame, group: str, order: tuple[str, ...], carried: tuple[str, ...] = ()) -> tuple[Manifest, Manifest]:
    """The manifests of the groups and of their subroots for leaves (hash, group, order, carried)."""
    own = dict.fromkeys(["hash", *order, *carried])
    groups = build(rows.select(group_key(F.col(group)).alias("grp"), *own), order, carried)
    roots = build(groups.tops().select(F.lit("").alias("grp"), "hash", F.col("grp").alias("of")), ("of",), ("of",))
    return groups, roots


def root_of(roots: Manifest) -> str | None:
    """The root: one digest, whatever the size of the dataset."""
    row = roots.tops().first()
    return row.hash if row else None


def lowered(text: Column) -> Column:
    """What tampering does here: A-Z lower-cased."""
    return F.translate(text, UPPER, LOWER)


def verified(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row of documents; ``tampered`` rows are checked with their text lower-cased."""
    values = [F.col(c) for c in FIELDS]
    other = F.when(tampered, leaf_hash(*values[:-1], lowered(values[-1])))
    leaves = docs.select("doc_id", "lang", leaf_hash(*values).alias("hash"), other.alias("shown"))
    groups, roots = manifest_of(leaves, "lang", ("doc_id", "hash"), ("doc_id", "shown"))
    root = root_of(roots)
    upper = prove(roots).select(F.col("of").alias("grp"), F.col("hash").alias("subroot"), "proof")
    proven = prove(groups, upper).withColumns({"leaf": F.col("hash"), "root": F.lit(root).cast("string")})
    folded = proven.withColumn("folded_root", fold(F.col("proof"), F.coalesce("shown", "leaf")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({" || ".join(map(_field_sql, FIELDS))}) AS leaf, {crc32_sql("doc_id::VARCHAR")} % 3 = 0 AS tampered,
    sha256({" || ".join(map(_field_sql, FIELDS[:-1]))} || {_field_sql(f"translate(text, '{UPPER}', '{LOWER}')")}) AS shown
  FROM documents, crc_table
),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
tree AS (
  SELECT grp, 0 AS level, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY grp, level, n, pos // {FANOUT}
),
subroots AS (SELECT grp, hash, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY level, n, pos // {FANOUT}
),
below AS (
  SELECT p.grp, p.pos AS leaf_pos, t.level, coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (WHERE t.pos < p.pos // ({FANOUT} ** p.level)::BIGINT), '') AS before,
    coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (WHERE t.pos > p.pos // ({FANOUT} ** p.level)::BIGINT), '') AS behind
  FROM (SELECT grp, pos, unnest(range(20)) AS level FROM placed) p
  JOIN tree t ON t.grp = p.grp AND t.n > 1 AND t.level = p.level AND t.pos // {FANOUT} = p.pos // ({FANOUT} ** (p.level + 1))::BIGINT GROUP BY ALL
),
above AS (
  SELECT p.grp, t.level, coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (WHERE t.pos < p.pos // ({FANOUT} ** p.level)::BIGINT), '') AS before,
    coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (WHERE t.pos > p.pos // ({FANOUT} ** p.level)::BIGINT), '') AS behind
  FROM (SELECT grp, pos, unnest(range(20)) AS level FROM subroots) p
  JOIN upper_tree t ON t.n > 1 AND t.level = p.level AND t.pos // {FANOUT} = p.pos // ({FANOUT} ** (p.level + 1))::BIGINT GROUP BY ALL
),
steps AS (
  SELECT grp, leaf_pos, list(before || '|' || behind ORDER BY stage, level) AS path, string_agg(before || behind, '' ORDER BY stage, level) AS siblings
  FROM (SELECT grp, leaf_pos, 0 AS stage, level, before, behind FROM below UNION ALL SELECT p.grp, p.pos, 1, a.level, a.before, a.behind FROM placed p JOIN above a ON a.grp = p.grp)
  GROUP BY grp, leaf_pos
),
folded AS (
  SELECT p.doc_id, p.leaf, s.hash AS subroot, (SELECT hash FROM upper_tree WHERE n = 1) AS root, sha256(coalesce(t.siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN p.tampered THEN p.shown ELSE p.leaf END, coalesce(t.path, [])), lambda done, step: sha256(split_part(step, '|', 1) || done || split_part(step, '|', 2))) AS folded_root
  FROM placed p JOIN subroots s ON s.grp = p.grp LEFT JOIN steps t ON t.grp = p.grp AND t.leaf_pos = p.pos
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query(SQL)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    proven = verified(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return proven.select("doc_id", "leaf", "subroot", "root", siblings_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")
