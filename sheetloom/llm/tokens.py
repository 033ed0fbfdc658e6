"""Edit-aware token counts: a segment tree over the pre-tokens of every document.

The leaves are blocks of 32 pre-tokens; every node holds the characters and tokens below it. An edit finds its leaf by descending on characters,
goes back as far as the pattern looks ahead (a pre-token depends on two characters after its end at most), reads pre-tokens from that leaf's start in the new
text until one ends where an untouched leaf begins, and updates the sums on the way up. What follows is unchanged, since the pattern
reads from left to right. Leaves that grow too large make the tree anew from its leaves, without encoding anything again.

Defined results: a missing text is empty and has no tokens; edits are applied in order, each to the text the former left; positions beyond the text are
moved to its end, negative ones to its start, missing ones and missing replacements count as 0 and as nothing; missing or empty edit lists change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.bpe import KNOWN_WORDS, default_ranks, merge
from sheetloom.llm.common import query, table, whole_text

BLOCK = 32
LARGEST = 4 * BLOCK
TREE = "tree struct<chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<start: int, length: int, replacement: string>>"


class Counter(dict):
    """Tokens per pre-token, forgotten all at once when there are too many."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        count = len(merge(word.encode("utf-8"), self.ranks))
        self[word] = count
        return count


class Tree:
    """Sums over leaf slots in heap order: node 1 is the root, node i has the children 2i and 2i + 1."""

    def __init__(self, chars, tokens):
        self.chars, self.tokens = np.asarray(chars, np.int64), np.asarray(tokens, np.int64)
        self.size = len(self.chars) // 2

    @classmethod
    def of_leaves(cls, chars: np.ndarray, tokens: np.ndarray) -> "Tree":
        size = 1 << max(0, int(len(chars) - 1).bit_length())
        tree = cls(np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64))
        for sums, leaves in ((tree.chars, chars), (tree.tokens, tokens)):
            sums[size : size + len(leaves)] = leaves
            level = size
            while level > 1:
                half = level // 2
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level = half
        return tree

    @classmethod
    def of_words(cls, lengths, counts) -> "Tree":
        if not len(lengths):
            return cls.of_leaves(np.zeros(1, np.int64), np.zeros(1, np.int64))
        starts = np.arange(0, len(lengths), BLOCK)
        return cls.of_leaves(np.add.reduceat(lengths, starts), np.add.reduceat(counts, starts))

    def leaf_after(self, position: int) -> tuple[int, int]:
        """The first leaf that ends after the position, and where it starts; the last leaf if none does."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if start + self.chars[node] <= position:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def set_leaves(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        low, high = first + self.size, first + self.size + len(chars)
        self.chars[low:high], self.tokens[low:high] = chars, tokens
        high -= 1
        while low > 1:
            low, high = low // 2, high // 2
            for sums in (self.chars, self.tokens):
                sums[low : high + 1] = sums[2 * low : 2 * high + 2 : 2] + sums[2 * low + 1 : 2 * high + 2 : 2]


def edit(text: str, tree: Tree, start: int, length: int, new: str, split: regex.Pattern, count: Counter) -> tuple[str, Tree, int]:
    """The edited text, its tree, and how many characters were encoded again."""
    start = min(max(start, 0), len(text))
    end = min(start + max(length, 0), len(text))
    moved = len(new) - (end - start)
    edited = text[:start] + new + text[end:]
    leaf, origin = tree.leaf_after(max(0, start - 2))
    leaves = tree.chars[tree.size :]
    lengths, counts, at, stop, border = [], [], origin, leaf, origin
    for found in split.finditer(edited, origin):
        lengths.append(found.end() - found.start())
        counts.append(count[found.group()])
        at = found.end()
        while stop < len(leaves) and (border < end or border + moved < at):
            border += int(leaves[stop])
            stop += 1
        if at >= start + len(new) and border >= end and border + moved == at:
            break
    else:
        stop = len(leaves)
    slots = stop - leaf
    ends_c, ends_t = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if slots and len(lengths) <= LARGEST * slots:
        edges = np.linspace(0, len(lengths), slots + 1).astype(int)
        tree.set_leaves(leaf, np.diff(ends_c[edges]), np.diff(ends_t[edges]))
    else:
        cut = np.append(np.arange(0, len(lengths), BLOCK), len(lengths))
        parts = [np.concatenate([sums[tree.size : tree.size + leaf], np.diff(ends[cut]), sums[tree.size + stop :]]) for sums, ends in ((tree.chars, ends_c), (tree.tokens, ends_t))]
        filled = parts[0] > 0
        tree = Tree.of_leaves(*(p[filled] for p in parts)) if filled.any() else Tree.of_words([], [])
    return edited, tree, at - origin


def with_trees(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """Documents (id, text, ...) with their segment trees. Other columns stay; a column ``tree`` is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    docs = docs.drop("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = Counter(sent.value), regex.compile(pattern)
        for batch in batches:
            trees = []
            for text in batch.column("text"):
                found = split.findall(text.as_py() or "")
                tree = Tree.of_words(list(map(len, found)), list(map(count.__getitem__, found)))
                trees.append({"chars": tree.chars.astype(np.int32), "tokens": tree.tokens.astype(np.int32)})
            kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, kind)], names=[*batch.schema.names, "tree"])

    return docs.mapInArrow(run, f"{_ddl(docs)}, {TREE}")


def apply_edits(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """Apply the column ``edits`` to documents with trees: text and tree are the edited ones, ``reencoded_chars`` says how much was encoded."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    docs = docs.drop("reencoded_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = Counter(sent.value), regex.compile(pattern)
        for batch in batches:
            texts, trees, again = [], [], []
            for text, tree, edits in zip(batch.column("text"), batch.column("tree"), batch.column("edits")):
                text, done = text.as_py() or "", 0
                tree = Tree(tree["chars"].values.to_numpy(), tree["tokens"].values.to_numpy())
                for e in edits.as_py() or []:
                    if e is not None:
                        text, tree, more = edit(text, tree, e["start"] or 0, e["length"] or 0, e["replacement"] or "", split, count)
                        done += more
                texts.append(text)
                trees.append({"chars": tree.chars.astype(np.int32), "tokens": tree.tokens.astype(np.int32)})
                again.append(done)
            new = {"text": pa.array(texts, pa.string()), "tree": pa.array(trees, batch.schema.field("tree").type)}
            columns = [new.get(name, column) for name, column in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.int64())], names=[*batch.schema.names, "reencoded_chars"])

    return docs.mapInArrow(run, f"{_ddl(docs)}, reencoded_chars long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in df.dtypes)


@query()
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts before and after three edits per document: an insertion after a third, a deletion in the middle, a new ending."""
    pattern, ranks = default_ranks()
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), whole_text().alias("text"))
    n = F.char_length("text")
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    edits = F.array(
        F.struct(third.alias("start"), F.lit(0).alias("length"), F.concat(F.lit("'s note "), F.col("id").cast("string")).alias("replacement")),
        F.struct(half.alias("start"), F.lit(9).alias("length"), F.lit("").alias("replacement")),
        F.struct((n - 5).alias("start"), F.lit(40).alias("length"), F.substring("text", 1, 25).alias("replacement")),
    )
    counted = with_trees(docs, pattern, ranks)
    total = lambda: F.get("tree.tokens", F.lit(1)).cast("long")
    counted = counted.select("id", "text", "tree", edits.cast(EDITS).alias("edits"), n.cast("long").alias("n_chars"), total().alias("n_tokens"))
    out = apply_edits(counted, pattern, ranks)
    return out.select(F.col("id").alias("doc_id"), "n_chars", "n_tokens", F.char_length("text").cast("long").alias("edited_chars"), total().alias("edited_tokens"), "reencoded_chars")
