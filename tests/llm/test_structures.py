"""Merkle manifest, cost-balanced packing and prefix trie against plain versions."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from llm_tables import edges, make  # noqa: F401
from sheetloom.llm import balanced, merkle, trie
from sheetloom.llm.common import QUERIES

SMALL = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Merkle manifest


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_siblings(levels, at, fanout):
    found = []
    for level in levels[:-1]:
        first = at - at % fanout
        found += [level[i] for i in range(first, min(first + fanout, len(level))) if i != at]
        at //= fanout
    return found


def plain_manifest(rows, fanout):
    """(group, leaf) -> sorted proofs, and the root, for (group, id, hash) rows."""
    groups = defaultdict(list)
    for g, i, h in rows:
        groups["" if g is None else "=" + g].append((i is not None, i or 0, h))
    trees = {g: plain_tree([h for *_, h in sorted(v)], fanout) for g, v in groups.items()}
    order = sorted(trees, key=str.encode)
    top = plain_tree([trees[g][-1][0] for g in order], fanout)
    out = []
    for n, g in enumerate(order):
        for at, leaf in enumerate(trees[g][0]):
            out.append((leaf, trees[g][-1][0], H(*plain_siblings(trees[g], at, fanout), *plain_siblings(top, n, fanout))))
    return sorted(out), top[-1][0]


@pytest.mark.parametrize("fanout, stride, shards", [(2, 2, 3), (3, 1, 8), (8, 3, 5)])
def test_proofs_of_any_tree(spark, fanout, stride, shards):
    rng = random.Random(fanout)
    rows = [(g, i if rng.random() < 0.9 else None, H(str(rng.randrange(40)), g or "")) for g, n in [(None, 7), ("a", 1), ("b", 90), ("ü", 17), ("z", 33), ("b b", 8)] for i in range(n)]
    rows += rows[10:30]
    df = spark.createDataFrame(rows, "grp string, id long, hash string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        groups = merkle.build(df.withColumn("grp", merkle.group_key(F.col("grp"))), ("id", "hash"), fanout=fanout, stride=stride)
        roots = merkle.build(groups.tops().select(F.lit("").alias("grp"), "hash", F.col("grp").alias("of")), ("of",), ("of",), fanout, stride)
        upper = merkle.prove(roots).select(F.col("of").alias("grp"), F.col("hash").alias("subroot"), "proof")
        proven = merkle.prove(groups, upper)
        found = [tuple(r) for r in proven.select("hash", "subroot", merkle.siblings_hash(F.col("proof")), merkle.fold(F.col("proof"), F.col("hash"))).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected, root = plain_manifest(rows, fanout)
    assert sorted(r[:3] for r in found) == expected
    assert {r[3] for r in found} == {root} == {merkle.root_of(roots)}


def test_only_every_third_level_is_stored(spark):
    df = spark.range(1500).select(F.lit("=g").alias("grp"), "id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    manifest = merkle.build(df, ("id",))
    assert [level.count() for level in manifest.levels] == [1500, 3, 1]


def test_manifest_of_edges(spark, make, edges):  # noqa: F811
    docs = make([*edges, (9, "Shout"), (12, None)])
    out = merkle.verified(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()
    assert len(out) == len(edges) + 2 and len({r.root for r in out}) == 1
    whole = {(r.doc_id, r.leaf) for r in out}
    length = len("a" * 50_000)
    assert (8, H("1:8", f"4:src{length % 3}", "2:en", "-", f"{length}:", "a" * length)) in whole
    assert (1, H("1:1", "-", "2:en", "-", "-")) in whole
    for r in out:
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        upper = r.doc_id in (6, 9)
        assert r.verified == (not (tampered and upper)) == (r.folded_root == r.root)
    assert merkle.verified(make([]), F.lit(True)).count() == 0
    assert [(r.leaf == r.subroot == r.root, r.proof, r.verified) for r in merkle.verified(make([(3, "One")]), F.lit(False)).collect()] == [(True, [], True)]
    assert [r.verified for r in merkle.verified(make([(3, "One")]), F.lit(True)).collect()] == [False]


# Cost-balanced packing


def plain_assign(lengths, capacity):
    """Linear search over all sequences."""
    rooms = balanced.rooms_for(sum(lengths), capacity)
    used, cost = [0] * len(rooms), [0.0] * len(rooms)
    left = sorted((-n, i, 0) for i, n in enumerate(lengths) if n)
    placed = []
    while left:
        n, item, start = left.pop(0)
        n = -n
        fit = [s for s in range(len(rooms)) if rooms[s] - used[s] >= n] or [s for s in range(len(rooms)) if rooms[s] > used[s]]
        s = min(fit, key=lambda s: (cost[s], s))
        taken = min(n, rooms[s] - used[s])
        placed.append((item, start, taken, s, used[s]))
        used[s] += taken
        cost[s] += balanced.LINEAR * taken + balanced.QUADRATIC * taken * taken
        if taken < n:
            left = sorted([*left, (taken - n, item, start + taken)])
    return placed


@pytest.mark.parametrize("seed", range(12))
def test_assignment_is_the_linear_search(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 2, rng.randrange(64), 63, 40]) for _ in range(rng.randrange(1, 160))]
    assert balanced.assign(lengths, 64) == plain_assign(lengths, 64)


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [rng.choice([rng.randrange(1, 60), rng.randrange(200, 330)]) for _ in range(4000)]
    cost = defaultdict(float)
    for _, _, n, s, _ in balanced.assign(lengths):
        cost[s] += balanced.LINEAR * n + balanced.QUADRATIC * n * n
    full = [c for s, c in cost.items() if s < sum(lengths) // 1024]
    ordered = defaultdict(float)
    at = 0
    for n in lengths:  # cutting in the given order, for comparison
        while n:
            taken = min(n, 1024 - at % 1024)
            ordered[at // 1024] += balanced.LINEAR * taken + balanced.QUADRATIC * taken * taken
            at, n = at + taken, n - taken
    assert np.std(full) < 0.75 * np.std(list(ordered.values())[:-1])


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, balanced._tokenizer(path)


def check_pieces(pieces, texts, tokenizer, capacity=1024):
    """texts: (doc_id, text) rows; ids of repeated rows are told apart by their digests only, so they are compared as bags."""
    expected = defaultdict(list)
    for i, text in texts:
        expected[i].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(by_doc) == set(expected)
    for i, own in by_doc.items():
        assert sum(p.length for p in own) == sum(map(len, expected[i]))
        if len(expected[i]) == 1:
            ids = expected[i][0]
            own.sort(key=lambda p: p.start)
            assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
            assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids) for p in own)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        n = sum(p.length for p in own)
        assert 0 < n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    assert padding == 0


def test_pieces_of_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_pieces(QUERIES["op12_balanced_packing"](spark, SMALL).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer[1])


def test_pieces_of_edges(make, edges, tokenizer):  # noqa: F811
    named = make(edges).withColumnRenamed("doc_id", "id")
    check_pieces(balanced.packed(named, tokenizer[0], shard_rows=3).collect(), edges, tokenizer[1])
    special = [(1, "a <|endoftext|> b"), (2, "c")]
    check_pieces(balanced.packed(make(special).withColumnRenamed("doc_id", "id"), tokenizer[0], PATTERN).collect(), special, tokenizer[1])
    assert balanced.packed(make([]).withColumnRenamed("doc_id", "id"), tokenizer[0]).count() == 0


@pytest.mark.parametrize("size", [1, 7, 50])
def test_parts_encode_like_the_whole(tokenizer, size):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Bé", " ", "  ", "\n", "'s", "it's", "12", " 7", "漢", "!", " x", "_", "²", " ²"]) for _ in range(120))
        parts = balanced.parts_of(text, size)
        assert "".join(parts) == text
        whole = tokenizer[1].encode(text, add_special_tokens=False).ids
        assert [i for p in parts for i in tokenizer[1].encode(p, add_special_tokens=False).ids] == whole


def test_rank_encoder_gives_the_library_ids(tokenizer):
    """Every code point in several places, and every piece from its own bytes by the list of merges, which makes ranks and merges agree on all texts."""
    fast, plain = balanced.Encoder(tokenizer[0], PATTERN, 0), balanced.Encoder(tokenizer[0], None, 0)
    assert fast.by_rank is not None and plain.by_rank is None
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for k in range(0, len(points), 50_000):
        texts = [f"a{c} {c}b{c}{c}1{c}!{c}" for c in points[k : k + 50_000]]
        assert all(np.array_equal(x, y) for x, y in zip(fast.encoded(texts), plain.encoded(texts)))
    model = json.loads(tokenizer[1].to_str())["model"]
    rank = {tuple(m): i for i, m in enumerate(model["merges"])}

    def merged(parts):
        while len(parts) > 1:
            lowest, at = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if lowest == len(rank):
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    assert all(len(merged(list(w))) == 1 for w in model["vocab"] if w != "<|endoftext|>")


# Prefix trie


@pytest.mark.parametrize("n, width", [(3, 1), (300, 2), (5000, 3)])
def test_radix_tree_keeps_its_keys(n, width):
    rng = random.Random(n)
    keys = [bytes(rng.randrange(256) for _ in range(width * rng.randrange(4))) for _ in range(n)]
    root = trie.Node(b"")
    for i, k in enumerate(keys):
        trie.insert(root, k, i, [])
    found, layouts = {}, set()

    def walk(node, path):
        layouts.add(node.layout)
        assert node.count == len(list(node.items())) <= node.layout
        assert node.ends or node is root or node.count > 1, "single children are compressed"
        if node.ends:
            found[path + node.prefix] = node.ends[0]
        for b, c in node.items():
            assert node.find(b) is c
            walk(c, path + node.prefix + bytes([b]))

    walk(root, b"")
    assert found == {k: keys.count(k) for k in set(keys)}
    assert n < 5000 or layouts == {4, 16, 48, 256}


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest[:16], (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(set)
    for key in members:
        if key:
            children[key[:-1]].add(key)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += (len(m) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, ())), leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == k).encode()).hexdigest())
        for k, m in members.items()
    )


def found_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [1, 4, 1000])
def test_trie_of_shared_turns(spark, shard_rows):
    """Families, copies and prefixes of copies, over shards that cut them anywhere."""
    rng = random.Random(7)
    rows = []
    for c in range(60):
        if c % 7 != 3:
            shared = rng.random() < 0.5
            rows += [(c, t, "user", "same" if shared or rng.random() < 0.4 else f"turn {rng.randrange(3)} ü") for t in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found_trie(trie.prefix_trie(df, shard_rows)) == plain_trie(rows)


def test_trie_of_edges(spark):
    rows = [(1, None, None, None), (1, 2, "u", "x" * 200_000), (1, 2, "a", "tie"), (2, 1, "", ""), (2, 1, "", ""), (None, 1, "u", "lost"), (7, -3, "u", "neg"), (10**15 + 1, 0, "u", "far"), (-4, 1, "u", "below zero")]
    rows += [(20, t, "user", f"long {t % 3}") for t in range(1500)] + [(21, t, "user", f"long {t % 3}") for t in range(1400)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(3)
    found = found_trie(trie.prefix_trie(df, 2))
    expected = [r for r in rows if r[0] is None or r[0] >= 0]
    assert len(found) > 1500
    assert found_trie(trie.prefix_trie(df.where("conv_id >= 0 or conv_id is null"), 2)) == plain_trie(expected)
    assert trie.prefix_trie(df.where("conv_id < -9")).count() == 0


def test_copies_lie_in_many_shards(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 200, 5) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found_trie(trie.prefix_trie(df, 3)) == plain_trie(rows)
