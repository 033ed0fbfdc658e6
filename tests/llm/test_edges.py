"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_tables import edges, make  # noqa: F401
from sheetloom.llm import bpe, fingerprints, jaccard, langid, packing, pii, suffixes, tokens, topk, toxicity


KEY = "a key for tests"


@pytest.fixture(scope="module")
def docs(make, edges):
    return make(edges)


@pytest.fixture(scope="module")
def none(make):
    return make([])


def named(docs):
    return docs.withColumnRenamed("doc_id", "id")


def test_tokens(docs, none, edges):
    pattern, ranks = bpe.default_ranks()
    counted = tokens.with_trees(named(docs), pattern, ranks)
    edits = F.array(F.struct(F.lit(-4).alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("replacement")), F.struct(F.lit(9).alias("start"), F.lit(99).alias("length"), F.lit("x").alias("replacement")))
    out = tokens.apply_edits(counted.withColumn("edits", edits.cast(tokens.EDITS)), pattern, ranks).collect()
    assert len(out) == len(edges)
    assert {r.text for r in out if r.id == 1} == {"x"} and all(r.score == 7 for r in out)
    assert tokens.apply_edits(tokens.with_trees(named(none), pattern, ranks).withColumn("edits", F.lit(None).cast(tokens.EDITS)), pattern, ranks).count() == 0


def test_pii(docs, none, edges):
    out = pii.pseudonymised(docs, KEY).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, edges))
    assert all(r.n_values == 0 and r.tree == "clash" for r in out)
    assert pii.pseudonymised(none, KEY).count() == 0


def test_fingerprints(docs, none):
    out = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).withColumn("near", fingerprints.likeness(F.col("print"), F.col("next_print"))).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert out[1].n_chars == 0 and len(out[1].print) == 0 and out[1].near == 1.0 and out[3].near == 0.0
    assert out[4].print == out[5].print and out[4].near == 1.0
    assert len(out[7].print) == 32
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_langid(docs, none, edges):
    assert langid.fit(named(none), F.lit(True)) is None
    out = langid.predict(named(docs), langid.fit(named(docs), F.lit(True))).collect()
    assert len(out) == len(edges)
    assert {r.lang_pred for r in out if r.id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.predict(named(docs), None).collect()} == {"und"}
    assert langid.predict(named(none), None).count() == 0


def test_toxicity(spark, docs, none, edges):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (8, 0), (7, None), (None, 1), (2, 5)], "id long, label int")
    model = toxicity.fit(named(docs), labels)
    out = toxicity.score(named(docs), model).collect()
    assert len(out) == len(edges) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.id in (1, 2, 3)} == {0.0}
    assert toxicity.fit(named(none), labels) is None
    assert {r.score for r in toxicity.score(named(docs), None).collect()} == {0.0}
    assert toxicity.offending(named(docs), model).columns == ["id", "start", "end", "score", "sentence"]


def test_suffixes(docs, none, edges):
    assert {r.id for r in suffixes.repeated_spans(named(docs).select("id", "text")).collect()} == {7}
    out = suffixes.without_copies(docs)
    assert out.columns == docs.columns and out.count() == len(edges)
    assert suffixes.without_copies(none).count() == 0 and suffixes.united(suffixes.repeated_spans(named(none))).count() == 0


def test_bpe(docs, none, edges):
    pattern, ranks = bpe.default_ranks()
    out = bpe.encode(named(docs), pattern, ranks).collect()
    assert len(out) == len(edges)
    texts = {i: t or "" for i, t in edges}
    assert all(bytes(r.decoded).decode() == texts[r.id] for r in out)
    assert bpe.digests(named(none), pattern, ranks).count() == 0


def test_jaccard(docs, none):
    out = {r.id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(named(docs), 4, 85, 100).collect()}
    assert out == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (2, 6), 7: (1, 7), 8: (1, 8)}
    assert jaccard.similar_components(named(none)).count() == 0


def test_packing(docs, none, edges):
    out = packing.packed_texts(docs).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (str(r.doc_id), r.piece)):
        whole.setdefault(r.doc_id, []).append(r)
    assert "".join(r.text for r in whole[8]) == "a" * 50_000
    assert {r.n_chars for r in out if r.doc_id in (1, 2)} == {0}
    assert sum(r.n_chars for r in out if r.doc_id == 7) == 2 * 360_000
    assert packing.best_fit(packing.sized(none)).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf")]), (6, [3.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    usable = df.where(F.col("vec_id").isNotNull() & topk.usable("embedding")).select("vec_id", topk.integers("embedding", 4).alias("vector"))
    out = [tuple(r) for r in topk.top_k(usable, usable.where("vec_id = 0"), 2).orderBy("rank").collect()]
    assert out == [(0, 1, 7, 80), (0, 2, 8, 80)]
    assert topk.top_k(usable.where("vec_id < 0"), usable.where("vec_id < 0"), 2).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, name, stage):
    out = stage(spark, docs, "")
    assert out.count() >= 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == corpus_pipeline.COLUMNS
    assert stage(spark, none, "").count() == 0
