"""The pipeline's stages against plain versions, with repeated and missing ids."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetloom.llm import langid
from sheetloom.llm.common import WORD

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(WORD, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts):
    """Places of texts by near-duplicate group, from all pairs."""
    sets = list(map(shingles, texts))
    home = list(range(len(texts)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                home[root(i)] = root(j)
    found = defaultdict(list)
    for i in range(len(texts)):
        found[root(i)].append(i)
    return list(found.values())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(7))


def test_every_unlike_text_of_a_repeated_id_stays(spark):
    rng = random.Random(1)
    a, u, v = (" ".join(word(rng) for _ in range(60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, u), (5, u), (None, v), (None, v), (None, a), (8, None), (9, ""), (9, None)]
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()), key=str)
    assert out == sorted([(False, 3, a), (False, 5, u), (True, 0, v), (False, 8, None), (False, 9, ""), (False, 9, None)], key=str)


def test_words_of_a_repeated_id_stay(spark):
    """Only the words of the passage go, in later rows only, whatever else bears their id."""
    rng = random.Random(2)
    passage = [word(rng) for _ in range(60)]
    own = [[f"{c}{i}" for i in range(80)] for c in "pqrs"]
    rows = [(1, " ".join(passage + own[0])), (5, " ".join(own[1] + passage)), (5, " ".join(["zz", *own[2]])), (None, " ".join(passage + own[3]))]
    out = corpus_pipeline.repeated_passages(spark, table(spark, rows), "").collect()
    words = [w for r in out for w in r.text.split()]
    assert len(out) == 4 and sorted(words) == sorted(passage + ["zz"] + [w for o in own for w in o])
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_one_document_of_each_group_stays(spark, seed):
    rng = random.Random(seed)
    base = [[word(rng) for _ in range(rng.choice([3, 6, 40, 90]))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = word(rng)
        rows.append((rng.choice([i, i, i - 1, None]), " ".join(words)))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table(spark, rows), "").collect()]
    expected = []
    for group in groups_of([t for _, t in rows]):
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in group)
        expected.append({rows[i][1] for i in group if (rows[i][0] is None, rows[i][0] or 0) == least})
    assert len(kept) == len(expected)
    for texts in expected:
        assert sum(t in texts for _, t in kept) == 1


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.language(spark, docs, FOLDER)
    assert kept.count() >= 0.98 * len(before)
    alone = corpus_pipeline.near_duplicates(spark, kept, FOLDER)
    texts = [r.text for r in alone.collect()]
    assert len(texts) == len(groups_of([r.text for r in kept.collect()]))
    cut = corpus_pipeline.repeated_passages(spark, alone, FOLDER)
    assert cut.count() == len(texts) and sum(r.n_chars for r in cut.collect()) < sum(map(len, texts))
    private = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, cut, FOLDER).collect()}
    assert set(private) == {r.doc_id for r in cut.collect()}
    packed = corpus_pipeline.packing_stage(spark, corpus_pipeline.personal_data(spark, cut, FOLDER), FOLDER).collect()
    whole = defaultdict(dict)
    for r in packed:
        whole[r.doc_id][r.piece] = r.text
    assert {i: "".join(t for _, t in sorted(parts.items())) for i, parts in whole.items()} == {i: t or "" for i, t in private.items()}


def test_language_stage_keeps_what_a_language_explains(spark):
    """Texts without a letter go; the decision is that of the plain prediction over the same texts."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = table(spark, [(900, "12 34 -- 56"), (901, None), (902, "   "), (903, "!!!")])
    both = docs.select(*corpus_pipeline.COLUMNS).unionByName(odd)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, FOLDER).collect()}
    assert not kept & {900, 901, 902, 903}
    net = langid.fit(both.select(F.col("doc_id").alias("id"), "text", "lang"), F.lit(True))
    named = {r.doc_id: r.lang_pred for r in langid.predict(both, net).collect()}
    assert kept <= {i for i, name in named.items() if name != langid.UNKNOWN}


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} <= set(range(200)) and len(rows) > 150
    assert all(len(r.text) == r.n_chars <= 8192 for r in rows)
