"""Toxicity by multiple-instance learning: sentences get scores, a noisy-or over them is the document's score.

Only documents are labelled. A sentence's score is a logistic function of its words; a document is toxic if at least one sentence is, so its probability is
1 - prod(1 - p). Training follows the gradient of the document likelihood down to the words, which puts the weight on the sentences that
explain the label; afterwards the sentences over one half are the offending ones.

A word's features are the word itself and its first four and five letters, since insults come in many forms. The vocabulary holds the features whose presence tells the labels apart best (a chi-square test on the sample). The sample is bounded: labelled rows in
order of a hash of the id, ``rows`` of them or ``characters`` characters, long texts among them like others.

Defined results: missing and empty texts and texts without words score 0; labels other than 0 and 1, missing ids and texts are not learned from; without both labels in the
sample every score is 0. Repeated rows are scored each, equal texts alike; texts of any length are scored whole, and clean sentences, however many, stay below a fifth together.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.common import query, table
from sheetloom.llm.langid import held_out

ROWS, CHARACTERS, VOCABULARY = 10_000, 50_000_000, 2_000
CLEAN, CLEAN_TOTAL = 0.05, 0.2
STEPS, RATE, DECAY = 400, 0.15, 2e-5
KNOWN_WORDS = 400_000
SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W_]+")


def features(word: str) -> tuple[str, ...]:
    return word, f"^{word[:4]}", f"^{word[:5]}"


class Weights(dict):
    """The weight of every word met so far, forgotten all at once when there are too many."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = total = sum(self.known.get(f, 0.0) for f in features(word))
        return total

    def __reduce__(self):
        return Weights, (self.known,)


@dataclass
class Model:
    weights: Weights
    bias: float

    def sentences(self, text: str | None) -> Iterator[tuple[int, int, float]]:
        """(start, end, score) of every sentence with words."""
        at = 0
        text = text or ""
        for stop in [*[m.end() for m in SENTENCE.finditer(text)], len(text)]:
            found = set(WORD.findall(text[at:stop].lower()))
            if found:
                yield at, stop, 1 / (1 + np.exp(-(self.bias + sum(sorted(map(self.weights.__getitem__, found))))))
            at = stop

    def document(self, text: str | None) -> float:
        """The noisy-or of the sentences. Those below ``CLEAN`` count together, up to ``CLEAN_TOTAL``, so that length alone makes no text toxic."""
        weight, log_none, clean, plain = self.weights.__getitem__, 0.0, 0.0, 0
        for part in SENTENCE.split((text or "").lower()):
            known = [v for v in map(weight, set(WORD.findall(part))) if v]
            if known:
                own = _softplus(self.bias + sum(sorted(known)))
                if own < CLEAN:
                    clean += own
                else:
                    log_none += own
            elif part and not part.isspace():
                plain += 1
        clean += plain * _softplus(self.bias)
        return -math.expm1(-(log_none + CLEAN_TOTAL * clean / (CLEAN_TOTAL + clean)))


def _softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fit sentence weights from document labels."""
    def sentences(text: str) -> Iterator[set[str]]:
        for part in SENTENCE.split(text.lower()):
            if found := set(WORD.findall(part)):
                yield found

    total, hit = Counter(), Counter()
    for text, y in zip(texts, labels):
        present = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        total.update(present)
        if y:
            hit.update(present)
    n, positive = len(labels), int(labels.sum())
    chosen = []
    for w, t in total.items():
        if t >= 5 and t < n:
            expected = t * positive / n
            chosen.append(((hit[w] - expected) ** 2 / (expected * (1 - positive / n) * (1 - t / n) + 1e-9), w))
    vocabulary = {w: i for i, (_, w) in enumerate(sorted(chosen, key=lambda x: (-x[0], x[1]))[:VOCABULARY])}
    del total, hit, chosen
    sentence_of, word_of, document_of, count = array("l"), array("l"), array("l"), 0
    for i, text in enumerate(texts):
        for s in sentences(text):
            known = [vocabulary[f] for w in sorted(s) for f in features(w) if f in vocabulary]
            sentence_of.extend([count] * len(known))
            word_of.extend(known)
            document_of.append(i)
            count += 1
    sentence_of, word_of, document_of = (np.array(x, np.int64) for x in (sentence_of, word_of, document_of))
    weights, bias = np.zeros(len(vocabulary)), -6.0
    m, s = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    y = labels.astype(float)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(sentence_of, weights[word_of], minlength=count)
        none = np.bincount(document_of, np.logaddexp(0, z), minlength=n)  # -log of the chance that no sentence is toxic
        chance = 1 / (1 + np.exp(-z))
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-6), 1.0)
        back = pull[document_of] * chance
        gradient = np.append(np.bincount(word_of, back[sentence_of], minlength=len(vocabulary)), back.sum()) / n
        gradient[:-1] += DECAY * weights
        m += 0.1 * (gradient - m)
        s += 0.01 * (gradient**2 - s)
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        weights -= change[:-1]
        bias -= change[-1]
    return Model(Weights({f: float(weights[i]) for f, i in vocabulary.items()}), float(bias))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, characters: int = CHARACTERS) -> Model | None:
    """Train on documents (id, text) and labels (id, label); None without both labels.

    The sample is the first rows in order of a hash of their ids, whatever their length, until ``rows`` rows or ``characters`` characters are together.
    """
    usable = labels.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).select("id", "label")
    sample = usable.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.select("id", "text").where(F.col("text").isNotNull())
    sizes = texts.select("id", F.char_length("text").alias("size")).join(F.broadcast(sample), "id").select(F.xxhash64("id").alias("h"), "id", "label", "size")
    last, total = None, 0
    for row in sorted(sizes.collect()):
        total += row.size
        if total > characters:
            break
        last = row.h
    if last is None:
        return None
    chosen = sample.where(F.xxhash64("id") <= last)
    found = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").collect()
    found = sorted(found)
    y = np.array([r.label for r in found], np.int64)
    if len(found) == 0 or y.min() == y.max():
        return None
    return train([r.text for r in found], y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(id, score) for documents (id, text)."""
    if model is None:
        return docs.select("id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = [min(1.0, max(0.0, own.document(t.as_py()))) for t in batch.column("text")]
            yield pa.record_batch([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, score double")


def offending(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(id, start, end, score, sentence): the sentences at or over the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b, float(p), t[a:b].strip()) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if t for a, b, p in sent.value.sentences(t) if p >= threshold]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "start", "end", "score", "sentence"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, start int, end int, score double, sentence string")


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = fit(docs, labels.where(~held_out("id", 5, 0)))
    out = score(docs, model).select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
