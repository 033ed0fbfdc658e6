"""Language identification by a byte convolutional network, trained in numpy.

A window is 256 bytes. Filters of widths 2, 3 and 4 slide over its bytes (each filter is a table of weights per offset and byte value), the
largest response of a filter over the window is rectified, and a softmax over the languages follows. Training is by Adam on windows of a bounded sample:
at most about ``per_language`` rows of each language, drawn by a hash of the id, two windows each. A text is cut into consecutive windows over
its whole length, taken in batches; its score is the mean probability over the windows, weighted by their bytes.

Defined results: a text that is missing or has no letter is ``und`` with score 0; without any labelled row every text is ``und``. Rows with a missing
id, text or label are not learned from. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.common import query, table

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE = 1500
EPOCHS, BATCH, RATE = 6, 64, 0.02
TOGETHER = 32
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: offset, byte, filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """For each width the response of every filter at every place of every window."""
        found = []
        for weights in self.tables:
            width = len(weights)
            places = windows.shape[1] - width + 1
            total = weights[0].take(windows[:, :places], axis=0)
            for j in range(1, width):
                total += weights[j].take(windows[:, j : j + places], axis=0)
            found.append(total)
        return found

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for start in range(0, len(windows), TOGETHER):
            pooled = np.concatenate([r.max(axis=1) for r in self.responses(windows[start : start + TOGETHER])], axis=1)
            parts.append(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)
        return _softmax(np.concatenate(parts))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a whole text, the last one filled up with blanks, and the bytes of text in each."""
    count = max(1, -(-len(text) // WINDOW))
    windows = np.full(count * WINDOW, 32, np.uint8)
    windows[: len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(count, WINDOW)
    sizes[-1] = len(text) - (count - 1) * WINDOW
    return windows.reshape(count, WINDOW), sizes


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit a network on windows (n, 256) of bytes and indexes of their languages."""
    random = np.random.default_rng(seed)
    hidden = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        [random.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(hidden, np.float32),
        random.normal(0, 0.2, (hidden, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    values = [*net.tables, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    balance = 1.0 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)
    balance = (balance * len(labels) / len(languages)).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            x, y = windows[rows], labels[rows]
            all_responses = net.responses(x)
            places = [r.argmax(axis=1) for r in all_responses]
            pooled = np.concatenate([np.take_along_axis(r, p[:, None, :], axis=1)[:, 0] for r, p in zip(all_responses, places)], axis=1) + net.bias
            active = np.maximum(pooled, 0)
            error = _softmax(active @ net.out + net.out_bias)
            error[np.arange(len(y)), y] -= 1
            error *= (balance[y] / len(y))[:, None]
            back = (error @ net.out.T) * (pooled > 0)
            gradients = []
            for i, (weights, place) in enumerate(zip(net.tables, places)):
                gradient = np.zeros_like(weights)
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(weights)):
                    seen = np.take_along_axis(x, place + j, axis=1)
                    np.add.at(gradient[j], (seen, np.arange(FILTERS)[None, :]), own)
                gradients.append(gradient)
            gradients += [back.sum(0), active.T @ error, error.sum(0)]
            step += 1
            for v, g, m, s in zip(values, gradients, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Network | None:
    """Train on documents (id, text, lang) where ``learn`` holds; None if there is nothing to learn from."""
    rows = docs.where(learn & F.col("id").isNotNull() & F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 12).cast("double") / float(1 << 52)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    chosen = rows.where((place < share) & has_letter(F.col("text")))
    room = F.greatest(F.char_length("text") - WINDOW + 1, F.lit(1))
    starts = [F.pmod(F.xxhash64("id", F.lit(j)), room.cast("long")).cast("int") + 1 for j in range(2)]
    sample = chosen.select("lang", *[F.substring("text", s, F.lit(WINDOW)).alias(f"w{j}") for j, s in enumerate(starts)]).collect()
    sample = sorted(sample)  # the same network whatever the order of rows
    languages = sorted({r.lang for r in sample})
    if not languages:
        return None
    windows = np.concatenate([cut(w.encode()[:WINDOW])[0] for r in sample for w in (r.w0, r.w1)])
    labels = np.repeat([languages.index(r.lang) for r in sample], 2)
    return train(windows, labels, languages)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Add lang_pred and score to documents with a column ``text``; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        for batch in batches:
            names, scores, group, held = [], [], [], 0
            results: list[tuple[str, float]] = []

            def close() -> None:
                nonlocal held
                windows = [w for w, _ in group if w is not None]
                p = network.probabilities(np.concatenate(windows)) if windows else None
                at = 0
                for w, sizes in group:
                    if w is None:
                        results.append((UNKNOWN, 0.0))
                        continue
                    mean = np.average(p[at : at + len(w)], axis=0, weights=sizes)
                    at += len(w)
                    best = int(mean.argmax())
                    results.append((network.languages[best], float(min(1.0, mean[best]))))
                group.clear()
                held = 0

            for text, known in zip(batch.column("text"), batch.column("_letter").to_pylist()):
                group.append(cut(text.as_py().encode()) if known else (None, None))
                held += len(group[-1][0]) if known else 0
                if held >= 1024:
                    close()
            close()
            names, scores = [r[0] for r in results], [r[1] for r in results]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "_letter"]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[n for n, _ in kept], "lang_pred", "score"])

    schema = ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in docs.dtypes)
    return docs.withColumn("_letter", has_letter(F.col("text"))).mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_column: str, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    net = fit(docs, ~held_out("id", 4, 2))
    out = predict(docs.select("id", "text").withColumn("held_out", held_out("id", 4, 2)), net)
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")
