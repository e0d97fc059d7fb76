"""Language identification by sparse multinomial logistic regression on character n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash slots of the n-grams; n-grams of 1 to ORDERS characters.
SLOTS, ORDERS = 1 << 15, 3
UNKNOWN = "und"
#: More values of ``lang`` than this are no languages; their shares of the sample are sent to every task.
MAX_LANGUAGES = 10_000


class LanguageModel(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # SLOTS x languages
    bias: np.ndarray
    temperature: float


def _letters() -> np.ndarray:
    """Which code points are letters, below the end of the last plane that has any."""
    return np.array([chr(c).isalpha() for c in range(0x32000)])


_LETTERS: list[np.ndarray] = []


def slots_of(text: str | None) -> np.ndarray:
    """Hash slots of all n-grams of a text: lower case, letters only, words set apart by one space; empty without a letter."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[0][np.minimum(points, len(_LETTERS[0]) - 1)]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, np.uint32(32))
    keep = letter | np.concatenate([[False], letter[:-1]])
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint32)
    found, code = [], np.zeros(len(points), np.uint32)
    for order in range(1, ORDERS + 1):
        code = code[: len(points) - order + 1] * np.uint32(0x01000193) + points[order - 1 :] + np.uint32(order)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        found.append(mixed >> np.uint32(32 - 15))
    return np.concatenate(found).astype(np.int64)


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the TF-IDF vector of a text, of length 1."""
    counts = np.bincount(slots_of(text), minlength=SLOTS)
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / (np.linalg.norm(values) or 1)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every slot over all rows; one fixed-size table reaches the driver."""

    def count(batches):
        total, rows = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                total[np.unique(slots_of(text.as_py()))] += 1
                rows += 1
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([0, 1], pa.int32()),
            "counts": pa.array([total.tobytes(), np.array([rows], np.int64).tobytes()], pa.binary()),
        })

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        return pa.table({"part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    partial = texts.select("text").mapInArrow(count, schema)
    rows = partial.groupBy("part").applyInArrow(add, schema).collect()
    found = {row["part"]: np.frombuffer(row["counts"], np.int64) for row in rows}
    if not found:
        return np.ones(SLOTS)
    return np.log((1 + found[1][0]) / (1 + found[0])) + 1


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3,
    alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slots x classes) and bias of a multinomial logistic regression.

    FTRL-Proximal (McMahan et al., 2013): each coordinate keeps the sum of its shifted gradients and
    of their squares, and its weight is the closed-form minimum with l1 and l2 penalties, so most stay exactly 0.
    """
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def weights(at):
        return np.where(
            np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0
        )

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, SLOTS), np.append(values, 1.0)
            w = weights(at)
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    found = weights(slice(None))
    return found[:SLOTS], found[SLOTS]


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature_for(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes held-out labels likeliest, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(scores / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    lo, hi, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_language_model(labelled: DataFrame, per_language: int = 1000) -> LanguageModel:
    """A model from rows ``id, text, lang``.

    Document frequencies count all rows.  Weights and temperature are fitted on a bounded sample:
    ``per_language`` rows of each language, drawn by a fixed seed where they lie; a fifth of them for the
    temperature.  Tables of rows without language or text give a model of no language, which answers ``und``.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    idf = inverse_frequencies(labelled)
    shares = labelled.groupBy("lang").agg((F.lit(1.2 * per_language + 50) / F.count("*")).alias("share"))
    if shares.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    drawn = labelled.select("lang", "text", F.rand(7).alias("draw")).join(F.broadcast(shares), "lang").where("draw < share")
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    rows = drawn.withColumn("nth", nth).where(F.col("nth") <= per_language).select("nth", "lang", "text")

    def vectors(batches):
        for batch in batches:
            found = [features(t.as_py(), idf) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "nth": batch.column("nth"), "lang": batch.column("lang"),
                "at": pa.array([at.astype(np.uint16).tobytes() for at, _ in found], pa.binary()),
                "v": pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
            })

    sample = rows.mapInArrow(vectors, "nth int, lang string, at binary, v binary").collect()
    sample = sorted((r for r in sample if r["at"]), key=lambda r: (r["lang"], r["nth"]))
    languages = sorted({r["lang"] for r in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    data = [
        (np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["v"], np.float32).astype(float), number[r["lang"]])
        for r in sample
    ]
    held = [d for d, r in zip(data, sample) if r["nth"] % 5 == 0]
    weights, bias = follow_the_leader([d for d, r in zip(data, sample) if r["nth"] % 5], max(1, len(languages)))
    scores = np.array([v @ weights[at] + bias for at, v, _ in held]).reshape(len(held), len(bias))
    temperature = temperature_for(scores, np.array([label for *_, label in held], int))
    return LanguageModel(languages, idf, weights, bias, temperature)


def predict_language(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of ``texts`` (``text`` among them) but ``text``, with ``lang_pred`` and ``score``, its calibrated probability.

    A text that is null or has no letter gets ``und`` and 0.  Equal texts get equal answers.
    """
    languages, idf, weights, bias, temperature = model
    rest = [f for f in texts.schema.fields if f.name != "text"]

    def predict(batches):
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                at, values = features(text.as_py(), idf)
                if len(at) and languages:
                    p = softmax((values @ weights[at] + bias) / temperature)
                    names.append(languages[int(p.argmax())])
                    scores.append(min(1.0, float(p.max())))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_pydict({
                **{f.name: batch.column(f.name) for f in rest},
                "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()),
            })

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    return texts.mapInArrow(predict, ", ".join([*columns, "lang_pred string", "score double"]))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id, as text, modulo ``parts`` is ``part``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts == part
