"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased texts give hashed character n-grams of one to three points.  Document
frequencies are counted over all rows that may be learned from.  The weights are
trained on a bounded sample with follow-the-regularised-leader (FTRL-proximal) and
an elastic-net penalty, which keeps most of them at zero; a temperature is then
fitted to rows of the sample that the weights did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import append_columns
from corpuslake.llm.labelled import bounded, held_out, remainder, within

BITS = 16
SIZE = 1 << BITS
_CHUNK = 1 << 20
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and counts of a whole text's 1-, 2- and 3-grams."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    total = np.zeros(SIZE, np.int64)
    for at in range(0, len(points), _CHUNK):
        part = points[at : at + _CHUNK + 2]
        here = min(_CHUNK, len(points) - at)
        h = np.zeros(len(part), np.uint32)
        for n in range(3):
            if len(part) <= n:
                break
            h = (h[: len(part) - n] ^ (part[n:] + np.uint32(n + 1))) * _MIX
            h ^= h >> np.uint32(15)
            total += np.bincount((h[:here] * _MIX) >> np.uint32(32 - BITS), minlength=SIZE)
    where = np.flatnonzero(total)
    return where, total[where]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # of TF-IDF buckets, by language
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        where, count = gram_counts(text)
        x = count * self.idf[where]
        return where, x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, where: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*self.vector(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], idf: np.ndarray, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel:
    """FTRL-proximal over the rows in order, four fifths for the weights and the rest for the temperature."""
    names = sorted(set(langs))
    model = LanguageModel(names, np.zeros((SIZE, len(names))), np.zeros(len(names)), idf)
    if not names:
        return model
    rows = [(*model.vector(t), names.index(g)) for t, g in zip(texts, langs, strict=True)]
    learn, check = [r for k, r in enumerate(rows) if k % 5], [r for k, r in enumerate(rows) if not k % 5]
    z, n = np.zeros((SIZE + 1, len(names))), np.zeros((SIZE + 1, len(names)))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(passes):
        for where, x, y in learn or check:
            at, value = np.append(where, SIZE), np.append(x, 1.0)
            w = weights(at)
            g = _softmax(value @ w)
            g[y] -= 1
            g = value[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(SIZE + 1))
    model.weights, model.bias = every[:SIZE], every[SIZE]
    if check:
        scores, truth = np.array([model.logits(w, x) for w, x, _ in check]), np.array([y for *_, y in check])

        def loss(log_t):
            return -np.log(np.maximum(_softmax(scores / np.exp(log_t))[np.arange(len(truth)), truth], 1e-12)).mean()

        model.temperature = float(np.exp(min(np.linspace(-3, 3, 121), key=loss)))
    return model


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, over all rows; one entry a bucket reaches the driver."""

    def run(batches):
        seen, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[gram_counts(text)[0]] += 1
                rows += 1
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], rows))], ["bucket", "n"])

    total = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r.bucket: r.n for r in total}
    return np.array([found.get(k, 0) for k in range(SIZE)], np.float64), found.get(-1, 0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 4000, max_points: int = 1 << 26) -> LanguageModel:
    """Weights from at most ``max_rows`` rows outside the hold-out with a language, of ``max_points`` code points in all; frequencies from all such rows.

    Beyond ``max_points`` the longest texts of the sample are left out.  Null texts
    count as empty; repeated rows count each, up to the bounds.
    """
    learnable = docs.filter((remainder(id_col, 3) != 1) & F.col(lang_col).isNotNull())
    seen, rows = document_frequencies(learnable, text_col)
    idf = np.log((1 + rows) / (1 + seen)) + 1
    known = learnable.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    chosen = bounded(known.select("_id").filter("_id is not null"), "_id", max_rows).distinct()
    got = within(known.join(F.broadcast(chosen), "_id"), max_rows, max_points, "lang").collect()
    got.sort(key=lambda r: (hash_order(r["_id"]), r["lang"], r["text"] or ""))
    return fit([r["text"] for r in got], [r["lang"] for r in got], idf)


def hash_order(key) -> int:
    import zlib

    return zlib.crc32(str(key).encode())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score``.

    Null texts and texts without a letter, as well as all texts if there was
    nothing to learn from, are ``und`` with score 0.  Repeated rows get equal
    results; an empty table gives an empty result; other columns are ignored.
    """

    def make(texts):
        found = [model.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    found = append_columns(docs, text_col, fields, make, [id_col])
    return found.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
