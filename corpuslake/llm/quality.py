"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are put in quantile bins.  Cyclic boosting visits the features
round by round; each visit fits a shallow tree (up to four leaves) on one feature's
bins to the gradient and adds it to that feature's lookup table.  The pairs with the
largest gain then get two-way tables in the same way.  A score is the sigmoid of
a sum of looked-up bin values, added for a whole batch of rows at once.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import append_columns
from corpuslake.llm.labelled import bounded, chosen_labels, held_out, remainder, texts_of

FEATURES = (
    "log_chars", "log_words", "word_length", "unique_words", "short_words", "upper", "digits", "symbols", "top_symbol", "bars",
    "stops", "commas", "bangs", "new_lines", "line_length", "repeated_lines", "open_lines", "marked_words", "other_letters", "repeated_word_pairs",
)
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _COMMA, _BANG, _BAR, _MARK, _LETTER = range(10)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """The class of each code point below 65,536; made once in each worker."""
    if not _CLASSES:
        table = np.full(65536, _MARK, np.uint8)
        for cp in range(65536):
            kind = unicodedata.category(chr(cp))
            if kind[0] in "LM":
                table[cp] = _UPPER if kind == "Lu" else _LOWER
            elif kind[0] == "N":
                table[cp] = _DIGIT
            elif kind[0] == "Z" or cp in (9, 10, 11, 12, 13):
                table[cp] = _SPACE
        for marks, kind in ((".", _STOP), (",;:'\"-()’", _COMMA), ("!?", _BANG), ("|", _BAR)):
            table[[ord(c) for c in marks]] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def features_of(text: str | None) -> list[float]:
    """The features of a whole text; a null text counts as empty."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _classes()[np.minimum(points, 65535)]
    count = np.bincount(kinds, minlength=10)
    chars, words = max(len(points), 1), text.split()
    n = max(len(words), 1)
    marks = points[(kinds >= _STOP) & (points < 256)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    tails = sum(line.rstrip()[-1] in ".!?…:;" for line in lines)
    pairs = set(zip(words, words[1:], strict=False))
    ends = np.flatnonzero(np.diff(kinds == _SPACE, append=True) & (kinds != _SPACE))
    return [
        np.log1p(len(points)), np.log1p(len(words)), lengths.sum() / n, len(set(words)) / n, (lengths <= 3).sum() / n, count[_UPPER] / chars, count[_DIGIT] / chars, (count[_MARK] + count[_BAR]) / chars,
        np.bincount(marks, minlength=1).max() / chars, count[_BAR] / n, count[_STOP] / n, count[_COMMA] / n, count[_BANG] / n, text.count("\n") / n, np.log1p(chars / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), 1 - tails / max(len(lines), 1), (kinds[ends] >= _BANG).sum() / n, ((points > 127) & (kinds <= _UPPER)).sum() / chars, 1 - len(pairs) / max(len(words) - 1, 1),
    ]


def feature_rows(texts) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    """Bin edges and tables; ``score`` adds looked-up values."""

    prior: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.prior)
        if not self.edges:
            return 1 / (1 + np.exp(-total))
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, rows[:, k], side="right")]
        coarse = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.pair_edges)]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h, penalty):
    return g * g / (h + penalty)


def _tree(g: np.ndarray, h: np.ndarray, penalty: float, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins with gradient and curvature sums."""
    whole = np.full(len(g), -g.sum() / (h.sum() + penalty))
    if depth == 0 or len(g) < 2:
        return whole
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h, penalty) + _gain(g.sum() - left_g, h.sum() - left_h, penalty) - _gain(g.sum(), h.sum(), penalty)
    at = int(gain.argmax())
    if gain[at] <= 1e-9:
        return whole
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], penalty, depth - 1), _tree(g[at + 1 :], h[at + 1 :], penalty, depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-way table into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        a, row, col, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return a, row - a, col - a, all_ - row - col + a

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    pg, ph = parts(cg), parts(ch)
    gain = sum(_gain(x, y, penalty) for x, y in zip(pg, ph, strict=True)) - _gain(cg[-1, -1], ch[-1, -1], penalty)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = np.empty(g.shape)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), pg, ph, strict=True):
        values[rows, cols] = -x[i, j] / (y[i, j] + penalty)
    return float(gain[i, j]), values


def fit(rows: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pair_bins: int = 8, pairs: int = 8, penalty: float = 2.0) -> AdditiveModel:
    """Train on feature rows and 0/1 labels; without both labels the model is the smoothed prior."""
    base = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(base / (1 - base))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(rows[:, k], bins) for k in range(rows.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(model.edges)]
    total = np.full(len(y), model.prior)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for place, table in zip(binned, model.tables, strict=True):
            g, h = slopes()
            step = rate * _tree(np.bincount(place, g, len(table)), np.bincount(place, h, len(table)), penalty)
            table += step
            total += step[place]
    model.pair_edges = [_edges(rows[:, k], pair_bins) for k in range(rows.shape[1])]
    coarse = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)

    def sums(a, b, g, h):
        cell = coarse[a] * shape(a, b)[1] + coarse[b]
        size = shape(a, b)[0] * shape(a, b)[1]
        return np.bincount(cell, g, size).reshape(shape(a, b)), np.bincount(cell, h, size).reshape(shape(a, b))

    g, h = slopes()
    gains = {(a, b): _quadrants(*sums(a, b, g, h), penalty)[0] for a, b in combinations(range(rows.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: -gains[p])[:pairs]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(rounds // 3):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _quadrants(*sums(a, b, g, h), penalty)[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows outside the hold-out; features are made on the executors.

    Null labels and labels without a document are left out, null texts count as
    empty, and repeated rows count each, up to the bound.
    """
    chosen = chosen_labels(labels.filter(remainder(id_col, 4) != 2), "quality", id_col, max_rows)
    sample = texts_of(docs, chosen, id_col, text_col)
    vectors = append_columns(sample, "text", [T.StructField("x", T.BinaryType())], lambda texts: [[r.tobytes() for r in feature_rows(texts)]], ["_id", "y"])
    got = sorted(bounded(vectors, "_id", max_rows, "y", "x").collect(), key=lambda r: (r["_id"], r["x"], r["y"]))
    rows = np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, len(FEATURES))
    return fit(rows, np.array([float(r["y"] == 1) for r in got]))


def _scored(docs: DataFrame, model: AdditiveModel, text_col: str, names: list[str], score: str) -> DataFrame:
    return append_columns(docs, text_col, [T.StructField(score, T.DoubleType())], lambda texts: [model.score(feature_rows(texts))], names)


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row.

    A null text is scored as an empty one; null ids are scored and not held out;
    repeated rows get equal scores; an empty table gives an empty result; other
    columns are ignored.
    """
    found = _scored(docs, model, text_col, [id_col], "score")
    return found.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they are, whatever their columns are called."""
    name = "score"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return _scored(docs, model, text_col, docs.columns, name).filter(F.col(name) >= threshold).drop(name)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model)
