"""Toxicity: a subsequence-kernel support vector machine with Nyström landmarks.

Strings are the words of a text's sentences and, for scoring and as clean strings to
train on, each word joined with the next, so that one blank inside an insult hides
nothing; insults of several ordinary words stay out of reach.  Runs of single letters count as one
word and marks between letters are left out, so spelled-out insults stay whole.  The kernel of two strings sums, over
every three-letter subsequence they share, ``DECAY`` to the power of the spans that
its occurrences cover, for spans of at most five places, so letters may be left out
or inserted; it is divided by what strings of those lengths hold.  Nyström landmarks
turn it into features in which a squared-hinge support vector machine is trained.

Labels belong to documents, so training is over bags: a toxic document is held by
its highest-scoring string and others that score nearly as high, a clean one by all
of its own; the witness strings and the hardest clean strings are chosen anew in each
round.  A document's score is its
highest string score, calibrated by a logistic fit.  Witnesses are also trained on
with a letter inserted and with one left out.

The machine is linear in subsequence features, so its landmark expansion is summed
once into a weight for each subsequence.  Scoring a text of n letters then takes
eighteen look-ups a letter, over the whole text, whatever the number of landmarks.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.llm.common import append_columns
from corpuslake.llm.labelled import chosen_labels, held_out, remainder, texts_of, within

DECAY, ALPHABET = 0.7, 64
#: So near to its most telling string in log odds, a toxic document's other strings are witnesses too at the start.
AS_CLEAR = 0.3
#: Places of the second and third letter after the first.
GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Strings whose subsequences are laid out, and feature rows copied, at once: training's memory beside its features.
STRINGS, ROWS = 256, 4096
_FOLD: list[np.ndarray] = []
_MARKS: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """The class of each code point below 65,536: 0 white space, 1-26 a-z, then classes for all else."""
    if not _FOLD:
        points = np.arange(65536)
        table = (27 + points % (ALPHABET - 27)).astype(np.uint8)
        table[97:123] = np.arange(1, 27)
        table[65:91] = np.arange(1, 27)
        for cp in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029):
            table[cp] = 0
        _FOLD.append(table)
    return _FOLD[0]


def _marks() -> np.ndarray:
    """Whether each code point below 65,536 is punctuation or a symbol."""
    if not _MARKS:
        _MARKS.append(np.array([unicodedata.category(chr(cp))[0] in "PS" for cp in range(65536)]))
    return _MARKS[0]


def classes_of(text: str | None) -> np.ndarray:
    """Classes of a text's points, white space as 0; marks inside words and blanks between single letters are left out."""
    points = np.minimum(np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4"), 65535)
    mark = np.concatenate(([True], _marks()[points] | (_fold()[points] == 0), [True]))
    codes = _fold()[points[~((_fold()[points] > 0) & mark[1:-1] & ~mark[:-2] & ~mark[2:])]]
    blank = np.concatenate(([True, True], codes == 0, [True, True]))
    inner = blank[2:-2] & blank[:-4] & ~blank[1:-3] & ~blank[3:-1] & blank[4:]
    return codes[~inner]


def words_in(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words."""
    edge = np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def subsequences(codes: np.ndarray, length: np.ndarray):
    """For each gap pattern: places of first letters, subsequence numbers, weights.  ``length``: letters left in the word."""
    wide = codes.astype(np.int64)
    for a, b in GAPS:
        at = np.flatnonzero(length[: max(len(codes) - b, 0)] > b)
        yield at, (wide[at] * ALPHABET + wide[at + a]) * ALPHABET + wide[at + b], DECAY ** (b + 1)


def letters_left(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    left = np.zeros(len(codes), np.int64)
    word = np.repeat(np.arange(len(starts)), sizes)
    places = np.flatnonzero(codes > 0)
    left[places] = (starts + sizes)[word] - places
    return left


def norms(sizes: np.ndarray) -> np.ndarray:
    """Root of the squared weights that strings of these lengths hold; short strings count as five letters."""
    n = np.maximum(sizes, 5)
    return np.sqrt(sum((n - b) * DECAY ** (2 * (b + 1)) for _, b in GAPS))


@dataclass
class Machine:
    weights: np.ndarray  # of subsequences
    bias: float
    slope: float
    shift: float

    def word_scores(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, sizes = words_in(codes)
        if not len(starts):
            return starts, sizes, np.zeros(0)
        left, total = letters_left(codes, starts, sizes), np.zeros(len(codes))
        for at, which, weight in subsequences(codes, left):
            total[at] += weight * self.weights[which]
        return starts, sizes, np.add.reduceat(total, starts) / norms(sizes) + self.bias

    def joined_scores(self, codes: np.ndarray) -> np.ndarray:
        """Scores of each word joined with the next, without the blank between them."""
        starts, sizes = words_in(codes)
        if len(starts) < 2:
            return np.zeros(0)
        letters, first = codes[codes > 0], np.cumsum(sizes) - sizes
        total = np.zeros((2, len(letters)))
        ends = (np.repeat(first + sizes, sizes), np.repeat(np.append((first + sizes)[1:], len(letters)), sizes))
        for k, end in enumerate(ends):
            for at, which, weight in subsequences(letters, end - np.arange(len(letters))):
                total[k, at] += weight * self.weights[which]
        own, wide = np.add.reduceat(total, first, axis=1)
        return (wide[:-1] + own[1:]) / norms(sizes[:-1] + sizes[1:]) + self.bias

    def margin(self, text: str | None) -> float:
        codes = classes_of(text)
        scores = np.concatenate([self.word_scores(codes)[2], self.joined_scores(codes)])
        return float(scores.max()) if len(scores) else self.bias

    def probability(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -60, 60))))


def _sparse(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, subsequence and value of normalised feature entries, for words as class bytes."""
    codes, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    row, scale = np.repeat(np.arange(len(words)), sizes), 1 / norms(sizes)
    left = np.cumsum(sizes)[row] - np.arange(len(codes))
    found = [(row[at], which, weight * scale[row[at]]) for at, which, weight in subsequences(codes, left)]
    rows, which, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], which[order], value[order]


def _gram(words: list[bytes], columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks; ``columns``: the subsequences that landmarks have."""
    out = np.zeros((len(words), landmarks.shape[0]))
    for at in range(0, len(words), STRINGS):
        part = words[at : at + STRINGS]
        row, which, value = _sparse(part)
        place = np.searchsorted(columns, which)
        place[place == len(columns)] = 0
        known = columns[place] == which
        dense = np.zeros((len(part), len(columns)))
        np.add.at(dense, (row[known], place[known]), value[known])
        out[at : at + len(part)] = dense @ landmarks.T
    return out


def _svm(blocks: list[np.ndarray], y: np.ndarray, cost: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Squared-hinge machine by Newton steps on the rows inside the margin, of feature blocks that are never copied whole."""
    size = blocks[0].shape[1] + 1
    edges = np.cumsum([0, *map(len, blocks)]).tolist()
    parts = [(b[k : k + ROWS], slice(at + k, at + k + len(b[k : k + ROWS]))) for b, at in zip(blocks, edges, strict=False) for k in range(0, len(b), ROWS)]
    w = np.zeros(size)
    for _ in range(30):
        left, right = penalty * np.eye(size), np.zeros(size)
        for part, rows in parts:
            inside = y[rows] * (part @ w[:-1] + w[-1]) < 1
            x = np.column_stack([part[inside], np.ones(inside.sum())])
            a = x * cost[rows][inside, None]
            left += a.T @ x
            right += a.T @ y[rows][inside]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _altered(word: bytes, draw: np.random.Generator, shorter: int) -> bytes:
    """The string with one letter or mark inserted, or with one letter left out."""
    at = int(draw.integers(1, max(len(word), 2)))
    if shorter and len(word) > 4:
        return word[:at] + word[at + 1 :]
    return word[:at] + bytes([int(draw.integers(1, ALPHABET))]) + word[at:]


def fit(texts: list[str], y: np.ndarray, landmarks: int = 384, rounds: int = 4, negatives: int = 16, alterations: int = 8, shares: tuple[float, float, float] = (0.35, 0.25, 0.4)) -> Machine:
    """Train on documents and 0/1 labels; without both labels every score is the smoothed prior.

    ``shares`` are those of the cost of witnesses, of their ``alterations``, and of clean strings.
    """
    base = (float(y.sum()) + 1) / (len(y) + 2)
    flat = Machine(np.zeros(ALPHABET**3), 0.0, 0.0, float(np.log(base / (1 - base))))
    if len(y) == 0 or y.min() == y.max():
        return flat
    coded = [classes_of(t) for t in texts]
    bags: list[list[bytes]] = []
    one: dict[bytes, bytes] = {}  # equal strings of all documents are one object
    for codes in coded:
        starts, sizes = words_in(codes)
        own = dict.fromkeys(codes[s : s + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n >= 3)
        bags.append([one.setdefault(w, w) for w in own])
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    # a first guess at witnesses: strings with a beginning that toxic documents have more often
    often: dict[bytes, list[int]] = {}
    for k, bag in enumerate(bags):
        for stem in {w[:n] for w in bag for n in range(3, 9)}:
            often.setdefault(stem, [0, 0])[int(y[k])] += 1

    def odds(word):
        """Log odds of the most telling beginning, with the count of toxic documents taken at its lower end."""
        found = (often.get(word[:n], (0, 0)) for n in range(3, 9))
        return max(np.log((max(t - 1.5 * t**0.5, 0) + 0.1) / (len(toxic) + 1)) - np.log((c + 0.5) / (len(clean) + 1)) for c, t in found)

    witness = []
    for k in toxic:
        told = sorted(((odds(w), w) for w in bags[k]), reverse=True)
        witness += [w for o, w in told if o > told[0][0] - AS_CLEAR]
    spread = np.random.default_rng(0)
    drawn = [bags[k][int(j)] for k in clean if bags[k] for j in spread.integers(len(bags[k]), size=min(negatives, len(bags[k])))]
    del bags, one, often  # the rounds read the documents
    hard: list[bytes] = []
    count: dict[bytes, int] = {}
    for w in witness:
        count[w] = count.get(w, 0) + 1
    picks = sorted(count, key=lambda w: (-count[w], w))[: landmarks // 2] + sorted(set(drawn))[:: max(1, len(set(drawn)) // (landmarks // 2))][: landmarks // 2]
    picks = list(dict.fromkeys(picks))
    if not witness:  # toxic documents without a string that can be told
        return flat
    row, which, value = _sparse(picks)
    columns = np.unique(which)
    marks = np.zeros((len(picks), len(columns)))
    np.add.at(marks, (row, np.searchsorted(columns, which)), value)
    lam, vec = np.linalg.eigh(marks @ marks.T)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(lam, 1e-3))) @ vec.T
    features = lambda words: _gram(words, columns, marks) @ root
    machine, plain = flat, features(drawn)
    for _ in range(rounds):
        different = sorted(set(witness))
        altered = [_altered(word, spread, k % 2) for k in range(alterations) for word in different]
        good = features(different)[np.searchsorted(np.array(different, object), np.array(witness, object))]
        blocks = [good, features(altered), plain, features(hard)]
        target = np.concatenate([np.ones(len(witness) + len(altered)), -np.ones(len(drawn) + len(hard))])
        sizes = [len(witness), len(altered), len(drawn) + len(hard)]
        cost = np.concatenate([np.full(n, c * len(target) / max(n, 1)) for n, c in zip(sizes, shares, strict=True)])
        w = _svm(blocks, target, cost)
        del good, blocks
        weights = np.zeros(ALPHABET**3)
        weights[columns] = (root @ w[:-1]) @ marks
        machine = Machine(weights, float(w[-1]), 1.0, 0.0)
        witness, hard = [], sorted(set(hard))
        for k, codes in enumerate(coded):
            starts, sizes, scores = machine.word_scores(codes)
            if not len(starts):
                continue
            ranks = np.argsort(-scores, kind="stable")
            chosen = ranks[scores[ranks] >= 0.7 * scores[ranks[0]]] if y[k] and scores[ranks[0]] > 0 else ranks[:1]
            (witness if y[k] else hard).extend(codes[starts[j] : starts[j] + sizes[j]].tobytes() for j in chosen.tolist())
            if not y[k] and len(starts) > 1:
                j = int(machine.joined_scores(codes).argmax())
                pair = codes[starts[j] : starts[j + 1] + sizes[j + 1]]
                hard.append(pair[pair > 0].tobytes())
    margins = np.array([machine.margin(t) for t in texts])
    a, b = 1.0, 0.0
    for _ in range(100):  # a logistic fit, held back so that split data keep a finite slope
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        h = p * (1 - p) + 1e-6
        g = np.array([((p - y) * margins).sum() + 1e-2 * a, (p - y).sum()])
        m = np.array([[(h * margins**2).sum() + 1e-2, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return Machine(machine.weights, machine.bias, float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 2000, max_points: int = 1 << 26) -> Machine:
    """Fit on at most ``max_rows`` toxic and as many clean documents outside the hold-out, of ``max_points`` code points in all.

    Beyond ``max_points`` the longest texts of the sample are left out.  Null labels
    and labels without a document are left out; null, empty and blank texts are
    documents without strings; repeated rows count each, up to the bounds.
    """
    learnable = labels.filter(remainder(id_col, 5) != 0)
    chosen = [chosen_labels(learnable.filter(F.col("toxic") == k), "toxic", id_col, max_rows) for k in (0, 1)]
    sample = within(texts_of(docs, chosen[0].unionByName(chosen[1]), id_col, text_col), 2 * max_rows, max_points, "y")
    got = sorted(sample.collect(), key=lambda r: (r["_id"], r["y"], r["text"] or ""))
    return fit([r["text"] for r in got], np.array([float(r["y"]) for r in got]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row.

    Null and empty texts get the score of a text without strings; null ids are
    scored and not held out; repeated rows get equal scores; an empty table gives
    an empty result; other columns are ignored.
    """
    found = append_columns(docs, text_col, [T.StructField("score", T.DoubleType())], lambda texts: [[machine.probability(t) for t in texts]], [id_col])
    return found.select(id_col, held_out(id_col, 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
