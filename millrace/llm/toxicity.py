"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: hashed 4- to 6-grams of words (their ends marked, so whole short words and
stems are among them) that toxic texts hold far more often than others. Trees are fitted over rates
of a text: lexicon densities, lexicon words close to a second-person word, capitals, punctuation,
obfuscation. Isotonic regression calibrates their sums. Labelled rows are dealt to folds by a hash of
their text: a row's rates come from a lexicon, and its sum for the calibration from trees, of the
other folds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only, sampled, small, spread, with_fields

#: Labelled rows that training uses at most, about, drawn by a hash of the row.
SAMPLE = 12_000
FOLDS = 5
BUCKETS = 1 << 20
ORDERS = (4, 5, 6)
#: A gram is in the lexicon from this G statistic on, if its odds of toxicity are this many times the base's.
LEAST_G, LEAST_ODDS = 13.0, 8.0
ROUNDS, DEPTH, RATE, BINS, RIDGE = 60, 3, 0.2, 32, 1.0
#: Words between a lexicon word and a second-person word that count as close.
NEAR = 5
MEMORY = 200_000

# Second-person words of English, German, French, Spanish, Portuguese and Italian.
SECOND_PERSON = frozenset("""
    you your yours yourself yourselves u ur thou thee
    du dich dir dein deine deinen deiner deinem ihr euch euer eure sie ihnen
    tu te toi ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros vuestro vuestra os
    você vocês teu tua teus tuas seu sua
    tuo tuoi voi vostro vostra lei
""".split())
STRIP = "\"'`.,;:!?()[]{}<>*#%&$|~-_+=/\\…«»“”‘’¡¿"
REPEATED = re.compile(r"(.)\1\1")
MIXED = re.compile(r"[^\W\d_][\d@$!*|+]+[^\W\d_]|[\d@$][^\W\d_]{2,}|[^\W\d_]{2,}[@$*]+[^\W\d_]")

#: Sums over a text's tokens, in order; FEATURES are made of them.
TOKEN_COLUMNS = ("lexicon", "weight", "strong", "second", "capital", "letters", "all_caps", "punctuation", "exclaim", "mixed", "repeated", "single", "chars")
FEATURES = (
    "lexicon density", "lexicon words", "weight density", "strong density", "strong words", "close density", "second-person density",
    "capital rate", "all-caps rate", "punctuation rate", "exclamation rate", "mixed rate", "repeated rate", "single rate", "log tokens", "mean length",
)


@dataclass
class Model:
    """lexicon[bucket] weights; trees as (feature, threshold, leaf) arrays; margin to score by interpolation."""

    base: float = 0.0
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    strong: float = np.inf
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words with an end mark on either side: each 4- to 6-gram's word and bucket. Shorter words have none."""
    c = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mark = c == 0
    word = np.cumsum(mark) - 1
    before = np.concatenate([[0], np.cumsum(mark)])
    h = c * np.uint64(0x9E3779B97F4A7C15)
    at_word, at_bucket = [], []
    for n in range(2, max(ORDERS) + 1):
        if n > len(c):
            break
        h = (h[:-1] ^ h[:-1] >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
        if n in ORDERS:
            inner = before[n - 1 : len(c)] - before[1 : len(c) - n + 2]  # marks among the inner characters
            keep = np.flatnonzero(inner == 0)
            mixed = (h[keep] ^ h[keep] >> np.uint64(30)) * np.uint64(0x94D049BB133111EB + 2 * n)
            at_word.append(word[keep])
            at_bucket.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *at_word]), np.concatenate([empty, *at_bucket])


def core(token: str) -> str:
    return token.strip(STRIP).lower()


class Tokens:
    """A worker's memory of tokens and of what each adds to a text's sums."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.empty((0, len(TOKEN_COLUMNS)), np.float32)

    def learn(self, new: list[str]) -> None:
        cores = [core(t) for t in new]
        word, bucket = grams(cores)
        weight = np.zeros(len(new), np.float32)
        np.maximum.at(weight, word, self.model.lexicon[bucket])
        rows = np.empty((len(new), len(TOKEN_COLUMNS)), np.float32)
        for i, (t, w) in enumerate(zip(new, cores, strict=True)):
            letters = len(t) if t.isalpha() else sum(map(str.isalpha, t))
            capital = 0 if t.islower() else sum(map(str.isupper, t))
            n = len(t)
            alnum = letters if letters == n else sum(map(str.isalnum, t))
            rows[i] = (
                0, 0, 0, w in SECOND_PERSON, capital, letters, capital == letters > 1, n - alnum, t.count("!"),
                letters < len(w) and MIXED.search(w) is not None, REPEATED.search(w) is not None, letters == 1 and len(w) == 1, n,
            )
        rows[:, 0], rows[:, 1], rows[:, 2] = weight > 0, weight, weight >= self.model.strong
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, rows])

    def features(self, texts: list[str]) -> np.ndarray:
        """One row of FEATURES for each text."""
        if len(self.at) > MEMORY:
            self.__init__(self.model)
        tokens = [t.split() for t in texts]
        if new := list(set().union(*tokens).difference(self.at)):
            self.learn(new)
        number = self.at.__getitem__
        n = np.array([len(x) for x in tokens], np.int64)
        ids = np.fromiter((k for x in tokens for k in map(number, x)), np.int64, int(n.sum()))
        rows, text = self.rows[ids], np.repeat(np.arange(len(n)), n)
        sums = np.stack([np.bincount(text, rows[:, k], len(n)) for k in range(len(TOKEN_COLUMNS))], axis=1)
        lexicon, weight, strong, second, capital, letters, caps, punctuation, exclaim, mixed, repeated, single, chars = sums.T
        # Lexicon words with a second-person word of the same text within NEAR tokens.
        you, bad = np.flatnonzero(rows[:, 3]), np.flatnonzero(rows[:, 0])
        close = np.zeros(len(n))
        if len(you) and len(bad):
            after, near = np.searchsorted(you, bad), np.zeros(len(bad), bool)
            for side in (np.minimum(after, len(you) - 1), np.maximum(after - 1, 0)):
                near |= (np.abs(you[side] - bad) <= NEAR) & (text[you[side]] == text[bad])
            close = np.bincount(text[bad], near, len(n))
        words, chars, letters = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(letters, 1)
        return np.stack(
            [
                lexicon / words, lexicon, weight / words, strong / words, strong, close / words, second / words, capital / letters, caps / words,
                punctuation / chars, exclaim / chars, mixed / words, repeated / words, single / words, np.log1p(n), np.where(n > 0, chars / words, 0),
            ], axis=1,
        )


# --- trees and calibration -------------------------------------------------------------------


def margins(trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, base: float) -> np.ndarray:
    out, rows = np.full(len(x), base), np.arange(len(x))
    for feature, threshold, leaf in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        out += leaf[at - (1 << DEPTH) + 1]
    return out


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Trees of full DEPTH for the logistic loss, on histograms of at most BINS quantile bins."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    # Split values lie half-way between neighbouring values of a feature.
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) < BINS else np.unique(np.concatenate([middle[:2], np.quantile(middle, np.linspace(0, 1, BINS - 2))])))
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin, trees, inner = np.full(len(y), base), [], (1 << DEPTH) - 1
    for _ in range(ROUNDS):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first = (1 << depth) - 1
            for node in range(first, 2 * first + 1):
                mine = np.flatnonzero(at == node)
                best = 1e-6
                for k, c in enumerate(cuts):
                    if not len(c) or len(mine) < 2:
                        continue
                    bins = binned[mine, k]
                    left_g = np.cumsum(np.bincount(bins, g[mine], len(c) + 1))
                    left_h = np.cumsum(np.bincount(bins, h[mine], len(c) + 1))
                    all_g, all_h = left_g[-1], left_h[-1]
                    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
                    j = int(gain[:-1].argmax())
                    if gain[j] > best:
                        best, feature[node], threshold[node] = gain[j], k, c[j]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf_of = at - inner
        leaf = RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + RIDGE)
        trees.append((feature, threshold, leaf))
        margin += leaf[leaf_of]
    return base, trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function closest to y: the pooled blocks' mean margins and means."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, of y, rows
    values, inverse = np.unique(margin[order], return_inverse=True)
    ones, rows = np.bincount(inverse, y[order]), np.bincount(inverse)
    for v, s, n in zip(values, ones, rows, strict=True):
        blocks.append([v * n, s, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


# --- training and scoring --------------------------------------------------------------------


def lexicon(n0: np.ndarray, n1: np.ndarray, all0: float, all1: float) -> np.ndarray:
    """Log odds of grams that n0 of all0 texts and n1 of all1 toxic texts hold; 0 for those not in the lexicon."""
    if not all0 or not all1:
        return np.zeros(len(n0))
    odds = np.log((n1 + 0.5) / (all1 + 1)) - np.log((n0 + 0.5) / (all0 + 1))
    rate = np.maximum(n0 + n1, 1e-9) / (all0 + all1)
    g = 2 * (n1 * np.log(np.maximum(n1, 1e-9) / (all1 * rate)) + n0 * np.log(np.maximum(n0, 1e-9) / (all0 * rate)))
    return np.where((g >= LEAST_G) & (odds >= np.log(LEAST_ODDS)), odds, 0)


def train(labelled: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on about ``sample`` rows with a text and a label of 0 or 1, drawn by a hash of id, text and label; rows that repeat count once.

    The driver gets sums by gram and one row of numbers per row of the sample. If either class is
    missing, every score is the share of label 1 (0 without rows).
    """
    context = labelled.sparkSession.sparkContext
    rows = only(labelled, [id_col, text_col, label_col]).toDF("id", "text", "y").filter("text is not null and y in (0, 1)")
    # Rows of one text are in one fold, so that no lexicon has seen another copy of the text it is tried on.
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = sampled(rows, sample, ["id", "text", "y"]).select("id", fold.alias("fold"), "text", F.col("y").cast("int").alias("y"))
    rows = rows.repartition(context.defaultParallelism * 2).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((FOLDS, 2, BUCKETS + 1), np.int32)  # the last counts texts
        for b in small(batches, 2):
            for fold, text, y in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                bucket = grams(list({core(t) for t in text.split()}))[1]
                n[fold, y, np.unique(bucket)] += 1
                n[fold, y, -1] += 1
        at = np.flatnonzero(n.any(axis=(0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(n[k, y, at].astype(np.int64)) for k in range(FOLDS) for y in (0, 1))], names)

    names = ["bucket", *(f"n{y}_{k}" for k in range(FOLDS) for y in (0, 1))]
    seen = rows.mapInArrow(count, ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names[1:]])
    toxic = sum(F.col(f"n1_{k}") for k in range(FOLDS))
    sums = seen.filter((toxic > 1) | (F.col("bucket") == BUCKETS)).toArrow()
    bucket = sums.column("bucket").to_numpy()
    n = np.array([[sums.column(f"n{y}_{k}").to_numpy() for y in (0, 1)] for k in range(FOLDS)])
    texts, gram = n[:, :, bucket == BUCKETS].sum(axis=2), bucket < BUCKETS
    model = Model()
    if not texts.sum(axis=0).all():
        ones = texts.sum(axis=0)
        model.knots = (np.zeros(1), np.array([ones[1] / ones.sum() if ones.sum() else 0.0]))
        rows.unpersist()
        return model

    def of(folds: list[int]) -> Model:
        made, counts, total = Model(), n[folds].sum(axis=0), texts[folds].sum(axis=0)
        weight = lexicon(counts[0, gram], counts[1, gram], *total)
        made.lexicon[bucket[gram]] = weight
        made.strong = float(np.median(weight[weight > 0])) if weight.any() else np.inf
        return made

    model = of(list(range(FOLDS)))
    # A row is measured with a lexicon that has not seen it.
    shared = context.broadcast([of([k for k in range(FOLDS) if k != out]) for out in range(FOLDS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [Tokens(m) for m in shared.value]
        for b in small(batches, 2):
            fold = b.column(1).to_numpy()
            for k in np.unique(fold):
                mine = b.filter(pa.array(fold == k))
                x = tokens[k].features(mine.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([mine.column(1), mine.column(3), pa.array(x.tolist(), pa.list_(pa.float64())), mine.column(0)], ["fold", "y", "x", "id"])

    # In order, so that equal data give equal trees.
    kind = dict(rows.dtypes)["id"]
    got = rows.mapInArrow(measure, f"fold int, y int, x array<double>, id {kind}").orderBy("id", "y", "x").toArrow()
    rows.unpersist()
    fold, y = got.column("fold").to_numpy(), got.column("y").to_numpy().astype(float)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    # Calibration sees margins of trees that have not seen the row.
    margin = np.zeros(len(y))
    for k in np.unique(fold):
        base, trees = boost(x[fold != k], y[fold != k])
        margin[fold == k] = margins(trees, x[fold == k], base)
    model.base, model.trees = boost(x, y)
    model.knots = isotonic(margin, y)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Whole texts are read. A null text counts as empty, whose features are all 0. Rows that repeat
    stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tokens = Tokens(m)
        for b in small(batches):
            x = tokens.features(pc.fill_null(b.column(1), "").to_pylist())
            p = np.interp(margins(m.trees, x, m.base), *m.knots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return spread(only(docs, [id_col, text_col])).mapInArrow(rate, with_fields(docs, id_col, "score double, predicted int"))
