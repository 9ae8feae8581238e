"""Quality scores from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the
counts of vote patterns, of all texts, estimates how each labeller votes on good and on bad texts,
and so each pattern's probability of being good. On a bounded sample a linear model over hashed
token features is fitted to these posteriors; it scores every text. No human label is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only, sampled, small, spread, with_fields

#: Texts the linear model is fitted on at most, about, drawn by a hash of id and text.
SAMPLE = 8_000
BUCKETS = 1 << 16
ROUNDS, EPOCHS, BATCH, STEP, DECAY = 200, 20, 256, 0.5, 1e-6
MEMORY = 500_000
GOOD, BAD, NONE = 1, 0, 2

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
FUNCTION_WORDS = frozenset("""
    the of and to in a is that it for was on as with be by are this from at or an
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als
    de la le et les des en un du une que est pour dans par sur au plus pas
    el los las y del se por con para al lo su como
    il di che non per sono da o os do em um uma não het een van dat op
""".split())
END = re.compile(r"[.!?。！？]['\")\]]?$")
RUNS = re.compile(r"[^\w\s]{2,}")
REPEATED = re.compile(r"(.)\1+")

LABELLERS = ("symbols", "capitals", "distinct words", "word length", "line ends", "function words", "repeated lines", "length", "symbol runs")
#: A pattern of votes as one number: base 3, first labeller lowest.
POWERS = 3 ** np.arange(len(LABELLERS))


def votes(tokens: Tokens, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """One vote of each labeller for each text; a text without words gets bad from the one on length and no others."""
    n = np.array([len(x) for x in ids], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    rows = tokens.rows[np.concatenate([np.empty(0, np.int64), *ids])]
    chars, letters, alnum, capitals, known, runs = (np.bincount(text, rows[:, k], len(n)) for k in range(len(TOKEN_COLUMNS)))
    distinct = np.array([len(np.unique(tokens.word[x])) for x in ids])
    lines = [[x for x in map(str.strip, t.split("\n")) if x] for t in texts]
    ended = np.array([sum(END.search(x[-3:]) is not None for x in ls) / max(len(ls), 1) for ls in lines])
    fresh = np.array([len(set(ls)) / max(len(ls), 1) for ls in lines])
    several = np.array([len(ls) > 2 for ls in lines], bool)
    one = np.maximum(n, 1)
    symbol, capital, length = (chars - alnum) / np.maximum(chars, 1), capitals / np.maximum(letters, 1), chars / one
    variety = distinct / one**0.85  # long texts repeat more
    known, runs, enough = known / one, runs / one, n >= 20
    good_bad = [
        (symbol < 0.08, symbol > 0.15),
        (capital < 0.15, capital > 0.4),
        (enough & (variety > 0.5), enough & (variety < 0.25)),
        ((length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        (ended > 0.6, ended < 0.2),
        (enough & (known > 0.08), enough & (known < 0.02)),
        (several & (fresh > 0.95), fresh < 0.7),
        (n >= 60, n < 15),
        (runs < 0.01, runs > 0.1),
    ]
    cast = np.stack([np.where(good, GOOD, np.where(bad, BAD, NONE)) for good, bad in good_bad], axis=1)
    cast[n == 0] = [BAD if name == "length" else NONE for name in LABELLERS]
    return cast


def posterior(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern of votes, by EM; labellers vote independently given the class.

    It starts from the share of good among a pattern's votes, so class 1 is the one that labellers call good.
    """
    if not len(patterns):
        return np.empty(0)
    cast = (patterns != NONE).sum(axis=1)
    p = np.where(cast > 0, ((patterns == GOOD).sum(axis=1) + 0.5) / (cast + 1), 0.5)
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        chance = np.stack([[(weight * (patterns[:, j] == v)).sum(axis=1) + 1 for v in (BAD, GOOD, NONE)] for j in range(patterns.shape[1])])
        chance /= chance.sum(axis=1, keepdims=True)  # labeller, vote, class
        log = np.log(prior)[None, :] + np.log(chance[np.arange(patterns.shape[1])[None, :], patterns]).sum(axis=1)
        then = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done, p = np.abs(then - p).max() < 1e-9, then
        if done:
            break
    return p


#: What a token adds to its text's sums.
TOKEN_COLUMNS = ("chars", "letters", "alnum", "capitals", "function word", "symbol runs")


class Numbers(dict):
    """Tokens and their numbers; one not yet known gets the next number, and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = at = len(self)
        self.new.append(token)
        return at


class Tokens:
    """A worker's memory of tokens: what each adds to the sums, the hash of its word and the bucket of its shape."""

    def __init__(self):
        self.at, self.shapes = Numbers(), {}
        self.word, self.shape = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.rows = np.empty((0, len(TOKEN_COLUMNS)), np.float32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > MEMORY or self.at.new:  # an error left tokens unlearned
            self.__init__()
        number, out = self.at.__getitem__, []
        for t in texts:
            tokens = t.split()
            out.append(np.fromiter(map(number, tokens), np.int64, len(tokens)))
        new, self.at.new = self.at.new, []
        if new:
            self._learn(new)
        return out

    def _learn(self, new: list[str]) -> None:
        import xxhash

        words, shapes, odd = [], [], []
        size = np.fromiter(map(len, new), np.int64, len(new))
        for i, t in enumerate(new):
            if t.isalpha() and t.islower():
                words.append(t)
                shapes.append("aa" if len(t) > 1 else "a")
            elif t[-1] in ",.;:!?" and (body := t[:-1]).isalpha() and body.islower():
                words.append(body)
                shapes.append(("aa" if len(body) > 1 else "a") + t[-1])
            else:
                words.append(t.strip(".,;:!?()[]\"'").lower())
                shapes.append(REPEATED.sub(r"\1\1", t.translate(SHAPE)))
                odd.append(i)
        # Plain words, with or without a mark at their end, are all letters but for the mark.
        letters = np.minimum(size, np.fromiter(map(len, words), np.int64, len(new)))
        rows = np.stack([size, letters, letters, np.zeros_like(size), [w in FUNCTION_WORDS for w in words], np.zeros_like(size)], axis=1).astype(np.float32)
        for i in odd:
            t = new[i]
            alnum = sum(map(str.isalnum, t))
            rows[i, 1:4] = sum(map(str.isalpha, t)), alnum, sum(map(str.isupper, t))
            rows[i, 5] = 0 if alnum == len(t) else len(RUNS.findall(t))
        for s in set(shapes).difference(self.shapes):
            self.shapes[s] = xxhash.xxh64_intdigest(s, 2) % BUCKETS
        self.rows = np.concatenate([self.rows, rows])
        self.word = np.concatenate([self.word, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))])
        self.shape = np.concatenate([self.shape, np.fromiter(map(self.shapes.__getitem__, shapes), np.int64, len(shapes))])

    def buckets(self, ids: np.ndarray) -> np.ndarray:
        """Buckets of a text's tokens, of their shapes, and of neighbours: both shapes, and whether they are the same token."""
        shape = self.shape[ids]
        pair = (shape[:-1] * 31 + shape[1:] * 7 + (ids[:-1] == ids[1:]) * 12_289 + 3) % BUCKETS
        return np.concatenate([(self.word[ids] % np.uint64(BUCKETS)).astype(np.int64), shape, pair])


_tokens = Tokens()


def remembered() -> Tokens:
    """This worker's memory; workers are reused, and so is it: it depends on no model."""
    return _tokens


class _Shape(dict):
    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else x
        return self[c]


SHAPE = _Shape()


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def shares(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and the share of its features in each: no more numbers than BUCKETS, however long the text."""
    at, n = np.unique(buckets, return_counts=True)
    return at.astype("<u2"), (n / max(len(buckets), 1)).astype("<f4")


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> Model:
    """Logistic regression on the shares of buckets with soft targets, by AdaGrad."""
    rng = np.random.default_rng(11)
    w, b, sq, sq_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in (order[i : i + BATCH] for i in range(0, len(order), BATCH)):
            bucket = np.concatenate([rows[i][0] for i in at]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in at]).astype(float)
            of = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
            margin = np.bincount(of, w[bucket] * value, len(at)) + b
            off = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target[at]) / len(at)
            g = np.bincount(bucket, off[of] * value, BUCKETS) + DECAY * w
            sq += g * g
            w -= STEP * g / np.sqrt(sq)
            sq_b += off.sum() ** 2
            b -= STEP * off.sum() / np.sqrt(sq_b)
    return Model(w, float(b))


def quality(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, votes (one per labeller: 1 good, 0 bad, 2 none), posterior, score, predicted.

    posterior is the weak-label model's probability of good for the row's votes, score the linear
    model's (both 0 to 1), predicted 1 if score >= 0.5, else 0. A null text counts as empty. Rows that
    repeat stay; an empty table gives an empty table; other columns are ignored. The driver gets the
    counts of vote patterns, at most 3 to the number of labellers, and of each text of the sample its distinct buckets with their shares.
    """
    spark = docs.sparkSession
    texts = spread(only(docs, [id_col, text_col]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = remembered(), np.zeros(3 ** len(LABELLERS), np.int64)
        for b in small(batches, 0):
            held = pc.fill_null(b.column(0), "").to_pylist()
            seen += np.bincount(votes(tokens, held, tokens.ids(held)) @ POWERS, minlength=len(seen))
        pattern = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(seen[pattern])], ["pattern", "n"])

    seen = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    pattern, n = seen.column("pattern").to_numpy(), seen.column("n").to_numpy().astype(float)
    good = posterior(pattern[:, None] // POWERS % 3, n)
    of_pattern = np.full(3 ** len(LABELLERS), 0.5)
    of_pattern[pattern] = good

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = remembered()
        for b in small(batches):
            held = pc.fill_null(b.column(1), "").to_pylist()
            ids = tokens.ids(held)
            rows = [shares(tokens.buckets(i)) for i in ids]
            columns = [pa.array([x[k].tobytes() for x in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes(tokens, held, ids) @ POWERS), *columns], ["key", "pattern", "buckets", "shares"])

    picked = sampled(texts.toDF("id", "text"), sample, ["id", "text"]).select(F.xxhash64("id", "text").alias("key"), "text")
    got = picked.mapInArrow(measure, "key long, pattern long, buckets binary, shares binary").orderBy("key", "pattern").toArrow()
    rows = [(np.frombuffer(x, "<u2"), np.frombuffer(y, "<f4")) for x, y in zip(got.column("buckets").to_pylist(), got.column("shares").to_pylist(), strict=True)]
    shared = spark.sparkContext.broadcast((fit(rows, of_pattern[got.column("pattern").to_numpy()]), of_pattern))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, chances), tokens = shared.value, remembered()
        for b in small(batches):
            held = pc.fill_null(b.column(1), "").to_pylist()
            ids = tokens.ids(held)
            cast = votes(tokens, held, ids)
            margin = np.array([model.weights[x].mean() if len(x) else 0.0 for x in map(tokens.buckets, ids)]) + model.bias
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            columns = [b.column(0), pa.array(cast.tolist(), pa.list_(pa.int32())), pa.array(chances[cast @ POWERS]), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "votes", "posterior", "score", "predicted"])

    return texts.mapInArrow(rate, with_fields(docs, id_col, "votes array<int>, posterior double, score double, predicted int"))
