"""Language identification that labels spans of mixed-language text.

A language's model holds the log probabilities of hashed character 2- to 4-grams of its words, and
the scripts it is written in. The Unicode range of a word's letters narrows the candidates; each
candidate scores the word; Viterbi over the words, with a penalty for switching, labels every word. A
text's language is the one that most of its letters carry.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import only, sampled, small, spread, with_fields

#: Training texts at most, about; all languages together, drawn by a hash of the id.
SAMPLE = 6_000
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
#: What a switch of language costs, in nats.
SWITCH = 10.0
SMOOTH = 0.2
#: A script is a language's if it has this share of its letters.
SCRIPT_SHARE = 0.02
#: Words a worker remembers the scores of, and words that go through Viterbi together.
MEMORY, AT_ONCE = 250_000, 1_200_000
#: Rows, and bytes of them, that are held for one answer however few words they have; characters of words remembered, and learned together.
HELD_ROWS, HELD_BYTES, MEMORY_CHARS, LEARN_CHARS = 1 << 16, 32 << 20, 8 << 20, 1 << 20
UNKNOWN = "und"

# First code points of Unicode's ranges, up to the next one, and their scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Other"),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"),
    (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Han"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x1F000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
NAMES = sorted({s for _, s in SCRIPTS})
STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_AT = np.array([NAMES.index(s) for _, s in SCRIPTS])

WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """langs in order; table[bucket, lang] log probabilities; scripts[lang, script] whether a language uses it."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty words with an end mark on either side: each gram's word and bucket."""
    c = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    mark = c == 0
    word = np.cumsum(mark) - 1
    at_word, at_bucket, h = [], [], c * np.uint64(0x9E3779B97F4A7C15)
    ok = np.ones(len(c), bool)
    for n in range(2, max(ORDERS) + 1):
        # h[i]: over the n characters from i; ok[i]: marks only at either end.
        h = (h[:-1] ^ h[:-1] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
        ok = ok[:-1] & ~mark[n - 2 : -1] if n > 2 else ok[:-1]
        if n in ORDERS:
            keep = np.flatnonzero(ok)
            mixed = (h[keep] ^ h[keep] >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            at_word.append(word[keep])
            at_bucket.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(at_word), np.concatenate(at_bucket)


def scripts_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's script, by its first letter, and its number of letters."""
    first = np.array([ord(next(x for x in w if x.isalpha())) for w in words], np.int64)
    letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words], np.int64)
    return SCRIPT_AT[np.searchsorted(STARTS, first, side="right") - 1], letters


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def train(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``sample`` of the rows with text and language, drawn by a hash of all three; rows that repeat count once.

    The driver gets sums by language and bucket, not texts. Without any such row the model knows no
    language.
    """
    rows = only(docs, [id_col, text_col, lang_col]).toDF("id", "text", "lang").filter("text is not null and lang is not null")
    picked = sampled(rows, sample, ["id", "text", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in small(batches, 0):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in seen.items():
            if not words:
                continue
            times = np.array(list(words.values()), np.int64)
            word, bucket = grams(list(words))
            script, letters = scripts_of(list(words))
            n = np.bincount(bucket, times[word], BUCKETS)
            s = np.bincount(script, times * letters, len(NAMES))
            at, of = np.flatnonzero(n), np.flatnonzero(s)
            key, value = np.concatenate([at, -1 - of]), np.concatenate([n[at], s[of]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(value)], ["lang", "bucket", "n"])

    sums = picked.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    which = np.array([langs.index(x) for x in names], np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    table, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(langs), len(NAMES)))
    gram = bucket >= 0
    table[bucket[gram], which[gram]] = n[gram]
    scripts[which[~gram], -1 - bucket[~gram]] = n[~gram]
    used = scripts >= SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)
    table = np.log((table + SMOOTH) / (table.sum(axis=0) + SMOOTH * BUCKETS)) / len(ORDERS)
    return Model(langs, table.astype(np.float32), used & (scripts > 0))


class Scorer:
    """A worker's memory of words: their scores by language and their letters."""

    def __init__(self, model: Model):
        self.model, self.at, self.chars = model, {}, 0
        self.scores, self.letters = np.empty((0, len(model.langs)), np.float32), np.empty(0, np.int64)

    def learn(self, new: list[str]) -> None:
        part, chars = [], 0
        for w in new:  # few at a time: grams hold many numbers a character
            if part and chars + len(w) > LEARN_CHARS:
                self._learn(part)
                part, chars = [], 0
            part.append(w)
            chars += len(w)
        self._learn(part)

    def _learn(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        word, bucket = grams(new)
        total = np.zeros((len(new), len(self.model.langs)), np.float32)
        for k in range(len(self.model.langs)):
            total[:, k] = np.bincount(word, self.model.table[bucket, k], len(new))
        script, letters = scripts_of(new)
        can = self.model.scripts[:, script].T
        # The best is 0; a language of another script is worse than any switch; a script that none has says nothing.
        total -= np.where(can, total, -np.inf).max(axis=1, keepdims=True, initial=-1e9)
        total = np.where(can, total, -4 * SWITCH)
        total[~can.any(axis=1)] = 0
        self.at.update(zip(new, range(len(self.letters), len(self.letters) + len(new)), strict=True))
        self.scores, self.letters = np.concatenate([self.scores, total.astype(np.float32)]), np.concatenate([self.letters, letters])

    def full(self) -> bool:
        return len(self.at) > MEMORY or self.chars > MEMORY_CHARS

    def forget(self) -> None:
        if self.full():
            self.__init__(self.model)


def viterbi(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Labels of words: ``ids`` (rows of scores) of one text after the other, texts longest first.

    All texts go step by step together, so a step costs a few array operations.
    """
    starts = np.cumsum(lengths) - lengths
    step = np.arange(len(ids)) - np.repeat(starts, lengths)
    order = np.argsort(step, kind="stable")  # by step, then by text
    active = np.bincount(step) if len(ids) else np.empty(0, np.int64)
    edges = np.concatenate([[0], np.cumsum(active)])
    by_step, langs = ids[order], scores.shape[1]
    value = np.zeros((len(lengths), langs), np.float32)
    stayed, best = np.empty((len(ids), langs), bool), np.empty(len(ids), np.int16)
    for t, n in enumerate(active.tolist()):
        a, z = edges[t], edges[t + 1]
        v = value[:n]
        top = v.argmax(axis=1)
        left = v[np.arange(n), top][:, None] - switch
        best[a:z] = top
        np.greater_equal(v, left, out=stayed[a:z])
        np.maximum(v, left, out=v)
        v += scores[by_step[a:z]]
    labels, state = np.empty(len(ids), np.int16), value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a, z, n = edges[t], edges[t + 1], int(active[t])
        s = state[:n]
        labels[a:z] = s
        state[:n] = np.where(stayed[a:z][np.arange(n), s], s, best[a:z])
    out = np.empty(len(ids), np.int16)
    out[order] = labels
    return out


def identify(docs: DataFrame, model: Model, *, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, lang_pred, score, spans.

    score is the share of the letters that carry lang_pred (1 for a text in one language); spans
    lists (lang, first, last) by number of word. ``und`` with score 0 and no spans if the text is
    null or has no letter, and for every text if the model knows no language. Ties go to the
    language first in the alphabet. Rows that repeat stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = scorer.model.langs
        at_once = AT_ONCE // max(1, len(langs) // 4)  # Viterbi holds a byte per word and language

        def answer(columns: list[pa.Array], texts: list[np.ndarray]) -> pa.RecordBatch:
            n = np.array([len(x) for x in texts], np.int64)
            longest = np.argsort(-n, kind="stable")
            pred, share, spans = [UNKNOWN] * len(n), np.zeros(len(n)), [[] for _ in n]
            if langs and n.sum():
                ids = np.concatenate([texts[i] for i in longest])
                labels, weight, end = viterbi(scorer.scores, ids, n[longest], switch), scorer.letters[ids], 0
                for i in longest[: np.count_nonzero(n)].tolist():
                    begin, end = end, end + int(n[i])
                    mine = labels[begin:end]
                    letters = np.bincount(mine, weight[begin:end], len(langs))
                    k = int(letters.argmax())
                    pred[i], share[i] = langs[k], letters[k] / letters.sum()
                    cut = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(mine)]
                    spans[i] = [{"lang": langs[mine[a]], "first": a, "last": z - 1} for a, z in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(columns), pa.array(pred), pa.array(share), pa.array(spans, span)], [id_col, "lang_pred", "score", "spans"])

        columns, texts, held, size = [], [], 0, 0
        for b in small(batches):
            words = [words_of(t) for t in pc.fill_null(b.column(1), "").to_pylist()]
            if new := list(set().union(*words).difference(scorer.at)):
                scorer.learn(new)
            number = scorer.at.__getitem__
            texts += [np.fromiter(map(number, w), np.int64, len(w)) for w in words]
            columns.append(b.column(0))
            held += sum(map(len, words))
            size += b.nbytes
            if held >= at_once or len(texts) >= HELD_ROWS or size >= HELD_BYTES or scorer.full():
                yield answer(columns, texts)
                columns, texts, held, size = [], [], 0, 0
                scorer.forget()
        if columns:
            yield answer(columns, texts)

    return spread(only(docs, [id_col, text_col])).mapInArrow(label, with_fields(docs, id_col, "lang_pred string, score double, spans array<struct<lang: string, first: long, last: long>>"))
