"""Benchmark decontamination by winnowing.

Words become 64-bit hashes. Of every run of WINDOW - GRAM + 1 neighbouring word GRAM-grams the
last one with the smallest hash is selected, so any span of WINDOW words that a document shares with
a benchmark item has a selected gram at the same place in both. Selected grams of documents that pass a bitmap of fixed
size over the benchmark's grams join the benchmark's; a joined pair is extended to the windows
around it, compared by the hashes of all their words. Items of fewer than WINDOW words are one window each, and
documents are searched for every run of as many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from millrace.llm.common import materialise, only, small, spread, with_fields

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
#: Bits of the bitmap as a power of two: 2 MB where it is sent and where it is used, whatever the benchmark's size.
BITMAP = 24
#: Words a worker remembers the hash of.
MEMORY = 200_000
#: What separates words, as upper-case letters' lower-case forms and all other word bytes stay.
SEPARATE = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256)
)
MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * i + 3) ** 7 | 1) & (1 << 64) - 1 for i in range(WINDOW)]

HIT = "array<struct<key: long, base: int, len: int, w: array<long>>>"

_hashes: dict[bytes, int] = {}


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (never 0) of all words of the texts, one text after the other, and where each text begins."""
    import xxhash

    words = [t.translate(SEPARATE).split() for t in texts]
    new = list(set().union(*words).difference(_hashes))
    _hashes.update(zip(new, map(partial(xxhash.xxh64_intdigest, seed=7), new), strict=True))
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    out = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), np.uint64, int(starts[-1]))
    if len(_hashes) > MEMORY:
        for w in new:
            del _hashes[w]
    return out | np.uint64(1), starts


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n values, at its first."""
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        total += (h[i : len(h) - n + 1 + i] ^ h[i : len(h) - n + 1 + i] >> np.uint64(32)) * np.uint64(MULTIPLIERS[i])
    return mix(total)


def selected(grams: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions of the last smallest gram of each run of RUN grams that begins where ``inside`` is true."""
    n = len(grams) - RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for i in range(1, RUN):
        np.minimum(least, grams[i : n + i], out=least)
    at = np.zeros(n, np.int64)
    for i in range(RUN):
        at[grams[i : n + i] == least] = i
    return np.unique((at + np.arange(n))[inside[:n]])


def in_bitmap(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bit of each key's top bits is set in a bitmap of bytes."""
    at = (key >> np.uint64(64 - BITMAP)).astype(np.int64)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def prints(h: np.ndarray, starts: np.ndarray, short: list[int], bitmap: np.ndarray | None, whole_items: bool) -> list[tuple]:
    """Selected grams as (text, key, base, len, w): w holds the hashes of the windows around the gram.

    base is where the first of these windows begins; a window that is not inside the text has hash 0.
    ``short``: lengths of shorter windows to list besides. With ``whole_items`` a text of fewer than
    WINDOW words gives itself as its one window, and no other.
    """
    out, sizes = [], np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    passes = (lambda key: in_bitmap(bitmap, key)) if bitmap is not None else (lambda key: np.ones(len(key), bool))
    if len(h) >= WINDOW:
        inside = text[: len(h) - WINDOW + 1] == text[WINDOW - 1 :]
        grams, windows = runs(h, GRAM), runs(h, WINDOW) | np.uint64(1)
        windows[~inside] = 0
        at = selected(grams, inside)
        at = at[passes(grams[at])]
        first = at - RUN + 1
        around = first[:, None] + np.arange(RUN)
        held = np.where((around >= 0) & (around < len(windows)), windows[np.clip(around, 0, len(windows) - 1)], np.uint64(0))
        held[text[np.clip(around, 0, len(text) - 1)] != text[at][:, None]] = 0
        base = first - starts[text[at]]
        out += zip(text[at].tolist(), grams[at].view(np.int64).tolist(), base.tolist(), [WINDOW] * len(at), held.view(np.int64).tolist(), strict=True)
    for n in range(1, WINDOW) if whole_items else short:
        if len(h) < n:
            continue
        key = mix(runs(h, n) + np.uint64(n))
        ok = text[: len(h) - n + 1] == text[n - 1 :]
        if whole_items:
            ok &= sizes[text[: len(h) - n + 1]] == n
        at = np.flatnonzero(ok)
        at = at[passes(key[at])]
        k = key[at].view(np.int64).tolist()
        out += zip(text[at].tolist(), k, (at - starts[text[at]]).tolist(), [n] * len(at), ([x | 1] + [0] * (RUN - 1) for x in k), strict=True)
    return out


def winnowed(texts: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray | None = None, short: list[int] = [], whole_items: bool = False) -> DataFrame:  # noqa: B006
    """Per row of texts: row (unique), id, n_words, prints."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in small(batches):
            h, starts = word_hashes(pc.cast(pc.fill_null(b.column(1), ""), pa.binary()).to_pylist())
            found: list[list] = [[] for _ in range(b.num_rows)]
            for i, key, base, n, w in prints(h, starts, short, shared.value if shared else None, whole_items):
                found[i].append({"key": key, "base": base, "len": n, "w": w})
            kinds = pa.list_(pa.struct([("key", pa.int64()), ("base", pa.int32()), ("len", pa.int32()), ("w", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + b.num_rows)), b.column(0), pa.array(np.diff(starts)), pa.array(found, kinds)],
                ["row", id_col, "n_words", "prints"],
            )
            row += b.num_rows
        _hashes.clear()  # the worker goes on to other things

    return spread(only(texts, [id_col, text_col])).mapInArrow(go, StructType([StructField("row", LongType()), *with_fields(texts, id_col, f"n_words long, prints {HIT}").fields]))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each of the 2**BITMAP values that the keys' top bits take, in bytes. The driver gets at most 2**BITMAP / 64 pairs of numbers."""
    at = F.shiftrightunsigned("key", 64 - BITMAP)
    rows = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITMAP}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << BITMAP >> 6, np.int64)
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.astype("<i8").view(np.uint8)


def _covered() -> Column:
    """Words of one window that no earlier window of the row covers."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits (items_sha256 is then that of the empty
    string). Rows that repeat an id count each for itself; items that repeat an id count once; an
    item without an id marks words but is not listed. An empty benchmark contaminates nothing.
    """
    items = materialise(winnowed(benchmark, item_col, item_text_col, whole_items=True).select(F.col(item_col).cast("string").alias("item"), F.explode("prints").alias("p")).select("item", "p.*").distinct(), "items")
    short = sorted(r["len"] for r in items.filter(F.col("len") < WINDOW).select("len").distinct().collect())  # of nine lengths
    rows = materialise(winnowed(docs, id_col, text_col, _bitmap(items), short), "winnowed")
    hits = rows.select("row", F.explode("prints").alias("p")).select("row", "p.key", "p.base", "p.len", F.col("p.w").alias("dw"))
    met = hits.join(items.select("item", "key", "len", F.col("w").alias("iw")), ["key", "len"])
    same = F.expr(f"transform(filter(sequence(0, {RUN - 1}), i -> dw[i] <> 0 and dw[i] = iw[i]), i -> i + base)")
    windows = met.withColumn("start", F.explode(same)).select("row", "item", "start", (F.col("start") + F.col("len")).alias("end"))
    # Most of the windows of a shared passage come from one item: row, item and row, window are each made distinct before they meet.
    n_hit = windows.select("row", "start", "end").distinct().withColumn("new", _covered()).groupBy("row").agg(F.sum("new").alias("n_hit"))
    listed = windows.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    listing = F.coalesce("items", none)
    return (
        rows.select("row", id_col, "n_words")
        .join(n_hit, "row", "left")
        .join(listed, "row", "left")
        .select(
            id_col,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listing).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", listing), 256).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )
