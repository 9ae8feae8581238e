"""Token counts with overlap resynchronisation for huge documents.

A document longer than a chunk is encoded in chunks that overlap, with offsets. Two neighbours
are spliced at a position of their overlap where both have a token boundary and which is proven
stable: an ASCII letter or digit before it, a space after it. No piece of the byte-level
pre-tokenizer crosses such a position (only a piece's first character can be a space unless the
whole piece is white space), its cut after the position depends on nothing before it, and no
special token holds white space; so the encoding of the whole is that of the left part and that
of the right part. Where an overlap has no such position it is doubled, up to the whole rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.common import only, small, spread, with_fields
from millrace.llm.tokens import Encoder, encoder

STABLE = re.compile(r"(?<=[A-Za-z0-9])(?= )")


def splice_point(text: str, start: int, stop: int, left: set[int], right: set[int]) -> int | None:
    """The first stable position in text[start:stop] that is a token boundary of both encodings."""
    for m in STABLE.finditer(text, start, stop):
        if start < m.start() < stop - 1 and m.start() in left and m.start() in right:
            return m.start()
    return None


def resync_count(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of text, by chunks of ``chunk`` characters that overlap by ``overlap`` or as far as needed."""

    def offsets(a: int, b: int) -> np.ndarray:
        e = enc.library.encode(text[a:b], add_special_tokens=False)
        return np.array([x for x, _ in e.offsets], dtype=np.int64) + a

    total, begin, at = 0, 0, 0  # at: where the tokens not yet counted begin
    here = offsets(0, min(len(text), chunk + overlap))
    while True:
        stop = begin + chunk
        if stop >= len(text):
            return total + int((here >= at).sum())
        width, point = overlap, None
        there = offsets(stop, min(len(text), stop + chunk + overlap))
        while point is None:
            end = min(len(text), stop + width)
            if width > overlap:  # both sides need the wider overlap
                here = offsets(at, end)
                there = offsets(stop, min(len(text), stop + max(chunk, width) + overlap))
            point = splice_point(text, stop, end, set(here.tolist()), set(there.tolist()))
            if point is None and end == len(text):
                return total + int((offsets(at, len(text)) >= at).sum())
            width *= 2
        total += int(((here >= at) & (here < point)).sum())
        here, begin, at = there, stop, point


def token_counts(
    docs: DataFrame, tokenizer: str, *, limit: int = 512, chunk: int = 16_384, overlap: int = 1_024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is a path that every executor has: a .json file of the tokenizers library or a
    .model file of sentencepiece. A null text counts as empty (0 bytes, 0 tokens). Rows with the
    same id are counted each. Documents beyond ``chunk`` characters are resynchronised if the
    tokenizer is a byte-level one, for which stable positions are proven; others are encoded whole.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            sizes = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            enc = encoder(tokenizer)

            def sizes(texts: list[str]) -> list[int]:
                huge = [enc.family == "byte" and len(t) > chunk for t in texts]
                small = iter(enc.encode([t for t, h in zip(texts, huge, strict=True) if not h]))
                return [resync_count(enc, t, chunk, overlap) if h else len(next(small)) // 4 for t, h in zip(texts, huge, strict=True)]

        for b in small(batches):
            texts = pc.fill_null(b.column(1), "")
            n = pa.array(sizes(texts.to_pylist()), pa.int64())
            n_bytes = pc.cast(pc.binary_length(pc.cast(texts, pa.binary())), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, n, pc.greater(n, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return spread(only(docs, [id_col, text_col])).mapInArrow(count, with_fields(docs, id_col, "n_bytes long, n_tokens long, over_limit boolean"))
