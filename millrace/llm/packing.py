"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Documents are encoded and cut into pieces no longer than a sequence. Pieces are dealt to groups
of a bounded size by a hash of the row, whatever ids repeat; each group is packed by itself, largest piece first: a piece goes
where the sum, over residual gaps, of the squared number of open bins with that gap becomes
smallest. Groups keep every task bounded; what a group wastes is a few part-filled bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import materialise, only, small, spread, with_fields
from millrace.llm.tokens import encoder

#: Pieces packed together by one task.
GROUP = 100_000


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document's ids (its end id included): id, piece, start, length, ids_crc32."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, step = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), capacity * 4
        for b in small(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(enc.encode(pc.fill_null(b.column(1), "").to_pylist())):
                raw += tail
                for k, a in enumerate(range(0, len(raw), step)):
                    part = raw[a : a + step]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"])

    return spread(only(docs, [id_col, text_col])).mapInArrow(cut, with_fields(docs, id_col, "piece int, start long, length long, ids_crc32 long"))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For sizes in the order to place them: each one's bin and offset."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full bin (gap 0) counts nothing
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, a in enumerate(sizes.tolist()):
        # Moving a bin from gap g to g - a changes the sum by 2 (count[g - a] - count[g] + 1), or less by 1 if it fills.
        change = count[: capacity + 1 - a] - count[a:]
        change[0] = -count[a]
        change *= 2
        change[1:] += 2
        change[0] += 1
        change[count[a:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) + a
        fresh = 2 * int(count[capacity - a]) + 1 if a < capacity else 0
        if count[best] and change[best - a] <= fresh:
            b, gap = open_bins[best].pop(), best
            count[best] -= 1
        else:
            b, gap = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > a:
            count[gap - a] += 1
            open_bins[gap - a].append(b)
    return bins, offsets


def pack(cut: DataFrame, *, capacity: int = 4096, group: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to a table of pieces (as ``pieces`` returns it, written down, so that it has its rows in one order).

    Every piece keeps its row; repeated rows are packed as often as they occur. Sequence ids are
    the group's number times 2**32 plus the bin's number. An empty table gives an empty table.
    """
    groups = max(1, -(-cut.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["__group"].to_numpy(np.int64) << 32) + bins, offset=offsets).drop(columns="__group")

    schema = StructType([*cut.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("__group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` ids, one row per piece.

    A document is its ids and then ``end_id``, so a null or empty text is one id. Columns other
    than ``id_col`` and ``text_col`` are ignored, whatever they are called.
    """
    cut = materialise(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack(cut, capacity=capacity, group=group, id_col=id_col)
