"""A content-addressed store of token ids.

A document's ids are cut into chunks where a rolling hash of the last ids says so, so equal
passages give equal chunks wherever they stand. Under the store's folder lie three tables:

  chunks     hash, width, ids: every distinct chunk once, under the BLAKE2b digest of its content
  recipes    id, start, n_tokens, hashes, root: how to put a document together again, in ascending
             id order; root is the Merkle root over the document's chunk hashes
  manifest   one row per range of recipes: first and last id, rows, ids, where it starts, Merkle root over the rows' roots; and one
             row, range -1, over all ranges, with the root over theirs

Only a chunk's first occurrence in a task carries its content through the one large shuffle, so a
passage that every document repeats is moved once per task. Reading verifies every hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import delete, only, running_total, small, spread
from millrace.llm.tokens import encoder

#: Ids the rolling hash looks at, and the bounds and the mean of a chunk's ids.
WINDOW, LEAST, MEAN, MOST = 8, 64, 256, 1024
DIGEST = 16
#: Ids hashed at once; a bound on memory.
AT_ONCE = 1 << 20
#: Pieces a worker remembers the ids of.
PIECES = 1_000_000
#: Hashes a task remembers as already sent; beyond it some content is sent again and dropped later.
SENT = 2_000_000

def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids ends in zero bits.

    ids may hold many documents one after the other: no chunk is cut within the first LEAST ids of a
    document, so a window that reaches back into the document before decides nothing.
    """
    found = [np.empty(0, np.int64)]
    for begin in range(0, len(ids), AT_ONCE):
        lead = min(begin, WINDOW - 1)
        mixed = (ids[begin - lead : begin + AT_ONCE].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolled = mixed.copy()
        for back in range(1, min(WINDOW, len(mixed))):
            rolled[back:] += mixed[:-back] << np.uint64(back)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        found.append(np.flatnonzero(rolled[lead:] >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + begin + 1)
    return np.concatenate(found)


def cut_points(found: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the document at [start, stop): marks, but within LEAST and MOST ids of each other."""
    ends, last = [], start
    for at in found:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            last = at
            ends.append(last)
    while stop - last > MOST:
        last += MOST
        ends.append(last)
    if last < stop:
        ends.append(stop)
    return ends


def address(width: int, raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST, salt=bytes([width])).digest()

def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; an odd one goes up as it is; no leaves give zeros."""
    level = leaves or [bytes(DIGEST)]
    while len(level) > 1:
        pairs = [hashlib.blake2b(level[i] + level[i + 1], digest_size=DIGEST, person=b"node").digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]

def parts(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + DIGEST] for i in range(0, len(hashes), DIGEST)]

def write_store(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs (null text: empty), append ``end_id`` to each, and write the store at ``path``.

    Repeated rows give a recipe each. An empty table gives a store with empty tables. Columns
    besides ``id_col`` and ``text_col`` are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, sent = encoder(tokenizer, PIECES), np.array([end_id], "<u4").tobytes(), set()
        for b in small(batches):
            row, hashes, lengths = [], [], []  # recipes
            new_hash, new_width, new_ids = [], [], []  # chunks
            raw = [x + tail for x in enc.encode(pc.fill_null(b.column(1), "").to_pylist())]
            stops = np.cumsum([len(x) // 4 for x in raw])
            ids = np.frombuffer(b"".join(raw), "<u4")
            at = marks(ids)
            # 16-bit ids where all of the batch fit, else 32-bit for chunks that need them.
            narrow, wide = ids.astype("<u2").tobytes(), ids.tobytes()
            all_fit = not len(ids) or int(ids.max()) < 1 << 16
            splits = np.searchsorted(at, stops, side="right")
            for i, (stop, first, then) in enumerate(zip(stops.tolist(), [0, *splits.tolist()], splits.tolist(), strict=False)):
                start = last = stop - len(raw[i]) // 4
                mine = []
                for end in cut_points(at[first:then].tolist(), start, stop):
                    width = 2 if all_fit or int(ids[last:end].max()) < 1 << 16 else 4
                    held = narrow[2 * last : 2 * end] if width == 2 else wide[4 * last : 4 * end]
                    key = address(width, held)
                    mine.append(key)
                    last = end
                    if key not in sent:
                        if len(sent) < SENT:
                            sent.add(key)
                        new_hash.append(key)
                        new_width.append(width)
                        new_ids.append(held)
                row.append(i)
                hashes.append(b"".join(mine))
                lengths.append(stop - start)
            k, n = len(new_hash), len(row)
            # A recipe goes wherever its hashes fall, a chunk to where its equals go.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.nulls(k, b.column(0).type), b.column(0).take(pa.array(row, pa.int32()))]),
                    pa.array([None] * k + lengths, pa.int64()),
                    pa.array(new_hash + hashes, pa.binary()),
                    pa.array(new_width + [None] * n, pa.int32()),
                    pa.array(new_ids + [None] * n, pa.binary()),
                    pa.array(["chunks"] * k + ["recipes"] * n),
                ],
                ["id", "n_tokens", "hashes", "width", "ids", "part"],
            )

    schema = f"id {kind}, n_tokens long, hashes binary, width int, ids binary, part string"
    # A chunk meets its equals; a recipe goes anywhere, so that equal documents do not pile up.
    cut = spread(only(docs, [id_col, text_col])).mapInArrow(chunked, schema)
    cut = cut.withColumn("salt", F.when(F.col("part") == "recipes", F.xxhash64("id", "n_tokens")).otherwise(F.lit(0).cast("long")))
    equal = Window.partitionBy("part", "hashes", "salt").orderBy("width")
    dealt = cut.repartition("part", "hashes", "salt").withColumn("nth", F.row_number().over(equal))
    dealt = dealt.filter((F.col("nth") == 1) | (F.col("part") == "recipes")).drop("salt", "nth")
    # Content is all distinct: a dictionary of it is of no use, and hard compression of little.
    packed = dealt.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("parquet.enable.dictionary", "false")
    packed.partitionBy("part").parquet(f"{path}/raw")

    for part in ("chunks", "recipes"):  # an empty table writes neither
        make_folder(spark, f"{path}/raw/part={part}")

    raw = spark.read.schema(schema).parquet(f"{path}/raw").filter(F.col("part") == "recipes")

    @F.pandas_udf("binary")
    def root(hashes: pd.Series) -> pd.Series:
        return hashes.map(lambda h: merkle(parts(h)))

    ordered = running_total(raw.select("id", "n_tokens", "hashes"), "id", "n_tokens", "start")
    keys = [F.col("id").asc_nulls_first(), F.col("start")]  # start tells rows of one id apart
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.select("id", "start", "n_tokens", "hashes", root("hashes").alias("root"), F.spark_partition_id().alias("range"))
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    delete(spark, f"{path}/raw/part=recipes")

    sealed(spark, ranges(recipes(spark, path, kind), kind)).write.parquet(f"{path}/manifest")

def ranges(rows: DataFrame, kind: str) -> DataFrame:
    """The manifest of a table of recipes: one row per range, with the Merkle root over its rows' roots."""

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, last, leaves, start, ids = None, None, None, [], 0, 0
        row = lambda: pd.DataFrame({"range": [at], "first": [first], "last": [last], "n": [len(leaves)], "start": [start], "ids": [ids], "root": [merkle(leaves)]})
        for b in batches:
            for r, i, leaf, begin, n in zip(b["range"], b["id"], b["root"], b["start"], b["n_tokens"], strict=True):
                if r != at:
                    if at is not None:
                        yield row()
                    at, first, leaves, start, ids = r, i, [], begin, 0
                last = i
                ids += n
                leaves.append(bytes(leaf))
        if at is not None:
            yield row()

    slim = rows.select("range", "id", "start", "n_tokens", "root").repartition("range").sortWithinPartitions("range", F.col("id").asc_nulls_first(), "start")
    return slim.mapInPandas(seal, f"range int, first {kind}, last {kind}, n long, start long, ids long, root binary")


def sealed(spark: SparkSession, found: DataFrame) -> DataFrame:
    """The ranges and a row over all of them: how many, how many ids, and the root over their roots. The driver gets one row per range."""
    rows = found.orderBy("range").collect()
    top = (-1, None, None, len(rows), 0, sum(r["ids"] for r in rows), merkle([bytes(r["root"]) for r in rows]))
    return spark.createDataFrame([*map(tuple, rows), top], found.schema).coalesce(1)

def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hashes binary, width int, ids binary").parquet(f"{path}/raw/part=chunks").withColumnRenamed("hashes", "hash")

def recipes(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    return spark.read.schema(f"id {kind}, start long, n_tokens long, hashes binary, root binary, range int").parquet(f"{path}/recipes")

# --- reading ---------------------------------------------------------------------------------

def crc_shift(n_bytes: int) -> list[int]:
    """The matrix over bits that a CRC-32 register passes through when n_bytes zero bytes follow."""
    square, out = [0xEDB88320, *(1 << i for i in range(31))], None  # one zero bit
    n = n_bytes * 8
    while n:
        if n & 1:
            out = square if out is None else [crc_times(square, c) for c in out]
        square = [crc_times(square, c) for c in square]
        n >>= 1
    return out or [1 << i for i in range(32)]

def crc_times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out

_shifts: dict[int, list[int]] = {}

def crc_join(a: int, b: int, b_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second's length."""
    if b_bytes not in _shifts:
        _shifts[b_bytes] = crc_shift(b_bytes)
    return crc_times(_shifts[b_bytes], a) ^ b

def read_digests(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Per document, from the store's files: id, start, n_tokens, ids_crc32 of all its ids, verified.

    Every chunk's content is read, hashed against its address and summed up; a recipe's sums are
    joined in its order. A chunk that is missing, or a hash or root that does not fit, raises; so do
    recipes that differ from the manifest in ranges, rows, ids or roots, before anything else is read. Rows with null
    or repeated ids are documents of their own.
    """
    if verify_manifest(spark, path, kind).limit(1).count():
        raise ValueError("the recipes do not fit the manifest")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, widths, held = (b.column(i).to_pylist() for i in range(3))
            for key, width, raw in zip(keys, widths, held, strict=True):
                if address(width, raw) != key:
                    raise ValueError(f"chunk {key.hex()} does not hold what its address says")
            # All chunks of a width are widened to 32 bits together.
            n = [len(raw) // width for raw, width in zip(held, widths, strict=True)]
            wide = {w: memoryview(np.frombuffer(b"".join([r for r, x in zip(held, widths, strict=True) if x == w]), f"<u{w}").astype("<u4").tobytes()) for w in set(widths)}
            at, crc = dict.fromkeys(wide, 0), []
            for width, k in zip(widths, n, strict=True):
                a = at[width]
                at[width] = a + 4 * k
                crc.append(zlib.crc32(wide[width][a : a + 4 * k]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["hash", "n", "crc"])

    sums = chunks(spark, path).mapInArrow(digest, "hash binary, n int, crc long")
    rows = recipes(spark, path, kind)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, seq, key = [], [], []
            for i, (hashes, root) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                mine = parts(hashes)
                if merkle(mine) != root:
                    raise ValueError("a recipe does not fit its Merkle root")
                row += [i] * len(mine)
                seq += range(len(mine))
                key += mine
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(seq, pa.int32()), pa.array(key, pa.binary())], ["start", "seq", "hash"])

    used = rows.select("start", "hashes", "root").mapInArrow(places, "start long, seq int, hash binary")
    # Only sums move here, no content. A hash that many documents use makes a large partition of
    # uses beside one row of sums, which adaptive execution splits.
    joined = used.join(sums, "hash", "left").select("start", "seq", "n", "crc")

    def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, crc = None, 0, 0
        for b in batches:
            start, count, value = [], [], []
            for s, n, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if n is None:
                    raise ValueError("a recipe names a chunk that the store does not have")
                if s != at:
                    if at is not None:
                        start.append(at)
                        count.append(total)
                        value.append(crc)
                    at, total, crc = s, 0, 0
                crc = crc_join(crc, c, n * 4) if total else c
                total += n
            yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(value, pa.int64())], ["start", "held", "ids_crc32"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total], pa.int64()), pa.array([crc], pa.int64())], ["start", "held", "ids_crc32"])

    # start is unique: every document holds its end id at least.
    whole = joined.repartition("start").sortWithinPartitions("start", "seq").mapInArrow(rejoin, "start long, held long, ids_crc32 long")
    fits = F.when(F.col("held") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error("a recipe's chunks do not add up").cast("long"))
    return rows.join(whole, "start").select("id", "start", fits.alias("n_tokens"), "ids_crc32")

def read_documents(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Per document its ids: id, start, ids array<long>, put together from the store's chunks.

    Rows with a null or repeated id are documents of their own, told apart by start. Of an empty store there are none. Hashes are
    not verified here: ``read_digests`` does that.
    """
    rows = recipes(spark, path, kind).select("id", "start", F.posexplode(F.expr(f"transform(sequence(0, length(hashes) div {DIGEST} - 1), i -> substring(hashes, i * {DIGEST} + 1, {DIGEST}))")).alias("seq", "hash"))

    @F.pandas_udf("array<long>")
    def ids(width: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(r, f"<u{w}").astype(np.int64) for w, r in zip(width, raw, strict=True)])

    held = rows.join(chunks(spark, path), "hash").select("id", "start", "seq", ids("width", "ids").alias("ids"))
    return held.groupBy("id", "start").agg(F.expr("flatten(transform(array_sort(collect_list(struct(seq, ids))), x -> x.ids))").alias("ids"))

def verify_manifest(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Ranges of the manifest that the recipes do not fit, or that are missing on either side, and range -1 if ranges are
    missing on both or do not begin where the ones before end: none if all is well.

    Rows with null or repeated ids count each. A store without a manifest raises.
    """
    found = ranges(recipes(spark, path, kind), kind)
    held = spark.read.schema(found.schema).parquet(f"{path}/manifest")
    made = sealed(spark, found)
    off = held.exceptAll(made).union(made.exceptAll(held))
    lower = F.sum("ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    gaps = made.filter("range >= 0").withColumn("lower", F.coalesce(lower, F.lit(0))).filter("start <> lower").drop("lower")
    return off.union(gaps)
