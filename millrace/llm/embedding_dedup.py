"""Near-duplicate embeddings by spherical-cap filters.

A code is a random rotation and a structured product code: the rotated space is cut into two blocks (three for many vectors)
with SIZE unit vectors each, and a filter direction is one vector of every block, so a code has SIZE**blocks
directions but is decoded from short lists. A vector is list-decoded to all directions whose inner product with it
reaches the code's threshold, set so that a random vector has REACHED of them on average; one that has fewer than LIST, as vectors of
uneven blocks do, goes to its LIST best. Vectors that share a label and a filter meet and are verified in double
precision; a pair counts in the first filter it shares.

There are about as many directions as vectors, however many these are, so a filter holds few vectors that are not alike. How
often a pair at the threshold shares no filter of one code depends on dimension and size; it is measured on random pairs
(a rotation makes any pair a random one), and so many codes are made that all fail together for one in 1e8 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, only, salted_join, spread
from millrace.llm.components import connected_components
from millrace.llm.simhash import in_blocks, whole_blocks

#: Directions a random vector reaches on average in a code, and how many a vector goes to at least. Few reached and several at
#: least give the fewest filters for the same misses.
REACHED, LIST = 1, 4
#: The least SIZE, and the greatest with two blocks; three blocks have no greatest.
LEAST_SIZE, TWO_BLOCKS = 64, 4096
#: Pairs at the threshold missed, as a share, at most; random pairs it is measured on; fewest and most codes.
MISSED, TRIALS, CODES = 1e-8, 4_000, (4, 24)
#: Scores looked at in a block at first; where the threshold reaches further, twice as many.
LOOK = {2: 12, 3: 6}
#: Rows of one filter compared in one block; filters with more are cut into blocks that meet pairwise.
BLOCK = 2_048


def code_shape(rows: int) -> tuple[int, int]:
    """(blocks, SIZE) for so many rows: a power of two near their square root, or cube root where that is beyond TWO_BLOCKS."""
    bits = max(0, rows - 1).bit_length()
    if 1 << -(-bits // 2) <= TWO_BLOCKS:
        return 2, max(1 << bits // 2, LEAST_SIZE)
    return 3, 1 << -(-bits // 3)


@dataclass(frozen=True)
class Code:
    """A rotation (dimension padded to a multiple of the blocks), unit vectors by block, and the threshold."""

    rotation: np.ndarray
    blocks: tuple[np.ndarray, ...]
    threshold: float = np.inf

    def scores(self, vectors: np.ndarray) -> list[np.ndarray]:
        turned = np.pad(vectors, [(0, 0), (0, len(self.rotation) - vectors.shape[1])]) @ self.rotation
        width = self.blocks[0].shape[1]
        return [turned[:, i * width : (i + 1) * width] @ b.T for i, b in enumerate(self.blocks)]

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and directions: all directions that reach the threshold, and the LIST best of rows that reach fewer."""
        scores, size = self.scores(vectors), len(self.blocks[0])
        most = np.stack([s.max(axis=1) for s in scores], axis=1)
        # A direction that reaches it has a score of at least this in a block, whatever its others.
        need = self.threshold - (most.sum(axis=1, keepdims=True) - most)
        rows, look, out_row, out = np.arange(len(vectors)), LOOK[len(scores)], [], []
        while len(rows):
            k = min(look, size)
            best = [np.argpartition(-s[rows], k - 1, axis=1)[:, :k] for s in scores]
            top = [np.take_along_axis(s[rows], b, axis=1) for s, b in zip(scores, best, strict=True)]
            more = np.zeros(len(rows), bool)
            if k < size:
                more = np.any([t.min(axis=1) >= need[rows, i] for i, t in enumerate(top)], axis=0)
            sums, number = top[0], best[0]
            for t, b in zip(top[1:], best[1:], strict=True):
                sums = (sums[:, :, None] + t[:, None, :]).reshape(len(rows), -1)
                number = (number[:, :, None] * size + b[:, None, :]).reshape(len(rows), -1)
            take = sums >= self.threshold
            few = np.flatnonzero(take.sum(axis=1) < LIST)
            if len(few):
                n = min(LIST, sums.shape[1])
                at = np.argpartition(-sums[few], n - 1, axis=1)[:, :n]
                take[few[:, None], at] = True
            take[more] = False
            of, at = np.nonzero(take)
            out_row.append(rows[of])
            out.append(number[of, at])
            rows, look = rows[more], look * 2
        return np.concatenate(out_row), np.concatenate(out)


def make_code(dim: int, blocks: int, size: int, k: int) -> Code:
    rng, padded = np.random.default_rng([dim, size, blocks, k, 20]), -(-dim // blocks) * blocks
    rotation = np.linalg.qr(rng.normal(size=(padded, padded)))[0]
    parts = [rng.normal(size=(size, padded // blocks)) for _ in range(blocks)]
    code = Code(rotation, tuple(b / np.linalg.norm(b, axis=1, keepdims=True) for b in parts))
    # The threshold: random vectors reach REACHED directions on average.
    v = rng.normal(size=(500, dim))
    scores = code.scores(v / np.linalg.norm(v, axis=1, keepdims=True))
    n = min(LOOK[blocks], size)
    sums = -np.sort(-scores[0], axis=1)[:, :n]
    for s in scores[1:]:
        sums = (sums[:, :, None] - np.sort(-s, axis=1)[:, None, :n]).reshape(len(sums), -1)
    return Code(code.rotation, code.blocks, float(np.sort(sums.ravel())[-min(REACHED * len(sums), sums.size)]))


def missed(code: Code, dim: int, least: float) -> float:
    """The share of random pairs at cosine ``least`` that share no direction of the code."""
    rng = np.random.default_rng([dim, 21])
    a, z = rng.normal(size=(2, TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    met = []
    for v in (a, least * a + np.sqrt(max(0.0, 1 - least**2)) * z):
        row, at = code.decode(v)
        met.append(row << 48 | at)
    both = np.intersect1d(*map(np.unique, met), assume_unique=True) >> 48
    return 1 - len(np.unique(both)) / TRIALS


_codes: dict[tuple[int, int, int, float], list[Code]] = {}


def codes(dim: int, blocks: int, size: int, least: float) -> list[Code]:
    """As many codes as together miss a share of MISSED at most, and the same on every machine."""
    key = (dim, blocks, size, least)
    if key not in _codes:
        first = make_code(dim, blocks, size, 0)
        share = max(missed(first, dim, least), 2 / TRIALS)
        n = int(np.clip(np.ceil(np.log(MISSED) / np.log(min(share, 0.9))), *CODES))
        _codes[key] = [first, *(make_code(dim, blocks, size, k) for k in range(1, n))]
    return _codes[key]


def list_decode(vectors: np.ndarray, blocks: int, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Filters of unit vectors: where each one's begin (and the last end), and their numbers, increasing within a vector."""
    rows, out, n = [], [], size**blocks
    for k, code in enumerate(codes(vectors.shape[1], blocks, size, least)):
        row, direction = code.decode(vectors)
        rows.append(row)
        out.append(direction.astype(np.int64) + k * n)
    row, number = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((number, row))
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(vectors)))]), number[order]


def verify(lists: list[np.ndarray], at: int, vectors: np.ndarray, copies: np.ndarray, chunk: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that meet in filter ``at``: links of each (copies counted) that no earlier filter has, and a root of each.

    ``lists``: each row's filters. With ``chunk`` only rows of different chunks link here.
    """
    norms = np.linalg.norm(vectors, axis=1)
    linked = vectors @ vectors.T / (norms[:, None] * norms[None, :]) >= least
    np.fill_diagonal(linked, False)
    if chunk is not None:
        linked &= chunk[:, None] != chunk[None, :]
    near = np.flatnonzero(linked.any(axis=1))
    count, root = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
    if len(near):
        linked = linked[np.ix_(near, near)]
        earlier = [x[x < at] for x in (lists[i] for i in near.tolist())]
        names, column = np.unique(np.concatenate(earlier), return_inverse=True)
        has = np.zeros((len(near), len(names)), np.float32)
        has[np.repeat(np.arange(len(near)), [len(x) for x in earlier]), column] = 1
        linked &= has @ has.T == 0
        count[near] = linked @ copies[near]
        label = np.arange(len(near))
        while True:
            low = np.where(linked, label[None, :], len(near)).min(axis=1, initial=len(near))
            then = np.minimum(label, low)
            then = then[then]
            if (then == label).all():
                break
            label = then
        root[near] = near[label]
    return count, root


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors as doubles, each divided by a power of two, exactly: squares of very large or small components would leave the range."""
    v = raw.astype(np.float64)
    return v / np.exp2(np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True))))


def embedding_components(
    vectors: DataFrame, *, least: float = 0.98, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row of vectors: id, n_links, component_id, kept (id = component_id).

    Rows link if their labels are equal and not null and their cosine is at least ``least``. A null or
    zero vector, one with a null, infinite or NaN component, and one whose label is null links with nothing: 0 links, its
    own component. Vectors of different lengths do not link. Equal vectors (of equal 128-bit hashes) are compared once and
    counted as often as they occur, rows that repeat an id too. A row without an id links and bridges like any other, but is never a
    component's smallest unless all its ids are null. An empty table gives an empty table; other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    number, byte = ("float", "<f4") if kind == "float" else ("double", "<f8")
    rows = spread(only(vectors, [id_col, vector_col, label_col])).toDF("id", "v", "label").withColumn("v", F.col("v").cast(f"array<{number}>"))
    sound = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False))).withColumn("row", F.monotonically_increasing_id())
    made = materialise(rows.withColumn("same", F.when(F.col("ok"), F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(1), "v", "label").alias("b")))), "vectors")
    # A node is the first of the rows with equal vectors. From here on it is its number that moves, and its vector where it is looked at.
    equal = made.filter("ok").groupBy("same").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(equal, "nodes")
    blocks, size = code_shape(nodes.count())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            length = np.array([len(x) for x in lists]) if b.num_rows else np.empty(0, np.int64)
            flat, ends = lists.flatten().to_numpy(), np.cumsum(length)
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                raw = np.stack([flat[e - dim : e] for e in ends[at]])
                v = scaled(raw)
                starts, filters = list_decode(v / np.linalg.norm(v, axis=1, keepdims=True), blocks, size, least)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take),
                        b.column(2).take(take),
                        pa.array([x.tobytes() for x in raw.astype(byte)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(filters)),
                        b.column(3).take(take),
                    ],
                    ["node", "label", "raw", "filters", "copies"],
                )

    label = dict(rows.dtypes)["label"]
    firsts = made.select(F.col("row").alias("node"), "v", "label").join(nodes.select("node", "copies"), "node")
    decoded = firsts.mapInArrow(decode, f"node long, label {label}, raw binary, filters array<long>, copies long")
    decoded = materialise(decoded, "filters")
    met = decoded.select("node", F.xxhash64("label", F.length("raw")).alias("group"), F.explode("filters").alias("filter"))
    met = met.select("node", "filter", F.xxhash64("group", "filter").alias("key"))
    met = in_blocks(met, "key", "node", block, alone=False).select("key", "block", "node", "filter", "own", "cross")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block: its members, a digest of these, and where it is dealt: by its first member, or by itself if two chunks meet."""
        import xxhash

        for t in whole_blocks(batches):
            key, block_, node, filter_, own, cross = (c.to_numpy() for c in t.columns)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block_[1:] != block_[:-1])])
            out = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                met_chunks = bool(cross[a:z].any())
                if z - a > 1:
                    members = node[a:z].tobytes() + (own[a:z] if met_chunks else np.full(z - a, -1)).astype("<i8").tobytes()
                    digest = xxhash.xxh3_128_digest(members)
                    out.append((digest, int(filter_[a]), int.from_bytes(digest[:8], "little", signed=True) if met_chunks else int(node[a]), members))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["digest", "filter", "deal", "members"])

    groups = met.repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInArrow(grouped, "digest binary, filter long, deal long, members binary")
    # Vectors close to each other share many filters, and blocks of the same members need one look: that of the first filter,
    # since a pair counts in the first that it shares.
    groups = groups.groupBy("digest").agg(F.min(F.struct("filter", "deal", "members")).alias("first"))
    groups = materialise(groups.select("first.deal", "first.filter", "first.members"), "groups")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, "<i8").reshape(2, -1)[0] for x in b.column(1).to_pylist()]
            deal = np.repeat(b.column(0).to_numpy(), [len(h) for h in held])
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(np.concatenate([np.empty(0, np.int64), *held]))], ["deal", "node"])

    # A vector goes once to each place that looks at it, and groups of close vectors, which have the same first member, are at one place:
    # at most as many groups as that member has filters.
    needed = groups.select("deal", "members").mapInArrow(listed, "deal long, node long").distinct().join(decoded, "node")
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")
    sent = needed.select("deal", F.lit(0).alias("kind"), "node", "label", "raw", "filters", "copies", zero.alias("filter"), F.lit(None).cast("binary").alias("members"))
    asked = groups.select("deal", F.lit(1).alias("kind"), zero.alias("node"), F.lit(None).cast(label).alias("label"), F.lit(None).cast("binary").alias("raw"), none.alias("filters"), zero.alias("copies"), "filter", "members")
    places = sent.union(asked).repartition("deal").sortWithinPartitions("deal", "kind").select("deal", F.lit(0).alias("block"), "kind", "node", "label", "raw", "filters", "copies", "filter", "members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            deal, kind, node, copies, filter_ = (t.column(k).to_numpy() for k in ("deal", "kind", "node", "copies", "filter"))
            label, raw, asked_of = (t.column(k).to_pylist() for k in ("label", "raw", "members"))
            lists = t.column("filters").combine_chunks()
            ends, flat, found = lists.offsets.to_numpy(), lists.values.to_numpy(), []
            starts = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(deal)], strict=True):
                first = a + int(np.searchsorted(kind[a:z], 1))  # vectors come before groups
                by_node = a + np.argsort(node[a:first])
                for g in range(first, z):
                    members, chunk = np.frombuffer(asked_of[g], "<i8").reshape(2, -1)
                    at = by_node[np.searchsorted(node[by_node], members)]
                    # Members met by a hash: rows of another label or length that share it stay apart.
                    alike: dict[tuple, list[int]] = {}
                    for k, i in enumerate(at.tolist()):
                        alike.setdefault((label[i], len(raw[i])), []).append(k)
                    for mine in alike.values():
                        i = at[mine]
                        v = scaled(np.frombuffer(b"".join([raw[x] for x in i]), byte).reshape(len(i), -1))
                        count, root = verify([flat[ends[x] : ends[x + 1]] for x in i.tolist()], int(filter_[g]), v, copies[i], chunk[mine] if chunk[0] >= 0 else None, least)
                        linked = (count > 0) | (root != np.arange(len(i)))
                        found.append((node[i][linked], count[linked], node[i[root[linked]]]))
            columns = [np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "root"])

    links = materialise(places.mapInArrow(compare, "node long, n long, root long"), "links")
    discard(decoded, groups)
    found = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("n").alias("links"))
    labelled = nodes.join(counted, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labelled = salted_join(labelled, smallest, "component", ["node"])
    labelled = labelled.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("n"))
    joined = salted_join(made.filter("ok").select("same", "row", "id"), labelled, "same", ["row"]).select("id", "n_links", "component_id")
    alone = made.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )

