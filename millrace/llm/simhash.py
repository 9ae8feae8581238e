"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into two halves of 32 bits, and a half into a segment of 23 bits and a
rest of 9. Of at most 3 differing bits one half has at most 1, so in that half either the segment
is equal, or it differs in one bit and the rest is equal. The perfect Golay code (23, 12, 7) maps
every 23-bit word to the one codeword within 3 bits, of 12-bit index. A segment of odd parity gives
its own index, one of even parity also those of the 23 words one bit away: two segments one bit
apart have different parities, so they share an index; 6 indices are the most one gives. Keys are
(half, index, rest) and (half, segment); rows that share a key are compared, and links verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.llm.common import discard, materialise, only, salted_join, small, spread, with_fields
from millrace.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows of one key compared in one block; keys with more are cut into blocks that meet pairwise.
BLOCK = 4_096
#: Generator polynomial of the Golay code.
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """The error pattern of each syndrome, and syndromes of the three bytes of a word."""
    rest = [_remainder(1 << i) for i in range(23)]
    errors = np.zeros(2048, np.int64)
    for a in range(-1, 23):
        for b in range(a if a < 0 else a + 1, 23):
            for c in range(b if b < 0 else b + 1, 23):
                bits = {x for x in (a, b, c) if x >= 0}
                syndrome = 0
                for x in bits:
                    syndrome ^= rest[x]
                errors[syndrome] = sum(1 << x for x in bits)
    by_byte = []
    for low in (0, 8, 16):
        column = np.zeros(256, np.int64)
        for value in range(256):
            for i in range(min(8, 23 - low)):
                if value >> i & 1:
                    column[value] ^= rest[low + i]
        by_byte.append(column)
    return errors, by_byte


ERRORS, SYNDROMES = _golay()


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndrome = SYNDROMES[0][words & 255] ^ SYNDROMES[1][words >> 8 & 255] ^ SYNDROMES[2][words >> 16]
    return (words ^ ERRORS[syndrome]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned 64-bit fingerprints: row numbers and keys, without repeats in a row."""
    rows, out = [], []
    n = np.arange(len(prints))
    for half in (0, 1):
        bits = (prints >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        segment, rest = bits >> 9, bits & 511
        indices = np.repeat(golay_index(segment)[:, None], 24, axis=1)
        even = np.flatnonzero(np.bitwise_count(segment) % 2 == 0)
        for i in range(23):
            indices[even, i + 1] = golay_index(segment[even] ^ (1 << i))
        indices.sort(axis=1)
        first = np.ones(indices.shape, bool)
        first[:, 1:] = indices[:, 1:] != indices[:, :-1]
        at, column = np.nonzero(first)
        rows += [at, n]
        out += [(2 * half << 56) + (indices[at, column] << 9) + rest[at], (2 * half + 1 << 56) + segment]
    return np.concatenate(rows), np.concatenate(out)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; of the whole if it has fewer words; none of no words."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), joined), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are those set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # 255 bits summed in a byte, eight bytes in one addition
        bits = np.unpackbits(hashes[at : at + 255, None].view(np.uint8), axis=1, bitorder="little")
        ones += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(words: list[bytes], shingle: int) -> int:
    """SimHash of a text's words: bit set if set in over half the XXH64 of its shingles, repeats included."""
    return majority(shingle_hashes(words, shingle))


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and print (the fingerprint as a signed long). Null and blank texts give 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = pc.cast(pc.fill_null(b.column(1), ""), pa.binary()).to_pylist()
            out = np.array([fingerprint(t.translate(LOWER).split(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], [id_col, "print"])

    return spread(only(docs, [id_col, text_col])).mapInArrow(hashed, with_fields(docs, id_col, "print long"))


def in_blocks(keyed: DataFrame, key: str, member: str, block: int, alone: bool = True) -> DataFrame:
    """Add block, own, cross: rows of a key with more than ``block`` rows go to several blocks, so any two meet.

    own is a row's chunk of its key. Rows of different chunks meet in one block, whose cross is
    true; rows of one chunk meet in the one block whose cross is false, and also where it is true.
    Without ``alone`` rows that are the only ones of their key are left out.
    """
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("n") > (block if alone else 1)).withColumn("__c", F.ceil(F.col("n") / F.lit(block)).cast("long"))
    dealt = salted_join(keyed, counts, key, [member], how="left" if alone else "inner").withColumn("__c", F.coalesce("__c", F.lit(1).cast("long")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.col(member)), F.col("__c")))
    dealt = dealt.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)))
    meet = F.least("__j", "own") * F.col("__c") + F.greatest("__j", "own")
    return dealt.withColumn("block", meet).withColumn("cross", F.col("__j") != F.col("own")).drop("__c", "__j")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, key and block: the same rows, no block cut in two."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        key, block = (b.column(i).to_numpy() for i in (0, 1))
        # The last block may go on in the next batch.
        whole = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        if not len(whole) and len(held) > 1 and (held[0].column(0)[-1] == b.column(0)[0] and held[0].column(1)[-1] == b.column(1)[0]):
            continue
        table = pa.Table.from_batches(held)
        cut = table.num_rows - b.num_rows + (int(whole[-1]) + 1 if len(whole) else 0)
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def bounded_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """As ``whole_blocks``, with False; but a block of more than ``most`` rows comes in parts, with True: no more are held."""
    held: list[pa.RecordBatch] = []
    over = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b])
        held = []
        if over is not None:
            goes_on = (t.column(0).to_numpy() == over[0]) & (t.column(1).to_numpy() == over[1])
            n = t.num_rows if goes_on.all() else int(goes_on.argmin())
            if n:
                yield t.slice(0, n), True
            t = t.slice(n)
            if not t.num_rows:
                continue
            over = None
        key, block = t.column(0).to_numpy(), t.column(1).to_numpy()
        whole = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield t.slice(0, cut), False
        if t.num_rows - cut > most:
            over = (key[-1], block[-1])
            yield t.slice(cut), True
        else:
            held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held), False


def neighbours(key: np.ndarray, block: np.ndarray, finished: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For lag 1, 2, ...: the rows whose lag-th next row is in the same block, until there is none.

    ``finished`` is asked after lags 1, 2, 4, ... which of the blocks that begin at these rows need no more; they are left out then.
    """
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    starts, number = np.flatnonzero(new), np.cumsum(new) - 1
    at, lag = np.arange(len(key)), 1
    while len(at := at[at + lag < len(key)]) and len(at := at[number[at] == number[at + lag]]):
        yield lag, at
        if finished is not None and not lag & (lag - 1):
            at = at[~finished(starts)[number[at]]]
        lag += 1


def spanning_links(
    key: np.ndarray, block: np.ndarray, node: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], part: np.ndarray | None = None
) -> pa.RecordBatch:
    """Links a, b that span what ``near`` links within blocks; it is asked only for rows not yet together, as those of one ``part`` are at once."""
    parent = np.arange(len(node))
    if part is not None and len(node):
        _, first, of = np.unique(np.stack([key, block, part]), axis=1, return_index=True, return_inverse=True)
        parent = first[of.ravel()]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def united(starts: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(parent, starts) == np.maximum.reduceat(parent, starts)

    for lag, rows in neighbours(key, block, united):
        apart = rows[parent[rows] != parent[rows + lag]]
        found = apart[near(apart, apart + lag)]
        for i in found.tolist():
            a, b = root(i), root(i + lag)
            if a != b:
                a, b = (a, b) if node[a] < node[b] else (b, a)
                parent[b] = a
        if len(found):
            while (parent != parent[parent]).any():
                parent[:] = parent[parent]
    linked = np.flatnonzero(parent != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], ["a", "b"])


def link_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows key, block, node, print sorted by key and block: spanning links a, b of each block's links."""
    for t in whole_blocks(batches):
        key, block, node, prints = (c.to_numpy() for c in t.columns)
        prints = prints.view(np.uint64)
        yield spanning_links(key, block, node, lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= bits)  # noqa: B023


def print_links(nodes: DataFrame, bits: int, block: int) -> DataFrame:
    """Links a, b of nodes that span those of at most ``bits`` (0 to 3) differing bits, from one row for each distinct print: print, node."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = keys(b.column(0).to_numpy().view(np.uint64))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(out), b.column(1).take(at), b.column(0).take(at)], ["key", "node", "print"])

    keyed = nodes.select("print", "node").mapInArrow(emit, "key long, node long, print long")
    met = in_blocks(keyed, "key", "print", block).select("key", "block", "node", "print")
    met = met.repartition("key", "block").sortWithinPartitions("key", "block")
    return met.mapInArrow(lambda it: link_blocks(it, bits), "a long, b long")


def simhash_components(
    docs: DataFrame, *, shingle: int = 3, bits: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id, kept (id = component_id).

    Texts are lower-cased in A-Z and cut at ASCII white space; fingerprints link at ``bits`` (at
    most 3) or fewer differing bits, and component_id is the smallest id that links reach. Ids are
    integers; a null id takes part but is never a component's smallest unless all its ids are null.
    A null or blank text has fingerprint zero. Rows that repeat an id are kept, each with its own
    fingerprint. An empty table gives an empty table; other columns are ignored.
    """
    if not 0 <= bits <= 3:
        raise ValueError("keys are proven to meet for 0 to 3 bits")
    prints = fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col).withColumnRenamed(id_col, "__id")
    made = materialise(prints.withColumn("row", F.monotonically_increasing_id()), "prints")
    # One row per distinct fingerprint from here on, which is its own node: whatever ids it has, it can link.
    nodes = made.groupBy("print").agg(F.min("__id").cast("long").alias("least_id"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.col("print"))

    found = connected_components(print_links(nodes, bits, block))
    labels = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labels.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels = salted_join(labels, smallest, "component", ["print"]).select("print", "component_id", F.col("copies").alias("n"))
    return salted_join(made, labels, "print", ["row"]).select(
        F.col("__id").alias(id_col),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


# --- texts of a given similarity -------------------------------------------------------------

#: Texts in the sample that tells frequent shingles, how often one must be in it, and how many are held. They decide no result.
SAMPLED, FREQUENT, MOST_FREQUENT = 8_192, 4, 100_000
BUCKETS = 256
#: Rows of a key beyond this many blocks are too many for a task to hold: they are dealt out by their exact number.
LARGE = 8
#: Bytes of sets, besides BLOCK rows, that are compared in one block at most (twice that where two chunks meet, or one set that is larger);
#: rows of a large component that are held against its STANDS rows, and at most LEADERS, at once.
HELD_BYTES, CHAIN, STANDS, LEADERS = 64 << 20, 256, 4, 16
#: Rows from which on a block's rows with a partner are found by sorting.
LONG = 64
#: Groups of nodes that a task remembers as already sent, and rows looked at together.
SENT, TOGETHER = 500_000, 1 << 14


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of the whole if it has fewer words; none of no words."""
    import xxhash

    words = text.translate(LOWER).split()
    n, k = len(words), min(len(words), shingle)
    if not n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), words), np.uint64, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ each[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """How many hashes lie in each bucket. Two sets differ in at least as many elements as their sketches."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sketches and sizes can have Jaccard similarity ``least``; never false if they have."""
    most = (n + m) * (1 - least) / (1 + least) + 1e-6
    out = np.abs(n - m) <= most
    at = np.flatnonzero(out)
    out[at] = np.abs(a[at].astype(np.int16) - b[at]).sum(axis=1, dtype=np.int64) <= most[at]
    return out


def has_partner(size: np.ndarray, left: np.ndarray, share: float) -> np.ndarray:
    """Of each row, whether another has min(left, left) >= share * (size + size): by sorting, not pair by pair.

    With reach = left / share - size this says that each one's size is within the other's reach.
    """
    reach = (left + 1e-6) / share - size
    order = np.argsort(size, kind="stable")
    r = reach[order]
    best = np.maximum.accumulate(r)
    at = np.searchsorted(best, best)  # where the greatest reach so far stands
    but = np.full(len(r), -np.inf)  # the greatest but that one
    new = at == np.arange(len(r))
    but[1:] = np.maximum.accumulate(np.where(new[1:], best[:-1], r[1:]))
    to = np.searchsorted(size[order], r, side="right") - 1  # the last row within reach
    found = np.where(at[to] == np.arange(len(r)), but[to], best[to])
    out = np.empty(len(r), bool)
    out[order] = (to >= 0) & (found >= size[order])
    return out


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether sets of hashes have Jaccard similarity ``least`` or more."""
    common = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= least * max(len(a), len(b)) - 1e-9 else 0
    return common >= least * (len(a) + len(b) - common) - 1e-9


def rarity(hashes: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each hash is expected, 0 if it is not among the sorted frequent ones."""
    if not len(often):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    return np.where(often[at] == hashes, times[at], 0)


def prefix(hashes: np.ndarray, least: float, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first hashes, rare ones first, of which sets of similarity ``least`` or more share one.

    Such a set holds least * n of these n, so it cannot miss all of the first n - least * n + 1; and of
    two such sets the first common hash, in an order that is the same for all, is among both prefixes.
    """
    n = len(hashes)
    order = np.lexsort((hashes, rarity(hashes, often, times)))
    return hashes[order[: n - int(np.ceil(least * n - 1e-9)) + 1]] if n else hashes


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def frequent_shingles(given: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample of texts, sorted by hash, and in how many texts they are expected."""
    n = given.count()
    every = max(1, n // SAMPLED)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 0):
            for t in pc.cast(pc.fill_null(b.column(0), ""), pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], ["h"])

    sample = given.filter(F.pmod(F.xxhash64("text", "__id"), F.lit(every)) == 0).select("text")
    rows = spread(sample).mapInArrow(hashed, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    found = rows.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toPandas()
    often = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(often)
    return often[order], found["n"].to_numpy(np.int64)[order] * every


def similar_rows(
    docs: DataFrame, *, shingle: int = 5, least: float = 0.8, bits: int | None = None, block: int = BLOCK // 2, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): every row as payload with its own number ``row``; and per row: row, component_id, chosen.

    Texts link where the Jaccard similarity of their sets of shingle hashes is ``least`` or more, computed
    from the sets. Such sets share a hash of their prefixes, so no such pair is missed: rows that share
    one meet, are pruned by bounds that hold for every pair (sizes, places in the prefixes, sketches), and
    what bounds leave together is compared by its sets, each read once a group. Equal sets are one node from the start.
    With ``bits`` the links of ``simhash_components`` (its fingerprints, keys and check) count as well: fingerprints weigh
    repeats, which sets do not.
    component_id is the smallest id that links reach; chosen is one row of it, of that id.
    """
    given = docs.select(F.struct("*").alias("payload"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text"))
    often, times = frequent_shingles(given, shingle)
    given = spread(given).select(F.struct("payload", "__id", F.monotonically_increasing_id().alias("row")).alias("of"), "text")
    share = least / (1 + least)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in small(batches):
            digest, size, counts, first, prints = [], [], [], [], []
            for t in pc.cast(pc.fill_null(b.column(1), ""), pa.binary()).to_pylist():
                h = shingle_set(t, shingle)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
                counts.append(sketch(h).tobytes())
                first.append(prefix(h, least, often, times).tobytes())
                prints.append(0 if bits is None else fingerprint(t.translate(LOWER).split(), 3))
            columns = [pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(counts, pa.binary()), pa.array(first, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(np.array(prints, np.uint64).view(np.int64))], ["of", "digest", "size", "sketch", "first", "print"])

    fields = with_fields(given, "of", "digest binary, size int, sketch binary, first binary, print long")
    made = materialise(given.mapInArrow(hashed, fields).select("of.*", *fields.names[1:]), "sets")
    # A node is the first row of those with equal sets; only rows that are not are written down.
    equal = made.groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = materialise(salted_join(made.select("row", "digest"), equal, "digest", ["row"]).filter("row <> node").select("row", "node"), "copies")
    nodes = made.join(copies.select("row"), "row", "left_anti").withColumnRenamed("row", "node")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(x) // 8 for x in b.column(2).to_pylist()], np.int64)
            key = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8")
            node, size = (np.repeat(b.column(i).to_numpy(), lengths) for i in (0, 1))
            place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # Frequent keys go to several blocks, so that any two rows of one meet.
            chunks = np.maximum(1, -(-rarity(key, often, times) // block))
            at = np.repeat(np.arange(len(key)), chunks)
            c, other = chunks[at], np.arange(len(at)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            own = ((node[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % c
            met = np.minimum(own, other) * c + np.maximum(own, other)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at].view(np.int64), met, node[at], size[at].astype(np.int64) << 32 | place[at])], ["key", "block", "node", "at"])

    def partnered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        import xxhash

        sent: set[int] = set()
        for t, over in bounded_blocks(together(batches), most):
            key, block_, node, at_ = (c.to_numpy() for c in t.columns)
            if over:  # a key more frequent than the sample said: its rows are counted and dealt to blocks
                mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ block_.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()), pa.array(node), pa.array(mixed.view(np.int64)), pa.array(at_)], ["group", "node", "key", "at"])
                continue
            size, left = at_ >> 32, (at_ >> 32) - (at_ & 0xFFFFFFFF)
            has = np.zeros(len(node), bool)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block_[1:] != block_[:-1])])
            long = np.zeros(len(key), bool)
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                if hi - lo > LONG:
                    has[lo:hi], long[lo:hi] = has_partner(size[lo:hi], left[lo:hi], share), True
            for lag, at in neighbours(key, block_, lambda starts: long[starts] | np.logical_and.reduceat(has, starts)):  # noqa: B023
                at = at[~(has[at] & has[at + lag])]
                # Where this is the first hash that two sets share, they share no more than what is left of both.
                near = at[np.minimum(left[at], left[at + lag]) >= share * (size[at] + size[at + lag]) - 1e-6]
                has[near] = has[near + lag] = True
            key, block_, node = key[has], block_[has], node[has]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block_[1:] != block_[:-1])]) if len(key) else np.empty(0, np.int64)
            group, member = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False):
                g = xxhash.xxh64_intdigest(node[lo:hi].tobytes())
                if g not in sent:
                    if len(sent) < SENT:
                        sent.add(g)
                    group.append(np.full(hi - lo, g, np.uint64).view(np.int64))
                    member.append(node[lo:hi])
            if group:
                n = sum(map(len, member))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(group)), pa.array(np.concatenate(member)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["group", "node", "key", "at"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(together(batches)):
            key, block_, node, size = (t.column(i).to_numpy() for i in range(4))
            counts = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(len(node), BUCKETS)
            yield spanning_links(key, block_, node, lambda i, j: may_reach(counts[i], counts[j], size[i].astype(np.int64), size[j].astype(np.int64), least))  # noqa: B023

    def with_sets(dealt: DataFrame) -> DataFrame:
        """Columns of dealt, of which node is one, and the node's set of hashes, held."""
        names = dealt.columns

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in small(batches, len(names)):
                held = [shingle_set(t, shingle).tobytes() for t in pc.cast(pc.fill_null(b.column(len(names)), ""), pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(held, pa.binary())], [*names, "held"])

        texts = nodes.select("node", F.col("payload").getField(text_col).alias("text")).join(dealt, "node").select(*names, "text")
        return texts.mapInArrow(sets, StructType([*dealt.schema.fields, StructField("held", BinaryType())]))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_blocks(batches):
            key, block_, node, part = (t.column(i).to_numpy() for i in range(4))
            held = [np.frombuffer(x, np.uint64) for x in t.column(4).to_pylist()]
            size, counts = np.array([len(x) for x in held], np.int64), np.array([sketch(x) for x in held])

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                out = may_reach(counts[i], counts[j], size[i], size[j], least)  # noqa: B023
                for k in np.flatnonzero(out).tolist():
                    out[k] = similar(held[i[k]], held[j[k]], least)  # noqa: B023
                return out

            yield spanning_links(key, block_, node, near, part)

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for b in batches:
            found = []
            for key, block_, node, held in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (key, block_) != at:
                    at, leaders = (key, block_), []
                mine = np.frombuffer(held, np.uint64)
                to = next((other for other, its in leaders if similar(mine, its, least)), None)
                if to is not None:
                    found.append((node, to))
                elif len(leaders) < LEADERS:
                    leaders.append((node, mine))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    keyed = nodes.select("node", "size", "first").mapInArrow(emit, "key long, block long, node long, at long")
    answer = "group long, node long, key long, at long"
    met = materialise(keyed.repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInArrow(lambda it: partnered(it, LARGE * block), answer), "met")
    over = in_blocks(met.filter("group is null").select("key", "node", "at"), "key", "node", block).select("key", "block", "node", "at")
    over = over.repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInArrow(lambda it: partnered(it, 1 << 62), answer)
    groups = materialise(met.filter("group is not null").union(over).select("group", "node").distinct(), "groups")
    discard(met)
    sized = groups.join(nodes.select("node", "size", "sketch"), "node").select("group", F.lit(0).cast("long").alias("block"), "node", "size", "sketch")
    loose = connected_components(sized.repartition("group").sortWithinPartitions("group").mapInArrow(bounded, "a long, b long"))
    members = materialise(loose.join(nodes.select("node", "size"), "node"), "members")
    n, size, first = F.count(F.lit(1)), F.sum(F.col("size").cast("long") * 8), F.lit(0).cast("long")
    stands = F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(STANDS)))
    counts = members.groupBy("component").agg(n.alias("n"), F.ceil(F.greatest(n / F.lit(block), size / F.lit(HELD_BYTES))).cast("long").alias("c"), stands.alias("stands"))
    large = materialise(counts.filter("c > 1"), "large")  # a row for so many rows or bytes: few
    dealt, links = members.select("component", "node", F.col("node").alias("part"), F.array(first).alias("to")), []
    if not large.isEmpty():
        # Near copies by the thousand: each is first held against a few rows of its component, so that few are left to compare with all.
        places, stand = F.ceil(F.col("n") / CHAIN).cast("long"), F.array_contains("stands", F.col("node"))
        to = F.when(stand, F.sequence(first, places - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), places)))
        begun = members.join(F.broadcast(large), "component")
        row = with_sets(begun.select("component", "node", (~stand).alias("later"), to.alias("to")))
        row = row.select("component", F.explode("to").alias("block"), "node", "held", "later")
        row = row.repartition("component", "block").sortWithinPartitions("component", "block", "later", "node").drop("later")
        links = [materialise(row.mapInArrow(led, "a long, b long"), "led")]
        parts = connected_components(links[0]).select("node", F.col("component").alias("part"))
        parts = materialise(begun.join(parts, "node", "left").select("component", "node", "size", "c", F.coalesce("part", "node").alias("part")), "parts")
        by_part = parts.groupBy("component", "part").agg(n.alias("n"), size.alias("size"))
        main = by_part.groupBy("component").agg(F.max(F.struct("n", "size", "part")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        # Others than those of the largest part go to all its chunks, if they are few; else all chunks meet.
        few = (F.col("n") - F.col("main.n") <= block) & (F.col("size") - F.col("main.size") <= HELD_BYTES)
        main = materialise(main.select("component", F.col("main.part").alias("main"), few.alias("few"), (F.col("n") > F.col("main.n")).alias("open")), "main")
        c, own = F.col("c"), F.pmod(F.xxhash64("node"), F.col("c"))
        chunks = F.sequence(first, c - 1)
        to = F.when(~F.col("few"), F.transform(chunks, lambda x: F.least(x, own) * c + F.greatest(x, own)))
        to = to.when(F.col("part") == F.col("main"), F.array(own * c + own)).otherwise(F.transform(chunks, lambda x: x * c + x))
        left = parts.join(F.broadcast(main), "component").filter("open").select("component", "node", "part", to.alias("to"))
        dealt = dealt.join(F.broadcast(large.select("component")), "component", "left_anti").select(*left.columns).union(left)
    dealt = with_sets(dealt).select("component", F.explode("to").alias("block"), "node", "part", "held")
    links.append(dealt.repartition("component", "block").sortWithinPartitions("component", "block").mapInArrow(link, "a long, b long"))
    links = reduce(DataFrame.union, links)
    # Slim rows from here on: each with its node's component, and of each component the row of the smallest id.
    slim = made.select("row", "__id", "print").join(copies, "row", "left").withColumn("node", F.coalesce("node", "row"))
    if bits is not None:  # nodes of one print link to the least of them, which stands for the print
        printed = materialise(slim.select("print", "node").distinct(), "printed")
        stands = printed.groupBy("print").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
        alike = salted_join(printed, stands, "print", ["node"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        links = links.union(alike).union(print_links(stands.select("print", F.col("least").alias("node")), bits, BLOCK))
    found = connected_components(links)
    slim = slim.join(found, "node", "left").select("row", "__id", F.coalesce("component", "node").alias("component"))
    first = slim.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("null"), "__id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    labels = salted_join(slim, first, "component", ["row"]).select("row", F.col("first.__id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("chosen"))
    return made.select("row", "payload"), labels


def similar_components(
    docs: DataFrame, *, shingle: int = 5, least: float = 0.8, block: int = BLOCK // 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, component_id, kept; texts link as ``similar_rows`` says.

    Ids, nulls and repeats are treated as in ``simhash_components``.
    """
    rows, labels = similar_rows(only(docs, [id_col, text_col]), shingle=shingle, least=least, block=block, id_col=id_col, text_col=text_col)
    joined = rows.select("row", F.col("payload").getField(id_col).alias(id_col)).join(labels, "row")
    return joined.select(id_col, "component_id", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")).alias("kept"))
