"""Near-duplicate groups by an LSH forest over MinHash signatures.

Every tree orders the documents by a signature of its own, a sequence of
MinHash values. Documents that stand together in that order with a common
prefix of ``MIN_DEPTH`` values form a region; where a region is crowded the
prefix grows, for that region alone, until it holds ``CROWD`` documents at most.
Inside a region, a document's candidates are its longest-common-prefix
neighbours: those that stand around it in the sorted order with as long a prefix
as any other shares with it. Compact sketches keep the promising ones; full
shingle sets confirm every link.

Whatever stays open is settled exactly: the first pass names the strongest
spanning forest of a region's candidates, and once the confirmed links are
known, every pair of a region between two different components is compared and
confirmed as well, unless its sketches or bitmaps of the two sets rule it out.
This second pass takes the regions of ``MIN_DEPTH`` values whole, however
crowded they are: large ones are compared block by block over all pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm._words import hash_words, mix, shingles, text_slices
from lexmill.operators.components import connected_components
from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut, forget

TREES = 24
DEPTH = 6
MIN_DEPTH = 3
CROWD = 2048
#: Two bytes of each MinHash value enter a tree's order.
STEP = 2
#: Crowds in a part of a large region of the second pass; a block holds two parts.
PART = 4
VALUES = TREES * DEPTH
#: Of VALUES sketch cells, so many equal ones make a candidate. At a similarity
#: of 0.75 the expected count is 110 with deviation 5: about 4 in a million fall short.
LEAST_EQUAL = 88
#: Bits for each document in the filter that names those whose full sets are wanted, and the filter's least and most bits (1 and 64 MB).
BITS_PER_ID, LEAST_FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 23, 1 << 29
#: Bytes of the bitmap that bounds a pair's common shingles from above.
BOUND_BYTES = 1024

_draw = np.random.default_rng(20240817)
_MULT = _draw.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _draw.integers(0, 1 << 63, VALUES, dtype=np.uint64)

_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("sig", T.BinaryType()),
    ]
)
_PAIRS = "a long, b long"


def _minima(s: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        part = (s[at : at + 2048][None, :] ^ _XOR[:, None]) * _MULT[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return mix(low)


def _sets(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, offsets and shingle hashes in slices of about a megabyte of text."""
    for lo, hi in text_slices(texts):
        bounds, (words,) = hash_words(texts.slice(lo, hi - lo))
        yield (ids.slice(lo, hi - lo), *shingles(bounds, words))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, offsets, runs in _sets(batch.column(0), batch.column(1)):
            counts, k1, k2, sketches, sigs = [], [], [], [], []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                s = np.unique(runs[lo:hi])
                counts.append(len(s))
                if not len(s):
                    k1.append(0), k2.append(0), sketches.append(None), sigs.append(None)
                    continue
                k1.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                low = _minima(s)
                cells = (low & np.uint64(15)).astype(np.uint8)
                sketches.append((cells[0::2] << 4 | cells[1::2]).tobytes())
                sigs.append((low >> np.uint64(48)).astype(">u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketches, pa.binary()), pa.array(sigs, pa.binary())],
                names=_SIGNED.names,
            )


def _full_sets(send, bitmap: bool):
    """Sorted shingle sets of the wanted documents, or bitmaps of them; ``send`` broadcasts the filter."""

    def hashed(s: np.ndarray) -> bytes:
        cells = np.zeros(8 * BOUND_BYTES, dtype=bool)
        cells[s % np.uint64(8 * BOUND_BYTES)] = True
        return np.packbits(cells).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(send.value, dtype=np.uint8)
        for batch in batches:
            slot = batch.column(2).to_numpy() - 1
            mask = (wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(mask.astype(bool)))
            if not batch.num_rows:
                continue
            for ids, offsets, runs in _sets(batch.column(0), batch.column(1)):
                if bitmap:
                    bits = [hashed(runs[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "members"])
                    continue
                parts = [np.unique(runs[lo:hi]).view(np.int64) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
                values = pa.array(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "members"])

    return run


def _unpack(rows: list[bytes]) -> np.ndarray:
    """Sketches as words of 16 cells."""
    return np.frombuffer(b"".join(rows), dtype=np.uint64).reshape(len(rows), -1)


def _likeness(cells: np.ndarray, sizes: np.ndarray, other_cells: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Equal cells of all pairs of two sides; 0 where the pair cannot be a link."""
    equal = np.empty((len(cells), len(other_cells)), dtype=np.int16)
    one, two, ones = np.uint64(1), np.uint64(2), np.uint64(0x1111111111111111)
    for at in range(0, len(cells), 64):
        unlike = np.zeros((len(cells[at : at + 64]), len(other_cells)), dtype=np.int16)
        for k in range(cells.shape[1]):
            bits = cells[at : at + 64, k, None] ^ other_cells[None, :, k]
            bits |= bits >> one
            bits |= bits >> two
            bits &= ones
            unlike += np.bitwise_count(bits)
        part, mine = VALUES - unlike, sizes[at : at + 64, None]
        small, large = np.minimum(mine, other_sizes[None, :]), np.maximum(mine, other_sizes[None, :])
        part[(part < LEAST_EQUAL) | (100 * small < 75 * large)] = 0
        equal[at : at + 64] = part
    return equal


def _neighbours(path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Longest-common-prefix neighbours in a sorted order: rows, and the stretch of rows around them that are theirs.

    ``path`` has a row of values for each document. Rows of one stretch have the
    same length of prefix as their longest; every row is in one of the first parts.
    """
    m = len(path)
    lcp = np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1)
    longest = np.maximum(np.concatenate(([-1], lcp)), np.concatenate((lcp, [-1])))
    for depth in np.unique(longest)[::-1]:
        stretch = np.concatenate(([0], np.cumsum(lcp < depth)))
        rows = np.flatnonzero(longest == depth)
        of = stretch[rows]
        ends = np.searchsorted(stretch, np.arange(stretch[-1] + 2))
        for some in np.split(rows, np.flatnonzero(of[1:] != of[:-1]) + 1):
            a = stretch[some[0]]
            yield some, np.arange(ends[a], ends[a + 1] if a + 1 < len(ends) else m)


def _forest(equal: np.ndarray) -> list[tuple[int, int]]:
    """The strongest spanning forest of a region's candidates."""
    m = len(equal)
    best, parent = np.zeros(m, dtype=np.int16), np.full(m, -1)
    out_of = np.ones(m, dtype=bool)
    edges, now = [], 0
    for _ in range(m):
        out_of[now] = False
        if parent[now] >= 0:
            edges.append((int(parent[now]), now))
        better = (equal[now] > best) & out_of
        best[better], parent[better] = equal[now][better], now
        now = int(np.argmax(np.where(out_of, best, -1)))
    return edges


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of one region each; rows arrive sorted by region."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column(0).to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]))
        if held and held[-1].column(0)[0].as_py() != int(region[0]):
            yield pa.concat_batches(held)
            held = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(region):
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)


def _possible(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, bits: np.ndarray, min_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can reach ``min_pct``: no more shingles are common than bits are, and those that share a bit."""
    filled = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    spare = np.where(filled == 8 * BOUND_BYTES, sizes.max(), sizes - filled)
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 8192):
        x, y = i[at : at + 8192], j[at : at + 8192]
        common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare[x], spare[y])
        keep[at : at + 8192] = 100 * common >= min_pct * (sizes[x] + sizes[y] - common)
    return i[keep], j[keep]


def _across(group: pa.RecordBatch, min_pct: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All possible pairs of a block between different components, a stripe at a time: within its part, or between its two parts."""
    cells, sizes, label = _unpack(group.column(3).to_pylist()), group.column(2).to_numpy(), group.column(4).to_numpy()
    bits = np.frombuffer(b"".join(group.column(5).to_pylist()), dtype=np.uint64).reshape(len(label), -1)
    part = group.column(6).to_numpy()
    one, two = np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min())
    for at in range(0, len(one), 64):
        x = one[at : at + 64]
        y = two if len(two) else one[at:]
        i, j = np.nonzero((_likeness(cells[x], sizes[x], cells[y], sizes[y]) > 0) & (label[x][:, None] != label[y][None, :]))
        if len(i):
            yield _possible(x[i], y[j], sizes, bits, min_pct)


def _pairs_of(across: bool, min_pct: int = 75):
    """Candidates of each region: the forest of its neighbours in sorted order, or all possible ones between different components."""

    def pairs_in(group: pa.RecordBatch) -> Iterator[tuple[np.ndarray | list, np.ndarray | list]]:
        if across:
            yield from _across(group, min_pct)
            return
        cells, sizes, m = _unpack(group.column(3).to_pylist()), group.column(2).to_numpy(), group.num_rows
        if m == 2:
            yield ([0], [1]) if _likeness(cells[:1], sizes[:1], cells[1:], sizes[1:])[0, 0] else ([], [])
            return
        path = np.frombuffer(b"".join(group.column(4).to_pylist()), dtype=f"V{STEP}").reshape(m, DEPTH)
        equal = np.zeros((m, m), dtype=np.int16)
        for rows, near in _neighbours(path):
            like = _likeness(cells[rows], sizes[rows], cells[near], sizes[near])
            equal[np.ix_(rows, near)] = like
            equal[np.ix_(near, rows)] = like.T
        edges = _forest(equal)
        yield [x for x, _ in edges], [y for _, y in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for group in _by_region(batches):
            if group.num_rows < 2:
                continue
            rep = group.column(1).to_numpy()
            for i, j in pairs_in(group):
                if not len(i):
                    continue
                x, y = rep[i], rep[j]
                ok = x != y
                found.append(np.stack((np.minimum(x, y)[ok], np.maximum(x, y)[ok]), axis=1))
                count += len(x)
                if count > 50_000:
                    yield flush()
                    found, count = [], 0
        if found:
            yield flush()

    return run


def _regions(reps: DataFrame) -> DataFrame:
    """Tree and region of each representative that shares its region with another, written.

    ``first`` marks the regions of the first pass, which deepen where they are
    crowded; ``whole`` those of the second, all of ``MIN_DEPTH`` values.
    """
    passes = lambda rows, first, whole: rows.select("region", "rep", "tree", F.lit(first).alias("first"), F.lit(whole).alias("whole"))
    width = STEP * DEPTH
    open_rows = reps.select("rep", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select(
        "rep", "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("path")
    )
    done: list[DataFrame] = []
    spent: list[DataFrame] = []
    for depth in range(MIN_DEPTH, DEPTH + 1):
        key = F.xxhash64("tree", F.substring("path", 1, STEP * depth), F.lit(depth))
        keyed = open_rows.select("rep", "tree", "path", key.alias("region"))
        shared = cut(keyed.groupBy("region").agg(F.count("*").alias("n"), F.min("rep").alias("pivot"), F.first("tree").alias("of")).where("n > 1"), "crowds")
        spent.append(shared)
        crowded = shared.where(F.col("n") > CROWD)
        any_crowd = not crowded.isEmpty()
        if not any_crowd:
            done.append(passes(keyed.join(shared.select("region"), "region"), True, depth == MIN_DEPTH))
            break
        done.append(passes(keyed.join(shared.where(F.col("n") <= CROWD).select("region"), "region"), True, depth == MIN_DEPTH))
        if depth == MIN_DEPTH:
            done.append(passes(keyed.join(crowded.select("region"), "region"), False, True))
        if depth < DEPTH:
            open_rows = keyed.join(crowded.select("region"), "region").select("rep", "tree", "path")
            continue
        # As deep as the trees go: deal the region out in parts, its pivot in each.
        parts = F.ceil(F.col("n") / CROWD).cast("int")
        crowded = crowded.select("region", "pivot", "of", parts.alias("parts"))
        dealt = keyed.join(crowded, "region").select(F.xxhash64("region", F.pmod(F.xxhash64("region", "rep"), "parts").cast("int")).alias("region"), "rep", "tree")
        pivots = crowded.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).select(
            F.xxhash64("region", F.col("part").cast("int")).alias("region"), F.col("pivot").alias("rep"), F.col("of").alias("tree")
        )
        done.append(passes(dealt.unionByName(pivots).distinct(), True, False))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    wide = reps.select("rep", "n_shingles", "sketch", "sig")
    path = F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("path")
    regions = cut(out.join(wide, "rep").select("region", "rep", "n_shingles", "sketch", "first", "whole", path), "regions")
    forget(*spent)
    return regions


def _parted(labelled: DataFrame) -> DataFrame:
    """Rows of the regions of several components, with their ``part`` and the numbers of parts.

    Rows of a large region's largest component need no comparison with each other,
    so they have parts of their own, the last ``mains`` of them.
    """
    rows = PART * CROWD
    by_label = labelled.groupBy("region", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("region").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    large = F.col("n") > rows
    mixed = mixed.select(
        "region",
        F.when(large, F.col("top.label")).alias("main"),
        F.when(large, F.ceil((F.col("n") - F.col("top.n")) / rows)).otherwise(1).cast("int").alias("others"),
        F.when(large, F.ceil(F.col("top.n") / rows)).otherwise(0).cast("int").alias("mains"),
    )
    deal = lambda n: F.pmod(F.xxhash64("region", "rep"), F.col(n)).cast("int")
    part = F.when(F.col("label") == F.col("main"), F.col("others") + deal("mains")).otherwise(deal("others"))
    return labelled.join(mixed, "region").withColumn("part", part).drop("main")


def _blocks(rest: DataFrame) -> DataFrame:
    """Each row once for every block, a pair of parts of its region, that it takes part in."""
    last = F.when(F.col("part") < F.col("others"), F.col("others") + F.col("mains") - 1).otherwise(F.col("others") - 1)
    every = rest.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return every.withColumn("region", F.xxhash64("region", F.least("part", "with"), F.greatest("part", "with")))


def _shingled(ids: DataFrame, docs: DataFrame, bitmap: bool = False) -> DataFrame:
    """``doc_id`` and ``members`` (set, or its bitmap) of the documents in ``ids``; texts meet no shuffle.

    A filter of a few bits for each wanted document keeps the others from being
    shingled. It grows with their number up to ``MOST_FILTER_BITS``; beyond, it lets
    more through, which the join drops: the work grows, the result stays.
    """
    n, bits = ids.count(), LEAST_FILTER_BITS
    while bits < min(BITS_PER_ID * n, MOST_FILTER_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    filled = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    keep = bytearray(bits // 8)
    for row in filled.toLocalIterator():  # bits / 32768 rows of 4 KB at most
        keep[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = row["bits"]
    send = docs.sparkSession.sparkContext.broadcast(bytes(keep))
    named = docs.select("doc_id", "text", slot.alias("slot")).where("doc_id is not null")
    return named.mapInArrow(_full_sets(send, bitmap), f"doc_id long, members {'binary' if bitmap else 'array<long>'}").join(ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, min_pct: int) -> DataFrame:
    """The pairs whose full shingle sets reach ``min_pct`` percent similarity."""
    sets = _shingled(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), docs)
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("ma").alias("na"), F.size("mb").alias("nb"), F.size(F.array_intersect("ma", "mb")).alias("common"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(min_pct) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pct: int = 75) -> DataFrame:
    """Group documents whose 5-word shingle sets are at least ``min_pct`` percent alike.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest linked id) and
    ``kept``, one row per input row. Null and blank texts have no shingles and
    link with nothing; a text under five words is one shingle. Rows that repeat
    an id count as one document. A row without an id joins no group and is kept.
    Other columns are ignored; an empty table gives an empty result; a text is
    taken whole, however long. The sketch threshold is tuned to ``min_pct`` of 75 and
    above; smaller values are refused.
    """
    if min_pct < 75:
        raise ValueError("min_pct must be 75 or more")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_sign, _SIGNED), "signed")
    named = signed.where("n_shingles > 0 and doc_id is not null")
    reps = cut(
        named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("sig").alias("sig")),
        "reps",
    )
    regions = _regions(reps)
    order = ["region", "rep", "n_shingles", "sketch"]
    ordered = regions.where("first").repartition("region").sortWithinPartitions("region", "path", "rep").select(*order, "path")
    pairs = cut(ordered.mapInArrow(_pairs_of(False), _PAIRS).distinct(), "pairs")
    links = cut(_confirmed(pairs, docs, min_pct), "links")
    groups = cut(connected_components(links), "groups")
    labelled = regions.where("whole").join(groups, F.col("rep") == F.col("node"), "left").select(*order, F.coalesce("component", "rep").alias("label"))
    held = rest = cut(_parted(labelled), "rest")
    bounds = _shingled(rest.select(F.col("rep").alias("doc_id")).distinct(), docs, bitmap=True)
    # A repeated id may stand for several texts; then every bit is set, which rules nothing out.
    bounds = bounds.groupBy(F.col("doc_id").alias("rep")).agg(F.max("members").alias("members"), F.count("*").alias("texts"))
    wide = F.when(F.col("texts") == 1, F.col("members")).otherwise(F.lit(b"\xff" * BOUND_BYTES))
    rest = _blocks(rest.join(bounds, "rep").withColumn("members", wide)).select(*order, "label", "members", "part").repartition("region").sortWithinPartitions("region")
    more = cut(rest.mapInArrow(_pairs_of(True, min_pct), _PAIRS).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        extra = cut(_confirmed(more, docs, min_pct), "links")
        if not extra.isEmpty():
            groups = cut(connected_components(links.unionByName(extra)), "groups")
        forget(extra)
    forget(regions, pairs, links, held, more)
    of_set = reps.select("k1", "k2", "rep").join(groups, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    mark = F.col("n_shingles") > 0
    joined = signed.select("doc_id", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"], "left")
    component = F.when(mark & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose document is kept by :func:`near_duplicates`.

    Rows without an id stay. Texts move only where the ids that go are too many to broadcast.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = broadcast_if_small(cut(gone, "gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op3_minhash_forest(spark, sf_dir: str) -> DataFrame:
    """The group of each of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)])) END AS s FROM d
), c AS (
  SELECT min(doc_id) AS id, s FROM s WHERE len(s) > 0 GROUP BY s
), e AS (
  SELECT id, len(s) AS n, unnest(s) AS g FROM c
), pairs AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
  UNION SELECT s.doc_id, c.id FROM s JOIN c ON s.s = c.s UNION SELECT c.id, s.doc_id FROM s JOIN c ON s.s = c.s
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
), least AS (
  SELECT id, min(r) AS component_id FROM reach GROUP BY id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON id = doc_id
"""
