"""Removal of passages that occur more than once, found by anchors at fixed blocks.

A window of ``n`` words holds a whole block of ``(n + 1) // 2`` words that starts at a
multiple of that width in its text. Such blocks are the index; every rolling window
of a block's width probes it. A block that is met anywhere else is an anchor, and
is extended to every window around it; windows are counted by two 64-bit hashes,
never paired, and the union of those that occur again are the maximal repeats.

Filters keep what moves small: bitmaps of a bounded size, of index, anchors and
texts with repeats. They only let rows by; whatever passes is joined and counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._words import hash_words, mix, text_slices
from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut, forget

WINDOW = 35
#: Bits of a bitmap at most (64 MB); tables that would fill it go without one.
MOST_BITS = 1 << 29
#: Bits to a hash, and of each piece of a bitmap that is made by itself.
SPREAD, PIECE_BITS = 32, 1 << 16
#: A window with one in so many of all that repeat is dealt over so many parts.
OFTEN, SALTS = 4096, 32
_MULTS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407))
_KEY = ["k1", "k2"]
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def runs(words: np.ndarray, width: int, mult: np.uint64) -> np.ndarray:
    """Hash of ``words[i:i + width]`` for every ``i``: runs of powers of two are joined, not word after word."""
    made, held = np.zeros(len(words) + 1, dtype=np.uint64), 0
    power, size, scale = words, 1, int(mult)
    while width >> (size.bit_length() - 1):
        if width & size:
            m = len(words) - held - size + 1
            if m <= 0:
                return np.zeros(0, dtype=np.uint64)
            made = made[:m] * np.uint64(scale) + power[held : held + m]
            held += size
        if len(power) > size:
            power = power[:-size] * np.uint64(scale) + power[size:]
        else:
            power = power[:0]
        scale, size = scale * scale % (1 << 64), 2 * size
    return mix(made)


class _Texts:
    """The words of some texts: hashes, offsets, and which places start a whole run of some width."""

    def __init__(self, column: pa.Array):
        self.bounds, (self.words,) = hash_words(column, lower=False)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(self.words)) - self.bounds[:-1][self.text]

    def whole(self, width: int) -> np.ndarray:
        """Places where a run of ``width`` words starts and ends in one text."""
        return np.flatnonzero(self.place + width <= self.counts[self.text])

    def anchored(self, blocks: np.ndarray, width: int, window: int) -> np.ndarray:
        """Places of all windows whose first block is one of ``blocks``."""
        at = (blocks[:, None] - np.arange(width)[None, :]).ravel()
        shift = np.tile(np.arange(width), len(blocks))
        text = self.text[np.repeat(blocks, width)]
        place = self.place[np.repeat(blocks, width)] - shift
        return np.sort(at[(place >= 0) & (place + window <= self.counts[text])])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _held(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a bitmap; without one, all may."""
    if bits is None:
        return np.ones(len(h), dtype=bool)
    at = h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(hashes: DataFrame, column: str) -> Broadcast:
    """A broadcast of the leading bits of all hashes in ``column``, ``SPREAD`` bits to a hash up to ``MOST_BITS``; of None where they are more than that."""
    spark, n = hashes.sparkSession, hashes.count()
    if n > MOST_BITS:
        return spark.sparkContext.broadcast(None)
    size = min(MOST_BITS, max(PIECE_BITS, 1 << (SPREAD * n).bit_length()))
    at = F.shiftrightunsigned(column, 65 - size.bit_length())
    places = hashes.select(at.alias("at")).distinct()

    def filled(piece: pa.Table) -> pa.Table:
        marks = np.zeros(PIECE_BITS, dtype=np.uint8)
        marks[piece.column("at").to_numpy() % PIECE_BITS] = 1
        number = piece.column("at")[0].as_py() // PIECE_BITS
        return pa.table({"piece": pa.array([number], pa.int64()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    made = places.groupBy(F.expr(f"at div {PIECE_BITS}").alias("piece")).applyInArrow(filled, "piece long, bits binary")
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in made.toLocalIterator():  # MOST_BITS at most
        bits[r["piece"] * (PIECE_BITS // 8) :][: PIECE_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(bits)


def _passed(texts: DataFrame, schema: str, find: Callable[[_Texts, np.ndarray, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``find`` over all texts, some at a time, with a flag of those that have copies. A task sees such a text once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            copied = batch.column(3).to_numpy(zero_copy_only=False)
            if copied.any():
                keys, new = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), ~copied
                for i in np.flatnonzero(copied):
                    new[i] = keys[i] not in seen
                    seen.add(keys[i])
                batch, copied = batch.filter(pa.array(new)), copied[new]
            for lo, hi in text_slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(find(_Texts(part.column(0)), copied[lo:hi], part), names=names)

    return texts.select("text", *_KEY, "copied").mapInArrow(run, schema)


def _index(texts: DataFrame, width: int) -> DataFrame:
    """``h`` of all blocks."""

    def find(t: _Texts, copied: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        at = t.whole(width)
        return [_signed(np.unique(runs(t.words, width, _MULTS[0])[at[t.place[at] % width == 0]]))]

    return _passed(texts, "h long", find).distinct()


def _anchors(texts: DataFrame, index: Broadcast, width: int) -> DataFrame:
    """``h`` of the blocks that some other rolling window equals. Copies of a text count twice."""

    def find(t: _Texts, copied: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        at = t.whole(width)
        h = runs(t.words, width, _MULTS[0])[at]
        near = _held(index.value, h)
        at, h = at[near], h[near]
        value, which = np.unique(h, return_inverse=True)
        n = np.bincount(which, 1 + copied[t.text[at]], minlength=len(value)).astype(np.int64)
        block = np.bincount(which, t.place[at] % width == 0, minlength=len(value)) > 0
        return [_signed(value), pa.array(n), pa.array(block)]

    met = _passed(texts, "h long, n long, block boolean", find).groupBy("h").agg(F.sum("n").alias("n"), F.max("block").alias("block"))
    return met.where("block and n > 1").select("h")


def _windows(texts: DataFrame, anchors: Broadcast, width: int, window: int, placed: bool) -> DataFrame:
    """The windows around anchors: ``w1``, ``w2`` and how often they occur, or, if ``placed``, where, in texts without copies."""

    def find(t: _Texts, copied: np.ndarray, part: pa.RecordBatch) -> list[pa.Array]:
        at = t.whole(width)
        at = at[t.place[at] % width == 0]
        if placed:
            at = at[~copied[t.text[at]]]
        at = t.anchored(at[_held(anchors.value, runs(t.words, width, _MULTS[0])[at])], width, window)
        one, two = (runs(t.words, window, m)[at] for m in _MULTS)
        if placed:
            rows = pa.array(t.text[at])
            return [_signed(one), _signed(two), part.column(1).take(rows), part.column(2).take(rows), pa.array(t.place[at].astype(np.int32))]
        # Equal windows of these texts are sent once.
        order = np.lexsort((two, one))
        one, two, n = one[order], two[order], 1 + copied[t.text[at[order]]].astype(np.int64)
        first = np.ones(len(one), dtype=bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        sums = np.add.reduceat(n, np.flatnonzero(first)) if len(n) else n
        return [_signed(one[first]), _signed(two[first]), pa.array(sums)]

    return _passed(texts, "w1 long, w2 long, k1 long, k2 long, place int" if placed else "w1 long, w2 long, n long", find)


def _met(windows: DataFrame, again: DataFrame) -> DataFrame:
    """The windows that are in ``again``. One that makes up much of the whole is dealt over ``SALTS`` parts on both sides."""
    total = again.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * OFTEN > total  # OFTEN windows at most
    hot = again.where(often).select("w1", "w2", F.lit(SALTS).alias("salts"))
    salted = windows.join(F.broadcast(hot), ["w1", "w2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("k1", "place"), "salts"), F.lit(0).cast("long"))).drop("salts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.when(often, SALTS - 1).otherwise(0).cast("long")))
    return salted.join(again.select("w1", "w2", salts.alias("salt")), ["w1", "w2", "salt"])


def flat(text: str) -> bytes:
    """The words of a text, joined by one space."""
    return _SPACE.sub(b" ", text.encode()).strip(b" ")


def without(words: bytes, places: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Numbers of words and of those in the windows at ``places``, and the others joined by one space."""
    gaps = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(words)]))
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    kept = np.cumsum(edge[:-1]) == 0
    turn = np.diff(np.concatenate(([False], kept, [False])).astype(np.int8))
    pieces = [words[starts[a] : ends[b - 1]] for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
    return len(starts), int((~kept).sum()), b" ".join(pieces)


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _batch(ids: pa.Array, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n, removed, kept = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` of every row: words in a window whose words also start anywhere else are removed.

    Windows are judged on the texts as given. A text that several rows have is read
    once and counts as two: all its windows repeat, and all its words go if it has a
    window at all. Rows that repeat an id are judged by their text alone, null ids
    too. Null, empty and short texts have no window and keep their words; very long
    ones are hashed whole, some bytes at a time; other columns of ``docs`` are not
    read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    width = (window + 1) // 2
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", *[F.xxhash64(F.lit(k), "text").alias(c) for k, c in enumerate(_KEY)])
    long = F.octet_length("text") >= 2 * window - 1
    copies = rows.where(long).groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    copies = cut(copies.select(*_KEY, "first", F.lit(True).alias("copied")), "copies")
    small = broadcast_if_small(copies)
    flagged = rows.join(small, _KEY, "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    if small is copies:  # texts move for this join, so once
        flagged = cut(flagged, "flagged")
    texts = flagged.where(long & (~F.col("copied") | F.col("doc_id").eqNullSafe(F.col("first"))))

    index = cut(_index(texts, width), "index")
    anchors = cut(_anchors(texts, bitmap(index, "h"), width), "anchors")
    near = bitmap(anchors, "h")
    again = cut(_windows(texts, near, width, window, False).groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1"), "again")
    met = _met(_windows(texts.where("not copied"), near, width, window, True), again)
    places = cut(met.groupBy(*_KEY).agg(F.collect_list("place").alias("places")), "places")  # a text's own places
    touched = bitmap(places, "k1")
    forget(index, anchors, again)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied = batch.column(3).to_numpy(zero_copy_only=False)
            near = ~copied & _held(touched.value, batch.column(2).to_numpy().view(np.uint64))
            batch, copied, found = batch.filter(pa.array(~near)), copied[~near], []
            for t, twice in zip(batch.column(1), copied, strict=True):
                words = flat(t.as_py())
                n = words.count(b" ") + 1 if words else 0
                found.append((n, n, b"") if twice and n >= window else (n, 0, words))
            yield _batch(batch.column(0), found)

    def pending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_held(touched.value, batch.column(2).to_numpy().view(np.uint64))))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, p in zip(batch.column(1), batch.column(2), strict=True):
                words = flat(t.as_py())
                found.append(without(words, p.values.to_numpy() if p.is_valid else np.zeros(0, dtype=np.int64), window) if words else (0, 0, b""))
            yield _batch(batch.column(0), found)

    ready = flagged.select("doc_id", "text", "k1", "copied").mapInArrow(done, _RESULT)
    open_ = flagged.where("not copied").select("doc_id", "text", *_KEY).mapInArrow(pending, "doc_id long, text string, k1 long, k2 long")
    rest = open_.join(places, _KEY, "left").select("doc_id", "text", "places").mapInArrow(finished, _RESULT)
    return ready.unionByName(rest)


def op13_block_anchors(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without passages of 35 words that occur again."""
    made = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT row, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW}),
wins AS (SELECT row, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h FROM starts JOIN d USING (row)),
again AS (SELECT row, p FROM wins WHERE h IN (SELECT h FROM wins GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT row, unnest(range(p, p + {WINDOW})) AS p FROM again),
words AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (row, p) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)"""
