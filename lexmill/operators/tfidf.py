"""TF-IDF tables, cosine pairs, and a linear classifier on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexmill.functions.text import collapse, words_of
from lexmill.functions.hashes import word_hashes
from lexmill.operators import counted, linear
from lexmill.operators.metrics import class_weights, macro_scores
from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut

#: Inverse strengths of the penalty that a validation set chooses from.
STRENGTHS = (0.3, 1.0, 3.0, 10.0, 30.0)
FEATURES = 1 << 18
#: Rows of a block of similar rows; as many pairs between two blocks are cheaper met at once.
BLOCK_ROWS = 256
#: Grams of a bucket that is counted at once, about, and characters of a chunk of texts whose grams are told apart at once.
HELD_GRAMS, COUNTED_GRAMS = 1 << 21, 1 << 20
#: Chunks of a file: as many are read at once at most.
FILE_CHUNKS = 64
#: Rows of a batch of folded grams.
FOLDED_ROWS = 256
#: Rows of a block that meets other blocks whole at most, and grams of its rows, but for a longer row alone.
MET_ROWS, MET_ENTRIES = 512, 1 << 20
#: Products of two rows by a matrix that cost as much as one by itself; grams of a matrix, products and pairs at once.
SCATTERED, MATRIX_GRAMS, PRODUCTS, SENT_PAIRS = 200, 512, 1 << 19, 1 << 16


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of each word between two spaces; grams never cross words."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        sizes = F.sequence(F.lit(least), F.least(F.lit(most), F.length(padded)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(words_of(text), of_word))


def gram_counts(rows: DataFrame, id_col: str, grams: Column) -> DataFrame:
    """``id``, ``gram``, ``tf``. Rows without grams give none."""
    return rows.select(F.col(id_col).alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def idf_table(counts: DataFrame, n: int) -> DataFrame:
    """``gram``, ``df``, ``idf``: smoothed inverse document frequency over ``n`` rows."""
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    return df.select("gram", "df", (F.ln(F.lit(1 + n).cast("double") / (1 + F.col("df")).cast("double")) + 1).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame, sublinear: bool = False) -> DataFrame:
    """``id``, ``gram``, ``weight``: rows of length one; grams that ``idf`` lacks are left out."""
    tf = 1 + F.ln(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = counts.join(idf, "gram").select("id", "gram", (tf * F.col("idf")).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(broadcast_if_small(norms), "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(rows: DataFrame, id_col: str, grams: Column, sublinear: bool = False) -> DataFrame:
    """``id``, ``gram``, ``weight`` of rows weighted among themselves."""
    counts = cut(gram_counts(rows, id_col, grams), "grams")
    return weighted(counts, idf_table(counts, rows.count()), sublinear)


def _row(values: pa.ListScalar) -> np.ndarray:
    return values.values.to_numpy()


def _similar(least: float):
    """Similarities of pairs of rows, each as sorted hashes of grams and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                g, v, h, w = (_row(batch.column(c)[i]) for c in range(2, 6))
                at = np.searchsorted(h, g)
                at[at == len(h)] = 0
                same = h[at] == g if len(h) else np.zeros(len(g), dtype=bool)
                sims[i] = v[same] @ w[at[same]]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["a", "b", "sim"])
            yield made.filter(pa.array(sims >= least))

    return run


def _similar_blocks(least: float):
    """The pairs of two blocks of rows at or above ``least``, by one product of matrices over the grams of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, ends, g, v), (others, stops, h, w) = ([_row(batch.column(c + k)[i]) for k in range(4)] for c in (2, 6))
                own = batch.column(0)[i] == batch.column(1)[i]
                grams = np.intersect1d(g, h)
                sides = []
                for rows, held, x in ((ends, g, v), (stops, h, w)):
                    at = np.minimum(np.searchsorted(grams, held), max(len(grams) - 1, 0))
                    same = grams[at] == held if len(grams) else np.zeros(len(held), dtype=bool)
                    dense = np.zeros((len(rows), len(grams)))
                    dense[np.repeat(np.arange(len(rows)), np.diff(rows, prepend=0))[same], at[same]] = x[same]
                    sides.append(dense)
                sims = sides[0] @ sides[1].T
                p, q = np.nonzero(np.triu(sims >= least, 1) if own else sims >= least)
                one, two = ids[p], others[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(sims[p, q])], names=["a", "b", "sim"])

    return run


def cosine_pairs(weights: DataFrame, least: float) -> DataFrame:
    """``a < b`` and ``sim`` of the pairs of unit rows, with numbers as ids, at or above ``least``, which must be above 0.

    Prefix filter: grams are ordered by how many rows hold them. What is left of a
    row behind a place of that order can add no more than its length to a
    similarity, so a pair at ``least`` shares a gram that comes before the rest's
    length falls below ``least``, in both rows. Only those are joined, the rare
    ones; the pairs they name are then summed over all grams of both rows. Rows
    stand in blocks of about ``BLOCK_ROWS``, alike ones together: where two blocks
    have many such pairs the blocks are multiplied, elsewhere each pair by itself.
    """
    bounded_batches(weights.sparkSession)
    weights = cut(weights.select(F.col("id").cast("long").alias("id"), "gram", "weight"), "weights")
    held = weights.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = cut(weights.join(held, "gram").select("id", F.xxhash64("gram").alias("h"), "df", "weight"), "shared")
    rest = F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id").orderBy(F.col("df").desc(), F.col("h").desc()).rowsBetween(Window.unboundedPreceding, 0))
    prefix = cut(shared.withColumn("rest", rest).where(F.col("rest") >= F.lit(least) * F.lit(least) - F.lit(1e-9)).select("id", "h"), "prefix")

    places = prefix.groupBy("id").agg(F.min("h").alias("least"))
    parts = places.groupBy("least").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    n_blocks = max(1, -(-places.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("least", F.pmod(F.xxhash64("id"), "parts")), F.lit(n_blocks))
    rows = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("h", "weight"))).alias("s"))
    rows = cut(rows.join(places.join(parts, "least").select("id", block.alias("block")), "id"), "rows")

    place = rows.select("id", "block")
    mine = prefix.join(place, "id")
    pairs = mine.withColumnsRenamed({"id": "a", "block": "ba"}).join(mine.withColumnsRenamed({"id": "b", "block": "bb"}), "h").where("a < b").select("a", "b", F.least("ba", "bb").alias("p"), F.greatest("ba", "bb").alias("q"))
    pairs = cut(pairs.distinct(), "candidates")
    dense = cut(pairs.groupBy("p", "q").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK_ROWS).select("p", "q"), "dense")

    side = lambda c, x, y: rows.select(F.col("id").alias(c), F.col("s.h").alias(x), F.col("s.weight").alias(y))
    apart = pairs.join(broadcast_if_small(dense), ["p", "q"], "left_anti").select("a", "b")
    single = apart.join(side("a", "ha", "wa"), "a").join(side("b", "hb", "wb"), "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(_similar(least), "a long, b long, sim double")

    packed = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "s"))).alias("rows"))
    ends = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: F.aggregate(F.slice("rows", F.lit(1), i), F.lit(0), lambda n, r: n + F.size(r["s"])))
    flat = F.flatten("rows.s")
    blocks = packed.select("block", F.col("rows.id").alias("ids"), ends.alias("ends"), F.transform(flat, lambda x: x["h"]).alias("h"), F.transform(flat, lambda x: x["weight"]).alias("w"))
    of = lambda c: blocks.select(F.col("block").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("ids", "ends", "h", "w")])
    met = dense.join(of("p"), "p").join(of("q"), "q").select("p", "q", *[f"{c}_{x}" for c in "pq" for x in ("ids", "ends", "h", "w")])
    return single.unionByName(met.mapInArrow(_similar_blocks(least), "a long, b long, sim double"))


@dataclass(frozen=True)
class Family:
    """Grams of a text: of ``least`` to ``most`` characters of each word between two spaces, or of as many words that follow each other."""

    name: str
    least: int
    most: int


CHARS, WORDS = Family("char", 2, 5), Family("word", 1, 2)


def _char_hashes(text: str, least: int, most: int) -> np.ndarray:
    """A number of 64 bits for every run of characters that crosses no word: a polynomial of its code points, mixed."""
    spaced = " ".join(w for w in re.split("[ \n]", text) if w)
    points = np.frombuffer(f" {spaced} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inner, made = points != 32, []
    value, whole = points.astype(np.uint64) + np.uint64(1), np.ones(len(points), dtype=bool)
    for n in range(2, most + 1):
        # A longer run has one more point; what was its last one now stands inside.
        value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
        whole = whole[:-1] & inner[n - 2 : -1] if n > 2 else whole[:-1]
        if n >= least:
            made.append(value[whole])
    h = np.concatenate(made)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def hashed(text: str | None, family: Family) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of a collapsed text, sorted, and how often each comes."""
    if not text or not text.strip(" \n"):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = _char_hashes if family.name == "char" else word_hashes
    return np.unique(of(text, family.least, family.most), return_counts=True)


def texts_once(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id`` and ``text``, collapsed; the texts of an id that repeats stand in lines of one row. Texts move only if some do."""
    docs = bounded_batches(rows.sparkSession) and rows.select(F.col(id_col).alias("id"), collapse(F.col(text)).alias("text"))
    if docs.groupBy("id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    return docs


def weighed(docs: DataFrame, families: tuple[Family, ...], sublinear: bool, fold: Callable[..., Iterator[dict[str, object]]], schema: str, n: int | None = None, then: tuple[Callable[..., Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """What ``fold(id, text, {family: (hashes, raw weights, counts)})`` yields for every row of ``docs`` (:func:`texts_once`).

    Frequencies are those of all rows, ``n`` if it is given. With a column ``counts``
    (whether a row counts for frequencies) and one ``asks`` (whether it is folded), they
    are those of the rows that count, and grams that these lack are left out. Texts are
    written once in chunks; grams move in packed buckets, once
    (:func:`counted.with_counts`). ``then`` is a function of the batches made so far and
    the schema of what it yields, run in the same task.
    """
    chosen = "counts" in docs.columns
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    sized = bounded_batches(docs.sparkSession) and docs.select("id", "text", *(["counts", "asks"] if chosen else []), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    chunks = cut(counted.chunked(sized, "size", COUNTED_GRAMS), "texts", FILE_CHUNKS)
    rows, size = chunks.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = rows if n is None else n
    # Texts hold about a third as many grams, told apart within a chunk, as characters.
    buckets = counted.bucket_count(size // 3, HELD_GRAMS)

    def read(table: pa.Table) -> list[tuple]:
        columns = [table.column(c).to_pylist() for c in table.schema.names if c != "size"]
        return [(*row, [hashed(row[1], f) for f in families]) for row in zip(*columns, strict=True)]

    def hashes(held: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        tables = []
        for k in range(len(families)):
            counting = np.concatenate([np.zeros(0, np.int64), *[r[-1][k][0] for r in held if not chosen or r[2]]])
            h, c = np.unique(counting, return_counts=True)
            if chosen:
                every = np.unique(np.concatenate([np.zeros(0, np.int64), *[r[-1][k][0] for r in held]]))
                at = np.searchsorted(every, h)
                known = np.zeros(len(every), np.int64)
                known[at] = c
                h, c = every, known
            tables.append((h, c))
        return tables

    def folded(held: list[tuple], tables: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in held:
            if chosen and not row[3]:
                continue
            made = {}
            for family, (h, tf), (every, total) in zip(families, row[-1], tables, strict=True):
                df = total[np.searchsorted(every, h)]
                if chosen:
                    h, tf, df = h[df > 0], tf[df > 0], df[df > 0]
                made[family] = h, (1 + np.log(tf) if sublinear else tf.astype(float)) * (np.log((1 + n) / (1 + df)) + 1), tf
            out += fold(row[0], row[1], made)
            if len(out) >= FOLDED_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    if then is None:
        return counted.with_counts(chunks, read, hashes, folded, schema, buckets)
    return counted.with_counts(chunks, read, hashes, folded, then[1], buckets, then[0])


def feature_totals(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id``, ``family``, ``n``, ``most``, ``total``: number, largest and sum of the sublinear weights of characters (2 to 5) and words (1 and 2), each family of length one."""
    docs = texts_once(rows, id_col, text)

    def fold(of: object, _: str, made: dict) -> Iterator[dict[str, object]]:
        for family, (h, raw, _) in made.items():
            if len(h):
                size = np.sqrt(raw @ raw)
                yield {"id": of, "family": family.name, "n": len(h), "most": float(raw.max() / size), "total": float((raw / size).sum())}

    return weighed(docs, (CHARS, WORDS), True, fold, f"id {docs.schema['id'].dataType.simpleString()}, family string, n long, most double, total double", rows.count())


def _packed_rows(size: int, entries: int = MET_ENTRIES):
    """Rows of grams in blocks of ``size`` rows and of ``entries`` grams at most, turned around: for each gram the rows that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        upto = 0

        def packed() -> pa.RecordBatch:
            ids, norms = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            h, tf, idf = (np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in ((2, np.int64), (3, np.int32), (4, np.float64)))
            of = np.repeat(np.arange(len(held)), [len(r[3]) // 4 for r in held])
            order = np.argsort(h, kind="stable")
            grams, first = np.unique(h[order], return_index=True)
            parts = [ids, norms, grams, idf[order][first], np.append(first, len(h)).astype(np.int32), of[order].astype(np.uint16), tf[order]]
            return pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["block", *_BLOCK])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if held and upto + len(row[3]) // 4 > entries:
                    yield packed()
                    held, upto = [], 0
                held.append(row)
                upto += len(row[3]) // 4
                if len(held) == size:
                    yield packed()
                    held, upto = [], 0
        if held:
            yield packed()

    return run


#: The setting of how many rows a product of two tables holds as objects; more are in memory that Spark counts and spills.
_BUFFERED = "spark.sql.cartesianProductExec.buffer.in.memory.threshold"
_BLOCK = {"ids": np.int64, "norms": np.float64, "grams": np.int64, "idf": np.float64, "starts": np.int32, "rows": np.uint16, "tf": np.int32}


def _products(one: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> np.ndarray:
    """Similarities of all rows of two blocks, summed over every gram of both.

    Grams that many rows hold go through matrices, the other ones product by product.
    """
    n, m = len(one["ids"]), len(two["ids"])
    _, at, of = np.intersect1d(one["grams"], two["grams"], assume_unique=True, return_indices=True)
    sides = []
    for side, places in ((one, at), (two, of)):
        first, counts = side["starts"][places].astype(np.int64), np.diff(side["starts"])[places].astype(np.int64)
        sides.append((side, first, counts, side["idf"][places]))
    met = sides[0][2] * sides[1][2]
    often = met * SCATTERED >= n * m

    def entries(side: dict[str, np.ndarray], first: np.ndarray, counts: np.ndarray, idf: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the gram, row and weight of everything that holds the chosen grams, and where each gram starts."""
        counts = counts[chosen]
        ends = np.cumsum(counts)
        gram = np.repeat(np.arange(len(chosen)), counts)
        held = np.arange(ends[-1]) + np.repeat(first[chosen] - ends + counts, counts)
        rows = side["rows"][held].astype(np.int64)
        return gram, rows, side["tf"][held] * idf[chosen][gram] / side["norms"][rows], ends - counts

    sims = np.zeros((n, m))
    dense = np.flatnonzero(often)
    for lo in range(0, len(dense), MATRIX_GRAMS):
        chosen, pair = dense[lo : lo + MATRIX_GRAMS], []
        for side in sides:
            gram, rows, w, _ = entries(*side, chosen)
            x = np.zeros((len(side[0]["ids"]), len(chosen)))
            x[rows, gram] = w
            pair.append(x)
        sims += pair[0] @ pair[1].T
    sparse = np.flatnonzero(~often)
    upto = np.cumsum(met[sparse])
    lo = 0
    while lo < len(sparse):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PRODUCTS, side="right")))
        chosen = sparse[lo:hi]
        (gram, rows, w, _), (_, others, v, starts) = (entries(*side, chosen) for side in sides)
        times = sides[1][2][chosen][gram]
        ends = np.cumsum(times)
        partner = np.arange(ends[-1]) + np.repeat(starts[gram] - ends + times, times)
        sims += np.bincount(np.repeat(rows * m, times) + others[partner], np.repeat(w, times) * v[partner], n * m).reshape(n, m)
        lo = hi
    return sims


def _met_above(least: float):
    """The pairs of two blocks at or above ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = [{name: np.frombuffer(batch.column(2 + side * len(_BLOCK) + k)[i].as_buffer(), kind) for k, (name, kind) in enumerate(_BLOCK.items())} for side in range(2)]
                sims = _products(*blocks)
                own = batch.column(0)[i] == batch.column(1)[i]
                p, q = np.nonzero(np.triu(sims >= least, 1) if own else sims >= least)
                for lo in range(0, len(p), SENT_PAIRS):
                    some = p[lo : lo + SENT_PAIRS], q[lo : lo + SENT_PAIRS]
                    one, two = blocks[0]["ids"][some[0]], blocks[1]["ids"][some[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(sims[some])], names=["a", "b", "sim"])

    return run


def alike_by_chars(rows: DataFrame, id_col: str, text: str, least: float, family: Family = Family("char", 3, 5)) -> DataFrame:
    """``a < b`` and ``sim`` of the pairs of texts at or above ``least``, which must be above 0, by weights of their characters.

    Ids are numbers, one a row. For texts where a share of all pairs is alike, so that
    no filter can spare them: rows stand in blocks that meet once, and the work grows
    with the square of the rows, as the result does. Grams are counted within their
    row (:func:`weighed`); those of one row alone count in its length and go no further.
    """
    docs = texts_once(rows, id_col, text)
    n = docs.count()
    single = np.log((1 + n) / 2) + 1

    def fold(of: object, _: str, made: dict) -> Iterator[dict[str, object]]:
        h, raw, tf = made[family]
        if len(h):
            idf = raw / tf
            kept = idf < single - 1e-12
            yield {"id": of, "norm": float(np.sqrt(raw @ raw)), "h": h[kept].tobytes(), "tf": tf[kept].astype(np.int32).tobytes(), "idf": idf[kept].tobytes()}

    packed = _packed_rows(MET_ROWS, MET_ENTRIES), f"block long, {', '.join(f'{c} binary' for c in _BLOCK)}"
    # A block a file: neither writer nor reader holds several.
    blocks = cut(weighed(docs, (family,), False, fold, "id long, norm double, h binary, tf binary, idf binary", n, packed), "blocks", 1)
    met = _met_once(blocks)
    return met.mapInArrow(_met_above(least), "a long, b long, sim double")


def _met_once(blocks: DataFrame) -> DataFrame:
    """Every two ``blocks`` once, and each with itself, in order ``a``, ``b``.

    Both sides are read where they are written, so nothing is shuffled, and what is
    on disk grows with the rows, not with their pairs. Which of two stands first goes
    by a hash, so every task has its share.
    """
    blocks.sparkSession.conf.set(_BUFFERED, "1")
    a, b = (blocks.select(F.col("block").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in _BLOCK]) for c in "ab")
    first = F.pmod(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), F.lit(2)) == 0
    met = a.join(b.hint("shuffle_replicate_nl"), (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == first))
    return met.select("a", "b", *[f"{c}_{x}" for c in "ab" for x in _BLOCK])


def top_words(rows: DataFrame, id_col: str, text: str, k: int, digits: int = 9) -> DataFrame:
    """``id``, ``gram``, ``weight`` of the ``k`` heaviest words of every row, and of those that equal the last of them to ``digits``."""
    family = Family("word", 1, 1)
    docs = texts_once(rows, id_col, text)

    def fold(of: object, text: str, made: dict) -> Iterator[dict[str, object]]:
        h, raw, _ = made[family]
        if len(h):
            weights = raw / np.sqrt(raw @ raw)
            least = np.partition(weights, -k)[-k] if len(weights) > k else 0.0
            near = weights >= least - 2 * 10.0**-digits
            wanted = dict(zip(h[near].tolist(), weights[near].tolist(), strict=True))
            words = [w for w in re.split("[ \n]", text) if w]
            of_word = dict(zip(word_hashes(text, 1, 1).tolist(), words, strict=True))
            yield from ({"id": of, "gram": of_word[x], "weight": w} for x, w in wanted.items())

    return weighed(docs, (family,), False, fold, f"id {docs.schema['id'].dataType.simpleString()}, gram string, weight double", rows.count())


def sparse_vector(slots: Column, values: Column, size: int = FEATURES) -> Column:
    """A sparse vector of sorted slots and their values, by expressions alone: the parser of JSON makes the type from its fields."""
    fields = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), slots.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]


def linear_vectors(rows: DataFrame, train: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """``id`` and a sparse vector of the sublinear weights of both families, each of length one; grams that hash alike are added.

    Frequencies are those of ``train``, of ``n`` rows; grams that it lacks are left out.
    """
    side = lambda part, counts: texts_once(part, id_col, text).withColumns({"counts": F.lit(counts), "asks": F.lit(not counts)})
    docs = side(rows, False).unionByName(side(train, True))

    def fold(of: object, _: str, made: dict) -> Iterator[dict[str, object]]:
        sides = [(h % (FEATURES // 2) + k * (FEATURES // 2), raw / np.sqrt(raw @ raw)) for k, (h, raw, _) in enumerate(made.values()) if len(h)]
        if sides:
            slots, at = np.unique(np.concatenate([x for x, _ in sides]), return_inverse=True)
            yield {"id": of, "slots": slots.astype(np.int32), "weights": np.bincount(at, np.concatenate([w for _, w in sides]))}

    made = weighed(docs, (CHARS, WORDS), True, fold, f"id {docs.schema['id'].dataType.simpleString()}, slots array<int>, weights array<double>", n)
    return made.select("id", sparse_vector(F.col("slots"), F.col("weights")).alias("features"))


def tuned_classifier(rows: DataFrame, id_col: str, text: str, label: str, part: str, strengths: tuple[float, ...] = STRENGTHS, iterations: int = 60) -> tuple[np.ndarray, float, DataFrame]:
    """Balanced logistic regression on the weights of ``linear_vectors``, its strength chosen by macro-F1 on a validation part.

    ``part`` is ``train``, ``val`` or ``test``; document frequencies are those of the
    training rows. Returns the model, the strength, and packed rows (:mod:`linear`) of
    all parts, which are written once and read in every step: nothing else is kept.
    Rows without a gram of the training rows have zeros only.
    """
    train = rows.where(F.col(part) == "train")
    n = train.count()
    named = rows.withColumn("_row", F.struct(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label"), F.col(part).alias("part")))
    docs = texts_once(named, "_row", text).withColumns({"counts": F.coalesce(F.col("id.part") == "train", F.lit(False)), "asks": F.lit(True)})

    def fold(of: dict, _: str, made: dict) -> Iterator[dict[str, object]]:
        sides = []
        for k, (h, raw, _) in enumerate(made.values()):
            slots = h % (FEATURES // 2) + k * (FEATURES // 2)
            order = np.argsort(slots, kind="stable")
            sides.append((slots[order].astype(np.int32), raw[order]))
        yield {"id": of, "slots": np.concatenate([x for x, _ in sides]), "values": np.concatenate([v for _, v in sides]), "first": len(sides[0][0]), "norms": [float(np.sqrt(v @ v)) or 1.0 for _, v in sides]}

    made = weighed(docs, (CHARS, WORDS), True, fold, f"id {docs.schema['id'].dataType.simpleString()}, slots array<int>, values array<double>, first int, norms array<double>", n, (linear.packed_rows, linear.PACKED))
    made = cut(made, "features", FILE_CHUNKS)
    counts = class_weights(rows.where(F.col(part) == "train").select(F.col(label).cast("double").alias("label"))).collect()  # a row a class
    weights = {r["label"]: r["weight"] for r in counts}
    # The penalty of a sum of losses, restated for the mean of them; balanced weights sum to the rows.
    models = linear.fitted(made.where("part = 'train'"), weights, sum(r["n"] * r["weight"] for r in counts), [1 / (s * max(n, 1)) for s in strengths], FEATURES, iterations)
    best: tuple[np.ndarray, float, float] | None = None
    for strength, model in zip(strengths, models, strict=True):
        judged = classify(model, made.where("part = 'val'"), rows.schema[id_col].dataType.simpleString())
        score = macro_scores(judged).first()["macro_f1"] or 0.0
        if best is None or score > best[2]:
            best = model, strength, score
    return best[0], best[1], made


def classify(model: np.ndarray, rows: DataFrame, id_type: str) -> DataFrame:
    """``id``, ``label``, ``probability`` of label 1 and ``pred`` of packed rows."""
    made = linear.probabilities(rows, model, id_type)
    return made.select("id", F.col("label").cast("int").alias("label"), "probability", (F.col("probability") > 0.5).cast("int").alias("pred"))
