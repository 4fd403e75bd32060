"""Contamination scan: passages, texts, ids and terms of a bank that a corpus repeats.

A bank of bounded bytes is one automaton that every task runs over its texts, so
nothing of the corpus is exploded or moved. A larger bank meets the corpus in joins
of hashes. Both are exact and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import collapse, windows, words_of
from lexmill.operators.sized import BROADCAST_BYTES, broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut

#: Words of a passage, characters of a text that counts whole, row ids that a text may mention.
WIDTH = 7
LEAST_CHARS = 15
MOST_IDS = 4
ROW_ID = "[a-z]+-[0-9]{3,}"
#: Bytes of needles up to which they are an automaton (some 50 times as large), and of each piece of it.
NEEDLE_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
#: Bytes of a text that a task matches at once.
TEXT_BYTES = 1 << 20


def _hashed_windows(rows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    runs = F.array_distinct(windows(words_of(F.col(text_col)), width))
    return rows.select(id_col, F.explode(runs).alias("run")).select(id_col, "run", F.xxhash64("run").alias("h"))


def _needles(bank: DataFrame, text_col: str, width: int, least_chars: int) -> DataFrame:
    """Distinct ``needle`` by ``kind``: passages (1) with the spaces around them, and whole texts (0)."""
    norm = bank.select(collapse(F.col(text_col)).alias("norm")).where("norm is not null")
    passages = norm.select(F.lit(1).alias("kind"), F.explode(windows(F.split("norm", " "), width)).alias("run")).select("kind", F.concat(F.lit(" "), "run", F.lit(" ")).alias("needle"))
    return norm.where(F.length("norm") >= least_chars).select(F.lit(0).alias("kind"), F.col("norm").alias("needle")).unionByName(passages).distinct()


def scanned(corpus: DataFrame, bank: DataFrame, corpus_id: str, bank_text: str = "text", corpus_text: str = "text", width: int = WIDTH, least_chars: int = LEAST_CHARS, most_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """``n_texts`` and ``n_windows`` of every row: distinct texts of the bank that it contains, and distinct passages of ``width`` words that it shares.

    Texts are normalised on both sides; null texts hold nothing. ``corpus_id`` is unique.
    """
    needles = cut(_needles(bank, bank_text, width, least_chars), "needles")
    if (needles.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) > most_bytes:
        passages = shared_windows(corpus, bank, corpus_id, bank_text, corpus_text, width, most_bytes=0)
        items = bank.select(F.col(bank_text).alias("text"), F.xxhash64(collapse(F.col(bank_text))).alias("item")).dropDuplicates(["item"])
        texts = contained_texts(corpus.withColumnRenamed(corpus_text, "text"), items, corpus_id, "item", least_chars, width).groupBy(corpus_id).agg(F.count("*").alias("n_texts"))
        return corpus.select(corpus_id).join(texts, corpus_id, "left").join(passages, corpus_id, "left").na.fill(0, ["n_texts", "n_windows"]).select(corpus_id, "n_texts", "n_windows")
    pieces, size = [[]], 0
    for r in needles.orderBy("kind", "needle").collect():  # most_bytes at most
        size += len(r["needle"])
        if size > PIECE_BYTES and pieces[-1]:
            pieces.append([])
            size = len(r["needle"])
        pieces[-1].append((r["needle"], r["kind"]))
    send = corpus.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = []
        for piece in send.value:
            machine = ahocorasick.Automaton()
            for place, (needle, kind) in enumerate(piece):
                machine.add_word(needle, (kind, place))
            machine.make_automaton()
            if len(machine):
                machines.append(machine)
        own, seen = None, [set() for _ in machines]
        for batch in batches:
            rows, counts = [], []
            for i in range(batch.num_rows):
                place, last = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                if place == 0:
                    own, seen = batch.column(0).slice(i, 1), [set() for _ in machines]
                # A piece starts and ends anywhere in its bytes: what is left of a character there is in the next piece too.
                if (piece := batch.column(3)[i]).is_valid:
                    text = (" " if place == 0 else "") + piece.as_py().decode("utf-8", "ignore") + (" " if last else "")
                    for machine, hits in zip(machines, seen, strict=True):
                        hits.update(hit for _, hit in machine.iter(text))
                if last:
                    rows.append(own)
                    kinds = [kind for hits in seen for kind, _ in hits]
                    counts.append((kinds.count(0), kinds.count(1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], names=[corpus_id, "n_texts", "n_windows"])

    kind = corpus.select(corpus_id).schema[0].dataType.simpleString()
    # Long texts come in pieces that overlap by the longest needle, one after the other, so no task of Python holds one whole.
    overlap = max((len(needle.encode()) for piece in pieces for needle, _ in piece), default=0)
    norm = bounded_batches(corpus.sparkSession) and corpus.select(corpus_id, F.encode(collapse(F.col(corpus_text)), "utf-8").alias("norm"))
    count = F.greatest(F.ceil(F.coalesce(F.octet_length("norm"), F.lit(0)) / TEXT_BYTES), F.lit(1)).cast("int")
    placed = norm.select(corpus_id, "norm", count.alias("_n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_at"))
    piece = F.substring("norm", F.col("_at") * TEXT_BYTES + 1, F.lit(TEXT_BYTES + overlap))
    return placed.select(corpus_id, "_at", (F.col("_at") == F.col("_n") - 1).alias("_last"), piece.alias("_piece")).mapInArrow(run, f"`{corpus_id}` {kind}, n_texts long, n_windows long")


def known_ids(corpus: DataFrame, ids: DataFrame, corpus_id: str, id_col: str = "id", corpus_text: str = "text") -> DataFrame:
    """``n_ids``: distinct ids of the data set, without regard to case, that a text mentions; texts that mention none have no row."""
    known = broadcast_if_small(ids.select(F.lower(id_col).alias("_id")).distinct())
    words = F.array_distinct(F.regexp_extract_all(collapse(F.col(corpus_text)), F.lit(ROW_ID), F.lit(0)))
    mentioned = corpus.select(corpus_id, F.explode(words).alias("_id")).join(known, "_id", "left_semi")
    return mentioned.groupBy(corpus_id).agg(F.count("*").alias("n_ids"))


def verdict(corpus: DataFrame, bank: DataFrame, ids: DataFrame, terms: tuple[str, ...], corpus_id: str, bank_text: str = "text", id_col: str = "id", corpus_text: str = "text", most_ids: int = MOST_IDS) -> DataFrame:
    """Every text with all reasons why it may leak the bank: ``n_texts``, ``n_windows``, ``n_ids``, ``n_terms``, and whether it does.

    One text or passage of the bank or one listed term is enough; ids of the bank
    count if there are more than ``most_ids``.
    """
    found = scanned(corpus, bank, corpus_id, bank_text, corpus_text).join(known_ids(corpus, ids, corpus_id, id_col, corpus_text), corpus_id, "left").na.fill(0, ["n_ids"])
    if terms:
        listed = corpus.select(corpus_id, F.coalesce(F.size(listed_terms(collapse(F.col(corpus_text)), terms)), F.lit(0)).cast("long").alias("n_terms"))
        found = found.join(listed.where("n_terms > 0"), corpus_id, "left").na.fill(0, ["n_terms"])
    else:
        found = found.withColumn("n_terms", F.lit(0).cast("long"))
    leaks = (F.col("n_texts") > 0) | (F.col("n_windows") > 0) | (F.col("n_terms") > 0) | (F.col("n_ids") > most_ids)
    return found.select(corpus_id, "n_texts", "n_windows", "n_ids", "n_terms", leaks.alias("leaks"))


def shared_windows(corpus: DataFrame, bank: DataFrame, corpus_id: str, bank_text: str = "text", corpus_text: str = "text", width: int = WIDTH, most_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """Distinct windows of ``width`` words of each text that the bank holds too, counted by text.

    A bank of more than ``most_bytes`` is matched by hash first, then by text, so the
    corpus is exploded but not shuffled as long as the windows can be broadcast.
    """
    if most_bytes:
        return scanned(corpus, bank, corpus_id, bank_text, corpus_text, width, most_bytes=most_bytes).where("n_windows > 0").select(corpus_id, "n_windows")
    runs = bank.select(F.explode(windows(words_of(F.col(bank_text)), width)).alias("run")).distinct()
    side = broadcast_if_small(runs.select(F.xxhash64("run").alias("h"), F.col("run").alias("bank_run")), most_bytes=BROADCAST_BYTES)
    ours = _hashed_windows(corpus, corpus_id, corpus_text, width)
    hits = ours.join(side, (ours["h"] == side["h"]) & (ours["run"] == side["bank_run"]), "left_semi")
    return hits.groupBy(corpus_id).agg(F.count("*").alias("n_windows"))


def contained_texts(corpus: DataFrame, bank: DataFrame, corpus_id: str, bank_id: str, least_chars: int = LEAST_CHARS, width: int = WIDTH) -> DataFrame:
    """Pairs of a bank text of ``least_chars`` characters or more and a corpus text that contains it, both normalised.

    A contained text may start and end inside a word, so its outer words are no
    evidence; the words between them stand whole in the text that contains it. Up
    to ``width`` of them make a probe. Texts of two words or one are probed by
    their first ``least_chars`` characters. Hashes of probes and of what a text holds
    are joined; texts themselves are joined only for the pairs that agree in one.
    """
    items = bank.select(F.col(bank_id).alias("_b"), collapse(F.col("text")).alias("_item")).where(F.length("_item") >= least_chars)
    words = F.split("_item", " ")
    inner = F.greatest(F.least(F.size(words) - 2, F.lit(width)), F.lit(0))  # 0: too few words
    probe = F.when(inner > 0, F.array_join(F.slice(words, F.lit(2), F.greatest(inner, F.lit(1))), " ")).otherwise(F.substring("_item", 1, least_chars))
    items = cut(items.select("_b", "_item", inner.alias("_w"), F.xxhash64(inner, probe).alias("_h")), "items")
    sizes = sorted(r["_w"] for r in items.select("_w").distinct().collect())  # width + 1 values at most
    if not sizes:
        return corpus.limit(0).select(F.lit(None).cast(bank.schema[bank_id].dataType).alias(bank_id), corpus_id)
    ours = corpus.select(F.col(corpus_id).alias("_c"), collapse(F.col("text")).alias("_norm"))

    def runs(w: int) -> Column:
        """Hashes of all runs of ``w`` words of a text, for 0 of ``least_chars`` characters."""
        if w:
            return F.transform(windows(F.split("_norm", " "), w), lambda r: F.xxhash64(F.lit(w), r))
        places = F.sequence(F.lit(1), F.greatest(F.length("_norm") - least_chars + 1, F.lit(1)))
        return F.transform(places, lambda i: F.xxhash64(F.lit(0), F.substring("_norm", i, F.lit(least_chars))))

    held = ours.select("_c", F.explode(F.array_distinct(F.concat(*map(runs, sizes)))).alias("_h"))
    near = cut(held.join(broadcast_if_small(items.select("_b", "_h")), "_h").select("_b", "_c").distinct(), "candidates")
    met = ours.join(broadcast_if_small(near), "_c").join(broadcast_if_small(items.select("_b", "_item"), most_bytes=BROADCAST_BYTES), "_b")
    return met.where(F.col("_norm").contains(F.col("_item"))).select(F.col("_b").alias(bank_id), F.col("_c").alias(corpus_id)).distinct()


def listed_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Distinct listed terms, as regular expressions without regard to case, that a text holds."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("|".join(t.lower() for t in terms)), F.lit(0)))
