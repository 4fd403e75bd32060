"""SentencePiece models on the ``tokenizers`` backend.

The model's protobuf is parsed here, field by field, and rebuilt as a tokenizer
of that library: normaliser, metaspace marker, scores (as a unigram lattice, or
as the merge order of a BPE model) and byte fallback. Batches are encoded by
several threads; ids can be verified against the original implementation.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.shared import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
BATCH_TEXTS = 256
MARK = "▁"
#: Words whose ids a worker remembers; then it starts anew.
MEMORY_WORDS = 150_000
#: New words that are encoded as one line.
LINE_WORDS = 2000

# Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield number, value


def parse_model(data: bytes) -> Model:
    """The parts of a serialized SentencePiece model that encoding needs."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.model_type = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unk_id = trainer.get(40, 0)
        elif number == 3:
            normal = dict(_fields(value))
            model.charsmap = normal.get(2, b"")
            model.dummy_prefix = bool(normal.get(3, 1))
            model.squeeze_spaces = bool(normal.get(4, 1))
            model.escape_spaces = bool(normal.get(5, 1))
    return model


def _merges(model: Model, vocab: dict[str, int]) -> list[tuple[str, str]]:
    """Pairs that a BPE model joins, best score first."""
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted(((-score, vocab[p], p) for p, score, kind in model.pieces if kind == NORMAL and len(p) > 1), key=lambda x: x[:2])
    pairs = []
    for _, _, piece in ranked:
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
        pairs += sorted(splits, key=lambda s: (vocab[s[0]], vocab[s[1]]))
    return pairs


def build(model: Model):
    """The model as a ``tokenizers.Tokenizer``; raises where that library has no equal part."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    if model.model_type == BPE:
        inner = models.BPE(vocab=vocab, merges=_merges(model, vocab), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0)
    elif model.model_type == UNIGRAM:
        inner = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    made = Tokenizer(inner)
    made.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        # No piece has the marker after another character: words can be cut apart, which lets the backend cache them.
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    back = [decoders.Replace(MARK, " "), *([decoders.ByteFallback()] if model.byte_fallback else []), decoders.Fuse()]
    made.decoder = decoders.Sequence([*back, *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return made


@lru_cache(maxsize=2)
def load(path: str, threads: int = THREADS):
    """Tokenizer of a model file, for this process; encodes batches with ``threads`` threads."""
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    with open(path, "rb") as f:
        return build(parse_model(f.read()))


@lru_cache(maxsize=2)
def _original(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Encoder:
    """Ids of batches of texts, with the checks that every word passed.

    Where words can be cut apart (see :func:`build`), a text is the sequence of
    its words, so each distinct word is encoded, decoded and verified once and
    remembered; texts whose spaces are not single are handled whole.
    """

    def __init__(self, path: str, threads: int, verify: bool):
        self.tokenizer, self.threads = load(path, threads), threads
        self.original = _original(path) if verify else None
        tokens = self.tokenizer.encode("a", add_special_tokens=False).tokens
        self.by_word = self.tokenizer.pre_tokenizer is not None and tokens[0].startswith(MARK)
        pieces = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(pieces.values()) + 1, bool)
        self.opens[[i for p, i in pieces.items() if p.startswith(MARK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends, self.trips, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.ones(0, bool), np.ones(0, bool)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, lengths, whether decoding gives the text again, whether the original agrees."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        same = [True] * len(ids) if self.original is None else map(eq, ids, self.original.encode(texts, num_threads=self.threads))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        return flat, lengths, np.fromiter(map(eq, texts, back), bool, len(ids)), np.fromiter(same, bool, len(ids))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_encode`, of many words at once: lines of words, cut again where a piece starts with the marker."""
        lines = [" ".join(words[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)]
        flat, _, trips, same = self._encode(lines)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(words) or not trips.all() or not same.all():
            return self._encode(words)
        sure = np.ones(len(words), bool)
        return flat, np.diff(np.append(starts, len(flat))), sure, sure

    def __call__(self, texts: list[str]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Ids by text, and by text whether it makes the round trip and whether the original agrees."""
        simple = np.array([self.by_word and bool(t) and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t for t in texts], bool)
        words = [t.split(" ") if ok else () for t, ok in zip(texts, simple, strict=True)]
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        flat = list(chain.from_iterable(words))
        if fresh := list(set(flat).difference(self.known)):
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            more, lengths, trips, same = self._encode_words(fresh)
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))
            self.ids, self.trips, self.same = np.concatenate((self.ids, more)), np.concatenate((self.trips, trips)), np.concatenate((self.same, same))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        whole, whole_lengths, whole_trips, whole_same = self._encode([t for t, ok in zip(texts, simple, strict=True) if not ok])

        first, sizes = self.ends[at], self.ends[at + 1] - self.ends[at]
        stops = np.cumsum(sizes)
        gathered = self.ids[np.repeat(first - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)]
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        upto = np.concatenate(([0], stops))[bounds]
        lengths = np.diff(upto)
        lengths[~simple] = whole_lengths
        trips, same = np.ones(len(texts), bool), np.ones(len(texts), bool)
        for i in np.flatnonzero(simple) if not (self.trips.all() and self.same.all()) else ():
            mine = at[bounds[i] : bounds[i + 1]]
            trips[i], same[i] = self.trips[mine].all(), self.same[mine].all()
        trips[~simple], same[~simple] = whole_trips, whole_same
        owner = np.repeat(simple, lengths)
        out = np.empty(len(owner), np.int32)
        out[owner], out[~owner] = gathered, whole
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out)), trips, same


@lru_cache(maxsize=2)
def _encoder(path: str, threads: int, verify: bool) -> Encoder:
    return Encoder(path, threads, verify)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, threads: int = THREADS, verify: bool = True) -> DataFrame:
    """Token ids of whole texts and whether they decode to the text again.

    Returns ``doc_id``, ``n_tokens``, ``token_ids``, ``round_trip`` (decoding gives
    the very text; a text with the marker character itself does not) and, with
    ``verify``, ``parity``: the original implementation gives the same ids, for
    each word or, where words cannot be cut apart, for the text. One row per input
    row, repeated ones included; null and empty texts have no tokens; texts are
    encoded whole, however long; an empty table gives an empty result; other columns
    are ignored. ``model`` is a path on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model, threads, verify)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(lo, BATCH_TEXTS)
                ids, trips, same = encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pc.list_value_length(ids).cast(pa.int64()), ids, pa.array(trips), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns[: 4 + verify], names=["doc_id", "n_tokens", "token_ids", "round_trip", "parity"][: 4 + verify])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean" + (", parity boolean" if verify else ""))


def decode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``doc_id`` and ``text`` of arrays of token ids; null arrays give null, empty ones the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(model, threads)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op5_tokenizers_backend(spark, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded where they lie."""
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
