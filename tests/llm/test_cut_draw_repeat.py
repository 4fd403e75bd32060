"""Fill-in-the-middle, importance resampling and removal of repeated passages against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import fill_middle, importance, substring_dedup
from lexmill.llm.fill_middle import OP11_SQL, fill_in_middle, op11_relational_fim, restored
from lexmill.llm.importance import OP12_SQL, hashed_words, op12_target_resampling, resample
from lexmill.llm.substring_dedup import OP13_SQL, drop_repeats, op13_block_anchors, runs
from tests.oracle import check

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEXEME = re.compile(rb"[0-9a-z\x80-\xff]+")


@pytest.mark.parametrize("query, sql", [(op11_relational_fim, OP11_SQL), (op12_target_resampling, OP12_SQL), (op13_block_anchors, OP13_SQL)])
def test_equals_sql(spark, sf_dir, query, sql):
    check(spark, sf_dir, query, sql)


# Fill-in-the-middle


def plain_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, z = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, n, form, len(a), len(m), f"<P>{a}<S>{z}<M>{m}" if form == "psm" else f"<S>{z}<P>{a}<M>{m}"


def _fim_rows(rng):
    pieces = ["one", "zwei", "drei\t", "  ", "\n\n", "çà", "😀", "<P", "S>", "<", "\x85", " ", "　x", "-"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(12)))) for i in range(300)]
    return [*rows, (1, "has <M> inside"), (2, None), (None, "no id, three  "), (None, "no id, three  "), *[(7, "one text many times over ")] * 600]


def test_samples_equal_a_plain_version(spark, monkeypatch):
    rows = _fim_rows(random.Random(4))
    want = Counter(plain_fim(*r) for r in rows)
    for copies in (256, 7):
        monkeypatch.setattr(fill_middle, "COPIES", copies)
        made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(map(tuple, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())) == want


def test_samples_are_turned_back(spark):
    rows = _fim_rows(random.Random(5))
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", restored(F.col("output"), F.col("form")))
    found = Counter((r["doc_id"], r["back"]) for r in made.collect())
    assert found == Counter((i, t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r["form"] for r in made.select("form").distinct().collect()}


# Importance resampling


def plain_buckets(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [zlib.crc32(w) % importance.BUCKETS for w in LEXEME.findall(data)]


def plain_resample(rows, target, least=20, percent=10):
    found = [plain_buckets(t) for _, t in rows]
    s, t = Counter(b for x in found for b in x), Counter(b for x in target for b in plain_buckets(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    scored = []
    for (doc_id, _), x in zip(rows, found, strict=True):
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = defaultdict(list)
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        place[r].append(k)
    return Counter((*r, place[r].pop() if place[r] else None) for r in scored)


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aZ09 -_~\x7f\x00ßé😀[@`{"), max_size=30)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_checksums_equal_a_plain_scan(texts):
    bounds, buckets = hashed_words(pa.array(texts, pa.string()))
    assert [list(buckets[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain_buckets(t) for t in texts]


def test_long_words_are_hashed_whole():
    texts = ["a" * 64, "b" * 65, "c" * 5000 + " " + "d" * 70, "x"]
    bounds, buckets = hashed_words(pa.array(texts).slice(1))
    assert list(buckets) == [b for t in texts[1:] for b in plain_buckets(t)] and list(bounds) == [0, 1, 3, 4]


def test_draw_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(rng.randrange(150), " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for _ in range(250)]
    rows += [(None, None), (3, ""), (4, "--- ..."), *[(5, "same words " * 30)] * 90, (None, "target word " * 20)]
    target = [" ".join(rng.choices(vocabulary[:9], k=40)) for _ in range(5)] + [None]
    want = plain_resample(rows, target)
    for copies in (4096, 4):
        monkeypatch.setattr(importance, "COPIES", copies)
        made = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"))
        assert Counter(map(tuple, made.select("doc_id", "n_features", "weight", "score", "rank").collect())) == want


def test_draw_prefers_the_target(spark):
    rows = [(i, ("alpha beta " if i % 4 else "gamma delta ") * 15) for i in range(400)]
    made = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("gamma delta " * 50,)], "text string")).where("rank is not null")
    drawn = [r["doc_id"] for r in made.collect()]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) >= 36


# Repeated passages


def plain_repeats(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    starts = defaultdict(list)
    for d, w in enumerate(words):
        for p in range(len(w) - window + 1):
            starts[tuple(w[p : p + window])].append((d, p))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for d, p in places:
                gone[d].update(range(p, p + window))
    return Counter((i, len(w), len(gone[d]), " ".join(x for p, x in enumerate(w) if p not in gone[d])) for d, ((i, _), w) in enumerate(zip(rows, words, strict=True)))


def _passages(rng, window):
    fresh = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(k) for k in (window - 1, window, window + 1, 2 * window, 5 * window)]
    rows = []
    for i in range(150):
        parts = [fresh(rng.randrange(2 * window))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), fresh(rng.randrange(window))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(x for p in parts for x in p)))
    near = " ".join(fresh(3 * window))
    rows += [(200 + k, near.replace(near.split(" ")[k % len(near.split(" "))], "other")) for k in range(20)]
    rows += [(300, "la " * (3 * window)), (301, "la " * (window - 1)), (302, None), (None, ""), (None, near), *[(303, " ".join(shared[4]))] * 5, *[(310 + k, "short copies") for k in range(9)]]
    return rows


@pytest.mark.parametrize("window", [35, 6, 1])
def test_repeats_equal_a_plain_version(spark, window):
    rows = _passages(random.Random(window), window)
    made = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window)
    assert Counter(map(tuple, made.select("doc_id", "n_words", "n_removed", "kept").collect())) == plain_repeats(rows, window)


@pytest.mark.parametrize("setting, value", [("MOST_BITS", 1 << 16), ("MOST_BITS", 4), ("broadcast", None)])
def test_full_or_absent_filters_lose_nothing(spark, monkeypatch, setting, value):
    """Crowded bitmaps let more through, none lets all through, and copies may be too many for a broadcast."""
    if setting == "broadcast":
        monkeypatch.setattr(substring_dedup, "broadcast_if_small", lambda t: t)
    else:
        monkeypatch.setattr(substring_dedup, setting, value)
    rows = _passages(random.Random(9), 35)
    made = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, made.select("doc_id", "n_words", "n_removed", "kept").collect())) == plain_repeats(rows, 35)


@pytest.mark.parametrize("width", [1, 2, 3, 18, 35, 64])
def test_runs_hash_their_words_and_nothing_else(width):
    words = np.array([5, 7, 5, 7, 9] * 30, dtype=np.uint64)
    found = runs(words, width, substring_dedup._MULTS[0])
    assert len(found) == len(words) - width + 1
    by = defaultdict(set)
    for i, h in enumerate(found):
        by[tuple(words[i : i + width])].add(h)
    assert all(len(h) == 1 for h in by.values()) and len(set.union(*by.values())) == len(by)
    assert not len(runs(words[: width - 1], width, substring_dedup._MULTS[0]))


# Odd rows


def test_odd_rows(spark, odd, none):
    assert fill_in_middle(odd).count() == odd.count() == drop_repeats(odd).count() == resample(odd, odd).count()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, fill_in_middle(odd).collect())) == Counter(plain_fim(*r) for r in texts)
    assert Counter(map(tuple, drop_repeats(odd).collect())) == plain_repeats(texts, 35)
    assert Counter(map(tuple, resample(odd, odd).collect())) == plain_resample(texts, [t for _, t in texts])
    clashing = odd.withColumns({c: F.lit(1).cast("long") for c in ("_k1", "k1", "n", "form", "lo", "copied", "first", "places", "weight", "rank", "copies", "part", "a.b")})
    assert Counter(map(tuple, fill_in_middle(clashing).collect())) == Counter(plain_fim(*r) for r in texts)
    assert drop_repeats(clashing).count() == resample(clashing, clashing).count() == odd.count()
    assert not fill_in_middle(none).count() and not drop_repeats(none).count() and not resample(none, odd).count()
    assert all(r["weight"] <= 0 or r["n_features"] for r in resample(odd, none).collect())
