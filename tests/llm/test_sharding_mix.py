from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import sharding
from lexmill.llm.sharding import external_shuffle, op4_external_shuffle, shard_of, write_shards
from lexmill.llm.source_mix import OP8_SQL, apply_mix, mix_sources, op8_golden_mix
from tests.oracle import check


def test_shards_hold_every_row_once(spark, sf_dir, docs):
    rows = op4_external_shuffle(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key" and 0 <= r["shard"] < 24
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op4_external_shuffle(spark, sf_dir).collect()))


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2000])
def test_small_buckets_keep_slots_gapless(spark, docs, bucket_bytes, tmp_path):
    made = external_shuffle(docs, n_shards=3, bucket_bytes=bucket_bytes)
    slots = defaultdict(list)
    for r in made.select("shard", "slot", "bucket").collect():
        slots[r["shard"]].append((r["slot"], r["bucket"]))
    assert sum(map(len, slots.values())) == docs.count()
    for s in slots.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s))) and [b for _, b in sorted(s)] == sorted(b for _, b in s)
    write_shards(made, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("record.*").collect())) == sorted(map(tuple, docs.collect())) and {"shard", "slot"} <= set(back.columns)


def hashed(*values):
    """The engine's 64-bit hash of numbers and strings: each value is hashed with the hash before it as seed."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v
        h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def whole(number, size=4):
    return int(number).to_bytes(size, "little", signed=True)


@pytest.mark.parametrize("fine", [1 << 12, 4])
def test_scatter_and_shuffle_equal_a_plain_version(spark, docs, monkeypatch, fine):
    """Buckets and slots by plain loops; with 4 parts counted first, buckets must be counted again."""
    monkeypatch.setattr(sharding, "FINE", fine)
    seed, shards, most = sharding.SEED, 3, 2000
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    shard_of_id = {i: max((hashed(whole(seed), whole(k), whole(i, 8)), k) for k in range(shards))[1] for i in rows}
    held, parts = Counter(), []
    for i, r in rows.items():
        held[shard_of_id[i]] += 40 + sum(len(r[c].encode()) for c in ("text", "lang", "source"))
    for k in range(shards):
        parts.append(1)
        while held[k] > parts[k] * most:
            parts[k] *= 2
    assert min(parts) > 4
    cells, first = max(fine, *parts), [sum(parts[:k]) for k in range(shards)]
    buckets = defaultdict(list)
    for i, r in rows.items():
        shard = shard_of_id[i]
        tie = hashed(whole(seed + 1), whole(i, 8), r["text"], r["lang"], r["source"], whole(r["n_chars"], 8))
        buckets[first[shard] + (tie % cells) // (cells // parts[shard])].append((i, tie))
    want, at = {}, Counter()
    for bucket in sorted(buckets):
        shard = max(k for k in range(shards) if first[k] <= bucket)
        held = sorted(buckets[bucket])
        draws = np.random.Generator(np.random.PCG64([seed, bucket])).random(len(held))
        for i in range(len(held) - 1, 0, -1):
            j = int(draws[i] * (i + 1))
            held[i], held[j] = held[j], held[i]
        for i, _ in held:
            want[i] = (shard, bucket, at[shard])
            at[shard] += 1
    made = external_shuffle(docs, n_shards=shards, bucket_bytes=most).select("record.doc_id", "shard", "bucket", "slot").collect()
    assert {r["doc_id"]: (r["shard"], r["bucket"], r["slot"]) for r in made} == want


def test_rows_that_differ_in_other_columns_only_keep_their_places(spark):
    rows = [(1, "same", f"s{i}", {"k": i}) for i in range(40)]
    schema = "doc_id long, text string, source string, more map<string,int>"
    made = [external_shuffle(spark.createDataFrame(r, schema).repartition(n), n_shards=2).select("record.source", "slot").collect() for r, n in ((rows, 3), (rows[::-1], 5))]
    assert {r["source"]: r["slot"] for r in made[0]} == {r["source"]: r["slot"] for r in made[1]} and len(made[0]) == 40


def test_identical_rows_are_spread_over_buckets(spark):
    """A third of the rows are one row: it fills no bucket of its own, all copies are there, and reruns agree."""
    rows = [(5, "the very same text", "a")] * 3000 + [(i % 900, f"text {i}", "b") for i in range(6000)]
    runs = []
    for n in (3, 7):
        made = external_shuffle(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), n_shards=3, bucket_bytes=4000).select("record.*", "shard", "bucket", "slot").collect()
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in made) == Counter(rows)
        slots = defaultdict(list)
        for r in made:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        same = Counter(r["bucket"] for r in made if r["doc_id"] == 5 and r["text"] == "the very same text")
        assert len({r["shard"] for r in made if r["doc_id"] == 5}) == 1 and len(same) >= 16 and max(same.values()) < 500
        runs.append(sorted(map(tuple, made)))
    assert runs[0] == runs[1]


@pytest.mark.parametrize("kind", ["string", "map<string,string>"])
def test_a_hot_id_fills_no_bucket(spark, tmp_path, kind):
    """Most rows have one id, or none, and one text, and differ elsewhere; other columns have the operator's own names."""
    rows = [(None if i % 2 else 4, "one text for all", f"{i:05d}" if kind == "string" else {"u": f"{i:05d}"}, i, i % 3) for i in range(6000)] + [(i, f"text {i}", None, i, 0) for i in range(600)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, url {kind}, _shard int, slot int")
    made = external_shuffle(frame, n_shards=4, bucket_bytes=8000)
    found = made.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards")).collect()
    assert sum(r["n"] for r in found) == 6600 and max(r["n"] for r in found) < 400 and all(r["shards"] == 1 for r in found)
    write_shards(made, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(str(tuple(r)) for r in back.select("record.*").collect()) == Counter(str(tuple(r)) for r in frame.collect())
    for shard in range(4):
        slots = sorted(r["slot"] for r in back.where(f"shard = {shard}").select("slot").collect())
        assert slots == list(range(len(slots)))


def test_long_and_unnamed_documents_stay_in_the_mix(spark):
    rows = [(1, "w " * 5000, "a")] + [(i, f"x{i} y z", "b") for i in range(2, 40)] + [(None, "no id here", "b"), (50, " ", "b")]
    mixed = [r["doc_id"] for r in apply_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert 1 in mixed and None in mixed and 50 not in mixed and max(Counter(mixed).values()) <= 2


def test_shuffle_order_is_mixed(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    order = [r["record"]["doc_id"] for r in external_shuffle(rows, n_shards=1).orderBy("slot").collect()]
    inversions = sum(a > b for a, b in zip(order, order[1:], strict=False))
    assert sorted(order) == list(range(3000)) and 1350 < inversions < 1650


def test_one_more_shard_only_takes_into_itself(spark):
    rows = spark.range(5000).select(shard_of(F.col("id"), 7).alias("a"), shard_of(F.col("id"), 8).alias("b")).collect()
    assert all(r["b"] in (r["a"], 7) for r in rows) and 450 < sum(r["b"] == 7 for r in rows) < 800


def test_mix_equals_sql(spark, sf_dir):
    check(spark, sf_dir, op8_golden_mix, OP8_SQL)


def test_mix_meets_its_targets(docs):
    rows = mix_sources(docs).collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], r["target"]] += r["taken"]
        target[r["source_size"], r["target"]] = r["target"]
    assert all(abs(taken[k] - t) <= 1 * sum(1 for x in target if x == k) for k, t in target.items())
    total = sum(r["size"] for r in rows)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total


def test_schedule_is_spread(docs):
    """Whatever part of the mix is read, a source has about its share of it."""
    rows = [r for r in mix_sources(docs, block=16).collect() if r["first_slot"] is not None]
    assert rows and len({r["first_slot"] for r in rows}) > len(rows) // 3


def test_odd_rows(odd, none):
    got = mix_sources(odd).collect()
    assert len(got) == odd.count() and mix_sources(none).count() == 0 and apply_mix(none).count() == 0
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    mixed = apply_mix(odd)
    assert mixed.columns == odd.columns and {r["doc_id"] for r in mixed.collect()} <= {None, 1, 2, 6, 7, 8, 9, 10}
    assert mixed.where("text is null or trim(text) = ''").count() == 0
    made = external_shuffle(odd, n_shards=3, bucket_bytes=100).select("shard", "slot", "record.doc_id").collect()
    assert len(made) == odd.count() and external_shuffle(none).count() == 0
    assert len({r["shard"] for r in made if r["doc_id"] is None}) == 1
