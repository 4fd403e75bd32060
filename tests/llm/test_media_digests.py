from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import fingerprints as fp
from lexmill.llm import tiff
from lexmill.llm.fingerprints import against_next, fingerprint, op10_quartile_digest
from lexmill.llm.tiff import TiffError, decode_pages, encode, lzw_decode, lzw_encode, op1_tiff_pages, pack_bits, store_texts, tiff_pages, unpack_bits


@pytest.mark.parametrize("layout", [*sorted(set(tiff.LAYOUTS)), (tiff.RAW, 1, False)])
def test_round_trip(layout):
    rng = random.Random(3)
    for n in (64, 128, 64 * 200, 64 * 700):
        for alphabet in (b"ab", bytes(range(256))):
            payload = bytes(rng.choices(alphabet, k=n))
            pages = list(decode_pages(encode(payload, layout)))
            assert b"".join(p.data for p in pages) == payload and len(pages) == -(-n // (64 * 256))
            assert all((p.compression, p.predictor, p.tiled) == layout for p in pages)


def test_codecs_of_random_bytes():
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choices(range(rng.choice([1, 2, 256])), k=rng.choice([0, 1, 2, 300, 9000])))
        assert lzw_decode(lzw_encode(data)) == data and unpack_bits(pack_bits(data)) == data
    assert unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0x80, 0xFD, 0xAA])) == b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa"


def build(order, fields, blobs, big=False):
    """A TIFF written plainly: blobs first, then one directory; offsets are patched in by name."""
    o, place, body = {"II": "<", "MM": ">"}[order], {}, b""
    head = 16 if big else 8
    for name, blob in blobs.items():
        place[name] = head + len(body)
        body += blob
    at, spill, out = head + len(body), b"", []
    room, entry = (8, 20) if big else (4, 12)
    end = at + (8 if big else 2) + entry * len(fields) + room
    for tag, kind, values in fields:
        values = [place.get(v, v) for v in values]
        data = struct.pack(f"{o}{len(values)}{tiff.TYPE_CODES[kind]}", *values)
        first = struct.pack(o + ("HHQ" if big else "HHI"), tag, kind, len(values))
        if len(data) > room:
            out.append(first + struct.pack(o + ("Q" if big else "I"), end + len(spill)))
            spill += data
        else:
            out.append(first + data.ljust(room, b"\0"))
    start = order.encode() + (struct.pack(o + "HHHQ", 43, 8, 0, at) if big else struct.pack(o + "HI", 42, at))
    return start + body + struct.pack(o + ("Q" if big else "H"), len(fields)) + b"".join(out) + b"\0" * room + spill


@pytest.mark.parametrize("order", ["II", "MM"])
@pytest.mark.parametrize("big", [False, True])
def test_wide_samples_planes_and_tiles(order, big):
    o = {"II": "<", "MM": ">"}[order]
    grid = np.arange(20 * 24 * 3, dtype=np.uint16).reshape(20, 24, 3) * 37
    diff = np.diff(grid, axis=1, prepend=np.zeros((20, 1, 3), np.uint16)).astype(np.uint16)
    base = [(256, 3, [24]), (257, 3, [20]), (258, 3, [16, 16, 16]), (259, 3, [8]), (262, 3, [2])]
    strips = {f"s{i}": zlib.compress(diff[i * 7 : i * 7 + 7].astype(o + "u2").tobytes()) for i in range(3)}
    data = build(order, [*base, (273, 4, list(strips)), (277, 3, [3]), (278, 3, [7]), (279, 4, [len(b) for b in strips.values()]), (317, 3, [2])], strips, big)
    (page,) = decode_pages(data)
    assert (page.width, page.length, page.samples, page.bits) == (24, 20, 3, 16) and page.data == grid.astype("<u2").tobytes()
    padded = np.zeros((32, 32, 3), np.uint16)
    padded[:20, :24] = grid
    tiles = {f"t{p}{y}{x}": zlib.compress(padded[16 * y : 16 * y + 16, 16 * x : 16 * x + 16, p].astype(o + "u2").tobytes()) for p in range(3) for y in range(2) for x in range(2)}
    data = build(order, [*base, (277, 3, [3]), (284, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, list(tiles)), (325, 4, [len(b) for b in tiles.values()])], tiles, big)
    (page,) = decode_pages(data)
    assert page.tiled and page.data == grid.astype("<u2").tobytes()


def test_floating_point_predictor():
    grid = np.linspace(-3, 9, 6 * 10, dtype=np.float32).reshape(6, 10)
    by_byte = grid.astype(">f4").view(np.uint8).reshape(6, 10, 4).transpose(0, 2, 1).reshape(6, 40)
    coded = np.diff(by_byte, axis=1, prepend=np.zeros((6, 1), np.uint8)).astype(np.uint8).tobytes()
    fields = [(256, 3, [10]), (257, 3, [6]), (258, 3, [32]), (259, 3, [1]), (273, 4, ["s"]), (277, 3, [1]), (278, 3, [6]), (279, 4, [len(coded)]), (317, 3, [3]), (339, 3, [3])]
    (page,) = decode_pages(build("II", fields, {"s": coded}))
    assert page.data == grid.astype("<f4").tobytes() and page.sample_format == 3


def test_bad_bytes_are_named(spark):
    good = encode(b"x" * 64 * 300, (tiff.DEFLATE, 1, False))
    rows = [(1, b""), (2, b"II*\0"), (3, good[:-20]), (4, None), (5, good), (5, good), (6, b"PNG, surely not")]
    got = tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {i: [r for r in got if r["doc_id"] == i] for i in range(1, 7)}
    assert all(r["error"] and r["data"] is None for i in (1, 2, 6) for r in by[i]) and by[4] == []
    assert len(by[5]) == 4 and not any(r["error"] for r in by[5]) and by[3][-1]["error"]
    with pytest.raises(TiffError):
        list(decode_pages(b"II*\0\x08\0\0\0" + struct.pack("<HHHIII", 1, 256, 3, 1, 5, 8)))


def test_mutated_files_give_pages_or_an_error():
    """Whatever a byte is changed to, the reader decodes or names a fault, and never more than its bound."""
    rng = random.Random(8)
    payload = bytes(rng.choices(b"abc \n", k=64 * 300))
    good = [encode(payload, layout) for layout in sorted(set(tiff.LAYOUTS))] + [encode(payload, (tiff.RAW, 1, False))]
    faults = 0
    for k in range(10_000):
        data = bytearray(good[k % len(good)])
        heads = [8, int.from_bytes(data[4:8], "little")]
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data)) if rng.random() < 0.3 else min(len(data) - 1, rng.choice(heads) + rng.randrange(140))
            data[at] = rng.choice([0, 1, 2, 3, 11, 12, 127, 128, 255, rng.randrange(256)])
        try:
            assert sum(len(p.data) for p in decode_pages(bytes(data[: rng.choice([len(data), rng.randrange(len(data))])]))) < 1 << 30
        except TiffError:
            faults += 1
    assert faults > 3000


def page_fields(**change):
    fields = {256: (3, [8]), 257: (3, [8]), 258: (3, [8]), 259: (3, [1]), 273: (4, ["s"]), 277: (3, [1]), 278: (3, [8]), 279: (4, [64])}
    fields |= {int(k[1:]): v for k, v in change.items()}
    return [(tag, kind, values) for tag, (kind, values) in sorted(fields.items())]


@pytest.mark.parametrize("change", [{"t278": (3, [0])}, {"t277": (3, [0]), "t284": (3, [2])}, {"t256": (11, [8.5])}, {"t256": (8, [-3])}, {"t258": (3, [0])}, {"t256": (4, [1 << 31]), "t257": (4, [1 << 31])}])
def test_impossible_layouts_are_faults(change):
    with pytest.raises(TiffError):
        list(decode_pages(build("II", page_fields(**change), {"s": bytes(64)})))


def test_output_is_bounded():
    bomb = zlib.compress(bytes(50_000_000))
    (page,) = decode_pages(build("II", page_fields(t259=(3, [8]), t279=(4, [len(bomb)])), {"s": bomb}))
    assert page.data == bytes(64)
    assert len(unpack_bits(b"\x81a" * 100_000, 1000)) < 1200 and len(lzw_decode(lzw_encode(b"a" * 200_000), 1000)) < 3000
    with pytest.raises(ValueError, match="named page"):
        tiff_pages(type("Media", (), {"schema": {}})(), "page")


def test_op1_equals_brute_force(spark, sf_dir, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op1_tiff_pages(spark, sf_dir).collect():
        data = texts[r["doc_id"]].encode()
        payload = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(encode(payload)).hexdigest() and r["media_bytes"] == len(encode(payload))
        assert f"mean={np.frombuffer(payload, np.uint8).mean():.4f}" in r["feature"]


def test_op10_equals_brute_force(spark, sf_dir, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in op10_quartile_digest(spark, sf_dir).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(text) and r["edited_fingerprint"] == fingerprint(edited)
        assert r["near_edited"] == fp.likeness(fingerprint(text), fingerprint(edited)) and r["near_next"] == fp.likeness(fingerprint(text), fingerprint(after))
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.98 * len(got)


def plain_digest(text):
    """The digest by a dictionary of counts and sorted lists."""
    data, counts = text.encode(), dict.fromkeys(range(256), 0)
    if data:
        padded = bytes(3) + data + bytes(3)
        for at in range(len(padded) - 3):
            for k, places in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
                h = 0
                for j, p in enumerate(places):
                    h ^= int(fp._TABLES[k, j, padded[at + p]])
                counts[h] += 1
    order = sorted(counts.values())
    low, mid, high = order[64], order[128], order[192]
    length = min(255, round(math.log(len(data), 1.1)) + 1) if data else 0
    ratios = (16 * low // (high + 1)) * 16 + 16 * mid // (high + 1) if data else 0
    quarter = [sum(counts[b] > edge for edge in (low, mid, high)) for b in range(256)]
    return length, ratios, quarter


def plain_likeness(a, b):
    steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[2], b[2], strict=True))
    heads = 6 * min(12, abs(a[0] - b[0])) + abs(a[1] // 16 - b[1] // 16) + abs(a[1] % 16 - b[1] % 16)
    return 1 - min(416, steps + heads) / 416


def plain_lzw(data):
    """Codes as they come, one by one: a clear code first, a table by strings, widths that grow one code early."""
    table, word, codes = {bytes([i]): i for i in range(256)}, b"", []
    sized = []

    def put(code):
        size = 258 + len(codes)
        sized.append((code, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
        codes.append(code)

    sized.append((256, 9))
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = 258 + len(codes) - 1
        word = data[i : i + 1]
        if 258 + len(codes) == 4095:
            sized.append((256, 12))
            table, codes = {bytes([i]): i for i in range(256)}, []
    if word:
        put(table[word])
    put(257)
    text = "".join(f"{code:0{n}b}" for code, n in sized)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_lzw_equals_a_plain_encoder():
    rng = random.Random(8)
    for size in (0, 1, 2, 253, 254, 255, 256, 700, 3000, 9000):
        for letters in (1, 3, 256):
            data = bytes(rng.randrange(letters) for _ in range(size))
            stored = tiff.lzw_encode(data)
            assert stored == plain_lzw(data) and tiff.lzw_decode(stored) == data and tiff.lzw_decode(stored + b"junk") == data
            assert data.startswith(tiff.lzw_decode(stored, 10)[:10])
    for wrong in (b"\xff\xff\xff", b"\x80\x7f\xff\xff"):
        with pytest.raises(tiff.TiffError):
            tiff.lzw_decode(wrong)
    assert tiff.lzw_decode(b"") == b"" and len({layout[0] for layout in tiff.LAYOUTS}) * 4 == len(tiff.LAYOUTS)


def test_op10_equals_counts_by_dictionary(spark, sf_dir, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"]) < 1500), reverse=True)
    some = docs.where(F.length("text") < 1500)
    got = {r["doc_id"]: r for r in against_next(some).collect()}
    assert len(got) == len(rows) > 50
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        mark, edited, following = plain_digest(text), plain_digest(text[: len(text) - n] + after[:n]), plain_digest(after)
        bits = "".join(f"{q:02b}" for q in mark[2])
        assert got[i]["fingerprint"] == bytes(mark[:2]).hex() + int(bits, 2).to_bytes(64, "big").hex()
        assert math.isclose(got[i]["near_edited"], plain_likeness(mark, edited)) and math.isclose(got[i]["near_next"], plain_likeness(mark, following))


@pytest.mark.parametrize("most", [1, 3, 50])
def test_ranges_do_not_change_rows(spark, docs, monkeypatch, most):
    """Ids that repeat, or none, among them."""
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 7).when(F.col("doc_id") % 2 > 0, F.col("doc_id")))
    order = lambda r: tuple((x is None, x or "") if isinstance(x, (str, type(None))) else (False, x) for x in r)
    want = sorted(map(tuple, against_next(docs).collect()), key=order)
    monkeypatch.setattr(fp, "RANGE_BYTES", 5000)
    monkeypatch.setattr(fp, "MOST_RANGES", most)
    assert sorted(map(tuple, against_next(docs).collect()), key=order) == want


def test_hot_ids_fill_several_ranges(spark, monkeypatch):
    """An id, or none, with most of the rows: still one circle through all rows, ids descending."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 200)
    rng = random.Random(9)
    rows = [(rng.choice([7, 7, 7, None, None, *range(20)]), f"{i:04d} " + "z" * rng.randint(9, 30)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    made = against_next(frame)
    got = made.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_chars"]) for r in got) == sorted((i is None, i, len(t)) for i, t in rows)
    sizes = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 40
    # Whose text follows is told by the digest of the edited text: a permutation of all rows, in one circle.
    edits = {hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest(): (a, b) for _, a in rows for _, b in rows}
    follows = dict(edits[r["edited_sha256"]] for r in got)
    assert len(follows) == len(set(follows.values())) == 400
    ids, at, seen = {t: i for i, t in rows}, rows[0][1], []
    for _ in range(400):
        seen.append(ids[at])
        at = follows[at]
    assert at == rows[0][1] and sum(a != b for a, b in zip(seen, seen[1:] + seen[:1], strict=True)) == len(set(seen))


def test_fingerprints():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ("".join(rng.choices("abcde \n", k=rng.randint(0, 2000))) for _ in range(2))
        assert 0 <= fp.likeness(fingerprint(a), fingerprint(b)) <= 1 and fp.difference(fingerprint(a), fingerprint(b)) == fp.difference(fingerprint(b), fingerprint(a)) <= fp.FAR
        assert fp.likeness(fingerprint(a), fingerprint(a)) == 1
    assert fingerprint("") == "0" * 132 and fingerprint("a") != fingerprint("b")
    long = "abc " * 200_000
    assert fingerprint(long) == fingerprint(long.encode())


def test_pieces_do_not_change_counts(monkeypatch):
    text = "".join(random.Random(7).choices("abcdefgh ", k=5000))
    whole = fingerprint(text)
    monkeypatch.setattr(fp, "_PIECE", 97)
    assert fingerprint(text) == whole


def test_odd_rows(spark, odd, none):
    assert store_texts(odd).count() == odd.count() == against_next(odd).count() == fp.fingerprints(odd).count()
    assert store_texts(none).count() == against_next(none).count() == fp.fingerprints(none).count() == 0
    pages = tiff_pages(store_texts(odd)).collect()
    assert not any(r["error"] for r in pages) and sum(r["doc_id"] == 6 for r in pages) > 1
    single = against_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert single["near_next"] == 1.0 and single["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    unnamed = against_next(spark.createDataFrame([(None, "abcdef"), (None, "xyzxyz")], "doc_id long, text string")).collect()
    assert {r["edited_sha256"] for r in unnamed} == {hashlib.sha256(x).hexdigest() for x in (b"abcdxy", b"xyzxab")}
