from __future__ import annotations

import random

import numpy as np
import pytest

from lexmill.llm import near_dedup
from lexmill.llm.near_dedup import drop_near_duplicates, near_duplicates, op3_minhash_forest


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Components by all pairs."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, set()).add(shingle_set(text))
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def variants(seed=1):
    """Groups of edited copies around the threshold, chains among them."""
    rng, rows, n = random.Random(seed), [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(2, 12)):
            now = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                now[rng.randrange(len(now))] = f"v{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words = now
            rows.append((n, " ".join(now)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [2048, 4])
def test_equals_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)  # 4: every tree deepens, regions are dealt out
    rows = variants()
    want = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 12


def templated(n):
    """A template of 84 shingles in each of ``n`` texts: partners are 0.80 alike, all others 0.72."""
    rng, head = random.Random(3), " ".join(f"t{i}" for i in range(88))
    ids = list(range(n))
    rng.shuffle(ids)
    tail = lambda name, size: " ".join(f"{name}x{i}" for i in range(size))
    rows = [(i, f"{head} {tail(f'p{k // 2}', 5)} {tail(f'o{k}', 11)}") for k, i in enumerate(ids)]
    want = {}
    for k in range(0, n, 2):
        want |= dict.fromkeys(ids[k : k + 2], min(ids[k : k + 2]))
    return rows, want


def test_template_is_as_said():
    rows, want = templated(60)
    assert brute(rows) == want and len(set(want.values())) == 30


@pytest.mark.parametrize(("crowd", "n"), [(2048, 5000), (32, 2600), (8, 1200)])
def test_large_templated_group_keeps_its_links(spark, monkeypatch, crowd, n):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rows, want = templated(n)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_documents_equal_all_pairs(spark, sf_dir, docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = op3_minhash_forest(spark, sf_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] >= 0 for r in got)


def test_odd_rows(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[1, 4]["component_id"] == by[2, 4]["component_id"] == by[10, 4]["component_id"] == 1
    assert by[8, 1]["component_id"] == 7 and not by[8, 1]["kept"] and by[7, 1]["kept"]
    assert by[3, 0]["component_id"] == 3 and by[5, 0]["kept"] and by[4, 0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 3, 4, 5, 6, 7, 9, None}
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_refuses_lower_similarity(odd):
    with pytest.raises(ValueError):
        near_duplicates(odd, min_pct=50)


def test_documents_equal_sql(spark, sf_dir):
    from tests.oracle import check

    check(spark, sf_dir, op3_minhash_forest, near_dedup.OP3_SQL)


def test_neighbours_share_the_longest_prefix():
    rng = np.random.default_rng(0)
    for _ in range(100):
        m = int(rng.integers(2, 30))
        path = rng.integers(0, 3, (m, 6)).astype("u2")
        path = path[np.lexsort(path.T[::-1])]
        common = np.array([[np.cumprod(path[i] == path[j]).sum() if i != j else -1 for j in range(m)] for i in range(m)])
        want = common == common.max(axis=1)[:, None]
        got = np.zeros((m, m), bool)
        for rows, near in near_dedup._neighbours(path):
            assert not got[rows].any()
            got[np.ix_(rows, near)] = True
        np.fill_diagonal(got, False)
        np.fill_diagonal(want, False)
        assert (got == want).all()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAST_FILTER_BITS", 1 << 15)
    monkeypatch.setattr(near_dedup, "MOST_FILTER_BITS", 1 << 15)
    rows = variants(2)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
