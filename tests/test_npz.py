"""Archives of arrays: what NumPy writes Spark reads, and the other way round."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest

from lexmill.sources import npz


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_numpy_archives_are_read_by_ranges(spark, tmp_path, save):
    rng = np.random.default_rng(3)
    arrays = {"id": np.arange(1000, dtype=">i8"), "mean": rng.normal(size=(1000, 7)).astype(np.float32), "lang": np.array([f"l{i % 5}é" for i in range(1000)]), "ok": rng.random(1000) < 0.5, "logits": rng.normal(size=(1000, 3))}
    save(tmp_path / "a.npz", **arrays)
    table = npz.register(spark).read.format("npz").option("rows", 130).load(str(tmp_path / "a.npz"))
    assert table.rdd.getNumPartitions() == 8 and dict(table.dtypes) == {"id": "bigint", "mean": "array<float>", "lang": "string", "ok": "boolean", "logits": "array<double>"}
    rows = sorted(table.collect(), key=lambda r: r["id"])
    assert all(np.array_equal([r[c] for r in rows], arrays[c]) for c in arrays)
    assert [r[0] for r in table.select("lang").where("id = 77").collect()] == ["l2é"]


def test_tables_are_written_and_read_back(spark, tmp_path):
    path, rows = f"{tmp_path}/out", [(i, [float(i), -1.0], f"t{i}") for i in range(500)]
    table = npz.register(spark).createDataFrame(rows, "i long, v array<double>, t string").repartition(3)
    table.write.format("npz").option("rows", 60).mode("append").save(path)
    back = lambda: sorted((r["i"], list(r["v"]), r["t"]) for r in spark.read.format("npz").load(f"file://{path}").collect())
    assert back() == rows and len(json.load(open(f"{path}/{npz.MANIFEST}"))) >= 9
    # What a lost task left is not read; more may be appended, or all replaced.
    np.savez(f"{path}/part-stray.npz", i=np.arange(3), v=np.zeros((3, 2)), t=np.array(list("abc")))
    assert back() == rows
    table.limit(0).write.format("npz").mode("append").save(path)
    table.where("i < 5").write.format("npz").mode("append").save(path)
    assert back() == sorted(rows + rows[:5])
    table.where("i < 2").write.format("npz").mode("overwrite").save(path)
    assert back() == rows[:2]


def test_what_cannot_be_held_is_refused(spark, tmp_path):
    npz.register(spark)
    with pytest.raises(Exception, match="nulls"):
        spark.createDataFrame([(None,), (1,)], "i long").write.format("npz").mode("append").save(f"{tmp_path}/x")
    assert not os.path.exists(f"{tmp_path}/x/{npz.MANIFEST}")
    with pytest.raises(Exception, match="mounted"):
        spark.read.format("npz").load("hdfs://there/x").collect()
    np.savez(tmp_path / "odd.npz", a=np.zeros(3), b=np.zeros(4))
    with pytest.raises(Exception, match="lengths"):
        spark.read.format("npz").load(str(tmp_path / "odd.npz"))
