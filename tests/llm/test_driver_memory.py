"""What training-data operators bring to the driver, and how many plans their rounds need."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import packing, quality
from orbitweave.storage import written


def test_the_model_reaches_the_driver_as_numbers(spark):
    r = np.random.default_rng(5)
    rows = sorted({(str(r.choice(["de", "en", "日"])), "".join(r.choice(list("abcdéß日 "), quality.ORDER)), float(-r.random())) for _ in range(3000)})
    model = written(spark.createDataFrame(rows, "lang string, gram string, log_p double").dropDuplicates(["lang", "gram"]).repartition(3), "model")
    want = quality.arrays_of(model.toArrow())
    got = quality.gathered(model)
    assert set(got) == set(want) == {"de", "en", "日"}
    for x, (h, p) in got.items():
        assert h.dtype == np.uint64 and p.dtype == np.float32 and (h == want[x][0]).all() and (p == want[x][1]).all()
    sent = quality.packed(model).toArrow()
    assert sent.column("h").type == sent.column("p").type == "binary"
    assert sum(len(v) for c in ("h", "p") for v in sent.column(c).to_pylist()) == 12 * model.count() and sent.num_rows <= 9
    assert quality.gathered(model.where("lang = 'none'")) == {}


@pytest.mark.parametrize("seed", range(3))
def test_heights_of_whole_sizes_are_those_of_parts(spark, monkeypatch, seed):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(1, 12)), int(r.integers(0, 2)), i, 0) for i in range(200)]
    tokens = spark.createDataFrame(rows, "size long, kind int, id long, slot int")
    one = packing.with_heights(tokens)
    # no further plan over sizes: the counts are there
    assert "Window" not in one._jdf.queryExecution().optimizedPlan().toString()
    stack, want = 0, {}
    for size, kind in sorted({(s, k) for s, k, _, _ in rows}, key=lambda x: (-x[0], x[1])):
        want[size, kind] = stack
        n = sum(x[:2] == (size, kind) for x in rows)
        stack = stack + n if kind == 0 else max(0, stack - n)
    assert {(x["size"], x["kind"]): x["height"] for x in one.collect()} == want and one.count() == 200
    monkeypatch.setattr(packing, "RANGE", 3)
    parts = packing.with_heights(tokens)
    first = {(x["size"], x["kind"]): x["h"] for x in parts.groupBy("size", "kind").agg(F.min_by("height", "part").alias("h")).collect()}
    assert {k: v for k, v in first.items() if k[1] == 0} == {k: v for k, v in want.items() if k[1] == 0}


def test_a_round_joins_no_gaps(spark, monkeypatch):
    seen = []

    def noted(df, name):
        if name == "gaps":
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(packing, "written", noted)
    lengths = [60, 30, 20, 20, 9, 5, 5, 3, 1, 1]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 64).collect()
    assert sorted(x["length"] for x in got) == sorted(lengths) and len(seen) > 1 and not any("Join" in p for p in seen)
