"""ppm consolidation over many parts, against a plain loop."""

import numpy as np
import pytest

from spectral_lake.operators import axis


def by_loop(values, ppm):
    groups = []
    for v in sorted(values):
        if groups and abs(v - groups[-1][0]) / groups[-1][0] * 1e6 <= ppm:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [sum(g) / len(g) for g in groups]


def values(kind):
    rng = np.random.default_rng(3)
    if kind == "dense":  # no gap above the tolerance anywhere
        return 100 + np.cumsum(rng.random(3000) * 1e-4)
    if kind == "denser":  # a group holds more values than a part
        return 100 + np.cumsum(rng.random(2000) * 1e-6)
    if kind == "gaps":
        return np.concatenate([c + np.cumsum(rng.random(200) * 2e-4) for c in (100, 150, 150.2, 400, 900)])
    if kind == "at the limit":  # steps of the tolerance itself
        v = [100.0]
        while len(v) < 500:
            v.append(v[-1] * (1 + 5e-6))
        return np.array(v)
    return np.array([7.0])


@pytest.mark.parametrize("kind", ["dense", "denser", "gaps", "at the limit", "one"])
@pytest.mark.parametrize("rows", [7, 100, 1 << 16])
def test_groups_are_the_loops(spark, kind, rows):
    v = np.unique(values(kind))
    if rows == 7:
        v = v[:150]
    df = spark.createDataFrame([(float(x),) for x in v], "mz double").repartition(4)
    got = axis.ppm_axis(df, 5.0, rows).orderBy("mz_idx").collect()
    want = by_loop(v.tolist(), 5.0)
    assert [r["mz_idx"] for r in got] == list(range(len(want)))
    assert np.allclose([r["mz"] for r in got], want, rtol=1e-14, atol=0)


def test_an_empty_axis(spark):
    assert axis.ppm_axis(spark.createDataFrame([], "mz double")).collect() == []


def test_a_dense_axis_is_folded_by_many_tasks(spark):
    v = 100 + np.cumsum(np.full(20_000, 1e-4))
    df = spark.createDataFrame([(i // 1000, float(x)) for i, x in enumerate(v)], "part bigint, mz double")
    first = np.array(v[::1000])
    dealt = df.repartition("part").sortWithinPartitions("part", "mz").mapInArrow(axis._dealt(first, 5.0), "part bigint, mz double")
    counts = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(counts) == 20 and max(counts) <= 1000 + 10  # its own values, and what a group at its end may reach
