"""Operators against NumPy on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectral_lake.functions import coords
from spectral_lake.operators import axis, balance, images, mapping, matrix, metadata, ontology, stats
from spectral_lake.plans import catalogue


def by_numpy(values, probes, tolerance=1e-6):
    i = np.minimum(np.searchsorted(values, probes), len(values) - 1)
    return {(k, int(j)) for k, (j, p) in enumerate(zip(i, probes)) if abs(values[j] - p) <= tolerance}


@pytest.mark.parametrize("how", [mapping.map_bucketed, mapping.map_vectorised])
def test_mapping_takes_the_first_value_not_below(spark, how):
    values = [100.0, 100.0000005, 200.0, 300.0]
    probes = [100.0, 100.0000002, 100.0000009, 200.0000001, 199.9999995, 300.0000004, 301.0, 99.9999999, 250.0]
    a = spark.createDataFrame(list(enumerate(values)), "mz_idx bigint, mz double")
    p = spark.createDataFrame([(0, k, v, 1.0) for k, v in enumerate(probes)], "spectrum_idx bigint, peak_pos bigint, mz double, intensity double")
    got = {(r["peak_pos"], r["mz_idx"]) for r in how(p, a).collect()}
    assert got == by_numpy(np.array(values), np.array(probes)) == {(0, 0), (1, 1), (4, 2), (5, 3), (7, 0)}


def test_mapping_near_collisions(spark):
    rng = np.random.default_rng(5)
    base = np.sort(rng.uniform(100, 101, 60))
    values = np.unique(np.concatenate([base, base + rng.uniform(-2e-6, 2e-6, 60)]))
    probes = np.concatenate([values + rng.uniform(-2e-6, 2e-6, len(values)), [99.0, 102.0]])
    a = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "mz_idx bigint, mz double")
    p = spark.createDataFrame([(0, k, float(v), 1.0) for k, v in enumerate(probes)], "spectrum_idx bigint, peak_pos bigint, mz double, intensity double")
    assert {(r["peak_pos"], r["mz_idx"]) for r in mapping.map_bucketed(p, a).collect()} == by_numpy(values, probes)


def greedy(values, ppm):
    groups = []
    for v in sorted(values):
        if groups and abs(v - groups[-1][0]) / groups[-1][0] * 1e6 <= ppm:
            groups[-1].append(v)
        else:
            groups.append([v])
    return [sum(g) / len(g) for g in groups]


def test_ppm_axis(spark):
    random.seed(3)
    for values in ([100, 100.0003, 100.0006, 100.0009, 200, 200.0005, 300], [100 + random.random() * 3 for _ in range(400)]):
        d = spark.createDataFrame([(float(v),) for v in values], "mz double")
        got = [r["mz"] for r in axis.ppm_axis(d, 5.0).orderBy("mz_idx").collect()]
        assert got == pytest.approx(greedy(values, 5.0), rel=1e-14)


def test_axis_is_sorted_and_distinct(spark):
    d = spark.createDataFrame([(float(v),) for v in [100, 200, 300, 150, 200, 350, 100, 250]], "mz double")
    assert [tuple(r) for r in axis.processed_axis(d).orderBy("mz_idx").collect()] == list(enumerate([100.0, 150.0, 200.0, 250.0, 300.0, 350.0]))
    assert axis.processed_axis(d.limit(0)).count() == 0


def test_last_peak_of_a_place_counts_in_totals(spark):
    m = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 2.0), (0, 2, 1, 3.0)], "spectrum_idx bigint, peak_pos bigint, mz_idx bigint, intensity double")
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "mz_idx bigint, mz double")
    assert [r["total"] for r in stats.total_spectrum(m, a).orderBy("mz_idx").collect()] == [2.0, 3.0, 0.0]


def test_later_spectrum_wins_and_negatives_stay(spark):
    m = spark.createDataFrame([(0, 0, 7, 0, 5.0), (1, 0, 7, 0, -2.0), (1, 1, 7, 1, 0.0)], "spectrum_idx bigint, peak_pos bigint, pixel_idx bigint, mz_idx bigint, intensity double")
    assert [tuple(r) for r in matrix.assemble(m).collect()] == [(7, 0, -2.0)]
    assert [tuple(r) for r in matrix.assemble(m, positive_only=True).collect()] == [(7, 0, 5.0)]


def test_coordinates(spark):
    d = spark.createDataFrame([(1, 1, 0), (2, 1, 3)], "x int, y int, z int")
    x, y, z = coords.zero_based(F.col("x"), F.col("y"), F.col("z"))
    assert [tuple(r) for r in d.select(x, y, z).collect()] == [(0, 0, 0), (1, 0, 2)]
    f = spark.createDataFrame([(1, 15, 25), (5, None, None)], "f int, x int, y int")
    x, y, z = coords.normalised(F.col("x"), F.col("y"), F.col("f"), F.lit(5), F.lit(15))
    assert [tuple(r) for r in f.select(x, y, z).collect()] == [(10, 10, 0), (4, 0, 0)]
    with pytest.raises(ValueError, match="Invalid dimensions"):
        images.grid(spark, 3, 3, 0)


def test_runs_of_ids(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 9, 10)], "id bigint")
    assert sorted(map(tuple, metadata.consecutive_ranges(ids, width=4).collect())) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_vocabulary(spark, tmp_path):
    (tmp_path / "t.obo").write_text("format-version: 1.2\n\n[Term]\nid: MS:1\nname: one\nxref: value-type:xsd\\:double \"x\"\n\n[Term]\nid: IMS:2\nname: two\n")
    terms = ontology.load_obo(spark, str(tmp_path / "t.obo"))
    assert {tuple(r) for r in terms.collect()} == {("MS:1", "one", "xsd:double"), ("IMS:2", "two", None)}
    (tmp_path / "a.imzML").write_text('<mzML xmlns="http://psi.hupo.org/ms/mzml"><cvParam cvRef="MS" accession="MS:1" name="one" value=""/><cvParam cvRef="MS" accession="XX:9" name="?" value="1"/></mzML>')
    params = ontology.read_params(spark, str(tmp_path / "a.imzML"))
    assert ontology.summary(params, terms).first().asDict() == {"total": 2, "known": 1, "unknown": 1, "distinct_terms": 2, "known_percent": 50.0}
    assert "unknown XX:9: 1" in ontology.report(params, terms)


def test_equal_peaks_stay_as_many_as_they_are(spark):
    axis_rows = spark.createDataFrame([(0, 100.0), (1, 100.0000005), (2, 200.0), (3, 300.0)], "mz_idx bigint, mz double")
    peaks = spark.createDataFrame([(1, 0, m, 1.0) for m in (100.0, 100.0, 99.9999995, 100.0000002, 200.0000001, 300.0000004, 150.0)], "spectrum_idx bigint, peak_pos bigint, mz double, intensity double")
    want = sorted([(100.0, 0), (100.0, 0), (99.9999995, 0), (100.0000002, 1), (300.0000004, 3)])
    for f in (mapping.map_bucketed, mapping.map_vectorised):
        assert sorted((r["mz"], r["mz_idx"]) for r in f(peaks, axis_rows).collect()) == want


def test_the_next_axis_value_by_buckets(spark):
    import numpy as np
    import pytest

    from spectral_lake.errors import ResourceError
    from spectral_lake.operators import mapping

    rng = np.random.default_rng(5)
    values = np.unique(np.concatenate([100 + rng.random(200) * 5e-3, 100 + rng.random(300) * 800, np.arange(200, 210)]))
    wanted = np.concatenate([rng.choice(values, 100), 90 + rng.random(400) * 900, [values[0], values[-1], values[-1] + 1e-9, 0.0]])
    axis = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "mz_idx bigint, mz double")
    peaks = spark.createDataFrame([(0, i, float(v), 1.0) for i, v in enumerate(wanted)], "spectrum_idx bigint, peak_pos bigint, mz double, intensity double")
    want = {i: int(k) for i, k in enumerate(np.searchsorted(values, wanted)) if k < len(values)}
    for got in (mapping.map_next(peaks, axis), mapping.map_next_bucketed(peaks, axis), mapping.map_next_bucketed(peaks, axis, 10.0)):
        assert {r["peak_pos"]: r["mz_idx"] for r in got.collect()} == want
    assert mapping.map_next_bucketed(peaks, axis.limit(0)).collect() == []
    with pytest.raises(ResourceError):
        mapping.dense(peaks, mapping.MOST_SHIPPED + 1)


def test_exact_mapping_in_stated_partitions(spark, monkeypatch):
    """The join keeps the partitions it is given, and finds what the plain join finds."""
    p = spark.createDataFrame([(i, i % 5, v, 1.0 * i) for i, v in enumerate([0.0, -0.0, 0.1 + 0.2, 0.3, 1e300, float("nan"), None, 7.0] * 40)], "spectrum_idx bigint, peak_pos bigint, mz double, intensity double")
    a = axis.processed_axis(p.where("mz is not null"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, dealt = mapping.map_exact(p, a), mapping.map_exact(p, a, 11)
        assert dealt.columns == plain.columns
        assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect()))
        assert dealt.rdd.getNumPartitions() == 11
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["intensity_matrix_coo", "csr_rows", "last_write_wins_matrix"])
def test_tasks_of_the_matrix_grow_in_number_with_the_rows(spark, monkeypatch, name):
    """The session has 4 partitions for any input; 6000 rows at 500 a task are 12, with the same result."""
    run = lambda: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    one = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(balance, "ROWS_A_TASK", 500)
    df = run()
    assert df.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, df.collect())) == one
    held = df.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert held.max() < 800
