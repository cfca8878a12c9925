"""Vocabularies in their order, sections, slices, and streams that bring a spectrum twice."""


from spectral_lake.convert import assemble
from spectral_lake.operators import extract, ontology
from spectral_lake.sources import frames
from spectral_lake.streaming import ingest


def obo(path, *terms):
    path.write_text("format-version: 1.2\n" + "".join(f"\n[Term]\nid: {i}\nname: {n}\n" + (f'xref: value-type:xsd\\:{k} "x"\n' if k else "") for i, n, k in terms))
    return str(path)


def test_later_vocabularies_replace_terms(spark, tmp_path):
    uo = obo(tmp_path / "uo.obo", ("UO:1", "metre", "float"), ("UO:2", "Second", None), ("X:9", "shared", None))
    ms = obo(tmp_path / "ms.obo", ("MS:1", "Shared", "int"), ("UO:1", "meter", None))
    ims = obo(tmp_path / "ims.obo", ("IMS:1", "position x", "int"), ("X:9", "SHARED", "string"))
    terms = ontology.load_vocabularies(spark, [uo, ms, ims])
    assert {r["accession"]: (r["name"], r["value_type"]) for r in terms.collect()} == {"UO:1": ("meter", None), "UO:2": ("Second", None), "X:9": ("SHARED", "xsd:string"), "MS:1": ("Shared", "xsd:int"), "IMS:1": ("position x", "xsd:int")}
    # X:9 was met before MS:1, so MS:1 is the later of the two that are called "shared"
    assert {r["name"]: r["accession"] for r in ontology.by_name(terms).collect()} == {"meter": "UO:1", "second": "UO:2", "shared": "MS:1", "position x": "IMS:1"}
    back = {r["accession"]: r["name"] for r in ontology.load_vocabularies(spark, [ms, uo]).collect()}
    assert back["UO:1"] == "metre"


def test_sections_without_any_value_go(spark):
    rows = [("a", "k", "v"), ("a", "l", None), ("b", "k", None), (None, "k", "v")]
    assert sorted(map(tuple, extract.nonempty(spark.createDataFrame(rows, "section string, key string, value string")).collect()), key=str) == [("a", "k", "v"), ("a", "l", None)]
    assert extract.nonempty(spark.createDataFrame([], "section string, key string, value string")).collect() == []


def test_a_spectrum_of_no_slice_counts_in_the_mean(spark):
    rows = [(0, 0, 0, 0, [1.0], [10.0]), (1, 0, 0, 1, [1.0], [20.0]), (2, 0, 0, 7, [1.0, 2.0], [30.0, 5.0])]
    out = assemble(spark.createDataFrame(rows, frames.SPECTRA), (1, 1, 2), "d", 1.0)
    assert sorted((r["slice_id"], r["intensity"]) for r in out["matrix"].collect()) == [("d_z0", 10.0), ("d_z1", 20.0)]
    assert sorted((r["z"], r["value"]) for r in out["tic"].collect()) == [(0, 10.0), (1, 20.0)]
    assert [r["average"] for r in out["spectrum"].orderBy("mz_idx").collect()] == [20.0, 5.0 / 3]
    assert out["attrs"].first()["non_empty_pixels"] == 3


def test_a_spectrum_that_comes_again(spark, tmp_path):
    spectra = lambda *rows: spark.createDataFrame(list(rows), ingest.SCHEMA)
    run = lambda: ingest.append_peaks(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = lambda: sorted((r["spectrum_idx"], r["mz"], r["intensity"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    spectra((1, 0, 0, 0, [1.0, 2.0], [1.0, 1.0]), (1, 0, 0, 0, [1.0], [9.0]), (2, 1, 0, 0, [5.0], [5.0])).write.parquet(str(tmp_path / "in"))
    run()
    first = got()
    assert first == [(1, 1.0, 9.0), (2, 5.0, 5.0)]  # [1.0] sorts before [1.0, 2.0]
    spectra((2, 1, 0, 0, [6.0], [6.0]), (3, 2, 0, 0, [7.0], [7.0])).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert got() == [*first, (3, 7.0, 7.0)]
    run()
    assert got() == [*first, (3, 7.0, 7.0)]


def test_running_totals(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0, 0, [1.0, 2.0], [1.0, 3.0]), (5, 0, 0, 0, [1.0], [8.0]), (2, 1, 0, 0, [5.0], [5.0])], ingest.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = ingest.running_tic(ingest.arriving(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("totals").select("x", "tic", "spectra").collect())) == [(0, 8.0, 2), (1, 5.0, 1)]


