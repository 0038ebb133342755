"""File round trips, model store, streaming and the end-to-end workflows (files in tmp only)."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from compscope.functions import fingerprints
from compscope.operators import features, leaders, models, similarity
from compscope.plans import workflows
from compscope.sources import model_store, tables
from compscope.streaming.scoring import score_stream


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("CCO", 1.5, "a,b"), ("CN", None, 'q"q')],
                               "smiles string, y double, note string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"))
    assert back.schema["y"].dataType.typeName() == "double"
    assert {(r["smiles"], r["y"]) for r in back.collect()} == {("CCO", 1.5), ("CN", None)}
    tables.write_parquet(df, str(tmp_path / "pq"), ["smiles"])
    assert tables.read_parquet(spark, str(tmp_path / "pq")).count() == 2


def test_read_libraries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("smi,x\nCCO,1\nCN,2\n")
    (tmp_path / "b.csv").write_text("structure\nCCC\n")
    lib, legend = tables.read_libraries(
        spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ["smi", "structure"], ["A", "B"]
    )
    assert {(r["Structure"], r["Dataset"]) for r in lib.collect()} == {
        ("CCO", "LIB-1"), ("CN", "LIB-1"), ("CCC", "LIB-2")
    }
    assert {tuple(r) for r in legend.collect()} == {("LIB-1", "A"), ("LIB-2", "B")}
    ids = [r["row_id"] for r in lib.orderBy("row_id").collect()]
    assert len(set(ids)) == 3 and [r["Structure"] for r in lib.orderBy("row_id").collect()] == ["CCO", "CN", "CCC"]


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("smiles,name\nCCO,é\n".encode("utf-8"))
    (tmp_path / "l.csv").write_bytes('smiles,name\r\nCN,"é, x"\r\nCC,plain\r\n'.encode("latin-1"))
    found = {r["file"].split("/")[-1]: r["encoding"] for r in tables.detect_encodings(
        spark, str(tmp_path), header_has="smiles").collect()}
    assert found["u.csv"] == "utf_8" and found["l.csv"] not in ("utf_8", "ascii", "cp037")
    rows, rejects = tables.read_csv_any_encoding(
        spark, str(tmp_path), "smiles string, name string", ("utf_8", "latin_1"), "smiles"
    )
    assert rejects.count() == 0
    assert {(r["smiles"], r["name"]) for r in rows.collect()} == {
        ("CCO", "é"), ("CN", "é, x"), ("CC", "plain")
    }
    assert len(tables.ENCODINGS) == 97


def test_no_file_and_no_line_is_lost(spark, tmp_path):
    text = "smiles,name\r\nCCO,\u00e9\r\nsmiles,name\r\nCN,\u0416\r\n"
    for name, enc in (("a", "utf-16"), ("b", "utf-16-be"), ("c", "utf-32"), ("d", "utf-16-le"), ("e", "utf-8-sig"), ("g", "utf-32-be")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(enc))
    (tmp_path / "f.csv").write_text("Name,SMILES,more\nx,CC,1\n\"y, z\",CCC,2\n")
    (tmp_path / "bad.csv").write_bytes(b"smiles,name\nCC,\xff\xff\n")
    rows, rejects = tables.read_csv_any_encoding(
        spark, str(tmp_path), "smiles string, name string",
        ("utf_8", "utf_16_le", "utf_16_be", "utf_32_le", "utf_32_be"),
    )
    got = sorted((r["smiles"], r["name"]) for r in rows.collect())
    assert got == sorted(
        [("CCO", "\u00e9"), ("smiles", "name"), ("CN", "\u0416")] * 6 + [("CC", "x"), ("CCC", "y, z")]
    )
    assert [r["file"].split("/")[-1] for r in rejects.collect()] == ["bad.csv"]


def test_malformed_rows_are_told(spark, tmp_path):
    (tmp_path / "x.csv").write_text("smiles,y\nCCO,1.5\nCN,high\nCC,2,3\n")
    rows, bad = tables.read_csv_checked(spark, str(tmp_path / "x.csv"), "smiles string, y double")
    assert [tuple(r) for r in rows.collect()] == [("CCO", 1.5)]
    assert {r["_corrupt_record"] for r in bad.collect()} == {"CN,high", "CC,2,3"}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(400).select(
        "id",
        F.array(*[((F.col("id") * k) % 17).cast("double") for k in (3, 5, 7)],
                ((F.col("id") * 3) % 17 * 2).cast("double"), F.lit(1.0)).alias("arr"),
    )
    return rows.withColumn("label", (F.col("arr")[0] > 8).cast("double")).withColumn(
        "features", array_to_vector("arr")
    ).cache()


@pytest.mark.parametrize("task", [models.CLASSIFIER, models.REGRESSOR])
def test_consensus_saved_loaded_and_streamed(spark, tmp_path, labelled, task):
    model = models.fit(labelled, task, "Consensus", "features", trees=3, depth=3)
    assert len(model.members) == 4
    path = str(tmp_path / "model")
    model_store.save_model(spark, model, path, label_threshold=0.5)
    loaded = model_store.load_model(spark, path)
    assert (loaded.task, loaded.algorithm, loaded.descriptor) == (task, "Consensus", "features")
    want = {r["id"]: r["score"] for r in model.score(labelled, digits=4).collect()}
    assert {r["id"]: r["score"] for r in loaded.score(labelled, digits=4).collect()} == want
    src = str(tmp_path / "in")
    labelled.select("id", "features").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    score_stream(stream, loaded, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["id"]: r["score"] for r in got.collect()} == want


def test_preprocessing_drops_the_right_features(labelled):
    fitted = features.VarianceFilter(inputCol="features", outputCol="v", threshold=0.05).fit(labelled)
    assert fitted.getIndices() == [0, 1, 2, 3]
    two = features.CorrelationFilter(inputCol="v", outputCol="c").fit(fitted.transform(labelled))
    assert two.getIndices() == [0, 1, 2]
    scaled = features.PopulationScaler(inputCol="v", outputCol="s").fit(fitted.transform(labelled))
    out = features.vector_statistics(scaled.transform(fitted.transform(labelled)), "s").collect()
    assert all(abs(r["mean"]) < 1e-9 and abs(r["variance"] - 1) < 1e-9 for r in out)


def test_bits_to_vector(spark):
    df = spark.createDataFrame([([0, 3],), ([],), (None,)], "b array<int>")
    rows = features.bits_to_vector(df, "b", 5, "v").collect()
    assert [r["v"].toArray().tolist() for r in rows] == [[1.0, 0.0, 0.0, 1.0, 0.0], [0.0] * 5, [0.0] * 5]


def test_train_and_benchmark_by_group(spark, tmp_path, labelled):
    table = labelled.withColumn("scaffold", (F.col("id") % 40).cast("string")).withColumn(
        "y", F.col("arr")[0].cast("string")
    )
    summary, cv = workflows.train_and_benchmark(
        table.select("id", "scaffold", "y", "arr"), "id", "y", ["arr"], ["RandomForest", "ExtraTrees"],
        models.CLASSIFIER, threshold=8, group="scaffold", n_folds=2, trees=3, depth=3,
        model_dir=str(tmp_path),
    )
    rows = summary.collect()
    assert summary.columns[:4] == ["desc", "algo", "Test_ACC", "Test_AUC"]
    assert {r["algo"] for r in rows} == {"RandomForest", "ExtraTrees"} and cv.count() == 4
    assert all(r["Val_AUC"] > 0.9 and r["Val_AUC_std"] is not None for r in rows)
    model = model_store.load_model(spark, rows[0]["model_path"])
    fresh = labelled.select("id", F.col("label").alias("exp"), array_to_vector("arr").alias("arr"))
    scored, stats = workflows.predict_table(fresh, model, "exp", observed="exp")
    assert "exp_pred" in scored.columns and stats.first()["accuracy"] > 0.9
    blind, none = workflows.predict_table(fresh.drop("exp"), model, "p")
    assert none is None and blind.first()["label"].startswith("pred: ")


def test_regression_prediction_report(labelled):
    data = labelled.withColumn("label", F.col("arr")[0])
    model = models.fit(data, models.REGRESSOR, "RandomForest", "features", trees=3, depth=4)
    scored, stats = workflows.predict_table(
        data.select("features", F.col("arr")[0].alias("exp")), model, "pred", observed="exp"
    )
    assert "|error|" in scored.columns and stats.first()["pearson_r"] > 0.8


def test_diversity_and_addressability(spark):
    smiles = ["CCO", "CCOC", "c1ccccc1CC", "c1ccccc1CN", "C1CCCCC1O", "C(", " CCO", "CCCCCCCCCl",
              "c1ccncc1C(=O)NC", "c1ccncc1C(=O)NCC"]
    rows = [(i, s, f"LIB-{1 + i % 2}") for i, s in enumerate(smiles)]
    lib = spark.createDataFrame(rows, "id long, smiles string, Dataset string")
    ref = spark.createDataFrame([(1, "CCO"), (2, "NNN")], "row_id long, BM string")

    def fingerprint(c):
        return fingerprints.qgram_fingerprint(c, q=2)

    div = workflows.library_diversity(
        lib, "id", "smiles", fingerprints.smiles_normalised, fingerprints.smiles_well_formed,
        lambda c: F.substring(c, 1, 8), fingerprint, 0.65, ref,
    )
    assert [r["id"] for r in div.rejects.collect()] == [5]
    assert div.compounds.count() == 9
    counts = {r["Dataset"]: r["n_clusters"] for r in div.cluster_counts.collect()}
    assert counts["reference"] == 2 and sum(counts.values()) == div.centroids.count()
    train = div.compounds.withColumn(
        "label", F.length("Molecule").cast("double")
    ).withColumn("features", array_to_vector(fingerprints.string_descriptors(F.col("Molecule"))))
    model = models.fit(train, models.REGRESSOR, "RandomForest", "features", trees=3, depth=3)
    result = workflows.addressability(
        div, model,
        lambda df: df.withColumn(
            "features", array_to_vector(fingerprints.string_descriptors(F.col("Molecule")))
        ),
        fingerprint,
    )
    assert result.curve.count() == 9
    assert result.best.count() == result.scored.select("Dataset", "cluster_ID").distinct().count()


def test_stored_reference_novelty_and_tree(spark):
    smiles = [f"c1ccccc1{'CNO'[i % 3]}{'C' * (i % 5)}" for i in range(30)]
    lib = spark.createDataFrame([(i, s, f"LIB-{1 + i % 2}") for i, s in enumerate(smiles)], "id long, smiles string, Dataset string")

    def bits(c):
        return fingerprints.qgram_fingerprint(c, q=3, n_bits=1024)

    known = spark.createDataFrame([(7, "c1ccccc1CC"), (8, "XYZ")], "row_id long, BM string")
    div = workflows.library_diversity(
        lib, "id", "smiles", fingerprints.smiles_normalised, fingerprints.smiles_well_formed, lambda c: c, bits, 0.65,
        n_bits=1024, reference_leaders=known.withColumn("bits", bits(F.col("BM"))),
    )
    counts = {r["Dataset"]: r["n_clusters"] for r in div.cluster_counts.collect()}
    assert counts["reference"] == 2 and set(counts) == {"LIB-1", "LIB-2", "reference"}
    novel = {r["BM"]: r["Datasets"] for r in div.novel.collect()}
    assert set(novel) == set(smiles) - {"c1ccccc1CC"} and all(d in (["LIB-1"], ["LIB-2"], ["LIB-1", "LIB-2"]) for d in novel.values())
    n = len({*smiles, "XYZ"})
    for width in (None, 1024):
        nodes, edges = workflows.scaffold_tree(div, k=n, n_bits=width)
        assert nodes.count() == n and {"src", "dst", "weight"} == set(edges.columns)
    assert edges.count() == n - 1  # all neighbours: one tree
    total = edges.agg(F.sum("weight")).first()[0]
    sets = {r["BM"]: set(r["bits"]) for r in div.scaffolds.select("BM", "bits").collect()}
    left, inside, want = set(sets), {min(sets)}, 0
    left -= inside
    while left:  # Prim
        w, x = min((10**6 - 10**6 * len(sets[a] & sets[b]) // max(1, len(sets[a] | sets[b])), b) for a in inside for b in left)
        want, inside = want + w, inside | {x}
        left.remove(x)
    assert total == want


def test_workflows_take_the_block_path(spark, monkeypatch):
    """With the width of the fingerprints, no inverted index is built and the clusters are the same."""
    smiles = [f"c1ccccc1{'CNO'[i % 3]}{'C' * (i % 7)}{'N' * (i // 21)}" for i in range(60)]
    lib = spark.createDataFrame([(i, s, f"LIB-{1 + i % 2}") for i, s in enumerate(smiles)], "id long, smiles string, Dataset string")

    def describe(df):
        return df.withColumn("features", array_to_vector(fingerprints.string_descriptors(F.col("Molecule"))))

    def run(n_bits):
        div = workflows.library_diversity(
            lib, "id", "smiles", fingerprints.smiles_normalised, fingerprints.smiles_well_formed, lambda c: c,
            lambda c: fingerprints.qgram_fingerprint(c, q=3, n_bits=1024), 0.65, n_bits=n_bits,
        )
        train = describe(div.compounds.withColumn("label", F.length("Molecule").cast("double")))
        model = models.fit(train, models.REGRESSOR, "RandomForest", "features", trees=2, depth=2)
        placed = workflows.addressability(div, model, describe, n_bits=n_bits).scored
        return (
            sorted(tuple(r) for r in div.centroids.select("Dataset", "row_id").collect()),
            sorted(tuple(r) for r in placed.select("Dataset", "row_id", "cluster_ID").collect()),
        )

    sparse = run(None)
    for module in (leaders, similarity):
        monkeypatch.setattr(module, "similarity_join", None)
    assert run(1024) == sparse


def test_materialised_tables_live_in_the_shared_folder(spark):
    import os

    from compscope.session import materialise, shared_folder

    df = materialise(spark.range(5).withColumn("b", F.col("id") % 2), "t", "b")
    assert df.columns == ["id", "b"] and df.count() == 5
    file = df.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.normpath(file).startswith(os.path.normpath(shared_folder(spark).removeprefix("file:")))


def test_shuffle_files_go_with_the_write_and_tables_can_be_discarded(spark):
    import os

    from compscope.session import CLEANUP, discard, materialise

    kept = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    rows = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before, switch = kept.size(), spark.conf.get(CLEANUP)
    table = materialise(rows, "counted")
    assert kept.size() <= before and spark.conf.get(CLEANUP) == switch
    assert rows.count() == table.count() == 10
    folder = table.written_to
    discard(table)
    assert not os.path.exists(folder)


def test_predict_from_file_to_file(spark, tmp_path):
    train = spark.range(200).select(
        F.concat(F.lit("C"), F.repeat(F.lit("C"), (F.col("id") % 9).cast("int"))).alias("smiles")
    ).withColumn("label", (F.length("smiles") > 5).cast("double"))

    def describe(df):
        return df.withColumn("features", array_to_vector(fingerprints.string_descriptors(F.col("smiles"))))

    model = models.fit(describe(train), models.CLASSIFIER, "RandomForest", "features", trees=3, depth=3)
    model_store.save_model(spark, model, str(tmp_path / "model"), label_threshold=4.5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("smiles,exp,note\nCCCCCCCC,8,\u00e9\nCC,2,b\nC(,1,c\n".encode("utf-16"))
    (tmp_path / "in" / "b.csv").write_text("exp,smiles,note\n7,CCCCCCC,d\nhigh,CCC,e\n3,CCC,f\n")
    got = workflows.predict_file(
        spark, str(tmp_path / "in"), str(tmp_path / "model"), str(tmp_path / "out"), "smiles",
        "smiles string, exp double, note string", fingerprints.smiles_normalised,
        fingerprints.smiles_well_formed, describe, "score", observed="exp",
    )
    rows = {r["smiles"]: r for r in got.scored.collect()}
    assert set(rows) == {"CCCCCCCC", "CC", "CCCCCCC", "CCC"} and "features" not in got.scored.columns
    assert all((r["score"] > 0.5) == r["exp_class"] == (r["exp"] > 4.5) for r in rows.values())
    assert [r["smiles"] for r in got.rejects.collect()] == ["C("]
    assert [r["_corrupt_record"] for r in got.malformed.collect()] == ["high,CCC,e"]
    assert got.report.first()["accuracy"] == 1.0 and got.undecodable.count() == 0
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 4
