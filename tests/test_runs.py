import pytest

from lodestone.operators import prepare
from lodestone.plans import runs
from lodestone.sources import loaders


def write(path, header, rows):
    path.write_text("\n".join([header, *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


def test_places_of_csv_rows(spark, tmp_path):
    for k, rows in (("b", ["x", "y"]), ("a", ["q", "p", "r"])):
        write(tmp_path / f"{k}.csv", "v,at", [(r, 0) for r in rows])
    got = prepare.in_order(loaders.read_csv(spark, str(tmp_path)), "pos")
    assert [(r.v, r["at"], r.pos) for r in got.orderBy("pos").collect()] == [("q", 0, 0), ("p", 0, 1), ("r", 0, 2), ("x", 0, 3), ("y", 0, 4)]


def test_kmeans_run(spark, tmp_path):
    source = write(tmp_path / "daily.csv", "Date,Price,Cluster,id", [(f"d{i}", p, "old", 7) for i, p in enumerate([1, 1.2, "n/a", 5, 5.5, "", 9, 9.1, 9.2])])
    run = runs.kmeans_run(spark, source, f"{tmp_path}/out")
    assert run.rows.columns == ["Date", "Price", "id", "Cluster"]
    want = {"d0": 0, "d1": 0, "d3": 1, "d4": 1, "d6": 2, "d7": 2, "d8": 2}
    assert {r.Date: r.Cluster for r in run.rows.collect()} == want
    assert {r.Date: r.Cluster for r in loaders.read_csv(spark, f"{tmp_path}/out").collect()} == want
    assert run.report().split("\n") == ["Cluster 0: 2 points, centre Price 1.10", "Cluster 1: 2 points, centre Price 5.25", "Cluster 2: 3 points, centre Price 9.10"]
    with pytest.raises(loaders.MissingColumns):
        runs.kmeans_run(spark, source, features=["price"])
    with pytest.raises(loaders.SourceNotFound):
        runs.kmeans_run(spark, f"{tmp_path}/none.csv")
    with pytest.raises(ValueError, match="between 1 and"):
        runs.kmeans_run(spark, source, k=8)
    with pytest.raises(ValueError, match="no rows"):
        runs.kmeans_run(spark, write(tmp_path / "bad.csv", "Price", [("a",), ("b",)]))


def test_density_runs(spark, tmp_path):
    rows = [(2000 + i % 2, 1 + i % 3, 1.0 + i % 2 / 10) for i in range(40)] + [(2000, "x", 3)]
    source = write(tmp_path / "gas.csv", "year,month,value", rows)
    run = runs.dbscan_run(spark, source, eps=3.0)
    assert run.rows.count() == 41 and run.rows.where("cluster_label is null").count() == 1 and run.report() == "Cluster 0: 40 points"
    zips = write(tmp_path / "zip.csv", "Zip,Consumption (therms),Consumption (GJ)", [(i, 10 * (i // 15) + i % 5 / 9, i % 3 / 7) for i in range(30)] + [(99, 500, 500)])
    run = runs.hdbscan_run(spark, zips, min_cluster_size=5)
    assert run.rows.columns == ["Zip", "Consumption (therms)", "Consumption (GJ)", "Cluster", "Cluster_Probability"]
    assert {r.Zip: r.Cluster for r in run.rows.collect()} == {i: i // 15 for i in range(30)} | {99: -1} and run.report().startswith("Noise: 1 points")
    ordered, first = runs.optics_run(spark, zips, 2.0, 3, "Consumption (therms),2")
    assert ordered.count() == 31 and [r.id for r in first.collect()][0] == 0
