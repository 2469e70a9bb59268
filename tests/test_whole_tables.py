"""Queries that read their whole tables, on small tables of their own."""

from tessera.plans import catalogue


def write(spark, folder, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_use_by_any_package_counts(spark, tmp_path):
    sf = write(spark, tmp_path, part=([(1, 10), (2, 25), (3, 26), (4, 1)], "p_partkey long, p_size int"), supplier=([(0,)], "s_suppkey long"), lineitem=([(41, 1), (40, 2), (7, 3)], "l_suppkey long, l_partkey long"))
    assert sorted(r.symbol for r in catalogue.QUERIES["unused_labels"](spark, sf).collect()) == [-1, 4]


def test_every_line_is_flattened(spark):
    sf = "/root/testdata/sf0.001"
    classes = catalogue.QUERIES["seam_flatten"](spark, sf).filter("kind IN ('class', 'abstract_class')")
    assert classes.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_every_line_is_ranked(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalogue.QUERIES["rank_points_big"](spark, sf).collect()
    assert sorted(r.rank for r in rows) == list(range(1, spark.read.parquet(f"{sf}/lineitem.parquet").count() + 1)) and min(r.score for r in rows) < 0.8
