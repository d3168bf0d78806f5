import re
import uuid

import pytest
from pyspark.sql import functions as F

from rankatlas.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, months=range(4), n=40):
    return spark.createDataFrame([(p, p % 7, 1 + p % 5, m) for m in months for p in range(m * n, m * n + n)], "point_id long, business_id int, rank int, scan_month int")


def test_months_are_pruned_and_overwritten(spark, tmp_path):
    path = f"{tmp_path}/facts"
    T.append(rows(spark), path, ["scan_month"])
    T.append(rows(spark, [9]), path, ["scan_month"])
    T.overwrite_partitions(rows(spark, [2], 3), path, ["scan_month"])
    found = T.read_path(spark, path)
    assert {r.scan_month: r["count"] for r in found.groupBy("scan_month").count().collect()} == {0: 40, 1: 40, 2: 3, 3: 40, 9: 40}
    one = found.filter("scan_month = 3 AND rank = 1")
    assert "PartitionFilters: [isnotnull(scan_month" in plan(one) and "PushedFilters: [IsNotNull(rank), EqualTo(rank,1)]" in plan(one) and one.count() == 8
    # months that only a join knows are pruned while the query runs
    wanted = spark.createDataFrame([(3, "x"), (9, "y")], "scan_month int, label string").filter("label = 'y'")
    joined = found.join(F.broadcast(wanted), "scan_month")  # two rows
    assert "dynamicpruning" in plan(joined).lower() and joined.count() == 40


def test_joins_on_the_bucketed_key_need_no_shuffle(spark):
    name, threshold = f"facts_{uuid.uuid4().hex}", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        T.save_facts(rows(spark), f"{name}_a", buckets=4)
        T.save_facts(rows(spark).withColumnRenamed("rank", "best"), f"{name}_b", buckets=4)
        a, b = spark.table(f"{name}_a"), spark.table(f"{name}_b")
        joined = a.filter("scan_month = 1").join(b.filter("scan_month = 1").select("point_id", "best"), "point_id")
        summed = joined.groupBy("point_id").agg(F.min("rank").alias("rank"))
        assert "Exchange" not in plan(summed) and summed.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for t in ("a", "b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def test_jdbc_against_a_live_database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    jvm = spark.sparkContext._jvm
    jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver()
    connection = jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    try:
        statement.execute("CREATE TABLE scans (id INT, engine VARCHAR(20), rank_no INT)")
        for i in range(50):
            statement.execute(f"INSERT INTO scans VALUES ({i * 3 + 10}, '{'ab'[i % 2]}', {i % 5})")
        driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
        assert T.jdbc_bounds(spark, url, "scans", "id", **driver) == (10, 157)
        found = T.read_jdbc_table(spark, url, "scans", "id", 4, **driver)
        assert found.rdd.getNumPartitions() == 4 and found.count() == 50
        some = found.filter("ENGINE = 'a' AND RANK_NO > 3").select("ID")
        assert "PushedFilters: [*IsNotNull(ENGINE), *IsNotNull(RANK_NO), *EqualTo(ENGINE,a), *GreaterThan(RANK_NO,3)]" in plan(some)
        assert sorted(r.ID for r in some.collect()) == [i * 3 + 10 for i in range(50) if i % 2 == 0 and i % 5 > 3]
        statement.execute("DELETE FROM scans")
        assert T.read_jdbc_table(spark, url, "scans", "id", 4, **driver).count() == 0
    finally:
        statement.close()
        connection.close()


@pytest.mark.parametrize("kind", ["parquet", "text"])
def test_pages_are_read_whole(spark, tmp_path, kind):
    html = "<html>\n<p>two\nlines</p>\n</html>"
    if kind == "text":
        (tmp_path / "a.html").write_text(html)
    else:
        T.append(spark.createDataFrame([("u", html)], "url string, html string"), f"{tmp_path}/p")
    (row,) = T.read_pages(spark, f"{tmp_path}/a.html" if kind == "text" else f"{tmp_path}/p", kind).collect()
    assert row.html == html and (row.url == "u" or row.url.endswith("a.html"))


def test_rankings_are_dealt_by_their_number(spark, monkeypatch):
    """However many rankings there are, a task groups a bounded number of them."""
    from rankatlas.plans import catalogue, views

    folder = "/root/testdata/sf0.001"
    few = sorted(map(str, catalogue.queries()["e10_rank_alerts"](spark, folder).collect()))
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    v = views.Views(spark, folder)
    assert v.parts == -(-v.lineitem.count() // 100) > 50
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert f", {v.parts}), REPARTITION_BY_NUM" in plan(v.fact)
    df = catalogue.queries()["e10_rank_alerts"](spark, folder)
    # the sums and the walk over them need no further exchange
    assert plan(df).count("Exchange hashpartitioning(business_id") == 1
    assert sorted(map(str, df.collect())) == few


def test_pages_of_small_rows_are_read_by_many_tasks(spark):
    from rankatlas.plans import catalogue, views

    v = views.Views(spark, "/root/testdata/sf0.001")
    assert v.spread("business", "business_id", rows=10).rdd.getNumPartitions() == -(-v.business.count() // 10) > 10
    assert "REPARTITION_BY_NUM" in catalogue.queries()["i2_built_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e10_rank_alerts", "e17_latest_ranks", "d16_cross_engine", "d18_market_overview", "d19_keyword_area_matrix", "d19_keyword_area_ranks", "d21_competitor_gap", "d21_gap_classes", "d21_geo_gap"])
def test_facts_are_dealt_by_their_number(spark, monkeypatch, name):
    """Rankings, their groups and the orders below them: none is left to the session's partitions."""
    from rankatlas.plans import catalogue, views

    monkeypatch.setattr(views, "TASK_ROWS", 100)
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert any("point_id" in x and x.endswith(", 60") for x in dealt)
    assert any("business_id" in x and x.endswith(", 60") for x in dealt)
    assert any("o_custkey" in x and x.endswith(", 15") for x in dealt)


@pytest.mark.parametrize("name", ["d19_keyword_area_matrix", "d19_keyword_area_ranks", "d21_competitor_gap", "d21_gap_classes", "d21_geo_gap"])
def test_parts_are_written_without_a_sort_while_they_can(spark, monkeypatch, name):
    """Parts stay at as many as Spark writes directly until they hold three times the usual rows, and grow in number from there."""
    from rankatlas.plans import catalogue, views

    assert [views.parts_of(n * 1_000_000) for n in (0, 36, 100, 216, 300, 600)] == [0, 72, 200, 200, 200, 400]
    folder = "/root/testdata/sf0.001"
    few = sorted(map(str, catalogue.queries()[name](spark, folder).collect()))
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    monkeypatch.setattr(views, "DIRECT_PARTS", 30)
    df = catalogue.queries()[name](spark, folder)
    dealt = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert sorted(x.rsplit(", ", 1)[1] for x in dealt) == ["15", "30", "30"]
    assert sorted(map(str, df.collect())) == few


@pytest.mark.parametrize("name", ["d18_market_overview", "d21_competitor_gap", "d21_gap_classes"])
def test_means_meet_businesses_where_they_were_dealt(spark, monkeypatch, name):
    """Where businesses are too many to be broadcast, means of ranks aren't dealt again into the session's few partitions."""
    from rankatlas.plans import catalogue, views

    folder = "/root/testdata/sf0.001"
    few = sorted(map(str, catalogue.queries()[name](spark, folder).collect()))
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalogue.queries()[name](spark, folder)
        dealt = re.findall(r"hashpartitioning\(business_id#\d+L?, (\d+)\), (\w+)", df._jdf.queryExecution().executedPlan().toString())
        assert sorted(set(dealt)) == [("60", "ENSURE_REQUIREMENTS"), ("60", "REPARTITION_BY_NUM")]
        assert sorted(map(str, df.collect())) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
