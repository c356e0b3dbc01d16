"""Order operators against plain windows: a hot tie, null keys, null scores, quotas out of range."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from punctua.functions.columns import seeded_hash
from punctua.operators import order


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(9000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7))
        .alias("grp"),
        F.when(F.col("id") % 3 == 1, F.lit(0.25))
        .otherwise(seeded_hash("score", "id") % 1009 / 1009.0).alias("score"),
    )
    return df.persist()


def quotas(spark, rows, by, fraction):
    if by:
        return rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn(
            "k", F.floor(F.col("n") * fraction).cast("bigint"))
    n = rows.count()
    return spark.createDataFrame([(n, int(n * fraction))], "n bigint, k bigint")


@pytest.fixture(scope="module")
def holes(spark, rows):
    """Rows with null keys, null scores, a group of nulls alone."""
    score = F.when(F.col("id") % 11 == 0, None).when(F.col("grp") == "g3", None).otherwise(
        F.col("score"))
    key = F.when(F.col("grp") == "g5", None).otherwise(F.col("grp"))
    return rows.select("id", score.alias("score"), key.alias("grp")).persist()


def taken(spark, table, by, ascending, k):
    """Ids of the first k rows per group in a plain window; nulls are the lowest."""
    keys = [F.col(c) if ascending else F.col(c).desc() for c in ("score", "id")]
    place = F.row_number().over(W.partitionBy(*by).orderBy(*keys))
    size = F.count("*").over(W.partitionBy(*by))
    plain = table.withColumn("r", place).withColumn("n", size)
    return {r.id for r in plain.where(F.col("r") <= k(F.col("n"))).collect()}


@pytest.mark.parametrize("by", [[], ["grp"]])
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("table", ["rows", "holes"])
@pytest.mark.parametrize("fraction", [0.4, 0.0, 1.0, 1.5, -0.1])
def test_top_k_equals_window(spark, request, table, by, ascending, fraction):
    df = request.getfixturevalue(table)
    q = quotas(spark, df, by, fraction)
    got = order.top_k(df, "score", "id", q, by, ascending)
    assert got.count() == df.count()
    want = taken(spark, df, by, ascending, lambda n: F.floor(n * fraction))
    assert {r.id for r in got.where("selected").collect()} == want


@pytest.mark.parametrize("by", [[], ["grp"]])
@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_and_sums_with_nulls(holes, by, ascending):
    keys = [F.col(c) if ascending else F.col(c).desc() for c in ("score", "id")]
    both = order.rank_all(holes, "score", "id", by, ascending).withColumn(
        "want", F.row_number().over(W.partitionBy(*by).orderBy(*keys)))
    assert both.count() == holes.count() and both.where("rank <> want").count() == 0
    cells = holes.groupBy(*by, "score").agg(F.count("*").alias("c"))
    got = order.prefix_sums(cells, "score", ["c"], by, ascending).withColumn(
        "want", F.sum("c").over(W.partitionBy(*by).orderBy(keys[0])))
    assert got.count() == cells.count() and got.where("cum_c <> want").count() == 0


def test_draw_of_more_rows_than_there_are(spark, holes):
    q = holes.groupBy("grp").agg((F.count("*") + 5).alias("k"))
    assert order.first_by_hash(holes, "id", "s", q, ["grp"]).where("drawn").count() == 9000
    all_ = spark.createDataFrame([(9005,)], "k bigint")
    assert order.first_by_hash(holes, "id", "s", all_).where("drawn").count() == 9000
    none = spark.createDataFrame([(-1,)], "k bigint")
    assert order.first_by_hash(holes, "id", "s", none).where("drawn").count() == 0


@pytest.mark.parametrize("by, ascending", [([], True), (["grp"], False)])
def test_rank_all_equals_window(rows, by, ascending):
    keys = [F.col(c) if ascending else F.col(c).desc() for c in ("score", "id")]
    both = order.rank_all(rows, "score", "id", by, ascending).withColumn(
        "want", F.row_number().over(W.partitionBy(*by).orderBy(*keys)))
    assert both.count() == rows.count()
    assert both.where("rank <> want").count() == 0


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_hash_cut_takes_exactly_k(spark, rows, by):
    q = quotas(spark, rows, by, 0.2)
    got = order.first_by_hash(rows, "id", "s", q, by).where("drawn")
    plain = rows.withColumn("r", F.row_number().over(
        W.partitionBy(*by).orderBy(seeded_hash("s", "id"), "id")))
    plain = plain.join(q, by) if by else plain.withColumn("k", F.lit(q.first()["k"]))
    assert {r.id for r in got.collect()} == {r.id for r in plain.where("r <= k").collect()}


def test_kth_values_many_ranks(spark, rows):
    ranks = [1, 2, 17, 2999, 3000, 4500, 8999, 9000]
    q = spark.createDataFrame([(k,) for k in ranks + [0, 9001]], "k bigint")
    got = {r.k: r.cut_value for r in order.kth_values(rows, "score", q).collect()}
    values = sorted(r.score for r in rows.collect())
    assert got == {k: values[k - 1] for k in ranks}


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("shared, ascending", [(True, False), (False, True)])
def test_prefix_sums_equal_window(monkeypatch, rows, shared, ascending, fits):
    if not fits:
        monkeypatch.setattr(order, "collected", lambda df: None)
    cells = rows.groupBy("grp", "score").agg(F.count("*").alias("c"))
    key = F.col("score") if ascending else F.col("score").desc()
    got = order.prefix_sums(cells, "score", ["c"], ["grp"], ascending, shared)
    got = got.withColumn("want", F.sum("c").over(W.partitionBy("grp").orderBy(key)))
    assert got.count() == cells.count()
    assert got.where("cum_c <> want").count() == 0


def test_dense_position(rows):
    got = order.dense_position(rows, ["grp", "score", "id"], "pos").withColumn(
        "want", F.row_number().over(W.orderBy("grp", "score", "id")) - 1)
    assert got.where("pos <> want").count() == 0


def test_quantiles_equal_percentile(holes):
    probs = [0.0, 0.3, 0.5, 1.0]
    got = {(r.grp, r.prob): r.quantile
           for r in order.quantiles(holes, "score", probs, ["grp"]).collect()}
    points = ", ".join(map(str, probs))
    plain = holes.groupBy("grp").agg(F.expr(f"percentile(score, array({points}))").alias("q"))
    want = {(r.grp, p): v for r in plain.collect() if r.q for p, v in zip(probs, r.q)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_positions_of_keys_with_nulls_and_one_prefix(spark):
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 50 = 0 THEN NULL ELSE concat('same-prefix-', id) END AS a", "id")
    got = order.dense_position(df, ["a", "id"], "pos").withColumn(
        "want", F.row_number().over(W.orderBy("a", "id")) - 1)
    assert got.count() == 3000 and got.where("pos <> want").count() == 0


def test_settle_keeps_all_rows_beyond_its_bound(spark):
    from punctua.session import settle

    assert settle(spark.range(100), bound=10).count() == 100
    assert settle(spark.range(10), bound=10).count() == 10


@pytest.mark.parametrize("by", [[], ["grp"]])
@pytest.mark.parametrize("slice_rows", [5, 400])
def test_narrowing_equals_window(spark, monkeypatch, holes, by, slice_rows):
    """Parts of few rows, so that values and ids of a hot tie are narrowed several times."""
    monkeypatch.setattr(order, "SLICE", slice_rows)
    monkeypatch.setattr(order, "GRID", 10)
    monkeypatch.setattr(order, "ACCURACY", 50)
    q = quotas(spark, holes, by, 0.37)
    got = order.top_k(holes, "score", "id", q, by)
    want = taken(spark, holes, by, False, lambda n: F.floor(n * 0.37))
    assert {r.id for r in got.where("selected").collect()} == want
    found = order.quantiles(holes.where("score IS NOT NULL"), "score", [0.1, 0.5, 0.9], by)
    plain = {r[0] if by else None: r.q for r in holes.groupBy(*by).agg(
        F.expr("percentile(score, array(0.1, 0.5, 0.9))").alias("q")).collect() if r.q}
    for r in found.collect():
        want = plain[r.grp if by else None][[0.1, 0.5, 0.9].index(r.prob)]
        assert abs(r.quantile - want) < 1e-12


def test_equal_ids_do_not_stop_a_draw(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("id"))
    q = spark.createDataFrame([(700,)], "k bigint")
    assert order.first_by_hash(rows, "id", "s", q).where("drawn").count() == 1000
