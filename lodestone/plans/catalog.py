"""Registry of the named queries. Each entry maps (spark, sf_dir) to a DataFrame; SQL holds its DuckDB twin.

Queries run over their whole tables. Where a query needs missing values, which the tables do not have, both sides derive
them by the same rule (null where event_id is a multiple of 13).
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scratch import Scratch
from ..functions.shipping import ship
from ..operators import charts, dbscan, hdbscan, kmeans, mlp, neighbors, optics, pca, prepare, profile, sentiment
from ..sources import loaders
from ..streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)

            def table(name: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{name}.parquet")

            table.in_order = lambda name: loaders.read_parquet_in_order(spark, f"{sf_dir}/{name}.parquet")
            return f(table)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, to: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), to) for n in names})


def rounded_pairs(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, scalars.round_fast(F.col(name), 4))


HOLES = "SELECT event_id, ts, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events"


def holes(t) -> DataFrame:
    return t("events").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"))


# ---- profiles

STATS = "count({0}) AS count, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, round(min({0}), 4) AS min, round(quantile_cont({0}, 0.25), 4) AS p25, round(quantile_cont({0}, 0.5), 4) AS p50, round(quantile_cont({0}, 0.75), 4) AS p75, round(max({0}), 4) AS max"
NUMBERS = ("mean", "std", "min", "p25", "p50", "p75", "max")


def describe_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {STATS.format(f'CAST({c} AS DOUBLE)')} FROM {table}" for c in columns)


PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_price", describe_sql("lineitem", PRICES))
def _(t):
    return rounded(profile.describe(t("lineitem"), PRICES), *NUMBERS)


@query("describe_customer_balance", describe_sql("customer", ["c_acctbal"]))
def _(t):
    return rounded(profile.describe(t("customer"), ["c_acctbal"]), *NUMBERS)


@query("describe_all_numeric_part", describe_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def _(t):
    return rounded(profile.describe(t("part")), *NUMBERS)


def counts_sql(table: str, column: str) -> str:
    return f"SELECT {column} AS level, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1"


@query("value_counts_event_type", counts_sql("events", "event_type"))
def _(t):
    return profile.value_counts(t("events"), "event_type")


@query("value_counts_segment", counts_sql("customer", "c_mktsegment"))
def _(t):
    return profile.value_counts(t("customer"), "c_mktsegment")


@query("group_counts_priority", counts_sql("orders", "o_orderpriority"))
def _(t):
    return charts.count_series(t("orders"), "o_orderpriority")


@query("count_series_filtered", counts_sql("orders", "o_orderpriority") .replace("WHERE", "WHERE o_orderstatus = 'F' AND"))
def _(t):
    return charts.count_series(t("orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("distinct_returnflag", "SELECT DISTINCT l_returnflag AS level FROM lineitem")
def _(t):
    return profile.distinct_values(t("lineitem"), "l_returnflag")


@query("null_report_events", f"WITH h AS ({HOLES}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM h" for c in ("event_id", "ts", "event_type", "value")))
def _(t):
    return profile.null_report(holes(t))


@query("null_total_events", f"WITH h AS ({HOLES}) SELECT CAST(count(*) * 4 - count(event_id) - count(ts) - count(event_type) - count(value) AS BIGINT) AS n_missing, count(*) * 4 > count(event_id) + count(ts) + count(event_type) + count(value) AS any_missing FROM h")
def _(t):
    return profile.null_total(holes(t))


@query("schema_info_customer", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS n_present FROM customer" for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))))
def _(t):
    return profile.schema_info(t("customer"))


@query("shape_orders", "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders")
def _(t):
    return profile.shape(t("orders"))


@query("corr_matrix_lineitem", " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({'1.0::DOUBLE' if a == b else f'corr({min(a, b)}, {max(a, b)})'}, 6) AS r FROM lineitem{' LIMIT 1' if a == b else ''}" if a != b else f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(1 AS DOUBLE) AS r" for a in PRICES for b in PRICES))
def _(t):
    return rounded(profile.correlations(t("lineitem"), PRICES), "r", to=6)


@query("corr_heat_map", " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(round({'1' if a == b else f'corr({a}, {b})'} * 100, 0) AS INTEGER) AS percent FROM part" + (" LIMIT 1" if a == b else "") if a != b else f"SELECT '{a}' AS col_a, '{a}' AS col_b, 100 AS percent" for a in ("p_size", "p_retailprice") for b in ("p_size", "p_retailprice")))
def _(t):
    return charts.heat_map(t("part"), ["p_size", "p_retailprice"])


@query("corr_pairwise_missing", f"WITH h AS ({HOLES}) SELECT 'event_id' AS col_a, 'value' AS col_b, round(corr(event_id, value), 6) AS r FROM h WHERE value IS NOT NULL")
def _(t):
    return rounded(profile.correlations(holes(t), ["event_id", "value"]).where("col_a < col_b"), "r", to=6)


@query("head_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t):
    return profile.head(t("orders"), "o_orderkey")


@query("crosstab_flag_status", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def _(t):
    return profile.crosstab(t("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query(
    "violin_density_value_by_type",
    """WITH s AS (SELECT event_type AS level, count(*) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY 1 HAVING max(value) > min(value)),
p AS (SELECT level, low, n, h, high, (high - low) / 1023 AS step, (value - low) / ((high - low) / 1023) AS x FROM events JOIN s ON level = event_type),
b AS (SELECT level, least(floor(x), 1022) + d AS bin, sum(CASE d WHEN 0 THEN 1 - (x - least(floor(x), 1022)) ELSE x - least(floor(x), 1022) END) AS w FROM p, range(2) r(d) GROUP BY 1, 2),
g AS (SELECT level, n, h, low, (high - low) / 1023 AS step, place, low - 2 * h + (high - low + 4 * h) * place / 99 AS y FROM s, range(100) r(place))
SELECT level, CAST(place AS INTEGER) AS place, round(y, 6) AS "at", round(sum(w * exp(-pow((y - low - bin * step) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM g JOIN b USING (level) GROUP BY level, place, y""",
)
def _(t):
    return rounded(rounded(profile.density_grid(t("events"), "event_type", "value"), "at", to=6), "density", to=8)


@query("violin_stats_value_by_type", "SELECT event_type AS level, count(*) AS n, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(max(value), 4) AS max FROM events GROUP BY 1")
def _(t):
    return rounded(profile.group_quartiles(t("events"), "event_type", "value"), "min", "p25", "p50", "p75", "max")


# ---- preparation


@query("project_drop_slice", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(t):
    return prepare.first_columns(t("customer").drop("c_mktsegment"), 3)


@query("positional_rename", "SELECT r_regionkey AS id, r_name AS label FROM region")
def _(t):
    return prepare.rename_all(t("region"), ["id", "label"])


@query("coerce_numeric_part_brand", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE right(p_brand, 2) END AS DOUBLE) AS x FROM part WHERE TRUE")
def _(t):
    raw = t("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.expr("right(p_brand, 2)")).alias("x"))
    return prepare.coerce(raw, ["x"])


@query("dropna_count", f"WITH h AS ({HOLES}) SELECT count(*) AS n_before, count(value) AS n_after, count(*) - count(value) AS n_dropped FROM h")
def _(t):
    return prepare.dropped_rows(holes(t), ["value"])


@query("dropna_rows", f"SELECT event_id, value FROM ({HOLES}) WHERE value IS NOT NULL")
def _(t):
    return prepare.drop_missing(holes(t).select("event_id", "value"), ["value"])


for _how, _f in (("mean", "avg"), ("median", "median")):

    @query(f"impute_{_how}_events", f"WITH h AS ({HOLES}) SELECT event_id, round(coalesce(value, (SELECT {_f}(value) FROM h)), 4) AS value FROM h")
    def _(t, how=_how):
        return rounded(prepare.impute(holes(t).select("event_id", "value"), ["value"], how), "value")


@query("one_hot_segment", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def _(t):
    return prepare.one_hot(t("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("binary_recode_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished FROM orders")
def _(t):
    return t("orders").select("o_orderkey", scalars.recode(F.col("o_orderstatus"), "F").alias("finished"))


@query("replace_level", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'bought' ELSE event_type END AS event_type FROM events")
def _(t):
    return prepare.replace_levels(t("events").select("event_id", "event_type"), "event_type", {"purchase": "bought"})


@query("standardize_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in ("l_quantity", "l_tax")) + ", CAST(0 AS DOUBLE) AS one FROM lineitem")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(1.0).alias("one"))
    return rounded(prepare.standardise(rows, ["l_quantity", "l_tax", "one"]), "l_quantity", "l_tax", to=6)


@query("minmax_part", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE), 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def _(t):
    return rounded(prepare.min_max(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice", to=6)


@query("pixel_scale_embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 255.0)), 8) AS total, len(embedding) AS n FROM embeddings")
def _(t):
    scaled = t("embeddings").select("vec_id", scalars.scale_pixels(F.col("embedding")).alias("p"))
    return scaled.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 8).alias("total"), F.size("p").cast("long").alias("n"))


@query("flatten_embeddings", "SELECT vec_id, CAST(v[1] AS DOUBLE) AS first, CAST(v[64] AS DOUBLE) AS last, CAST(len(v) AS BIGINT) AS n FROM (SELECT vec_id, flatten(list_transform(range(8), lambda i: embedding[8 * i + 1 : 8 * i + 8])) AS v FROM embeddings)")
def _(t):
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    flat = t("embeddings").select("vec_id", scalars.flatten_pixels(image).alias("v"))
    return flat.select("vec_id", F.col("v")[0].cast("double").alias("first"), F.col("v")[63].cast("double").alias("last"), F.size("v").cast("long").alias("n"))


@query("file_positions_orders", "SELECT o_orderkey, row_number() OVER () - 1 AS pos FROM orders")
def _(t):
    return t.in_order("orders").select("o_orderkey", "pos")


@query("file_head_customer", "SELECT c_custkey, c_name, CAST(pos AS BIGINT) AS pos FROM (SELECT *, row_number() OVER () - 1 AS pos FROM customer) WHERE pos < 5")
def _(t):
    return loaders.first_rows(t.in_order("customer")).select("c_custkey", "c_name", "pos")


@query("row_positions_orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def _(t):
    rows = t("orders").select("o_orderkey")
    return prepare.row_positions(rows, "o_orderkey", Scratch(rows.sparkSession))


@query("label_attach_left", f"WITH h AS ({HOLES}) SELECT event_id, CAST(CASE WHEN value IS NULL THEN NULL WHEN value > 100 THEN 1 ELSE 0 END AS INTEGER) AS label FROM h")
def _(t):
    h = holes(t)
    labels = h.where("value is not null").select("event_id", F.when(F.col("value") > 100, 1).otherwise(0).alias("label"))
    return prepare.attach_labels(h.select("event_id"), labels, "event_id")


# ---- neighbourhoods

PAIRS = "pts AS (SELECT {id} AS id, CAST({x} AS DOUBLE) AS x FROM {table}), pairs AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x)) AS dist FROM pts a JOIN pts b ON sqrt((a.x - b.x) * (a.x - b.x)) <= {eps})"
CUSTOMERS = PAIRS.format(id="c_custkey", x="c_acctbal", table="customer", eps=15)
CORE = "cores AS (SELECT src AS id, max(CASE WHEN k = 5 THEN dist END) AS core_distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS k FROM pairs) WHERE k <= 5 GROUP BY src)"


@query("pairwise_distance_supplier", "WITH " + PAIRS.format(id="s_suppkey", x="s_acctbal", table="supplier", eps=500) + " SELECT src, dst, round(dist, 4) AS dist FROM pairs")
def _(t):
    return rounded_pairs(neighbors.eps_pairs(t("supplier"), "s_suppkey", ["s_acctbal"], 500.0), "dist")


@query("eps_neighbors_customer", f"WITH {CUSTOMERS} SELECT src, dst, round(dist, 4) AS dist FROM pairs")
def _(t):
    return rounded_pairs(neighbors.eps_pairs(t("customer"), "c_custkey", ["c_acctbal"], 15.0), "dist")


@query("eps_neighbors_2d", "WITH pts AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer) SELECT a.id AS src, b.id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS dist FROM pts a JOIN pts b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 12")
def _(t):
    return rounded_pairs(neighbors.eps_pairs(t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], 12.0), "dist")


@query("eps_neighbor_counts", f"WITH {CUSTOMERS} SELECT src AS id, count(*) AS n_neighbors FROM pairs GROUP BY 1")
def _(t):
    return dbscan.neighbor_counts(t("customer"), "c_custkey", ["c_acctbal"], 15.0)


@query("cell_neighbor_counts", SQL["eps_neighbor_counts"])
def _(t):
    return dbscan.neighbor_counts(t("customer"), "c_custkey", ["c_acctbal"], 15.0)


@query("core_distance_customer", f"WITH {CUSTOMERS}, {CORE} SELECT id, round(core_distance, 4) AS core_distance FROM cores")
def _(t):
    return rounded(neighbors.cores_within(t("customer"), "c_custkey", ["c_acctbal"], 15.0, 5), "core_distance")


@query("reachability_edges", f"WITH {CUSTOMERS}, {CORE} SELECT src, dst, round(greatest(core_distance, dist), 4) AS reach FROM pairs JOIN cores ON src = id WHERE core_distance IS NOT NULL")
def _(t):
    return rounded_pairs(neighbors.reachability_within(t("customer"), "c_custkey", ["c_acctbal"], 15.0, 5), "reach")


@query("hdbscan_mutual_reachability", f"WITH {CUSTOMERS}, {CORE} SELECT src, dst, round(greatest(a.core_distance, b.core_distance, dist), 4) AS reach FROM pairs JOIN cores a ON src = a.id JOIN cores b ON dst = b.id WHERE src < dst AND a.core_distance IS NOT NULL AND b.core_distance IS NOT NULL")
def _(t):
    return rounded_pairs(neighbors.mutual_reachability_within(t("customer"), "c_custkey", ["c_acctbal"], 15.0, 5), "reach")


@query("knn2_supplier", "SELECT query, CAST(rank AS INTEGER) AS rank, neighbor, round(dist, 4) AS dist FROM (SELECT a.s_suppkey AS query, b.s_suppkey AS neighbor, abs(a.s_acctbal - b.s_acctbal) AS dist, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS rank FROM supplier a CROSS JOIN supplier b) WHERE rank <= 2")
def _(t):
    return rounded(neighbors.nearest(t("supplier").select("s_suppkey", F.array("s_acctbal").alias("v")), "s_suppkey", "v", 2), "dist")


@query("knn2_embeddings", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT query, CAST(rank AS INTEGER) AS rank, neighbor, round(dist, 4) AS dist FROM (SELECT a.vec_id AS query, b.vec_id AS neighbor, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank FROM v a CROSS JOIN v b) WHERE rank <= 2")
def _(t):
    return rounded(neighbors.nearest(t("embeddings"), "vec_id", "embedding", 2), "dist")


@query("knn3_customer", "WITH q AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, 100.0 * c_nationkey AS y FROM customer) SELECT query, CAST(rank AS INTEGER) AS rank, neighbor, round(dist, 4) AS dist FROM (SELECT a.id AS query, b.id AS neighbor, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rank FROM q a CROSS JOIN q b) WHERE rank <= 3")
def _(t):
    rows = t("customer").select("c_custkey", F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey") * F.lit(100.0)).alias("v"))
    return rounded(neighbors.nearest(rows, "c_custkey", "v", 3, block=256), "dist")


# ---- clustering

ROUNDS = 6


def lloyd_sql(source: str, final: str) -> str:
    """k-means with k = 3 from min, mean and max, unrolled."""
    steps = [f"p AS ({source})", "c0 AS (SELECT min(x) AS a, avg(x) AS b, max(x) AS c FROM p)"]
    d = "(x - {0}) * (x - {0})".format
    side = f"CASE WHEN {d('a')} <= {d('b')} AND {d('a')} <= {d('c')} THEN 0 WHEN {d('b')} <= {d('c')} THEN 1 ELSE 2 END"
    for k in range(ROUNDS):
        steps.append(f"c{k + 1} AS (SELECT coalesce(avg(x) FILTER (k = 0), any_value(a)) AS a, coalesce(avg(x) FILTER (k = 1), any_value(b)) AS b, coalesce(avg(x) FILTER (k = 2), any_value(c)) AS c FROM (SELECT x, a, b, c, {side} AS k FROM p CROSS JOIN c{k}))")
    steps.append(f"l AS (SELECT id, x, a, b, c, {side} AS cluster FROM p CROSS JOIN c{ROUNDS})")
    return f"WITH {', '.join(steps)} {final}"


PRICE = "SELECT event_id AS id, value AS x FROM events WHERE event_id % 13 <> 0"


def price_model(t) -> tuple[DataFrame, kmeans.KMeansModel]:
    raw = t("events").select("event_id", F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    rows = prepare.drop_missing(prepare.coerce(raw, ["value"]), ["value"])
    low, mid, high = rows.agg(F.min("value"), F.avg("value"), F.max("value")).first()
    return rows, kmeans.kmeans(rows, ["value"], 3, init=[(low,), (mid,), (high,)], max_iter=ROUNDS, tol=-1.0)


@query("kmeans_price_k3", lloyd_sql(PRICE, "SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n_points, round(any_value(CASE cluster WHEN 0 THEN a WHEN 1 THEN b ELSE c END), 4) AS center FROM l GROUP BY 1"))
def _(t):
    rows, model = price_model(t)
    return rounded(model.summary(rows).withColumnRenamed("c0", "center"), "center")


@query("kmeans_assign", lloyd_sql(PRICE, "SELECT id AS event_id, CAST(cluster AS INTEGER) AS cluster FROM l"))
def _(t):
    rows, model = price_model(t)
    return model.transform(rows).select("event_id", "cluster")


@query("kmeans_inertia", lloyd_sql(PRICE, "SELECT round(sum(least((x - a) * (x - a), (x - b) * (x - b), (x - c) * (x - c))), 2) AS inertia FROM l"))
def _(t):
    rows, model = price_model(t)
    return rows.sparkSession.createDataFrame([(round(model.inertia, 2),)], "inertia double")


@query("kmeans_position_series", lloyd_sql(PRICE, "SELECT row_number() OVER (ORDER BY id) - 1 AS pos, x AS value, CAST(cluster AS INTEGER) AS cluster, round(CASE cluster WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 4) AS centre FROM l"))
def _(t):
    rows, model = price_model(t)
    return rounded(charts.position_series(rows, "event_id", "value", model), "centre")


def lloyd_rounds_sql(rounds: int) -> str:
    """k-means of p (id, x, y) from the centres in start (g, c, x, y), each g on its own, until none moves or rounds are over.

    last has the centres at the end, near (g, id, c, d2) the nearest one of each row."""
    side = "SELECT g, id, arg_min(c, d2) AS c, min(d2) AS d2, any_value(px) AS px, any_value(py) AS py FROM (SELECT g, c, id, p.x AS px, p.y AS py, (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y) AS d2 FROM {0} k CROSS JOIN p) GROUP BY g, id"
    return f"""
lloyd(g, n, c, x, y, moved) AS (
  SELECT g, 0, c, x, y, CAST('inf' AS DOUBLE) FROM start
  UNION ALL
  SELECT g, n + 1, c, x, y, max(greatest(abs(x - ox), abs(y - oy))) OVER (PARTITION BY g) FROM (
    SELECT o.g, o.n, o.c, coalesce(m.x, o.x) AS x, coalesce(m.y, o.y) AS y, o.x AS ox, o.y AS oy
    FROM lloyd o LEFT JOIN (SELECT g, c, avg(px) AS x, avg(py) AS y FROM ({side.format("lloyd")}) GROUP BY g, c) m ON m.g = o.g AND m.c = o.c
    WHERE o.moved > 1e-9 AND o.n < {rounds})),
last AS (SELECT g, c, x, y FROM lloyd QUALIFY n = max(n) OVER (PARTITION BY g)),
near AS ({side.format("last")})"""


def spread_sql(ks) -> str:
    """The starts of k-means at even quantiles of x and the mean of y."""
    return "start AS (" + " UNION ALL ".join(f"SELECT {k} AS g, {i} AS c, quantile_cont(x, {(i + 0.5) / k!r}) AS x, avg(y) AS y FROM p" for k in ks for i in range(k)) + ")"


RESTARTS = f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
start AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY md5(g || ':' || id), id) AS c, x, y FROM p CROSS JOIN (SELECT unnest(range(42, 52)) AS g) QUALIFY c <= 2), {lloyd_rounds_sql(300)},
best AS (SELECT g FROM near GROUP BY g ORDER BY round(sum(d2), 3), g LIMIT 1),
ranked AS (SELECT c, CAST(row_number() OVER (ORDER BY x, y) - 1 AS INTEGER) AS cluster FROM last JOIN best USING (g))
SELECT px AS x, CAST(py AS INTEGER) AS y, cluster FROM near JOIN best USING (g) JOIN ranked USING (c)"""


@query("kmeans_restarts", RESTARTS)
def _(t):
    rows = t("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    model = kmeans.kmeans(rows, ["c_acctbal", "c_nationkey"], 2, n_init=10, id_col="c_custkey")
    return charts.scatter_series(model.transform(rows), "c_acctbal", "c_nationkey")


@query("elbow_sse_k1", "SELECT 1 AS k, round(var_pop(p_retailprice) * count(*), 2) AS sse FROM part")
def _(t):
    return rounded(kmeans.elbow(t("part"), ["p_retailprice"], range(1, 2)), "sse", to=2)


PARTS = "p AS (SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part)"
ELBOW = f"WITH RECURSIVE {PARTS}, {spread_sql(range(1, 6))}, {lloyd_rounds_sql(50)} SELECT CAST(g AS INTEGER) AS k, round(sum(d2), 2) AS sse FROM near GROUP BY g"


@query("elbow_sse", ELBOW)
def _(t):
    return rounded(kmeans.elbow(t("part"), ["p_retailprice", "p_size"], max_iter=50), "sse", to=2)


def seeds_sql(k: int, seed: int, rounds: int = 5) -> str:
    """k-means|| over p (id, x, y), rounds written out; start (g, c, x, y) has the k picks in their order."""
    u = lambda step, at="": f"(('0x' || substr(md5('{seed}:{step}:' || {at}id), 1, 12))::BIGINT / 281474976710656.0)"
    d2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
    steps = [f"c0 AS MATERIALIZED (SELECT id, x, y FROM p ORDER BY {u('first')}, id LIMIT 1)"]
    for r in range(1, rounds + 1):
        steps.append(f"d{r} AS MATERIALIZED (SELECT a.id, a.x, a.y, min({d2}) AS d FROM p a CROSS JOIN c{r - 1} b GROUP BY a.id, a.x, a.y)")
        steps.append(f"c{r} AS MATERIALIZED (SELECT id, x, y FROM c{r - 1} UNION ALL SELECT id, x, y FROM d{r} WHERE {u(f'round {r}')} * (SELECT sum(d) FROM d{r}) < {2 * k}.0 * d)")
    steps.append(f"own AS (SELECT a.id, arg_min(b.id, row({d2}, b.id)) AS c FROM p a CROSS JOIN c{rounds} b GROUP BY a.id)")
    steps.append(f"w AS MATERIALIZED (SELECT b.id, x, y, count(own.c) AS w FROM c{rounds} b LEFT JOIN own ON own.c = b.id GROUP BY 1, 2, 3)")
    steps.append(f"s0 AS MATERIALIZED (SELECT 0 AS c, id, x, y FROM w WHERE w > 0 ORDER BY -ln(1 - {u('pick 0')}) / w LIMIT 1)")
    for j in range(1, k):
        steps.append(f"s{j} AS MATERIALIZED (SELECT * FROM s{j - 1} UNION ALL (SELECT {j}, id, x, y FROM (SELECT a.id, a.x, a.y, any_value(a.w) AS w, min({d2}) AS d FROM w a CROSS JOIN s{j - 1} b GROUP BY a.id, a.x, a.y) WHERE w * d > 0 ORDER BY -ln(1 - {u(f'pick {j}')}) / (w * d) LIMIT 1))")
    steps.append(f"start AS (SELECT 1 AS g, c, x, y FROM s{k - 1})")
    return ", ".join(steps)


@query("kmeans_seeds", f"WITH {PARTS}, {seeds_sql(8, 42)} SELECT CAST(c AS INTEGER) AS pick, x AS price, y AS size FROM start")
def _(t):
    rows = kmeans.complete(t("part"), ["p_retailprice", "p_size"], "p_partkey")
    picked = kmeans.seeded_starts(rows, ["x0", "x1"], 8, [42], "id")[0]
    return rows.sparkSession.createDataFrame([(j, *c) for j, c in enumerate(picked)], "pick int, price double, size double")


PLUS_PLUS = f"""WITH RECURSIVE p AS (SELECT event_id AS id, CAST(value AS DOUBLE) AS x, 0.0 AS y FROM events WHERE event_id % 13 <> 0), {seeds_sql(3, 42)}, {lloyd_rounds_sql(50)},
ranked AS (SELECT c, x, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS cluster FROM last)
SELECT cluster, count(*) AS n_points, round(any_value(x), 4) AS center FROM near JOIN ranked USING (c) GROUP BY 1"""


@query("kmeans_plus_plus", PLUS_PLUS)
def _(t):
    model = kmeans.kmeans(holes(t), ["value"], 3, init="k-means++", id_col="event_id", max_iter=50)
    return rounded(model.summary(holes(t)).withColumnRenamed("c0", "center"), "center")


DBSCAN = """
WITH RECURSIVE p AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
e AS (SELECT a.id AS s, b.id AS d FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.1),
core AS (SELECT s AS id FROM e GROUP BY s HAVING count(*) >= 5),
ce AS (SELECT s, d FROM e WHERE s IN (SELECT id FROM core) AND d IN (SELECT id FROM core)),
r(id, o) AS (SELECT id, id FROM core UNION SELECT r.id, ce.d FROM r JOIN ce ON r.o = ce.s),
c AS (SELECT id, min(o) AS lead FROM r GROUP BY id),
n AS (SELECT id, CAST(dense_rank() OVER (ORDER BY lead) - 1 AS INTEGER) AS cluster FROM c),
b AS (SELECT d AS id, min(cluster) AS low FROM e JOIN n ON e.s = n.id GROUP BY d),
l AS (SELECT p.id, coalesce(n.cluster, b.low, -1) AS cluster, n.cluster IS NOT NULL AS is_core FROM p LEFT JOIN n USING (id) LEFT JOIN b USING (id))
"""


def customer_clusters(t) -> DataFrame:
    return dbscan.dbscan(t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], eps=0.1, min_samples=5)


@query("dbscan_customer", DBSCAN + "SELECT * FROM l")
def _(t):
    return customer_clusters(t)


@query("dbscan_scatter", DBSCAN + "SELECT c_acctbal AS x, c_nationkey AS y, cluster FROM customer JOIN l ON id = c_custkey")
def _(t):
    rows = dbscan.dbscan_attach(t("customer"), customer_clusters(t), "c_custkey")
    return charts.scatter_series(rows, "c_acctbal", "c_nationkey", "cluster_label")


@query("dbscan_summary", DBSCAN + "SELECT cluster AS label, count(*) AS n FROM l GROUP BY 1")
def _(t):
    return profile.label_counts(customer_clusters(t), "cluster")


@query("dbscan_attach", DBSCAN + "SELECT c_custkey, c_acctbal, cluster AS cluster_label FROM customer JOIN l ON id = c_custkey")
def _(t):
    return dbscan.dbscan_attach(t("customer").select("c_custkey", "c_acctbal"), customer_clusters(t), "c_custkey")


def ordered_customers(t) -> DataFrame:
    return optics.optics(t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], eps=15.0, min_pts=5)


OPTICS_CORE = "WITH pts AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), pairs AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM pts a JOIN pts b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 15), " + CORE


@query("optics_core", OPTICS_CORE + " SELECT id, round(core_distance, 4) AS core_distance FROM cores")
def _(t):
    # no ordering is needed for these
    return rounded(neighbors.cores_within(t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], 15.0, 5), "core_distance")


@query("optics_ordering")
def _(t):
    return ordered_customers(t)


@query("reachability_plot_series")
def _(t):
    return optics.reachability_series(ordered_customers(t))


@query("optics_report")
def _(t):
    return optics.optics_report(ordered_customers(t))


def customer_hierarchy(t) -> DataFrame:
    return hdbscan.hdbscan(t("customer"), "c_custkey", ["c_acctbal", "c_nationkey"], min_cluster_size=5)


@query("hdbscan_labels")
def _(t):
    return customer_hierarchy(t)


@query("hdbscan_summary")
def _(t):
    return profile.label_counts(customer_hierarchy(t), "cluster")


def tree_sql(rounds: int = 10) -> str:
    """An edge is in the tree if no path of lesser edges joins its ends; paths of least greatest rank double their length each round."""
    steps = ["v AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier)", "d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x)) AS dist FROM v a JOIN v b ON TRUE)",
             "core AS (SELECT a AS id, dist AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM d) WHERE k = 4)",
             "e AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS r FROM (SELECT d.a, d.b, greatest(dist, x.core, y.core) AS w FROM d JOIN core x ON x.id = d.a JOIN core y ON y.id = d.b WHERE d.a < d.b))",
             "m0 AS (SELECT a, b, r FROM e UNION ALL SELECT b, a, r FROM e UNION ALL SELECT id, id, 0 FROM v)"]
    steps += [f"m{k + 1} AS MATERIALIZED (SELECT x.a, y.b, min(greatest(x.r, y.r)) AS r FROM m{k} x JOIN m{k} y ON x.b = y.a GROUP BY 1, 2)" for k in range(rounds)]
    return f"WITH {', '.join(steps)} SELECT count(*) AS n_edges, round(sum(w), 4) AS total FROM e JOIN m{rounds} USING (a, b) WHERE e.r = m{rounds}.r"


@query("hdbscan_tree_weight", tree_sql())
def _(t):
    rows = t("supplier")
    tree = hdbscan.hierarchy(rows, "s_suppkey", ["s_acctbal"], 4, Scratch(rows.sparkSession))
    return tree.agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("reach"), 4).alias("total"))


# ---- principal components


@query("pca_covariance_embeddings", "WITH e AS (SELECT vec_id, unnest(range(64)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(covar_samp(a.x, b.x), 8) AS cov FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2")
def _(t):
    v = t("embeddings")
    _, cov, _ = pca.covariance(v, "embedding")
    return v.sparkSession.createDataFrame([(i, j, round(float(x), 8)) for i, row in enumerate(cov) for j, x in enumerate(row)], "i int, j int, cov double")


@query("pca_total_variance", "SELECT round(sum(v), 8) AS total FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(range(64)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY k)")
def _(t):
    v = t("embeddings")
    return v.sparkSession.createDataFrame([(round(pca.fit(v, "embedding").total_variance, 8),)], "total double")


def scores_sql(d: int = 64, doublings: int = 24) -> str:
    """s (vec_id, pc1, pc2): the covariance matrix, its power by doubling, whose columns tend to the leading component; the same again without that."""
    steps = ["e AS MATERIALIZED (SELECT vec_id, k, x - avg(x) OVER (PARTITION BY k) AS x FROM (SELECT vec_id, unnest(range(%d)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings))" % d,
             "a0 AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS w FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2)"]
    for s, name in ((0, "a"), (1, "b")):
        for k in range(doublings):
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT i, j, w / sqrt(sum(w * w) OVER ()) AS w FROM (SELECT p.i, q.j, sum(p.w * q.w) AS w FROM {name}{k} p JOIN {name}{k} q ON p.j = q.i GROUP BY 1, 2))")
        # the column with the largest entry on the diagonal, its largest loading positive, of length 1
        steps.append(f"v{s} AS MATERIALIZED (SELECT i, w / sqrt(sum(w * w) OVER ()) * sign(arg_max(w, abs(w)) OVER ()) AS w FROM {name}{doublings} WHERE j = (SELECT arg_max(i, w) FROM {name}{doublings} WHERE i = j))")
        if not s:
            steps.append("b0 AS MATERIALIZED (SELECT a0.i, a0.j, a0.w - l * x.w * y.w AS w FROM a0 JOIN v0 x ON x.i = a0.i JOIN v0 y ON y.i = a0.j CROSS JOIN (SELECT sum(a0.w * x.w * y.w) AS l FROM a0 JOIN v0 x ON x.i = a0.i JOIN v0 y ON y.i = a0.j))")
    return ", ".join(steps) + ", s AS MATERIALIZED (SELECT vec_id, sum(x * v0.w) AS pc1, sum(x * v1.w) AS pc2 FROM e JOIN v0 ON v0.i = k JOIN v1 ON v1.i = k GROUP BY 1)"


SCORES = f"WITH {scores_sql()} SELECT vec_id, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM s"
PCA_KMEANS = f"""WITH RECURSIVE {scores_sql()}, p AS MATERIALIZED (SELECT vec_id AS id, pc1 AS x, pc2 AS y FROM s), {spread_sql([8])}, {lloyd_rounds_sql(50)},
ranked AS (SELECT c, CAST(row_number() OVER (ORDER BY x, y) - 1 AS INTEGER) AS cluster FROM last)
SELECT id AS vec_id, round(px, 6) AS pc1, round(py, 6) AS pc2, cluster FROM near JOIN ranked USING (c)"""


def leading_scores(t) -> DataFrame:
    v = t("embeddings").select("vec_id", "embedding")
    return pca.fit(v, "embedding").transform(v, "embedding").select("vec_id", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"))


@query("pca_scores", SCORES)
def _(t):
    return rounded(leading_scores(t), "pc1", "pc2", to=6)


@query("pca_kmeans_clusters", PCA_KMEANS)
def _(t):
    scores = leading_scores(t)
    return rounded(kmeans.kmeans(scores, ["pc1", "pc2"], 8, max_iter=50).transform(scores), "pc1", "pc2", to=6)


# ---- sentiment

# Valences for words that occur in the invented texts; they say nothing about real sentiment.
TOY_LEXICON = {"the": 0.1, "and": 0.2, "of": -0.1, "was": -0.9, "this": 1.1, "with": -0.4, "from": 0.7, "best": 3.2, "no": -1.2, "idiot": -2.3, "clown": -1.5, "loser": -2.4}
LEXICON_SQL = "lex(token, valence) AS (VALUES " + ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in TOY_LEXICON.items()) + ")"
SENTIMENT = f"WITH {LEXICON_SQL}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS token FROM documents), s AS (SELECT doc_id, sum(valence) AS total FROM w JOIN lex USING (token) GROUP BY 1), r AS (SELECT doc_id, coalesce(total, 0) AS total, coalesce(total, 0) / sqrt(coalesce(total, 0) * coalesce(total, 0) + 15) AS compound FROM documents LEFT JOIN s USING (doc_id) WHERE regexp_matches(text, '\\S')), l AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM r) "


def lexicon(t) -> DataFrame:
    return t("documents").sparkSession.createDataFrame(list(TOY_LEXICON.items()), "token string, valence double")


def sums(t) -> DataFrame:
    return sentiment.lexicon_sums(t("documents"), lexicon(t))


@query("sentiment_scores", SENTIMENT + "SELECT doc_id, round(total, 4) AS total, round(compound, 4) AS compound FROM l")
def _(t):
    return rounded(sums(t).select("doc_id", "total", "compound"), "total", "compound")


@query("sentiment_labels", SENTIMENT + "SELECT doc_id, label FROM l")
def _(t):
    return sums(t).select("doc_id", "label")


@query("sentiment_distribution", SENTIMENT + ", k(label) AS (VALUES ('positive'), ('neutral'), ('negative')), n AS (SELECT k.label, count(l.label) AS n FROM k LEFT JOIN l ON k.label = l.label GROUP BY 1) SELECT label, n, round(CASE WHEN sum(n) OVER () > 0 THEN n / CAST(sum(n) OVER () AS DOUBLE) * 100 ELSE 0 END, 4) AS percent FROM n".replace(", k(label)", ", k(label)"))
def _(t):
    return rounded(sentiment.distribution(sums(t)), "percent")


SQL["sentiment_distribution"] = SENTIMENT.rstrip() + SQL["sentiment_distribution"][len(SENTIMENT) :]


@query("sentiment_sample_md5", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def _(t):
    return sentiment.sample(t("documents"), 200).select("doc_id")


NEGATED = "replace({0}, '''', '') IN (" + ", ".join(f"'{w}'" for w in sorted(sentiment.NEGATIONS)) + ") OR {0} LIKE '%n''t'"
PUSH_SQL = "boost(token, push) AS (VALUES " + ", ".join(f"('{w}', {v})" for w, v in sentiment.BOOSTERS.items()) + ")"


def rules_sql() -> str:
    """r (doc_id, text, neg, neu, pos, compound): words with their places, the three before each, and sums by text."""
    space = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
    marks = "'" + string.punctuation.replace("'", "''") + "'"
    steps = [
        LEXICON_SQL, PUSH_SQL, "d AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\\S'))",
        f"w0 AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '{space}'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(text, '{space}'), lambda x: x <> ''), 1) AS place FROM d)",
        f"w1 AS (SELECT doc_id, place, CASE WHEN length(trim(w, {marks})) > 2 THEN trim(w, {marks}) ELSE w END AS w FROM w0 WHERE length(trim(w, {marks})) > 1 OR lower(w) IN (SELECT token FROM lex))",
        "w2 AS (SELECT doc_id, place, lower(w) AS low, w = upper(w) AND w <> lower(w) AS up FROM w1)",
        "w3 AS (SELECT doc_id, place, low, up AND bool_or(up) OVER doc AND NOT bool_and(up) OVER doc AS loud, min(CASE WHEN low = 'but' THEN place END) OVER doc AS but, CASE WHEN push IS NULL THEN coalesce(valence, 0) ELSE 0 END AS v0, valence IS NULL AS open, coalesce(push, 0) AS push FROM w2 LEFT JOIN lex ON low = lex.token LEFT JOIN boost ON low = boost.token WINDOW doc AS (PARTITION BY doc_id))",
        "w4 AS (SELECT *, " + ", ".join(f"coalesce(lag(open, {k}) OVER doc, FALSE) AS open{k}, lag(push, {k}) OVER doc AS push{k}, lag(loud, {k}) OVER doc AS loud{k}, coalesce(lag(low, {k}) OVER doc, '') AS low{k}" for k in (1, 2, 3)) + f", v0 + CASE WHEN loud THEN sign(v0) * {sentiment.CAPS} ELSE 0 END AS v FROM w3 WINDOW doc AS (PARTITION BY doc_id ORDER BY place))",
    ]
    v = "v"
    for k, fade in enumerate(sentiment.FADE, 1):
        pushed = f"{v} + CASE WHEN open{k} AND push{k} <> 0 THEN {fade} * sign(v0) * ({sentiment.BOOST} * push{k} + CASE WHEN loud{k} THEN {sentiment.CAPS} ELSE 0 END) ELSE 0 END"
        steps.append(f"x{k} AS (SELECT * REPLACE (({pushed}) * CASE WHEN open{k} AND ({NEGATED.format(f'low{k}')}) THEN {sentiment.NEGATE} ELSE 1 END AS v) FROM {'w4' if k == 1 else f'x{k - 1}'})")
    steps += [
        f"y AS (SELECT doc_id, place, CASE WHEN v0 = 0 THEN 0 ELSE v END * CASE WHEN place < but THEN {sentiment.BEFORE_BUT} WHEN place > but THEN {sentiment.AFTER_BUT} ELSE 1 END AS s FROM x3)",
        "z AS (SELECT doc_id, fsum(s ORDER BY place) AS total, coalesce(sum(s + 1) FILTER (s > 0), 0) AS p, coalesce(sum(1 - s) FILTER (s < 0), 0) AS n, count(*) FILTER (s = 0) AS u FROM y GROUP BY 1)",
        f"m AS (SELECT doc_id, text, coalesce(total, 0) AS total, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(u, 0) AS u, least(length(text) - length(replace(text, '!', '')), 4) * {sentiment.EXCLAIM} + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN {sentiment.MANY_QUESTIONS} WHEN length(text) - length(replace(text, '?', '')) > 1 THEN (length(text) - length(replace(text, '?', ''))) * {sentiment.QUESTION} ELSE 0 END AS marks FROM d LEFT JOIN z USING (doc_id))",
        "q AS (SELECT doc_id, text, total + sign(total) * marks AS total, p + CASE WHEN p > n THEN marks ELSE 0 END AS p, n + CASE WHEN p < n THEN marks ELSE 0 END AS n, u FROM m)",
        f"r AS (SELECT doc_id, text, coalesce(n / nullif(p + n + u, 0), 0) AS neg, coalesce(u / nullif(p + n + u, 0), 0) AS neu, coalesce(p / nullif(p + n + u, 0), 0) AS pos, CASE WHEN p + n + u = 0 THEN 0 ELSE total / sqrt(total * total + {sentiment.NORMALISER}) END AS compound FROM q)",
        f"l AS (SELECT *, CASE WHEN compound >= {sentiment.POSITIVE} THEN 'positive' WHEN compound <= {sentiment.NEGATIVE} THEN 'negative' ELSE 'neutral' END AS label FROM r)",
    ]
    return "WITH " + ", ".join(steps)


@query("sentiment_rules", rules_sql() + " SELECT doc_id, round(neg, 6) AS neg, round(neu, 6) AS neu, round(pos, 6) AS pos, round(compound, 6) AS compound, label FROM l")
def _(t):
    return rounded(sentiment.analyse(t("documents"), lexicon(t)).select("doc_id", "scores.*", "label"), "neg", "neu", "pos", "compound", to=6)


@query("sentiment_rules_fold", SQL["sentiment_rules"])
def _(t):
    return rounded(sentiment.analyse(t("documents"), lexicon(t), fold=True).select("doc_id", "scores.*", "label"), "neg", "neu", "pos", "compound", to=6)


@query("sentiment_examples", rules_sql() + " SELECT doc_id, substr(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g'), 1, 80) AS start, round(compound, 6) AS compound, upper(label[1]) || label[2:] AS label FROM l ORDER BY doc_id LIMIT 5")
def _(t):
    return rounded(sentiment.examples(sentiment.analyse(t("documents"), lexicon(t))), "compound", to=6)


# ---- classifier


@query("argmax_confidence", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS prediction, CAST(list_max(embedding) AS DOUBLE) AS confidence FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", scalars.argmax(F.col("embedding")).alias("prediction"), F.array_max("embedding").cast("double").alias("confidence"))


@query("mlp_train_accuracy")
def _(t):
    v = t("embeddings")
    model = mlp.fit(v, "embedding", "label", epochs=5, batches=4, rate=0.01)
    return mlp.evaluate(model.transform(v, "embedding"), "label")


# ---- the stateless operators on time windows


@query("cluster_counts_by_day", lloyd_sql(PRICE, "SELECT date_trunc('day', ts) AS start, CAST(cluster AS INTEGER) AS cluster, count(*) AS n FROM l JOIN events ON id = event_id GROUP BY 1, 2"))
def _(t):
    _, model = price_model(t)
    rows = t("events").where(F.col("event_id") % 13 != 0)
    return scoring.cluster_counts(rows, model)
