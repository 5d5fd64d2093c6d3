"""Queries of reports, joins, sets and run selection, on results derived from orders, lineitem and customers.

Segments stand for datasets, order priorities for methods, years for configurations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import reports, retrieval
from .registry import query, r, table

RESULTS = "WITH res AS (SELECT c_mktsegment AS dataset, 'y' || (year(o_orderdate) % 2) AS term, o_orderpriority AS method, CAST(year(o_orderdate) AS INTEGER) AS config, CAST(month(o_orderdate) AS INTEGER) AS rep, avg(o_totalprice / 100000) AS mase, avg(o_totalprice / 50000) AS seconds, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS fallback, count(*) AS eligible FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), eff AS (SELECT dataset, term, method, avg(mase) AS mase, avg(seconds) AS seconds, CAST(sum(fallback) AS BIGINT) AS fallback, CAST(sum(eligible) AS BIGINT) AS eligible FROM (SELECT dataset, term, method, config, avg(mase) AS mase, avg(seconds) AS seconds, sum(fallback) AS fallback, sum(eligible) AS eligible FROM res GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), scaled AS (SELECT e.*, e.mase / b.mase AS scaled FROM eff e JOIN eff b ON b.dataset = e.dataset AND b.term = e.term AND b.method = '5-LOW') "
TASK = ["dataset", "term"]


def results(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    keys = [F.col("c_mktsegment").alias("dataset"), F.concat(F.lit("y"), (F.year("o_orderdate") % 2).cast("string")).alias("term"), F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("config"), F.month("o_orderdate").alias("rep")]
    return j.groupBy(*keys).agg(F.avg(F.col("o_totalprice") / 100000).alias("mase"), F.avg(F.col("o_totalprice") / 50000).alias("seconds"), F.count_if(F.col("o_orderstatus") == "F").alias("fallback"), F.count("*").alias("eligible"))


def effective(spark, sf_dir) -> DataFrame:
    return reports.effective(results(spark, sf_dir), TASK, "method", "config", ["mase", "seconds"], ["fallback", "eligible"])


def scaled(spark, sf_dir) -> DataFrame:
    return reports.scaled_within(effective(spark, sf_dir), F.col("method") == "5-LOW", TASK)


@query("SELECT c_custkey AS id, c_mktsegment AS segment, n_name AS nation, orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j1_left_joins(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), "orders")


@query("SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j2_validated_joins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    n = reports.require_unique(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), ["n_nationkey"])
    g = reports.require_unique(table(spark, sf_dir, "region"), ["r_regionkey"])
    return c.join(n, "n_nationkey").join(g, "r_regionkey").groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("customers"))


@query(RESULTS + "SELECT dataset, term, method, " + r("scaled") + " AS scaled FROM scaled")
def j3_scaled_by_baseline(spark, sf_dir):
    return scaled(spark, sf_dir).select(*TASK, "method", "scaled")


@query(RESULTS + "SELECT t.dataset, t.term, m.method FROM (SELECT DISTINCT dataset, term FROM res) t, (SELECT DISTINCT method FROM res) m WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.dataset = t.dataset AND r.term = t.term AND r.method = m.method AND r.mase > 1.9 AND r.rep = 3 AND r.config % 3 = 0)")
def j4_missing_tasks(spark, sf_dir):
    res = results(spark, sf_dir)
    return reports.missing_tasks(res.select(*TASK).distinct(), res.select("method").distinct(), res.where("mase > 1.9 and rep = 3 and config % 3 = 0"))


@query(RESULTS + "SELECT dataset, term, count(DISTINCT rep % 5) AS supports FROM res GROUP BY 1, 2 HAVING count(DISTINCT rep % 5) > 1")
def j5_unequal_support(spark, sf_dir):
    return reports.unequal_support(results(spark, sf_dir).withColumn("support", F.col("rep") % 5), TASK, "support")


@query(RESULTS + "SELECT dataset, term, method, " + r("mase") + " AS mase, " + r("seconds") + " AS seconds, fallback, eligible FROM eff")
def g17_effective_cells(spark, sf_dir):
    return effective(spark, sf_dir)


@query(RESULTS + "SELECT method, " + ", ".join(r(x) + f" AS {n}" for n, x in {"scaled_mase": "exp(avg(ln(scaled)))", "mase": "avg(mase)", "seconds": "sum(seconds)"}.items()) + ", count(DISTINCT dataset) AS datasets, count(*) AS tasks, count(seconds) AS timed_tasks, count(CASE WHEN fallback > 0 THEN 1 END) AS tasks_with_fallback, " + r("avg(fallback / CAST(eligible AS DOUBLE))") + " AS average_fallback_rate, " + r("sum(fallback) / CAST(sum(eligible) AS DOUBLE)") + " AS pooled_fallback_rate FROM scaled GROUP BY 1")
def g18_method_summary(spark, sf_dir):
    return reports.method_summary(scaled(spark, sf_dir))


@query(RESULTS + "SELECT m.method, coalesce(" + r("sum(s.rate)") + ", 0) AS rate_sum, count(CASE WHEN s.rate > 0 THEN 1 END) AS tasks FROM (SELECT DISTINCT method FROM res UNION ALL SELECT 'never') m LEFT JOIN (SELECT method, mase / 10 AS rate FROM eff) s USING (method) GROUP BY 1")
def g19_selection_rates(spark, sf_dir):
    e = effective(spark, sf_dir).select("method", (F.col("mase") / 10).alias("rate"))
    names = e.select("method").distinct().unionByName(spark.range(1).select(F.lit("never").alias("method")))
    return reports.selection_rates(e, names)


_POINTS = RESULTS + ", pts AS (SELECT 'fallback' AS feature, method AS model, round(fallback / CAST(eligible AS DOUBLE), 4) AS x, scaled AS y FROM scaled UNION ALL SELECT 'size', method, CAST(eligible AS DOUBLE), scaled FROM scaled), rk AS (SELECT *, rank() OVER (PARTITION BY feature, model ORDER BY x) + (count(*) OVER (PARTITION BY feature, model, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, model ORDER BY y) + (count(*) OVER (PARTITION BY feature, model, y) - 1) / 2.0 AS ry FROM pts), rho AS (SELECT feature, model, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS rho, count(*) AS n FROM rk GROUP BY 1, 2)"


def points(spark, sf_dir) -> DataFrame:
    s = scaled(spark, sf_dir)
    both = F.array(F.struct(F.lit("fallback").alias("feature"), F.round(F.col("fallback") / F.col("eligible"), 4).alias("x")), F.struct(F.lit("size").alias("feature"), F.col("eligible").cast("double").alias("x")))
    return s.select(F.col("method").alias("model"), F.col("scaled").alias("y"), F.explode(both).alias("p")).select("p.feature", "model", "p.x", "y")


@query(_POINTS + " SELECT feature, model, " + r("rho") + " AS rho, n FROM rho")
def g32_spearman(spark, sf_dir):
    return reports.spearman(points(spark, sf_dir))


@query(_POINTS + " SELECT feature, " + r("avg(abs(rho))") + " AS mean_absolute FROM rho GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1")
def s5_top_features(spark, sf_dir):
    return reports.top_features(reports.mean_absolute(reports.spearman(points(spark, sf_dir))), 1)


@query(_POINTS + " SELECT feature, model, " + r("regr_slope(y, x)") + " AS slope, " + r("regr_intercept(y, x)") + " AS intercept, count(*) AS n FROM pts WHERE feature = 'size' GROUP BY 1, 2")
def a14_trend_lines(spark, sf_dir):
    return reports.trend_lines(points(spark, sf_dir).where("feature = 'size'"))


@query(RESULTS + "SELECT dataset, method, " + r("exp(avg(ln(scaled)))") + " AS scaled_mase FROM scaled GROUP BY 1, 2")
def g33_dataset_geometric_mean(spark, sf_dir):
    return scaled(spark, sf_dir).groupBy("dataset", "method").agg(reports.geometric_mean(F.col("scaled")).alias("scaled_mase"))


@query(RESULTS + "SELECT method, " + ", ".join(r(x) + f" AS {n}" for n, x in {"mean_s": "avg(seconds)", "median_s": "quantile_cont(seconds, 0.5)", "p95_s": "quantile_cont(seconds, 0.95)", "min_s": "min(seconds)", "max_s": "max(seconds)"}.items()) + ", count(*) AS runs FROM res GROUP BY 1")
def g34_timing_summary(spark, sf_dir):
    return reports.timing_summary(results(spark, sf_dir), ["method"])


_RUNS = "WITH runs AS (SELECT c_mktsegment AS identity, CAST(o_custkey % 3 AS INTEGER) AS config, o_orderkey AS run, o_orderdate AS stamp, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'running' END AS status, o_orderkey % 50 = 0 AS selected FROM orders JOIN customer ON o_custkey = c_custkey)"


def runs(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("identity"), (F.col("o_custkey") % 3).cast("int").alias("config"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("stamp"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), (F.col("o_orderkey") % 50 == 0).alias("selected"))


@query(_RUNS + " SELECT identity, config, run FROM (SELECT *, row_number() OVER (PARTITION BY identity, config ORDER BY selected DESC, stamp DESC, run DESC) AS r FROM runs WHERE status = 'completed') WHERE r = 1")
def r8_selected_runs(spark, sf_dir):
    return reports.select_runs(runs(spark, sf_dir), "distinct", "selected").select("identity", "config", "run")


@query(_RUNS + " SELECT identity, config, run FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY stamp DESC, run DESC) AS r FROM runs WHERE status = 'completed') WHERE r = 1")
def s7_latest_runs(spark, sf_dir):
    return reports.select_runs(runs(spark, sf_dir), "latest", "latest").select("identity", "config", "run")


@query(_RUNS.replace("AS selected", "AS selected, o_totalprice AS price") + " SELECT identity, " + r("avg(price)") + " AS price FROM (SELECT identity, config, avg(price) AS price FROM runs WHERE status = 'completed' GROUP BY 1, 2) GROUP BY 1")
def r8_averaged_runs(spark, sf_dir):
    priced = runs(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("price")), "run")
    return reports.select_runs(priced, "average", "average", values=["price"])


@query(_RUNS + " SELECT identity, config, count(*) AS matches FROM runs GROUP BY 1, 2 HAVING count(*) <> 1")
def j13_inexact_matches(spark, sf_dir):
    return reports.inexact_matches(runs(spark, sf_dir), ["identity", "config"])


@query("SELECT o_orderkey AS prepared, o_custkey AS extraction, max(l_linenumber) AS model FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1, 2")
def j14_manifest_chain(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp")), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_orderkey").alias("prepared"), F.col("o_custkey").alias("extraction")).agg(F.max_by("l_linenumber", "l_linenumber").alias("model"))


@query("SELECT l_returnflag AS reason, l_linestatus AS split, count(*) AS rows_ FROM lineitem GROUP BY 1, 2")
def g35_reason_counts(spark, sf_dir):
    return reports.reason_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("reason"), F.col("l_linestatus").alias("split")), ["reason", "split"]).withColumnRenamed("rows", "rows_")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('7/' || event_id), event_id) AS turn FROM events) ORDER BY turn, md5('8/' || event_type), event_type LIMIT 100")
def s6_balanced_sample(spark, sf_dir):
    return reports.balanced_sample(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 100, 7)


@query("SELECT c_custkey AS id FROM customer UNION ALL SELECT o_custkey FROM orders")
def u_1_union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 40")
def u_2_union_distinct(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return a.unionByName(table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"))).distinct()


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u_3_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct().join(o, "id", "left_anti")


@query("SELECT DISTINCT l_suppkey AS item, l_returnflag AS channel FROM lineitem")
def u_4_distinct_references(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("channel")).distinct()


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS unknown, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS unused")
def u_5_set_equality(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct(), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct()
    return o.join(c, "id", "left_anti").agg(F.count("*").alias("unknown")).crossJoin(c.join(o, "id", "left_anti").agg(F.count("*").alias("unused")))


@query("SELECT l_orderkey, l_partkey, count(*) AS rows_ FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u_6_duplicate_keys(spark, sf_dir):
    return reports.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]).withColumnRenamed("rows", "rows_")


@query("SELECT p_partkey AS id, regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g') AS name, split_part(p_brand, '#', 1) AS family FROM part")
def k_safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), columns.safe_name(F.col("p_name")).alias("name"), F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("family"))


@query("SELECT event_id AS id, CAST(floor(epoch(date_trunc('second', ts)) / 3600) AS BIGINT) + 5 AS hour_tick, CAST(floor(epoch(date_trunc('second', ts)) / 900) AS BIGINT) + 5 AS quarter_hour_tick, CAST((year(ts) - 1970) * 12 + month(ts) - 1 AS BIGINT) + 5 AS month_tick FROM events")
def k_calendar_ticks(spark, sf_dir):
    t = lambda f: columns.tick(F.col("ts"), f, F.lit(5).cast("long"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), t("H").alias("hour_tick"), t("15T").alias("quarter_hour_tick"), t("M").alias("month_tick"))


@query("SELECT o_orderpriority AS name, sha256(o_orderpriority || '|' || count(*)) AS digest FROM orders GROUP BY o_orderpriority")
def k_config_digest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"))
    return o.select("name", F.sha2(F.concat_ws("|", "name", F.col("n").cast("string")), 256).alias("digest"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS events, count(*) - count(value) AS missing, max(value) AS largest FROM events GROUP BY 1, 2")
def l_tumbling_audit(spark, sf_dir):
    from ..streaming.events import tumbling_audit

    return tumbling_audit(table(spark, sf_dir, "events"))


@query("SELECT p_partkey AS id, p_size AS size, p_retailprice AS price FROM part WHERE p_size % 7 <> 0")
def b11_required_features(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    return p.na.drop(subset=["size"])


@query("SELECT l_orderkey AS query_id, list_reduce(list_transform(list(struct_pack(n := l_linenumber, v := p_retailprice) ORDER BY l_linenumber), lambda x: x.v), lambda a, b: a + b) AS total, count(*) AS neighbours FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def j10_point_lookup(spark, sf_dir):
    """The parts of every order's lines, looked up by id, an id without a part being an error."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("ref_id"))
    found = retrieval.gather(asked, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_id"), "p_retailprice"), "p_retailprice", 2**31 - 1)
    return found.select("query_id", F.aggregate("neighbours", F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("neighbours").cast("long").alias("neighbours"))


@query("SELECT l_suppkey AS item, l_returnflag AS channel, count(*) AS windows, min(l_orderkey) AS first_ref, max(l_orderkey) AS last_ref FROM lineitem GROUP BY 1, 2")
def j16_group_assembly(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("channel")).agg(F.count("*").alias("windows"), F.min("l_orderkey").alias("first_ref"), F.max("l_orderkey").alias("last_ref"))
