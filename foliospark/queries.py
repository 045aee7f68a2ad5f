"""Registered queries for the document and grid operators, with the same results in SQL.

Formula queries compile formula text; each whole table is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import conditional as cf
from .operators import document, grid, layout, lookup, statistics
from .plans.compile import aggregate_formulas, with_formulas
from .registry import QUERIES, SQL, register, rounded, table

__all__ = ["QUERIES", "SQL"]

#: The injected clock of the period rules: 1995-06-15.
NOW = 34865.0
STOPS3 = (cf.Stop("min"), cf.Stop("percentile", 50), cf.Stop("max"))
COLOURS3 = ("F8696B", "FFEB84", "63BE7B")


# --- conditional aggregates -----------------------------------------------------------------


@register("""SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 30) AS DOUBLE) AS over_30, CAST(count(*) FILTER (WHERE l_quantity <> 17) AS DOUBLE) AS not_17,
  CAST(count(*) FILTER (WHERE l_linestatus ILIKE 'o%') AS DOUBLE) AS open_lines, CAST(count(*) FILTER (WHERE lower(l_linestatus) <> 'o') AS DOUBLE) AS other_lines FROM lineitem GROUP BY l_returnflag""")
def f_countif(spark, sf_dir):
    formulas = {"over_30": 'COUNTIF(l_quantity,">30")', "not_17": 'COUNTIF(l_quantity,"<>17")', "open_lines": 'COUNTIF(l_linestatus,"o*")', "other_lines": 'COUNTIF(l_linestatus,"<>O")'}
    return aggregate_formulas(table(spark, sf_dir, "lineitem"), formulas, ["l_returnflag"])


@register("""SELECT CAST(count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 30) AS DOUBLE) AS n, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 30), 0), 2) AS total,
  round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 30), 4) AS mean, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'Q'), 0) AS nothing FROM lineitem""")
def f_sumifs(spark, sf_dir):
    formulas = {"n": 'COUNTIFS(l_returnflag,"R",l_quantity,">=30")', "total": 'ROUND(SUMIFS(l_extendedprice,l_returnflag,"R",l_quantity,">=30"),2)', "mean": 'ROUND(AVERAGEIFS(l_extendedprice,l_returnflag,"R",l_quantity,">=30"),4)', "nothing": 'SUMIFS(l_extendedprice,l_returnflag,"Q")'}
    return aggregate_formulas(table(spark, sf_dir, "lineitem"), formulas)


@register("""SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS filled, round(avg(o_totalprice) FILTER (WHERE o_totalprice > 100000), 4) AS large_mean FROM orders GROUP BY o_orderpriority""")
def f_sumif_averageif(spark, sf_dir):
    formulas = {"filled": 'ROUND(SUMIF(o_orderstatus,"F",o_totalprice),2)', "large_mean": 'ROUND(AVERAGEIF(o_totalprice,">100000"),4)'}
    return aggregate_formulas(table(spark, sf_dir, "orders"), formulas, ["o_orderpriority"])


@register("""SELECT p_size, round(sum(p_retailprice), 2) AS s, round(avg(p_retailprice), 4) AS a, min(p_retailprice) AS lo, max(p_retailprice) AS hi, CAST(count(p_retailprice) AS DOUBLE) AS n,
  CAST(count(p_name) AS DOUBLE) AS na, round(median(p_retailprice), 4) AS m, round(sum(p_retailprice * p_retailprice), 2) AS sq, round(sum(p_retailprice * p_size), 2) AS sp FROM part GROUP BY p_size""")
def f_aggregates(spark, sf_dir):
    formulas = {"s": "SUM(p_retailprice)", "a": "AVERAGE(p_retailprice)", "lo": "MIN(p_retailprice)", "hi": "MAX(p_retailprice)", "n": "COUNT(p_retailprice)", "na": "COUNTA(p_name)", "m": "MEDIAN(p_retailprice)", "sq": "SUMSQ(p_retailprice)", "sp": "SUMPRODUCT(p_retailprice,p_size)"}
    df = aggregate_formulas(table(spark, sf_dir, "part"), formulas, ["p_size"])
    return df.select("p_size", F.round("s", 2).alias("s"), F.round("a", 4).alias("a"), "lo", "hi", "n", "na", F.round("m", 4).alias("m"), F.round("sq", 2).alias("sq"), F.round("sp", 2).alias("sp"))


@register("""SELECT c_nationkey, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp, round(var_samp(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp,
  round(var_pop(c_acctbal) * count(*), 0) AS dev, round(avg(abs(c_acctbal - mu)), 4) AS ad FROM (SELECT *, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS mu FROM customer) GROUP BY c_nationkey""")
def f_spread(spark, sf_dir):
    formulas = {"sd": "STDEV(c_acctbal)", "sdp": "STDEV.P(c_acctbal)", "v": "VAR.S(c_acctbal)", "vp": "VARP(c_acctbal)", "dev": "DEVSQ(c_acctbal)"}
    customer = table(spark, sf_dir, "customer")
    df = aggregate_formulas(customer, formulas, ["c_nationkey"])
    far = statistics.group_stats(customer, ["c_nationkey"], _mu=F.avg("c_acctbal")).groupBy("c_nationkey").agg(F.round(F.avg(F.abs(F.col("c_acctbal") - F.col("_mu"))), 4).alias("ad"))
    return df.select("c_nationkey", F.round("sd", 4).alias("sd"), F.round("sdp", 4).alias("sdp"), F.round("v", 2).alias("v"), F.round("vp", 2).alias("vp"), F.round("dev", 0).alias("dev")).join(far, "c_nationkey")


@register("""SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g, round(count(*) / sum(1 / p_retailprice), 4) AS h FROM part GROUP BY p_brand""")
def f_geo_har_mean(spark, sf_dir):
    return rounded(aggregate_formulas(table(spark, sf_dir, "part"), {"g": "GEOMEAN(p_retailprice)", "h": "HARMEAN(p_retailprice)"}, ["p_brand"]))


@register("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2 FROM orders GROUP BY o_orderpriority""")
def f_percentile(spark, sf_dir):
    return rounded(aggregate_formulas(table(spark, sf_dir, "orders"), {"p90": "PERCENTILE(o_totalprice,0.9)", "q1": "QUARTILE.INC(o_totalprice,1)", "q2": "QUARTILE(o_totalprice,2)"}, ["o_orderpriority"]))


@register("""SELECT o_orderstatus, max(CASE WHEN d = 3 THEN o_totalprice END) AS third_largest, max(CASE WHEN a = 2 THEN o_totalprice END) AS second_smallest FROM
  (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS d, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS a FROM orders) GROUP BY o_orderstatus""")
def f_large_small(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    big, small = (statistics.kth(orders, "o_totalprice", k, ["o_orderstatus"], largest, name) for k, largest, name in ((3, True, "third_largest"), (2, False, "second_smallest")))
    return big.join(small, "o_orderstatus")


@register("""SELECT s_suppkey, s_nationkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS INTEGER) AS rank_down, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS INTEGER) AS rank_up FROM supplier""")
def f_rank(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    out = s
    for name, ascending in (("rank_down", False), ("rank_up", True)):
        places = statistics.ranks(s, "s_acctbal", ["s_nationkey"], ascending, name).withColumnRenamed("s_acctbal", "_key")
        out = statistics.joined(out, places, ["s_nationkey"], key=F.col("s_acctbal"))
    return out.select("s_suppkey", "s_nationkey", F.col("rank_down").cast("int").alias("rank_down"), F.col("rank_up").cast("int").alias("rank_up"))


@register("""SELECT l_returnflag, CASE WHEN n > 1 THEN l_quantity END AS mode FROM (SELECT l_returnflag, l_quantity, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, f) AS k FROM
  (SELECT l_returnflag, l_quantity, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY ALL)) WHERE k = 1""")
def f_mode(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("_order", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return statistics.mode_first(lines, "l_quantity", "_order", ["l_returnflag"])


@register("""SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS s FROM lineitem GROUP BY l_suppkey""")
def f_sumproduct(spark, sf_dir):
    return rounded(aggregate_formulas(table(spark, sf_dir, "lineitem"), {"s": "SUMPRODUCT(l_extendedprice,1-l_discount,1+l_tax)"}, ["l_suppkey"]), 2)


# --- scalar library -------------------------------------------------------------------------


@register("""SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, substring(p_name, 2, 5) AS m, upper(p_name) AS u, lower(p_brand) AS lo, CAST(length(p_type) AS DOUBLE) AS n, replace(p_type, 'A', 'x') AS s,
  repeat(left(p_brand, 1), 3) AS rp, CAST(CASE WHEN strpos(lower(p_type), 'e') > 0 THEN strpos(lower(p_type), 'e') END AS DOUBLE) AS se, concat(left(p_name, 2), '*', substring(p_name, 6)) AS rep, p_name = p_type AS ex, concat(p_brand, '|', p_size) AS c FROM part""")
def f_text(spark, sf_dir):
    formulas = {"l": "LEFT(p_name,4)", "r": "RIGHT(p_name,3)", "m": "MID(p_name,2,5)", "u": "UPPER(p_name)", "lo": "LOWER(p_brand)", "n": "LEN(p_type)", "s": 'SUBSTITUTE(p_type,"A","x")', "rp": "REPT(LEFT(p_brand),3)", "se": 'SEARCH("E",p_type)', "rep": 'REPLACE(p_name,3,3,"*")', "ex": "EXACT(p_name,p_type)", "c": 'p_brand&"|"&p_size'}
    return with_formulas(table(spark, sf_dir, "part"), formulas).select("p_partkey", *formulas)


@register("""SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names, string_agg(n_name, '' ORDER BY n_nationkey) AS joined FROM nation GROUP BY n_regionkey""")
def f_textjoin(spark, sf_dir):
    return aggregate_formulas(table(spark, sf_dir, "nation"), {"names": 'TEXTJOIN(", ",TRUE,n_name)', "joined": "CONCAT(n_name)"}, ["n_regionkey"], order="n_nationkey")


@register("""SELECT p_partkey, round(sign(x) * floor(abs(x) * 10 + 0.5) / 10, 6) AS r, ceil(x) AS up, round(floor(x * 100) / 100, 6) AS dn, round(x - 7 * floor(x / 7), 6) AS m, CAST(trunc(x / 7) AS DOUBLE) AS q, round(ln(x), 6) AS l, round(sqrt(x), 6) AS sr,
  round(atan2(2.0, x), 6) AS at, floor(x / 25) * 25 AS fl, 2 * ceil(ceil(x) / 2) AS ev, round(sin(x), 6) AS si, CAST(p_size % 2 = 1 AS BOOLEAN) AS od, CAST(factorial(CAST(p_size % 10 AS INTEGER)) AS DOUBLE) AS f FROM (SELECT *, p_retailprice AS x FROM part)""")
def f_math(spark, sf_dir):
    formulas = {"r": "ROUND(p_retailprice,1)", "up": "ROUNDUP(p_retailprice)", "dn": "TRUNC(p_retailprice,2)", "m": "MOD(p_retailprice,7)", "q": "QUOTIENT(p_retailprice,7)", "l": "ROUND(LN(p_retailprice),6)", "sr": "ROUND(SQRT(p_retailprice),6)", "at": "ROUND(ATAN2(p_retailprice,2),6)", "fl": "FLOOR(p_retailprice,25)", "ev": "EVEN(p_retailprice)", "si": "ROUND(SIN(p_retailprice),6)", "od": "ISODD(p_size)", "f": "FACT(MOD(p_size,10))"}
    return with_formulas(table(spark, sf_dir, "part"), formulas).select("p_partkey", *[F.round(c, 6).alias(c) if c in ("m", "dn", "r") else c for c in formulas])


_DAY = "CAST(o_orderdate AS DATE)"


@register(f"""SELECT o_orderkey, CAST(year(d) AS DOUBLE) AS y, CAST(month(d) AS DOUBLE) AS mo, CAST(day(d) AS DOUBLE) AS dd, CAST(dayofweek(d) + 1 AS DOUBLE) AS wd, CAST(weekofyear(d) AS DOUBLE) AS iso,
  CAST(date_diff('day', DATE '1899-12-30', last_day(d + INTERVAL 1 MONTH)) AS DOUBLE) AS eo, CAST(date_diff('day', DATE '1899-12-30', CAST(d + INTERVAL 2 MONTH AS DATE)) AS DOUBLE) AS ed, CAST(date_diff('day', DATE '1995-01-01', d) AS DOUBLE) AS days,
  CAST(floor((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) / 7) + 1 AS DOUBLE) AS wn FROM (SELECT o_orderkey, {_DAY} AS d FROM orders)""")
def f_dates(spark, sf_dir):
    formulas = {"y": "YEAR(o_orderdate)", "mo": "MONTH(o_orderdate)", "dd": "DAY(o_orderdate)", "wd": "WEEKDAY(o_orderdate)", "iso": "ISOWEEKNUM(o_orderdate)", "eo": "EOMONTH(o_orderdate,1)", "ed": "EDATE(o_orderdate,2)", "days": "DAYS(o_orderdate,DATE(1995,1,1))", "wn": "WEEKNUM(o_orderdate)"}
    return with_formulas(table(spark, sf_dir, "orders"), formulas).select("o_orderkey", *formulas)


@register("""SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, CASE lower(event_type) WHEN 'click' THEN 1.0 WHEN 'view' THEN 2.0 ELSE 0.0 END AS code, CASE WHEN value = 0 THEN -1.0 ELSE round(1 / value, 6) END AS inv,
  value IS NOT NULL AS isnum, TRUE AS istext FROM events""")
def f_logic(spark, sf_dir):
    formulas = {"band": 'IFS(value>100,"high",value>10,"mid",TRUE,"low")', "code": 'SWITCH(event_type,"CLICK",1,"view",2,0)', "inv": "IFERROR(ROUND(1/value,6),-1)", "isnum": "ISNUMBER(value)", "istext": "ISTEXT(event_type)"}
    return with_formulas(table(spark, sf_dir, "events"), formulas).select("event_id", *formulas)


# --- lookups --------------------------------------------------------------------------------


@register("""SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def j_vlookup_exact(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer")
    return lookup.vlookup_exact(orders, "o_custkey", customer, "c_custkey", ["c_name", "c_mktsegment"], "c_custkey").drop("o_custkey")


@register("""SELECT l_orderkey, l_linenumber, b.p_retailprice AS band_price FROM lineitem ASOF LEFT JOIN (SELECT DISTINCT p_retailprice FROM part) b ON lineitem.l_extendedprice / 10 >= b.p_retailprice""")
def j_vlookup_approximate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10).alias("price"))
    bands = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("key"), F.col("p_retailprice").alias("band_price")).distinct()
    return lookup.vlookup_approximate(lines, "price", bands, "key", ["band_price"]).drop("price")


@register("""SELECT (SELECT min(p_partkey) FROM part WHERE p_type ILIKE '%e%') AS position, (SELECT p_name FROM part WHERE p_partkey = 17) AS p_name""")
def j_match_index(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return lookup.match_wildcard(part, "p_type", "*E*", "p_partkey").join(F.broadcast(lookup.index_at(part, "p_partkey", 17, ["p_name"])), how="left")


# --- rules ----------------------------------------------------------------------------------


@register("""SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS inside, l_quantity NOT BETWEEN 10 AND 20 AS outside, l_quantity >= 25 AS big, lower(l_returnflag) = 'r' AS returned FROM lineitem""")
def cf_cell_is(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cf.cell_is(q, "between", 20, 10).alias("inside"), cf.cell_is(q, "notBetween", 10, 20).alias("outside"), cf.cell_is(q, "greaterThanOrEqual", 25).alias("big"), cf.cell_is(F.col("l_returnflag"), "equal", "r").alias("returned"))


def _shade(a: str, b: str, k: int) -> str:
    x, y = (int(c[2 * k : 2 * k + 2], 16) for c in (a, b))
    return f"{x} + ({y - x}) * coalesce((v - {{lo}}) / nullif({{hi}} - {{lo}}, 0), 0)"


def _gradient_sql(k: int) -> str:
    first, mid, last = COLOURS3
    low, high = _shade(first, mid, k).format(lo="t0", hi="t1"), _shade(mid, last, k).format(lo="t1", hi="t2")
    c = f"CASE WHEN v <= t0 THEN {int(first[2 * k : 2 * k + 2], 16)} WHEN v >= t2 THEN {int(last[2 * k : 2 * k + 2], 16)} WHEN v <= t1 THEN {low} ELSE {high} END"
    return f"lpad(to_hex(CAST(floor(({c}) + 0.5) AS BIGINT)), 2, '0')"


@register(f"""SELECT c_custkey, upper({_gradient_sql(0)} || {_gradient_sql(1)} || {_gradient_sql(2)}) AS color FROM (SELECT c_custkey, c_acctbal AS v, min(c_acctbal) OVER w AS t0, quantile_cont(c_acctbal, 0.5) OVER w AS t1, max(c_acctbal) OVER w AS t2 FROM customer WINDOW w AS (PARTITION BY c_nationkey))""")
def cf_color_scale(spark, sf_dir):
    return cf.color_scale(table(spark, sf_dir, "customer"), "c_acctbal", STOPS3, COLOURS3, ["c_nationkey"]).select("c_custkey", "color")


@register("""SELECT s_suppkey, round(CASE WHEN lo < 0 AND hi > 0 THEN CASE WHEN v >= 0 THEN v / hi * (1 - ax) ELSE abs(v) / abs(lo) * ax END ELSE CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 1 END END, 6) AS bar_fraction,
  round(CASE WHEN lo < 0 AND hi > 0 THEN CASE WHEN v >= 0 THEN ax ELSE ax - abs(v) / abs(lo) * ax END END, 6) AS bar_start, CASE WHEN lo < 0 AND hi > 0 AND v < 0 THEN 'FF0000' ELSE '638EC6' END AS bar_color
  FROM (SELECT *, -lo / (hi - lo) AS ax FROM (SELECT s_suppkey, s_acctbal AS v, min(s_acctbal) OVER () AS lo, max(s_acctbal) OVER () AS hi FROM supplier))""")
def cf_data_bar(spark, sf_dir):
    return rounded(cf.data_bar(table(spark, sf_dir, "supplier"), "s_acctbal", cf.Stop("min"), cf.Stop("max"), "638EC6").select("s_suppkey", "bar_fraction", "bar_start", "bar_color"), 6)


@register("""SELECT p_partkey, CAST(i AS INTEGER) AS icon, CASE i WHEN 0 THEN 'FF0000' WHEN 1 THEN 'FFC000' ELSE '00B050' END AS icon_color FROM (SELECT p_partkey, CAST(p_retailprice >= lo + (hi - lo) * 33 / 100 AS INTEGER) + CAST(p_retailprice >= lo + (hi - lo) * 67 / 100 AS INTEGER) AS i
  FROM (SELECT p_partkey, p_retailprice, min(p_retailprice) OVER w AS lo, max(p_retailprice) OVER w AS hi FROM part WINDOW w AS (PARTITION BY p_brand)))""")
def cf_icon_set(spark, sf_dir):
    stops = (cf.Stop("percent", 0), cf.Stop("percent", 33), cf.Stop("percent", 67))
    return cf.icon_set(table(spark, sf_dir, "part"), "p_retailprice", stops, ["p_brand"]).select("p_partkey", "icon", "icon_color")


@register("""SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 10 AS in_top, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) <= greatest(1, floor(count(*) OVER (PARTITION BY o_orderpriority) * 5 / 100)) AS in_bottom FROM orders""")
def cf_top_n(spark, sf_dir):
    top = cf.top_n(table(spark, sf_dir, "orders"), "o_totalprice", 10, ["o_orderpriority"])
    return cf.top_n(top, "o_totalprice", 5, ["o_orderpriority"], percent=True, bottom=True, name="in_bottom").select("o_orderkey", "in_top", "in_bottom")


@register("""SELECT c_custkey, c_acctbal > m AS over, c_acctbal < m - s AS far_under FROM (SELECT c_custkey, c_acctbal, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m, stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment) AS s FROM customer)""")
def cf_above_average(spark, sf_dir):
    over = cf.above_average(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"], name="over")
    return cf.above_average(over, "c_acctbal", ["c_mktsegment"], above=False, deviations=1, name="far_under").select("c_custkey", "over", "far_under")


@register("""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) > 1 AS repeated, count(*) OVER (PARTITION BY o_custkey) = 1 AS single FROM orders""")
def cf_duplicates(spark, sf_dir):
    key = cf.typed_key(F.col("o_custkey"), True)
    once = cf.duplicates(table(spark, sf_dir, "orders"), key, name="repeated")
    return cf.duplicates(once, key, unique=True, name="single").select("o_orderkey", "repeated", "single")


@register("""SELECT p_partkey, contains(lower(p_type), 'st') AS has, NOT contains(lower(p_type), 'st') AS hasnt, starts_with(lower(p_brand), 'brand#1') AS begins, ends_with(lower(p_brand), '5') AS ends FROM part""")
def cf_text_rules(spark, sf_dir):
    t, b = F.col("p_type"), F.col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", cf.text_rule(t, "contains", "ST").alias("has"), cf.text_rule(t, "notContains", "St").alias("hasnt"), cf.text_rule(b, "beginsWith", "brand#1").alias("begins"), cf.text_rule(b, "endsWith", "5").alias("ends"))


@register(f"""SELECT o_orderkey, d = DATE '1995-06-15' AS today, d BETWEEN DATE '1995-06-09' AND DATE '1995-06-15' AS last7, d BETWEEN DATE '1995-06-11' AND DATE '1995-06-17' AS this_week, d BETWEEN DATE '1995-06-18' AND DATE '1995-06-24' AS next_week,
  date_trunc('month', d) = DATE '1995-06-01' AS this_month, date_trunc('month', d) = DATE '1995-05-01' AS last_month FROM (SELECT o_orderkey, {_DAY} AS d FROM orders)""")
def cf_time_period(spark, sf_dir):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    names = {"today": "today", "last7Days": "last7", "thisWeek": "this_week", "nextWeek": "next_week", "thisMonth": "this_month", "lastMonth": "last_month"}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[cf.time_period(serial, p, NOW).alias(n) for p, n in names.items()])


@register("""SELECT l_orderkey, l_linenumber, coalesce(l_quantity > 1.5 * avg(l_quantity) OVER (PARTITION BY l_suppkey) AND l_discount < 0.05, FALSE) AS matches FROM lineitem""")
def cf_expression(spark, sf_dir):
    return cf.expression_rule(table(spark, sf_dir, "lineitem"), "=AND(l_quantity>1.5*AVERAGE(l_quantity),l_discount<0.05)", ["l_suppkey"]).select("l_orderkey", "l_linenumber", "matches")


@register("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'bold' WHEN o_orderstatus = 'F' THEN 'green' WHEN contains(lower(o_orderpriority), 'urgent') THEN 'red' END AS format FROM orders""")
def cf_priority(spark, sf_dir):
    rules = [(3, cf.text_rule(F.col("o_orderpriority"), "contains", "URGENT"), "red"), (1, cf.cell_is(F.col("o_totalprice"), "greaterThan", 300000), "bold"), (2, cf.cell_is(F.col("o_orderstatus"), "equal", "f"), "green")]
    return table(spark, sf_dir, "orders").select("o_orderkey", cf.first_rule(rules))


# --- grids ----------------------------------------------------------------------------------


def _supplier_cells(spark, sf_dir) -> DataFrame:
    return grid.to_cells(table(spark, sf_dir, "supplier").select("s_name", "s_nationkey", "s_acctbal", "s_suppkey"), F.col("s_suppkey"), ["s_name", "s_nationkey", "s_acctbal"], F.col("s_nationkey"))


@register("""SELECT s_nationkey AS sheet, CAST(s_suppkey AS INTEGER) AS row, 0 AS col, 'str' AS kind, CAST(NULL AS DOUBLE) AS num, s_name AS str, 'A' || (s_suppkey + 1) AS address FROM supplier UNION ALL
  SELECT s_nationkey, s_suppkey, 1, 'num', s_nationkey, NULL, 'B' || (s_suppkey + 1) FROM supplier UNION ALL SELECT s_nationkey, s_suppkey, 2, 'num', s_acctbal, NULL, 'C' || (s_suppkey + 1) FROM supplier""")
def g_sparse_cells(spark, sf_dir):
    return _supplier_cells(spark, sf_dir).select("sheet", "row", "col", "kind", "num", "str", grid.cell_address(F.col("row"), F.col("col")).alias("address"))


@register("""SELECT s_nationkey AS sheet, CAST(max(s_suppkey) AS INTEGER) AS last_row, 2 AS last_col, 3 * count(*) AS n_cells FROM supplier GROUP BY s_nationkey""")
def g_used_range(spark, sf_dir):
    return grid.used_range(_supplier_cells(spark, sf_dir))


@register("""SELECT s_nationkey AS sheet, CAST(s_suppkey AS INTEGER) AS row, k AS col, CASE WHEN k <= 1 AND s_suppkey BETWEEN 10 AND 40 THEN 'first' WHEN s_suppkey BETWEEN 30 AND 60 THEN 'second' END AS label FROM supplier, (VALUES (0), (1), (2)) v(k)""")
def g_range_join(spark, sf_dir):
    cells = _supplier_cells(spark, sf_dir)
    boxes = spark.createDataFrame([(10, 0, 40, 1, "first", 1), (30, 0, 60, 16383, "second", 2)], "r0 int, c0 int, r1 int, c1 int, label string, ord int")
    ranges = cells.select("sheet").distinct().join(F.broadcast(boxes))
    return grid.range_join(cells, ranges, ["label"], "ord").select("sheet", "row", "col", "label")


@register("""SELECT n_nationkey, CASE WHEN k > 1 THEN CAST((k - 2) % 2 AS INTEGER) END AS band FROM (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)""")
def g_row_banding(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", grid.band(F.col("n_nationkey"), ["n_regionkey"]).alias("band"))


@register("""SELECT p_brand, CAST(k AS INTEGER) AS item, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY f, p_type) AS k FROM (SELECT p_brand, p_type, min(p_partkey) AS f FROM part GROUP BY ALL)) WHERE k <= 256""")
def g_slicer_items(spark, sf_dir):
    return grid.slicer_items(table(spark, sf_dir, "part"), "p_type", "p_partkey", ["p_brand"])


@register("""SELECT c_custkey, coalesce(n_name, '') AS text FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def g_shared_strings(spark, sf_dir):
    strings = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("text"))
    return grid.decode_shared(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", strings).select("c_custkey", "text")


@register("""SELECT s_nationkey AS sheet, round(sum(s_acctbal) FILTER (WHERE s_suppkey BETWEEN 4 AND 49), 2) AS total, CAST(count(*) FILTER (WHERE s_suppkey BETWEEN 4 AND 49 AND s_acctbal > 0) AS DOUBLE) AS positive FROM supplier GROUP BY s_nationkey""")
def g_area_formulas(spark, sf_dir):
    cells = _supplier_cells(spark, sf_dir).withColumn("err", F.lit(None).cast("string"))
    out = aggregate_formulas(cells, {"total": "SUM($C$5:C50)", "positive": 'COUNTIF(C5:C50,">0")'}, ["sheet"])
    counted = cells.where(grid.in_area(F.col("row"), F.col("col"), (4, 2, 49, 2))).groupBy("sheet").agg(F.count("*").alias("_n"))
    return out.join(counted, "sheet", "left").select("sheet", F.when(F.col("_n") > 0, F.round("total", 2)).alias("total"), "positive")


# --- text and documents ---------------------------------------------------------------------


@register("""SELECT doc_id, regexp_matches(coalesce(text, ''), '[\\x{0590}-\\x{08FF}]') AS rtl, CAST(length(regexp_replace(coalesce(text, ''), '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS INTEGER) AS han FROM documents""")
def d_scripts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", tx.has_rtl(t).alias("rtl"), tx.script_count(t, "han").alias("han"))


@register("""SELECT page_id, CASE WHEN lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto') THEN trim(url) END AS link FROM pages""")
def d_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_link(F.col("url")).alias("link"))


@register("""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN least(length(text) % 9 + 1, 6) WHEN turn % 4 = 1 THEN least(length(text) % 9 + 1, 6) WHEN turn % 4 = 2 THEN 1 END AS level, CASE WHEN length(text) >= 1.5 * m THEN 0 WHEN length(text) >= 1.25 * m THEN 1 END AS by_size FROM conversations JOIN (SELECT conv_id, median(length(text)) AS m FROM conversations GROUP BY 1) USING (conv_id)""")
def d_headings(spark, sf_dir):
    """Levels from outlines, from styles' names, and from sizes beside the document's median."""
    turns = table(spark, sf_dir, "conversations")
    n, kind = F.length("text"), F.col("turn") % 4
    median = turns.groupBy("conv_id").agg(F.median(n).alias("m"))
    outline = F.when(kind == 0, n % 9)
    style = F.when(kind == 1, F.concat(F.lit("heading "), (n % 9 + 1).cast("string"))).when(kind == 2, "Title").otherwise("Normal")
    return turns.join(median, "conv_id").select("conv_id", "turn", tx.heading_level(outline, style).alias("level"), tx.heading_by_size(n, F.col("m")).alias("by_size"))


@register(r"""SELECT doc_id, NOT regexp_matches(coalesce(text, ''), '[^\s\x{00A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]') AS blank, replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS escaped, source = 'a' OR starts_with(source, 'a.') AS inside, replace(coalesce(source, ''), 'e', 'e' || chr(10)) AS decoded FROM documents""")
def t_text_tools(spark, sf_dir):
    """Blank texts, markup, feature prefixes and escaped characters."""
    t, source = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    coded = F.replace(source, F.lit("e"), F.lit("e_x000A_"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_blank(t).alias("blank"), tx.escape_html(t).alias("escaped"), tx.within_feature(F.col("source"), "a").alias("inside"), tx.decode_xstring(coded).alias("decoded"))


@register("""SELECT p_brand, floor(lo / step) * step AS low, ceil(hi * 1.05 / step) * step AS high, step FROM (SELECT *, CASE WHEN f < 1.5 THEN 1 WHEN f < 3 THEN 2 WHEN f < 7 THEN 5 ELSE 10 END * unit AS step FROM (SELECT *, (hi - lo) / 5 / unit AS f FROM (SELECT *, power(10, floor(log10((hi - lo) / 5))) AS unit FROM (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1))))""")
def g_nice_scale(spark, sf_dir):
    ends = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    axis = grid.nice_scale(F.col("lo"), F.col("hi"))
    return ends.select("p_brand", axis["min"].alias("low"), axis["max"].alias("high"), axis["step"].alias("step"))


#: Special characters are escaped everywhere, and a mark or number that would start a block at the front.
_ESCAPED = r"regexp_replace(text, '([\\`*_\[\]<>|])', '\\\1', 'g')"
_GUARDED = rf"regexp_replace(regexp_replace({_ESCAPED}, '^(\s*)([#>+-]|={{3,}})', '\1\\\2'), '^(\s*\d{{1,9}})([.)])(\s|$)', '\1\\\2\3')"


@register(rf"""SELECT conv_id, coalesce(string_agg(CASE WHEN turn = 0 THEN '# ' || {_ESCAPED} ELSE {_GUARDED} END, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '') AS markdown FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE text <> '') > 0""")
def d_markdown(spark, sf_dir):
    blocks = table(spark, sf_dir, "conversations").withColumns({"kind": F.when(F.col("turn") == 0, "heading").otherwise("paragraph"), "level": F.lit(1)})
    return document.markdown(blocks, ["conv_id"], "turn")


def _roman_sql(n: str) -> str:
    def digit(place: int, one: str, five: str, ten: str) -> str:
        d = f"({n} // {place} % 10)"
        return f"CASE WHEN {d} = 9 THEN '{one}{ten}' WHEN {d} >= 5 THEN '{five}' || repeat('{one}', CAST({d} - 5 AS INTEGER)) WHEN {d} = 4 THEN '{one}{five}' ELSE repeat('{one}', CAST({d} AS INTEGER)) END"

    return f"repeat('M', CAST({n} // 1000 AS INTEGER)) || {digit(100, 'C', 'D', 'M')} || {digit(10, 'X', 'L', 'C')} || {digit(1, 'I', 'V', 'X')}"


def _letters_sql(n: str) -> str:
    """One to three letters: up to 18 278."""
    return f"CASE WHEN {n} = 0 THEN '' WHEN {n} <= 26 THEN chr(CAST(64 + {n} AS INTEGER)) WHEN {n} <= 702 THEN chr(CAST(64 + ({n} - 1) // 26 AS INTEGER)) || chr(CAST(65 + ({n} - 1) % 26 AS INTEGER)) ELSE chr(CAST(65 + ({n} - 703) // 676 AS INTEGER)) || chr(CAST(65 + ({n} - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + ({n} - 703) % 26 AS INTEGER)) END"


@register(f"""SELECT p_partkey, n, CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS zero, {_letters_sql("n")} AS letter, lower({_letters_sql("n")}) AS small_letter, {_roman_sql("n")} AS roman, lower({_roman_sql("n")}) AS small_roman,
  n || CASE WHEN n % 100 IN (11, 12, 13) THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM (SELECT p_partkey, p_partkey % 3000 AS n FROM part)""")
def d_counters(spark, sf_dir):
    n = F.col("n")
    forms = {"zero": "decimalZero", "letter": "upperLetter", "small_letter": "lowerLetter", "roman": "upperRoman", "small_roman": "lowerRoman", "ordinal": "ordinal"}
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3000).alias("n")).select("p_partkey", "n", *[document.counter(style, n).alias(name) for name, style in forms.items()])


@register("""SELECT user_id AS doc_id, 'dropped' AS severity, event_type AS feature, props AS detail, count(*) AS times FROM events GROUP BY ALL""")
def d_losses(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit("dropped").alias("severity"), F.col("event_type").alias("feature"), F.col("props").alias("detail"))
    return document.distinct_losses(losses)


@register("""SELECT conv_id, turn, CAST(greatest(users, 1) AS INTEGER) AS top, CASE WHEN role <> 'user' THEN CAST(row_number() OVER (PARTITION BY conv_id, users, role <> 'user' ORDER BY turn) AS INTEGER) END AS below FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS users FROM conversations)""")
def d_numbering(spark, sf_dir):
    """Users' turns number the first level of a list, all others the second."""
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.lit("1").alias("num_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("ilvl"))
    return document.number_lists(items).select(F.col("doc_id").alias("conv_id"), F.col("seq").alias("turn"), F.get("counters", F.lit(0)).cast("int").alias("top"), F.get("counters", F.lit(1)).cast("int").alias("below"))


@register("""SELECT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def h_content_hash(spark, sf_dir):
    t = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"))


# --- layout ---------------------------------------------------------------------------------


def _runs(spark, sf_dir) -> DataFrame:
    """Runs set out from documents: each line's words at steps of 40 points, lines 14 points apart."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line_text"))
    words = words.select("doc_id", "n", F.posexplode(F.split("line_text", " ")).alias("k", "text"))
    page, row = F.floor(F.col("n") / 40).cast("int"), F.col("n") % 40
    return words.select("doc_id", page.alias("page"), (F.col("n") * 10000 + F.col("k")).alias("run_idx"), (F.col("k") * 40.0).alias("x"), (row * 14.0).alias("y"), (F.col("k") * 40.0 + 30.0).alias("end_x"), (F.length("text") % 7 + 6.0).alias("font_size"), "text")


@register("""SELECT doc_id, CAST(n // 40 AS INTEGER) AS page, count(DISTINCT n) AS lines, count(*) AS runs FROM (SELECT doc_id, CAST(n AS BIGINT) - 1 AS n, unnest(string_split(l, ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)) GROUP BY ALL""")
def l_lines(spark, sf_dir):
    return layout.lines_by_gap(_runs(spark, sf_dir)).groupBy("doc_id", "page").agg(F.countDistinct("line").alias("lines"), F.count("*").alias("runs"))


_WORDS_SQL = "SELECT doc_id, n, w FROM (SELECT doc_id, n, unnest(string_split(l, ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"


@register(f"""SELECT doc_id, CAST(6.0 + f AS DOUBLE) AS median_font FROM (SELECT doc_id, f, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM (SELECT doc_id, length(w) % 7 AS f FROM ({_WORDS_SQL}) WHERE trim(w) <> '')) WHERE k = c // 2""")
def l_median_font(spark, sf_dir):
    """The upper median of font sizes that follow the words' lengths."""
    return layout.median_font(_runs(spark, sf_dir).where("trim(text) <> ''"))


from . import queries_documents, queries_formulas, queries_sheets  # noqa: E402, F401  add their queries
