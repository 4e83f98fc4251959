"""Queries of payload flattening, exclusion and matching rules, and weekly aggregation, over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelforge.functions import has_category, ratio, stable_hash, ticker, truthy
from panelforge.operators import factors, order, panel, xsec
from panelforge.session import shared_path
from panelforge.sources import chunks, markdown_universe, payloads, table, write_manifest, write_twins

from .common import PANEL, rd, returns, rounded, weekly

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Files


@query("""
WITH l AS (SELECT s_suppkey, s_name, s_nationkey, n_name, 'T' || (s_suppkey % 60) AS symbol FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT n_name AS cohort, CAST(s_suppkey AS INT) AS rank, s_name AS coin, symbol FROM l QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY s_nationkey, s_suppkey) = 1""")
def markdown_cohorts(spark, d):
    """Suppliers as a Markdown universe, a heading a nation, written and parsed; the first row of a symbol stays."""
    a = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", "s_suppkey", "s_name", F.concat(F.lit("t"), F.col("s_suppkey") % 60)), F.lit(" |"))
    head = a.select("s_nationkey", F.lit(-1).cast("long").alias("s_suppkey"), F.concat(F.lit("## "), "n_name").alias("value")).distinct()
    lines = head.unionByName(a.select("s_nationkey", "s_suppkey", cells.alias("value"))).orderBy("s_nationkey", "s_suppkey")
    path = shared_path(spark, "universe")
    lines.select("value").coalesce(1).write.text(path)
    return markdown_universe(spark, path)


@query(f"""
WITH {PANEL}, t AS (SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, min(week) AS first_week, max(week) AS last_week, round(sum(price) + 1e-8, 3) AS price FROM p)
SELECT kind, n, symbols, first_week, last_week, price FROM t, (VALUES ('csv'), ('manifest'), ('parquet')) AS k(kind)""")
def twins_and_manifest(spark, d):
    """The weekly panel as Parquet and CSV twins and the measures of that write as a manifest: each read back and summed up."""
    path = shared_path(spark, "twins")
    symbols = F.size(F.collect_set("symbol")).alias("symbols")
    made = write_twins(weekly(spark, d), path, symbols=F.size(F.collect_set("symbol")), first_week=F.min("week"), last_week=F.max("week"), price=F.sum("price"))
    write_manifest(spark.createDataFrame([(made["rows"], made["symbols"], str(made["first_week"]), str(made["last_week"]), made["price"])], "n long, symbols long, first_week string, last_week string, price double"), f"{path}.json")
    told = spark.read.schema("n long, symbols long, first_week date, last_week date, price double").json(f"{path}.json").select(F.lit("manifest").alias("kind"), "n", "symbols", "first_week", "last_week", "price")
    schema = weekly(spark, d).schema
    read = {"parquet": spark.read.schema(schema).parquet(f"{path}.parquet"), "csv": spark.read.schema(schema).option("header", True).csv(f"{path}.csv")}
    sums = [a.agg(F.count("*").alias("n"), symbols.cast("long"), F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.sum("price").alias("price")).select(F.lit(kind).alias("kind"), "*") for kind, a in read.items()]
    found = told.unionByName(sums[0]).unionByName(sums[1])
    return found.withColumn("price", rd("price", 3))


# Payloads


@query("""
WITH e AS (SELECT user_id, event_type, event_id, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
d AS (SELECT user_id, event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT 'U' || e.user_id AS symbol, event_type AS metric, CASE WHEN event_type = 'purchase' THEN NULL ELSE coalesce(d.day, CASE WHEN event_type = 'click' THEN e.day END) END AS date,
  CASE event_type WHEN 'click' THEN 'web' WHEN 'signup' THEN 'app' END AS dimension, round(value + 1e-8, 4) AS value
FROM e LEFT JOIN d ON d.user_id = e.user_id AND d.k = e.k AND d.k <= 3 WHERE event_type IN ('view', 'click', 'signup') OR (event_type = 'purchase' AND e.k = 1)""")
def payload_series(spark, d):
    """A payload a user: three dates, a list (views), a list of objects with dates and a dimension (clicks), an object of
    lists (signups) and one value (the first purchase)."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    lists = lambda kind, item: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "value", "day")))), item)
    own = F.col("event_id")
    a = e.groupBy("user_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("event_id", "day"))), 1, 3), lambda x: x["day"]).alias("dates"), lists("view", lambda x: x["value"]).alias("view"),
        lists("click", lambda x: F.struct(x["day"].alias("date"), x["value"].alias("val"), F.lit("web").alias("chain"))).alias("click"), lists("signup", lambda x: x["value"]).alias("signup"),
        F.min_by("value", F.when(F.col("event_type") == "purchase", own)).alias("purchase"),
    )
    metrics = F.concat(
        F.lit('{"view": '), F.to_json("view"), F.lit(', "click": '), F.to_json("click"), F.lit(', "signup": {"app": '), F.to_json("signup"), F.lit("}"),
        F.coalesce(F.concat(F.lit(', "purchase": '), F.col("purchase").cast("string")), F.lit("")), F.lit("}"),
    )
    text = F.concat(F.lit('{"data": {"dates": '), F.to_json("dates"), F.lit(', "symbols": {"u'), F.col("user_id").cast("string"), F.lit('": '), metrics, F.lit("}}}"))
    return rounded(payloads.metric_series(a.select(text.alias("payload"))), 4)


@query("SELECT p_partkey, len(list_filter(string_split(lower(p_type), ' '), lambda c: contains(c, 'steel') OR contains(c, 'brass'))) > 0 AS metal FROM part")
def category_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", has_category(F.split("p_type", " "), ["STEEL", "brass"]).alias("metal"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS ts, round(max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 4) AS price, round(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mcap, round(max(o_totalprice), 4) AS volume
FROM orders GROUP BY 1, 2""")
def ticks_merge(spark, d):
    """Three parallel lists of [ts, value] a customer, merged by ts."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double")
    pair = lambda when: F.collect_list(F.when(when, F.array(ms, F.col("o_totalprice"))))
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol"))
    charts = a.agg(pair(F.col("o_orderpriority") == "1-URGENT").alias("prices"), pair(F.col("o_orderstatus") == "F").alias("market_caps"), pair(F.lit(True)).alias("total_volumes"))
    return rounded(payloads.merged_ticks(charts).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 4)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS symbol, o_orderdate AS open_time, o_totalprice AS open, o_totalprice + 1 AS high, CAST(NULL AS DOUBLE) AS low, CAST(o_custkey AS DOUBLE) AS close, 7.0::DOUBLE AS volume FROM orders WHERE o_orderstatus <> 'P'")
def klines_bars(spark, d):
    """Positional bars as texts; those of pending orders are too short and dropped."""
    ms, price = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"), F.col("o_totalprice")
    head = [ms, price.cast("string"), (price + 1).cast("string"), F.lit("n/a"), F.col("o_custkey").cast("string"), F.lit("7")]
    bar = F.when(F.col("o_orderstatus") == "P", F.array(*head)).otherwise(F.array(*head, F.lit("1"), F.lit("2"), F.lit("3")))
    a = payloads.klines(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("symbol"), bar.alias("k")))
    return a.withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), l_tax) AS tvl, CASE WHEN l_returnflag = 'N' AND l_quantity = 0 THEN NULL ELSE coalesce(CASE WHEN l_returnflag = 'A' THEN l_quantity END, CASE WHEN l_returnflag = 'R' THEN l_discount END, l_tax) / nullif(l_tax, 0) END AS share FROM lineitem")
def tvl_and_unlocks(spark, d):
    """The total or, where it is zero, the other field; and an amount under one of three names over the largest supply."""
    a = table(spark, d, "lineitem")
    named = {"amount": F.when(F.col("l_returnflag") == "A", F.col("l_quantity")), "tokens": F.when(F.col("l_returnflag") == "R", F.col("l_discount")), "value": F.col("l_tax"), "max_supply": F.col("l_tax")}
    return a.select("l_orderkey", "l_linenumber", payloads.tvl_value(F.col("l_discount"), F.col("l_tax")).alias("tvl"), payloads.unlock_share(named).alias("share"))


@query("""
WITH s AS (SELECT DISTINCT 'b' || lower(p_brand) AS slug FROM part WHERE p_size > 40 AND p_brand > 'Brand#3'), n AS (SELECT trim(lower(p_type)) AS name, arg_max('b' || lower(p_brand), p_partkey) AS slug FROM part WHERE p_size > 40 AND p_brand > 'Brand#3' GROUP BY 1)
SELECT p_partkey, CASE WHEN s.slug IS NOT NULL THEN 'B' || p_brand ELSE n.slug END AS matched FROM (SELECT *, CASE WHEN p_size > 15 THEN 'B' || p_brand END AS own FROM part) p
LEFT JOIN s ON s.slug = lower(own) LEFT JOIN n ON n.name = trim(lower(p_type)) WHERE s.slug IS NOT NULL OR n.slug IS NOT NULL""")
def raises_match(spark, d):
    """Parts matched to protocols by slug where they have one, else by name."""
    p = table(spark, d, "part")
    slug = F.concat(F.lit("b"), F.lower("p_brand"))
    protocols = p.filter("p_size > 40 and p_brand > 'Brand#3'").select(slug.alias("slug"), F.col("p_type").alias("name"), "p_partkey")
    rows = p.select("p_partkey", F.when(F.col("p_size") > 15, F.concat(F.lit("B"), F.col("p_brand"))).alias("slug"), F.concat(F.lit(" "), F.upper("p_type")).alias("name"))
    return payloads.match_by_slug_or_name(rows, protocols, "p_partkey").select("p_partkey", "matched")


#: Points of a chunk that is written, about, at most, unless an hour has more.
CHUNK_POINTS = 50_000


@query("""
SELECT event_type AS name, epoch_us(ts) // 1000 AS ts_ms, round(arg_max(value, event_id) + 1e-8, 4) AS price, round(CASE WHEN epoch_us(ts) // 1000 % 2 = 0 THEN arg_max(value, event_id) * 2 END + 1e-8, 4) AS mcap FROM events GROUP BY 1, 2""")
def chunk_replay(spark, d):
    """Events as cached chart payloads, a chunk a day and type or, where a day has more than ``CHUNK_POINTS``, some hours of it,
    written and replayed through the data source: a task reads a chunk whole."""
    ms = F.expr("unix_millis(cast(ts AS timestamp))")
    e = table(spark, d, "events")
    busiest = e.groupBy("event_type", F.to_date("ts").alias("day")).count().agg(F.max("count")).first()[0] or 1
    hours = min(24, max(1, 24 * CHUNK_POINTS // busiest))
    label = F.concat(F.date_format("ts", "yyyyMMdd"), F.lpad((F.hour("ts") - F.hour("ts") % hours).cast("string"), 2, "0"))
    e = e.select("event_id", "event_type", ms.alias("ms"), "value", label.alias("label"))
    points = F.array_sort(F.collect_list(F.struct("event_id", F.array(F.col("ms").cast("double"), "value").alias("p"), F.when(F.col("ms") % 2 == 0, F.array(F.col("ms").cast("double"), F.col("value") * 2)).alias("m"))))
    files = e.groupBy(F.concat_ws("_", "event_type", "label").alias("file")).agg(points.alias("x"))
    payload = F.to_json(F.struct(F.col("x.p").alias("prices"), F.filter("x.m", lambda m: m.isNotNull()).alias("market_caps")))
    folder = shared_path(spark, "chunks")
    chunks.write(files.select("file", payload.alias("payload")), folder)
    labels = [r["label"] for r in e.select("label").distinct().collect()]  # a row a day or some hours
    a = chunks.chunks(spark, folder, labels)
    return a.select("name", F.unix_millis("ts").alias("ts_ms"), rd("price", 4).alias("price"), rd("mcap", 4).alias("mcap"))


@query("""SELECT event_id, CAST(ts AS DATE) AS day, round(value + coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + 1e-8, 4) AS supply FROM events""")
def stable_points(spark, d):
    """Points whose date is Unix seconds or ISO text by type of event, and whose supply is the sum of a map."""
    e = table(spark, d, "events")
    date = F.when(F.col("event_type") == "view", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    supply = F.create_map(F.lit("peggedUSD"), F.col("value"), F.lit("peggedEUR"), F.get_json_object("props", "$.k").try_cast("double"))
    day, total = payloads.stable_point(F.col("date"), F.col("supply"))
    return e.select("event_id", date.alias("date"), supply.alias("supply")).select("event_id", day.alias("day"), rd(total, 4).alias("supply"))


@query("""SELECT event_id, sha256('{"event":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","user":"' || user_id || '"}') AS digest FROM events""")
def hashed_payloads(spark, d):
    """Hashes of maps, the same whatever the order of their keys."""
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("props"), F.col("props"), F.lit("event"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", stable_hash(m).alias("digest"))


@query("SELECT p_partkey, json_object('size', p_size, 'type', p_type)::VARCHAR AS text FROM part")
def scalar_texts(spark, d):
    """Nested values as JSON text."""
    from panelforge.functions import json_text

    return table(spark, d, "part").select("p_partkey", json_text(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type"))).alias("text"))


# Exclusions, labels and matching rules


@query("""
WITH x AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT s_suppkey, s_nationkey NOT IN (SELECT n_nationkey FROM x) AS kept FROM supplier""")
def exclusion_join(spark, d):
    """Suppliers outside and inside an exclusion set of nations."""
    names = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"))
    kept, gone = panel.excluded(table(spark, d, "supplier"), names, "s_nationkey")
    return kept.select("s_suppkey", F.lit(True).alias("kept")).unionByName(gone.select("s_suppkey", F.lit(False).alias("kept")))


@query("""SELECT upper(trim(' ' || c_name || ' ')) AS symbol, CASE WHEN c_acctbal < 0 THEN 'unmapped' WHEN c_mktsegment = 'BUILDING' THEN 'mapped_exact_name' ELSE 'mapped_single_candidate' END AS status,
  substr(c_name, 1, 8) AS prefix, replace(c_name, '#', '-') AS dashed FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')""")
def listed_exclusions(spark, d):
    """Normalised names outside a fixed list of segments, with how they are mapped; columns that a table lacks are left out."""
    c = table(spark, d, "customer").filter(~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"))
    c = c.select(*panel.existing(c, ["c_name", "c_acctbal", "c_mktsegment", "c_missing"]))
    status = panel.mapping_status(F.when(F.col("c_acctbal") >= 0, F.col("c_name")), F.col("c_mktsegment") == "BUILDING")
    return c.select(ticker(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("symbol"), status.alias("status"), F.substring("c_name", 1, 8).alias("prefix"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"))


@query("""
WITH p AS (SELECT * FROM (SELECT CAST(p_size AS VARCHAR) AS gecko_id, p_name AS slug, CASE WHEN p_size = 7 THEN NULL ELSE p_brand END AS category, p_retailprice AS tvl, p_partkey FROM part)),
b AS (SELECT gecko_id, arg_max(slug, (coalesce(tvl, 0), slug)) FILTER (lower(category) IN ('brand#11', 'brand#22', 'brand#33')) AS best, count(*) FILTER (lower(category) IN ('brand#11', 'brand#22', 'brand#33')) AS fit FROM p GROUP BY 1)
SELECT s_name AS symbol, CASE WHEN s_nationkey = 3 THEN NULL WHEN s_nationkey = 5 THEN 'by-hand' WHEN s_nationkey = 6 THEN NULL ELSE best END AS slug,
  CASE WHEN s_nationkey = 3 THEN 'skipped' WHEN s_nationkey = 5 THEN 'override' WHEN s_nationkey = 6 THEN 'override_skip' WHEN fit IS NULL THEN 'unmapped' WHEN fit = 0 THEN 'fallback_filtered_out' ELSE 'gecko_id_fallback' END AS source
FROM supplier LEFT JOIN b ON gecko_id = CAST(s_suppkey AS VARCHAR)""")
def rule_cascade(spark, d):
    s = table(spark, d, "supplier")
    assets = s.select(F.col("s_name").alias("symbol"), F.col("s_suppkey").cast("string").alias("gecko_id"))
    protocols = table(spark, d, "part").select(F.col("p_size").cast("string").alias("gecko_id"), F.col("p_name").alias("slug"), F.when(F.col("p_size") != 7, F.col("p_brand")).alias("category"), F.col("p_retailprice").alias("tvl"))
    named = lambda key: s.filter(F.col("s_nationkey") == key).select(F.col("s_name").alias("symbol"))
    overrides = named(5).withColumn("slug", F.lit("by-hand")).unionByName(named(6).withColumn("slug", F.lit(None).cast("string")))
    return panel.cascade(assets, named(3), overrides, protocols, ["brand#11", "brand#22", "brand#33"])


# Weekly aggregation


@query("SELECT user_id AS symbol, CAST(date_trunc('week', ts) AS DATE) AS week, round(avg(value) + 1e-8, 5) AS act_value FROM events GROUP BY 1, 2")
def weekly_mean(spark, d):
    return rounded(table(spark, d, "events").groupBy(F.col("user_id").alias("symbol"), panel.week_of("ts").alias("week")).agg(F.avg("value").alias("act_value")), 5)


_SLUGS = "SELECT CAST(c_nationkey AS VARCHAR) AS symbol, c_custkey AS slug FROM customer UNION SELECT c_mktsegment, c_custkey FROM customer"


@query(f"""
WITH m AS ({_SLUGS}), o AS (SELECT o_custkey AS slug, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS tvl FROM orders GROUP BY 1, 2)
SELECT symbol, week, round(sum(tvl) + 1e-8, 3) AS tvl FROM o JOIN m USING (slug) GROUP BY 1, 2""")
def two_level_sum(spark, d):
    """The last value of each symbol, slug and week, summed by symbol and week; a slug has two symbols here."""
    c = table(spark, d, "customer")
    slugs = c.select(F.col("c_nationkey").cast("string").alias("symbol"), F.col("c_custkey").alias("slug")).union(c.select("c_mktsegment", "c_custkey")).distinct()
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("slug"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("tvl"))
    return rounded(panel.last_by_slug_then_sum(rows, slugs, "o_orderdate", ["o_orderdate", "o_orderkey"], "tvl"), 3)


@query("""
WITH c AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS supply, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS inflow FROM events GROUP BY 1)
SELECT CAST(date_trunc('week', day) AS DATE) AS week, round(arg_max(supply, day) + 1e-8, 4) AS supply, round(arg_max(inflow, day) + 1e-8, 4) AS inflow FROM c GROUP BY 1""")
def chain_fallback(spark, d):
    """Each week's last day; types of events are chains, none of them ALL, so days are sums over chains."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("chain"), F.col("value").alias("supply"), F.get_json_object("props", "$.k").try_cast("double").alias("inflow"))
    return rounded(panel.chain_totals(e, ["supply", "inflow"]), 4)


@query("""
WITH l AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_suppkey AS symbol, * FROM lineitem),
a AS (SELECT week, symbol, sum(l_extendedprice * l_discount) AS fees FROM l WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT week, symbol, sum(l_extendedprice * l_tax) AS tvl FROM l WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT week, symbol, round(fees + 1e-8, 4) AS fees, round(tvl + 1e-8, 4) AS tvl FROM a FULL OUTER JOIN b USING (week, symbol)""")
def outer_measures(spark, d):
    """Fees of returned lines beside the value of the others: weeks and symbols that either has."""
    a = table(spark, d, "lineitem")
    weekly_sum = lambda rows, x, name: rows.groupBy(panel.week_of("l_shipdate").alias("week"), F.col("l_suppkey").alias("symbol")).agg(F.sum(F.col("l_extendedprice") * F.col(x)).alias(name))
    fees, tvl = weekly_sum(a.filter("l_returnflag = 'R'"), "l_discount", "fees"), weekly_sum(a.filter("l_returnflag <> 'R'"), "l_tax", "tvl")
    return rounded(fees.join(tvl, ["week", "symbol"], "full_outer"), 4)


@query("SELECT p_brand AS base, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY p_size) AS quotes, len(list(p_size)) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1")
def quote_lists(spark, d):
    """The tradable quotes of each base."""
    a = table(spark, d, "part").groupBy(F.col("p_brand").alias("base")).agg(F.sort_array(F.collect_set("p_size")).alias("q"))
    return a.select("base", F.array_join(F.col("q").cast("array<string>"), ",").alias("quotes"), F.size("q").cast("long").alias("n"))


@query(f"""
WITH {PANEL}, k AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY week DESC) AS r FROM r WHERE ret IS NOT NULL)
SELECT symbol, round(exp(sum(ln(1 + ret))) - 1 + 1e-8, 6) AS ret4, count(*) AS n FROM k WHERE r <= 4 GROUP BY 1""")
def last_rows_compounded(spark, d):
    r = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("week").desc()))
    a = returns(spark, d).filter("ret is not null").withColumn("r", r).filter("r <= 4")
    return rounded(a.groupBy("symbol").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret4"), F.count("*").alias("n")))


@query(f"""
WITH {PANEL}, c AS (SELECT symbol, max(week) AS last_week, count(*) AS n, CASE WHEN count(*) > 200 THEN avg(fees) END AS depth FROM p GROUP BY 1)
SELECT symbol, n, row_number() OVER (ORDER BY depth DESC NULLS LAST, n DESC NULLS LAST, symbol) AS place FROM c""")
def sorted_coverage(spark, d):
    """Symbols in order of depth, unknown ones last; then by count and name."""
    a = weekly(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.when(F.count("*") > 200, F.avg("fees")).alias("depth"))
    return order.positions(a, [F.col("depth").desc_nulls_last(), F.col("n").desc_nulls_last(), F.col("symbol")], "place").select("symbol", "n", "place")


@query(f"""
WITH {PANEL}, c AS (SELECT symbol, min(week) AS a, max(week) AS b, count(*) AS n FROM p GROUP BY 1), k AS (SELECT symbol FROM c WHERE (b - a) / 365.25 >= 5 AND n >= 200)
SELECT week, count(*) AS live, count(*) FILTER (symbol IN (SELECT symbol FROM k)) AS backbone FROM (SELECT week, symbol, count(ret) OVER (PARTITION BY symbol ORDER BY week ROWS UNBOUNDED PRECEDING) AS seen FROM r) WHERE seen >= 12 GROUP BY week""")
def live_members(spark, d):
    """Members with twelve returns by week, and how many of them have five years and 200 weeks in all."""
    core = panel.backbone(panel.coverage(weekly(spark, d), "price")).select("symbol", F.lit(True).alias("core"))
    a = panel.eligible(returns(spark, d), "ret").filter("eligible").join(core, "symbol", "left")
    return a.groupBy("week").agg(F.count("*").alias("live"), F.count_if("core").alias("backbone"))


@query(f"""
WITH {PANEL}, a AS (SELECT symbol, week, price, mcap, ln(mcap / price) AS y, CAST(week - min(week) OVER (PARTITION BY symbol) AS DOUBLE) AS t FROM p WHERE mcap > 0 AND price > 0),
k AS (SELECT symbol, greatest(least(regr_slope(y, t), 0.50 / 365), -0.03 / 365) AS slope, avg(y) AS my, avg(t) AS mt, exp(max(y)) AS most FROM a GROUP BY 1 HAVING count(*) >= 30),
e AS (SELECT symbol, CAST(floor(((SELECT max(week) FROM p) - week) / 365.25) AS INT) AS years_back, abs(least(exp(my + slope * (t - mt)), most) * price / mcap - 1) AS ape FROM a JOIN k USING (symbol)),
s AS (SELECT symbol, years_back, median(ape) AS m, count(*) AS n, sum(count(*)) OVER (PARTITION BY symbol) AS total FROM e GROUP BY 1, 2)
SELECT years_back, round(sum(m * n) / sum(n) + 1e-8, 5) AS median_abs_pct_err, count(DISTINCT symbol) AS n_coins FROM s WHERE total > 30 GROUP BY 1""")
def reconstruction_error(spark, d):
    """How far price times fitted supply is from the real value, by full years back: medians by symbol, weighted by their counts."""
    return rounded(factors.reconstruction_error(returns(spark, d)), 5)


# Fundamental characteristics


def _roll(x: str, n: int, least: int) -> str:
    over = f"(PARTITION BY symbol ORDER BY week ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {over} >= {least} THEN avg({x}) OVER {over} END"


def _nz(x: str) -> str:
    return f"({x} - avg({x}) OVER (PARTITION BY week)) / nullif(stddev_samp({x}) OVER (PARTITION BY week), 0)"


@query(f"""
WITH {PANEL}, a AS (SELECT *, (52 * {_roll('fees', 4, 2)} + 0.5 * 52 * {_roll('tvl', 4, 2)}) / mcap AS cash, {_roll('fees', 4, 2)} / {_roll('fees', 16, 6)} - 1 AS g1, {_roll('volume', 4, 2)} / {_roll('volume', 16, 6)} - 1 AS g2,
  (mcap / price) / lag(mcap / price, 12) OVER (PARTITION BY symbol ORDER BY week) - 1 AS em FROM p),
z AS (SELECT *, {_nz('g1')} AS z1, {_nz('g2')} AS z2, {_nz('em')} AS ze FROM a)
SELECT week, symbol, round(cash + 1e-8, 5) AS cash_yield, round(CASE WHEN z1 IS NULL THEN z2 WHEN z2 IS NULL THEN z1 ELSE (z1 + z2) / 2 END + 1e-8, 4) AS growth, round(-ze + 1e-8, 4) AS emission,
  round(ln(mcap) + 1e-8, 5) AS log_mcap, round(ln(volume) + 1e-8, 5) AS log_volume, round(volume / mcap + 1e-8, 7) AS turnover FROM z""")
def fundamentals(spark, d):
    """Cash-flow yield, growth of activity, emission of supply, and market features."""
    a = factors.activity_growth(factors.cash_flow_yield(weekly(spark, d)), ["fees", "volume"])
    a = factors.supply_emission(a).withColumns({"log_mcap": F.log("mcap"), "log_volume": F.log("volume"), "turnover": ratio(F.col("volume"), F.col("mcap"))})
    places = {"cash_yield": 5, "growth": 4, "emission": 4, "log_mcap": 5, "log_volume": 5, "turnover": 7}
    return a.select("week", "symbol", *(rd(c, k).alias(c) for c, k in places.items()))
