"""The registered queries over the driver's tables and their SQL twins.

Each query is a text in the engine's language. Sums and means of doubles are rounded
to whole units, because the order of additions is not fixed.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_MONTH = "substring(string($l=>l_shipdate), 1, 7)"
_SQL_MONTH = "substring(CAST(l_shipdate AS VARCHAR), 1, 7)"

#: name -> (query, SQL or None).
QUERIES: dict[str, tuple[str, str | None]] = {
    # sources, bindings, filters
    "scan": ("for $l in collection('lineitem') return $l", "SELECT * FROM lineitem"),
    "scan_small": ("for $n in collection('nation') return $n", "SELECT * FROM nation"),
    "projection": ("for $o in collection('orders') return { key: $o=>o_orderkey, price: $o=>o_totalprice }", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders"),
    "field_values": ("for $n in collection('nation')=>n_name return $n", "SELECT n_name AS value FROM nation"),
    "filter_gt": ("for $o in collection('orders') where $o=>o_orderkey > 100 return $o", "SELECT * FROM orders WHERE o_orderkey > 100"),
    "filter_and": (
        "for $l in collection('orders') where $l=>o_orderkey > 100 and $l=>o_orderdate > '1998-01-01' return $l",
        "SELECT * FROM orders WHERE o_orderkey > 100 AND o_orderdate > TIMESTAMP '1998-01-01'",
    ),
    "filter_or_not": (
        "for $c in collection('customer') where $c=>c_mktsegment = 'BUILDING' or not($c=>c_acctbal >= 0) return { c: $c=>c_custkey }",
        "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT (c_acctbal >= 0)",
    ),
    "filter_string": ("for $c in collection('customer') where $c=>c_mktsegment eq 'BUILDING' return $c", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_value_comparisons": (
        "for $l in collection('lineitem') where $l=>l_quantity ge 10 and $l=>l_quantity lt 12 and $l=>l_linenumber ne 1 and $l=>l_discount le 0.05 return { k: $l=>l_orderkey, n: $l=>l_linenumber }",
        "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_linenumber <> 1 AND l_discount <= 0.05",
    ),
    "filter_two_on_one_field": ("for $l in collection('lineitem') where $l=>l_quantity > 10 and $l=>l_quantity < 20 return { q: $l=>l_quantity }", "SELECT l_quantity AS q FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20"),
    "filter_empty": ("for $l in collection('lineitem') where $l=>l_quantity < 0 let $k := $l=>l_orderkey group by $k order by $k return { k: $k, n: count($l) }", "SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY 1"),
    "let_arith": (
        "for $l in collection('lineitem') let $net := $l=>l_extendedprice * (1 - $l=>l_discount), $gross := $net * (1 + $l=>l_tax) return { k: $l=>l_orderkey, net: round($net), gross: round($gross) }",
        "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount)) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS gross FROM lineitem",
    ),
    "integer_arith": (
        "for $o in collection('orders') return { k: $o=>o_orderkey, m: $o=>o_orderkey mod 7, d: $o=>o_orderkey idiv 7, n: -$o=>o_orderkey + 1 }",
        "SELECT o_orderkey AS k, o_orderkey % 7 AS m, o_orderkey // 7 AS d, -o_orderkey + 1 AS n FROM orders",
    ),
    "record_ctor": (
        "for $o in collection('orders') let $r := { key: $o=>o_orderkey, inner: { status: $o=>o_orderstatus } } return { k: $r=>key, s: $r=>inner=>status }",
        "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders",
    ),
    "substring_month": (f"for $l in collection('lineitem') return {{ k: $l=>l_orderkey, month: {_MONTH} }}", f"SELECT l_orderkey AS k, {_SQL_MONTH} AS month FROM lineitem"),
    "sqrt_div": ("for $p in collection('part') return { k: $p=>p_partkey, r: floor(math:sqrt($p=>p_size)), h: $p=>p_size div 2 }", "SELECT p_partkey AS k, CAST(floor(sqrt(p_size)) AS BIGINT) AS r, p_size / 2 AS h FROM part"),
    "string_functions": (
        "for $n in collection('nation') where contains($n=>n_name, 'A') return { up: upper-case($n=>n_name), low: lower-case($n=>n_name), n: string-length($n=>n_name), c: concat($n=>n_name, '-', $n=>n_nationkey) }",
        "SELECT upper(n_name) AS up, lower(n_name) AS low, CAST(length(n_name) AS INTEGER) AS n, n_name || '-' || n_nationkey AS c FROM nation WHERE contains(n_name, 'A')",
    ),
    "conditional": (
        "for $p in collection('part') return { k: $p=>p_partkey, size: if ($p=>p_size > 25) then 'big' else 'small', s: $p=>p_size cast as xs:string }",
        "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, CAST(p_size AS VARCHAR) AS s FROM part",
    ),
    "declared_function": (
        "declare function local:net($price, $discount) { $price * (1 - $discount) }; for $l in collection('lineitem') return { k: $l=>l_orderkey, net: round(local:net($l=>l_extendedprice, $l=>l_discount)) }",
        "SELECT l_orderkey AS k, round(l_extendedprice * (1 - l_discount)) AS net FROM lineitem",
    ),
    "for_over_sequence": (
        "for $n in collection('nation') for $x in ($n=>n_nationkey, $n=>n_regionkey) return { n: $n=>n_name, x: $x }",
        "SELECT n_name AS n, unnest([n_nationkey, n_regionkey]) AS x FROM nation",
    ),
    "general_comparison": ("for $n in collection('nation') where ($n=>n_nationkey, $n=>n_regionkey) = (1, 3) return $n", "SELECT * FROM nation WHERE n_nationkey IN (1, 3) OR n_regionkey IN (1, 3)"),
    # sorting
    "order_by": ("for $o in collection('orders') let $d := $o=>o_orderdate order by $d return $o", "SELECT * FROM orders ORDER BY o_orderdate"),
    "order_by_desc": ("for $c in collection('customer') order by $c=>c_acctbal descending empty greatest return { c: $c=>c_custkey, b: $c=>c_acctbal }", "SELECT c_custkey AS c, c_acctbal AS b FROM customer"),
    "order_by_multi": ("for $p in collection('part') order by $p=>p_brand, $p=>p_size descending, $p=>p_partkey return { k: $p=>p_partkey, b: $p=>p_brand, s: $p=>p_size }", "SELECT p_partkey AS k, p_brand AS b, p_size AS s FROM part"),
    # grouping
    "group_by_collect": (
        "for $n in collection('nation') let $r := $n=>n_regionkey, $name := $n=>n_name group by $r for $x in $name return { r: $r, name: $x, n: count($name) }",
        "SELECT n_regionkey AS r, n_name AS name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation",
    ),
    "group_sum": (f"for $l in collection('lineitem') let $m := {_MONTH} group by $m return {{ month: $m, sum_price: round(sum($l=>l_extendedprice)) }}", f"SELECT {_SQL_MONTH} AS month, round(sum(l_extendedprice)) AS sum_price FROM lineitem GROUP BY 1"),
    "group_count": ("for $l in collection('lineitem') let $f := $l=>l_returnflag group by $f return { flag: $f, n: count($l) }", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1"),
    "group_avg": ("for $l in collection('lineitem') let $f := $l=>l_returnflag group by $f return { flag: $f, q: round(100 * avg($l=>l_quantity)) }", "SELECT l_returnflag AS flag, round(100 * avg(l_quantity)) AS q FROM lineitem GROUP BY 1"),
    "group_minmax": (
        "for $l in collection('lineitem') let $s := $l=>l_suppkey group by $s return { s: $s, least: min($l=>l_extendedprice), most: max($l=>l_extendedprice) }",
        "SELECT l_suppkey AS s, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1",
    ),
    "group_multi_key": (
        "for $l in collection('lineitem') let $f := $l=>l_returnflag, $s := $l=>l_linestatus, $disc := $l=>l_extendedprice * (1 - $l=>l_discount) group by $f, $s return { f: $f, s: $s, qty: round(sum($l=>l_quantity)), net: round(sum($disc)), n: count($l) }",
        "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity)) AS qty, round(sum(l_extendedprice * (1 - l_discount))) AS net, count(*) AS n FROM lineitem GROUP BY 1, 2",
    ),
    "group_const": ("for $l in collection('lineitem') let $one := 1 group by $one return { n: count($l) }", "SELECT count(*) AS n FROM lineitem"),
    "group_keys_only": ("for $c in collection('customer') let $s := $c=>c_mktsegment group by $s return { s: $s }", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "group_twice": (
        "for $o in collection('orders') let $c := $o=>o_custkey group by $c let $n := count($o) group by $n return { orders: $n, customers: count($c) }",
        "SELECT n AS orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1",
    ),
    "having": (
        "for $l in collection('lineitem') let $k := $l=>l_orderkey group by $k let $n := count($l) where $n > 5 return { k: $k, n: $n }",
        "SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5",
    ),
    "multi_stage": (
        "for $l in collection('lineitem') let $d := $l=>l_shipdate group by $d let $sum_price := sum($l=>l_extendedprice) where $sum_price > 20000 order by $sum_price return { shipdate: $d, sum_price: round($sum_price) }",
        "SELECT l_shipdate AS shipdate, round(sum(l_extendedprice)) AS sum_price FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) > 20000",
    ),
    # joins
    "join_eq": (
        "for $l in collection('lineitem') for $o in collection('orders') where $l=>l_orderkey eq $o=>o_orderkey return { order: $o=>o_orderkey, item: $l=>l_linenumber }",
        'SELECT o_orderkey AS "order", l_linenumber AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey',
    ),
    "join_filter": (
        "for $l in collection('lineitem') for $o in collection('orders') where $l=>l_orderkey eq $o=>o_orderkey and $l=>l_shipdate gt '1994-12-31' and $o=>o_totalprice gt 70000.00 return { o: $o=>o_orderkey, l: $l=>l_linenumber }",
        "SELECT o_orderkey AS o, l_linenumber AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > TIMESTAMP '1994-12-31' AND o_totalprice > 70000.00",
    ),
    "join_small": (
        "for $s in collection('supplier'), $n in collection('nation'), $r in collection('region') where $s=>s_nationkey = $n=>n_nationkey and $n=>n_regionkey = $r=>r_regionkey return { s: $s=>s_name, n: $n=>n_name, r: $r=>r_name }",
        "SELECT s_name AS s, n_name AS n, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_composite": (
        "for $a in collection('lineitem'), $b in collection('lineitem') where $a=>l_orderkey = $b=>l_orderkey and $a=>l_suppkey = $b=>l_suppkey and $a=>l_linenumber < $b=>l_linenumber return { k: $a=>l_orderkey, a: $a=>l_linenumber, b: $b=>l_linenumber }",
        "SELECT a.l_orderkey AS k, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
    ),
    "join_expression_key": (
        "for $c in collection('customer'), $n in collection('nation') where $c=>c_nationkey + 1 = $n=>n_nationkey + 1 return { c: $c=>c_custkey, n: $n=>n_name }",
        "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey + 1 = n_nationkey + 1",
    ),
    "join3": (
        "for $c in collection('customer'), $o in collection('orders'), $l in collection('lineitem') where $c=>c_custkey = $o=>o_custkey and $l=>l_orderkey = $o=>o_orderkey and $c=>c_mktsegment = 'BUILDING' return { c: $c=>c_custkey, o: $o=>o_orderkey, l: $l=>l_linenumber }",
        "SELECT c_custkey AS c, o_orderkey AS o, l_linenumber AS l FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "join_query": (
        "let $big := (for $o in collection('orders') where $o=>o_totalprice > 200000 return { key: $o=>o_orderkey, c: $o=>o_custkey }) for $b in $big, $c in collection('customer') where $b=>c = $c=>c_custkey return { key: $b=>key, name: $c=>c_name }",
        "SELECT o_orderkey AS key, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000",
    ),
    "join_group_avg": (
        "for $l in collection('lineitem') for $o in collection('orders') where $l=>l_orderkey eq $o=>o_orderkey let $orderkey := $o=>o_orderkey group by $orderkey return { order: $orderkey, avg_price: round(avg($l=>l_extendedprice)) }",
        'SELECT o_orderkey AS "order", round(avg(l_extendedprice)) AS avg_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1',
    ),
    "join_group_order": (
        "for $l in collection('lineitem') for $o in collection('orders') where $l=>l_orderkey eq $o=>o_orderkey let $p := $o=>o_orderpriority group by $p let $avg := avg($l=>l_extendedprice) order by $avg return { priority: $p, avg_price: round($avg) }",
        "SELECT o_orderpriority AS priority, round(avg(l_extendedprice)) AS avg_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "tpch03": (
        "for $c in collection('customer'), $o in collection('orders'), $l in collection('lineitem') where $c=>c_custkey = $o=>o_custkey and $l=>l_orderkey = $o=>o_orderkey "
        "let $orderkey := $l=>l_orderkey, $orderdate := $o=>o_orderdate, $discounted := $l=>l_extendedprice * (1 + $l=>l_discount) group by $orderkey, $orderdate let $revenue := sum($discounted) order by $revenue "
        "return { order_key: $orderkey, revenue: round($revenue), order_date: $orderdate }",
        "SELECT l_orderkey AS order_key, round(sum(l_extendedprice * (1 + l_discount))) AS revenue, o_orderdate AS order_date FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderdate",
    ),
    "tpch03_filtered": (
        "for $c in collection('customer'), $o in collection('orders'), $l in collection('lineitem') where $c=>c_custkey = $o=>o_custkey and $l=>l_orderkey = $o=>o_orderkey and $c=>c_mktsegment = 'BUILDING' and $o=>o_orderdate < '1995-03-15' and $l=>l_shipdate > '1995-03-15' "
        "let $orderkey := $l=>l_orderkey, $orderdate := $o=>o_orderdate, $discounted := $l=>l_extendedprice * (1 - $l=>l_discount) group by $orderkey, $orderdate let $revenue := sum($discounted) order by $revenue descending "
        "return { order_key: $orderkey, revenue: round($revenue), order_date: $orderdate }",
        "SELECT l_orderkey AS order_key, round(sum(l_extendedprice * (1 - l_discount))) AS revenue, o_orderdate AS order_date FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey "
        "WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate",
    ),
    # global aggregates, ranges, nested queries
    "global_count": ("count(collection('lineitem'))", "SELECT count(*) AS value FROM lineitem"),
    "global_sum_expr": ("let $s := sum(for $l in collection('lineitem') return $l=>l_extendedprice * $l=>l_discount) return { s: round($s) }", "SELECT round(sum(l_extendedprice * l_discount)) AS s FROM lineitem"),
    "nested_count": ("let $n := count(for $o in collection('orders') where $o=>o_totalprice > 100000.0 return 1) return { n: $n, half: $n div 2 }", "SELECT count(*) AS n, count(*) / 2 AS half FROM orders WHERE o_totalprice > 100000.0"),
    "nested_avg_filter": (
        "let $avg := avg(for $c in collection('customer') return $c=>c_acctbal) for $c in collection('customer') where $c=>c_acctbal > $avg return { c: $c=>c_custkey }",
        "SELECT c_custkey AS c FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    ),
    "range_sum": ("sum(1 to 100000)", "SELECT CAST(sum(range) AS BIGINT) AS value FROM range(1, 100001)"),
    "range_filter_count": ("count(for $i in -50 to 50 where $i mod 7 = 0 return $i)", "SELECT count(*) AS value FROM range(-50, 51) t(i) WHERE i % 7 = 0"),
    "range_empty": ("for $i in 5 to 3 return $i", "SELECT range AS value FROM range(5, 4)"),
    "pi_montecarlo": ("let $inside := count(for $i in 1 to 1000000 let $x := bit:random(0, 1) let $y := bit:random(0, 1) where math:sqrt($x*$x + $y*$y) < 1.0 return 1) return { close: abs(4 * $inside div 1000000 - 3.14159) < 0.01 }", "SELECT true AS close"),
    "pi_grouped": ("for $i in 1 to 1000000 let $x := bit:random(0, 1) let $y := bit:random(0, 1) let $d := math:sqrt($x * $x + $y * $y) where $d < 1.0 let $one := 1 group by $one return { close: abs(4 * count($d) div 1000000 - 3.14159) < 0.01 }", "SELECT true AS close"),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the driver's tables declared."""
    found = Engine(spark)
    for t in TABLES:
        found.declare(t, "parquet", f"{sf_dir}/{t}.parquet")
    return found


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="skein-")
    return f"{found.rstrip('/')}/catalogue-{uuid.uuid4().hex}"


#: What the text files hold, and the query that writes them: the empty last field makes a delimiter after the last one.
_TEXT_TYPE = {"key": "xs:long", "cust": "xs:long", "price": "xs:double", "priority": "xs:string"}
_TO_TEXT = "for $o in collection('orders') return { key: $o=>o_orderkey, cust: $o=>o_custkey, price: $o=>o_totalprice, priority: $o=>o_orderpriority, end: '' }"

#: name -> (query over delimited text that the engine wrote, SQL). The prolog imports a schema file and declares the collection.
TEXT_QUERIES: dict[str, tuple[str, str]] = {
    "csv_scan": ("for $o in collection('sale') return $o", "SELECT o_orderkey AS key, o_custkey AS cust, o_totalprice AS price, o_orderpriority AS priority FROM orders"),
    "csv_filter_projection": ("for $o in collection('sale') where $o=>price > 100000.0 return { k: $o=>key }", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 100000.0"),
    "csv_group": ("for $o in collection('sale') let $p := $o=>priority group by $p return { priority: $p, n: count($o) }", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1"),
    "csv_join_option": (
        "declare option skein:broadcast-threshold '-1'; for $o in collection('sale'), $c in collection('customer') where $o=>cust = $c=>c_custkey return { k: $o=>key, name: $c=>c_name }",
        "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
}


def over_text(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The query over orders as the engine's sink wrote them, the second time in place of the first."""
    own, folder = engine(spark, sf_dir), _folder(spark)
    options = f"declare option skein:output-dir '{folder}'; declare option skein:delete-existing 'true'; "
    for _ in range(2):
        own.run(options + _TO_TEXT, "sale")
    spark.createDataFrame([(json.dumps([{"name": "sale", "schema": _TEXT_TYPE}]),)], "value string").coalesce(1).write.text(f"{folder}/types")
    prolog = f"import json schema namespace t=\"http://example.org\" at \"{folder}/types\"; declare %format('csv') %location('{folder}/sale') collection sale as object(t:sale); "
    return own.query(prolog + text)


#: name -> (query whose order counts, SQL with the same order in position).
ORDER_QUERIES: dict[str, tuple[str, str]] = {
    "order_position": (
        "for $c in collection('customer') order by $c=>c_acctbal descending, $c=>c_custkey return { c: $c=>c_custkey }",
        "SELECT c_custkey AS c, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer",
    ),
    "order_position_computed": (
        "for $l in collection('lineitem') order by $l=>l_orderkey mod 10, $l=>l_orderkey descending, $l=>l_linenumber return { k: $l=>l_orderkey, n: $l=>l_linenumber }",
        "SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (ORDER BY l_orderkey % 10, l_orderkey DESC, l_linenumber) AS position FROM lineitem",
    ),
}


def positioned(df: DataFrame) -> DataFrame:
    """df with the position of every row from 1, in the order that it has. Rows are written once, with partition and place."""
    spark = df.sparkSession
    path = _folder(spark)
    df.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    # A row for each partition: as many as the sort has, whatever they hold.
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(starts), "__part").select(*df.columns, place.alias("position"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(text: str):
        return lambda spark, sf_dir: engine(spark, sf_dir).query(text)

    def text_of(text: str):
        return lambda spark, sf_dir: over_text(spark, sf_dir, text)

    def order_of(text: str):
        return lambda spark, sf_dir: positioned(engine(spark, sf_dir).query(text))

    found = {name: of(text) for name, (text, _) in QUERIES.items()}
    found |= {name: text_of(text) for name, (text, _) in TEXT_QUERIES.items()}
    return found | {name: order_of(text) for name, (text, _) in ORDER_QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (QUERIES | TEXT_QUERIES | ORDER_QUERIES).items() if sql}
