import json
import math
import warnings
from decimal import Decimal

import pytest

from skein.cli import main
from skein.engine import Engine, Settings
from skein.errors import AnalysisProblem
from skein.flwor import call, collection, for_, lit, record, var
from skein.plans.lower import UnknownField

TYPES = [
    {"name": "item", "schema": {"key": "xs:int", "line": "xs:int", "price": "xs:decimal", "off": "xs:decimal", "day": "xs:string"}},
    {"name": "sale", "schema": {"key": "xs:int", "buyer": "xs:int", "total": "xs:decimal"}},
]
ITEMS = [(1, 1, "10.00", "0.10", "1996-03-13"), (1, 2, "20.50", "0.00", "1996-04-12"), (2, 1, "5.25", "0.05", "1996-03-01"), (3, 1, "7.00", "0.00", "1997-01-30"), (None, 1, "1.00", "0.00", "1997-01-30")]
SALES = [(1, 100, "50.00"), (2, 101, "70.00"), (2, 102, "80.00"), (4, 100, "1.00"), (None, 100, "2.00")]


@pytest.fixture(scope="module")
def prolog(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    (d / "types.json").write_text(json.dumps(TYPES))
    for name, rows in (("item", ITEMS), ("sale", SALES)):
        lines = ["|".join("" if x is None else str(x) for x in r) + "|" for r in rows]
        (d / f"{name}.tbl").write_text("\n".join(lines))
    return f"import json schema namespace t=\"http://example.org\" at \"{d}/types.json\"; " + "".join(f"declare %format('csv') %location('{d}/{n}.tbl') collection {n} as object(t:{n}); " for n in ("item", "sale"))


@pytest.fixture
def rows(spark, prolog):
    return lambda text: [tuple(r) for r in Engine(spark).query(prolog + text).collect()]


def by(rows):
    return sorted(rows, key=repr)


def test_scan_with_trailing_delimiter(spark, prolog):
    df = Engine(spark).query(prolog + "for $i in collection('item') return $i")
    assert df.columns == ["key", "line", "price", "off", "day"] and df.count() == 5
    assert df.schema["price"].dataType.simpleString() == "decimal(15,2)"


def test_filters(rows):
    assert rows("for $i in collection('item') where $i=>key > 1 and $i=>key < 3 return { k: $i=>key }") == [(2,)]
    assert len(rows("for $i in collection('item') where $i=>day gt '1996-12-31' return $i")) == 2
    assert rows("for $i in collection('item') where $i=>key < 0 let $d := $i=>day group by $d order by $d return { d: $d, n: count($i) }") == []


def test_unknown_field_is_empty_and_an_error_when_strict(spark, prolog):
    text = prolog + "for $s in collection('sale') where $s=>shipdate > '1998-01-01' return $s"
    with pytest.warns(UnknownField):
        assert Engine(spark).query(text).count() == 0
    with pytest.raises(AnalysisProblem, match="shipdate"):
        Engine(spark, Settings(strict=True)).query(text)


def test_null_keys_group_but_do_not_join(rows):
    assert (None, 1) in rows("for $i in collection('item') let $k := $i=>key group by $k return { k: $k, n: count($i) }")
    joined = rows("for $i in collection('item'), $s in collection('sale') where $i=>key = $s=>key return { i: $i=>line, s: $s=>buyer }")
    assert by(joined) == [(1, 100), (1, 101), (1, 102), (2, 100)]


def test_join_sides_can_be_swapped(rows):
    a = rows("for $i in collection('item'), $s in collection('sale') where $i=>key = $s=>key return { k: $i=>key, b: $s=>buyer }")
    b = rows("for $s in collection('sale'), $i in collection('item') where $s=>key eq $i=>key return { k: $i=>key, b: $s=>buyer }")
    assert by(a) == by(b) and len(a) == 4


def test_duplicate_keys_on_both_sides(spark):
    e = Engine(spark)
    e.declare_frame("a", spark.createDataFrame([(1, x) for x in range(2)], "k int, x int"))
    e.declare_frame("b", spark.createDataFrame([(1, y) for y in range(3)], "k int, y int"))
    assert e.query("for $a in collection('a'), $b in collection('b') where $a=>k = $b=>k return { x: $a=>x, y: $b=>y }").count() == 6


def test_aggregates(rows):
    got = rows("for $i in collection('item') let $m := substring($i=>day, 1, 7) group by $m order by $m return { m: $m, s: sum($i=>price), a: avg($i=>price), n: count($i), lo: min($i=>price), hi: max($i=>price) }")
    assert got[0] == ("1996-03", Decimal("15.25"), Decimal("7.625000"), 2, Decimal("5.25"), Decimal("10.00"))
    assert all(abs(r[2] * r[3] - r[1]) < Decimal("0.001") for r in got)


def test_aggregates_are_lifted_and_others_gathered(spark, prolog):
    plan = Engine(spark).explain(prolog + "for $i in collection('item') let $d := $i=>day group by $d return { d: $d, s: sum($i=>price) }")
    assert "collect_list" not in plan and "partial_sum" in plan
    df = Engine(spark).query(prolog + "for $i in collection('item') let $d := $i=>day group by $d return $i")
    assert sorted(len(r[0]) for r in df.collect()) == [1, 1, 1, 2]


def test_pruned_scan_and_pushed_filter(spark, prolog):
    plan = Engine(spark).explain(prolog + "for $i in collection('item') where $i=>key > 1 return { p: $i=>price }")
    assert "ReadSchema: struct<key:int,price:decimal(15,2)>" in plan and "GreaterThan(key,1)" in plan


def test_having_and_second_group(rows):
    assert rows("for $s in collection('sale') let $b := $s=>buyer group by $b let $t := sum($s=>total) where $t > 60 order by $t return { b: $b, t: $t }") == [(101, Decimal("70.00")), (102, Decimal("80.00"))]
    assert by(rows("for $s in collection('sale') let $b := $s=>buyer group by $b let $n := count($s) group by $n return { n: $n, m: count($b) }")) == [(1, 2), (3, 1)]


def test_order_modifiers(rows):
    keys = lambda how: [r[0] for r in rows(f"for $s in collection('sale') order by $s=>key {how}, $s=>buyer return {{ k: $s=>key }}")]
    assert keys("") == [None, 1, 2, 2, 4]
    assert keys("empty greatest") == [1, 2, 2, 4, None]
    assert keys("descending") == [4, 2, 2, 1, None]
    assert keys("descending empty greatest") == [None, 4, 2, 2, 1]


@pytest.mark.parametrize(("text", "expected"), [("1 to 7", list(range(1, 8))), ("5 to 3", []), ("-2 to 2", [-2, -1, 0, 1, 2]), ("3000000000 to 3000000001", [3000000000, 3000000001])])
def test_ranges(spark, text, expected):
    assert [r[0] for r in Engine(spark).query(f"for $i in {text} return $i").collect()] == expected


def test_partition_count_does_not_matter(spark):
    found = {n: Engine(spark, Settings(range_partitions=n)).query("sum(for $i in 1 to 1000 where $i mod 3 = 0 return $i)").head()[0] for n in (1, 2, 7)}
    assert set(found.values()) == {sum(range(0, 1001, 3))}


@pytest.mark.parametrize(
    ("expr", "expected"),
    [
        ("substring('1996-03-13', 0, 7)", "1996-0"), ("substring('abc', 2)", "bc"), ("substring('abc', -1, 3)", "a"), ("substring('abc', 5, 2)", ""),
        ("7 idiv 2", 3), ("-7 idiv 2", -3), ("7 mod 4", 3), ("1 div 4", 0.25), ("if (1 < 2) then 'y' else 'n'", "y"),
        ("'12' cast as xs:int", 12), ("sum(())", 0), ("count((1, 2, ()))", 2), ("avg((1, 2))", 1.5), ("(1, 2) = (2, 3)", True), ("(1, 2) = 5", False),
        ("concat('a', (), 1)", "a1"), ("empty(())", True), ("exists((1, 2))", True), ("sum(1 to 4)", 10), ("max((3, 9, 4))", 9), ("math:sqrt(16)", 4.0), ("not(1 = 1)", False),
        ("not('x')", False), ("not('')", True), ("not(())", True), ("not(0)", True), ("not((1, 2))", False), ("substring('12345', 1.5, 2.6)", "234"),
        ("round(-2.5)", -2), ("round(2.5)", 3), ("round(-2.6)", -3), ("exists(for $i in 1 to 3 where $i > 2 return $i)", True), ("empty(for $i in 1 to 3 where $i > 3 return $i)", True),
    ],
)
def test_expressions(spark, expr, expected):
    assert Engine(spark).query(expr).head()[0] == expected


def test_nested_queries(rows):
    assert rows("let $n := count(for $i in collection('item') return 1) return 2 * $n") == [(10,)]
    assert rows("count(collection('sale'))") == [(5,)]
    assert by(rows("let $all := collection('sale') for $s in $all where $s=>total = max($all=>total) return { b: $s=>buyer, n: count($all) }")) == [(102, 5)]
    assert by(rows("for $b in (for $s in collection('sale') where $s=>total > 60 return { b: $s=>buyer }) return $b")) == [(101,), (102,)]


def test_monte_carlo(spark):
    pi = Engine(spark).query("let $c := count(for $i in 1 to 1000000 let $x := bit:random(0,1) let $y := bit:random(0,1) where math:sqrt($x*$x + $y*$y) < 1.0 return $i) return 4 * $c div 1000000").head()[0]
    assert math.isclose(pi, math.pi, abs_tol=0.01)


def test_declared_functions(spark):
    q = Engine(spark).query
    assert [r[0] for r in q("declare function local:f($x) { $x + 1 }; declare function local:g($x) { local:f(local:f($x)) }; for $x in 1 to 2 return local:g($x)").collect()] == [3, 4]
    assert q("declare function local:n($a) { count(for $x in 1 to 3 where $x > 1 return $x) + $a }; for $x in 5 to 5 return local:n($x)").head()[0] == 7
    with pytest.raises(AnalysisProblem, match="itself"):
        q("declare function local:f($x) { local:f($x) }; local:f(1)")


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("for $x in collection('nowhere') return $x", "no collection"), ("$y", "unknown variable"), ("for $s in collection('sale') where $s=>key = 'a' return $s", "compares"),
        ("for $s in collection('sale') let $m := (1, 2) group by $m return $m", "single item"), ("nope(1)", "unknown function"), ("substring('a')", "arguments"), ("(1, 2) eq 1", "single items"),
        ("for $s in collection('sale') let $n := count(for $i in collection('item') where $i=>key = $s=>key return $i) return $n", "not supported"), ("declare %format('hbase') %location('x') collection h as item()*; for $x in collection('h') return $x", "client"),
        ("declare option nope 'x'; 1", "unknown option"),
    ],
)
def test_analysis_errors(rows, text, says):
    with pytest.raises(AnalysisProblem, match=says):
        rows(text)


def test_host_functions(spark):
    e = Engine(spark)
    e.register("my:inc", lambda c: c + 1, 1)
    assert e.query("my:inc(41)").head()[0] == 42


def test_builder_makes_the_same_result(spark, prolog, rows):
    i = var("i")
    tree = for_("i", collection("item")).let(d=i.day, net=i.price * (1 - i.off)).group_by("d").let(s=call("sum", var("net"))).where(var("s") > lit(1)).order_by(var("s"), descending=True).return_(record(d=var("d"), s=var("s")))
    from skein.lang.parser import parse

    text = "for $i in collection('item') let $d := $i=>day, $net := $i=>price * (1 - $i=>off) group by $d let $s := sum($net) where $s > 1 order by $s descending return { d: $d, s: $s }"
    assert tree == parse(text).body and len(rows(text)) == 4


def test_sink_and_cli(spark, prolog, tmp_path, capsys):
    e = Engine(spark, Settings(output_dir=str(tmp_path)))
    text = prolog + "for $s in collection('sale') where $s=>key = 2 return { b: $s=>buyer, t: $s=>total }"
    out = e.run(text, "two")
    assert sorted(spark.read.text(out).toPandas()["value"]) == ["101|70.00", "102|80.00"]
    with pytest.raises(Exception, match="(?i)exist"):
        e.run(text, "two")
    e.run("declare option skein:delete-existing 'true'; " + "{ a: 1, b: (1, 2) }", "two")
    assert list(spark.read.text(out).toPandas()["value"]) == ['{"a":1,"b":[1,2]}']
    assert main([], spark) == 2
    query = tmp_path / "q.xq"
    query.write_text("for $i in 1 to 2\nreturn $i")
    assert main([str(query)], spark) == 0 and "|1" in capsys.readouterr().out
    config = tmp_path / "c.properties"
    config.write_text("output-dir = " + str(tmp_path / "c") + "\ndelimiter = ,  # comma\n")
    assert main(["--config", str(config), "{ a: 1, b: 2 }"], spark) == 0
    assert spark.read.text(str(tmp_path / "c/result")).head()[0] == "1,2"


def test_empty_input(spark):
    e = Engine(spark)
    e.declare_frame("none", spark.createDataFrame([], "k int, v double"))
    with warnings.catch_warnings():
        assert e.query("for $x in collection('none') let $k := $x=>k group by $k order by $k return { k: $k, s: sum($x=>v) }").collect() == []
    assert tuple(e.query("let $s := sum(collection('none')=>v), $a := avg(collection('none')=>v) return { s: $s, a: $a }").head()) == (0.0, None)


def test_options_hold_for_their_query_alone(spark, prolog):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    join = "for $i in collection('item'), $s in collection('sale') where $i=>key = $s=>key return { k: $i=>key }"
    engine = Engine(spark)
    plain, sorted_ = engine.query(prolog + join), engine.query("declare option skein:broadcast-threshold '-1'; " + prolog + join)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(sorted_) and "BroadcastHashJoin" in plan(plain)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert sorted(map(tuple, sorted_.collect())) == sorted(map(tuple, plain.collect()))
