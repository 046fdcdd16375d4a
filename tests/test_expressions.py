import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import values as V
from sluice.functions.compiler import Compiler
from sluice.functions.parser import ExpressionError, parse
from sluice.functions.registry import Function, Registry, conformance
from sluice.functions.values import Value

BODY = {"id": "o1", "amount": 1500, "status": "paid", "price": 100.0, "quantity": 5, "tax": 0.1, "active": True, "nothing": None, "items": [{"price": 5, "quantity": 3, "tag": "a"}, {"price": 10, "quantity": 2, "tag": "b"}], "customer": {"name": "Alexander Hamilton", "address": {"city": "NY"}}, "text": "  a  b "}
SCHEMA = "id string, amount bigint, status string, price double, quantity bigint, tax double, active boolean, nothing string, items array<struct<price:double,quantity:bigint,tag:string>>, customer struct<name:string,address:struct<city:string>>, text string"

CASES = [
    ("body.amount / 100", 15),
    ("body.amount > 1000 and body.status = 'paid'", True),
    ("body.amount > 2000 or body.active", True),
    ('{"order_id": body.id, "total": body.amount / 100}', {"order_id": "o1", "total": 15}),
    ("[body.id, body.amount, body.status]", ["o1", 1500, "paid"]),
    ('"Order " & body.id & " is " & body.status', "Order o1 is paid"),
    ('body.status = "paid" ? "processing" : "waiting"', "processing"),
    ("body.price * body.quantity * (1 + body.tax)", 550),
    ("body.nonexistent", None),
    ("body.nonexistent.deeper", None),
    ("$sum(body.items.(price * quantity))", 35),
    ("$count(body.items)", 2),
    ("$length(body.customer.name) > 10 ? 'long' : 'short'", "long"),
    ("body.customer.address.city", "NY"),
    ("body.items[0].price", 5),
    ("body.items[-1].price", 10),
    ("body.items[price > 6].tag", ["b"]),
    ("body.items.tag", ["a", "b"]),
    ("$map(body.items, function($i) { $i.price * 2 })", [10, 20]),
    ("$filter(body.items, function($i) { $i.quantity = 2 }).tag", ["b"]),
    ("$reduce(body.items.price, function($a, $b) { $a + $b }, 100)", 115),
    ("body.items^(>price).tag", ["b", "a"]),
    ("body.items{tag: $sum(price)}", {"a": 5, "b": 10}),
    ("[1..4]", [1, 2, 3, 4]),
    ("2 in [1, 2]", True),
    ("($x := 3; $y := $x * 2; $x + $y)", 9),
    ("body.text ~> $trim", "a b"),
    ("$uppercase(body.id) & '-' & $substring('hello', 1, 3)", "O1-ell"),
    ("$substring('hello', -3)", "llo"),
    ("$substringBefore('a=b', '=') & $substringAfter('a=b', '=')", "ab"),
    ("$substringBefore('ab', '=')", "ab"),
    ("$round(2.5) + $round(3.5)", 6),
    ("$round(123.456, 2)", 123.46),
    ("$average([1, 2, 3]) + $max([1, 5]) - $min([2, 3])", 5),
    ("$split('a.b.c', '.')", ["a", "b", "c"]),
    ("$split('a1b22c', /[0-9]+/)", ["a", "b", "c"]),
    ("$join(['a', 'b'], '-')", "a-b"),
    ("$replace('aXbX', 'X', '.', 1)", "a.bX"),
    ("$contains('abc', /B/i)", True),
    ("$match('a1b2', /[0-9]/).match", ["1", "2"]),
    ("$base64decode($base64encode('hé'))", "hé"),
    ("$decodeUrlComponent($encodeUrlComponent('a b&c'))", "a b&c"),
    ("$number('12.5') * 2", 25),
    ("$string(5) & $string(true)", "5true"),
    ("$boolean([]) or $boolean('')", False),
    ("$not(body.active)", False),
    ("$exists(body.id) and $not($exists(body.none))", True),
    ("$type(body.items) & $type(body.amount) & $type(body.customer)", "arraynumberobject"),
    ("$append([1], [2, 3])", [1, 2, 3]),
    ("$reverse($sort([3, 1, 2]))", [3, 2, 1]),
    ("$sort(['b', 'a'], function($l, $r) { $l > $r })", ["a", "b"]),
    ("$distinct([1, 1, 2])", [1, 2]),
    ("$keys(body.customer.address)", ["city"]),
    ("$lookup(body, 'id')", "o1"),
    ("$merge([{'a': 1}, {'a': 2}]).a", 2),
    ("$sift({'a': 1, 'b': 5}, function($v) { $v > 2 })", {"b": 5}),
    ("$each({'a': 1}, function($v, $k) { $k & $v })", ["a1"]),
    ("$zip([1, 2], [3, 4])", [[1, 3], [2, 4]]),
    ("$single([7])", 7),
    ("$power(2, 3) + $sqrt(9) + $abs(-1) + $floor(1.7) + $ceil(1.2)", 15),
    ("$formatBase(255, 16)", "ff"),
    ("$pad('a', 3, '#') & $pad('a', -3)", "a##  a"),
    ("$toMillis('1970-01-01T00:00:01Z')", 1000),
    ("$fromMillis(0)", "1970-01-01T00:00:00.000Z"),
    ("body.nothing = null", True),
    ("body.id != null", True),
    ("body.amount % 7", 2),
    ("1 / 0", None),
    ("-body.amount", -1500),
    ("headers.\"content-type\"", "json"),
    ("$$.body.id", "o1"),
    ("body.customer.*", None),
    ("function($x) { $x + 1 }(4)", 5),
    ("$formatNumber(1234.5, '#,##0.00')", "1,234.50"),
]


def run(spark, expr, variant):
    df = spark.range(1).select(F.lit(json.dumps(BODY)).alias("j"), F.create_map(F.lit("content-type"), F.lit("json")).alias("headers"))
    df = df.select("headers", (F.parse_json("j") if variant else F.from_json("j", SCHEMA)).alias("body"))
    kinds = {f.name: f.dataType for f in df.schema}
    v = Compiler({c: Value(F.col(c), kinds[c]) for c in ("body", "headers")}).compile(expr)
    out = df.select(V.json(v)).first()[0]
    return json.loads(out) if out is not None else None


@pytest.mark.parametrize("expr,want", [c for c in CASES if c[0] != "body.customer.*"])
def test_struct_body(spark, expr, want):
    got = run(spark, expr, False)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


SAME_ON_VARIANT = [
    c for c in CASES
    if not any(x in c[0] for x in ("body.items{", "body.items^", "$type(body.items)", "$keys(body", "body.customer.*", "$$.body", "[body.id,"))
]


@pytest.mark.parametrize("expr,want", SAME_ON_VARIANT)
def test_variant_body(spark, expr, want):
    got = run(spark, expr, True)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("expr", ["", "body.", "(1", "1 +", "{'a' 1}", "$x := ", "$ -> 1", "a[1", "'open"])
def test_syntax_errors(expr):
    with pytest.raises(ExpressionError):
        parse(expr)


@pytest.mark.parametrize("expr", ["$nosuch(1)", "$x", "%", "{'a': 1, 'a': 2}", "body.id(1)"])
def test_compile_errors(spark, expr):
    with pytest.raises(ExpressionError):
        run(spark, expr, False)


@pytest.mark.parametrize("expr,want", [("1", True), ("0", False), ("'hello'", True), ("''", False), ("true", True), ("false", False), ("null", False), ("[]", True), ("{}", True), ("body.nope", False)])
def test_truthiness(spark, expr, want):
    df = spark.range(1).select(F.lit(1).alias("body"))
    v = Compiler({"body": Value(F.struct(F.lit(1).alias("a")), df.select(F.struct(F.lit(1).alias("a"))).schema[0].dataType)}).compile(expr)
    assert df.select(V.truthy(v)).first()[0] is want


def test_text_of_results(spark):
    c = Compiler({})
    for expr, want in (("15", "15"), ("1.5", "1.500000"), ("3.0", "3"), ("true", "true"), ("'x'", "x"), ("null", "null")):
        assert spark.range(1).select(V.go_text(c.compile(expr))).first()[0] == want


def test_registry(spark):
    r = Registry()
    r.register(Function("twice", ("double",), "double", lambda x: x * 2))
    with pytest.raises(ValueError):
        r.register(Function("twice", ("double",), "double", lambda x: x))
    with pytest.raises(ValueError):
        r.register(Function("", (), "double", lambda: None))
    assert len(r) == 1 and r.lookup("nope") is None
    assert all(conformance(spark, r.lookup("twice"), [(1.0,), (2.0,)], [2.0, 4.0]).values())
