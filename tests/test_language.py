import pytest

from tidemark.functions.registry import FUNCTIONS, ArgumentError, result_type
from tidemark.plans.checks import check
from tidemark.plans.language import Binary, Call, Delete, Explain, Insert, LanguageError, Literal, Name, Select, Unary, parse, tokens, walk


def codes(text):
    return [d.code for d in check(parse(text))]


def test_select_shape():
    s = parse("select tag.host as site, value v from metrics where time > 1 order by site desc, v limit 10 offset 2;")
    assert isinstance(s, Select)
    assert [i.alias for i in s.items] == ["site", "v"]
    assert s.items[0].expr == Name(("tag", "host"))
    assert (s.limit, s.offset) == (10, 2)
    assert [o.descending for o in s.order] == [True, False]


def test_group_fill_order():
    s = parse("select avg(value) from metrics where time >= 0 group by time_bucket(300, time) fill(previous) order by time desc")
    assert s.fill.kind == "previous"
    assert s.group == (Call("time_bucket", (Literal(300), Name(("time",)))),)
    assert parse("select avg(value) from m where time>0 group by time_bucket(1m, time) fill(-1)").fill.value == Unary("-", Literal(1))


def test_not_binds_tighter_than_comparison():
    assert parse("select not value > 5").items[0].expr == Binary(">", Unary("not", Name(("value",))), Literal(5))


def test_precedence():
    assert parse("select 1 + 2 * 3").items[0].expr == Binary("+", Literal(1), Binary("*", Literal(2), Literal(3)))
    e = parse("select a || b && c = d < e").items[0].expr
    assert e.op == "or" and e.right.op == "and" and e.right.right.op == "=" and e.right.right.right.op == "<"


def test_literals_and_comments():
    s = parse("select 1, 1.5, 1e3, 'it''s', true, null, 5m, \"odd name\" -- tail\n /* and\nmore */")
    assert [i.expr for i in s.items] == [Literal(1), Literal(1.5), Literal(1000.0), Literal("it's"), Literal(True), Literal(None), Literal(300), Name(("odd name",))]


def test_other_statements():
    assert parse("insert into metrics values (now(), 42, 'ok')") == Insert("metrics", (), (Call("now", ()), Literal(42), Literal("ok")))
    assert parse("delete from metrics where value > 10") == Delete("metrics", Binary(">", Name(("value",)), Literal(10)))
    assert isinstance(parse("explain select 1"), Explain)
    assert parse("select value from by_id(42) where time > 0").selector.series_id == 42


@pytest.mark.parametrize("text", ["", "select", "select 1 +", "select 'open", "select * where", "select a from b limit x", "insert into a values", "select 1 extra words", "select £"])
def test_broken(text):
    with pytest.raises(LanguageError):
        parse(text)


def test_tokens_keep_places():
    assert [(t.text, t.start) for t in tokens("a >= 1")] == [("a", 0), (">=", 2), ("1", 5)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select value from metrics", ["time_range_required"]),
        ("select value from metrics where value > 1", ["time_range_required"]),
        ("select value from metrics where time >= 10 and time < 20", []),
        ("select foo(value) from metrics where time > 0", ["invalid_syntax"]),
        ("select 1", []),
        ("delete from metrics where value > 10", ["time_range_required"]),
        ("delete from metrics", ["time_range_required"]),
        ("delete from metrics where time > 10", []),
        ("explain select value from metrics", ["time_range_required"]),
        ("select avg(value) from metrics where time >= 0 group by time_bucket(300, time) fill(linear)", []),
        ("select avg(value) from metrics where time >= 0 fill(null)", ["unsupported_fill_policy"]),
        ("select percentile(value, 1) from metrics where time >= 0", ["invalid_function_arity"]),
        ("select rate(true) from metrics where time >= 0", ["invalid_function_arity"]),
        ("select value from metrics where time > 0 and avg(value) > 1", ["invalid_syntax"]),
        ("select value from metrics where time > 0 and not value > 5", ["invalid_function_arity"]),
        ("select value from metrics where time > 0 and (1 < 2) + 1 > 5", ["invalid_function_arity"]),
    ],
)
def test_checks(text, want):
    assert codes(text) == want


def test_function_types():
    assert len(FUNCTIONS) == 27
    assert result_type("avg", ["value"]) == "float"
    assert result_type("min", ["integer"]) == "integer"
    assert result_type("count", []) == "integer"
    assert result_type("time_bucket", ["integer", "timestamp"]) == result_type("time_bucket", ["integer", "timestamp", "integer"]) == "timestamp"
    assert result_type("lag", ["value"]) == result_type("lag", ["value", "integer"]) == "value"
    assert result_type("coalesce", ["string", "null", "string"]) == "string"
    for name, types in (("percentile", ["value"]), ("percentile", ["value", "integer"]), ("rate", ["boolean"]), ("time_bucket", ["integer"]), ("coalesce", [])):
        with pytest.raises(ArgumentError):
            result_type(name, types)


def test_times_durations_and_patterns():
    s = parse("select 1h30m from 'ns.metric' where time >= 2024-03-01T00:00:00Z and time < 2024-03-01T01:00:00+01:00 and tag.env =~ /prod|st\\/aging/")
    assert s.items[0].expr == Literal(5400) and s.selector.name == "ns.metric"
    found = [e.value for e in walk(s.where) if isinstance(e, Literal)]
    assert found == [1709251200, 1709251200, "prod|st/aging"]
    assert parse("select 8 / 2 / 2").items[0].expr == Binary("/", Binary("/", Literal(8), Literal(2)), Literal(2))
