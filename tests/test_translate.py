import pytest

from tidemark.plans.language import parse
from tidemark.plans.translate import SQLSTATES, Translator, translate

# fixed cases: the first eight of OK and the first ten of BAD must give just these results
OK = [
    ("SELECT 1", "select 1"),
    ("SELECT 1;", "select 1"),
    ("INSERT INTO users(id) VALUES (1)", "insert into users (id) values (1)"),
    ("SELECT id, name FROM users", "select id,name from users"),
    ("SELECT name FROM users WHERE id = 42", "select name from users where id = 42"),
    ("select * from accounts", "select * from accounts"),
    ("DELETE FROM users WHERE id = 42", "delete from users where id = 42"),
    ("DELETE FROM sessions", "delete from sessions"),
    ("  SELECT  a ,  max(b, c)\nFROM t GROUP BY a ORDER BY a ; ", "select a,max(b, c) from t GROUP BY a ORDER BY a"),
    ("INSERT INTO t VALUES (1, 'a;b')", "insert into t values (1, 'a;b')"),
    ("SELECT a FROM t WHERE b <> 'x''y' AND c::int > 1", "select a from t where b <> 'x''y' AND c::int > 1"),
]
BAD = [
    "UPDATE users SET name = 'rex' WHERE id = 1",
    "UPDATE accounts SET balance = balance + 1",
    "UPDATE users SET",
    "INSERT INTO users (id) VALUES (2) RETURNING id",
    "INSERT INTO users (id) VALUES (3) RETURNING",
    "UPDATE users SET name = 'rex' WHERE id = 1 RETURNING id",
    "UPDATE users SET name = 'rex' RETURNING",
    "DELETE FROM users WHERE",
    "DELETE FROM users WHERE id = 5 RETURNING id",
    "DELETE FROM users RETURNING",
    "",
    "SELECT",
    "SELECT a",
    "CREATE TABLE t (a int)",
    "INSERT INTO t (a VALUES (1)",
    "SELECT 'open FROM t",
]


@pytest.mark.parametrize(("sql", "text"), OK)
def test_translates(sql, text):
    assert translate(sql).text == text


@pytest.mark.parametrize("sql", BAD)
def test_not_supported(sql):
    made = translate(sql)
    assert (made.ok, made.sqlstate, made.message) == (False, "0A000", "feature not supported")


def test_translations_parse():
    for sql, text in OK[:8]:
        parse(translate(sql).text)
        assert translate(sql).text == text


def test_counters():
    t = Translator(sample=1)
    for sql in ("SELECT 1", "SELECT 1", "UPDATE x"):
        t.translate(sql)
    assert (t.counters.translations, t.counters.fallbacks, t.counters.cache_hits) == (2, 1, 1)
    assert len(SQLSTATES) == 14
