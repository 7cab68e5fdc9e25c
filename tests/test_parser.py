from __future__ import annotations

import pytest

from relspark.errors import ParseError, Position
from relspark.sql import parse, tree
from relspark.sql.lexer import KEYWORDS, tokens


def shape(e) -> str:
    """An expression with all its parentheses."""
    match e:
        case tree.Literal():
            return repr(e.value)
        case tree.Reference():
            return f"{e.qualifier}.{e.name}" if e.qualifier else e.name
        case tree.Negation():
            return f"(NOT {shape(e.operand)})"
        case tree.Call():
            return f"{e.name}({'*' if e.star else ', '.join(map(shape, e.arguments))})"
    return f"({shape(e.left)} {e.operator} {shape(e.right)})"


def where(text: str) -> str:
    return shape(parse(f"SELECT a FROM t WHERE {text}").where)


def test_tokens_and_positions():
    found = tokens("SELECT a,\n  'it''s' -- note\n FROM t;")
    assert [(t.kind, t.text) for t in found] == [("keyword", "SELECT"), ("name", "a"), ("symbol", ","), ("string", "it's"), ("keyword", "FROM"), ("name", "t"), ("symbol", ";"), ("end", "")]
    assert found[3].position == Position(2, 3)
    assert found[4].position == Position(3, 2)
    assert len(KEYWORDS) == 23


@pytest.mark.parametrize(("text", "message"), [("SELECT 'open", "A string isn't closed at 1:8"), ("SELECT a ? b", "No token begins with '?' at 1:10"), ('SELECT "a" FROM t', "No token begins with")])
def test_lexer_errors(text, message):
    with pytest.raises(ParseError, match=message.replace("?", r"\?")):
        parse(text)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a + b * c - d", "((a + (b * c)) - d)"),
        ("a / b * c = 1", "(((a / b) * c) = 1)"),
        ("a = 1 OR b = 2 AND c = 3", "((a = 1) OR ((b = 2) AND (c = 3)))"),
        ("NOT a = 1 AND b", "((NOT (a = 1)) AND b)"),
        ("NOT NOT x OR y", "((NOT (NOT x)) OR y)"),
        ("(a OR b) AND t.c <> 'x'", "((a OR b) AND (t.c <> 'x'))"),
        ("a != TRUE", "(a <> True)"),
        ("a + 1 <= b - 2", "((a + 1) <= (b - 2))"),
        ("f(a, b + 1) > count(*)", "(f(a, (b + 1)) > count(*))"),
        ("a OR NOT b AND c", "(a OR ((NOT b) AND c))"),
    ],
)
def test_precedence(text, expected):
    assert where(text) == expected


def test_select_parts():
    q = parse("select u.id as x, count(*) n from users as u, orders o where u.id = o.user_id group by u.id, u.id + 1;")
    assert [(shape(i.expression), i.alias) for i in q.items] == [("u.id", "x"), ("count(*)", "n")]
    assert [(s.table, s.alias) for s in q.sources] == [("users", "u"), ("orders", "o")]
    assert [shape(g) for g in q.groups] == ["u.id", "(u.id + 1)"]
    assert parse("SELECT * FROM t").items is None


def test_ddl_and_insert():
    c = parse("CREATE TABLE t (id INT, name VARCHAR(10), f FLOAT, s STRING, b BOOLEAN, n BIGINT)")
    assert [(x.name, x.kind, x.length) for x in c.columns] == [("id", "INT", None), ("name", "VARCHAR", 10), ("f", "FLOAT", None), ("s", "STRING", None), ("b", "BOOLEAN", None), ("n", "BIGINT", None)]
    assert parse("DROP TABLE t;").table == "t"
    i = parse("INSERT INTO t (id, name) VALUES (1 + 2, 'a'), (2, '')")
    assert i.columns == ("id", "name")
    assert [[shape(v) for v in r] for r in i.rows] == [["(1 + 2)", "'a'"], ["2", "''"]]


@pytest.mark.parametrize(
    "text",
    [
        "UPDATE t SET a = 1", "SELECT *, a FROM t", "SELECT a FROM t ORDER BY a", "SELECT a FROM t LIMIT 1", "SELECT a FROM t HAVING a",
        "SELECT a FROM t JOIN u", "SELECT a FROM t WHERE -a = 1", "SELECT a FROM t WHERE a < b < c", "SELECT 1.5 FROM t", "SELECT a FROM t UNION SELECT a FROM t",
        "CREATE TABLE t ()", "CREATE TABLE t (a DOUBLE)", "CREATE TABLE t (a VARCHAR)", "CREATE TABLE t (a VARCHAR(0))", "INSERT INTO t VALUES ()",
        "SELECT a FROM t; SELECT b FROM t", "SELECT FROM t", "SELECT a", "", "SELECT a || b FROM t", "SELECT 99999999999999999999 FROM t", "SELECT a FROM select",
    ],
)
def test_rejected(text):
    with pytest.raises(ParseError, match=r"at \d+:\d+"):
        parse(text)
