"""Objectives: what is accepted, and that values equal those of the SQL dialect users write."""

import math

import pytest
from pyspark.sql import functions as F

from larder.functions.objective import ObjectiveError, check_objective, check_syntax, compile_objective, is_random

COLUMNS = "x DOUBLE, y DOUBLE, n INTEGER, k INTEGER"
ROWS = [(0.5, 2.0, 4, 3), (-0.25, 1.5, 1, 6), (0.0, -2.5, 3, 2), (2.675, 7.5, 0, 5), (0.99, 3.0, 5, 4)]

SAME_AS_SQL = [
    "x + y", "x - y", "x * y", "x / y", "x / 0", "x // y", "n // k", "-n // k", "n % k", "x ** 2", "x ^ 2", "2 ^ n",
    "n & k", "n | k", "n << k", "n >> 1", "~n", "n!", "(n + 1)! * 2", "@(x)", "@(x - y)", "abs(x)", "acos(x)",
    "acosh(y)", "add(x, y)", "asin(x)", "asinh(x)", "atan(x)", "atanh(x)", "x % y", "atan2(y, x)", "bit_count(n)", "cbrt(x)",
    "ceil(x)", "ceiling(y)", "cos(x)", "cot(y)", "degrees(pi())", "divide(n, k)", "divide(x, y)", "even(x)", "even(y)",
    "exp(x)", "factorial(n)", "fdiv(x, y)", "fdiv(n, k)", "floor(x)", "fmod(x, y)", "fmod(n, k)", "gamma(y)",
    "gcd(n, k)", "greatest_common_divisor(n, k)", "greatest(x, y, n)", "isfinite(x)", "isinf(x)", "isnan(x)",
    "lcm(n, k)", "least_common_multiple(n, k)", "least(x, y, n)", "lgamma(y)", "ln(x)", "log(x)", "log10(y)", "log2(y)",
    "multiply(x, y)", "nextafter(x, y)", "pi()", "pow(x, y)", "power(y, 2)", "radians(x)", "round_even(x, 0)",
    "round(x, 2)", "sign(x)", "signbit(x)", "sin(x)", "sqrt(x)", "subtract(x, y)", "tan(x)", "trunc(y)", "trunc(x)",
    "xor(n, k)", "round(  2.71828  , 3   )", "(sin(x) + cos(y)) / 2", "sqrt(pow(x,2) + pow(y,2))",
    "3.14159e0 * y ** 2", "/* a comment */ exp(2)", "(-x) ^ 2", "-(x ^ 2)", "1e-6", "27", "-1", "2 * n! + 1",
    "(n | k) & 3", "1 << 2 + n", "x\n + y",
]


# The objectives that have to be accepted, and those that have to be refused.
CORPUS_ACCEPTED = [
    "x",
    "27",
    "3.14",
    "-1",
    "1e-6",
    "x + y",
    "x - y",
    "x * y",
    "x / y",
    "x // y",
    "x % y",
    "x ** y",
    "x ^ y",
    "x & y",
    "x | y",
    "x << y",
    "x >> y",
    "~x",
    "n!",
    "@(x)",
    "abs(x)",
    "acos(x)",
    "acosh(x)",
    "add(x,y)",
    "asin(x)",
    "asinh(x)",
    "atan(x)",
    "atanh(x)",
    "atan2(y,x)",
    "bit_count(x)",
    "cbrt(x)",
    "ceil(x)",
    "ceiling(x)",
    "cos(x)",
    "cot(x)",
    "degrees(pi())",
    "divide(x,y)",
    "even(x)",
    "exp(x)",
    "factorial(n)",
    "fdiv(x,y)",
    "floor(x)",
    "fmod(x,y)",
    "gamma(x)",
    "gcd(x,y)",
    "greatest_common_divisor(x,y)",
    "greatest(x1,x2,x3)",
    "isfinite(x)",
    "isinf(x)",
    "isnan(x)",
    "lcm(x,y)",
    "least_common_multiple(x,y)",
    "least(x1,x2,x3)",
    "lgamma(x)",
    "ln(x)",
    "log(x)",
    "log10(x)",
    "log2(x)",
    "multiply(x,y)",
    "nextafter(x,y)",
    "pi()",
    "pow(x,y)",
    "power(x,y)",
    "radians(x)",
    "random()",
    "round_even(x,0)",
    "round(x,2)",
    "setseed(x)",
    "sign(x)",
    "signbit(x)",
    "sin(x)",
    "sqrt(x)",
    "subtract(x,y)",
    "tan(x)",
    "trunc(x)",
    "xor(x,y)",
    "round(  2.71828  , 3   )",
    "(sin(x) + cos(y)) / 2",
    "sqrt(pow(x,2) + pow(y,2))",
    "3.14159e0 * r ** 2",
    "/* block-comment */ exp(2)",
]
CORPUS_REFUSED = [
    "sin(1); drop table users;",
    "select 1",
    "drop table users;",
    "insert into table values (1,2,3)",
    "update table set column = value",
    "delete from table where condition",
    "create table new_table (id int,name string)",
    "alter table existing_table add column new_column int",
    "drop index idx_name",
    "select * from secrets where 1",
    "grant all privileges on db.* to 'evil'@'%'",
    "exec master..xp_cmdshell 'dir'",
    "system('shutdown -h now')",
    "drop database prod; commit;",
    "union select password from users",
    "sqrt(16",
]


@pytest.mark.parametrize("text", SAME_AS_SQL)
def test_syntax_accepted(text):
    assert check_syntax(text) == (True, "Valid objective.")


def test_values_equal_sql(spark, duck):
    duck.execute(f"CREATE TABLE t (i INTEGER, {COLUMNS})")
    rows = [(i, *row) for i, row in enumerate(ROWS)]
    duck.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "i int, x double, y double, n int, k int")
    ours = df.select(
        "i", *[compile_objective(t, df.schema).cast("double").alias(f"c{i}") for i, t in enumerate(SAME_AS_SQL)]
    )
    got = {r.i: r for r in ours.collect()}
    wrong = []
    for c, text in enumerate(SAME_AS_SQL):
        for i, want in duck.execute(f"SELECT i, CAST(({text}) AS DOUBLE) FROM t").fetchall():
            have = got[i][f"c{c}"]
            same = have == want or (
                None not in (have, want)
                and ((math.isnan(have) and math.isnan(want)) or math.isclose(have, want, rel_tol=1e-12, abs_tol=1e-15))
            )
            if not same:
                wrong.append((text, rows[i], want, have))
    assert not wrong


@pytest.mark.parametrize("text", CORPUS_ACCEPTED)
def test_corpus_accepted(text):
    assert check_syntax(text) == (True, "Valid objective.")


@pytest.mark.parametrize(
    "text",
    [
        *CORPUS_REFUSED, "x.y", "[x]", "x if y else n", "not x", "(x, y)", "lambda: 1", "__import__(x)", "f(x)", "sqrt(x, y)", "x = 1",
        "", "x and y", "1j", "*x", "x!!y", "@", "!x", "pi(*x)",
    ],
)
def test_syntax_refused(text):
    assert not check_syntax(text)[0]


@pytest.mark.parametrize("text", ["-x ^ 2", "2 ^ 3 ^ 2", "~n + 1", "@x + 1", "n & k | 1", "n << k & 1"])
def test_ambiguous_grouping_is_refused(text):
    """SQL groups these differently from common notation; no silent choice is made."""
    valid, message = check_syntax(text)
    assert not valid and "parentheses" in message


def test_result_has_to_be_floating(spark):
    df = spark.createDataFrame(ROWS, "x double, y double, n int, k int")
    assert check_objective("x + n", df)[0]
    assert check_objective("3.14", df)[0]
    assert not check_objective("27", df)[0]
    assert not check_objective("n + k", df)[0]
    assert not check_objective("isnan(x)", df)[0]
    assert check_objective("z + 1", df) == (False, "Variable 'z' not found.")
    assert not check_objective("x & y", df)[0]


def test_random_is_flagged(spark):
    assert is_random("x * random()") and not is_random("x * 2")
    df = spark.range(5).select(F.lit(1.0).alias("x"))
    assert all(0 <= r[0] < 1 for r in df.select(compile_objective("random()", df.schema)).collect())
    assert all(r[0] is None for r in df.select(compile_objective("setseed(x)", df.schema)).collect())


def test_round_needs_constant_digits(spark):
    df = spark.createDataFrame(ROWS, "x double, y double, n int, k int")
    with pytest.raises(ObjectiveError):
        compile_objective("round(x, n)", df.schema)
