"""Objective expressions written by users, turned into Spark columns.

Python's own `ast` does the parsing. Nothing from the text ever reaches Spark's
SQL parser: only the listed nodes, operators and functions become columns.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from larder.functions import numeric as N

ALLOWED = re.compile(r"[\w+\-*/%^&|<>~!@().,\s]+")
COMMENT = re.compile(r"/\*.*?\*/", re.DOTALL)
OPERAND = re.compile(r"[\w.]+")
BIT_OPERATORS = (ast.BitAnd, ast.BitOr, ast.LShift, ast.RShift)


class ObjectiveError(ValueError):
    """The text is not an objective this module accepts."""


def _doubles(function: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *args: function(*(a.cast("double") for a in args))


def _longs(function: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *args: function(*(a.cast("long") for a in args))


def _clamped(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.abs(x.cast("double")) > 1, N.NAN).otherwise(function(x.cast("double")))


def _log(first: Column, second: Column | None = None) -> Column:
    """log(x) is decimal; log(base, x) takes its base first."""
    tens = N.ieee_log(first, F.log10)
    return tens if second is None else N.ieee_divide(N.ieee_log(second, F.log10), tens)


# name -> (accepted argument counts, None for "one or more"; column builder)
FUNCTIONS: dict[str, tuple[tuple[int, ...] | None, Callable[..., Column]]] = {
    "abs": ((1,), F.abs),
    "acos": ((1,), _clamped(F.acos)),
    "acosh": ((1,), lambda x: F.when(x < 1, N.NAN).otherwise(F.acosh(x))),
    "add": ((2,), lambda x, y: x + y),
    "asin": ((1,), _clamped(F.asin)),
    "asinh": ((1,), F.asinh),
    "atan": ((1,), F.atan),
    "atan2": ((2,), F.atan2),
    "atanh": ((1,), F.atanh),
    "bit_count": ((1,), F.bit_count),
    "cbrt": ((1,), F.cbrt),
    "ceil": ((1,), lambda x: -N._floor_double(-x.cast("double"))),
    "ceiling": ((1,), lambda x: -N._floor_double(-x.cast("double"))),
    "cos": ((1,), F.cos),
    "cot": ((1,), F.cot),
    "degrees": ((1,), F.degrees),
    "divide": ((2,), lambda x, y: N.ieee_divide(x, y)),
    "even": ((1,), N.next_even),
    "exp": ((1,), F.exp),
    "factorial": ((1,), lambda n: F.factorial(n.cast("int"))),
    "fdiv": ((2,), N.floored_quotient),
    "floor": ((1,), lambda x: N._floor_double(x.cast("double"))),
    "fmod": ((2,), N.floored_remainder),
    "gamma": ((1,), _doubles(N.gamma)),
    "gcd": ((2,), _longs(N.gcd)),
    "greatest": (None, lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0]),
    "greatest_common_divisor": ((2,), _longs(N.gcd)),
    "isfinite": ((1,), N.is_finite),
    "isinf": ((1,), N.is_infinite),
    "isnan": ((1,), lambda x: F.isnan(x.cast("double"))),
    "lcm": ((2,), _longs(N.lcm)),
    "least": (None, lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0]),
    "least_common_multiple": ((2,), _longs(N.lcm)),
    "lgamma": ((1,), _doubles(N.lgamma)),
    "ln": ((1,), N.ieee_log),
    "log": ((1, 2), lambda *xs: _log(*xs)),
    "log10": ((1,), lambda x: N.ieee_log(x, F.log10)),
    "log2": ((1,), lambda x: N.ieee_log(x, F.log2)),
    "multiply": ((2,), lambda x, y: x * y),
    "nextafter": ((2,), _doubles(N.nextafter)),
    "pi": ((0,), F.pi),
    "pow": ((2,), N.ieee_power),
    "power": ((2,), N.ieee_power),
    "radians": ((1,), F.radians),
    "random": ((0,), F.rand),
    "round": ((1, 2), N.round_half_away),
    "round_even": ((1, 2), F.bround),
    "setseed": ((1,), lambda x: F.when(x.isNull(), F.lit(None).cast("double"))),
    "sign": ((1,), lambda x: F.sign(x).cast("int")),
    "signbit": ((1,), N.is_negative),
    "sin": ((1,), F.sin),
    "sqrt": ((1,), lambda x: F.when(x < 0, N.NAN).otherwise(F.sqrt(x))),
    "subtract": ((2,), lambda x, y: x - y),
    "tan": ((1,), F.tan),
    "trunc": ((1,), N.toward_zero),
    "xor": ((2,), lambda x, y: x.bitwiseXOR(y)),
}

OPERATORS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: N.ieee_divide,
    ast.Mod: lambda a, b: a % b,
    ast.Pow: N.ieee_power,
    ast.BitAnd: lambda a, b: a.bitwiseAND(b),
    ast.BitOr: lambda a, b: a.bitwiseOR(b),
    ast.LShift: lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")),
    ast.RShift: lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")),
}


def compile_objective(text: str, schema: T.StructType, key: Column | None = None, seed: int = 0) -> Column:
    """The column that `text` stands for, over a DataFrame of this schema.

    With `key`, a whole number that tells rows apart, random() is a function of the key and the seed: the same in every
    run and however rows are partitioned. Without one it differs from run to run.

    Operators mean what they mean in DuckDB's SQL: `^` and `**` are
    powers, `//` cuts integers toward zero and divides floats, `n!` is a factorial,
    `@x` an absolute value, `log` the decimal logarithm.
    """
    tree = _parse(text)
    columns = {field.name.lower(): field for field in schema.fields}
    return _column(tree.body, columns, _Draws(key, seed) if key is not None else None)


def check_objective(text: str, df: DataFrame) -> tuple[bool, str]:
    """Whether `text` can rank rows of df: known columns and a floating or decimal result."""
    try:
        column = compile_objective(text, df.schema)
        result = df.select(column.alias("objective")).schema[0].dataType
    except ObjectiveError as error:
        return False, str(error)
    except AnalysisException:
        return False, "Operand types do not fit."
    if not isinstance(result, (T.DoubleType, T.FloatType, T.DecimalType)):
        return False, f"Objective '{text.strip()}' is not a floating-point number."
    return True, "Valid objective."


def check_syntax(text: str) -> tuple[bool, str]:
    """Whether `text` is a single expression of allowed parts, whatever the columns."""
    try:
        for node in ast.walk(_parse(text).body):
            _check_node(node)
    except ObjectiveError as error:
        return False, str(error)
    return True, "Valid objective."


def is_random(text: str) -> bool:
    """True if the objective changes from run to run, so that a caller can warn."""
    return any(isinstance(n, ast.Call) and n.func.id.lower() == "random" for n in ast.walk(_parse(text).body))


def _parse(text: str) -> ast.Expression:
    if not ALLOWED.fullmatch(text):
        raise ObjectiveError("Only names, numbers, operators and parentheses are allowed.")
    source = COMMENT.sub(" ", text).replace("\n", " ").strip().replace("^", "**")
    source = _prefix_calls(_postfix_calls(source))
    try:
        return ast.parse(source, mode="eval")
    except (SyntaxError, ValueError) as error:
        raise ObjectiveError("Not a single expression.") from error


def _postfix_calls(source: str) -> str:
    """Write `n!` as factorial(n)."""
    while (at := source.find("!")) >= 0:
        end = len(source[:at].rstrip())
        start = end
        if end and source[end - 1] == ")":
            start = _open_of(source, end - 1)
        while start and (source[start - 1].isalnum() or source[start - 1] in "_."):
            start -= 1
        if start == end:
            raise ObjectiveError("Nothing before '!'.")
        source = f"{source[:start]}factorial({source[start:end]}){source[at + 1:]}"
    return source


def _prefix_calls(source: str) -> str:
    """Write `@x` as abs(x); an operator may only follow after explicit parentheses."""
    while (at := source.rfind("@")) >= 0:
        if re.search(r"[\w)]\s*$", source[:at]):
            raise ObjectiveError("'@' goes before its operand.")
        begin = at + 1 + len(source[at + 1 :]) - len(source[at + 1 :].lstrip())
        name = OPERAND.match(source, begin)
        end = name.end() if name else begin
        if source[end : end + 1] == "(":
            end = _close_of(source, end) + 1
        if end == begin:
            raise ObjectiveError("Nothing after '@'.")
        if re.match(r"\s*[+\-*/%]", source[end:]):
            raise ObjectiveError("Put '@' and its operand in parentheses.")
        source = f"{source[:at]}abs({source[begin:end]}){source[end:]}"
    return source


def _open_of(source: str, close: int) -> int:
    depth = 0
    for at in range(close, -1, -1):
        depth += (source[at] == ")") - (source[at] == "(")
        if depth == 0:
            return at
    raise ObjectiveError("Unmatched parenthesis.")


def _close_of(source: str, start: int) -> int:
    depth = 0
    for at in range(start, len(source)):
        depth += (source[at] == "(") - (source[at] == ")")
        if depth == 0:
            return at
    raise ObjectiveError("Unmatched parenthesis.")


def _check_node(node: ast.AST) -> None:
    """Refuse unlisted nodes, and groupings that Python and SQL read differently."""
    match node:
        case ast.Constant():
            if isinstance(node.value, bool) or not isinstance(node.value, (int, float)):
                raise ObjectiveError("Only numbers may be constants.")
            if isinstance(node.value, int) and node.value >= 2**63:
                raise ObjectiveError("Integer constant out of range.")
        case ast.UnaryOp(op=ast.USub() | ast.UAdd()):
            if isinstance(node.operand, ast.BinOp) and _bare(node, node.operand):
                raise ObjectiveError("Put the sign and its power in parentheses.")
        case ast.BinOp(op=ast.FloorDiv()):
            pass
        case ast.BinOp():
            if type(node.op) not in OPERATORS:
                raise ObjectiveError("Unknown operator.")
            for child in (node.left, node.right):
                if _regroups(node, child) and _bare(node, child):
                    raise ObjectiveError("Add parentheses to say what is grouped.")
        case ast.Call(func=ast.Name(id=name), keywords=[]):
            if name.lower() not in FUNCTIONS:
                raise ObjectiveError(f"Function '{name}' is not available.")
            arity, _ = FUNCTIONS[name.lower()]
            if len(node.args) not in (arity or range(1, 256)):
                raise ObjectiveError(f"Function '{name}' has a different number of arguments.")
        case ast.UnaryOp(op=ast.Invert()) | ast.Name() | ast.operator() | ast.unaryop() | ast.expr_context():
            pass
        case _:
            raise ObjectiveError(f"{type(node).__name__} is not allowed.")


def _bare(parent: ast.AST, child: ast.AST) -> bool:
    """True if the child is written without parentheses of its own."""
    if isinstance(parent, ast.BinOp) and child is parent.left:
        return child.col_offset == parent.col_offset
    return child.end_col_offset == parent.end_col_offset


def _regroups(parent: ast.BinOp, child: ast.AST) -> bool:
    if isinstance(child, ast.UnaryOp):
        return isinstance(child.op, ast.Invert) and child is parent.left and not isinstance(parent.op, BIT_OPERATORS)
    if not isinstance(child, ast.BinOp):
        return False
    if isinstance(parent.op, ast.Pow):
        return isinstance(child.op, ast.Pow)
    mixed = type(child.op) is not type(parent.op)
    return mixed and isinstance(parent.op, BIT_OPERATORS) and isinstance(child.op, BIT_OPERATORS)


class _Draws:
    """Random numbers of one objective: each call of random() has a stream of its own under the seed in force."""

    def __init__(self, key: Column, seed: int):
        self.key, self.seed, self.calls = key, seed, 0

    def draw(self) -> Column:
        self.calls += 1
        return N.counter_random(self.key, self.seed, self.calls)

    def reseed(self, node: ast.AST) -> None:
        """setseed takes a constant from -1 to 1 and holds for the calls after it; streams start anew."""
        try:
            value = float(ast.literal_eval(node))
        except (ValueError, TypeError) as error:
            raise ObjectiveError("The seed has to be a constant.") from error
        if not -1 <= value <= 1:
            raise ObjectiveError("The seed lies between -1 and 1.")
        self.seed, self.calls = N.seed_of(value), 0


def _column(node: ast.AST, columns: dict[str, T.StructField], draws: _Draws | None = None) -> Column:
    _check_node(node)
    match node:
        case ast.Constant(value=value):
            return F.lit(value)
        case ast.Name(id=name):
            if name.lower() not in columns:
                raise ObjectiveError(f"Variable '{name}' not found.")
            return F.col(f"`{columns[name.lower()].name}`")
        case ast.UnaryOp(op=ast.USub()):
            return -_column(node.operand, columns, draws)
        case ast.UnaryOp(op=ast.UAdd()):
            return _column(node.operand, columns, draws)
        case ast.UnaryOp(op=ast.Invert()):
            return F.bitwise_not(_column(node.operand, columns, draws))
        case ast.BinOp(op=ast.FloorDiv()):
            left, right = _column(node.left, columns, draws), _column(node.right, columns, draws)
            if _integral(node.left, columns) and _integral(node.right, columns):
                return F.call_function("div", left, right)
            return N.ieee_divide(left, right)
        case ast.BinOp():
            return OPERATORS[type(node.op)](_column(node.left, columns, draws), _column(node.right, columns, draws))
        case ast.Call(func=ast.Name(id=name)):
            args = [_column(a, columns, draws) for a in node.args]
            if draws and name.lower() == "random":
                return draws.draw()
            if draws and name.lower() == "setseed":
                draws.reseed(node.args[0])
            if name.lower() in ("round", "round_even"):
                return FUNCTIONS[name.lower()][1](args[0], _digits(node))
            if name.lower() == "divide" and all(_integral(a, columns) for a in node.args):
                return F.call_function("div", *args)
            return FUNCTIONS[name.lower()][1](*args)
    raise ObjectiveError(f"{type(node).__name__} is not allowed.")


def _digits(call: ast.Call) -> int:
    try:
        return int(ast.literal_eval(call.args[1])) if len(call.args) > 1 else 0
    except ValueError as error:
        raise ObjectiveError("The number of digits has to be a constant.") from error


def _integral(node: ast.AST, columns: dict[str, T.StructField]) -> bool:
    """Whether the node is an integer in SQL's typing: only + - * % // and bit operators keep integers."""
    match node:
        case ast.Constant(value=value):
            return isinstance(value, int)
        case ast.Name(id=name):
            field = columns.get(name.lower())
            return field is not None and isinstance(field.dataType, T.IntegralType)
        case ast.UnaryOp():
            return _integral(node.operand, columns)
        case ast.BinOp(op=ast.Div() | ast.Pow()):
            return False
        case ast.BinOp():
            return _integral(node.left, columns) and _integral(node.right, columns)
        case ast.Call(func=ast.Name(id=name)):
            return name.lower() in ("gcd", "lcm", "bit_count", "factorial", "xor", "sign") or (
                name.lower() in ("abs", "add", "subtract", "multiply", "divide", "greatest", "least")
                and all(_integral(a, columns) for a in node.args)
            )
    return False
