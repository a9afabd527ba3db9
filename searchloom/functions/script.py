"""A small expression language for filters, scores and computed fields, compiled to columns.

Supported: literals, ``params``, ``doc['f']`` (``value``, ``size()``, ``length``, ``empty``), ``_score``, arithmetic, comparison,
logic, the ternary, local variables, ``if``/``else`` with ``return``, ``emit``, ``Math`` functions, vector functions, string and
date members. Numbers are doubles. Division by zero gives NaN, ``+`` with a string joins, a missing value makes the result null;
a null filter matches nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions import vectors

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+|\d+)[lLdDfF]?|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(&&|\|\||==|!=|<=|>=|[-+*/%<>!?:()\[\].,;{}=]))")
_LEVEL = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
MAX_DEPTH = 200


class ScriptError(ValueError):
    """The script can't be parsed, or uses what the language lacks."""


@dataclass
class Scope:
    """What a script can see: the columns and their types, parameters and the score."""

    schema: T.StructType
    params: dict = field(default_factory=dict)
    score: Column | None = None
    names: dict = field(default_factory=dict)


@dataclass
class _Doc:
    name: str


@dataclass
class _Value:
    col: Column
    kind: str  # number, string, boolean, date, list, null


def tokenize(text: str) -> list[str]:
    out, at = [], 0
    text = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text, flags=re.DOTALL).rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ScriptError(f"unexpected character at {at}: {text[at : at + 20]!r}")
        out.append(next(g for g in m.groups() if g is not None))
        at = m.end()
    return out


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "list"
    return "string"


class _Parser:
    def __init__(self, text: str, scope: Scope):
        self.toks, self.i, self.scope, self.depth = tokenize(text), 0, scope, 0

    def peek(self, ahead: int = 0) -> str:
        return self.toks[self.i + ahead] if self.i + ahead < len(self.toks) else ""

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if not t or want is not None and t != want:
            raise ScriptError(f"expected {want or 'more'}, found {t or 'the end'}")
        self.i += 1
        return t

    # statements
    def program(self) -> _Value:
        v = self.block("")
        if v is None:
            raise ScriptError("the script gives no value")
        return v

    def block(self, end: str) -> _Value | None:
        while self.peek() and self.peek() != end:
            if self.peek() == ";":
                self.take()
                continue
            t = self.peek()
            if t == "return":
                self.take()
                v = self.expr()
                self._skip(end)
                return v
            if t == "if":
                return self.conditional(end)
            if t in ("def", "double", "float", "int", "long", "String", "boolean", "var") and self.peek(2) == "=":
                self.take()
                name = self.take()
                self.take("=")
                self.scope.names[name] = self.expr()
                continue
            if re.match(r"[A-Za-z_]", t) and self.peek(1) == "=":
                name = self.take()
                self.take("=")
                self.scope.names[name] = self.expr()
                continue
            v = self.expr()
            if self.peek() in (";", end, ""):
                self._skip(end) if self.peek() != ";" or self._rest_is_empty(end) else None
                if self.peek() in (end, ""):
                    return v
        return None

    def _rest_is_empty(self, end: str) -> bool:
        j = self.i
        while j < len(self.toks) and self.toks[j] == ";":
            j += 1
        done = j >= len(self.toks) or self.toks[j] == end
        if done:
            self.i = j
        return done

    def _skip(self, end: str) -> None:
        level = 0
        while self.peek():
            if self.peek() == "{":
                level += 1
            elif self.peek() == "}":
                if not level and end == "}":
                    return
                level -= 1
            self.i += 1

    def conditional(self, end: str) -> _Value | None:
        self.take("if")
        self.take("(")
        c = self.expr()
        self.take(")")
        names = dict(self.scope.names)
        yes = self.branch()
        after_yes, self.scope.names = self.scope.names, dict(names)
        no = None
        if self.peek() == "else":
            self.take()
            no = self.conditional(end) if self.peek() == "if" else self.branch()
        after_no = self.scope.names
        merged = {}
        for k in names:
            a, b = after_yes.get(k, names[k]), after_no.get(k, names[k])
            merged[k] = a if a is b else _Value(F.when(c.col, a.col).otherwise(b.col), a.kind)
        self.scope.names = merged
        if yes is not None and no is not None:
            return _Value(F.when(c.col, yes.col).otherwise(no.col), yes.kind)
        rest = self.block(end)
        if yes is None and no is None:
            return rest
        if rest is None:
            rest = _Value(F.lit(None), "null")
        a, b = yes or rest, no or rest
        return _Value(F.when(c.col, a.col).otherwise(b.col), (yes or no).kind)

    def branch(self) -> _Value | None:
        if self.peek() == "{":
            self.take()
            v = self.block("}")
            self.take("}")
            return v
        if self.peek() == "return":
            self.take()
            v = self.expr()
            if self.peek() == ";":
                self.take()
            return v
        name = self.take()
        self.take("=")
        self.scope.names[name] = self.expr()
        if self.peek() == ";":
            self.take()
        return None

    # expressions
    def expr(self) -> _Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ScriptError("the script is nested too deeply")
        c = self.binary(1)
        if self.peek() == "?":
            self.take()
            a = self.expr()
            self.take(":")
            b = self.expr()
            c = _Value(F.when(c.col, a.col).otherwise(b.col), a.kind if a.kind != "null" else b.kind)
        self.depth -= 1
        return c

    def binary(self, level: int) -> _Value:
        a = self.unary()
        while (op := self.peek()) in _LEVEL and _LEVEL[op] >= level:
            self.take()
            b = self.binary(_LEVEL[op] + 1)
            a = _apply(op, a, b)
        return a

    def unary(self) -> _Value:
        if self.peek() == "!":
            self.take()
            return _Value(~self.unary().col, "boolean")
        if self.peek() == "-":
            self.take()
            return _Value(-self.unary().col, "number")
        if self.peek() == "+":
            self.take()
            return self.unary()
        return self.postfix(self.primary())

    def primary(self):
        t = self.take()
        if t == "(":
            v = self.expr()
            self.take(")")
            return v
        if t[0].isdigit() or t[0] == ".":
            return _Value(F.lit(float(t)), "number")
        if t[0] in "'\"":
            return _Value(F.lit(re.sub(r"\\(.)", r"\1", t[1:-1])), "string")
        if t in ("true", "false"):
            return _Value(F.lit(t == "true"), "boolean")
        if t == "null":
            return _Value(F.lit(None), "null")
        if t == "_score":
            return _Value(self.scope.score if self.scope.score is not None else F.lit(1.0), "number")
        if t == "doc":
            self.take("[")
            name = self.take()[1:-1]
            self.take("]")
            return _Doc(name)
        if t == "params":
            if self.peek() == "[":
                self.take()
                key = self.take()[1:-1]
                self.take("]")
            else:
                self.take(".")
                key = self.take()
            return self.literal(key)
        if t == "Math":
            self.take(".")
            return self.math(self.take())
        if self.peek() == "(":
            return self.call(t)
        if t in self.scope.names:
            return self.scope.names[t]
        raise ScriptError(f"unknown name {t}")

    def literal(self, key: str) -> _Value:
        if key not in self.scope.params:
            raise ScriptError(f"no parameter {key}")
        v = self.scope.params[key]
        if isinstance(v, bool):
            return _Value(F.lit(v), "boolean")
        if isinstance(v, (int, float)):
            return _Value(F.lit(float(v)), "number")
        if isinstance(v, (list, tuple)):
            return _Value(F.array(*[F.lit(float(x) if isinstance(x, (int, float)) else x) for x in v]), "list")
        return _Value(F.lit(v), "string" if v is not None else "null")

    def args(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expr())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def math(self, name: str) -> _Value:
        if name in ("PI", "E"):
            return _Value(F.lit(math.pi if name == "PI" else math.e), "number")
        a = [x.col for x in self.args()]
        one = {"abs": F.abs, "log": F.log, "log10": F.log10, "sqrt": F.sqrt, "exp": F.exp}
        if name in one:
            return _Value(one[name](a[0]), "number")
        two = {"max": F.greatest, "min": F.least, "pow": F.pow}
        if name in two:
            return _Value(two[name](a[0], a[1]), "number")
        if name in ("floor", "ceil", "round"):
            return _Value({"floor": F.floor, "ceil": F.ceil, "round": F.round}[name](a[0]).cast("double"), "number")
        raise ScriptError(f"unknown function Math.{name}")

    def call(self, name: str) -> _Value:
        if name == "emit":
            return self.args()[0]
        if name in ("dotProduct", "cosineSimilarity", "l1norm", "l2norm"):
            self.take("(")
            q = self.expr()
            self.take(",")
            v = self.expr() if self.peek()[0] not in "'\"" else _Value(F.col(f"`{self.take()[1:-1]}`"), "list")
            self.take(")")
            return _Value(vectors.FUNCTIONS[name](q.col, v.col), "number")
        if name == "sigmoid":
            v, k, a = (x.col for x in self.args())
            return _Value(F.pow(v, a) / (F.pow(k, a) + F.pow(v, a)), "number")
        raise ScriptError(f"unknown function {name}")

    def postfix(self, v):
        while self.peek() in (".", "["):
            if self.peek() == "[":
                self.take()
                i = self.expr()
                self.take("]")
                v = _Value(F.get(v.col, i.col.cast("int")), "number")
                continue
            self.take()
            name = self.take()
            called = self.peek() == "("
            if isinstance(v, _Doc):
                v = self.doc_member(v, name)
                if called:
                    self.args()
                continue
            v = self.member(v, name, self.args() if called else [])
        if isinstance(v, _Doc):
            return self.doc_member(v, "value")
        return v

    def doc_member(self, d: _Doc, name: str) -> _Value:
        try:
            f = self.scope.schema[d.name]
        except KeyError:
            raise ScriptError(f"no field {d.name}") from None
        col, kind = F.col(f"`{d.name}`"), _kind(f.dataType)
        if name == "value":
            return _Value(col.cast("double") if kind == "number" else col, kind)
        n = F.coalesce(F.size(col), F.lit(0)) if kind == "list" else col.isNotNull().cast("int")
        if name in ("size", "length"):
            return _Value(n.cast("double"), "number")
        if name == "empty":
            return _Value(n == 0, "boolean")
        raise ScriptError(f"unknown member {name} of doc")

    def member(self, v: _Value, name: str, args: list) -> _Value:
        c = v.col
        if v.kind == "string":
            if name == "length":
                return _Value(F.length(c).cast("double"), "number")
            if name in ("toLowerCase", "toUpperCase"):
                return _Value((F.lower if name == "toLowerCase" else F.upper)(c), "string")
            if name == "toString":
                return v
            if name in ("contains", "startsWith", "endsWith"):
                return _Value(getattr(c, name.lower() if name != "contains" else name)(args[0].col), "boolean")
        if v.kind == "date":
            if name == "getDayOfWeek":
                return _Value((F.weekday(c) + 1).cast("double"), "number")
            if name == "getDayOfWeekEnum":
                return _Value(F.upper(F.date_format(c, "EEEE")), "string")
            part = {"getHour": F.hour, "getMinute": F.minute, "getSecond": F.second, "getDayOfMonth": F.dayofmonth, "getMonthValue": F.month, "getYear": F.year}
            if name in part:
                return _Value(part[name](c).cast("double"), "number")
        if v.kind == "list":
            if name in ("size", "length"):
                return _Value(F.size(c).cast("double"), "number")
            if name == "isEmpty":
                return _Value(F.size(c) == 0, "boolean")
        if name == "toString":
            return _Value(c.cast("string"), "string")
        raise ScriptError(f"unknown member {name}")


def _apply(op: str, a: _Value, b: _Value) -> _Value:
    x, y = a.col, b.col
    if op in ("&&", "||"):
        return _Value(x & y if op == "&&" else x | y, "boolean")
    if op in ("==", "!="):
        if "null" in (a.kind, b.kind):
            same = y.isNull() if a.kind == "null" else x.isNull()
        elif a.kind != b.kind and "string" in (a.kind, b.kind):
            same = F.lit(False)
        else:
            same = x == y
        return _Value(same if op == "==" else ~same, "boolean")
    if op in ("<", ">", "<=", ">="):
        return _Value({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "boolean")
    if op == "+" and "string" in (a.kind, b.kind):
        return _Value(F.concat(x.cast("string"), y.cast("string")), "string")
    if op in ("/", "%"):
        safe = F.when(y == 0, F.lit(float("nan"))).otherwise(x / y if op == "/" else x % y)
        return _Value(F.when(x.isNotNull() & y.isNotNull(), safe), "number")
    return _Value({"+": x + y, "-": x - y, "*": x * y}[op], "number")


def compile_script(source: str | dict, schema: T.StructType, score: Column | None = None) -> Column:
    """The column of a script: a string, or ``{"source": ..., "params": ...}``."""
    if isinstance(source, dict):
        text, params = source.get("source") or source.get("inline"), source.get("params", {})
    else:
        text, params = source, {}
    if not isinstance(text, str):
        raise ScriptError("a script needs a source")
    return _Parser(text, Scope(schema, params, score)).program().col
