"""The rules' expression language, type-checked and compiled to Catalyst columns.

Types come from literals, from a table's schema and from the functions' signatures, so a call that no signature allows doesn't compile. An error at run time (a cast, a division by
zero, an overflow, an index out of range) is NULL and never ends a job: Spark's three-valued AND and OR then absorb errors as the language does (`true || error` is
true, `false && error` is false). Calls on `fs` with literal arguments become probes, which the caller resolves to columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DayTimeIntervalType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

TOKENS = re.compile(r"""\s+|//[^\n]*|(?P<num>0x[0-9a-fA-F]+u?|\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+u?)|(?P<str>[rbRB]{0,2}(?:"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))|(?P<id>@?[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}])""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
BINARY = [("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%")]
#: Functions on the file system: argument count. Their value is a probe.
PROBES = {"fileExists": 1, "fileContains": 2, "glob": 1, "isDir": 1, "read": 1, "depExists": 2, "depVersion": 2}
PROBE_TYPES = {"fileExists": "bool", "fileContains": "bool", "glob": ("list", "string"), "isDir": "bool", "read": "bytes", "depExists": "bool", "depVersion": "string"}
PROBE_DOCS = {
    "fileExists": "whether a file exists", "fileContains": "whether a file holds a text", "glob": "the files that match a glob", "isDir": "whether a file exists and is a directory", "read": "a file's bytes",
    "depExists": "whether a dependency of a manager matches a name with wildcards", "depVersion": "a dependency's version, empty where there is none",
}
MACROS = ("all", "exists", "exists_one", "map", "filter", "sortBy")


class ExpressionError(ValueError):
    """An expression that doesn't compile."""


class Unsigned(int):
    """An unsigned literal."""


@dataclass(frozen=True)
class Node:
    kind: str  # lit, id, call, method, list, map, index, cond, select
    value: Any = None
    args: tuple["Node", ...] = ()


def tokenise(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r} at {at}: {text}")
        at = m.end()
        kind = m.lastgroup
        if kind == "num":
            s = m[0].rstrip("u")
            n = int(s, 16) if s.startswith("0x") else int(s) if s.isdigit() else float(s)
            if type(n) is int and n > (UINT_MAX if m[0].endswith("u") else 2**63 - 1):
                raise ExpressionError(f"number out of range: {m[0]}")
            out.append(("lit", Unsigned(n) if m[0].endswith("u") else n))
        elif kind == "str":
            prefix = re.match(r"[rbRB]*", m[0])[0].lower()
            body = m[0][len(prefix) + 1 : -1]
            if "r" not in prefix:
                body = re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda e: chr(int(e[1][1:], 16)) if e[1][0] in "ux" and len(e[1]) > 1 else ESCAPES.get(e[1], e[1]), body)
            out.append(("lit", body.encode() if "b" in prefix else body))
        elif kind:
            out.append((kind, m[0]))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenise(text), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at]

    def take(self, op: str | None = None) -> tuple[str, Any]:
        t = self.tokens[self.at]
        if op is not None and t != ("op", op):
            raise ExpressionError(f"expected {op!r}, found {t[1]!r}: {self.text}")
        self.at += 1
        return t

    def accept(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.at += 1
            return True
        return False

    def parse(self) -> Node:
        out = self.ternary()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}: {self.text}")
        return out

    def ternary(self) -> Node:
        cond = self.binary(0)
        if not self.accept("?"):
            return cond
        yes = self.ternary()
        self.take(":")
        return Node("cond", None, (cond, yes, self.ternary()))

    def binary(self, level: int) -> Node:
        if level == len(BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[0] in ("op", "id") and self.peek()[1] in BINARY[level]:
            op = self.take()[1]
            left = Node("call", op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Node:
        for op in ("!", "-"):
            if self.accept(op):
                return Node("call", op, (self.unary(),))
        out = self.primary()
        while True:
            if self.accept("."):
                name = self.take()[1]
                out = Node("method", name, (out, *self.arguments(")"))) if self.accept("(") else Node("select", name, (out,))
            elif self.accept("["):
                out = Node("index", None, (out, self.ternary()))
                self.take("]")
            else:
                return out

    def arguments(self, close: str) -> list[Node]:
        out: list[Node] = []
        while not self.accept(close):
            if out:
                self.take(",")
                if self.accept(close):
                    break
            out.append(self.ternary())
        return out

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "lit":
            return Node("lit", value)
        if kind == "id":
            if value in ("true", "false", "null"):
                return Node("lit", {"true": True, "false": False, "null": None}[value])
            if self.accept("("):
                return Node("call", value, tuple(self.arguments(")")))
            if value == "lists" and self.accept(".") or value == "strings" and self.accept("."):
                name = f"{value}.{self.take()[1]}"
                self.take("(")
                return Node("call", name, tuple(self.arguments(")")))
            return Node("id", value)
        if (kind, value) == ("op", "("):
            out = self.ternary()
            self.take(")")
            return out
        if (kind, value) == ("op", "["):
            return Node("list", None, tuple(self.arguments("]")))
        if (kind, value) == ("op", "{"):
            pairs: list[Node] = []
            while not self.accept("}"):
                if pairs:
                    self.take(",")
                pairs.append(self.ternary())
                self.take(":")
                pairs.append(self.ternary())
            return Node("map", None, tuple(pairs))
        raise ExpressionError(f"unexpected {value!r}: {self.text}")


def parse(text: str) -> Node:
    return Parser(text).parse()


def probes_of(node: Node, registry: Registry | None = None) -> set[tuple]:
    """(function, argument, ...) of every call on `fs`; the arguments must be literal."""
    out = set()
    known = {n: k for n, (k, *_) in registry.probes.items()} if registry else PROBES
    if node.kind == "method" and node.args[0] == Node("id", "fs"):
        args = node.args[1:]
        if node.value not in known or len(args) != known[node.value]:
            raise ExpressionError(f"fs.{node.value} with {len(args)} arguments")
        if not all(a.kind == "lit" and isinstance(a.value, str) for a in args):
            raise ExpressionError(f"fs.{node.value} takes texts")
        out.add((node.value, *(a.value for a in args)))
    for a in node.args:
        out |= probes_of(a, registry)
    return out


# Types


#: bool, int, uint, double, string, bytes, duration, timestamp, null, dyn (not known); ("list", T), ("map", K, V), ("struct", StructType).
Type = Any
NUMBERS = ("int", "uint", "double")
TYPE_NAMES = {"bool": "bool", "int": "int", "uint": "uint", "double": "double", "string": "string", "bytes": "bytes", "list": "list", "map": "map", "null": "null_type", "duration": "google.protobuf.Duration", "timestamp": "google.protobuf.Timestamp"}
UINT_MAX = 2**64 - 1


@dataclass(frozen=True)
class Value:
    """A compiled part: its column and type; `literal` where it is one. Timestamps are columns without zone, in UTC; unsigned numbers are decimals."""

    column: Column
    type: Type = "dyn"
    literal: Any = ...


def kind_of(t: Type) -> str:
    return t if isinstance(t, str) else t[0]


def shown(t: Type) -> str:
    return t if isinstance(t, str) else t[0] if t[0] == "struct" else f"{t[0]}({', '.join(map(shown, t[1:]))})"


def fits(pattern: Type, t: Type) -> bool:
    """Whether an argument of type `t` may stand for a parameter: `any`, a type, or only its kind."""
    if pattern == "any" or t in ("dyn", "null") or pattern == t:
        return True
    if isinstance(pattern, str):
        return pattern == kind_of(t)
    return kind_of(pattern) == kind_of(t) and all(map(fits, pattern[1:], t[1:]))


def of_schema(column: Column, kind: DataType) -> Value:
    """A column of a table as a typed value."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return Value(column.cast("bigint"), "int")
    if isinstance(kind, (FloatType, DoubleType, DecimalType)):
        return Value(column.cast("double"), "double")
    if isinstance(kind, TimestampType):
        return Value(F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz")), "timestamp")
    if isinstance(kind, DateType):
        return Value(column.cast("timestamp_ntz"), "timestamp")
    if isinstance(kind, (ArrayType, MapType)):
        small = kind.simpleString()
        for a, b in (("tinyint", "bigint"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double")):
            small = re.sub(rf"(?<![a-z]){a}(?![a-z])", b, small)
        return Value(column.cast(small) if small != kind.simpleString() else column, type_of(kind))
    return Value(column, type_of(kind))


def type_of(kind: DataType) -> Type:
    simple = {BooleanType: "bool", ByteType: "int", ShortType: "int", IntegerType: "int", LongType: "int", FloatType: "double", DoubleType: "double", DecimalType: "double", StringType: "string", BinaryType: "bytes", TimestampType: "timestamp", TimestampNTZType: "timestamp", DateType: "timestamp", DayTimeIntervalType: "duration", NullType: "null"}
    if isinstance(kind, ArrayType):
        return "list", type_of(kind.elementType)
    if isinstance(kind, MapType):
        return "map", type_of(kind.keyType), type_of(kind.valueType)
    if isinstance(kind, StructType):
        return "struct", kind
    return next((t for k, t in simple.items() if isinstance(kind, k)), "dyn")


# Functions: an error is NULL


def ascii_case(c: Column, upper: bool) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, low, up) if upper else F.translate(c, up, low)


def jq_path(document: Column, query: str) -> Column:
    """The first result of a query over a JSON object, as text; empty for null and missing values, NULL where the document is no object or the query fails. Paths stay in
    the JVM; other programs run over Arrow batches."""
    text = document.cast("string")
    if not re.fullmatch(r"\.|(?:\.(?:[A-Za-z_]\w*|\"[^\"]+\")|\[\d+\]|\.?\[\"[^\"]+\"\])+", query):
        return jq_program(F.make_valid_utf8(text), query)
    keys = re.findall(r'\.?\[(\d+)\]|\.?\["([^"]+)"\]|\."([^"]+)"|\.([A-Za-z_]\w*)', query)
    path = "$" + "".join(f"[{i}]" if i else "['" + (a or b or c) + "']" for i, a, b, c in keys)
    value = F.get_json_object(text, path) if keys else text
    whole = F.expr("true") & F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")
    return F.when(F.coalesce(whole, F.lit(False)), F.coalesce(value, F.lit("")))


def jq_program(document: Column, query: str) -> Column:
    from .jq import JqError, compile_program, show

    try:
        program = compile_program(query)
    except JqError as e:
        raise ExpressionError(f"{query}: {e}") from None

    def first(texts):
        import json

        def one(text):
            try:
                value = json.loads(text)
                if not isinstance(value, dict):
                    return None
                found = next(iter(program(value)), ...)
                return None if found is ... else "" if found is None else show(found)
            except (JqError, ValueError, RecursionError):
                return None

        return of_distinct(texts, one)

    return F.pandas_udf(first, "string")(document)


def of_distinct(texts, one: Callable[[str], str | None]):
    """A series of results, each different text of the batch read once; null for null."""
    known = {t: one(t) for t in set(texts) if isinstance(t, str)}
    return texts.__class__([known.get(t) for t in texts], index=texts.index, dtype=object)


def yaml_to_json(document: Column) -> Column:
    """A YAML mapping as JSON text, by Arrow batches; NULL for what can't be read."""

    def convert(texts):
        import json

        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def one(text):
            try:
                return json.dumps(yaml.load(text, loader), default=str)
            except (yaml.YAMLError, ValueError, RecursionError):
                return None

        return of_distinct(texts, one)

    return F.pandas_udf(convert, "string")(F.make_valid_utf8(document.cast("string")))


def number(c: Column) -> Column:
    return c.cast("int")


def within(index: Column, size: Column, value: Column) -> Column:
    return F.when((index >= 0) & (index <= size), value)


def substring(s: Column, a: Column, b: Column | None = None) -> Column:
    end = F.length(s) if b is None else b
    return F.when((a >= 0) & (a <= end) & (end <= F.length(s)), F.substring(s, number(a) + 1, number(end - a)))


def index_of(s: Column, t: Column, at: Column | None = None) -> Column:
    first = F.lit(0) if at is None else at
    return within(first, F.length(s), F.when(t == "", first).otherwise(F.position(t, s, number(first) + 1) - 1)).cast("bigint")


def last_index_of(s: Column, t: Column, at: Column | None = None) -> Column:
    """The last place not behind `at`."""
    part = s if at is None else F.substring(s, F.lit(1), number(at) + F.length(t))
    place = F.when(t == "", F.length(s) if at is None else at).when(F.contains(part, t), F.length(part) - F.length(t) - (F.position(F.reverse(t), F.reverse(part)) - 1)).otherwise(-1).cast("bigint")
    return place if at is None else F.when((at >= 0) & (at < F.length(s)), place)


def split(s: Column, sep: Column, n: Column | None = None) -> Column:
    form = F.concat(F.lit("\\Q"), F.replace(sep, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letters = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "(?<=.)(?=.)", -1))
    whole = F.when(sep == "", letters).otherwise(F.split(s, form))
    if n is None:
        return whole
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 0, whole).when(n >= F.size(whole), whole).otherwise(
        F.concat(F.slice(whole, F.lit(1), F.greatest(number(n) - 1, F.lit(0))), F.array(F.call_function("array_join", F.slice(whole, F.greatest(number(n), F.lit(1)), F.size(whole)), sep)))
    )


def replace(s: Column, a: Column, b: Column, n: Column | None = None) -> Column:
    return F.replace(s, a, b) if n is None else F.when(n < 0, F.replace(s, a, b)).otherwise(F.call_function("array_join", split(s, a, n + 1), b))


def quote(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


def micros(d: Column) -> Column:
    return F.unix_micros(F.lit(0).cast("timestamp") + d)


def interval(us: Column) -> Column:
    return F.make_dt_interval(secs=(us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def duration(s: Column) -> Column:
    """From numbers with the units h, m, s, ms, us and ns, such as `1h2m3.5s`; NULL for other texts. Parts of a microsecond are cut off."""
    units = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "µs": 1, "ns": 0.001}
    part = lambda u: F.aggregate(F.regexp_extract_all(s, F.lit(rf"([0-9.]+){u}(?![a-zµ])"), F.lit(1)), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    total = reduce(lambda a, b: a + b, (part(u) * n for u, n in units.items()))
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    return F.when(s.rlike(r"^[-+]?(?:0|(?:(?:\d+(?:\.\d*)?|\.\d+)(?:h|ms|m|s|us|µs|ns))+)$"), interval((total * sign).cast("bigint")))


def double_text(d: Column) -> Column:
    """The shortest digits; with an exponent from 1e+21 and below 1e-4 on."""
    text, size = d.cast("string"), F.abs(d)
    parts = F.regexp_replace(F.regexp_replace(text, r"\.0(?=E|$)", ""), "E(-?)(\\d)$", "E$10$2")
    scientific = F.regexp_replace(F.regexp_replace(parts, "E(?=\\d)", "e+"), "E-", "e-")
    plain = F.regexp_replace(F.regexp_replace(d.try_cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(d), "NaN").when(size == float("inf"), F.when(d > 0, "+Inf").otherwise("-Inf")).when(~text.contains("E"), parts).when((size < 1e21) & (size >= 1e-4), plain).otherwise(scientific)


def stamp_text(t: Column) -> Column:
    return F.regexp_replace(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0+Z$", "Z")


def parsed_stamp(s: Column) -> Column:
    """From RFC 3339, with its zone."""
    there = F.try_to_timestamp(F.regexp_replace(s, "^(.{10})t", "$1T"))
    return F.when(s.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[-+]\d\d:\d\d)$"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), there.cast("timestamp_ntz")))


def getter(f: Callable[[Column], Column]) -> Callable[..., Column]:
    """A field of a timestamp in UTC, or in the zone of the second argument."""
    return lambda t, zone=None: f(t if zone is None else F.convert_timezone(F.lit("UTC"), zone, t)).cast("bigint")


def checked_uint(c: Column) -> Column:
    return F.when((c >= 0) & (c <= F.lit(str(UINT_MAX)).cast("decimal(20,0)")), c.try_cast("decimal(20,0)"))


def whole_division(a: Column, b: Column) -> Column:
    """Toward zero; NULL by zero and where it overflows."""
    return F.when((b != 0) & ~((a == -(2**63)) & (b == -1)), F.call_function("div", a, F.when(b != 0, b)))


def double_division(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.when((b == 0) & (a != 0), F.signum(a) * float("inf")).when((b == 0) & (a == 0), F.lit(float("nan"))))


def has_nulls(x: Column) -> Column:
    return F.exists(x, lambda v: v.isNull())


def same(types: list[Type]) -> Type:
    return types[0]


STAMP, SPAN = "timestamp", "duration"
TEXTS = ("string",)


def fixed(name: str, doc: str, *overloads: tuple) -> tuple[str, str, list[tuple]]:
    return name, doc, list(overloads)


#: Name, doc, and (parameter types, result type, function) of each way to call it. A result may depend on the arguments' types.
BUILT_IN: list[tuple[str, str, list[tuple]]] = [
    fixed("bool", "to a boolean; texts as 1, t, true, 0, f, false", (("bool",), "bool", lambda x: x), (TEXTS, "bool", lambda x: F.when(x.isin("1", "t", "T", "TRUE", "true", "True"), True).when(x.isin("0", "f", "F", "FALSE", "false", "False"), False))),
    fixed("bytes", "to bytes", (("bytes",), "bytes", lambda x: x), (TEXTS, "bytes", lambda x: x.cast("binary"))),
    fixed("double", "to a double", (("double",), "double", lambda x: x), (("int",), "double", lambda x: x.cast("double")), (("uint",), "double", lambda x: x.cast("double")), (TEXTS, "double", lambda x: F.trim(x).try_cast("double"))),
    fixed("int", "to a 64-bit number, toward zero", (("int",), "int", lambda x: x), (("double",), "int", lambda x: x.try_cast("bigint")), (("uint",), "int", lambda x: x.try_cast("bigint")), (TEXTS, "int", lambda x: F.when(x.rlike(r"^[-+]?\d+$"), x.try_cast("bigint"))), ((STAMP,), "int", lambda x: F.floor(micros(x - F.lit("1970-01-01").cast("timestamp_ntz")) / 1_000_000).cast("bigint")), ((SPAN,), "int", lambda x: micros(x) * 1000)),
    fixed("uint", "to an unsigned number", (("uint",), "uint", lambda x: x), (("int",), "uint", lambda x: checked_uint(x.cast("decimal(20,0)"))), (("double",), "uint", lambda x: checked_uint(F.floor(F.when(F.abs(x) < 1e20, x)).try_cast("decimal(20,0)"))), (TEXTS, "uint", lambda x: F.when(x.rlike(r"^\d+$"), checked_uint(x.try_cast("decimal(20,0)"))))),
    fixed("string", "to a text", (TEXTS, "string", lambda x: x), (("bool",), "string", lambda x: x.cast("string")), (("bytes",), "string", lambda x: F.when(F.is_valid_utf8(x.cast("string")), x.cast("string"))), (("double",), "string", double_text), (("int",), "string", lambda x: x.cast("string")), (("uint",), "string", lambda x: x.cast("string")), ((STAMP,), "string", stamp_text), ((SPAN,), "string", lambda x: F.concat(double_text(micros(x) / 1_000_000.0), F.lit("s")))),
    fixed("dyn", "the value itself", (("any",), same, lambda x: x)),
    fixed("timestamp", "from RFC 3339 or seconds", ((STAMP,), STAMP, lambda x: x), (TEXTS, STAMP, parsed_stamp), (("int",), STAMP, lambda x: F.lit("1970-01-01").cast("timestamp_ntz") + interval(x * 1_000_000))),
    fixed("duration", "from a text such as `1h2m3.5s`, or nanoseconds", ((SPAN,), SPAN, lambda x: x), (TEXTS, SPAN, duration), (("int",), SPAN, lambda x: interval(F.floor(x / 1000).cast("bigint")))),
    fixed("charAt", "the character at an index from 0; the empty text behind the last", (("string", "int"), "string", lambda s, i: within(i, F.length(s), F.substring(s, number(i) + 1, F.lit(1))))),
    fixed("contains", "whether a text holds another", (("string", "string"), "bool", F.contains)),
    fixed("startsWith", "whether a text begins with another", (("string", "string"), "bool", F.startswith)),
    fixed("endsWith", "whether a text ends with another", (("string", "string"), "bool", F.endswith)),
    fixed("matches", "whether a regex matches somewhere", (("string", "string"), "bool", F.regexp_like)),
    fixed("indexOf", "first index, from one on, -1 where absent", (("string", "string"), "int", index_of), (("string", "string", "int"), "int", index_of)),
    fixed("lastIndexOf", "last index, up to one, -1 where absent", (("string", "string"), "int", last_index_of), (("string", "string", "int"), "int", last_index_of)),
    fixed("lowerAscii", "ASCII letters in lower case", (TEXTS, "string", lambda s: ascii_case(s, False))),
    fixed("upperAscii", "ASCII letters in upper case", (TEXTS, "string", lambda s: ascii_case(s, True))),
    fixed("replace", "all, or the first n", (("string",) * 3, "string", replace), (("string", "string", "string", "int"), "string", replace)),
    fixed("split", "by a literal text, into n pieces at most; 0 gives none, below 0 all", (("string", "string"), ("list", "string"), split), (("string", "string", "int"), ("list", "string"), split)),
    fixed("join", "a list of texts, with a text between them", ((("list", "string"),), "string", lambda x: F.array_join(x, "")), ((("list", "string"), "string"), "string", lambda x, sep: F.call_function("array_join", x, sep))),
    fixed("substring", "from an index up to another", (("string", "int"), "string", substring), (("string", "int", "int"), "string", substring)),
    fixed("trim", "without white space at both ends", (TEXTS, "string", lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))),
    fixed("strings.quote", "in double quotes, escaped", (TEXTS, "string", quote)),
    fixed("reverse", "of a text or list", (TEXTS, "string", F.reverse), (("list",), same, F.reverse)),
    fixed("distinct", "in order of first appearance", (("list",), same, F.array_distinct)),
    fixed("slice", "from an index up to another", (("list", "int", "int"), same, lambda x, a, b: F.when((a >= 0) & (a <= b) & (b <= F.size(x)), F.slice(x, number(a) + 1, number(b - a))))),
    fixed("sort", "in order", (("list",), same, F.array_sort)),
    fixed("lists.range", "0 up to n", (("int",), ("list", "int"), lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>")))),
    fixed("size", "characters of a text, bytes, or members", (TEXTS, "int", lambda x: F.length(x).cast("bigint")), (("bytes",), "int", lambda x: F.length(x).cast("bigint")), (("list",), "int", lambda x: F.when(x.isNotNull(), F.size(x)).cast("bigint")), (("map",), "int", lambda x: F.when(x.isNotNull(), F.size(x)).cast("bigint"))),
    fixed("getFullYear", "the year", ((STAMP,), "int", getter(F.year)), ((STAMP, "string"), "int", getter(F.year))),
    fixed("getMonth", "the month from 0", ((STAMP,), "int", getter(lambda t: F.month(t) - 1)), ((STAMP, "string"), "int", getter(lambda t: F.month(t) - 1))),
    fixed("getDate", "the day of the month from 1", ((STAMP,), "int", getter(F.dayofmonth)), ((STAMP, "string"), "int", getter(F.dayofmonth))),
    fixed("getDayOfMonth", "the day of the month from 0", ((STAMP,), "int", getter(lambda t: F.dayofmonth(t) - 1)), ((STAMP, "string"), "int", getter(lambda t: F.dayofmonth(t) - 1))),
    fixed("getDayOfWeek", "the day of the week, Sunday 0", ((STAMP,), "int", getter(lambda t: F.dayofweek(t) - 1)), ((STAMP, "string"), "int", getter(lambda t: F.dayofweek(t) - 1))),
    fixed("getDayOfYear", "the day of the year from 0", ((STAMP,), "int", getter(lambda t: F.dayofyear(t) - 1)), ((STAMP, "string"), "int", getter(lambda t: F.dayofyear(t) - 1))),
    fixed("getHours", "the hour, or whole hours", ((STAMP,), "int", getter(F.hour)), ((STAMP, "string"), "int", getter(F.hour)), ((SPAN,), "int", lambda d: whole_division(micros(d), F.lit(3_600_000_000)))),
    fixed("getMinutes", "the minute, or whole minutes", ((STAMP,), "int", getter(F.minute)), ((STAMP, "string"), "int", getter(F.minute)), ((SPAN,), "int", lambda d: whole_division(micros(d), F.lit(60_000_000)))),
    fixed("getSeconds", "the second, or whole seconds", ((STAMP,), "int", getter(F.second)), ((STAMP, "string"), "int", getter(F.second)), ((SPAN,), "int", lambda d: whole_division(micros(d), F.lit(1_000_000)))),
    fixed("getMilliseconds", "milliseconds within the second", ((STAMP,), "int", getter(lambda t: F.floor(F.date_part(F.lit("SECONDS"), t) * 1000) % 1000)), ((STAMP, "string"), "int", getter(lambda t: F.floor(F.date_part(F.lit("SECONDS"), t) * 1000) % 1000)), ((SPAN,), "int", lambda d: whole_division(micros(d), F.lit(1000)) % 1000)),
    fixed("@not_strictly_false", "true where it isn't surely false", (("bool",), "bool", lambda x: F.coalesce(x, F.lit(True)))),
    fixed("@in", "whether a list holds a value, or a map a key", (("any", "list"), "bool", lambda x, l: F.array_contains(l, x)), (("any", "map"), "bool", lambda x, m: F.map_contains_key(m, x))),
    fixed("in", "whether a list holds a value, or a map a key", (("any", "list"), "bool", lambda x, l: F.array_contains(l, x)), (("any", "map"), "bool", lambda x, m: F.map_contains_key(m, x))),
    fixed("@sortByAssociatedKeys", "a list in the order of its keys", (("list", "list"), same, lambda l, keys: F.when(F.size(l) == F.size(keys), F.transform(F.array_sort(F.transform(F.arrays_zip(keys.alias("k"), F.sequence(F.lit(0), F.greatest(F.size(l) - 1, F.lit(0))).alias("i")), lambda p: F.struct(p["k"].alias("k"), p["i"].alias("i")))), lambda p: F.get(l, p["i"]))))),
    fixed("!", "not", (("bool",), "bool", lambda x: ~x)),
    fixed("&&", "and; an error counts only where the other side doesn't decide", (("bool", "bool"), "bool", lambda a, b: a & b)),
    fixed("||", "or; an error counts only where the other side doesn't decide", (("bool", "bool"), "bool", lambda a, b: a | b)),
    fixed("+", "sum, or texts and lists one after the other", (("int", "int"), "int", F.try_add), (("uint", "uint"), "uint", lambda a, b: checked_uint(a + b)), (("double", "double"), "double", lambda a, b: a + b), (("string", "string"), "string", F.concat), (("bytes", "bytes"), "bytes", F.concat), (("list", "list"), same, F.concat), ((SPAN, SPAN), SPAN, F.try_add), ((STAMP, SPAN), STAMP, lambda a, b: a + b), ((SPAN, STAMP), STAMP, lambda a, b: b + a)),
    fixed("-", "difference, or the negative", (("int", "int"), "int", F.try_subtract), (("uint", "uint"), "uint", lambda a, b: checked_uint(a - b)), (("double", "double"), "double", lambda a, b: a - b), ((SPAN, SPAN), SPAN, F.try_subtract), ((STAMP, SPAN), STAMP, lambda a, b: a - b), ((STAMP, STAMP), SPAN, lambda a, b: a - b), (("int",), "int", lambda x: F.try_subtract(F.lit(0).cast("bigint"), x)), (("double",), "double", lambda x: -x)),
    fixed("*", "product", (("int", "int"), "int", F.try_multiply), (("uint", "uint"), "uint", lambda a, b: checked_uint(a.try_cast("decimal(38,0)") * b)), (("double", "double"), "double", lambda a, b: a * b)),
    fixed("/", "quotient, of whole numbers toward zero", (("int", "int"), "int", whole_division), (("uint", "uint"), "uint", lambda a, b: F.when(b != 0, F.call_function("div", a, F.when(b != 0, b))).cast("decimal(20,0)")), (("double", "double"), "double", double_division)),
    fixed("%", "rest, with the sign of the first", (("int", "int"), "int", F.try_mod), (("uint", "uint"), "uint", F.try_mod)),
]
OPERATOR_NAMES = frozenset({"!", "&&", "||", "+", "-", "*", "/", "%", "in", "==", "!=", "<", "<=", ">", ">="})
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


@dataclass
class Registry:
    """Functions by name, each with the ways to call it; users register their own, also as methods of `fs`."""

    functions: dict[str, list[tuple[tuple | None, Type, Callable[..., Column]]]] = field(default_factory=dict)
    docs: dict[str, str] = field(default_factory=dict)
    #: Methods of `fs`: number of arguments, type of the result, and what gives their rows (see `register_probe`).
    probes: dict[str, tuple[int, Type, Callable | None]] = field(default_factory=lambda: {n: (k, PROBE_TYPES[n], None) for n, k in PROBES.items()})

    def register(self, name: str, function: Callable[..., Column], doc: str = "", parameters: tuple | None = None, result: Type = "dyn") -> None:
        """A function of columns; without `parameters` it takes any. An entry of the same name is replaced."""
        self.functions[name] = [(parameters, result, function)]
        self.docs[name] = doc or (function.__doc__ or "")

    def register_probe(self, name: str, arguments: int, rows: Callable[..., DataFrame], doc: str = "", result: Type = "string") -> None:
        """A method `fs.name(...)` of literal texts: rows(files, *arguments) gives a table (repo, path, value), one row for each directory that has a value: a boolean, a
        text or bytes, by `result`."""
        self.probes[name] = (arguments, result, rows)
        self.docs[name] = doc or (rows.__doc__ or "")

    @staticmethod
    def default() -> Registry:
        r = Registry()
        for name, doc, overloads in BUILT_IN:
            r.functions[name], r.docs[name] = overloads, doc
        r.docs |= {"flatten": "a list of lists as one list, down to n levels", "format": "a text with its places filled", "type": "the type's name", "jq": "the first result of a query over JSON bytes", "yq": "the same over YAML bytes"} | PROBE_DOCS
        return r

    def reference(self) -> str:
        """All functions and operators with their types, as Markdown."""
        out = []
        for name in sorted(self.docs, key=lambda n: (n in OPERATOR_NAMES, n.lower())):
            out += [f"### `{name}`", "", self.docs[name], ""]
            if name in self.probes:
                k, result, _ = self.probes[name]
                out.append(f"* `fs.{name}({', '.join(['string'] * k)})` -> `{shown(result)}`")
            for parameters, result, _ in self.functions.get(name, ()):
                given = ", ".join(map(shown, parameters)) if parameters is not None else "..."
                out.append(f"* `{name}({given})` -> `{shown(result) if not callable(result) else shown(parameters[0])}`")
            out.append("")
        return "\n".join(out)


@dataclass
class Compiler:
    """`variables`: columns by name. `schema`: their types (a table's schema); without it a variable's type isn't known, and what depends on it follows the other argument.
    `probe`: resolves (function, argument, ...) of a call on `fs`."""

    variables: dict[str, Column | Value] = field(default_factory=dict)
    probe: Callable[..., Column] | None = None
    registry: Registry = field(default_factory=Registry.default)
    schema: StructType | None = None

    def compile(self, text: str) -> Column:
        """The column of an expression. Types are checked; an error at run time is NULL."""
        return self.typed(text).column

    def typed(self, text: str) -> Value:
        node = parse(text)
        probes_of(node, self.registry)
        return self.value(node)

    def fail(self, message: str) -> ExpressionError:
        return ExpressionError(message)

    def value(self, node: Node) -> Value:
        kind, value, args = node.kind, node.value, node.args
        if kind == "lit":
            return literal(value)
        if kind == "id":
            return self.variable(value)
        if kind == "cond":
            c, a, b = map(self.value, args)
            if not fits("bool", c.type):
                raise self.fail(f"a condition must be a bool, not {shown(c.type)}")
            if not (fits(a.type, b.type) or fits(b.type, a.type)):
                raise self.fail(f"{shown(a.type)} and {shown(b.type)} in one choice")
            return Value(F.when(c.column, a.column).when(~c.column, b.column), a.type if a.type != "null" else b.type)
        if kind == "list":
            members = [self.value(a) for a in args]
            types = list(dict.fromkeys(m.type for m in members if m.type != "null"))
            return Value(F.array(*(m.column for m in members)), ("list", types[0] if len(types) == 1 else "dyn"))
        if kind == "map":
            members = [self.value(a) for a in args]
            pick = lambda part: next(iter(dict.fromkeys(m.type for m in part)), "dyn") if len({m.type for m in part}) <= 1 else "dyn"
            return Value(F.create_map(*(m.column for m in members)), ("map", pick(members[::2]), pick(members[1::2])))
        if kind == "index":
            return self.index(*map(self.value, args))
        if kind == "select":
            return self.select(self.value(args[0]), value)
        if kind == "method" and args[0] == Node("id", "fs"):
            if self.probe is None:
                raise self.fail("no file system here")
            return Value(self.probe(value, *(a.value for a in args[1:])), self.registry.probes[value][1])
        if kind == "method" and value in MACROS and len(args) >= 3 and args[1].kind == "id":
            return self.macro(node)
        if kind == "call" and value == "has" and len(args) == 1:
            if args[0].kind == "select":
                base = self.value(args[0].args[0])
                if kind_of(base.type) == "map":
                    return Value(F.map_contains_key(base.column, F.lit(args[0].value)), "bool")
            return Value(self.value(args[0]).column.isNotNull(), "bool")
        given = [self.value(a) for a in args]
        if kind == "call" and value in ("jq", "yq"):
            if len(given) != 2 or not isinstance(given[1].literal, str) or not (fits("bytes", given[0].type) or fits("string", given[0].type)):
                raise self.fail(f"{value} takes a document and a literal query")
            return Value(jq_path(yaml_to_json(given[0].column) if value == "yq" else given[0].column, given[1].literal), "string")
        if value in COMPARISONS and kind == "call":
            return self.compared(value, *given)
        if value == "type" and len(given) == 1:
            return Value(F.lit(TYPE_NAMES.get(kind_of(given[0].type), "dyn")), "string")
        if value == "format" and kind == "method" and "format" not in self.registry.functions:
            return self.format(args, given)
        if value == "flatten" and kind == "method" and "flatten" not in self.registry.functions:
            return self.flatten(given)
        if value == "matches" and len(given) == 2 and isinstance(given[1].literal, str):
            try:
                re.compile(given[1].literal)
            except re.error as e:
                raise self.fail(f"matches: {e}") from None
        return self.call(value, given)

    def column(self, node: Node) -> Column:
        return self.value(node).column

    def variable(self, name: str) -> Value:
        if name in self.variables:
            v = self.variables[name]
            if isinstance(v, Value):
                return v
            if self.schema is not None and name in self.schema.names:
                return of_schema(v, self.schema[name].dataType)
            return Value(v)
        if name in TYPE_NAMES:  # the name of a type is a value, too
            return Value(F.lit(TYPE_NAMES[name]), "string")
        raise self.fail(f"unknown name: {name}")

    def call(self, name: str, given: list[Value]) -> Value:
        if name not in self.registry.functions:
            raise self.fail(f"unknown function: {name}")
        types = [v.type for v in given]
        ways = self.registry.functions[name]
        # of ways that fit because a type isn't known, the one that most known types name
        best = sorted((w for w in ways if w[0] is None or len(w[0]) == len(types) and all(map(fits, w[0], types))), key=lambda w: -sum(p == t or kind_of(p) == kind_of(t) for p, t in zip(w[0] or (), types)))
        if not best:
            raise self.fail(f"{name} can't take ({', '.join(map(shown, types))})")
        _, result, function = best[0]
        try:
            return Value(function(*(v.column for v in given)), result(types) if callable(result) else result)
        except TypeError as e:
            raise self.fail(f"{name}: {e}") from None

    def compared(self, op: str, a: Value, b: Value) -> Value:
        if "null" in (a.type, b.type) and op in ("==", "!="):
            other = b if a.type == "null" else a
            return Value(other.column.isNull() if op == "==" else other.column.isNotNull(), "bool")
        both = kind_of(a.type), kind_of(b.type)
        if not (all(k in NUMBERS for k in both) or fits(a.type, b.type) or fits(b.type, a.type)) or op not in ("==", "!=") and both[0] in ("list", "map", "struct"):
            raise self.fail(f"{shown(a.type)} {op} {shown(b.type)}")
        if both == ("map", "map"):
            entries = lambda m: F.array_sort(F.map_entries(m))
            a, b = Value(entries(a.column)), Value(entries(b.column))
        return Value(COMPARISONS[op](a.column, b.column), "bool")

    def index(self, base: Value, at: Value) -> Value:
        if kind_of(base.type) == "map":
            if not fits(base.type[1], at.type):
                raise self.fail(f"a key of {shown(base.type)} can't be {shown(at.type)}")
            return Value(F.try_element_at(base.column, at.column), base.type[2])
        if kind_of(base.type) == "list":
            if not fits("int", at.type):
                raise self.fail(f"an index must be an int, not {shown(at.type)}")
            return Value(F.get(base.column, number(F.when((at.column >= 0) & (at.column < 2**31), at.column))), base.type[1])
        if base.type == "dyn":
            return Value(F.get(base.column, number(at.column)) if at.type == "int" else F.try_element_at(base.column, at.column))
        raise self.fail(f"{shown(base.type)} has no members")

    def select(self, base: Value, name: str) -> Value:
        if kind_of(base.type) == "struct":
            if name not in base.type[1].names:
                raise self.fail(f"no field {name}")
            return of_schema(base.column[name], base.type[1][name].dataType)
        if kind_of(base.type) == "map":
            return Value(F.try_element_at(base.column, F.lit(name)), base.type[2])
        if base.type == "dyn":
            return Value(base.column[name])
        raise self.fail(f"{shown(base.type)} has no field {name}")

    def flatten(self, given: list[Value]) -> Value:
        if not given or kind_of(given[0].type) not in ("list", "dyn") or len(given) > 2 or len(given) == 2 and not isinstance(given[1].literal, int):
            raise self.fail("flatten takes a list and a literal number of levels")
        levels = given[1].literal if len(given) == 2 else 1
        if levels < 0:
            raise self.fail("flatten: below 0 levels")
        c, t = given[0].column, given[0].type
        if t == "dyn":
            for _ in range(levels):
                c = F.flatten(c)
            return Value(c)
        while levels and kind_of(t[1]) == "list":
            c, t, levels = F.flatten(c), t[1], levels - 1
        return Value(c, t)

    def format(self, args: tuple[Node, ...], given: list[Value]) -> Value:
        """Places %s %d %f %e %b %o %x %X, with a precision for %f and %e; %% is a percent sign."""
        if len(args) != 2 or not isinstance(given[0].literal, str) or args[1].kind != "list":
            raise self.fail("format takes a literal text and a list")
        values = [self.value(a) for a in args[1].args]
        out, at, last = [], 0, 0
        text = given[0].literal
        for m in re.finditer(r"%(?:%|(\.\d+)?([a-zA-Z])|.?)", text):
            out.append(F.lit(text[last : m.start()]))
            last = m.end()
            if m[0] == "%%":
                out.append(F.lit("%"))
                continue
            if not m[2] or m[2] not in "sdfeboxX" or at >= len(values):
                raise self.fail(f"format: {m[0]!r}")
            out.append(self.formatted(values[at], m[2], m[1] or ".6"))
            at += 1
        if at < len(values):
            raise self.fail("format: more values than places")
        return Value(F.concat(*out, F.lit(text[last:])), "string")

    def formatted(self, v: Value, verb: str, precision: str) -> Column:
        t = kind_of(v.type)
        if verb == "s":
            return self.text_of(v)
        if t in ("int", "uint", "dyn") and verb in "dboxX":
            if verb == "d":
                return v.column.cast("string")
            base = {"b": 2, "o": 8, "x": 16, "X": 16}[verb]
            digits = F.conv(F.abs(v.column).cast("string"), 10, base)
            return F.concat(F.when(v.column < 0, "-").otherwise(""), digits if verb == "X" else F.lower(digits))
        if t == "bool" and verb == "b":
            return v.column.cast("int").cast("string")
        if t == "double" and verb == "d":
            return double_text(v.column)
        if t in ("string", "bytes") and verb in "xX":
            return F.hex(v.column.cast("binary")) if verb == "X" else F.lower(F.hex(v.column.cast("binary")))
        if t in (*NUMBERS, "dyn") and verb in "fe":
            return F.when(v.column.isNotNull(), F.format_string(f"%{precision}{verb}", v.column.cast("double")))
        raise self.fail(f"format: %{verb} of {shown(v.type)}")

    def text_of(self, v: Value) -> Column:
        t = kind_of(v.type)
        if t == "list":
            inner = v.type[1]
            return F.concat(F.lit("["), F.array_join(F.transform(v.column, lambda x: self.text_of(Value(x, inner))), ", "), F.lit("]"))
        if t == "map":
            show = lambda e: F.concat(self.text_of(Value(e["key"], v.type[1])), F.lit(": "), self.text_of(Value(e["value"], v.type[2])))
            return F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(F.map_entries(v.column), show)), ", "), F.lit("}"))
        if t == "null":
            return F.lit("null")
        return v.column.cast("string") if t in ("dyn", "struct") else self.call("string", [v]).column

    def macro(self, node: Node) -> Value:
        base, name, *bodies = node.args
        of = self.value(base)
        if kind_of(of.type) == "map":
            of = Value(F.map_keys(of.column), ("list", of.type[1]))
        if kind_of(of.type) not in ("list", "dyn"):
            raise self.fail(f"{node.value} over {shown(of.type)}")
        member = of.type[1] if kind_of(of.type) == "list" else "dyn"
        types: list[Type] = []

        def body(i: int) -> Callable[[Column], Column]:
            def run(x: Column) -> Column:
                v = Compiler({**self.variables, name.value: Value(x, member)}, self.probe, self.registry, self.schema).value(bodies[i])
                types.append(v.type)
                return v.column

            return run

        def test(i: int) -> Callable[[Column], Column]:
            inner = body(i)

            def run(x: Column) -> Column:
                c = inner(x)
                if not fits("bool", types[-1]):
                    raise self.fail(f"{node.value} needs a bool, not {shown(types[-1])}")
                return c

            return run

        c = of.column
        sure = lambda i, out: F.when(~has_nulls(F.transform(c, test(i))), out)  # noqa: E731 - an error in one member is one of the whole
        if node.value == "all":
            return Value(F.forall(c, test(0)), "bool")
        if node.value == "exists":
            return Value(F.exists(c, test(0)), "bool")
        if node.value == "exists_one":
            return Value(sure(0, F.size(F.filter(c, test(0))) == 1), "bool")
        if node.value == "filter":
            return Value(sure(0, F.filter(c, test(0))), of.type)
        if node.value == "sortBy":
            return Value(F.transform(F.array_sort(F.transform(c, lambda x: F.struct(body(0)(x).alias("k"), x.alias("v")))), lambda p: p["v"]), of.type)
        out = F.transform(c, body(0)) if len(bodies) == 1 else F.transform(F.filter(c, test(0)), body(1))
        return Value(F.when(~has_nulls(out), out), ("list", types[-1]))


def literal(value: Any) -> Value:
    if value is None:
        return Value(F.lit(None), "null", None)
    if isinstance(value, Unsigned):
        return Value(F.lit(str(int(value))).cast("decimal(20,0)"), "uint", value)
    if type(value) is int:
        return Value(F.lit(value).cast("bigint"), "int", value)
    return Value(F.lit(value), {bool: "bool", float: "double", str: "string", bytes: "bytes"}[type(value)], value)
