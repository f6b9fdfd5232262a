"""Queries over JSON documents in the language of jq: a parser to closures. A program maps a document to a stream of results; plain Python, run over Arrow batches."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

Env = dict[str, Any]
Filter = Callable[[Any, Env], Iterator[Any]]

TOKENS = re.compile(r'\s+|\#[^\n]*|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:\\.|[^"\\])*")|(?P<var>\$[A-Za-z_]\w*)|(?P<field>\.[A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<op>\.\.|//|==|!=|<=|>=|[.|,()\[\]{}:;+\-*/%<>?])')
ORDER = {type(None): 0, bool: 1, int: 3, float: 3, str: 4, list: 5, dict: 6}
RANKS = [("//",), ("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]


class JqError(Exception):
    """A query that doesn't parse, or fails on a document."""


def show(value: Any) -> str:
    """A result as text: texts as they are, all else as JSON; whole numbers without a fraction."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e17:
        value = int(value)
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def rank(v: Any) -> tuple:
    """The order of values: null, false, true, numbers, texts, lists, objects."""
    if isinstance(v, bool):
        return 1 + v, 0
    if isinstance(v, list):
        return ORDER[list], [rank(x) for x in v]
    if isinstance(v, dict):
        keys = sorted(v)
        return ORDER[dict], keys, [rank(v[k]) for k in keys]
    return ORDER[type(v)], 0 if v is None else v


def true(v: Any) -> bool:
    return v is not None and v is not False


def kind(v: Any) -> str:
    return {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def at(v: Any, key: Any) -> Any:
    if v is None and (key is None or isinstance(key, str) or number(key)):
        return None
    if isinstance(v, dict) and isinstance(key, str):
        return v.get(key)
    if isinstance(v, list) and number(key):
        k = math.floor(key)
        return v[k] if -len(v) <= k < len(v) else None
    raise JqError(f"cannot index {kind(v)} with {kind(key)}")


def members(v: Any) -> list:
    if isinstance(v, list):
        return v
    if isinstance(v, dict):
        return [v[k] for k in sorted(v)]
    raise JqError(f"cannot iterate over {kind(v)}")


def calculate(op: str, a: Any, b: Any) -> Any:
    if op == "+":
        if a is None or b is None:
            return b if a is None else a
        if number(a) and number(b) or type(a) is type(b) and isinstance(a, (str, list)):
            return a + b
        if isinstance(a, dict) and isinstance(b, dict):
            return a | b
    elif op == "-":
        if number(a) and number(b):
            return a - b
        if isinstance(a, list) and isinstance(b, list):
            return [x for x in a if not any(rank(x) == rank(y) for y in b)]
    elif op == "*":
        if number(a) and number(b):
            return a * b
        if isinstance(a, str) and number(b):
            return a * int(b) if b > 0 else None
        if isinstance(a, dict) and isinstance(b, dict):
            return a | {k: calculate("*", a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}
    elif op == "/":
        if number(a) and number(b) and b:
            return a // b if isinstance(a, int) and isinstance(b, int) and a % b == 0 else a / b
        if isinstance(a, str) and isinstance(b, str):
            return a.split(b) if b else list(a)
    elif op == "%" and number(a) and number(b) and int(b):
        return int(math.fmod(int(a), int(b)))
    raise JqError(f"{kind(a)} {op} {kind(b)}")


def contains(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(contains(x, y) for x in a) for y in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if kind(a) != kind(b):
        raise JqError(f"{kind(a)} contains {kind(b)}")
    return rank(a) == rank(b)


def need(v: Any, *kinds: str) -> Any:
    if kind(v) not in kinds:
        raise JqError(f"{kind(v)} is no {' or '.join(kinds)}")
    return v


def length(v: Any) -> Any:
    return 0 if v is None else abs(v) if number(v) else len(need(v, "string", "array", "object"))


def has(v: Any, k: Any) -> bool:
    return k in v if isinstance(v, dict) else 0 <= k < len(need(v, "array"))


def added(values: list) -> Any:
    out = None
    for v in values:
        out = calculate("+", out, v)
    return out


def to_number(v: Any) -> Any:
    if number(v):
        return v
    try:
        return json.loads(need(v, "string"), parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError):
        raise JqError(f"no number: {v!r}") from None


def unique(values: list, key: Callable[[Any], Any] = rank) -> list:
    out: list = []
    for v in sorted(values, key=key):
        if not out or key(out[-1]) != key(v):
            out.append(v)
    return out


def flat(v: list, depth: float = math.inf) -> list:
    return [y for x in v for y in (flat(x, depth - 1) if isinstance(x, list) and depth > 0 else [x])]


def deep(v: Any) -> Iterator[Any]:
    yield v
    if isinstance(v, (list, dict)):
        for x in members(v):
            yield from deep(x)


def entry(e: dict) -> tuple[str, Any]:
    key = next((e[k] for k in ("key", "k", "name", "Name", "Key", "K") if e.get(k) is not None), None)
    return key if isinstance(key, str) else show(key), next((e[k] for k in ("value", "v", "Value", "V") if k in e), None)


#: Functions of the input and of argument values.
PLAIN: dict[tuple[str, int], Callable[..., Any]] = {
    ("length", 0): length, ("not", 0): lambda v: not true(v), ("type", 0): kind, ("tostring", 0): show, ("tojson", 0): lambda v: json.dumps(v, separators=(",", ":")), ("fromjson", 0): lambda v: json.loads(need(v, "string")), ("tonumber", 0): to_number,
    ("keys", 0): lambda v: sorted(v) if isinstance(v, dict) else list(range(len(need(v, "array")))), ("add", 0): lambda v: added(members(v)), ("any", 0): lambda v: any(map(true, members(v))), ("all", 0): lambda v: all(map(true, members(v))), ("reverse", 0): lambda v: need(v, "array", "string")[::-1],
    ("sort", 0): lambda v: sorted(need(v, "array"), key=rank), ("unique", 0): lambda v: unique(need(v, "array")), ("min", 0): lambda v: min(need(v, "array"), key=rank, default=None), ("max", 0): lambda v: max(need(v, "array"), key=rank, default=None), ("first", 0): lambda v: at(v, 0), ("last", 0): lambda v: at(v, -1),
    ("floor", 0): lambda v: math.floor(need(v, "number")), ("ceil", 0): lambda v: math.ceil(need(v, "number")), ("sqrt", 0): lambda v: math.sqrt(need(v, "number")), ("abs", 0): lambda v: abs(need(v, "number")), ("flatten", 0): lambda v: flat(need(v, "array")), ("flatten", 1): lambda v, n: flat(need(v, "array"), n),
    ("ascii_downcase", 0): lambda v: "".join(c.lower() if c.isascii() else c for c in need(v, "string")), ("ascii_upcase", 0): lambda v: "".join(c.upper() if c.isascii() else c for c in need(v, "string")), ("explode", 0): lambda v: list(map(ord, need(v, "string"))), ("implode", 0): lambda v: "".join(map(chr, need(v, "array"))),
    ("to_entries", 0): lambda v: [{"key": k, "value": need(v, "object")[k]} for k in sorted(v)], ("from_entries", 0): lambda v: dict(map(entry, need(v, "array"))), ("trim", 0): lambda v: need(v, "string").strip(), ("ltrim", 0): lambda v: need(v, "string").lstrip(), ("rtrim", 0): lambda v: need(v, "string").rstrip(),
    ("has", 1): has, ("contains", 1): contains, ("inside", 1): lambda v, b: contains(b, v), ("startswith", 1): lambda v, s: need(v, "string").startswith(need(s, "string")), ("endswith", 1): lambda v, s: need(v, "string").endswith(need(s, "string")), ("ltrimstr", 1): lambda v, s: v.removeprefix(s) if isinstance(v, str) and isinstance(s, str) else v,
    ("rtrimstr", 1): lambda v, s: v.removesuffix(s) if isinstance(v, str) and isinstance(s, str) else v, ("split", 1): lambda v, s: calculate("/", need(v, "string"), need(s, "string")), ("join", 1): lambda v, s: s.join("" if x is None else show(x) for x in need(v, "array")), ("test", 1): lambda v, p: re.search(p, need(v, "string")) is not None,
    ("sub", 2): lambda v, p, r: re.sub(p, lambda m: r, need(v, "string"), count=1), ("gsub", 2): lambda v, p, r: re.sub(p, lambda m: r, need(v, "string")), ("index", 1): lambda v, s: (need(v, "string").find(s) if s in v else None), ("tojson", 0): lambda v: json.dumps(v, separators=(",", ":")),
}


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        place = 0
        while place < len(text):
            m = TOKENS.match(text, place)
            if not m:
                raise JqError(f"unexpected {text[place]!r}")
            place = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.tokens.append(("end", ""))
        self.k = 0

    def accept(self, text: str) -> bool:
        if self.tokens[self.k][0] in ("op", "name") and self.tokens[self.k][1] == text:
            self.k += 1
            return True
        return False

    def take(self, text: str) -> None:
        if not self.accept(text):
            raise JqError(f"expected {text!r}, found {self.tokens[self.k][1]!r}")

    def parse(self) -> Filter:
        out = self.pipe()
        if self.tokens[self.k][0] != "end":
            raise JqError(f"unexpected {self.tokens[self.k][1]!r}")
        return out

    def pipe(self) -> Filter:
        left = self.comma()
        if self.accept("as"):
            name = self.variable()
            self.take("|")
            body = self.pipe()
            return lambda v, e: (y for x in left(v, e) for y in body(v, e | {name: x}))
        if self.accept("|"):
            right = self.pipe()
            return lambda v, e: (y for x in left(v, e) for y in right(x, e))
        return left

    def comma(self) -> Filter:
        parts = [self.binary(0)]
        while self.accept(","):
            parts.append(self.binary(0))
        return parts[0] if len(parts) == 1 else lambda v, e: (y for p in parts for y in p(v, e))

    def binary(self, level: int) -> Filter:
        if level == len(RANKS):
            return self.postfix()
        left = self.binary(level + 1)
        while self.tokens[self.k][0] in ("op", "name") and self.tokens[self.k][1] in RANKS[level]:
            op = self.tokens[self.k][1]
            self.k += 1
            left = joined(op, left, self.binary(level if op == "//" else level + 1))
        return left

    def variable(self) -> str:
        group, text = self.tokens[self.k]
        if group != "var":
            raise JqError(f"expected a variable, found {text!r}")
        self.k += 1
        return text

    def postfix(self) -> Filter:
        out = self.primary()
        while True:
            group, text = self.tokens[self.k]
            if group == "field":
                self.k += 1
                out = indexed(out, constant(text[1:]))
            elif self.accept("."):
                if self.tokens[self.k][0] == "str":
                    out = indexed(out, self.primary())
                elif self.tokens[self.k][1] != "[":
                    raise JqError("a name must follow the dot")
            elif self.accept("["):
                out = self.bracket(out)
            elif self.accept("?"):
                out = quiet(out)
            else:
                return out

    def bracket(self, of: Filter) -> Filter:
        if self.accept("]"):
            return lambda v, e: (y for x in of(v, e) for y in members(x))
        low = None if self.tokens[self.k][1] == ":" else self.pipe()
        if self.accept(":"):
            high = None if self.tokens[self.k][1] == "]" else self.pipe()
            self.take("]")
            one = lambda f, v, e: None if f is None else next(iter(f(v, e)), None)
            return lambda v, e: (None if x is None else need(x, "array", "string")[one(low, v, e) : one(high, v, e)] for x in of(v, e))
        self.take("]")
        return indexed(of, low)

    def primary(self) -> Filter:
        group, text = self.tokens[self.k]
        self.k += 1
        if group == "num":
            return constant(float(text) if re.search("[.eE]", text) else int(text))
        if group == "str":
            return constant(json.loads(text))
        if group == "field":
            return indexed(same, constant(text[1:]))
        if group == "var":
            return lambda v, e: iter([variable_of(e, text)])
        if text == "..":
            return lambda v, e: deep(v)
        if text == ".":
            return indexed(same, self.primary()) if self.tokens[self.k][0] == "str" else same
        if text == "-":
            inner = self.postfix()
            return lambda v, e: (calculate("-", 0, x) for x in inner(v, e))
        if text == "(":
            out = self.pipe()
            self.take(")")
            return out
        if text == "[":
            if self.accept("]"):
                return lambda v, e: iter([[]])
            inner = self.pipe()
            self.take("]")
            return lambda v, e: iter([list(inner(v, e))])
        if text == "{":
            return self.object()
        if group == "name":
            return self.named(text)
        raise JqError(f"unexpected {text!r}")

    def object(self) -> Filter:
        fields: list[tuple[Filter, Filter]] = []
        while not self.accept("}"):
            if fields:
                self.take(",")
            group, text = self.tokens[self.k]
            if group == "var":
                self.k += 1
                key, default = constant(text[1:]), lambda v, e, text=text: iter([variable_of(e, text)])
            elif self.accept("("):
                key, default = self.pipe(), None
                self.take(")")
            elif group in ("name", "str"):
                self.k += 1
                name = json.loads(text) if group == "str" else text
                key, default = constant(name), indexed(same, constant(name))
            else:
                raise JqError(f"unexpected {text!r}")
            if self.accept(":"):
                value = self.binary(0)
            elif default is None:
                raise JqError("a value must follow")
            else:
                value = default
            fields.append((key, value))

        def build(v: Any, e: Env, k: int = 0) -> Iterator[dict]:
            if k == len(fields):
                yield {}
                return
            for name in fields[k][0](v, e):
                for x in fields[k][1](v, e):
                    for rest in build(v, e, k + 1):
                        yield {need(name, "string"): x} | rest

        return build

    def named(self, name: str) -> Filter:
        if name in ("null", "true", "false"):
            return constant({"null": None, "true": True, "false": False}[name])
        if name == "if":
            return self.choice()
        if name == "reduce":
            of = self.postfix()
            self.take("as")
            variable = self.variable()
            self.take("(")
            start = self.pipe()
            self.take(";")
            step = self.pipe()
            self.take(")")

            def fold(v: Any, e: Env) -> Iterator[Any]:
                for out in start(v, e):
                    for x in of(v, e):
                        out = last(step(out, e | {variable: x}))
                    yield out

            return fold
        if name == "try":
            body = self.postfix()
            handler = self.postfix() if self.accept("catch") else None
            return quiet(body, handler)
        args: list[Filter] = []
        if self.accept("("):
            args.append(self.pipe())
            while self.accept(";"):
                args.append(self.pipe())
            self.take(")")
        return function(name, args)

    def choice(self) -> Filter:
        cond = self.pipe()
        self.take("then")
        yes = self.pipe()
        no: Filter = same
        if self.accept("elif"):
            no = self.choice()
        else:
            if self.accept("else"):
                no = self.pipe()
            self.take("end")
        return lambda v, e: (y for c in cond(v, e) for y in (yes if true(c) else no)(v, e))


def same(v: Any, e: Env) -> Iterator[Any]:
    yield v


def constant(value: Any) -> Filter:
    return lambda v, e: iter([value])


def indexed(of: Filter, key: Filter) -> Filter:
    return lambda v, e: (at(x, k) for x in of(v, e) for k in key(v, e))


def variable_of(e: Env, name: str) -> Any:
    if name not in e:
        raise JqError(f"unknown variable {name}")
    return e[name]


def last(values: Iterator[Any]) -> Any:
    out = None
    for out in values:
        pass
    return out


def quiet(of: Filter, handler: Filter | None = None) -> Filter:
    def run(v: Any, e: Env) -> Iterator[Any]:
        try:
            yield from of(v, e)
        except JqError as error:
            if handler:
                yield from handler(str(error), e)

    return run


def joined(op: str, left: Filter, right: Filter) -> Filter:
    if op == "//":

        def otherwise(v: Any, e: Env) -> Iterator[Any]:
            good = [x for x in quiet(left)(v, e) if true(x)]
            yield from good or right(v, e)

        return otherwise
    if op in ("and", "or"):
        return lambda v, e: (x for a in left(v, e) for x in ([op == "or"] if true(a) is (op == "or") else (true(b) for b in right(v, e))))
    compare = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if op in compare:
        return lambda v, e: (compare[op](rank(a), rank(b)) for b in right(v, e) for a in left(v, e))
    return lambda v, e: (calculate(op, a, b) for b in right(v, e) for a in left(v, e))


def function(name: str, args: list[Filter]) -> Filter:
    f = args[0] if args else same
    by = lambda x, e: [rank(k) for k in f(x, e)]
    special: dict[tuple[str, int], Filter] = {
        ("empty", 0): lambda v, e: iter(()),
        ("select", 1): lambda v, e: (v for c in f(v, e) if true(c)),
        ("map", 1): lambda v, e: iter([[y for x in members(v) for y in f(x, e)]]),
        ("map_values", 1): lambda v, e: iter([{k: y for k, x in v.items() for y in list(f(x, e))[:1]} if isinstance(v, dict) else [y for x in need(v, "array") for y in list(f(x, e))[:1]]]),
        ("values", 0): lambda v, e: iter([v] if v is not None else ()),
        ("nulls", 0): lambda v, e: iter([v] if v is None else ()),
        ("strings", 0): lambda v, e: iter([v] if isinstance(v, str) else ()),
        ("numbers", 0): lambda v, e: iter([v] if number(v) else ()),
        ("arrays", 0): lambda v, e: iter([v] if isinstance(v, list) else ()),
        ("objects", 0): lambda v, e: iter([v] if isinstance(v, dict) else ()),
        ("recurse", 0): lambda v, e: deep(v),
        ("first", 1): lambda v, e: iter([x for x, _ in zip(f(v, e), range(1))]),
        ("last", 1): lambda v, e: iter(list(f(v, e))[-1:]),
        ("any", 1): lambda v, e: iter([any(true(y) for x in members(v) for y in f(x, e))]),
        ("all", 1): lambda v, e: iter([all(true(y) for x in members(v) for y in f(x, e))]),
        ("sort_by", 1): lambda v, e: iter([sorted(need(v, "array"), key=lambda x: by(x, e))]),
        ("unique_by", 1): lambda v, e: iter([unique(need(v, "array"), lambda x: by(x, e))]),
        ("group_by", 1): lambda v, e: iter([[[x for x in v if by(x, e) == by(u, e)] for u in unique(need(v, "array"), lambda x: by(x, e))]]),
        ("min_by", 1): lambda v, e: iter([min(need(v, "array"), key=lambda x: by(x, e), default=None)]),
        ("max_by", 1): lambda v, e: iter([max(need(v, "array"), key=lambda x: by(x, e), default=None)]),
        ("with_entries", 1): lambda v, e: iter([dict(entry(y) for k in sorted(need(v, "object")) for y in f({"key": k, "value": v[k]}, e))]),
        ("range", 1): lambda v, e: (i for n in f(v, e) for i in range(math.ceil(n))),
        ("error", 0): failing,
        ("error", 1): lambda v, e: (x for m in f(v, e) for x in failing(m, e)),
    }
    own = special.get((name, len(args)))
    if own:
        return own
    plain = PLAIN.get((name, len(args)))
    if plain is None:
        raise JqError(f"{name}/{len(args)} is not known")

    def run(v: Any, e: Env) -> Iterator[Any]:
        for values in every(args, v, e):
            try:
                yield plain(v, *values)
            except (TypeError, ValueError, AttributeError, re.error) as error:
                raise JqError(f"{name}: {error}") from None

    return run


def failing(v: Any, e: Env) -> Iterator[Any]:
    raise JqError(show(v))
    yield


def every(args: list[Filter], v: Any, e: Env) -> Iterator[list]:
    if not args:
        yield []
        return
    for rest in every(args[1:], v, e):
        for x in args[0](v, e):
            yield [x, *rest]


@lru_cache(maxsize=256)
def compile_program(text: str) -> Callable[[Any], Iterator[Any]]:
    program = Parser(text).parse()
    return lambda document: program(document, {})
