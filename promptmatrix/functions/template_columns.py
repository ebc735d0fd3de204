"""Templates as column expressions over VARIANT.

``compile`` turns a parsed template into one string expression: lookups become
variant paths, conditions CASE, loops a transform over the elements joined
again.  The expression gives a text only where that text is surely what
``template.render`` gives, and null everywhere else: where a name is not
defined, where a list or a mapping would be printed whole, where a number has
more digits than both sides print alike, where letters outside ASCII change
case.  Those rows, and they alone, go to ``template.render``, which gives the
text or the error.  A template that uses what has no expression at all (a key
that is not constant, rounding, an attribute of a loop other than its counters)
compiles to None.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptmatrix.functions import template
from promptmatrix.functions.text import strip

#: A name in scope: the value under a path of constant keys, as VARIANT (null: not there, or not to be had here).
Lookup = Callable[[tuple[str | int, ...]], Column]
_DIGITS = 15  # decimal numbers of so many digits are told apart by a double, and printed as they were written
_KEY = re.compile(r"[^'\"\\\[\]]+")


class NoExpression(Exception):
    """The template needs more than expressions."""


def of_variant(root: Column) -> Lookup:
    """The variables of a parsed JSON object."""
    return lambda path: F.try_variant_get(root, _path(path), "variant")


def of_columns(columns: dict[str, Column]) -> Lookup:
    """Variables that are columns; null is not defined."""

    def look(path: tuple[str | int, ...]) -> Column:
        if path[0] not in columns:
            return F.lit(None).cast("variant")
        value = columns[path[0]].cast("variant")
        return value if len(path) == 1 else F.try_variant_get(value, _path(path[1:]), "variant")

    return look


def of_value(value: Column) -> Lookup:
    return lambda path: value if len(path) == 1 else F.try_variant_get(value, _path(path[1:]), "variant")


def _path(keys: tuple[str | int, ...]) -> str:
    out = "$"
    for k in keys:
        if isinstance(k, bool) or (isinstance(k, int) and k < 0) or not isinstance(k, (int, str)) or (isinstance(k, str) and not _KEY.fullmatch(k)):
            raise NoExpression(f"key {k!r}")
        out += f"[{k}]" if isinstance(k, int) else f"['{k}']"
    return out


def _once(work: Callable[..., Column]) -> Callable[..., Column]:
    """``work`` over columns that it reads many times: each is worked out once, as the variable of a lambda, and stands in the plan once."""

    def bound(*values: Column) -> Column:
        def rest(known: tuple[Column, ...], left: tuple[Column, ...]) -> Column:
            return F.get(F.transform(F.array(left[0]), lambda v: rest((*known, v), left[1:])), F.lit(0)) if left else work(*known)

        return rest((), values)

    return bound


def _get(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _is(value: Column, *kinds: str) -> Column:
    said = F.schema_of_variant(value)
    tests = [said == k if k in ("STRING", "BIGINT", "BOOLEAN", "VOID", "DOUBLE") else said.startswith(k) for k in kinds]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


@_once
def _number(value: Column) -> Column:
    """A number that a double holds exactly, or with the digits it was written with; else null."""
    whole = _get(value, "bigint")
    return F.when(_is(value, "BIGINT") & (F.abs(whole) < 1 << 53), whole.cast("double")).when(_is(value, "DECIMAL", "DOUBLE"), _get(value, "double"))


@_once
def _printed(number: Column) -> Column:
    """A double as both sides print it, or null."""
    said = number.cast("string")
    return F.when(said.rlike(r"^-?\d+\.\d+$") & (F.length(F.regexp_replace(said, r"^-?0*\.?0*|\.0$|[-.]", "")) <= _DIGITS) & (F.abs(number) < 1e15) & (F.abs(number) >= 1e-3), said).when(said == "0.0", said)


@_once
def _fraction(value: Column) -> Column:
    """A number written with a point: without the zeros at its end; null for zero, whose sign is lost, and for many digits."""
    said = _get(value, "decimal(38,18)").cast("string")
    cut = F.regexp_replace(said, r"(?<=\.\d)0+$|(?<=\.\d{2})0+$|0+$", "")
    full = F.when(cut.endswith("."), F.concat(cut, F.lit("0"))).otherwise(cut)
    point = F.schema_of_variant(value).rlike(r",([1-9]|1[0-7])\)$")
    digits = F.length(F.regexp_replace(full, r"^-?0*\.?0*|[-.]", ""))
    return F.when(point & (digits <= _DIGITS) & (digits > 0) & (F.abs(_get(value, "double")) >= 1e-3), full)


@_once
def _text(value: Column) -> Column:
    """What str() gives, or null."""
    return (
        F.when(_is(value, "STRING"), _get(value, "string"))
        .when(_is(value, "BIGINT"), _get(value, "bigint").cast("string"))
        .when(_is(value, "BOOLEAN"), F.when(_get(value, "boolean"), "True").otherwise("False"))
        .when(_is(value, "VOID"), "None")
        .when(_is(value, "DECIMAL"), _fraction(value))
        .when(_is(value, "DOUBLE"), F.when(_get(value, "double") != 0, _printed(_get(value, "double"))))
    )


@_once
def _elements(value: Column) -> Column:
    return F.when(_is(value, "ARRAY"), _get(value, "array<variant>"))


@_once
def _truth(value: Column) -> Column:
    return (
        F.when(_is(value, "BOOLEAN"), _get(value, "boolean"))
        .when(_is(value, "STRING"), _get(value, "string") != "")
        .when(_is(value, "VOID"), F.lit(False))
        .when(_is(value, "ARRAY"), F.size(_elements(value)) > 0)
        .when(_is(value, "OBJECT"), F.to_json(value) != "{}")
        .when(_is(value, "BIGINT", "DECIMAL", "DOUBLE"), _get(value, "double") != 0)
    )


@_once
def _equal(a: Column, b: Column) -> Column:
    scalars = ("STRING", "BIGINT", "DECIMAL", "DOUBLE", "VOID", "BOOLEAN")
    numbers = ("BIGINT", "DECIMAL", "DOUBLE")
    both = lambda *kinds: _is(a, *kinds) & _is(b, *kinds)
    return (
        F.when(both("STRING"), _get(a, "string") == _get(b, "string"))
        .when(both("BOOLEAN"), _get(a, "boolean") == _get(b, "boolean"))
        .when(both(*numbers), _number(a) == _number(b))
        .when(both("BOOLEAN", *numbers), F.lit(None).cast("boolean"))
        .when(both(*scalars), both("VOID"))
    )


def _ordered(sign: str, a: Column, b: Column) -> Column:
    compare: Callable[[Column, Column], Column] = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[sign]
    return _once(lambda a, b: F.when(_is(a, "STRING") & _is(b, "STRING"), compare(_get(a, "string"), _get(b, "string"))).otherwise(compare(_number(a), _number(b))))(a, b)


@_once
def _within(a: Column, b: Column) -> Column:
    return F.when(_is(a, "STRING") & _is(b, "STRING"), F.contains(_get(b, "string"), _get(a, "string"))).when(a.isNotNull() & _is(b, "ARRAY"), F.exists(_elements(b), lambda x: _equal(a, x)))


def _sum(sign: str, a: Column, b: Column) -> Column:
    """Arithmetic as VARIANT: whole numbers stay whole, a quotient is a fraction; null where the result is not sure."""

    def work(a: Column, b: Column, m: Column, n: Column) -> Column:
        x, y = _get(a, "bigint"), _get(b, "bigint")
        whole = _is(a, "BIGINT") & _is(b, "BIGINT")
        if sign == "/":
            return F.when(n != 0, F.try_divide(m, n)).cast("variant")
        if sign in ("//", "%"):
            positive = whole & (x >= 0) & (y > 0)
            return F.when(positive, (F.try_subtract(x, F.try_mod(x, y)) / y).cast("bigint") if sign == "//" else F.try_mod(x, y)).cast("variant")
        exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign]
        near = {"+": m + n, "-": m - n, "*": m * n}[sign]
        out = F.when(whole, exact(x, y).cast("variant")).otherwise(near.cast("variant"))
        return F.when(_is(a, "STRING") & _is(b, "STRING"), F.concat(_get(a, "string"), _get(b, "string")).cast("variant")).otherwise(out) if sign == "+" else out

    return _once(lambda a, b: _once(work)(a, b, _number(a), _number(b)))(a, b)


@_once
def _ascii(text: Column) -> Column:
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text)


@_once
def _quoted(value: Column) -> Column:
    """JSON of a scalar whose text needs no escapes, or null."""
    said = _get(value, "string")
    return F.when(_is(value, "STRING"), F.when(said.rlike(r'^[ !#-\[\]-~]*$'), F.concat(F.lit('"'), said, F.lit('"')))).when(_is(value, "VOID"), "null").when(_is(value, "BOOLEAN"), said).when(_is(value, "BIGINT", "DECIMAL", "DOUBLE"), _text(value))


def _listed(items: Column, one: Callable[[Column], Column], by: Column) -> Column:
    """Texts of the elements, joined; null if any of them is."""
    joined = lambda texts: F.aggregate(texts, F.lit(None).cast("string"), lambda s, t: F.when(s.isNull(), t).otherwise(F.concat(s, by, t)), lambda s: F.coalesce(s, F.lit("")))
    return _whole(F.transform(items, lambda x: one(x)), joined)  # noqa: PLW0108


def _whole(texts: Column, joined: Callable[[Column], Column]) -> Column:
    """The texts joined, if none of them is null."""
    return _once(lambda t: F.when(F.forall(t, lambda x: x.isNotNull()), joined(t)))(texts)


class Compiler:
    def __init__(self, scope: Callable[[str], Lookup]):
        self.root = scope

    def text(self, nodes: tuple, scope: dict[str, Lookup]) -> Column:
        parts = [self.part(n, scope) for n in nodes]
        return F.concat(*parts) if parts else F.lit("")

    def part(self, node: tuple, scope: dict[str, Lookup]) -> Column:
        kind = node[0]
        if kind == "text":
            return F.lit(node[1])
        if kind == "put":
            return _text(self.value(node[1], scope))
        if kind == "if":
            out: Column = F.lit("")
            for test, body in reversed(node[1]):
                out = self.choice(self.truth(test, scope), self.text(body, scope), out)
            return out
        return _once(lambda items, size: self.loop(node, scope, items, size))(items := _elements(self.value(node[2], scope)), F.size(items))

    def loop(self, node: tuple, scope: dict[str, Lookup], items: Column, size: Column) -> Column:
        def body(item: Column, i: Column) -> Column:
            counters = {"index": i + 1, "index0": i, "first": i == 0, "last": i == size - 1, "length": size}

            def loop(path: tuple[str | int, ...]) -> Column:
                if len(path) != 2 or path[1] not in counters:
                    raise NoExpression("loop")
                value = counters[path[1]]
                return (value if path[1] in ("first", "last") else value.cast("bigint")).cast("variant")

            return self.text(node[3], {**scope, node[1]: of_value(item), "loop": loop})

        return _whole(F.transform(items, body), lambda texts: F.array_join(texts, ""))

    def value(self, node: tuple, scope: dict[str, Lookup]) -> Column:
        """The value as VARIANT; null where it is missing or not sure."""
        kind = node[0]
        if kind == "value":
            v = node[1]
            if isinstance(v, float):
                raise NoExpression("a fraction")  # its printed form is not that of a number in JSON
            return F.parse_json(F.lit(json.dumps(v)))
        if kind in ("name", "get"):
            path = self.path(node)
            if path is None:
                raise NoExpression("a key that is not constant, or of a result")
            name = path[0]
            return scope[name](path) if name in scope else self.root(name)(path)
        if kind == "filter":
            return self.filtered(node, scope)
        if kind in ("not", "is") or node[1] in ("==", "!=", "<", "<=", ">", ">=", "in"):
            return self.truth(node, scope).cast("variant")
        if kind == "op" and node[1] in ("and", "or"):
            both = (lambda left, right: self.choice(_truth(left), right, left)) if node[1] == "and" else (lambda left, right: self.choice(_truth(left), left, right))
            return _once(both)(self.value(node[2], scope), self.value(node[3], scope))
        if kind == "op" and node[1] == "~":
            return F.concat(_text(self.value(node[2], scope)), _text(self.value(node[3], scope))).cast("variant")
        if kind == "op":
            return _sum(node[1], self.value(node[2], scope), self.value(node[3], scope))
        raise NoExpression(kind)

    @staticmethod
    def choice(holds: Column, yes: Column, no: Column) -> Column:
        """One of two by a condition that is true, false or not sure."""
        return _once(lambda h: F.when(h, yes).when(~h, no))(holds)

    @staticmethod
    def path(node: tuple) -> tuple[str | int, ...] | None:
        keys: list[str | int] = []
        while node[0] == "get":
            if node[2][0] != "value":
                return None
            keys.append(node[2][1])
            node = node[1]
        return (node[1], *reversed(keys)) if node[0] == "name" else None

    def defined(self, node: tuple, scope: dict[str, Lookup]) -> Column:
        """Whether a name or lookup is there; null if it is a place of a text."""
        found = self.value(node, scope).isNotNull()
        if node[0] == "get" and isinstance(node[2][1], int):
            return F.when(_is(self.value(node[1], scope), "STRING"), F.lit(None).cast("boolean")).otherwise(found)
        return found

    def truth(self, node: tuple, scope: dict[str, Lookup]) -> Column:
        kind = node[0]
        if kind == "value":
            return F.lit(bool(node[1]))
        if kind == "not":
            return ~self.truth(node[1], scope)
        if kind == "is":
            if node[1][0] not in ("name", "get"):
                raise NoExpression("a test of a result")
            found = self.defined(node[1], scope)
            return found if node[2] == "defined" else self.choice(found, _is(self.value(node[1], scope), "VOID"), F.lit(False))
        if kind == "op" and node[1] in ("and", "or"):
            a, b = self.truth(node[2], scope), self.truth(node[3], scope)
            return self.choice(a, b, F.lit(False)) if node[1] == "and" else self.choice(a, F.lit(True), b)
        if kind == "op" and node[1] in ("==", "!=", "<", "<=", ">", ">=", "in"):
            a, b = self.value(node[2], scope), self.value(node[3], scope)
            if node[1] == "in":
                return _within(a, b)
            return _equal(a, b) if node[1] == "==" else ~_equal(a, b) if node[1] == "!=" else _ordered(node[1], a, b)
        return _truth(self.value(node, scope))

    def filtered(self, node: tuple, scope: dict[str, Lookup]) -> Column:
        _, name, inner, arguments = node
        if name == "default":
            if inner[0] not in ("name", "get") or len(arguments) > 1:
                raise NoExpression("default of a result")
            value, found = self.value(inner, scope), self.defined(inner, scope)
            other = self.value(arguments[0], scope) if arguments else F.parse_json(F.lit('""'))
            return self.choice(found, value, other)
        given = [self.value(a, scope) for a in arguments]
        return _once(lambda value, *rest: self.result(name, value, list(rest)))(self.value(inner, scope), *given)

    @staticmethod
    def result(name: str, value: Column, given: list[Column]) -> Column:
        text = _text(value)
        if name in ("trim", "lower", "upper", "capitalize", "title", "string") and given:
            raise NoExpression(name)
        if name == "trim":
            return strip(text).cast("variant")
        if name == "string":
            return text.cast("variant")
        if name in ("lower", "upper"):
            return (F.lower if name == "lower" else F.upper)(_ascii(text)).cast("variant")
        if name == "capitalize":
            plain = _ascii(text)
            return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 30))).cast("variant")
        if name == "title":
            return F.when(text.rlike("^[A-Za-z ]*$"), F.initcap(text)).cast("variant")
        if name in ("length", "count") and not given:
            return F.when(_is(value, "STRING"), F.length(_get(value, "string"))).when(_is(value, "ARRAY"), F.size(_elements(value))).cast("bigint").cast("variant")
        if name == "join" and len(given) < 2:
            by = _get(F.when(_is(given[0], "STRING"), given[0]), "string") if given else F.lit("")
            return _listed(_elements(value), _text, by).cast("variant")
        if name == "replace" and len(given) == 2:
            old, new = (_get(F.when(_is(g, "STRING"), g), "string") for g in given)
            return F.when((old != "") & new.isNotNull(), F.replace(text, old, new)).cast("variant")
        if name == "tojson" and not given:
            inside = _listed(_elements(value), _quoted, F.lit(", "))
            return F.when(_is(value, "ARRAY"), F.concat(F.lit("["), inside, F.lit("]"))).otherwise(_quoted(value)).cast("variant")
        if name == "int" and len(given) < 2:
            other = given[0] if given else F.parse_json(F.lit("0"))
            plain = _ascii(text)
            return F.when(plain.rlike(r"^\s*[-+]?\d{1,15}(\.\d*)?\s*$"), F.trim(F.regexp_replace(plain, r"\s+|\..*$", "")).try_cast("bigint").cast("variant")).when(~plain.rlike(r"^\s*[-+]?\d+(\.\d*)?\s*$"), other)
        if name in ("first", "last") and not given:
            return F.try_element_at(_elements(value), F.lit(1 if name == "first" else -1))
        if name == "list" and not given:
            return F.when(_is(value, "ARRAY"), value)
        if name == "sort" and not given:
            items = _elements(value)
            texts = F.array_sort(F.transform(items, lambda x: F.when(_is(x, "STRING"), _get(x, "string"))))
            return F.when(F.forall(items, lambda x: _is(x, "STRING")), F.to_variant_object(texts))
        if name == "abs" and not given:
            return F.when(_is(value, "BIGINT") & (_get(value, "bigint") > -(1 << 62)), F.abs(_get(value, "bigint"))).cast("variant")
        raise NoExpression(name)


def compile(source: str, scope: Callable[[str], Lookup]) -> Column | None:  # noqa: A001
    """The text of a template where it is sure, null elsewhere; None if the template has no expression."""
    try:
        return Compiler(scope).text(template.parse(source), {})
    except NoExpression:
        return None
