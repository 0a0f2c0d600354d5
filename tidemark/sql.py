"""SELECT statements over a lake. Spark's own parser says where a statement names tables and functions, so that text in
quotes, columns, aliases and common table expressions of the same names stay as they are."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .state import LakeError

QUOTED = r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)"
SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


def kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def place(node) -> tuple[int, int]:
    origin = node.origin()
    return origin.startIndex().get(), origin.stopIndex().get() + 1


@dataclass
class Named:
    """A place in a text where a table (relation, travel) or a function (call, listing) is named."""

    what: str
    name: str
    start: int
    end: int
    aliased: bool = False
    node: object = None


def named(node, hidden: frozenset = frozenset(), parent: str = "", expression: bool = False) -> Iterator[Named]:
    """The names in a parsed plan or expression; hidden are those of the common table expressions around it."""
    what = kind(node)
    if what == "UnresolvedRelation":
        parts = items(node.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in hidden:
            yield Named("relation", ".".join(parts), *place(node), parent in ("SubqueryAlias", "Sample"))
        return
    if what == "RelationTimeTravel":
        inner = node.relation()
        yield Named("travel", ".".join(items(inner.multipartIdentifier())), place(inner)[0], place(node)[1], parent in ("SubqueryAlias", "Sample"), node)
        return
    if what == "UnresolvedTableValuedFunction":
        yield Named("listing", ".".join(items(node.name())), *place(node), parent == "SubqueryAlias", node)
        for e in items(node.functionArgs()):
            yield from named(e, hidden, what, True)
        return
    if what == "UnresolvedFunction":
        yield Named("call", ".".join(items(node.nameParts())), *place(node), True, node)
    if what == "UnresolvedWith":
        for cte in items(node.innerChildren()):
            yield from named(cte, hidden, what)
            hidden = hidden | {cte.alias().lower()}
    if what in SUBQUERIES:
        yield from named(node.plan(), hidden, what)
    for child in items(node.children()):
        yield from named(child, hidden, what, expression)
    if not expression and what not in SUBQUERIES:
        for e in items(node.expressions()):
            yield from named(e, hidden, what, True)


def with_travel(text: str) -> str:
    """`AT (VERSION => n)` and `AT (TIMESTAMP => 'x')` as Spark's time travel clauses."""
    return re.sub(QUOTED + r"|\bAT\s*\(\s*(VERSION|TIMESTAMP)\s*=>\s*(\d+|'[^']*')\s*\)", lambda m: m[0] if m[1] else f"{m[2].upper()} AS OF {m[3]}", text, flags=re.IGNORECASE)


@dataclass
class Statement:
    """A SELECT with its names bound to temporary views and functions, which go once Spark has resolved them.

    table(name, version, timestamp) gives a table's rows, or None if there is no such table; listing(name, arguments) those
    of a table function; view(name) the text of a view; macros and variables (as SQL) are those of the lake and session.
    """

    spark: SparkSession
    table: Callable[[str, int | None, str | None], DataFrame | None]
    listing: Callable[[str, list[str]], DataFrame | None]
    view: Callable[[str], str | None]
    macros: dict[str, list[dict]]
    variables: dict[str, str]
    views: list[str] = field(default_factory=list)
    functions: dict[tuple[str, int], str] = field(default_factory=dict)

    def run(self, text: str) -> DataFrame:
        try:
            return self.spark.sql(self.bound(with_travel(text)))
        finally:
            for v in self.views:
                self.spark.catalog.dropTempView(v)
            for f in self.functions.values():
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {f}")

    def bound(self, text: str, expression: bool = False, depth: int = 0) -> str:
        if depth > 20:
            raise LakeError("views or macros refer to each other")
        parser = self.spark._jsparkSession.sessionState().sqlParser()
        tree = parser.parseExpression(text) if expression else parser.parsePlan(text)
        new = {}
        for n in named(tree, expression=expression):
            if (found := self._bound(n, text, depth)) is not None:
                new[(n.start, n.end if n.what != "call" or "(" not in found[1] else n.start)] = found
        for (start, _), (length, put) in sorted(new.items(), reverse=True):
            text = text[:start] + put + text[start + length :]
        return text

    def _bound(self, n: Named, text: str, depth: int) -> tuple[int, str] | None:
        """(length of what is replaced, replacement) or None if the name is not the lake's."""
        if n.what in ("relation", "travel"):
            travel = n.node
            version = int(travel.version().get()) if travel is not None and travel.version().isDefined() else None
            when = text[place(travel.timestamp().get())[0] : place(travel.timestamp().get())[1]].strip("'") if travel is not None and travel.timestamp().isDefined() else None
            rows = self.table(n.name, version, when)
            if rows is None:
                inner = self.view(n.name)
                if inner is None or travel is not None:
                    return None
                rows = self.spark.sql(self.bound(with_travel(inner), depth=depth + 1))
            return n.end - n.start, self._view(rows) + ("" if n.aliased else f" AS `{n.name.rpartition('.')[2]}`")
        arguments = items(n.node.functionArgs() if n.what == "listing" else n.node.arguments())
        if n.what == "listing":
            rows = self.listing(n.name, [self._text(a, text) for a in arguments])
            if rows is not None:
                return n.end - n.start, self._view(rows) + ("" if n.aliased else f" AS `{n.name}`")
        elif n.name.lower() == "getvariable":
            name = self._text(arguments[0], text)
            if name not in self.variables:
                raise LakeError(f"no variable {name}")
            return n.end - n.start, f"({self.variables[name]})"
        if n.name in self.macros:
            return len(n.name), self._macro(n.name, len(arguments), depth)
        return None

    def _text(self, argument, text: str) -> str:
        start, end = place(argument)
        inner = text[start:end]
        if kind(argument) == "UnresolvedFunction" or kind(argument) == "Cast":
            return str(self.spark.sql("SELECT " + self.bound(inner, expression=True)).first()[0])
        return inner.strip().strip("'")

    def _view(self, rows: DataFrame) -> str:
        name = f"lake_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(name)
        self.views.append(name)
        return name

    def _macro(self, name: str, given: int, depth: int) -> str:
        """The temporary function of the implementation of a macro that takes so many arguments."""
        fits = [i for i in self.macros[name] if sum(p[2] is None for p in i["params"]) <= given <= len(i["params"])]
        if not fits:
            raise LakeError(f"macro {name} takes no {given} arguments")
        key = (name, self.macros[name].index(fits[0]))
        if key not in self.functions:
            function = name if not any(n == name for n, _ in self.functions) else f"{name}_{uuid.uuid4().hex}"
            one = fits[0]
            table = one["returns"].lower().startswith("table")
            body = self.bound(one["body"], expression=not table, depth=depth + 1)
            if function != name:
                body = re.sub(QUOTED + rf"|\b{re.escape(name)}\.", lambda m: m[0] if m[1] else function + ".", body)
            params = ", ".join(f"{p} {t}" + (f" DEFAULT {d}" if d is not None else "") for p, t, d in one["params"])
            self.functions[key] = function
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}({params}) RETURNS {one['returns']} RETURN {body}")
        return self.functions[key]
