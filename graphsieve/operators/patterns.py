"""Patterns over graph nodes, compiled to filters, semi-joins and anti-joins.

A pattern answers ``filter(g, nodes, context)``: the rows of ``nodes`` that match.  Where
a pattern is a predicate on the node's own columns, ``condition`` gives it as one Column,
and boolean combinations of such patterns stay one filter that reaches the scan.  Only
what looks at other nodes costs a join.

``context`` marks the predicate form that Inside and Not use: method names then match
anywhere in the name, and annotations of the enclosing class count as the method's.

Decisions where forms could disagree: call names are regular expressions in every form;
receiver types and equal metavariables are tested in every form; ``None`` as an argument
skips it; ``$_`` never binds.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import full_match
from ..graph import EXPRESSIONS, Graph

LiteralValue = str | int | float | bool | None
_VALUES = (*EXPRESSIONS, "METHOD_PARAMETER_IN")


def is_variable(x: object) -> bool:
    return isinstance(x, str) and x.startswith("$")


@dataclass(frozen=True)
class Metavariable:
    """A name, and the argument that it binds (None: the node itself)."""

    name: str
    index: int | None = None


class Pattern(ABC):
    """Subclass to add patterns: give ``filter``, and ``condition`` where columns suffice."""

    labels: tuple[str, ...] = ()

    def condition(self, context: bool = False) -> Column | None:
        """The pattern as a predicate on the node's columns, or None if it needs joins."""
        return None

    @abstractmethod
    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        """Rows of ``nodes`` that match, once each."""

    def scan(self, g: Graph) -> DataFrame:
        return self.filter(g, g.label(*self.labels) if self.labels else g.nodes)

    def ids(self, g: Graph, context: bool = False) -> DataFrame:
        nodes = g.label(*self.labels) if self.labels else g.nodes
        return self.filter(g, nodes, context).select("id")

    def variables(self) -> Iterator[Metavariable]:
        """Metavariables in order of appearance."""
        return iter(())

    # fluent forms
    def where(self, *others: Pattern) -> Pattern:
        return And([self, *others])

    def inside(self, context: Pattern) -> Pattern:
        return Inside(self, context)

    def is_dominated_by(self, barrier: Pattern) -> Pattern:
        return DominatedBy(self, barrier)

    def is_not_dominated_by(self, barrier: Pattern) -> Pattern:
        return DominatedBy(self, barrier, negated=True)

    def field(self, name: str) -> Pattern:
        return Field(self, name)

    def __or__(self, other: Pattern) -> Pattern:
        return Or([*(self.parts if isinstance(self, Or) else [self]), *(other.parts if isinstance(other, Or) else [other])])

    def __and__(self, other: Pattern) -> Pattern:
        return And([self, other])

    def __invert__(self) -> Pattern:
        return Not(self)


class _Simple(Pattern):
    """A pattern that is a predicate on columns."""

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        return nodes.where(self.condition(context))

    def _label(self) -> Column:
        return F.col("label").isin(*self.labels)


class Any(_Simple):
    """Every node."""

    def condition(self, context: bool = False) -> Column:
        return F.lit(True)


class Var(_Simple):
    """Any expression or parameter, bound to a name."""

    labels = _VALUES

    def __init__(self, name: str = "$_"):
        self.name = name

    def condition(self, context: bool = False) -> Column:
        return self._label()

    def variables(self) -> Iterator[Metavariable]:
        yield Metavariable(self.name)


class Literal(_Simple):
    """A literal by value; a text with or without quotes, ``$x`` for any."""

    labels = ("LITERAL",)

    def __init__(self, value: LiteralValue):
        self.value = value

    def condition(self, context: bool = False) -> Column:
        v = self.value
        if is_variable(v):
            return self._label()
        if isinstance(v, str):
            return self._label() & F.col("code").isin(v, f'"{v}"', f"'{v}'")
        return self._label() & full_match("code", str(v).replace(".", r"\."))

    def variables(self) -> Iterator[Metavariable]:
        if is_variable(self.value):
            yield Metavariable(self.value)


class Identifier(_Simple):
    labels = ("IDENTIFIER",)

    def __init__(self, name: str):
        self.name = name

    def condition(self, context: bool = False) -> Column:
        return self._label() if is_variable(self.name) else self._label() & full_match("name", self.name)

    def variables(self) -> Iterator[Metavariable]:
        if is_variable(self.name):
            yield Metavariable(self.name)


class Return(_Simple):
    labels = ("RETURN",)

    def condition(self, context: bool = False) -> Column:
        return self._label()


def _annotated(g: Graph, nodes: DataFrame, pattern: str, of_class: bool) -> DataFrame:
    notes = g.label("ANNOTATION").where(full_match("name", pattern)).select(F.col("id").alias("dst"))
    holders = g.links("ANNOTATED_BY").join(notes, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    own = nodes.join(holders, "id", "left_semi")
    if not of_class:
        return own
    classes = g.label("TYPE_DECL").join(holders, "id", "left_semi").select(F.col("full_name").alias("ast_parent_full_name")).distinct()
    both = own.select("id").unionByName(nodes.join(classes, "ast_parent_full_name", "left_semi").select("id")).distinct()
    return nodes.join(both, "id", "left_semi")


class Parameter(Pattern):
    labels = ("METHOD_PARAMETER_IN",)

    def __init__(self, name: str | None = None, annotation: str | None = None):
        self.name, self.annotation = name, annotation

    def _own(self) -> Column:
        out = F.col("label") == "METHOD_PARAMETER_IN"
        return out if self.name is None or is_variable(self.name) else out & full_match("name", self.name)

    def condition(self, context: bool = False) -> Column | None:
        return self._own() if self.annotation is None else None

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        out = nodes.where(self._own())
        return out if self.annotation is None else _annotated(g, out, self.annotation, False)

    def variables(self) -> Iterator[Metavariable]:
        if is_variable(self.name):
            yield Metavariable(self.name)


class Method(Pattern):
    labels = ("METHOD",)

    def __init__(self, name: str | None = None, fullname: str | None = None, annotation: str | None = None, parameter: str | None = None):
        self.name, self.fullname, self.annotation, self.parameter = name, fullname, annotation, parameter

    def _own(self, context: bool) -> Column:
        out = F.col("label") == "METHOD"
        if self.fullname is not None:
            out = out & full_match("full_name", self.fullname)
        if self.name is not None:
            out = out & full_match("name", f".*({self.name}).*" if context else self.name)
        return out

    def condition(self, context: bool = False) -> Column | None:
        return self._own(context) if self.annotation is None and self.parameter is None else None

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        out = nodes.where(self._own(context))
        if self.annotation is not None:
            out = _annotated(g, out, self.annotation, context)
        if self.parameter is not None:
            holders = g.label("METHOD_PARAMETER_IN").where(full_match("name", self.parameter)).select(F.col("method_id").alias("id"))
            out = out.join(holders, "id", "left_semi")
        return out


def _as_pattern(x: object) -> Pattern | None:
    if x is None or isinstance(x, Pattern):
        return x
    return Var(x) if is_variable(x) else Literal(x)


class Call(Pattern):
    """A call by name or full name (which wins), receiver type and arguments.

    ``args[i]`` is tested on argument i + 1, which must exist.
    """

    labels = ("CALL",)

    def __init__(self, name: str | None = None, fullname: str | None = None, receiver_type: str | None = None, args: Sequence[object] | None = None):
        self.name, self.fullname, self.receiver_type = name, fullname, receiver_type
        self.args = [_as_pattern(a) for a in args or []]

    def _own(self) -> Column:
        out = F.col("label") == "CALL"
        if self.fullname is not None:
            return out & full_match("method_full_name", self.fullname)
        return out if self.name is None or is_variable(self.name) else out & full_match("name", self.name)

    def condition(self, context: bool = False) -> Column | None:
        return self._own() if not self.receiver_type and not self.args else None

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        out = nodes.where(self._own())
        if self.receiver_type:
            held = g.nodes.where(full_match("type_full_name", f".*{self.receiver_type}.*")).select(F.col("id").alias("arg"))
            out = out.join(g.argument(0).join(held, "arg", "left_semi").select(F.col("call").alias("id")), "id", "left_semi")
        for i, a in enumerate(self.args):
            if a is None:
                continue
            here = g.argument(i + 1)
            # the argument's own row is needed only where its pattern looks at it
            good = a.filter(g, g.label(*a.labels) if a.labels else g.nodes, True).select(F.col("id").alias("arg"))
            out = out.join(here.join(good, "arg", "left_semi").select(F.col("call").alias("id")), "id", "left_semi")
        return self._unified(g, out)

    def _unified(self, g: Graph, calls: DataFrame) -> DataFrame:
        """Calls in which a name that stands at several arguments has the same code at all."""
        places: dict[str, list[int]] = {}
        for v in self.variables():
            if v.index is not None and v.name != "$_":
                places.setdefault(v.name, []).append(v.index)
        for indexes in places.values():
            first, *others = sorted(set(indexes))
            for other in others:
                a = g.with_code(g.argument(first), "arg", "x").select("call", "x")
                b = g.with_code(g.argument(other), "arg", "y").select("call", "y")
                same = a.join(b, "call").where("x = y").select(F.col("call").alias("id"))
                calls = calls.join(same, "id", "left_semi")
        return calls

    def variables(self) -> Iterator[Metavariable]:
        if is_variable(self.name):
            yield Metavariable(self.name)
        for i, a in enumerate(self.args):
            for v in a.variables() if a is not None else ():
                if v.index is None:
                    yield Metavariable(v.name, i + 1)


class Field(Pattern):
    """An access to a field of something that matches ``receiver``."""

    labels = ("CALL",)

    def __init__(self, receiver: Pattern, name: str):
        self.receiver, self.name = receiver, name

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        out = nodes.where((F.col("label") == "CALL") & full_match("name", ".*fieldAccess.*"))
        held = self.receiver.scan(g).select(F.col("id").alias("arg"))
        named = g.label("FIELD_IDENTIFIER", "IDENTIFIER", "LITERAL").where(full_match("code", self.name)).select(F.col("id").alias("arg"))
        out = out.join(g.argument(1).join(held, "arg", "left_semi").select(F.col("call").alias("id")), "id", "left_semi")
        return out.join(g.argument(2).join(named, "arg", "left_semi").select(F.col("call").alias("id")), "id", "left_semi")

    def variables(self) -> Iterator[Metavariable]:
        return self.receiver.variables()


class And(Pattern):
    """All parts; the first gives the nodes, the others filter them."""

    def __init__(self, parts: Sequence[Pattern]):
        self.parts = list(parts)

    @property
    def labels(self) -> tuple[str, ...]:
        return self.parts[0].labels if self.parts else ()

    def condition(self, context: bool = False) -> Column | None:
        own = [p.condition(context) for p in self.parts]
        return None if any(c is None for c in own) else reduce(Column.__and__, own, F.lit(True))

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        for p in sorted(self.parts, key=lambda p: p.condition(context) is None):  # columns first, they are cheap
            nodes = p.filter(g, nodes, context)
        return nodes

    def variables(self) -> Iterator[Metavariable]:
        for p in self.parts:
            yield from p.variables()


class Or(Pattern):
    """Any part. Parts that are predicates on columns make one filter, the others a union of ids."""

    def __init__(self, parts: Sequence[Pattern]):
        self.parts = list(parts)

    @property
    def labels(self) -> tuple[str, ...]:
        sets = [p.labels for p in self.parts]
        return tuple(sorted({x for s in sets for x in s})) if sets and all(sets) else ()

    def condition(self, context: bool = False) -> Column | None:
        own = [p.condition(context) for p in self.parts]
        if not own:
            return F.lit(True)
        return None if any(c is None for c in own) else reduce(Column.__or__, own)

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        if (c := self.condition(context)) is not None:
            return nodes.where(c)
        simple = [c for p in self.parts if (c := p.condition(context)) is not None]
        found = [nodes.where(reduce(Column.__or__, simple)).select("id")] if simple else []
        found += [p.filter(g, nodes, context).select("id") for p in self.parts if p.condition(context) is None]
        return nodes.join(reduce(DataFrame.unionByName, found).distinct(), "id", "left_semi")

    def variables(self) -> Iterator[Metavariable]:
        for p in self.parts:
            yield from p.variables()


class Not(Pattern):
    def __init__(self, part: Pattern):
        self.part = part

    def condition(self, context: bool = False) -> Column | None:
        c = self.part.condition(True)
        return None if c is None else ~F.coalesce(c, F.lit(False))

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        if (c := self.condition(context)) is not None:
            return nodes.where(c)
        return nodes.join(self.part.filter(g, nodes, True).select("id"), "id", "left_anti")


class Inside(Pattern):
    """Nodes whose enclosing method matches."""

    def __init__(self, part: Pattern, context: Pattern):
        self.part, self.context = part, context

    @property
    def labels(self) -> tuple[str, ...]:
        return self.part.labels

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        methods = self.context.filter(g, g.label("METHOD"), True).select(F.col("id").alias("method_id"))
        return self.part.filter(g, nodes, context).join(methods, "method_id", "left_semi")

    def variables(self) -> Iterator[Metavariable]:
        return self.part.variables()


class DominatedBy(Pattern):
    """Nodes that a matching node strictly dominates in control flow, or none does."""

    def __init__(self, part: Pattern, barrier: Pattern, negated: bool = False):
        self.part, self.barrier, self.negated = part, barrier, negated

    @property
    def labels(self) -> tuple[str, ...]:
        return self.part.labels

    def filter(self, g: Graph, nodes: DataFrame, context: bool = False) -> DataFrame:
        from .dominance import dominated

        out = self.part.filter(g, nodes, context)
        barrier = self.barrier.filter(g, g.label(*self.barrier.labels) if self.barrier.labels else g.nodes, True)
        return out.join(dominated(g, out, barrier), "id", "left_anti" if self.negated else "left_semi")

    def variables(self) -> Iterator[Metavariable]:
        return self.part.variables()
