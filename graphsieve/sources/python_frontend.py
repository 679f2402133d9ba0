"""Python source files as a property graph.

``parse`` turns one file into node and edge rows with the standard ``ast`` module; files
are independent, so ``import_python`` runs it as one pass over a table of files, and
links calls to methods across files with a join on dotted names afterwards.

Flow edges (DDG): a definition reaches uses of the variable, or of an access path such
as ``o.field``; operands reach the expression they are in; an argument reaches the
result of its call if the callee is unknown, else its parameter, and what a method
returns reaches the call.  Branches join, loop bodies are read twice.  Control flow
(CFG) is in order of evaluation; CDG edges lead from a condition to what it controls.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGES, NODES, Graph
from ..storage import Scratch, ship

_OPERATORS = {ast.Add: "addition", ast.Sub: "subtraction", ast.Mult: "multiplication", ast.Div: "division", ast.Mod: "modulo", ast.FloorDiv: "floorDivision", ast.Pow: "exponentiation", ast.BitOr: "or", ast.BitAnd: "and", ast.BitXor: "xor", ast.LShift: "shiftLeft", ast.RShift: "shiftRight", ast.MatMult: "matrixMultiplication"}
Env = dict[str, frozenset]


def module_name(path: str) -> str:
    """Dotted module of a path; a package's own file is the package."""
    out = path.removesuffix(".py").replace("\\", "/").strip("/").replace("/", ".")
    return out.removesuffix(".__init__")


class _File:
    """Rows of one file while it is read."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.module = path, text, module_name(path)
        self.base = int.from_bytes(blake2b(path.encode(), digest_size=5).digest(), "big") >> 2 << 24
        self.nodes: list[dict] = []
        self.edges: list[tuple] = []
        self.lines = text.split("\n")
        self.imports: dict[str, str] = {}
        self.types: dict[str, str] = {}
        self.defined: dict[str, str] = {}
        self.lambdas = 0
        # what the walk is in
        self.method = 0
        self.owner = ""
        self.scope: list[str] = []
        self.locals: dict[str, int] = {}
        self.env: Env = {}
        self.tails: list[int] = []
        self.conditions: list[int] = []
        self.loops: list[tuple[list, list]] = []

    # ---------------------------------------------------------------- rows
    def node(self, label: str, at: ast.AST | None = None, **columns) -> int:
        i = self.base + len(self.nodes)
        row = {"id": i, "label": label, "filename": self.path, "lang": "python", "ast_pre": len(self.nodes), "ast_post": len(self.nodes), "method_id": self.method or None}
        if at is not None and hasattr(at, "lineno"):
            row |= {"line": at.lineno, "col": at.col_offset, "line_end": at.end_lineno, "col_end": at.end_col_offset}
            row["code"] = ast.get_source_segment(self.text, at) or ""
        self.nodes.append(row | columns)
        return i

    def close(self, i: int) -> int:
        self.nodes[i - self.base]["ast_post"] = len(self.nodes) - 1
        return i

    def edge(self, src: int, dst: int, label: str, idx: int | None = None) -> None:
        self.edges.append((src, dst, label, idx))

    def step(self, i: int) -> int:
        """The next node that is evaluated."""
        for t in self.tails:
            self.edge(t, i, "CFG")
        self.tails = [i]
        for c in self.conditions:
            self.edge(c, i, "CDG")
        return i

    def argument(self, call: int, arg: int, idx: int) -> None:
        self.edge(call, arg, "ARGUMENT", idx)
        self.edge(call, arg, "AST", idx)
        self.nodes[arg - self.base] |= {"arg_index": idx, "ord": idx}

    def operator(self, name: str, at: ast.AST, *parts: int) -> int:
        call = self.node("CALL", at, name=f"<operator>.{name}", method_full_name=f"<operator>.{name}")
        for k, p in enumerate(parts, 1):
            self.argument(call, p, k)
            self.edge(p, call, "DDG")
        return self.step(call)

    # ---------------------------------------------------------------- names
    def dotted(self, e: ast.expr) -> str | None:
        if isinstance(e, ast.Name):
            return self.types.get(e.id) or self.imports.get(e.id) or self.defined.get(e.id) or e.id
        if isinstance(e, ast.Attribute):
            head = self.dotted(e.value)
            if isinstance(e.value, ast.Name) and e.value.id in ("self", "cls") and self.owner:
                head = f"{self.module}.{self.owner}"
            return f"{head}.{e.attr}" if head else e.attr
        if isinstance(e, ast.Call):
            return self.dotted(e.func)
        return None

    def path_of(self, e: ast.expr) -> str | None:
        """An access path that can be assigned and read."""
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute) and (head := self.path_of(e.value)):
            return f"{head}.{e.attr}"
        return None

    def read(self, path: str, at: int) -> None:
        for d in self.env.get(path, ()):
            if d != at:
                self.edge(d, at, "DDG")

    def define(self, path: str, by: int) -> None:
        self.env = {k: v for k, v in self.env.items() if not k.startswith(f"{path}.")} | {path: frozenset([by])}

    # ---------------------------------------------------------------- expressions
    def expression(self, e: ast.expr) -> int:
        if isinstance(e, ast.Constant):
            return self.step(self.node("LITERAL", e, type_full_name=type(e.value).__name__))
        if isinstance(e, ast.Name):
            i = self.step(self.node("IDENTIFIER", e, name=e.id, type_full_name=self.types.get(e.id) or self.imports.get(e.id) or ""))
            if e.id in self.locals:
                self.edge(i, self.locals[e.id], "REF")
            elif e.id in self.defined:
                ref = self.node("METHOD_REF", e, name=e.id, method_full_name=f"{self.path}:{e.id}")
                self.edge(i, ref, "AST")
            self.read(e.id, i)
            return i
        if isinstance(e, ast.Attribute):
            base = self.expression(e.value)
            field = self.step(self.node("FIELD_IDENTIFIER", e, name=e.attr))
            self.nodes[field - self.base]["code"] = e.attr
            call = self.operator("fieldAccess", e, base)
            self.argument(call, field, 2)
            if path := self.path_of(e):
                self.read(path, call)
            return call
        if isinstance(e, ast.Subscript):
            return self.operator("indexAccess", e, self.expression(e.value), self.expression(e.slice))
        if isinstance(e, ast.Call):
            return self.call(e)
        if isinstance(e, ast.JoinedStr):
            parts = [self.expression(v.value if isinstance(v, ast.FormattedValue) else v) for v in e.values]
            return self.operator("formatString", e, *parts)
        if isinstance(e, ast.BinOp):
            return self.operator(_OPERATORS.get(type(e.op), "operation"), e, self.expression(e.left), self.expression(e.right))
        if isinstance(e, ast.BoolOp):
            return self.operator("logicalAnd" if isinstance(e.op, ast.And) else "logicalOr", e, *[self.expression(v) for v in e.values])
        if isinstance(e, ast.Compare):
            return self.operator("compare", e, self.expression(e.left), *[self.expression(c) for c in e.comparators])
        if isinstance(e, ast.UnaryOp):
            return self.operator("logicalNot" if isinstance(e.op, ast.Not) else "minus", e, self.expression(e.operand))
        if isinstance(e, ast.IfExp):
            return self.operator("conditional", e, self.expression(e.test), self.expression(e.body), self.expression(e.orelse))
        if isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            return self.operator({ast.List: "listLiteral", ast.Tuple: "tupleLiteral"}.get(type(e), "setLiteral"), e, *[self.expression(x) for x in e.elts])
        if isinstance(e, ast.Dict):
            return self.operator("dictLiteral", e, *[self.expression(x) for x in (*(k for k in e.keys if k), *e.values)])
        if isinstance(e, ast.Lambda):
            return self.lambda_(e)
        if isinstance(e, (ast.Await, ast.YieldFrom, ast.Starred)):
            return self.operator("await" if isinstance(e, ast.Await) else "starred", e, self.expression(e.value))
        if isinstance(e, ast.NamedExpr):
            value = self.expression(e.value)
            self.declare(e.target.id, e.target)
            target = self.step(self.node("IDENTIFIER", e.target, name=e.target.id))
            call = self.operator("assignment", e, target, value)
            self.define(e.target.id, call)
            return call
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            for g in e.generators:
                self.assign_to(g.target, self.expression(g.iter), g.iter)
                for test in g.ifs:
                    self.expression(test)
            parts = [e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]
            return self.operator("comprehension", e, *[self.expression(p) for p in parts])
        children = [self.expression(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)]
        return self.operator("expression", e, *children)

    def call(self, e: ast.Call) -> int:
        receiver = self.expression(e.func.value) if isinstance(e.func, ast.Attribute) else None
        args = [self.expression(a.value if isinstance(a, ast.Starred) else a) for a in (*e.args, *(k.value for k in e.keywords))]
        full = self.dotted(e.func) or "<unknown>"
        name = e.func.attr if isinstance(e.func, ast.Attribute) else e.func.id if isinstance(e.func, ast.Name) else "<call>"
        call = self.node("CALL", e, name=name, method_full_name=full, signature=full)
        if receiver is not None:
            self.argument(call, receiver, 0)
            self.edge(receiver, call, "ARGFLOW", 0)
            if isinstance(e.func.value, ast.Name):
                self.nodes[receiver - self.base]["type_full_name"] = self.types.get(e.func.value.id) or self.imports.get(e.func.value.id) or ""
        for k, a in enumerate(args, 1):
            self.argument(call, a, k)
            keyword = e.keywords[k - 1 - len(e.args)].arg if k > len(e.args) else None
            self.edge(a, call, f"KEYFLOW:{keyword}" if keyword else "ARGFLOW", k)
            source = (*e.args, *(w.value for w in e.keywords))[k - 1]
            if isinstance(source, ast.Name) and source.id in self.defined and source.id not in self.locals:
                self.edge(call, self.node("METHOD_REF", source, name=source.id, method_full_name=f"{self.path}:{source.id}"), "AST")
        return self.step(call)

    def lambda_(self, e: ast.Lambda) -> int:
        self.lambdas += 1
        name = f"<lambda>{self.lambdas}"
        body = ast.Return(value=e.body, lineno=e.lineno, col_offset=e.col_offset, end_lineno=e.end_lineno, end_col_offset=e.end_col_offset)
        self.function(name, e, e.args, [body], [])
        ref = self.step(self.node("METHOD_REF", e, name=name, method_full_name=f"{self.path}:{'.'.join((*self.scope, name))}"))
        return ref

    # ---------------------------------------------------------------- statements
    def declare(self, name: str, at: ast.AST) -> None:
        if name not in self.locals:
            self.locals[name] = self.node("LOCAL", None, name=name, line=getattr(at, "lineno", None))

    def assign_to(self, target: ast.expr, value: int, source: ast.expr | None, at: ast.AST | None = None) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assign_to(t.value if isinstance(t, ast.Starred) else t, value, None, at)
            return
        path = self.path_of(target)
        if isinstance(target, ast.Name):
            self.declare(target.id, target)
            left = self.step(self.node("IDENTIFIER", target, name=target.id))
            self.edge(left, self.locals[target.id], "REF")
            called = self.dotted(source.func) if isinstance(source, ast.Call) else None
            if called and called.split(".")[-1][:1].isupper():
                self.types[target.id] = called
            else:
                self.types.pop(target.id, None)
        else:
            left = self.expression(target)
        call = self.node("CALL", at or target, name="<operator>.assignment", method_full_name="<operator>.assignment")
        self.argument(call, left, 1)
        self.edge(value, call, "DDG")
        self.step(call)
        self.edge(call, value, "ARGUMENT", 2)
        if path:
            self.define(path, call)
        elif isinstance(target, ast.Subscript) and (held := self.path_of(target.value)):
            self.env = self.env | {held: self.env.get(held, frozenset()) | {call}}

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.statement(s)

    @staticmethod
    def joined(*envs: Env) -> Env:
        return {k: frozenset().union(*(e.get(k, frozenset()) for e in envs)) for k in {k for e in envs for k in e}}

    def branch(self, test: int, *bodies: list[ast.stmt]) -> None:
        """Bodies after a condition, each from the same state; their ends join."""
        env, tails, ends, envs = self.env, self.tails, [], []
        self.conditions.append(test)
        for b in bodies:
            self.env, self.tails = env, tails
            self.block(b)
            ends += self.tails
            envs.append(self.env if self.tails else {})
        self.conditions.pop()
        self.env, self.tails = self.joined(*envs), list(dict.fromkeys(ends))

    def loop(self, test: int, body: list[ast.stmt], orelse: list[ast.stmt], again) -> None:
        before = self.env
        self.conditions.append(test)
        self.loops.append(([], []))
        self.block(body)
        once = self.joined(before, self.env)
        for name, defs in once.items():
            # what the body defines reaches uses at its beginning
            for n in self.nodes:
                if n["label"] == "IDENTIFIER" and n.get("name") == name and n["id"] > test and n["method_id"] == self.method:
                    for d in defs - before.get(name, frozenset()):
                        if d != n["id"]:
                            self.edge(d, n["id"], "DDG")
        self.conditions.pop()
        breaks, continues = self.loops.pop()
        for t in (*self.tails, *continues):
            self.edge(t, test, "CFG")
        self.env, self.tails = once, [test, *breaks]
        self.block(orelse)

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.defined[s.name] = f"{self.module}.{'.'.join((*self.scope, s.name))}"
            self.function(s.name, s, s.args, s.body, s.decorator_list)
        elif isinstance(s, ast.ClassDef):
            self.class_(s)
        elif isinstance(s, ast.Import):
            for a in s.names:
                self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(s, ast.ImportFrom):
            package = self.module.rsplit(".", s.level)[0] if s.level and "." in self.module else ""
            head = ".".join(x for x in (package if s.level else "", s.module or "") if x)
            for a in s.names:
                self.imports[a.asname or a.name] = f"{head}.{a.name}" if head else a.name
        elif isinstance(s, (ast.Assign, ast.AnnAssign)):
            if s.value is not None:
                value = self.expression(s.value)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    self.assign_to(t, value, s.value, s)
        elif isinstance(s, ast.AugAssign):
            left = self.expression(s.target)
            value = self.operator(_OPERATORS.get(type(s.op), "operation"), s, left, self.expression(s.value))
            self.assign_to(s.target, value, None, s)
        elif isinstance(s, ast.Expr):
            self.expression(s.value)
        elif isinstance(s, ast.Return):
            value = self.expression(s.value) if s.value is not None else None
            i = self.step(self.node("RETURN", s))
            if value is not None:
                self.edge(value, i, "DDG")
                self.edge(i, value, "ARGUMENT", 1)
            self.edge(i, self.method, "RETURNS")
            self.tails = []
        elif isinstance(s, ast.If):
            self.branch(self.expression(s.test), s.body, s.orelse)
        elif isinstance(s, ast.While):
            self.loop(self.expression(s.test), s.body, s.orelse, s.test)
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            over = self.expression(s.iter)
            head = self.operator("iterator", s.iter, over)
            self.assign_to(s.target, head, None)
            self.loop(head, s.body, s.orelse, None)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                value = self.expression(item.context_expr)
                if item.optional_vars is not None:
                    self.assign_to(item.optional_vars, value, item.context_expr)
            self.block(s.body)
        elif isinstance(s, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            env, tails = self.env, list(self.tails)
            self.block([*s.body, *s.orelse])
            envs, ends = [self.env], list(self.tails)
            for h in s.handlers:
                # a handler may begin before or after any statement of the body
                self.env, self.tails = self.joined(env, envs[0]), list(dict.fromkeys([*tails, *ends]))
                if h.name:
                    self.declare(h.name, h)
                self.block(h.body)
                envs.append(self.env)
                ends += self.tails
            self.env, self.tails = self.joined(*envs), list(dict.fromkeys(ends))
            self.block(s.finalbody)
        elif isinstance(s, ast.Raise):
            if s.exc is not None:
                self.expression(s.exc)
            self.tails = []
        elif isinstance(s, (ast.Break, ast.Continue)):
            if self.loops:
                self.loops[-1][isinstance(s, ast.Continue)].extend(self.tails)
            self.tails = []
        elif isinstance(s, ast.Match):
            self.branch(self.expression(s.subject), *[c.body for c in s.cases], [])
        elif isinstance(s, ast.Delete):
            for t in s.targets:
                self.expression(t)
        elif isinstance(s, ast.Assert):
            self.expression(s.test)
        elif isinstance(s, (ast.Global, ast.Nonlocal, ast.Pass)):
            pass

    # ---------------------------------------------------------------- scopes
    def annotate(self, owner: int, decorators: list[ast.expr]) -> None:
        for d in decorators:
            head = d.func if isinstance(d, ast.Call) else d
            name = head.attr if isinstance(head, ast.Attribute) else getattr(head, "id", "")
            note = self.node("ANNOTATION", d, name=name, full_name=self.dotted(head))
            self.edge(owner, note, "ANNOTATED_BY")

    def class_(self, s: ast.ClassDef) -> None:
        self.defined[s.name] = f"{self.module}.{'.'.join((*self.scope, s.name))}"
        decl = self.node("TYPE_DECL", s, name=s.name, full_name=f"{self.path}:{'.'.join((*self.scope, s.name))}")
        self.annotate(decl, s.decorator_list)
        owner, self.owner = self.owner, ".".join((*self.scope, s.name))
        self.scope.append(s.name)
        saved = dict(self.defined)
        self.block(s.body)
        self.defined = saved
        self.scope.pop()
        self.owner = owner
        self.close(decl)

    def function(self, name: str, at: ast.AST, args: ast.arguments, body: list[ast.stmt], decorators: list[ast.expr]) -> None:
        qualified = ".".join((*self.scope, name))
        held = (self.method, self.locals, self.env, self.tails, self.conditions, self.loops, dict(self.types))
        i = self.node("METHOD", at, name=name, full_name=f"{self.path}:{qualified}", signature=f"{self.module}.{qualified}", is_external=False, ast_parent_full_name=f"{self.path}:{self.owner}" if self.owner else f"{self.path}:program", ast_parent_type="TYPE_DECL" if self.owner else "METHOD")
        if held[0]:
            self.edge(held[0], i, "AST")
        self.annotate(i, decorators)
        self.method, self.env, self.tails, self.conditions, self.loops = i, dict(self.env), [i], [], []
        self.locals = {}
        self.scope.append(name)
        every = [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]
        shift = 0 if every and every[0].arg in ("self", "cls") and self.owner else 1
        defaults = dict(zip([a.arg for a in every][len(args.args) - len(args.defaults) :], args.defaults))
        for k, a in enumerate(every):
            kind = ast.get_source_segment(self.text, a.annotation) if a.annotation else ""
            p = self.node("METHOD_PARAMETER_IN", a, name=a.arg, code=a.arg, ord=k + shift, type_full_name=kind or "")
            self.edge(i, p, "PARAMETER", k + shift)
            self.locals[a.arg] = p
            self.define(a.arg, p)
            given = defaults.get(a.arg)
            if isinstance(given, ast.Call):
                self.annotate(p, [given])
        self.block(body)
        self.scope.pop()
        self.close(i)
        self.method, self.locals, self.env, self.tails, self.conditions, self.loops, self.types = held


def parse(path: str, text: str) -> tuple[list[dict], list[tuple], str | None]:
    """Nodes, edges and an error, if any, of one file."""
    f = _File(path, text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [], [], f"{type(error).__name__}: {error}"
    f.node("FILE", None, name=path)
    f.node("META_DATA", None, name="python")
    program = f.node("METHOD", None, name=":program", full_name=f"{path}:program", signature=f.module, is_external=False, line=1)
    f.method, f.tails = program, [program]
    for s in tree.body:  # names that later code may use before their definition
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            f.defined[s.name] = f"{f.module}.{s.name}"
    try:
        f.block(tree.body)
    except RecursionError as error:
        return [], [], f"RecursionError: {error}"
    f.close(program)
    return f.nodes, f.edges, None


_NODE_NAMES = [x.name for x in NODES]
_OUT = "kind string, error string, " + ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in NODES) + ", src long, dst long, edge string, idx int"


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_FIELDS = [("kind", "string"), ("error", "string"), *((x.name, x.dataType.simpleString()) for x in NODES), ("src", "bigint"), ("dst", "bigint"), ("edge", "string"), ("idx", "int")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            nodes, edges, error = parse(path, text or "")
            rows = [{"kind": "node", **n} for n in nodes] + [{"kind": "edge", "src": a, "dst": z, "edge": e, "idx": i} for a, z, e, i in edges]
            if error:
                rows.append({"kind": "error", "filename": path, "error": error})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[t]) for c, t in _FIELDS], [c for c, _ in _FIELDS])


def import_python(files: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of files (path, content), and path and error of those that do not parse."""
    spark = files.sparkSession
    ship(spark)
    scratch = Scratch(spark, "frontend")
    rows = scratch.save(files.select("path", "content").mapInArrow(_rows, _OUT), "rows", "kind")
    nodes = rows.where("kind = 'node'").select(_NODE_NAMES)
    raw = rows.where("kind = 'edge'").select("src", "dst", F.col("edge").alias("label"), "idx")
    errors = rows.where("kind = 'error'").select(F.col("filename").alias("path"), "error")
    return link(spark, nodes, raw), errors


def link(spark: SparkSession, nodes: DataFrame, raw: DataFrame) -> Graph:
    """Calls to methods by dotted name, then arguments to parameters and returns to calls.

    A name that only methods of other files end with is matched by its last two parts.
    """
    methods = nodes.where("label = 'METHOD' and name != ':program'").select(F.col("id").alias("dst"), F.col("signature").alias("key"))
    calls = nodes.where("label = 'CALL'").select(F.col("id").alias("src"), F.col("method_full_name").alias("key")).where("not startswith(key, '<operator>')")
    exact = calls.join(methods, "key").select("src", "dst")
    # a class that is called is its constructor
    ctor = calls.withColumn("key", F.concat("key", F.lit(".__init__"))).join(methods, "key").select("src", "dst")
    tail = lambda c: F.array_join(F.slice(F.split(c, r"\."), -2, 2), ".")
    last = methods.withColumn("tail", tail(F.col("key"))).where("contains(tail, '.')")
    loose = calls.where("contains(key, '.')").withColumn("tail", tail(F.col("key"))).join(last.select("tail", "dst"), "tail").select("src", "dst")
    resolved = exact.unionByName(ctor)
    loose = loose.join(resolved.select("src").distinct(), "src", "left_anti")
    resolved = resolved.unionByName(loose).distinct()
    call_edges = resolved.select("src", "dst", F.lit("CALL").alias("label"), F.lit(None).cast("int").alias("idx"))
    given = raw.where("label = 'ARGFLOW' or startswith(label, 'KEYFLOW:')").select(F.col("src").alias("arg"), F.col("dst").alias("call"), "label", "idx")
    into = given.join(resolved.select(F.col("src").alias("call"), F.col("dst").alias("method_id")), "call", "left")
    unknown = into.where("method_id is null").select(F.col("arg").alias("src"), F.col("call").alias("dst"))
    params = nodes.where("label = 'METHOD_PARAMETER_IN'").select("method_id", F.col("id").alias("param"), F.col("name").alias("pname"), "ord")
    bound = into.where("method_id is not null").join(params, "method_id").where(F.when(F.col("label") == "ARGFLOW", F.col("ord") == F.col("idx")).otherwise(F.col("label") == F.concat(F.lit("KEYFLOW:"), "pname")))
    returns = raw.where("label = 'RETURNS'").select("src", F.col("dst").alias("method_id")).join(resolved.select(F.col("src").alias("call"), F.col("dst").alias("method_id")), "method_id")
    flow = unknown.unionByName(bound.select(F.col("arg").alias("src"), F.col("param").alias("dst"))).unionByName(returns.select("src", F.col("call").alias("dst")))
    own = raw.where("label in ('AST', 'ARGUMENT', 'CFG', 'CDG', 'DDG', 'REF', 'ANNOTATED_BY', 'PARAMETER')")
    edges = own.unionByName(call_edges).unionByName(flow.select("src", "dst", F.lit("DDG").alias("label"), F.lit(None).cast("int").alias("idx"))).distinct()
    return Graph(nodes, edges.select([f.name for f in EDGES])).materialize()
