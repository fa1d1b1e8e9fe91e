"""Python source code to functions, statements and their reads and writes, by the standard ``ast``.

Plain Python without Spark: the operators call it in Arrow batches.  Statement kinds have the names
of the usual concrete grammar.  Choices of this engine: a fingerprint lists ``ast`` node names; code
that does not parse as a whole is parsed block by block, a block that does not parse by the blocks
inside it, and what is left is left out; a ``with`` alias and a starred target are written.
"""

from __future__ import annotations

import ast
import contextlib
import gc
from dataclasses import dataclass, field

# The kinds of statements that count, by node class.
KINDS = {
    ast.Expr: "expression_statement", ast.Assign: "expression_statement", ast.AugAssign: "expression_statement", ast.AnnAssign: "expression_statement",
    ast.Return: "return_statement", ast.Delete: "delete_statement", ast.Raise: "raise_statement", ast.Pass: "pass_statement",
    ast.Break: "break_statement", ast.Continue: "continue_statement", ast.Import: "import_statement", ast.ImportFrom: "import_from_statement",
    ast.Assert: "assert_statement", ast.Global: "global_statement", ast.Nonlocal: "nonlocal_statement", ast.If: "if_statement",
    ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.Try: "try_statement", ast.TryStar: "try_statement",
    ast.With: "with_statement", ast.AsyncWith: "with_statement", ast.Match: "match_statement",
    ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition",
}
COMPOUND = ("for_statement", "while_statement", "if_statement", "with_statement", "try_statement", "match_statement")
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPE = (*_FUNCTION, ast.ClassDef)
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


class Source:
    """Source text, its tree (of all blocks that parse) and the text of nodes."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\f", " ")
        self.lines = self.text.split("\n")
        self.plain = self.text.isascii()  # columns count bytes
        self.body = _parse(self.text, self.lines)

    def span(self, node: ast.AST) -> str:
        if self.plain:
            rows = self.lines[node.lineno - 1 : node.end_lineno]
            rows[-1] = rows[-1][: node.end_col_offset]
            rows[0] = rows[0][node.col_offset :]
            return "\n".join(rows)
        rows = [line.encode() for line in self.lines[node.lineno - 1 : node.end_lineno]]
        rows[-1] = rows[-1][: node.end_col_offset]
        rows[0] = rows[0][node.col_offset :]
        return b"\n".join(rows).decode(errors="replace")

    def is_elif(self, node: ast.If) -> bool:
        return self.lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif")


def _tree(code: str) -> list[ast.stmt] | None:
    try:
        return ast.parse(code).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _parse(text: str, lines: list[str]) -> list[ast.stmt]:
    whole = _tree(text)
    return _salvage(lines, 0, len(lines)) if whole is None else whole


def _salvage(lines: list[str], first: int, last: int) -> list[ast.stmt]:
    """What parses of the blocks of some lines, each by itself, with its own lines and columns; of a
    block that does not, the definitions among its inner blocks."""
    indents = {i: len(lines[i]) - len(lines[i].lstrip()) for i in range(first, last) if lines[i].strip()}
    if not indents:
        return []
    width = indents[min(indents)] if first else 0
    starts = [i for i, n in indents.items() if n == width and lines[i].lstrip()[0] not in ")]}#"]
    out: list[ast.stmt] = []
    begin = None
    for k, end in zip(starts, [*starts[1:], last][: len(starts)], strict=True):
        begin = k if begin is None else begin
        if lines[k].lstrip().startswith("@") and end < last:
            continue  # goes with what it decorates
        code = "\n".join(lines[begin:end])
        found = _tree("\n" * begin + code) if not width else _tree("\n" * (begin - 1) + "if 1:\n" + code)
        if found is None:
            out += [s for s in _salvage(lines, k + 1, end) if isinstance(s, _SCOPE)] if k + 1 < end else []
        else:
            out += found if not width else found[0].body
        begin = None
    return out


#: The fields of node classes that can hold nodes, and those that hold blocks, last first; classes are
#: added as they are met.
_BELOW: dict[type, tuple[str, ...]] = {ast.Name: (), ast.Constant: ()}
_HELD: dict[type, tuple[str, ...]] = {}


def _preorder(node: ast.AST) -> list[ast.AST]:
    """A node and all below it in the order of the source, without the contexts of names."""
    out, left = [], [node]
    while left:
        node = left.pop()
        out.append(node)
        names = _BELOW.get(type(node))
        if names is None:
            names = _BELOW[type(node)] = tuple(n for n in reversed(node._fields) if n != "ctx")
        for name in names:
            value = getattr(node, name, None)
            if isinstance(value, ast.AST):
                left.append(value)
            elif isinstance(value, list):
                left += [v for v in reversed(value) if isinstance(v, ast.AST)]
    return out


def _in_blocks(body: list[ast.stmt]) -> list[ast.AST]:
    """Statements at all depths, and the clauses that hold them, in the order of the source."""
    out: list[ast.AST] = []
    left: list[ast.AST] = body[::-1]
    while left:
        node = left.pop()
        out.append(node)
        names = _HELD.get(type(node))
        if names is None:
            names = _HELD[type(node)] = tuple(n for n in reversed(_BLOCKS) if n in node._fields)
        for name in names:
            left += reversed(getattr(node, name))
    return out


@contextlib.contextmanager
def uncollected():
    """Trees hold no cycles: while many are made, a search for cycles only costs time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


# --- functions


@dataclass
class Function:
    name: str
    parameters: list[str]
    return_type: str | None
    body_code: str
    start_line: int
    end_line: int
    dependencies: list[str]
    fingerprint: list[str]
    is_stub: bool


def _parameters(a: ast.arguments) -> list[str]:
    plain = [*a.posonlyargs, *a.args]
    bare = len(plain) - len(a.defaults)  # from here on they have defaults
    out = [p.arg for i, p in enumerate(plain) if i >= bare or p.annotation or p.arg not in ("self", "cls")]
    if a.vararg and not a.vararg.annotation:
        out.append(a.vararg.arg)
    out += [p.arg for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d or p.annotation or p.arg not in ("self", "cls")]
    if a.kwarg and not a.kwarg.annotation:
        out.append(a.kwarg.arg)
    return out


def _callees(nodes: list[ast.AST], own: str) -> list[str]:
    calls = (n.func for n in nodes if isinstance(n, ast.Call))
    names = (f.attr if isinstance(f, ast.Attribute) else f.id for f in calls if isinstance(f, ast.Attribute) or isinstance(f, ast.Name) and f.id != own)
    return sorted(set(names))


def _is_stub(node, source: Source) -> bool:
    if any("abstractmethod" in source.span(d) for d in node.decorator_list):
        return True

    def empty(s: ast.stmt) -> bool:
        if isinstance(s, ast.Pass):
            return True
        value = s.value if isinstance(s, ast.Expr) else None
        return isinstance(value, ast.JoinedStr) or isinstance(value, ast.Constant) and (value.value is ... or isinstance(value.value, (str, bytes)))

    return all(map(empty, node.body))


def functions(text: str) -> list[Function]:
    """All functions and methods, nested ones too, in the order of the source."""
    source = Source(text)
    out = []
    for node in _in_blocks(source.body):
        if isinstance(node, _FUNCTION):
            below = _preorder(node)
            prints = [type(n).__name__ for n in below]
            returns = source.span(node.returns) if node.returns else None
            out.append(Function(node.name, _parameters(node.args), returns, source.span(node), node.lineno, node.end_lineno, _callees(below, node.name), prints, _is_stub(node, source)))
    return out


def count_statements(text: str) -> int:
    """Statements at any depth; the outer function is one, a decorated definition two, an ``elif``
    none."""
    return _count(Source(text))


def _count(source: Source) -> int:
    counted = (n for n in _in_blocks(source.body) if type(n) in KINDS and not (isinstance(n, ast.If) and source.is_elif(n)))
    return sum(1 + (isinstance(n, _SCOPE) and bool(n.decorator_list)) for n in counted)


# --- statements


@dataclass
class Statement:
    index: int
    parent: int | None
    kind: str
    start_line: int
    end_line: int
    source_text: str
    writes: list[str] = field(default_factory=list)
    reads: list[str] = field(default_factory=list)


def top_level_statements(text: str) -> list[Statement]:
    """The first function's statements that no other statement holds, numbered from 0."""
    out = [s for s in statements(text) if s.parent is None]
    for i, s in enumerate(out):
        s.index = i
    return out


_NAMELESS = (ast.Constant, ast.Call, ast.BinOp, ast.Compare, ast.Add, ast.Tuple, ast.Subscript)


def _names(node: ast.AST | None) -> set[str]:
    """Every identifier in an expression, attributes, keywords and bound names included."""
    out: set[str] = set()
    for n in _preorder(node) if node is not None else ():
        if type(n) is ast.Name:
            out.add(n.id)
            continue
        if type(n) in _NAMELESS:
            continue
        match n:
            case ast.Attribute(attr=x) | ast.arg(arg=x) | ast.MatchAs(name=str(x)) | ast.MatchStar(name=str(x)) | ast.MatchMapping(rest=str(x)):
                out.add(x)
            case ast.keyword(arg=str(x)):
                out.add(x)
            case ast.Global(names=xs) | ast.Nonlocal(names=xs):
                out.update(xs)
            case ast.alias(name=x, asname=y):
                out.update(x.split("."))
                out.update([y] if y else [])
            case ast.FunctionDef(name=x) | ast.AsyncFunctionDef(name=x) | ast.ClassDef(name=x) | ast.ExceptHandler(name=str(x)):
                out.add(x)
    return out


def _targets(node: ast.AST) -> set[str]:
    match node:
        case ast.Name(id=x):
            return {x}
        case ast.Tuple(elts=parts) | ast.List(elts=parts):
            return set().union(*map(_targets, parts))
        case ast.Starred(value=inner):
            return _targets(inner)
    return set()  # what a subscript or an attribute sets is no new binding


def _writes_reads(s: ast.stmt) -> tuple[set[str], set[str]]:
    """Names that a statement binds and that it mentions; of compound ones, the header only."""
    all_of = lambda *nodes: set().union(*(_names(n) for n in nodes if n is not None))
    match s:
        case ast.Expr(value=ast.NamedExpr(target=t, value=v)):
            return _targets(t), _names(v)
        case ast.Assign(targets=[first], value=v):
            return _targets(first), _names(v)
        case ast.Assign(targets=[first, *rest], value=v):
            return _targets(first), all_of(v, *rest)  # a = b = c binds a only; b and c are mentioned
        case ast.AnnAssign(target=t, value=v):
            return _targets(t), _names(v)
        case ast.AugAssign(target=t, value=v):
            return (_targets(t) if isinstance(t, ast.Name) else set()), all_of(t, v)
        case ast.For(target=t, iter=it) | ast.AsyncFor(target=t, iter=it):
            return _targets(t), _names(it)
        case ast.While(test=t) | ast.If(test=t):
            return set(), _names(t)
        case ast.With(items=items) | ast.AsyncWith(items=items):
            return set().union(*(_targets(i.optional_vars) for i in items if i.optional_vars)), all_of(*(i.context_expr for i in items))
        case ast.Import(names=names):
            return {a.asname or a.name.split(".")[0] for a in names}, set()
        case ast.ImportFrom(names=names):
            return {a.asname or a.name for a in names if a.name != "*"}, set()
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            return {s.name}, all_of(*s.decorator_list)
        case ast.Try() | ast.TryStar() | ast.Global() | ast.Nonlocal() | ast.Pass() | ast.Break() | ast.Continue():
            return set(), set()
    return set(), _names(s)


def _bodies(s: ast.stmt, source: Source) -> list[list[ast.stmt]]:
    """The blocks of a compound statement; those of its clauses belong to it as well."""
    match s:
        case ast.If(body=body, orelse=orelse):
            chained = len(orelse) == 1 and isinstance(orelse[0], ast.If) and source.is_elif(orelse[0])
            return [body, *(_bodies(orelse[0], source) if chained else [orelse])]
        case ast.For() | ast.AsyncFor() | ast.While():
            return [s.body, s.orelse]
        case ast.With() | ast.AsyncWith():
            return [s.body]
        case ast.Try() | ast.TryStar():
            return [s.body, *(h.body for h in s.handlers), s.orelse, s.finalbody]
        case ast.Match(cases=cases):
            return [c.body for c in cases]
    return []


def statements(text: str, over: int = -1, covered: bool = True) -> list[Statement]:
    """The first function's statements at all depths, in order; definitions inside are leaves.
    Lines count from the text's first.  A text of no more than ``over`` statements, as
    :func:`count_statements` has them, gives none.  Without ``covered`` their texts are left empty."""
    source = Source(text)
    out: list[Statement] = []
    if over < 0 or _count(source) > over:
        first = next((n for n in _in_blocks(source.body) if isinstance(n, _FUNCTION)), None)
        _add(out, source, first.body if first is not None else [], None, covered)
    return out


def _add(out: list[Statement], source: Source, block: list[ast.stmt], parent: int | None, covered: bool) -> None:
    for s in block:
        kind = KINDS.get(type(s))
        if kind is None:
            continue
        start = s.lineno
        if isinstance(s, _SCOPE) and s.decorator_list:
            kind, start = "decorated_definition", s.decorator_list[0].lineno
        writes, reads = _writes_reads(s)
        text = source.span(s) if covered else ""
        if covered and start != s.lineno:
            text = "\n".join([*source.lines[start - 1 : s.lineno - 1], text]).strip()
        me = len(out)
        out.append(Statement(me, parent, kind, start, s.end_lineno, text, sorted(writes), sorted(reads)))
        for inner in _bodies(s, source) if kind in COMPOUND else ():
            _add(out, source, inner, me, covered)


def providers(found: list[Statement]) -> list[int | None]:
    """For each statement the least earlier one that is the first to write a name that it reads."""
    first: dict[str, int] = {}
    for s in found:
        for name in s.writes:
            first.setdefault(name, s.index)
    return [min((first[n] for n in s.reads if first.get(n, s.index) < s.index), default=None) for s in found]
