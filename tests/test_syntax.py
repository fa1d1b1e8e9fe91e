from textwrap import dedent

import pytest

from plumbline.functions import syntax


def parsed(code):
    return syntax.functions(dedent(code))


def edges(code):
    """Data edges of the first function, from the reads and writes."""
    s = syntax.statements(dedent(code))
    return {(a.index, b.index) for a in s for b in s if a.index < b.index and set(a.writes) & set(b.reads)}


def test_functions_and_their_fields():
    found = parsed(
        '''
        class Shop:
            @property
            def price(self, net: float, rate=0.2, *extra, strict, **options) -> "Money":
                def inner(self: int, cls=1): return self
                return self.tax(net).round(helper(inner(1)), price(2))
        async def fetch(cls, /, url, *rest: str, **more: int):
            await get(url)
        '''
    )
    assert [f.name for f in found] == ["price", "inner", "fetch"]
    assert [f.parameters for f in found] == [["net", "rate", "extra", "strict", "options"], ["self", "cls"], ["url"]]
    assert [f.return_type for f in found] == ['"Money"', None, None]
    assert found[0].dependencies == ["helper", "inner", "round", "tax"]
    assert found[0].body_code.startswith("def price(self") and found[0].body_code.split("\n")[1].startswith("        def inner")
    assert found[2].body_code.startswith("async def") and (found[2].start_line, found[2].end_line) == (7, 8)


def test_equal_structure_has_equal_fingerprints():
    a, b, c = parsed("def a(x):\n  y = x + 1\n  return y\ndef b(k):\n  z = k + 2\n  return z\ndef c(k):\n  return k\n")
    assert a.fingerprint == b.fingerprint != c.fingerprint


@pytest.mark.parametrize(
    "body, stub", [("pass", True), ("...", True), ('"""doc"""', True), ('"""doc"""\n    pass', True), ("return 1", False), ("raise NotImplementedError", False), ("x = ...", False)]
)
def test_stubs(body, stub):
    assert syntax.functions(f"def f():\n    {body}\n")[0].is_stub is stub


def test_abstract_methods_are_stubs():
    found = parsed("class A:\n    @abc.abstractmethod\n    def f(self): return 1\n    @other\n    def g(self): return 1\n")
    assert [f.is_stub for f in found] == [True, False]


def test_blocks_that_do_not_parse_are_left_out():
    assert [(f.name, f.start_line) for f in syntax.functions("x = 1\ndef a():\n  return 1\ndef bad(:\n  x\n@deco\ndef c():\n  return 2\n")] == [("a", 2), ("c", 7)]
    assert syntax.functions("def broken(") == [] and syntax.functions("") == [] and syntax.functions("\0") == []
    assert syntax.statements("x = 1") == [] and syntax.count_statements("") == 0


def test_statement_counts():
    code = "def f(a):\n    x = 1\n    if a:\n        return 1\n    elif x:\n        pass\n    else:\n        del x\n    @d\n    def g(): return 2\n"
    assert syntax.count_statements(code) == 1 + 1 + 1 + 1 + 1 + 1 + 2 + 1
    assert syntax.count_statements("a = 1\nb = 2") == 2


def test_flat_order_parents_and_kinds():
    s = syntax.statements(dedent(
        """
        def f(xs):
            for x in xs:
                if x:
                    a = 1
                elif b:
                    c = 2
                else:
                    d = 3
            else:
                e = 4
            try:
                g = 5
            except E as err:
                h = 6
            finally:
                i = 7
            match xs:
                case [1]:
                    j = 8
            @deco
            def inner():
                return 1
        """
    ))
    assert [(x.index, x.parent) for x in s] == [(0, None), (1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, None), (7, 6), (8, 6), (9, 6), (10, None), (11, 10), (12, None)]
    assert s[0].kind == "for_statement" and s[10].kind == "match_statement" and s[12].kind == "decorated_definition"
    assert s[1].reads == ["x"] and s[6].reads == [] and s[12].writes == ["inner"] and s[12].reads == ["deco"]
    assert (s[12].start_line, s[12].end_line) == (21, 23)


def test_top_level_statements():
    s = syntax.top_level_statements("def f(a):\n    if a:\n        b = 1\n    return b\n")
    assert [(x.index, x.kind, x.end_line) for x in s] == [(0, "if_statement", 3), (1, "return_statement", 4)]


@pytest.mark.parametrize(
    "line, writes, reads",
    [
        ("a = b + c.d(e=f)", ["a"], ["b", "c", "d", "e", "f"]),
        ("a = b = c", ["a"], ["b", "c"]),
        ("a += b", ["a"], ["a", "b"]),
        ("a.x += b", [], ["a", "b", "x"]),
        ("a[i] = b", [], ["b"]),
        ("(a, [b, *c]) = d", ["a", "b", "c"], ["d"]),
        ("a: int = b", ["a"], ["b"]),
        ("a: int", ["a"], []),
        ("(a := b)", ["a"], ["b"]),
        ("f(a := b)", [], ["a", "b", "f"]),
        ("import a.b, c as d", ["a", "d"], []),
        ("from m import a, b as c", ["a", "c"], []),
        ("with a as b, c: pass", ["b"], ["a", "c"]),
        ("while a: pass", [], ["a"]),
        ("return [x for x in y]", [], ["x", "y"]),
        ("del a", [], ["a"]),
        ("assert a, b", [], ["a", "b"]),
        ("global a", [], []),
        ("g = lambda q: q + r", ["g"], ["q", "r"]),
    ],
)
def test_writes_and_reads(line, writes, reads):
    s = syntax.statements(f"def f():\n    {line}\n")[0]
    assert (s.writes, s.reads) == (writes, reads)


def test_edges_of_small_functions():
    assert edges("def f(a):\n  x = a\n  y = x\n  x = y\n  return x") == {(0, 1), (0, 3), (1, 2), (2, 3)}
    assert edges("def f(a):\n  for i in a:\n    t = i\n  return t") == {(0, 1), (1, 2)}
    assert edges("def f(a):\n  import os\n  p = os.path\n  a, b = p\n  return b") == {(0, 1), (1, 2), (2, 3)}


def test_one_bad_method_costs_only_itself():
    text = """import os

class A:
    x = 1

    def good(self, a):
        return a

    def bad(self:
        y = 2
        def inside(q):
            return q

    @deco
    def late(self, b):
        return '''it
  is''' + b

def after(c):
    return c

if broken(
    pass
"""
    found = syntax.functions(text)
    assert [(f.name, f.start_line, f.end_line) for f in found] == [("good", 6, 7), ("inside", 11, 12), ("late", 15, 17), ("after", 19, 20)]
    assert found[0].body_code == "def good(self, a):\n        return a" and found[2].parameters == ["b"]
    assert syntax.functions("    def f(:\n") == [] == syntax.functions(")\n}\n") and syntax.functions("def g(:\n" * 500) == []
