"""The canonical text of a node is the library's, for every kind and whatever is nested in it."""

import ast
import time

import pytest

from patchlens.operators import unparse as U
from patchlens.operators.extract import definitions

SOURCE = '''
@deco
class C(Base):
    """doc"""
    def m(self, p, /, q=1, *rest, key=2, **more) -> int:
        x = (q + 1) * -p ** 2 if q else not (a and (b or c) and d)
        return
    async def a(self):
        def inner(z): return [z, 1.5, 1e999, 2j, ..., None, b'x', u'y', 'it\\'s "quoted"']
        await inner(1)
if a < b <= c and not d in e:
    x, y = z[1:2, ::3], (1,)
    t[()] = t[1,] = t[a, b:c]
elif f(*g, h=1, **k).attr[0]:
    def nested(a, b):
        pass
    after = 1 .real
else:
    x += (yield_ := 3)
    for (i, j) in (1, 2), []: continue
    while x: break
    else: y
try: raise E from e
except (A, B) as err: raise
finally: del x
match p:
    case [1, *_]: z = lambda q: {**q, 'k': {1}}
s = f'{x} {n}' + f'{x!r:>{w}}' + f"it's {{}} {'q'}"
v = x.p.q @ w // 3 % 4 << 5 | ~6 & 7 ^ 8
'''


def test_texts_and_dumps_are_the_librarys():
    nodes = [n for n in ast.walk(ast.parse(SOURCE)) if isinstance(n, (ast.stmt, ast.expr)) and not isinstance(n, (ast.FormattedValue, ast.Slice))]
    assert len(nodes) > 150
    for n in nodes:
        assert U.unparse(n) == ast.unparse(n)
        if isinstance(n, ast.expr):
            assert U.dump(n) == ast.dump(n)


@pytest.mark.parametrize("source", ["x = " + "a + " * 200 + "b", "x = " + "f(" * 60 + "1" + ")" * 60, "x" + ".a" * 100])
def test_deep_nodes_are_left_to_the_library(source):
    node = ast.parse(source).body[0]
    assert U.unparse(node) == ast.unparse(node)


def test_definitions_are_found_breadth_first_in_every_container():
    source = ("def a():\n  def b(): pass\ntry:\n  def c(): pass\nexcept E:\n  def d(): pass\nelse:\n  def e(): pass\nfinally:\n  def f(): pass\n"
              "match x:\n  case 1:\n    def g(): pass\nasync def h():\n  def i(): pass\nwith x:\n  def j(): pass\n")
    walked = [n.name for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)]
    assert [n.name for n in definitions(source)] == walked and len(walked) == 9


def test_usual_statements_are_written_without_the_visitor():
    body = ast.parse("\n".join(f"x{k} = f{k}(a.b, 'c') + {k}\nif x{k} > {k}:\n    return_ = x{k} - 1" for k in range(500))).body

    def took(write):
        start = time.process_time()
        for n in body:
            write(n)
        return time.process_time() - start

    assert min(took(U.unparse) for _ in range(3)) * 2 < min(took(ast.unparse) for _ in range(3))
