"""Definition extraction and metrics on a literal Python file."""

from repolens.operators.code_metrics import (extract_functions, extract_top_level,
                                             parse_definitions, parse_top_level)

SRC = '''import os
from sys import path

LIMIT = 3


def outer(a, b):
    """Größe prüfen."""  # non-ASCII text before the code
    import json
    # a comment
    total = 0
    for i in range(a):
        if i > b:
            total += helper(i)
        elif i == b:
            total -= 1
    while total > LIMIT:
        total = os.path.join(str(total), "x")
    def inner(x):
        return x * 2
    return inner(total)


class Box:
    size = 2

    def area(self):
        try:
            return self.size ** 2
        except Exception:
            return 0


print(LIMIT)
'''


def test_parse_definitions_metrics():
    rows = {(r["type"], r["name"]): r for r in parse_definitions("m.py", SRC)}
    assert set(rows) == {("function", "outer"), ("function", "inner"), ("class", "Box"),
                         ("function", "area")}
    o = rows[("function", "outer")]
    assert o["lines_of_code"] == 15
    # 1 + for + if + elif (a nested If) + while
    assert o["cyclomatic_complexity"] == 5
    assert o["control_depth"] == 3                     # for > if > elif
    assert o["calls"] == ["range", "helper", "os.path.join", "str", "inner"]
    assert o["number_of_function_calls"] == 5
    assert o["imports"] == ["import json"]
    assert o["docstring"] == "Größe prüfen."
    assert o["comments"] == ["# non-ASCII text before the code", "# a comment"]
    assert o["location"] == {"start": {"line": 7, "character": 0}, "end": {"line": 21, "character": 23}}
    assert o["code"].startswith("def outer(a, b):") and o["code"].endswith("return inner(total)")
    a = rows[("function", "area")]
    assert a["cyclomatic_complexity"] == 2 and a["location"]["start"] == {"line": 27, "character": 4}
    assert rows[("function", "inner")]["code"] == "def inner(x):\n        return x * 2"


def test_parse_top_level_and_bad_files():
    t = parse_top_level("m.py", SRC)
    assert t["imports"] == ["import os", "from sys import path", "import json"]
    assert t["code"] == ["LIMIT = 3", "size = 2", "print(LIMIT)"]
    assert parse_definitions("bad.py", "def (:") == []


def test_extract_functions_distributed(spark):
    files = spark.createDataFrame([("o", "r", "m.py", SRC), ("o", "r", "bad.py", "def (:"),
                                   ("o", "r", "n.py", None)],
                                  "repo_owner string, repo_name string, file_path string, content string")
    fns = extract_functions(files)
    assert fns.count() == 4
    top = extract_top_level(files).collect()
    assert {r.file_path: r.file_extension for r in top} == {"m.py": ".py", "bad.py": ".py", "n.py": ".py"}


def test_columns_are_characters_and_lines_are_the_parsers():
    src = "s = \"é\" + helper(1)\n\x0cdef f():\n    x = '# no'  # yes\n    return g('ü', h())\n"
    (f,) = parse_definitions("m.py", src)
    assert f["code"].startswith("def f():") and f["code"].endswith("h())")
    assert f["calls"] == ["g", "h"] and f["comments"] == ["# yes"] and f["lines_of_code"] == 3
    assert parse_top_level("m.py", src)["code"] == ['s = "é" + helper(1)']
    (g,) = parse_definitions("n.py", "def k(): return 'é' + helper(2)\n")
    assert g["calls"] == ["helper"] and g["location"]["end"]["character"] == len("def k(): return 'é' + helper(2)")


def test_deep_file_is_a_reject(spark):
    from repolens.operators.code_metrics import unparsable
    deep = "x = " + "-" * 100_000 + "1"
    files = spark.createDataFrame([("o", "r", "a.py", "def a(): pass\n"), ("o", "r", "deep.py", deep), ("o", "r", "bad.py", "def (:")],
                                  "repo_owner string, repo_name string, file_path string, content string")
    assert [r.name for r in extract_functions(files).collect()] == ["a"]
    assert {r.file_path for r in unparsable(files).collect()} == {"deep.py", "bad.py"}
