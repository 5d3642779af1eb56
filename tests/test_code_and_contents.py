"""Code structure against Python's own parser, and contents pages against worked rows."""

import ast

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import code as rules
from gradeflow.operators import contents

PROGRAMS = [
    "def f(n):\n    if n < 2:\n        return 1\n    return n * f(n - 1)",
    "for i in range(3):\n    for j in range(i):\n        print(i, j)",
    "for i in a:\n    print(i)\nfor j in b:\n    print(j)",
    "if a:\n    x = 1\nelif b:\n    x = 2\nelse:\n    x = 3",
    "if a:\n    x = 1\nelse:\n    if b:\n        x = 2",
    "while True:\n    try:\n        x = int(input('go: '))\n        break\n    except ValueError:\n        pass\n    finally:\n        for k in x: print(k)",
    "class A(B):\n    def go(self):\n        return self.go()\n    def stop(self): return [x for x in self.y if x]",
    "async def go(x):\n    async with x as y:\n        await y\n    async for z in y:\n        yield z",
    "def g(a,\n      b=(1,\n         2)):\n    '''Doc with for and while:\n      if odd'''\n    with open(a) as h:  # for later: while\n        return sorted(h, key=lambda r: r[0])",
    "x = [\n    y\n    for y in z\n]\nif x:\n    print('it''s')",
    "s = 'if a: b'\nfor c in s: print(c)",
    "total = 0\nfor x in items:\n\tif x:\n\t\ttotal += x\n\n\tif total:\n\t\tbreak",
    "for i in a:\n    pass\nelse:\n    for j in b:\n        pass",
    "def outer():\n    def inner():\n        return outer()\n    return inner()",
    "@wraps(f)\ndef f(x): return f(x)",
    "x = 1 if y else 2\nif x: y = 3\nelse: y = 4",
    "a = b + \\\n    c\nif a > b:\n    pass",
    "data = {'a': 1,\n  'b': [i for i in range(3)]}\nwhile data:\n    data.pop()",
]
NO_PROGRAMS = [
    "Write a function that sorts a list", "for x in y\n    print(x)", "if a:\nprint(a)", "def f(x):\n    return x\n  y = 2", "Write for loops in Python", "  if a:\n    b",
    "Example:\n    if a:\n        b", "if (a:\n    b", "else:\n    x = 1", "What is it? if a: b", "for i in a:", "print x if y", "Use a loop. while x: y",
]


def by_parser(code):
    tree = ast.parse(code)
    seen = {"function": False, "class": False, "try": False, "with": False, "async": False, "lambda": False, "yield": False, "loops": 0, "ifs": 0, "nested_loop": False, "nested_if": False, "recursion": False, "comprehension": False}

    def walk(node, loops, ifs, names):
        kind = type(node).__name__
        seen["function"] |= kind in ("FunctionDef", "AsyncFunctionDef")
        seen["async"] |= kind == "AsyncFunctionDef"
        for name, kinds in {"class": "ClassDef", "try": "Try", "with": "With", "lambda": "Lambda"}.items():
            seen[name] |= kind == kinds
        seen["yield"] |= kind in ("Yield", "YieldFrom")
        seen["comprehension"] |= kind in ("ListComp", "SetComp", "DictComp", "GeneratorExp")
        if kind in ("For", "While"):
            seen["loops"] += 1
            seen["nested_loop"] |= loops > 0
            loops += 1
        if kind == "If":
            seen["ifs"] += 1
            seen["nested_if"] |= ifs > 0
            ifs += 1
        if kind in ("FunctionDef", "AsyncFunctionDef"):
            names = [*names, node.name]
        if kind == "Call" and names and isinstance(node.func, ast.Name):
            seen["recursion"] |= node.func.id == names[-1]
        for child in ast.iter_child_nodes(node):
            walk(child, loops, ifs, names)

    walk(tree, 0, 0, [])
    seen["used"] = seen["function"] or seen["class"] or seen["loops"] > 0 or seen["ifs"] > 0
    return seen


def test_structure_as_parsed(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(PROGRAMS)], "id int, code string")
    got = {r["id"]: r["s"].asDict() for r in rows.select("id", rules.structure(F.col("code")).alias("s")).collect()}
    for i, code in enumerate(PROGRAMS):
        want = by_parser(code)
        assert {k: got[i][k] for k in want} == want, code


def test_no_structure_in_what_does_not_parse(spark):
    for code in NO_PROGRAMS:
        with pytest.raises(SyntaxError):
            ast.parse(code)
    rows = spark.createDataFrame([(c,) for c in NO_PROGRAMS], "code string")
    got = rows.select("code", rules.structure(F.col("code"))["used"].alias("used")).collect()
    assert [r["code"] for r in got if r["used"]] == []


def test_coding_difficulty(spark):
    fenced = "```python\n{}\n```".format
    cases = [
        (None, 0, "beginner", None),
        ("", 0, "beginner", None),
        ("What is a list?", 0, "beginner", None),
        ("Write a program using recursion", 2 + 4, "intermediate", "hard_master"),
        ("What does it do?\n" + fenced(PROGRAMS[0]), 5 + 1, "intermediate", "hard_master"),
        ("Trace this:\n" + fenced("for i in a:\n    print(i)"), 3 + 2, "intermediate", "hard_intermediate"),
        (fenced(PROGRAMS[1]), 3, "beginner", "hard_advanced"),
        ("Fix and implement: for x in y while z", 2 + 3 + 2 + 4, "advanced", "advanced"),
        ("Why does this print? if", 2 + 3 + 1, "intermediate", "intermediate"),
        (fenced("if a:\n    b"), 1, "beginner", None),
        (fenced("x = " + "'y' " * 3) + "a" * 200_000, 0, "beginner", None),
        ("'" + "z" * 200_000 + "'\nif a: b", 2 + 1, "beginner", None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, text string")
    got = {r["id"]: (r["d"]["score"], r["d"]["level"], r["d"]["tag"]) for r in rows.select("id", rules.coding_difficulty(F.col("text")).alias("d")).collect()}
    for i, (text, *want) in enumerate(cases):
        assert got[i] == tuple(want), text and text[:80]


def entries(spark, text, **more):
    row = spark.createDataFrame([(text,)], "text string").select(contents.text_entries(F.col("text"), **more).alias("e")).first()
    return [tuple(e) for e in row["e"]]


def test_entries_with_dot_leaders(spark):
    text = "Contents\n1. Start ..... 3\n1.1 First steps .... 5\n\n1.1.1 Deep ..7\nAn exercise .... 9"
    assert entries(spark, text, next_line_too=True) == [("1. Start", 2, 0), ("1.1 First steps", 4, 1), ("1.1.1 Deep", 6, 2), ("An exercise", 8, 1)]
    assert entries(spark, text) == [("1. Start", 2, 0), ("1.1.1 Deep", 6, 2)]


def test_split_entries(spark):
    text = "Loops\nand more\n\n12\nPreface\n3\nLists . . .\n77\n" + "\n".join(f"filler {k}" for k in range(12)) + "\n5\n..\n90\nab\n91"
    got = entries(spark, text)
    # a line too far from its page starts no entry, the first within ten lines does
    assert got == [("Loops and more", 11, 0), ("Lists . .", 76, 0), ("filler 2 " + " ".join(f"filler {k}" for k in range(3, 12)), 4, 0)]
    assert entries(spark, None) == [] and entries(spark, "") == []
    assert entries(spark, "A title\n" + "9" * 30 + "\n4") == [("A title", 3, 0)]


def test_toc_parse(spark):
    good = "Contents\nA. Alpha ... 2\n\n1.1.1 Beta ... 4\n\nGamma\n3"
    pages = [
        (1, 0, "A book of many things"), (1, 1, good), (1, 2, "Plain text without numbers here"), (1, 3, "Contents\nLate\n9"),
        (2, 0, "Table of contents\nOne\n1\nTwo\n2"), (3, 0, "Only text here, nothing else"), (4, 20, good), (5, 0, None), (5, 1, "1 One .. 1\n\n2 Two .. 2\n\n3 Three .. 3\n\n4 Four .. 4\n9 8 7 6 5 4 3"),
    ]
    got = [tuple(r) for r in contents.toc_parse(spark.createDataFrame(pages, "document int, page int, text string")).orderBy("document", "place").collect()]
    assert [r for r in got if r[0] == 1] == [(1, 0, "A. Alpha", 1, 0), (1, 1, "Gamma", 2, 0), (1, 2, "1.1.1 Beta", 3, 1)]
    assert {r[0] for r in got} == {1, 5}
    assert contents.toc_parse(spark.createDataFrame([], "document int, page int, text string")).count() == 0


def test_toc_levels(spark):
    """As a fold over each document's entries, and by running values alone: a list that grows by each entry takes the square of a document's length."""
    import random

    from gradeflow.operators import catalogue

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(40), rng.choice([None, -2, 0, 1, 2, 3, 4, 9])) for i in range(300)]
    df = catalogue.toc_levels(spark.createDataFrame(rows, "document string, entry_id long, start_page long, level long"))
    want = []
    for d in ("a", "b", None):
        before = 0
        for place, (_, i, level) in enumerate(sorted((p, i, v) for k, i, p, v in rows if k == d)):
            before = min(before + 1, 3, 3 if level is None else level)
            want.append((str(d), place, i, before))
    assert sorted((str(r["document"]), *r[1:]) for r in df.collect()) == sorted(want)
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()
