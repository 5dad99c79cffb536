"""Call names, concept extraction profiles and notebooks."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from conceptmine.operators import code
from conceptmine.sources import notebooks
from conceptmine.streaming.convert import scripts, start_conversion

MODULE = '''
import x

class Outer(Gate, lib.Base):
    """Outer class.

    More text."""

    def method(self):
        """Method doc."""

    class Nested:
        """Nested doc."""


@deprecate
def helper(a):
    """Helper\nline two."""
    def inner():
        """Inner doc."""
    return a


def _private():
    """no"""


def get_value():
    """no"""


async def later():
    """not taken"""
    def inside():
        """Inside doc."""


class Plain:
    pass
'''


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_call_names(spark):
    scripts = files(
        spark, ("a.py", "foo(bar.baz(1))\nx[0](2)\nfoo()\n(lambda: q())()"), ("b.py", "def ("), ("c.py", "x = 1"),
        ("d.py", "f(\0)"), ("e.py", None))
    got = sorted(map(tuple, code.call_names(scripts).collect()))
    assert got == [("a.py", "baz"), ("a.py", "foo"), ("a.py", "q")]


def test_no_calls_at_all(spark):
    assert code.call_names(files(spark, ("a.py", "x = (1)"))).collect() == []


def test_class_and_function_profile(spark):
    path = "qiskit/circuit/library/mod.py"
    rows = code.extract_concepts_ordered(files(spark, (path, MODULE)), code.PROFILE_A).orderBy("pos").collect()
    names = [r["name"].split(".")[-1] for r in rows]
    assert names == ["Outer", "Nested", "helper", "inner", "inside"]
    outer = rows[0]
    assert outer["name"] == "/qiskit/qiskit.circuit.library.mod.Outer"
    assert (outer["type"], outer["is_target_subclass"], outer["base_classes"]) == ("Class", True, ["Gate"])
    assert outer["summary"] == "Outer class." and outer["docstring"] == "Outer class.\n\nMore text."
    helper = rows[2]
    assert helper["type"] == "Function" and helper["is_target_subclass"] is None
    assert helper["summary"] == "Helper line two."
    # the decorator is not part of the definition's source
    assert helper["source_code"].startswith("def helper(a):") and helper["source_code"].endswith("return a")


def test_which_files_a_profile_reads(spark):
    base = "qiskit/circuit/library/"
    rows = [(base + p, MODULE) for p in ("a.py", "__init__.py", "test_x.py", "templates/b.py", "x/standard_gates/c.py", "d.txt")]
    rows += [("other/e.py", MODULE), (base + "tiny.py", "class A:\n    '''Doc.'''")]
    got = code.select_modules(files(spark, *rows), code.PROFILE_A).select("path").collect()
    assert [r[0] for r in got] == [base + "a.py"]


def test_class_profile_takes_all_documented_classes(spark):
    found = code.extract_concepts(files(spark, ("pennylane/templates/m.py", MODULE)), code.PROFILE_B)
    assert sorted(r["name"] for r in found.collect()) == [
        "/pennylane/pennylane.templates.m.Nested", "/pennylane/pennylane.templates.m.Outer"]


def test_first_definition_of_a_name_wins(spark):
    text = "class A:\n    '''First.'''\n\nclass A:\n    '''Second.'''\n" + "# filler\n" * 10
    found = code.extract_concepts(files(spark, ("pennylane/templates/m.py", text)), code.PROFILE_B).collect()
    assert [r["summary"] for r in found] == ["First."]


API = '''
class Box:
    def method(self):
        """Method. Two. Three."""

def pub():
    """[Qmod core-library function]

    Public one."""

def empty():
    """[Qmod core-library function]."""
'''


def public(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_public_functions_only(spark):
    modules = files(spark, ("open_library/functions/a.py", API))
    found = code.extract_concepts(modules, code.PROFILE_C, public(spark, "pub", "method", "empty", "gone"))
    rows = {r["name"].split(".")[-1]: r for r in found.collect()}
    assert set(rows) == {"pub", "method"}
    assert rows["method"]["summary"] == "Method. Two."
    assert rows["pub"]["summary"] == "Public one." and rows["pub"]["type"] is None
    gap = {tuple(r) for r in code.api_gap(found, public(spark, "pub", "method", "empty", "gone")).collect()}
    assert gap == {("pub", "documented"), ("method", "documented"), ("empty", "missing"), ("gone", "missing")}


@pytest.mark.parametrize("names, expected", [(("pub",), 1), (("pub", "gone"), 2)])
def test_later_folder_is_read_only_while_names_are_missing(spark, names, expected):
    modules = files(spark, ("open_library/functions/a.py", API), ("qmod/builtins/functions/b.py", API))
    assert code.extract_concepts(modules, code.PROFILE_C, public(spark, *names)).count() == expected


def test_profile_without_names_is_an_error(spark):
    with pytest.raises(ValueError):
        code.extract_concepts(files(spark, ("open_library/functions/a.py", API)), code.PROFILE_C)


def notebook(*cells):
    return json.dumps({"cells": [dict(zip(("cell_type", "source", "execution_count"), c)) for c in cells]})


def test_notebook_conversion(spark):
    text = notebook(
        ("markdown", ["# T\n", "x"]), ("code", "%matplotlib inline\n!ls 'a'\ny = !pwd\nx = foo(1) % 2\nfoo?", 3),
        ("code", ["%%bash\n", "echo hi"], None), ("code", "[1, 2]", 0), ("raw", "skip"))
    old = json.dumps({"worksheets": [{"cells": [{"cell_type": "code", "input": ["f()"], "prompt_number": 2}]}]})
    df = files(spark, ("a/b.ipynb", text), ("c.ipynb", "{bad"), ("d.ipynb", '{"x": 1}'), ("e.ipynb", old))
    got = {r["path"]: r["text"] for r in notebooks.convert(df).collect()}
    assert got["c.py"] is None and got["d.py"] is None
    head = "#!/usr/bin/env python\n# coding: utf-8\n"
    assert got["e.py"] == head + "\n# In[2]:\n\n\nf()\n\n"
    assert got["a/b.py"] == head + (
        "\n# # T\n# x\n"
        "\n# In[3]:\n\n\nget_ipython().run_line_magic('matplotlib', 'inline')\nget_ipython().system('ls \\'a\\'')\n"
        "y = get_ipython().getoutput('pwd')\nx = foo(1) % 2\nget_ipython().run_line_magic('pinfo', 'foo')\n\n"
        "\n# In[ ]:\n\n\nget_ipython().run_cell_magic('bash', '', 'echo hi\\n')\n\n"
        "\n# In[ ]:\n\n\n[1, 2]\n\n")
    compile(got["a/b.py"], "a/b.py", "exec")


def test_incremental_conversion(spark):
    nb = spark.sql("""SELECT * FROM VALUES
      ('a.ipynb', timestamp'2024-01-02', '{"cells": []}'), ('b.ipynb', timestamp'2024-01-01', '{"cells": []}'),
      ('c.ipynb', timestamp'2024-01-01', '{'), ('d.ipynb', timestamp'2024-01-01', '{"cells": []}')
      AS t(path, modified, text)""")
    done = spark.sql("""SELECT * FROM VALUES ('a.py', timestamp'2024-01-01'), ('b.py', timestamp'2024-01-01')
      AS t(path, converted)""")
    statuses = notebooks.conversion_status(nb, done)
    assert {r["path"]: r["status"] for r in statuses.collect()} == {
        "a.ipynb": "SUCCESS", "b.ipynb": "SKIPPED", "c.ipynb": "ERROR", "d.ipynb": "SUCCESS"}
    assert notebooks.status_counts(statuses).first().asDict() == {"success": 2, "skipped": 1, "error": 1}
    assert sorted(r["path"] for r in notebooks.pending(nb, done).collect()) == ["a.ipynb", "c.ipynb", "d.ipynb"]


def test_all_worksheets_are_read(spark):
    old = json.dumps({"worksheets": [
        {"cells": [{"cell_type": "code", "input": ["a(1)"], "prompt_number": 1}]}, {},
        {"cells": [{"cell_type": "code", "input": "b(2)", "prompt_number": 2}]}]})
    df = spark.createDataFrame([("o.ipynb", old)], "path string, text string")
    text = notebooks.convert(df).first()["text"]
    assert "a(1)" in text and "b(2)" in text


def test_shell_forms_keep_the_notebook(spark):
    forms = [
        "!pip install \\\n  thing", "\n\n%%bash\necho hi", "x = [1,\n %name\n]" , "    indented(1)\n    also(2)", ">>> prompt(1)\n... ",
        "obj.*load*?", "f??", "%timeit?", "In [1]: numbered(1)", "text = \"\"\"\n!not a command\n%nor this\n\"\"\"\n%time run(1)",
        "name = 7\nx = (9\n%name)", "if x:\n    !ls\n    y = %sx pwd", "out = !ls | wc", "# 100% done!\nplain(1)"]
    df = spark.createDataFrame([(f"{i}.ipynb", notebook(("code", f, 1), ("code", "keep(1)", 2))) for i, f in enumerate(forms)],
                               "path string, text string")
    got = {r["path"]: r["text"] for r in notebooks.convert(df).collect()}
    for i, form in enumerate(forms):
        text = got[f"{i}.py"]
        assert "keep(1)" in text
        if form != "x = [1,\n %name\n]":  # no Python in any reading
            ast.parse(text)
    assert "system('pip install    thing')" in got["0.py"]
    assert "run_cell_magic('bash', '', 'echo hi\\n')" in got["1.py"]
    assert "\nindented(1)\nalso(2)" in got["3.py"] and "\nprompt(1)" in got["4.py"] and "\nnumbered(1)" in got["8.py"]
    assert "('psearch', 'obj.*load*')" in got["5.py"] and "('pinfo2', 'f')" in got["6.py"] and "('pinfo', '%timeit')" in got["7.py"]
    assert "\n!not a command\n%nor this\n" in got["9.py"] and "run_line_magic('time', 'run(1)')" in got["9.py"]
    assert "x = (9\n%name)" in got["10.py"]


def test_stream_converts_new_and_changed_notebooks_once(spark, tmp_path):
    import os
    root, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    (root / "p").mkdir(parents=True)

    def put(name, text, at):
        (root / "p" / f"{name}.ipynb").write_text(text)
        os.utime(root / "p" / f"{name}.ipynb", (at, at))

    def run():
        start_conversion(spark, str(root), str(out), str(ckpt)).awaitTermination(60)
        written = spark.read.option("basePath", str(out)).parquet(str(out)) if out.exists() else None
        newest = {r.path: r.text.split("\n")[-3] for r in scripts(spark, str(out)).collect()}
        return written.count(), newest

    put("one", notebook(("code", "f(1)", 1)), 1000)
    put("two", notebook(("code", "f(2)", 1)), 1001)
    put("bad", "{broken", 1002)
    assert run() == (2, {"p/one.py": "f(1)", "p/two.py": "f(2)"})
    assert run()[0] == 2  # nothing new
    put("one", notebook(("code", "f(11)", 1)), 2000)  # the same name, changed
    put("three", notebook(("code", "f(3)", 1)), 500)  # new, with an old time
    want = (4, {"p/one.py": "f(11)", "p/two.py": "f(2)", "p/three.py": "f(3)"})
    assert run() == want and run() == want
    # a batch that was written but not committed runs again, and adds nothing
    commits = sorted((ckpt / "stream" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == want
    put("bad", notebook(("code", "f(4)", 1)), 3000)  # readable now
    assert run()[0] == 5
