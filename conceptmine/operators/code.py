"""Call names and documented definitions out of Python source text.

The only Python in the hot path is the parser call itself: it turns one text
into flat rows. Which rows count, how they are named and how their text is
cleaned is decided by column expressions, so Catalyst can prune and reorder.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptmine.functions import text as tx
from conceptmine.operators.ranking import first_wins
from conceptmine.session import materialize

# Characters of modules whose definitions are held at once, about.
BATCH_CHARS = 4_000_000

# Everything ast.parse raises on text that is not a program.
NOT_A_PROGRAM = (SyntaxError, ValueError, RecursionError, MemoryError)


def _parse(source: str) -> ast.AST | None:
    try:
        return ast.parse(source)
    except NOT_A_PROGRAM:
        return None


def _callees(source: str) -> list[str]:
    tree = _parse(source)
    if tree is None:
        return []
    funcs = [n.func for n in ast.walk(tree) if isinstance(n, ast.Call)]
    names = {f.id for f in funcs if isinstance(f, ast.Name)}
    return sorted(names | {f.attr for f in funcs if isinstance(f, ast.Attribute)})


@F.arrow_udf(T.ArrayType(T.StringType()))
def _callee_lists(texts: pa.Array) -> pa.Array:
    return pa.array([_callees(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))


def callees(text: Column) -> Column:
    """Sorted distinct callee names of a script, empty for text that does not parse.

    Text without an opening parenthesis holds no call and is not sent to Python.
    """
    return _callee_lists(F.when(F.contains(text, F.lit("(")), text))


def call_names(scripts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Distinct callee names per script: ``(path, element)``."""
    return scripts.select(F.col(path).alias("path"), F.explode(callees(F.col(text))).alias("element"))


# --- documented definitions ---------------------------------------------------

DEFINITION_SCHEMA = (
    "path string, pos int, kind string, def_name string, in_class boolean, "
    "bases array<string>, docstring string, source_code string"
)

# Docstring blocks without prose (fixed values): literal text blocks, drawings
# under a 'Circuit symbol:' line, and formulas.
DOC_BLOCKS = [
    re.compile(p, re.MULTILINE)
    for p in (
        r"(.. (code-block|parsed-literal):: text\n\n)(^\s+.*$\n?)+",
        r".*Circuit symbol:.*(?:\n\s*.. code-block:: text)?\n\n(^\s*.*[┌┐└┘├┤│─].*$\n?)+",
        r"(.. math::\n\n)(^\s+.*$\n?)+",
    )
]


def drop_doc_blocks(doc: str) -> str:
    for block in DOC_BLOCKS:
        doc = block.sub("", doc)
    return doc.strip()


def _definitions(source: str) -> Iterator[dict]:
    """Documented classes and plain functions, outer before inner, in text order."""
    tree = _parse(source)
    if tree is None:
        return
    lines = [m.encode() for m in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source)]

    def segment(node) -> str:
        rows = lines[node.lineno - 1:node.end_lineno]
        rows[-1] = rows[-1][:node.end_col_offset]
        rows[0] = rows[0][node.col_offset:]
        return b"".join(rows).decode()

    todo = [(tree, False)]
    while todo:
        node, in_class = todo.pop()
        is_class = isinstance(node, ast.ClassDef)
        if is_class or isinstance(node, ast.FunctionDef):
            doc = ast.get_docstring(node)
            if doc:
                bases = node.bases if is_class else []
                yield {
                    "kind": "Class" if is_class else "Function", "def_name": node.name,
                    "in_class": in_class, "docstring": doc, "source_code": segment(node),
                    "bases": [b.id for b in bases if isinstance(b, ast.Name)],
                }
        inside = in_class or is_class
        todo.extend((child, inside) for child in reversed(list(ast.iter_child_nodes(node))))


def definitions(modules: DataFrame, clean_docs: bool = False) -> DataFrame:
    """``(path, text)`` to one row per documented definition, ``pos`` = order in file."""
    arrow = pa.schema([
        ("path", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("def_name", pa.string()),
        ("in_class", pa.bool_()), ("bases", pa.list_(pa.string())), ("docstring", pa.string()),
        ("source_code", pa.string()),
    ])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, text in zip(batch.column("path"), batch.column("text")):
                path, text = path.as_py(), text.as_py()
                for pos, found in enumerate(_definitions(text)):
                    if clean_docs:
                        found["docstring"] = drop_doc_blocks(found["docstring"])
                    rows.append({"path": path, "pos": pos, **found})
                # a module is part of its definitions' sources, nested ones of several
                size += len(text)
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return modules.select("path", "text").where(F.col("text").isNotNull()).mapInArrow(parse, DEFINITION_SCHEMA)


@dataclass(frozen=True)
class Profile:
    """What one framework's extraction keeps and how it names concepts."""

    prefix: str
    subdirs: list[str]
    kinds: tuple[str, ...] = ("Class", "Function")
    exclude_parts: list[str] = field(default_factory=list)
    skip_files: list[str] = field(default_factory=lambda: ["__init__.py"])
    skip_prefix: str | None = None
    min_chars: int = 0
    clean_docs: bool = False
    api_functions: bool = False
    target_bases: list[str] | None = None
    dedup: bool = False


# Extraction profiles of the three mined frameworks (fixed values).
PROFILE_A = Profile(
    prefix="/qiskit/", subdirs=["qiskit/circuit/library/"],
    exclude_parts=["standard_gates", "templates"], skip_prefix="test_", min_chars=50,
    clean_docs=True, target_bases=["QuantumCircuit", "Gate"], dedup=True,
)
PROFILE_B = Profile(
    prefix="/pennylane/", subdirs=["pennylane/templates/"], kinds=("Class",), min_chars=50,
)
PROFILE_C = Profile(
    prefix="/classiq/", subdirs=["open_library/functions", "qmod/builtins/functions"],
    kinds=("Function",), api_functions=True,
)


def _in_subdir(path: Column, subdir: str) -> Column:
    return path.startswith(subdir.rstrip("/") + "/")


def _dir_rank(profile: Profile) -> Column:
    """Position of the search folder that holds a file, null outside all of them."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(profile.subdirs))):
        rank = F.when(_in_subdir(F.col("path"), profile.subdirs[i]), F.lit(i)).otherwise(rank)
    return rank


def select_modules(files: DataFrame, profile: Profile) -> DataFrame:
    """SDK files a profile reads.

    Runs before any parsing, so skipped files never reach a Python worker.
    """
    path = F.col("path")
    parts = F.split(path, "/")
    file_name = F.element_at(parts, -1)
    below = path
    for subdir in profile.subdirs:
        rest = F.substr(path, F.lit(len(subdir.rstrip("/")) + 2))
        below = F.when(_in_subdir(path, subdir), rest).otherwise(below)
    keep = _dir_rank(profile).isNotNull() & path.endswith(".py") & ~file_name.isin(profile.skip_files)
    if profile.exclude_parts:
        excluded = F.array(*[F.lit(p) for p in profile.exclude_parts])
        keep &= ~F.arrays_overlap(F.split(below, "/"), excluded)
    if profile.skip_prefix:
        keep &= ~file_name.startswith(profile.skip_prefix)
    if profile.min_chars:
        keep &= F.length(tx.strip(F.col("text"))) >= profile.min_chars
    return files.where(keep)


def concept_rows(files: DataFrame, profile: Profile, api_names: DataFrame | None = None) -> DataFrame:
    """Concept candidates with their order keys ``dir_rank, path, pos``; not yet unique by name.

    ``api_names(name)`` is the public-function list a profile with
    ``api_functions`` is limited to.
    """
    modules = select_modules(files, profile)
    defs = definitions(modules, profile.clean_docs).where(F.col("kind").isin(*profile.kinds))
    doc = F.col("docstring")
    if profile.api_functions:
        if api_names is None:
            raise ValueError("this profile needs the table of public names")
        wanted = api_names.select(F.col("name").alias("def_name")).distinct()
        defs = defs.join(wanted, "def_name", "left_semi")
        doc = tx.without_boilerplate(doc)
    else:
        free = ~F.col("in_class") & ~F.col("def_name").startswith("_") & ~F.col("def_name").startswith("get_")
        defs = defs.where((F.col("kind") == "Class") | free)
        doc = tx.strip(doc)
    defs = defs.withColumn("docstring", doc).where(F.col("docstring") != "")
    summary = tx.two_sentences(F.col("docstring")) if profile.api_functions else tx.first_paragraph(F.col("docstring"))

    is_class = F.col("kind") == "Class"
    typed = profile.target_bases is not None
    targets = F.array(*[F.lit(b) for b in profile.target_bases or [""]])
    # only the public-function profile walks its folders one after the other
    order_rank = _dir_rank(profile) if profile.api_functions else F.lit(0)
    name = F.concat(F.lit(profile.prefix), tx.module_path(F.col("path")), F.lit("."), F.col("def_name"))
    return defs.select(
        order_rank.alias("dir_rank"), "path", "pos", name.alias("name"), summary.alias("summary"),
        "docstring", "source_code",
        (F.col("kind") if typed else F.lit(None).cast("string")).alias("type"),
        F.when(F.lit(typed) & is_class, F.arrays_overlap("bases", targets)).alias("is_target_subclass"),
        F.when(F.lit(typed) & is_class, F.col("bases")).alias("base_classes"),
    )


def stop_when_covered(rows: DataFrame, api_names: DataFrame) -> DataFrame:
    """Drop rows of search folders that come after every public name is documented."""
    first_seen = rows.groupBy(F.element_at(F.split("name", r"\."), -1).alias("name")).agg(
        F.min("dir_rank").alias("seen"))
    never = 2**31 - 1
    last_needed = (
        api_names.select("name").distinct().join(first_seen, "name", "left")
        .agg(F.max(F.coalesce("seen", F.lit(never))))
    )
    return rows.where(F.col("dir_rank") <= last_needed.scalar())


def extract_concepts_ordered(files: DataFrame, profile: Profile, api_names: DataFrame | None = None) -> DataFrame:
    """All concepts of one framework, unique by name, with their order keys."""
    rows = concept_rows(files, profile, api_names)
    if profile.api_functions:
        rows = stop_when_covered(materialize(rows), api_names)  # parsed once, read twice
    return first_wins(rows, ["name"], [F.col("dir_rank"), F.split("path", "/"), F.col("pos")])


def extract_concepts(files: DataFrame, profile: Profile, api_names: DataFrame | None = None) -> DataFrame:
    return extract_concepts_ordered(files, profile, api_names).drop("dir_rank", "path", "pos")


def api_gap(concepts: DataFrame, api_names: DataFrame) -> DataFrame:
    """``(name, status)``: which public names were documented and which are missing."""
    found = concepts.select(tx.last_part(F.col("name"), ".").alias("name")).distinct()
    wanted = api_names.select("name").distinct().withColumn("wanted", F.lit(True))
    both = wanted.join(found.withColumn("found", F.lit(True)), "name", "full_outer")
    return both.select("name", F.when(F.col("found"), "documented").otherwise("missing").alias("status"))
