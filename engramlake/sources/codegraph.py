"""Symbols, calls and imports of source files, as relations."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("target", "node_modules", ".git", "vendor", "__pycache__", ".venv")

_RUST_ITEM = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|mod)\s+(\w+)", re.M)
_RUST_USE = re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)", re.M)
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_RUST_WORDS = {"if", "while", "for", "match", "return", "fn", "loop", "Some", "Ok", "Err", "None"}


def python_symbols(path: str, text: str) -> list[tuple]:
    """(path, what, name, owner, line) for definitions, calls and imports; a file that doesn't parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append((path, "class" if isinstance(child, ast.ClassDef) else "function", child.name, owner, child.lineno))
                inner = child.name
            elif isinstance(child, ast.Import):
                out.extend((path, "import", a.name, owner, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append((path, "import", child.module or ".", owner, child.lineno))
            elif isinstance(child, ast.Call):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr if isinstance(child.func, ast.Attribute) else None
                if name:
                    out.append((path, "call", name, owner, child.lineno))
            visit(child, inner)

    visit(tree, None)
    return out


def rust_symbols(path: str, text: str) -> list[tuple]:
    """The same for Rust, by its item keywords; a call belongs to the function that starts last before it."""
    line = lambda at: text.count("\n", 0, at) + 1
    items = [(m.start(), m[1], m[2]) for m in _RUST_ITEM.finditer(text)]
    out = [(path, "function" if k == "fn" else k, name, None, line(at)) for at, k, name in items]
    out += [(path, "import", m[1], None, line(m.start())) for m in _RUST_USE.finditer(text)]
    functions = [(at, name) for at, k, name in items if k == "fn"]
    for m in _CALL.finditer(text):
        owner = next((name for at, name in reversed(functions) if at < m.start()), None)
        if m[1] not in _RUST_WORDS and owner and not re.search(r"fn\s+$", text[max(0, m.start() - 8) : m.start()]):
            out.append((path, "call", m[1], owner, line(m.start())))
    return out


def read_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".py", ".rs")) -> DataFrame:
    """(path, content) of source files below ``root``, vendored folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    skipped = "|".join(re.escape(s) for s in SKIPPED)
    return files.where(~F.col("path").rlike(f"/({skipped})/")).select("path", F.decode("content", "UTF-8").alias("content"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, what, name, owner, line) over all files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, text in zip(p["path"], p["content"]):
                rows += (python_symbols if path.endswith(".py") else rust_symbols)(path, text or "")
            yield pd.DataFrame(rows, columns=["path", "what", "name", "owner", "line"]).astype({"line": "int64"})

    return files.select("path", "content").mapInPandas(run, "path string, what string, name string, owner string, line long")


def edges(found: DataFrame) -> DataFrame:
    """(src, dst, rtype): a call becomes ``uses`` where its name is defined once and isn't the caller; an import
    becomes ``depends_on`` from the file."""
    defined = found.where(F.col("what").isin("function", "class", "struct")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("name")
    calls = found.where((F.col("what") == "call") & F.col("owner").isNotNull() & (F.col("owner") != F.col("name"))).join(defined, "name")
    uses = calls.select(F.col("owner").alias("src"), F.col("name").alias("dst"), F.lit("uses").alias("rtype"))
    imports = found.where("what = 'import'").select(F.col("path").alias("src"), F.col("name").alias("dst"), F.lit("depends_on").alias("rtype"))
    return uses.union(imports).distinct()
