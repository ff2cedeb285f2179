"""Top-level names of Python files (path, content), parsed in tasks by the standard library."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, name string, kind string, line int, end_line int, exported boolean"


def _names(tree: ast.Module) -> tuple[list[tuple[str, str, int, int]], set[str] | None]:
    """(name, kind, first line, last line) of top-level definitions, and __all__ where it is a list of strings."""
    found, every = [], None
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            found.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    if target.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                        every = {e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
                    else:
                        found.append((target.id, "constant" if target.id.isupper() else "variable", node.lineno, node.end_lineno))
    return found, every


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, line, end_line, exported) of each file; what does not parse, and null contents, give nothing.

    Exported is what __all__ names, or without it what does not begin with an underscore.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found, every = _names(ast.parse(content or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(path, *x, x[0] in every if every is not None else not x[0].startswith("_")) for x in found]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "name", "kind", "line", "end_line", "exported"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
