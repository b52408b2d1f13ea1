"""Examples in entries: which code is shown in use, and what it needs that it doesn't have."""

from __future__ import annotations

import ast
import builtins
import re
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_BLOCK = re.compile(r"```([\w+]*)[^\n]*\n(.*?)```", re.S)
#: Names of languages whose blocks are Python, and how names are usually imported (fixed values).
_PYTHON = ("", "python", "py", "pycon", "python3", "ipython")
IMPORTS = {"np": "import numpy as np", "pd": "import pandas as pd", "plt": "import matplotlib.pyplot as plt", "tf": "import tensorflow as tf", "sns": "import seaborn as sns"}


def is_placeholder(text: Column) -> Column:
    """Whether an example section says only that it has none."""
    return ~F.contains(text, F.lit("```")) & text.rlike("(?i)This section is incomplete|no example")


def shows_use(code: Column) -> Column:
    """Whether code shows itself in use: a session with its prompts, or a whole program of C or C++."""
    return F.contains(code, F.lit(">>>")) | (F.contains(code, F.lit("#include")) & code.rlike(r"\bmain\s*\("))


def code_of(text: str) -> list[str]:
    """The Python of a text's blocks; of sessions, what follows the prompts."""
    out = []
    for language, body in _BLOCK.findall(text):
        if language.lower() in _PYTHON:
            prompted = re.findall(r"(?m)^(?:>>>|\.\.\.)(?: (.*))?$", body) if ">>>" in body else None
            out.append("\n".join(prompted) if prompted is not None else body)
    return out


class _Names(ast.NodeVisitor):
    """Names that code binds, and names that it reads."""

    def __init__(self) -> None:
        self.bound: set[str] = set()
        self.read: set[str] = set()

    def generic_visit(self, node: ast.AST) -> None:
        if isinstance(node, ast.Name):
            (self.read if isinstance(node.ctx, ast.Load) else self.bound).add(node.id)
        elif isinstance(node, ast.alias):
            self.bound.add((node.asname or node.name).split(".")[0])
        elif isinstance(node, ast.arg):
            self.bound.add(node.arg)
        elif isinstance(name := getattr(node, "name", None), str):  # functions, classes, handlers, patterns
            self.bound.add(name)
        super().generic_visit(node)


def needs(text: str, package: str = "", name: str = "") -> list[str] | None:
    """What an example needs that it doesn't have (nothing: it is complete); None without code that can
    be read. name: the object that the entry documents; package: one whose name needs no import."""
    native = [body for language, body in _BLOCK.findall(text) if language in ("c", "cpp", "c++")]
    if native:
        code = "\n".join(native)
        if not code.strip():
            return None
        has = "#include" in code
        return [] if has and re.search(r"\bmain\s*\(", code) else ["a main function" if has else "#include and main"]
    names, parsed = _Names(), 0
    for code in code_of(text):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                names.visit(ast.parse(code))
            parsed += 1
        except SyntaxError:
            continue
    if not parsed:
        return None
    module, _, leaf = name.rpartition(".")
    how = lambda n: IMPORTS.get(n) or (f"from {module} import {n}" if module and n == leaf else f"import {n}" if n == (module or name).split(".")[0] else f"{n} (from earlier)")
    return [how(n) for n in sorted(names.read - names.bound - set(dir(builtins)) - {package})]


@F.pandas_udf(ArrayType(StringType()))
def example_needs(text: pd.Series, package: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else needs(t, p or "", n or "") for t, p, n in zip(text, package, name)])


def example_entries(entries: DataFrame) -> DataFrame:
    """Entries of kind example made of the Examples section of API entries (id, title, kind, text): id, title, text."""
    part = F.regexp_extract("text", r"(?is)(?:^|\n)#{1,6} *examples?:? *\n(.*?)(?=\n#{1,6} |\z)", 1)
    found = entries.select("id", "title", F.trim(part).alias("text")).where(F.contains("text", F.lit("```")) & ~is_placeholder(F.col("text")))
    return found.select("id", F.concat(F.regexp_replace("title", r"\s+\([^)]*\)$", ""), F.lit(" › Example")).alias("title"), "text")
