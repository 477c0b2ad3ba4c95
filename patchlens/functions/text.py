"""Column helpers for text: Python-compatible trim, normalisation, fence cleanup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip()/split() treat as whitespace, as one regex class
# that Java regex and RE2 read the same way.
PY_WS_CLASS = r"[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]"

# ---- fixed values (must equal the reference behaviour)
EXPLANATION_DELIMITER = "---EXPLANATION---"
NO_BUGS_SENTINEL = "NO BUGS FOUND"
REQUEST_HEAD = (
    "\n"
    "    You are a senior software engineer.\n"
    "    The following code has a bug.\n"
    "    1. Provide only the fixed code without extra explanation.\n"
    "    2. Provide a detailed explanation of what was changed (after the fixed code, "
    "separated by a delimiter '---EXPLANATION---').\n"
    "    3. If no bugs were found, the explanaton should be \"NO BUGS FOUND\".\n"
    "\n"
    "    Code:\n"
    "    "
)
REQUEST_TAIL = "\n    "
# three cleanup steps on a reply's code part, each followed by a strip
FENCE_OPEN_PATTERN = r"(?md)^```(?:python)?"
FENCE_CLOSE_PATTERN = r"(?md)```$"
LABEL_PATTERN = r"(?iu)\AFixed Code:" + PY_WS_CLASS + "*"
# ---- end of fixed values


def apart(c: Column) -> Column:
    """``c`` as it is. Its lambda makes Spark compile the projection it is in by itself, in small methods; many choices in one method with
    the operators around them pass 8,000 bytes, and such a method the JVM interprets for every row."""
    return F.get(F.transform(F.array(c), lambda x: x), 0)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(c, rf"\A{PY_WS_CLASS}+|{PY_WS_CLASS}+\z", "")


def normalise(c: Column) -> Column:
    """Strip, then lower-case."""
    return F.lower(py_strip(c))


def clean_code_block(c: Column) -> Column:
    """Drop line-start fences (optional ``python`` tag), line-end fences, and a
    leading ``Fixed Code:`` label (any case); strip after every step."""
    c = py_strip(F.regexp_replace(c, FENCE_OPEN_PATTERN, ""))
    c = py_strip(F.regexp_replace(c, FENCE_CLOSE_PATTERN, ""))
    return py_strip(F.regexp_replace(c, LABEL_PATTERN, ""))


def first_line(c: Column) -> Column:
    """Text up to the first line break (``\n``, ``\r\n`` or ``\r``, as Python text mode reads)."""
    return F.element_at(F.split(c, r"\r\n|\r|\n", 2), 1)
