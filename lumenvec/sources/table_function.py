"""The engine as a table function of Spark SQL: SELECT * FROM find('FIND SIMILARITY(...)').

A Python table function can't run Spark jobs, so the call is replaced by a view before the statement goes to Spark: sql() compiles each find() call
to its lazy DataFrame, and the statement around it is planned together with it. The argument is $$text$$ or any constant expression of Spark SQL, which is evaluated first.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from ..session import Engine

_CALL = re.compile(r"\bfind\s*\(", re.I)
#: Texts, names and comments, in which nothing is a call; else one character.
_TOKEN = re.compile(r"""\$\$.*?\$\$|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|.""", re.S)


def _closed(statement: str, at: int) -> int:
    """Where the parenthesis that is open before at is closed."""
    depth = 1
    for m in _TOKEN.finditer(statement, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    raise ValueError("find(: the parenthesis isn't closed")


def sql(engine: Engine, statement: str, user: object = None) -> DataFrame:
    """Run a statement with find(...) as tables."""
    out, at = [], 0
    while at < len(statement):
        call = _CALL.match(statement, at)
        before = statement[at - 1 : at]
        if not call or before.isalnum() or before in ("_", "."):
            out.append(_TOKEN.match(statement, at)[0])
            at += len(out[-1])
            continue
        end = _closed(statement, call.end())
        text = statement[call.end() : end].strip()
        text = text[2:-2] if text.startswith("$$") and text.endswith("$$") else engine.spark.sql(f"SELECT {text}").first()[0]
        out.append(f"find_{uuid.uuid4().hex}")
        engine.frame(text, user).createOrReplaceTempView(out[-1])
        at = end + 1
    return engine.spark.sql("".join(out))
