"""JSON in answers that does not parse as it stands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_ESCAPES = frozenset('"\\/bfnrtu')
_CLOSES = {"{": "}", "[": "]"}


def repaired(text: str | None) -> str | None:
    """JSON with wrong escapes undone, line breaks inside strings as spaces, other control characters and idle commas out, open strings and brackets closed."""
    if text is None:
        return None
    out, open_, inside, at = [], [], False, 0
    while at < len(text):
        c = text[at]
        if inside and c == "\\":
            after = text[at + 1 : at + 2]
            out.append(c + after if after in _ESCAPES and after else after)
            at += 1
        elif inside:
            inside = c != '"'
            out.append(" " if c in "\n\r" else "" if c < " " else c)
        elif c == '"':
            inside = True
            out.append(c)
        elif c in "}]":
            if open_ and open_[-1] == c:  # a bracket that closes nothing goes
                open_.pop()
                while out and (not out[-1].strip() or out[-1] == ","):
                    if out.pop() == ",":
                        break
                out.append(c)
        else:
            if c in _CLOSES:
                open_.append(_CLOSES[c])
            out.append(c)
        at += 1
    tail = ('"' if inside else "") + "".join(reversed(open_))
    body = "".join(out)
    return (re.sub(r",\s*$", "", body) if not inside else body) + tail


@F.pandas_udf(StringType())
def json_repaired(texts: pd.Series) -> pd.Series:
    """``repaired`` for a column; null stays null."""
    return texts.map(repaired)
