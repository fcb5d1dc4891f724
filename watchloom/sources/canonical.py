"""The canonical form of a JSON payload, and its digest.

Keys are sorted, white space goes, the last of repeated keys stays, numbers keep
their literals (``1.50`` is not ``1.5``), and what a collector adds to a record is left
out.  Any single JSON value has a form, not only an object.  Strings are written with
``<``, ``>``, ``&`` and the two line separators as ``\\u`` escapes, control characters
as short or ``\\u00`` escapes and all else as it is.

Python parses the text once, in Arrow batches of the tasks; memory is that of one
payload.  Texts that are no JSON, or nested deeper than 900 levels, have none.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Paths that a collector may change although the record is the same.
COLLECTED = (("agent", "ephemeral_id"), ("event", "created"), ("log", "file", "path"), ("log", "file", "inode"), ("log", "file", "device_id"))

#: Levels of nesting that are read.
DEEPEST = 900

_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPED = re.compile('["\\\\<>&\u2028\u2029\x00-\x1f\ud800-\udfff]')


class Literal(str):
    """A number as it is written."""


def _refuse(name: str) -> None:
    raise ValueError(name)


_READER = json.JSONDecoder(parse_float=Literal, parse_int=Literal, parse_constant=_refuse)


def _escape(m: re.Match[str]) -> str:
    c = m[0]
    # half of a surrogate pair is no character
    return _SHORT.get(c) or ("\ufffd" if "\ud800" <= c <= "\udfff" else f"\\u{ord(c):04x}")


def _quoted(s: str) -> str:
    return f'"{_ESCAPED.sub(_escape, s)}"'


def _written(value: Any, out: list[str], depth: int) -> None:
    if depth > DEEPEST:
        raise RecursionError
    if isinstance(value, Literal):
        out.append(value)
    elif isinstance(value, str):
        out.append(_quoted(value))
    elif value is None or isinstance(value, bool):
        out.append({None: "null", True: "true", False: "false"}[value])
    elif isinstance(value, dict):
        # code points sort as their UTF-8 bytes do
        for i, k in enumerate(sorted(value)):
            out.append(("," if i else "{") + _quoted(k) + ":")
            _written(value[k], out, depth + 1)
        out.append("}" if value else "{}")
    else:
        for i, v in enumerate(value):
            out.append("," if i else "[")
            _written(v, out, depth + 1)
        out.append("]" if value else "[]")


def canonical(text: str | None) -> str | None:
    """The canonical form of one JSON text; None if it is none."""
    if text is None:
        return None
    try:
        value = _READER.decode(text)
        for path in COLLECTED:
            owner = value
            for key in path[:-1]:
                owner = owner.get(key) if isinstance(owner, dict) else None
            if isinstance(owner, dict):
                owner.pop(path[-1], None)
        out: list[str] = []
        _written(value, out, 0)
    except (ValueError, RecursionError):
        return None
    return "".join(out)


@F.pandas_udf(T.StructType([T.StructField("canonical", T.StringType()), T.StructField("digest", T.StringType())]))
def canonical_payload(texts: pd.Series) -> pd.DataFrame:
    """The canonical forms and their SHA-256."""
    forms = [canonical(t) for t in texts]
    return pd.DataFrame({"canonical": pd.Series(forms, dtype=object), "digest": pd.Series([None if f is None else hashlib.sha256(f.encode()).hexdigest() for f in forms], dtype=object)})


def with_payload_hash(df: DataFrame, j: str = "payload") -> DataFrame:
    """df with payload_hash: SHA-256 of the payload's canonical form; null if it is no single JSON value."""
    return df.withColumn("payload_hash", canonical_payload(F.col(j))["digest"])
