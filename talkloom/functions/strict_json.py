"""Strict RFC 8259 parsing on top of the standard library."""

from __future__ import annotations

import json


def _reject(token: str):
    raise ValueError(f"not a JSON value: {token}")


def _long_int(digits: str) -> int:
    return int(digits[:4000])


_STRICT = json.JSONDecoder(parse_constant=_reject)
_LONG = json.JSONDecoder(parse_constant=_reject, parse_int=_long_int)


def parse_strict(text: str):
    """The value of a text that is exactly one JSON value; raises ``ValueError`` otherwise.

    NaN and Infinity, byte-order marks, raw control characters and anything after the value are
    errors. Integers of any length are accepted. Nesting beyond the interpreter's recursion limit
    (about a thousand levels) counts as an error, as RFC 8259 section 9 allows.
    """
    try:
        return _STRICT.decode(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    except ValueError as error:
        if "integer string conversion" in str(error):
            return _LONG.decode(text)
        raise


def json_type(value) -> str:
    """The JSON type name of a parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"
