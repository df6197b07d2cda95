"""YAML 1.2 core schema, to JSON text. PyYAML reads 1.1, so its implicit types are replaced: only
true/false are booleans, dates and clock times stay text, 0o17 is octal, 017 decimal, 1e3 a number."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

try:
    import yaml
except ModuleNotFoundError:  # documents with data then raise when they are read
    yaml = None

#: Longest text that is remembered.
MEMO_TEXT = 4096

if yaml is not None:

    class Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

    for _tag, _pattern, _first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)

    def _int(loader, node):
        text = node.value
        return int(text[2:], 8) if text.startswith("0o") else int(text, 16) if text.startswith("0x") else int(text)

    def _float(loader, node):
        text = node.value.lower()
        return float(text.replace(".inf", "inf").replace(".nan", "nan"))

    Core.add_constructor("tag:yaml.org,2002:int", _int)
    Core.add_constructor("tag:yaml.org,2002:float", _float)


def load(text: str):
    """The value of one YAML document; null for none."""
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    return yaml.load(text, Core)


def _plain(value):
    if isinstance(value, dict):
        return {_key(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return None  # document code sees what is not finite as null
        return int(value) if value.is_integer() and abs(value) < 2**63 else value
    return value if isinstance(value, (str, int, bool)) or value is None else str(value)


def _key(k) -> str:
    return "true" if k is True else "false" if k is False else "null" if k is None else str(k)


def to_json(text: str) -> str:
    return json.dumps(_plain(load(text)), ensure_ascii=False)


@lru_cache(maxsize=4096)
def _mapping_json(text: str) -> str | None:
    """The JSON of a text's mapping, null for none, None for anything else; equal texts are read once."""
    value = load(text)
    return json.dumps(None if value is None else _plain(value), ensure_ascii=False) if value is None or isinstance(value, dict) else None


def mapping(text: str, what: str) -> dict:
    """The mapping a YAML text holds; empty text is an empty one, anything else an error."""
    found = _mapping_json(text) if len(text) <= MEMO_TEXT else _mapping_json.__wrapped__(text)
    if found is None:
        raise ValueError(f"{what} must be a mapping")
    return json.loads(found) or {}
