"""Arguments of the functions: tagged values, their JSON, and signatures."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

# The tags of argument values and the names of argument types.
TAGS = ("int", "string", "bool", "float", "timestamp", "interval", "column")


class ArgumentError(ValueError):
    """Wrong number, name or type of arguments."""


@dataclass(frozen=True)
class Arg:
    kind: str
    value: Any

    @property
    def is_scalar(self) -> bool:
        return self.kind != "column"

    @classmethod
    def of(cls, value: Any) -> Arg:
        """A tagged argument from a plain Python value."""
        if isinstance(value, Arg):
            return value
        for kind, types in (("bool", bool), ("int", int), ("float", float), ("string", str)):
            if isinstance(value, types):
                return cls(kind, value)
        raise ArgumentError(f"unsupported argument {value!r}")


def from_json(text: str | None, named: bool = False):
    """``[{"type": "string", "value": "a"}, ...]`` -> list of Arg; with ``named`` each also has a "name" -> list of pairs."""
    items = json.loads(text) if text else []
    for x in items:
        if x.get("type") not in TAGS:
            raise ArgumentError(f"unknown argument type {x.get('type')!r}")
    return [(x["name"], Arg(x["type"], x["value"])) for x in items] if named else [Arg(x["type"], x["value"]) for x in items]


@dataclass(frozen=True)
class Parameter:
    arg_type: str
    name: str | None = None
    default: Any = None

    def to_dict(self) -> dict:
        default = None if self.default is None else {"type": Arg.of(self.default).kind, "value": self.default}
        return {"name": self.name, "default": default, "arg_type": self.arg_type}


def signatures_json(signatures: tuple[tuple[Parameter, ...], ...]) -> str:
    return json.dumps([{"parameters": [p.to_dict() for p in s]} for s in signatures], separators=(",", ":"))


def scalars(args) -> list[Arg]:
    """Positional arguments without the table operand's columns."""
    return [a for a in map(Arg.of, args or ()) if a.is_scalar]


def names_of(text: str) -> list[str]:
    """Comma-separated names, trimmed, without empty ones."""
    return [x.strip() for x in text.split(",") if x.strip()]
