"""What a caller asks for is checked before a plan is built, and answers are kept while the tables they came from stand."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Hashable

#: Bytes of one argument, and of one that lists many names.
MAX_ARGUMENT, MAX_LIST = 512, 4096

_KINDS = {"string": str, "integer": int, "boolean": bool, "object": dict}


def check_text(value: str, limit: int = MAX_ARGUMENT, decoded: bool = True) -> None:
    """Raises ValueError for an argument that is too long, holds a null, or could leave its folder; decoded: a per cent sign may stand for something else later, so it is refused."""
    if len(value.encode()) > limit:
        raise ValueError(f"longer than {limit} bytes")
    if "\0" in value:
        raise ValueError("holds a null byte")
    if decoded and "%" in value:
        raise ValueError("holds a per cent sign")
    up = value.replace("\\", "/")
    if "../" in up or up == ".." or up.endswith("/.."):
        raise ValueError("leaves its folder")
    if up.startswith("/") or value[1:2] == ":":
        raise ValueError("is an absolute path")


def checked(schema: dict, given: dict | None) -> dict:
    """Arguments as a schema (properties: {name: {type, enum}}, required, additionalProperties) wants them; ValueError says what is wrong.

    Whole numbers and booleans may come as text. None counts as not given. Numbers aren't negative.
    """
    if given is not None and not isinstance(given, dict):
        raise ValueError("arguments are an object")
    given, props = dict(given or {}), schema.get("properties", {})
    if schema.get("additionalProperties") is False and (more := sorted(set(given) - set(props))):
        raise ValueError(f"unknown argument {more[0]!r}; expected one of {', '.join(sorted(props))}")
    for name in schema.get("required", ()):
        value = given.get(name)
        if value is None or (isinstance(value, str) and not value.strip()):
            raise ValueError(f"{name!r} is required")
    for name, value in given.items():
        want = props.get(name, {}).get("type")
        if value is None or want is None:
            continue
        if isinstance(value, str) and want == "integer":
            try:
                value = int(value.strip())
            except ValueError:
                pass
        elif isinstance(value, str) and want == "boolean":
            value = {"true": True, "false": False}.get(value.strip(), value)
        if not isinstance(value, _KINDS.get(want, object)) or (want == "integer" and isinstance(value, bool)):
            raise ValueError(f"{name!r} is no {want}")
        if want == "integer" and value < 0:
            raise ValueError(f"{name!r} is negative")
        if (allowed := props[name].get("enum")) and value not in allowed:
            raise ValueError(f"{name!r} is one of {', '.join(map(str, allowed))}")
        given[name] = value
    return given


class ResultCache:
    """Answers by tool, arguments and versions of the tables they were read from. The least lately used go when there are too many or they are too large.

    Answers are small serialised results (a response to a caller), not tables: those belong to Spark.
    """

    def __init__(self, entries: int = 256, size: int = 64 * 1024 * 1024):
        self.entries, self.size, self.held = entries, size, 0
        self._kept: OrderedDict[Hashable, bytes] = OrderedDict()

    def get(self, tool: str, args: dict, versions: dict, make: Callable[[], bytes]) -> bytes:
        """The answer kept under these versions, or what make() gives, kept if it fits. An answer of older versions is never given."""
        key = (tool, json.dumps(args, sort_keys=True), json.dumps(versions, sort_keys=True))
        if key in self._kept:
            self._kept.move_to_end(key)
            return self._kept[key]
        value = make()
        if len(value) <= self.size:
            self._kept[key] = value
            self.held += len(value)
            while len(self._kept) > self.entries or self.held > self.size:
                self.held -= len(self._kept.popitem(last=False)[1])
        return value

    def __len__(self) -> int:
        return len(self._kept)
