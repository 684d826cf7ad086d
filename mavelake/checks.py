"""Argument checks with one meaning everywhere: type, range, allowed values, length and missing values."""

from __future__ import annotations

import importlib.util
import math
from collections.abc import Iterable
from typing import Any

KINDS = {"character": str, "numeric": (int, float), "logical": bool, "list": (list, dict, tuple)}


def _is(value: Any, kind: str) -> bool:
    if kind == "numeric" and isinstance(value, bool):
        return False
    return isinstance(value, KINDS[kind])


def assert_vector(x: Any, name: str, kind: str | None = None, rng_incl=None, rng_excl=None, valid_values: Iterable | None = None, length: int | None = None, rng_len=None, allow_null: bool = False) -> None:
    """Raise unless x is a vector of the kind, in the ranges (values in valid_values are always allowed then)."""
    if x is None:
        if allow_null:
            return
        raise ValueError(f"'{name}' is needed")
    values = list(x) if isinstance(x, (list, tuple, set)) else [x]
    if kind is not None and kind != "list" and not all(_is(v, kind) for v in values):
        raise TypeError(f"'{name}' must be of class '{kind}'")
    if kind == "list" and not isinstance(x, KINDS["list"]):
        raise TypeError(f"'{name}' must be of class 'list'")
    valid = None if valid_values is None else list(valid_values)
    free = [v for v in values if valid is None or v not in valid]
    for rng, inside, words in ((rng_incl, lambda v, a, b: a <= v <= b, "inclusive"), (rng_excl, lambda v, a, b: a < v < b, "exclusive")):
        if rng is not None:
            for v in free:
                if isinstance(v, float) and math.isnan(v) or not inside(v, *rng):
                    raise ValueError(f"'{name}' takes values from {rng[0]} to {rng[1]} ({words})" + (f" or any of {valid}" if valid else ""))
    if valid is not None and rng_incl is None and rng_excl is None and free:
        raise ValueError(f"'{name}' takes only {', '.join(map(str, valid))}")
    if length is not None and len(values) != length:
        raise ValueError(f"'{name}' must have length {length}")
    if rng_len is not None and not rng_len[0] <= len(values) <= rng_len[1]:
        raise ValueError(f"'{name}' takes {rng_len[0]} to {rng_len[1]} values")


def assert_scalar(x: Any, name: str, kind: str | None = None, allow_null: bool = False, **rules: Any) -> None:
    """As assert_vector, for one value."""
    if x is None and not allow_null:
        raise ValueError(f"'{name}' is needed")
    if x is not None and isinstance(x, (list, tuple, set)):
        if len(x) != 1:
            raise ValueError(f"'{name}' must have length 1")
        x = next(iter(x))
    assert_vector(x, name, kind, allow_null=allow_null, **rules)


def assert_packages_available(names: Iterable[str]) -> None:
    missing = [n for n in names if importlib.util.find_spec(n) is None]
    if missing:
        raise ImportError(f"this needs the packages {', '.join(missing)}")
