"""What a Python worker keeps from task to task: one thing at a time, so that stages do not add up."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's object for ``key``; whatever another stage kept goes before it is made."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
