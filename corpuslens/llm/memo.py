"""A memo of bounded size for frequent units of text."""

from __future__ import annotations

from array import array
from collections.abc import Callable

#: Units remembered in each of two generations by a Python worker (some 200
#: bytes each).
REMEMBERED = 250_000
#: Longest unit that is remembered, in characters.
LONGEST = 64


class UnitMemo:
    """Ids of text units, as bytes of 32-bit integers. When the young
    generation is full it becomes the old one, so units in use survive and
    memory stays bounded. ``encode`` gives the ids of each of some units."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def joined(self, units: list[str]) -> bytes:
        out = list(map(self.young.get, units))
        if None in out:
            young, old = self.young, self.old
            missing = {u: old.get(u) for u, got in zip(units, out) if got is None}
            new = [u for u, got in missing.items() if got is None]
            missing.update(zip(new, (array("i", ids).tobytes() for ids in self.encode(new))))
            out = [missing[u] if got is None else got for u, got in zip(units, out)]
            if len(young) + len(missing) > self.remembered:
                self.old, self.young = young, {}
            self.young.update(item for item in missing.items() if len(item[0]) <= LONGEST)
        return b"".join(out)
