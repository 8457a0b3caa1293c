"""A memo of byte strings whose size in memory is bounded."""

from __future__ import annotations

#: Bytes that an entry takes beside its key and value.
ENTRY = 200


class Memo:
    """Values of keys, in two generations of at most ``limit`` bytes together.

    When the young generation is full it becomes the old one and the former old
    one is forgotten; a value found in the old generation moves back to the young.
    """

    def __init__(self, limit: int):
        self.limit, self.held = limit // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def get_all(self, keys: list[bytes]) -> list[bytes | None]:
        found = list(map(self.young.get, keys))
        if self.old:
            old = self.old
            for k, value in enumerate(found):
                if value is None and (value := old.get(keys[k])) is not None:
                    found[k] = value
                    self.add(keys[k], value)
        return found

    def add(self, key: bytes, value: bytes) -> None:
        size = ENTRY + len(key) + len(value)
        if size > self.limit // 64:
            return  # one long word shall not age the others
        if self.held + size > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += size
