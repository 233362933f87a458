"""A naive sequential model of the store: the whole history in a list, walked newest first."""

from __future__ import annotations

import random

from lamina.records import MERGE_OPERAND, RANGE_TOMBSTONE, TOMBSTONE, VALUE


class Model:
    def __init__(self):
        self.log: list[tuple] = []  # cf, key, seq, vt, val, end

    def add(self, cf, vt, key, val=b"", end=None):
        self.log.append((cf, key, len(self.log) + 1, vt, val, end))

    def get(self, cf, key, as_of=None):
        operands = []
        for c, k, seq, vt, val, end in reversed(self.log):
            if c != cf or as_of is not None and seq > as_of:
                continue
            if vt == RANGE_TOMBSTONE and k <= key < end:
                break
            if k != key or vt == RANGE_TOMBSTONE:
                continue
            if vt == TOMBSTONE:
                break
            if vt == VALUE:
                return val + b"".join(reversed(operands))
            operands.append(val)
        return b"".join(reversed(operands)) if operands else None

    def state(self, as_of=None):
        keys = {(c, k) for c, k, _, vt, _, _ in self.log if vt != RANGE_TOMBSTONE}
        found = {x: self.get(*x, as_of) for x in keys}
        return {x: v for x, v in found.items() if v is not None}


def random_ops(seed: int, n: int, families: int = 2) -> Model:
    rng = random.Random(seed)
    model = Model()

    def key():
        return bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randrange(0, 4)))

    for _ in range(n):
        cf, kind = rng.randrange(families), rng.choices((VALUE, TOMBSTONE, MERGE_OPERAND, RANGE_TOMBSTONE), (5, 2, 4, 1))[0]
        if kind == RANGE_TOMBSTONE:
            a, b = sorted((key(), key()))
            if a < b:
                model.add(cf, kind, a, b"", b)
        else:
            model.add(cf, kind, key(), b"" if kind == TOMBSTONE else bytes(rng.randrange(256) for _ in range(rng.randrange(0, 6))))
    return model
