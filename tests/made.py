"""Small tables from a seeded generator, with nulls, repeated rows and keys without a partner."""

import random

SHOPS = [f"shop{i}" for i in range(5)]


def visits(seed=21, n=40):
    """(shop, spent): some shops are null, some rows occur twice."""
    rng = random.Random(seed)
    rows = [(rng.choice([*SHOPS, None]), rng.randrange(5, 90)) for _ in range(n)]
    return rows + rows[: n // 8]


def loans(seed=22, n=30):
    """(loan, reader, days): readers r0 to r7, of whom r6 and r7 are unknown."""
    rng = random.Random(seed)
    return [(f"b{i}", f"r{rng.randrange(8)}", rng.randrange(1, 60)) for i in range(n)]


READERS = [(f"r{i}", f"reader {i}") for i in range(6)] + [("r99", "never came")]


def spoilt(rows, places, value):
    """The rows with another value at some places."""
    return [(*r[:-1], value) if i in places else r for i, r in enumerate(rows)]
