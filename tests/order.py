"""Order-aware comparison: rows must come sorted by the given keys; rows that tie on them may come in any order."""


class _Down:
    """Turns an order round."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def _rank(row, keys):
    """Nulls first when ascending and last when descending, as the engine sorts."""
    out = []
    for name in keys:
        down = name.startswith("-")
        value = row[name.lstrip("-")]
        part = (value is not None, value if value is not None else 0)
        out.append(_Down(part) if down else part)
    return out


def out_of_order(rows, keys):
    """The first place at which a row should not follow the one before it, or None."""
    ranks = [_rank(r, keys) for r in rows]
    return next((k for k in range(1, len(ranks)) if ranks[k] < ranks[k - 1]), None)


def check_order(df, keys, least=3):
    """Collect the rows in the order they come; keys are column names, ``-`` before one turns it round.

    At least ``least`` places must be decided by the keys, or the check would say nothing.
    """
    rows = df.collect()
    assert out_of_order(rows, keys) is None, f"row {out_of_order(rows, keys)} is out of order by {keys}"
    ranks = [_rank(r, keys) for r in rows]
    assert sum(a < b for a, b in zip(ranks, ranks[1:])) >= least
    return rows
