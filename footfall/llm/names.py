"""Names for helper columns that a table does not have."""

from __future__ import annotations

from collections.abc import Iterable


def free_prefix(columns: Iterable[str], names: Iterable[str]) -> str:
    """The fewest underscores (at least one) before `names` that give no column of `columns`, case aside."""
    taken = {c.lower() for c in columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return prefix
