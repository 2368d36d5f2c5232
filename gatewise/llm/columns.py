"""Names for working columns that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused_name(table: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so, in whatever case."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(table: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, str]]:
    """``table`` with every column but ``kept`` renamed to a plain number, and the way back: new name -> old name."""
    names = {(c if c in kept else f"c{k}"): c for k, c in enumerate(table.columns)}
    return table.toDF(*names), names
