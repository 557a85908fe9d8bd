"""Structured tables: a named rectangle with a header row, typed columns and rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality


@dataclass
class TableSpec:
    """``first`` and ``last`` are sheet rows, the header row among them; ``types`` only say what is valid."""

    name: str
    columns: list[str]
    first: int
    last: int
    types: dict[str, str] = field(default_factory=dict)
    rules: list[quality.Rule] = field(default_factory=list)
    banded: bool = True

    def __post_init__(self):
        from ..sources.csv import unique_names

        self.name = re.sub(r"^(?=\d)", "_", re.sub(r"[^\w.]", "_", self.name)) or "Table"
        self.columns = unique_names(self.columns)

    def frame(self, sheet: DataFrame, row: str = "_row") -> DataFrame:
        """The table's body."""
        return sheet.where(F.col(row).between(self.first + 1, self.last)).select(row, *self.columns)

    def violations(self, sheet: DataFrame, row: str = "_row") -> DataFrame:
        typed = [quality.Rule(c, t) for c, t in self.types.items() if t != "any"]
        return quality.violations(self.frame(sheet, row), typed + self.rules)

    def band(self, row: str = "_row"):
        return (F.col(row) - self.first) % 2 == 0 if self.banded else F.lit(False)
