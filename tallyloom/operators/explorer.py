"""The explorer: a view's state compiled to filter, order, page and export."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import csv_cell, has_tokens, one_decimal

#: Kinds of columns whose first direction is ascending; numbers start from the high end.
ASCENDING = ("text", "category", "year", "rank")
PAGE_SIZES = (25, 50, 100)


@dataclass(frozen=True)
class Field:
    """A column of a view: its label, its kind and how it is shown."""

    key: str
    label: str
    kind: str

    def shown(self) -> Column:
        c = F.col(self.key)
        if self.kind == "number":
            text = F.format_string("%.2f", c.cast("double"))
        elif self.kind == "percent":
            text = F.concat(one_decimal(c.cast("double") * 100), F.lit("%"))
        elif self.kind == "agent":
            text = F.lpad(c.cast("string"), F.greatest(F.lit(3), F.length(c.cast("string"))), F.lit("0"))
        elif self.kind == "category":
            text = F.replace(c.cast("string"), F.lit("_"), F.lit(" "))
        else:
            text = c.cast("string")
        return F.when(c.isNull(), F.lit("—")).otherwise(text)

    def sought(self) -> Column:
        """What a search sees: labels of categories, `agent 7` for a rater, plain text of everything else; nothing for null."""
        c = F.col(self.key).cast("string")
        if self.kind == "agent":
            return F.concat(F.lit("agent "), c)
        return F.replace(c, F.lit("_"), F.lit(" ")) if self.kind == "category" else c

    @property
    def ascending_first(self) -> bool:
        return self.kind in ASCENDING


@dataclass(frozen=True)
class ExplorerQuery:
    """State of a view. Any change but of the page itself goes back to page 0."""

    fields: tuple[Field, ...]
    search_columns: tuple[str, ...] = ()
    search: str = ""
    equals: tuple[tuple[str, object], ...] = ()
    sorts: tuple[tuple[str, bool], ...] = ()
    tie: str = "rank"
    page: int = 0
    page_size: int = 50
    defaults: tuple[tuple[str, bool], ...] = field(default=())

    def searched(self, text: str) -> ExplorerQuery:
        return replace(self, search=text, page=0)

    def where(self, key: str, value: object) -> ExplorerQuery:
        """An equality filter; None takes it away."""
        rest = tuple(x for x in self.equals if x[0] != key)
        return replace(self, equals=rest if value is None else (*rest, (key, value)), page=0)

    def sorted_by(self, key: str, ascending: bool | None = None) -> ExplorerQuery:
        """A new primary sort; a secondary sort on the same column goes."""
        up = next(f.ascending_first for f in self.fields if f.key == key) if ascending is None else ascending
        return replace(self, sorts=((key, up), *(s for s in self.sorts[1:2] if s[0] != key)), page=0)

    def clicked(self, key: str) -> ExplorerQuery:
        """A click on a header: turns the direction of the primary column, and clears the secondary sort."""
        turn = self.sorts and self.sorts[0][0] == key
        up = not self.sorts[0][1] if turn else next(f.ascending_first for f in self.fields if f.key == key)
        return replace(self, sorts=((key, up),), page=0)

    def then_by(self, key: str, ascending: bool) -> ExplorerQuery:
        return replace(self, sorts=(*self.sorts[:1], (key, ascending)), page=0)

    def matching(self, rows: DataFrame) -> DataFrame:
        for key, value in self.equals:
            rows = rows.where(F.col(key) == F.lit(value))
        if self.search.split():
            fields = {f.key: f for f in self.fields}
            seen = (fields[c].sought() if c in fields else F.col(c).cast("string") for c in self.search_columns)
            rows = rows.where(has_tokens(F.lower(F.concat_ws(" ", *seen)), self.search))
        return rows

    def order(self) -> list[Column]:
        """Nulls last ascending, first descending; ties by the source order."""
        return [*(F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_first() for k, up in self.sorts), F.col(self.tie).asc()]

    def ordered(self, rows: DataFrame) -> DataFrame:
        return self.matching(rows).orderBy(*self.order())

    def slice(self, rows: DataFrame, n_rows: int | None = None) -> DataFrame:
        """The page's rows; a page beyond the last is the last, where the number of rows is known."""
        page = self.page if n_rows is None else min(self.page, max(0, (n_rows - 1) // self.page_size))
        return self.ordered(rows).offset(page * self.page_size).limit(self.page_size)

    def csv_lines(self, rows: DataFrame) -> DataFrame:
        """`line` of every matching row, in order, after a header; write with `csv_document` for the exact bytes."""
        return self.ordered(rows).select(F.concat_ws(",", *(csv_cell(f.shown()) for f in self.fields)).alias("line"))

    def csv_document(self, rows: DataFrame) -> str:
        """The exported file: byte-order mark, header, lines, no last line break. For what a person downloads."""
        head = ",".join('"' + f.label.replace('"', '""') + '"' if any(c in f.label for c in '",\n') else f.label for f in self.fields)
        return "﻿" + "\n".join([head, *(r["line"] for r in self.csv_lines(rows).toLocalIterator())])
