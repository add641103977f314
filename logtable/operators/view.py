"""The combined view: marked rows, time window, regex, then a stable sort."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from logtable.functions.patterns import to_java
from logtable.functions.text import quoted
from logtable.operators import positions
from logtable.operators.columns import ColumnView, reset_view, sort_column
from logtable.operators.filters import filter_marked, filter_regex
from logtable.operators.rows import LINE_NO
from logtable.operators.sorting import ordering
from logtable.operators.windows import TimeWindow, filter_window
from logtable.plans.ordered import Key, in_order, ordered
from logtable.plans.staging import stage


@dataclass(frozen=True)
class LogView:
    """A table with the state of its view. Each method returns a changed copy."""

    df: DataFrame
    columns: ColumnView
    annotations: DataFrame | None = None
    window: TimeWindow | None = None
    ts: str = "ts_parsed"
    pattern: str = ""
    pattern_on: bool = False
    sort_by: str | None = None
    desc: bool = False

    @classmethod
    def of(cls, df: DataFrame, **state) -> LogView:
        return cls(df, reset_view(df), **state)

    def filter(self, pattern: str) -> LogView:
        """Set the regex filter; '' clears it, an invalid one raises."""
        to_java(pattern)
        return replace(self, pattern=pattern, pattern_on=bool(pattern))

    def toggle_filter(self) -> LogView:
        """Switch the filter off or on again, keeping the pattern."""
        return replace(self, pattern_on=bool(self.pattern.strip()) and not self.pattern_on)

    def between(self, window: TimeWindow | None) -> LogView:
        return replace(self, window=window)

    def only_marked(self, annotations: DataFrame | None) -> LogView:
        return replace(self, annotations=annotations)

    def sort(self, by: str | int | None, desc: bool = False) -> LogView:
        column = sort_column(self.columns, by)
        return replace(self, sort_by=column, desc=desc and column is not None)

    def reset_layout(self) -> LogView:
        """Source column order, everything visible, no sort; filters stay."""
        return replace(self, columns=reset_view(self.df), sort_by=None, desc=False)

    def rows(self) -> DataFrame:
        """The rows of the view, in no order."""
        df = self.df
        if self.annotations is not None:
            df = filter_marked(df, self.annotations)
        df = filter_window(df, self.window, self.ts)
        return filter_regex(df, self.pattern, self.pattern_on)

    def keys(self, rows: DataFrame, backwards: bool = False) -> list[Key]:
        """Sort keys for ``rows`` of this view."""
        return ordering(rows, self.sort_by, self.desc, backwards=backwards)

    def _narrow(self) -> DataFrame:
        """Line numbers and the sort column of the view's rows, staged: the kind of the
        values and the order are found on these alone."""
        sorts = [] if self.sort_by in (None, "#") else [quoted(self.sort_by)]
        return stage(self.rows().select(LINE_NO, *sorts))

    def to_df(self) -> DataFrame:
        """The view in order."""
        rows = self.rows()
        return ordered(rows, self.keys(rows))

    def positions(self) -> DataFrame:
        """The view with dense positions."""
        rows = self.rows()
        return in_order(rows, self.keys(rows))

    def page(self, start: int, size: int) -> DataFrame:
        narrow = self._narrow()
        places = positions.page(narrow, self.keys(narrow), start, size).select(LINE_NO, "pos")
        return positions.fetched(self.rows(), places, size)

    def last(self, size: int) -> DataFrame:
        narrow = self._narrow()
        places = positions.last(narrow, self.keys(narrow, backwards=True), size).select(LINE_NO, "pos")
        return positions.fetched(self.rows(), places, size)
