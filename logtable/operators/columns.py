"""Which columns are shown, and in which order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from logtable.functions.text import BOM
from logtable.operators.rows import data_columns, default_columns, select_cells


@dataclass(frozen=True)
class ColumnView:
    """Column order and the hidden columns; positions in it are 1-based."""

    order: tuple[str, ...]
    hidden: frozenset[str] = field(default_factory=frozenset)

    @property
    def visible(self) -> list[str]:
        return [c for c in self.order if c not in self.hidden]

    def resolve(self, token: str | int) -> str | None:
        """A column by 1-based position or by name, ignoring case."""
        text = str(token).strip()
        if text.lstrip("+-").isdigit() and 1 <= int(text) <= len(self.order):
            return self.order[int(text) - 1]
        matches = (c for c in self.order if c.lower() == text.lower())
        return next(matches, None) if text else None

    def select(self, df: DataFrame) -> DataFrame:
        """The visible cells of ``df``."""
        return select_cells(df, self.visible)


def initial_view(df: DataFrame) -> ColumnView:
    """Source order with the blank columns hidden."""
    columns = data_columns(df)
    return ColumnView(tuple(columns), frozenset(columns) - frozenset(default_columns(df)))


def _picked(view: ColumnView, tokens: Sequence[str | int]) -> tuple[list[str], list[str]]:
    tokens = [t for t in tokens if str(t).strip()]
    if not tokens:
        raise ValueError("no columns specified")
    found = {str(t): view.resolve(t) for t in tokens}
    picked = dict.fromkeys(c for c in found.values() if c is not None)
    return list(picked), [str(t) for t in tokens if found[str(t)] is None]


def toggle_columns(
    view: ColumnView, tokens: Sequence[str | int]
) -> tuple[ColumnView, list[str], list[str]]:
    """Flip the named columns once each; ``all`` shows every column.

    Returns the new view, the toggled columns and the unknown tokens.
    """
    if [str(t).strip().lower() for t in tokens] == ["all"]:
        return replace(view, hidden=frozenset()), list(view.order), []
    toggled, missing = _picked(view, tokens)
    return replace(view, hidden=view.hidden ^ frozenset(toggled)), toggled, missing


def reorder_columns(
    view: ColumnView, tokens: Sequence[str | int]
) -> tuple[ColumnView, list[str], list[str]]:
    """Put the named columns first; the others keep their order behind them."""
    first, missing = _picked(view, tokens)
    if not first:
        raise ValueError("no valid columns in order")
    rest = [c for c in view.order if c not in first]
    return replace(view, order=(*first, *rest)), first, missing


def reset_view(df: DataFrame) -> ColumnView:
    """Source order, everything visible."""
    return ColumnView(tuple(data_columns(df)))


# Names that mean "original line order" in a sort.
LINE_ALIASES = frozenset({"#", "row", "rownum", "rownumber", "line", "linenumber", "index"})
SORT_OFF = frozenset({"", "off", "none", "clear"})


def sort_column(view: ColumnView, by: str | int | None) -> str | None:
    """The column a sort names: None for off, ``'#'`` for line order.

    Numbers count the visible columns only; 0 means line order.
    """
    text = ("" if by is None else str(by)).strip()
    if text.lower() in SORT_OFF:
        return None
    bare = text.removeprefix(BOM).strip()
    if bare.lower() in LINE_ALIASES:
        return "#"
    if text.lstrip("+-").isdigit():
        place, shown = int(text), view.visible
        if place == 0:
            return "#"
        if not 1 <= place <= len(shown):
            raise ValueError(f"column number {place} out of range")
        return shown[place - 1]
    for name in view.order:
        if name.removeprefix(BOM).strip().lower() == bare.lower():
            return name
    raise ValueError(f"unknown column {text!r}")
