"""Functions of table grids (array of rows, each an array of cells)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataleaf.functions import text as T
from strataleaf.functions.binding import let

MIN_ROWS, MIN_COLS, MAX_COLS = 2, 2, 20
MAX_EMPTY_RATIO, MIN_CELL_LENGTH, MAX_FRAGMENT_RATIO = 0.70, 3, 0.35


def cells(grid: Column) -> Column:
    return F.flatten(grid)


def filled(grid: Column) -> Column:
    return F.filter(F.flatten(grid), lambda c: c != "")


def _double(c: Column) -> Column:
    return c.cast("double")


def empty_ratio(grid: Column) -> Column:
    n = F.size(cells(grid))
    return F.when(n == 0, F.lit(1.0)).otherwise(_double(F.size(F.filter(cells(grid), lambda c: c == ""))) / n)


def average_cell_length(grid: Column) -> Column:
    n = F.size(filled(grid))
    return F.when(n == 0, F.lit(0.0)).otherwise(_double(F.aggregate(filled(grid), F.lit(0), lambda a, c: a + F.length(c))) / n)


def fragment_ratio(grid: Column) -> Column:
    """Share of cells that look like pieces of words; lower-case beginnings of the header count once more."""
    short = F.size(F.filter(filled(grid), lambda c: (F.length(c) <= 4) & T.starts_lower(c)))
    head = F.size(F.filter(F.coalesce(F.get(grid, F.lit(0)), F.array().cast("array<string>")), lambda c: T.starts_lower(c)))
    n = F.size(filled(grid))
    return F.when(n == 0, F.lit(0.0)).otherwise(_double(short + head) / n)


def column_count(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def has_split_words(grid: Column) -> Column:
    """Among the first ten rows with content, two or more in which neighbouring cells look like one word cut in two."""
    rows = F.slice(F.filter(grid, lambda r: F.exists(r, lambda c: c != "")), 1, 10)

    def is_split(row: Column) -> Column:
        return let(F.filter(row, lambda c: c != ""), neighbours)

    def neighbours(own: Column) -> Column:
        a = F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), T.rstrip)
        b = F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), T.lstrip)
        last = lambda x: F.length(F.element_at(T.words(x), -1))
        first = lambda x: F.length(F.element_at(T.words(x), 1))
        mixed = lambda x, y: T.ends_alpha(x) & T.starts_lower(y)
        capitals = lambda x, y: T.ends_upper(x) & T.starts_upper(y) & (F.least(last(x), first(y)) <= 3)
        return F.exists(F.zip_with(a, b, lambda x, y: F.when((x != "") & (y != ""), mixed(x, y) | capitals(x, y)).otherwise(F.lit(False))), lambda x: x)

    return F.size(F.filter(rows, is_split)) >= 2


def header_empty_ratio(grid: Column) -> Column:
    head = F.get(grid, F.lit(0))
    return F.when(F.size(head) > 0, _double(F.size(F.filter(head, lambda c: c == ""))) / F.size(head)).otherwise(F.lit(0.0))


def is_column_artefact(grid: Column, x0: Column, x1: Column, page_width: Column, method: Column) -> Column:
    """Two columns of prose taken for a table: very wide, or with long headers. Ruled tables are never one."""
    head = F.get(grid, F.lit(0))
    long = F.size(F.filter(F.coalesce(head, F.array().cast("array<string>")), lambda c: F.length(c) > 60))
    wide = (page_width > 0) & ((x1 - x0) / page_width > 0.85)
    return (method != "lines") & (wide | F.coalesce(_double(long) / F.greatest(F.size(head), F.lit(1)) > 0.5, F.lit(False)))


def passes_quality(grid: Column, x0: Column, x1: Column, page_width: Column, method: Column) -> Column:
    return (
        (F.size(grid) >= MIN_ROWS)
        & (column_count(grid) >= MIN_COLS)
        & (column_count(grid) <= MAX_COLS)
        & (empty_ratio(grid) <= MAX_EMPTY_RATIO)
        & (average_cell_length(grid) >= MIN_CELL_LENGTH)
        & (fragment_ratio(grid) <= MAX_FRAGMENT_RATIO)
        & ~has_split_words(grid)
        & (header_empty_ratio(grid) < 0.5)
        & ~is_column_artefact(grid, x0, x1, page_width, method)
    )


def cleaned(grid: Column) -> Column:
    """Clean cells, no empty rows, every row as wide as the header; null if nothing is left."""

    def even(rows: Column) -> Column:
        return let(F.size(F.get(rows, F.lit(0))), lambda n: F.when((F.size(rows) > 0) & (n > 0), whole(F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n)))))

    def whole(padded: Column) -> Column:
        return let(padded, lambda rows: F.filter(rows, lambda r, i: (i == 0) | F.exists(r, lambda c: c != "")))

    return let(F.filter(F.transform(grid, lambda r: F.transform(r, T.clean_cell)), lambda r: F.exists(r, lambda c: c != "")), even)


def widths(rows: Column) -> Column:
    """Longest cell of each column, 3 at least."""
    return F.transform(F.get(rows, F.lit(0)), lambda _, i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.length(F.get(r, i))))))


def markdown(rows: Column) -> Column:
    """Rows of equal length as a pipe table with aligned columns."""
    line = lambda cs: F.concat(F.lit("| "), F.array_join(cs, " | "), F.lit(" |"))

    def with_widths(w: Column) -> Column:
        body = F.transform(rows, lambda r: line(F.zip_with(r, w, lambda c, n: F.rpad(c, n, F.lit(" ")))))
        rule = line(F.transform(w, lambda n: F.repeat(F.lit("-"), n)))
        return let(body, lambda b: F.array_join(F.concat(F.slice(b, 1, 1), F.array(rule), F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))), "\n"))

    return let(widths(rows), with_widths)


def split_row(line: Column) -> Column:
    """Cells of a pipe-table line, outer pipes off."""
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), T.strip)


def is_valid_page_table(headers: Column, rows: Column) -> Column:
    """Checks of a pipe table that a page model wrote."""
    named = F.filter(headers, lambda h: T.strip(h) != "")
    cols = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    head_length = F.aggregate(named, F.lit(0), lambda a, h: a + F.length(h)).cast("double") / F.greatest(F.size(named), F.lit(1))

    def splits(row: Column) -> Column:
        return let(F.filter(row, lambda c: T.strip(c) != ""), pairs_of)

    def pairs_of(own: Column) -> Column:
        n = F.greatest(F.size(own) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, F.lit(2), n), lambda a, b: T.ends_alpha(a) & T.starts_lower(b))
        return F.size(F.filter(pairs, lambda x: x))

    n_splits = F.aggregate(F.slice(rows, 1, 8), F.lit(0), lambda a, r: a + splits(r))
    every = F.concat(headers, F.flatten(rows))
    empty = F.size(F.filter(every, lambda c: T.strip(c) == "")).cast("double") / F.greatest(F.size(every), F.lit(1))
    tiny = F.size(F.filter(every, lambda c: ((F.length(T.strip(c)) <= 2) & (T.strip(c) != "")) | (F.endswith(T.strip(c), F.lit(".")) & (F.length(T.strip(c)) <= 3))))
    return (
        (F.size(named) >= 2)
        & (F.size(rows) >= 1)
        & (cols >= 2)
        & (head_length <= 80)
        & ~F.exists(named, T.starts_lower)
        & (n_splits < 2)
        & (cols <= 20)
        & ~((F.size(rows) > 1) & (empty > 0.75))
        & ~((F.size(rows) > 4) & (tiny >= 3))
    )
