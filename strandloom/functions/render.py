"""Alignments as text blocks (JVM expressions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import DIMER3_FREE, DIMER_FREE
from .dna import _col, complement

LINE_WIDTH = 120


def chars(text: Column) -> Column:
    """The characters of a string as an array; no character of an empty one."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def masked_ends(aligned: Column, left_free: bool, right_free: bool) -> Column:
    """Gap runs at free ends become spaces."""
    if left_free:
        run = F.length(F.regexp_extract(aligned, "^-*", 0))
        aligned = F.concat(F.repeat(F.lit(" "), run), F.substring(aligned, run + 1, F.length(aligned)))
    if right_free:
        run = F.length(F.regexp_extract(aligned, "-*$", 0))
        aligned = F.concat(F.substring(aligned, F.lit(1), F.length(aligned) - run), F.repeat(F.lit(" "), run))
    return aligned


def wrapped(rows: Sequence[Column], line_width: int | None = LINE_WIDTH) -> Column:
    """Rows of equal length in blocks of line_width columns, a blank line after each; trailing white space goes but for one
    line end. Without a width the rows stand as they are, each with its line end."""
    if line_width is None or line_width <= 0:
        return F.concat(*[part for row in rows for part in (row, F.lit("\n"))])
    blocks = F.ceil(F.length(rows[0]) / F.lit(line_width)).cast("int")
    block = lambda k: F.array(*[F.substring(row, k * line_width + 1, F.lit(line_width)) for row in rows], F.lit(""))
    lines = F.when(blocks > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), block)))
    return F.concat(F.regexp_replace(F.coalesce(F.array_join(lines, "\n"), F.lit("")), r"\s+$", ""), F.lit("\n"))


def _same_length(rows: Sequence[Column], value: Column) -> Column:
    equal, known = F.lit(True), rows[0].isNotNull()
    for row in rows[1:]:
        equal, known = equal & (F.length(row) == F.length(rows[0])), known & row.isNotNull()
    return F.when(known & F.assert_true(equal, F.lit("aligned strings must have the same length")).isNull(), value)


def match_line(top: Column, bottom: Column) -> Column:
    """| where both rows have the same letter."""
    mark = lambda a, b: F.when((a == b) & ~a.isin("-", " "), "|").otherwise(" ")
    return F.array_join(F.zip_with(chars(top), chars(bottom), mark), "")


def to_ascii(aligned1, aligned2, free: Sequence[bool] = (False,) * 4, line_width: int | None = LINE_WIDTH) -> Column:
    one, two = _col(aligned1), _col(aligned2)
    top, bottom = masked_ends(one, free[0], free[1]), masked_ends(two, free[2], free[3])
    return _same_length([one, two], wrapped([top, match_line(top, bottom), bottom], line_width))


def to_ascii_3d(aligned1, aligned2, aligned3, free: Sequence[bool] = (False,) * 6, line_width: int | None = LINE_WIDTH) -> Column:
    rows = [_col(a) for a in (aligned1, aligned2, aligned3)]
    return _same_length(rows, wrapped([masked_ends(r, free[2 * k], free[2 * k + 1]) for k, r in enumerate(rows)], line_width))


def dimer_to_ascii(aligned1, aligned2, line_width: int | None = LINE_WIDTH) -> Column:
    """A predicted dimer: bonds where the strands pair, the bottom strand as it stands (3' to 5'). Empty wrapped input is an error."""
    one, two = _col(aligned1), _col(aligned2)
    top, bottom = masked_ends(one, *DIMER_FREE[:2]), masked_ends(two, *DIMER_FREE[2:])
    shown = wrapped([top, match_line(top, complement(bottom)), bottom], line_width)
    if line_width is not None and line_width > 0:
        shown = F.when(F.assert_true(F.length(one) > 0, F.lit("a dimer needs at least one column")).isNull(), shown)
    return _same_length([one, two], shown)


def dimer_alignment_to_ascii(aligned1, aligned2, aligned3, line_width: int | None = LINE_WIDTH) -> Column:
    """An aligned dimer, first and second primer, the last as it stands."""
    return to_ascii_3d(aligned1, aligned2, aligned3, DIMER3_FREE, line_width)


def lines_of(text) -> Column:
    """The lines of a rendered block, as an array."""
    return F.split(F.regexp_replace(_col(text), r"\n$", ""), "\n")
