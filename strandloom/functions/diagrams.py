"""Third-party dimer diagrams in the form of rendered alignments (JVM expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import _col, bound, complement
from .render import LINE_WIDTH, chars, wrapped

NOTHING = "\n\n\n"
#: What ends a line, and how a line of either strand begins.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
TOP_LABEL, BOTTOM_LABEL, TAB = "SEQ", "STR", 8


def normalise_top(row) -> Column:
    """Up to the last letter spaces are gaps; after it gaps are spaces; without a letter spaces are gaps."""
    row = _col(row)
    head = F.regexp_extract(row, r"(?s)^(.*\p{L})", 1)
    tail = F.substring(row, F.length(head) + 1, F.length(row))
    return F.when(F.length(head) > 0, F.concat(F.translate(head, " ", "-"), F.translate(tail, "-", " "))).otherwise(F.translate(row, " ", "-"))


def normalise_bottom(row) -> Column:
    """Before the first letter gaps are spaces; from it on spaces are gaps; without a letter spaces are gaps."""
    row = _col(row)
    lead = F.regexp_extract(row, r"(?s)^(\P{L}*)\p{L}", 1)
    rest = F.substring(row, F.length(lead) + 1, F.length(row))
    return F.when(row.rlike(r"\p{L}"), F.concat(F.translate(lead, "-", " "), F.translate(rest, " ", "-"))).otherwise(F.translate(row, " ", "-"))


def bond_line(top, bottom) -> Column:
    """| where top and bottom are complementary letters; case counts. As long as the shorter row."""
    top, bottom = chars(_col(top)), chars(_col(bottom))
    mark = lambda a, b: F.when(~a.isin("-", " ") & ~b.isin("-", " ") & (complement(a) == b), "|").otherwise(" ")
    size = F.least(F.size(top), F.size(bottom))
    return F.array_join(F.zip_with(F.slice(top, 1, size), F.slice(bottom, 1, size), mark), "")


def _tabs_expanded(body: Column) -> Column:
    pieces = F.split(body, "\t")
    pad = lambda acc: F.repeat(F.lit(" "), F.lit(TAB) - F.length(acc) % TAB)
    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), pieces[0], lambda acc, piece: F.concat(acc, pad(acc), piece))


def _strands(diagram: Column) -> Column:
    """struct<a, b>: both strands without the columns that neither has."""
    bodies = lambda lines, label: F.transform(F.filter(lines, lambda x: x.startswith(label)), lambda x: _tabs_expanded(F.substring(x, F.lit(4), F.length(x))))

    def overlaid(rows: Column, width: Column) -> Column:  # the first row that isn't blank in a column wins
        blank = F.array_repeat(F.lit(" "), width)
        return F.aggregate(rows, blank, lambda acc, row: F.zip_with(acc, chars(F.rpad(row, width, F.lit(" "))), lambda a, b: F.when(a == " ", b).otherwise(a)))

    def combined(x: Column) -> Column:
        both = F.filter(F.arrays_zip(overlaid(x["top"], x["width"]).alias("a"), overlaid(x["bottom"], x["width"]).alias("b")), lambda z: (z["a"] != " ") | (z["b"] != " "))
        return bound(both, lambda kept: F.struct(F.array_join(F.transform(kept, lambda z: z["a"]), "").alias("a"), F.array_join(F.transform(kept, lambda z: z["b"]), "").alias("b")))

    def sized(x: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(F.concat(x["top"], x["bottom"]), lambda y: F.length(y))), F.lit(0))
        return F.struct(x["top"].alias("top"), x["bottom"].alias("bottom"), width.alias("width"))

    rows = bound(F.split(diagram, LINE_ENDS, -1), lambda lines: F.struct(bodies(lines, TOP_LABEL).alias("top"), bodies(lines, BOTTOM_LABEL).alias("bottom")))
    return bound(bound(rows, sized), combined)


def _normalised(diagram) -> Column:
    """struct<some, top, bottom>."""
    def rows(strands: Column) -> Column:
        return F.struct((F.length(strands["a"]) > 0).alias("some"), normalise_top(strands["a"]).alias("top"), normalise_bottom(strands["b"]).alias("bottom"))

    return bound(_strands(_col(diagram)), rows)


def parse_primer3(diagram, line_width: int | None = LINE_WIDTH) -> Column:
    """A diagram of SEQ and STR lines as top strand, bonds and bottom strand."""
    shown = lambda r: F.when(r["some"], bound(F.struct(r["top"].alias("a"), bond_line(r["top"], r["bottom"]).alias("m"), r["bottom"].alias("b")), lambda z: wrapped([z["a"], z["m"], z["b"]], line_width))).otherwise(NOTHING)
    return F.when(_col(diagram).isNotNull(), bound(_normalised(diagram), shown))


def has_internal_gap(diagram) -> Column:
    """Whether either strand has a gap between its first and last letter, at any width."""
    inside = r"(?s)\p{L}.*-.*\p{L}"
    return bound(_normalised(diagram), lambda r: r["top"].rlike(inside) | r["bottom"].rlike(inside))


def parse_idt(primer1, primer2, response, line_width: int | None = LINE_WIDTH) -> Column:
    """One structure of an OligoAnalyzer answer, with TopLinePadding, BondLinePadding, BottomLinePadding and Bonds (0, 1 or 2)."""
    response = _col(response)
    wrong = F.raise_error(F.lit("bonds must be 0, 1 or 2")).cast("string")
    bonds = F.array_join(F.transform(response["Bonds"], lambda b: F.when(b == 0, " ").when(b.isin(1, 2), "|").otherwise(wrong)), "")
    spaced = lambda pad, text: F.concat(F.repeat(F.lit(" "), pad), text)
    rows = [spaced(response["TopLinePadding"], _col(primer1)), spaced(response["BondLinePadding"], bonds), spaced(response["BottomLinePadding"], F.reverse(_col(primer2)))]
    width = F.greatest(*[F.length(r) for r in rows])
    top, mid, bottom = (F.rpad(r, width, F.lit(" ")) for r in rows)
    shown = [normalise_top(top), mid, normalise_bottom(bottom)]
    lead = F.least(*[F.length(F.regexp_extract(r, "^ *", 0)) for r in shown])
    trail = F.least(*[F.length(F.regexp_extract(r, " *$", 0)) for r in shown])
    cropped = [F.substring(r, lead + 1, width - lead - trail) for r in shown]
    return F.when(lead < width, wrapped(cropped, line_width)).when(lead.isNotNull(), NOTHING)
