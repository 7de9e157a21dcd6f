"""Tree paths (``root:a:b``) and the CSV tree stored in one column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from famloom.functions.binding import let

# Colour per top-level category.
TOP_LEVEL_COLOURS = {
    "Host-associated": "#4C8BE0",
    "Environmental": "#E07C3A",
    "Engineered": "#4CAF76",
    "Mixed": "#D94F4F",
    "Unknown": "#AAAAAA",
}

_RECORD = "array<struct<ids:string,labels:string,parents:string,counts:int,depth:int>>"
#: Stand for separators outside quotes while a blob is parsed; blobs lose these two signs.
_CELL, _LINE = "\x01", "\x02"


def top_level(path: Column) -> Column:
    """Second part of the path, or ``Unknown``."""
    return F.coalesce(F.get(F.split(path, ":"), F.lit(1)), F.lit("Unknown"))


def depth(path: Column) -> Column:
    """Number of steps below the root."""
    return F.size(F.split(path, ":")) - 1


def colour(category: Column) -> Column:
    """Colour of a top-level category; unknown ones share a colour."""
    known = F.create_map(*[F.lit(x) for pair in TOP_LEVEL_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, category), F.lit(TOP_LEVEL_COLOURS["Unknown"]))


def lenient_count(text: Column) -> Column:
    """Whole part of a number; anything else is 0."""
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _marked(text: Column) -> Column:
    """The text without quoting, and with marks for the separators outside quotes.

    Cut at quotes, every second piece is quoted.  An empty piece between two quoted ones is
    a doubled quote.  Each piece is looked at once.
    """
    # Replacing looks for one sign at a time, translating would look up every character.
    pieces = F.split(_replaced(text, (_CELL, ""), (_LINE, "")), '"', -1)

    def joined(cut: Column) -> Column:
        # ``cut`` is bound once, so the text is not split again for every piece.
        return let(F.size(cut), lambda n: F.array_join(F.transform(cut, lambda p, i: piece(p, i, n)), ""))

    def piece(p: Column, i: Column, n: Column) -> Column:
        return (
            F.when(i % 2 == 1, p)
            .when((i > 0) & (i < n - 1) & (p == ""), F.lit('"'))
            .otherwise(_replaced(p, ("\r\n", "\n"), (",", _CELL), ("\n", _LINE)))
        )

    return let(pieces, joined)


def _csv_lines(text: Column) -> Column:
    return F.filter(F.split(_marked(text), _LINE, -1), lambda line: line != "")


def _csv_fields(line: Column) -> Column:
    return F.split(line, _CELL, -1)


def _records_under(header: Column, lines: Column) -> Column:
    names = ("ids", "labels", "parents", "counts")
    # Where the columns stand is looked up once a tree, not once a record.
    places = F.struct(*[(F.array_position(header, name).cast("int") - 1).alias(name) for name in names])

    def record(fields: Column, at: Column) -> Column:
        def value(name: str) -> Column:
            return F.coalesce(F.get(fields, at[name]), F.lit(""))

        return F.struct(
            value("ids").alias("ids"),
            value("labels").alias("labels"),
            value("parents").alias("parents"),
            lenient_count(value("counts")).alias("counts"),
            depth(value("ids")).alias("depth"),
        )

    complete = F.size(lines) > 1
    for name in names:
        complete = complete & F.array_contains(header, name)
    rows = let(
        places,
        lambda at: F.transform(
            F.slice(lines, F.lit(2), F.size(lines)),
            lambda line: let(_csv_fields(line), lambda fields: record(fields, at)),
        ),
    )
    return F.when(complete, rows).otherwise(F.array().cast(_RECORD))


def tree_records(blob: Column) -> Column:
    """Records of a CSV tree; blank, headerless or incomplete blobs give an empty array."""
    text = F.coalesce(blob.cast("string"), F.lit(""))
    return let(
        _csv_lines(text),
        lambda lines: let(
            _csv_fields(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))),
            lambda header: _records_under(header, lines),
        ),
    )


def leaf_records(records: Column) -> Column:
    """Records whose id is nobody's parent inside the same tree."""

    def parents(rows: Column) -> Column:
        return F.array_distinct(
            F.filter(F.transform(rows, lambda r: r["parents"]), lambda parent: parent != "")
        )

    # ``records`` may be a whole parse, so both the parents and the leaves come from one value.
    return let(
        records,
        lambda rows: let(
            parents(rows),
            lambda inner: F.filter(rows, lambda r: ~F.array_contains(inner, r["ids"])),
        ),
    )
