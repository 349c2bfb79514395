"""Cell grids (array of rows, each an array of cells): headers and register parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.registers import bit_notation, context_peripheral, caption_name, width
from docquarry.functions.text import col, collapse, strip_blank

# Header vocabularies, from which a table's kind is told.
REGISTER_WORDS = ["address", "offset", "register", "name", "width", "reset", "access", "description"]
FIELD_WORDS = ["field", "bit", "bits", "range", "type", "access", "reset", "description", "name", "function"]
MEMORY_WORDS = ["peripheral", "base", "address", "size", "description"]
# Words that name a column.
HEADER_HINTS = ["name", "register", "offset", "address", "bit"]
NAME, OFFSET, ADDRESS = ["name", "register"], ["offset"], ["address", "addr"]
WIDTH, RESET, ACCESS, DESCRIPTION = ["width", "size"], ["reset", "default"], ["access", "type", "r/w"], ["description", "desc"]
FIELD_NAME, FIELD_BITS = ["field", "name"], ["bit", "bits", "range"]
SUMMARY_NAME = ["register name", "register", "name"]


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def header_keywords(text) -> Column:
    """Distinct words of three or more characters, lower case, punctuation removed."""
    clean = F.regexp_replace(F.lower(col(text)), r"(?U)[^\w\s]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(clean, r"(?U)\s+"), lambda w: F.length(w) > 2)))


def cell_keywords(cells) -> Column:
    """Each header cell as one keyword."""
    return F.array_sort(F.array_distinct(F.transform(col(cells), lambda c: F.regexp_replace(strip_blank(F.lower(c)), r"(?U)[^\w\s]", ""))))


def overlap(keywords, vocabulary: list[str]) -> Column:
    return F.size(F.array_intersect(col(keywords), words(vocabulary)))


def is_header(keywords) -> Column:
    return (overlap(keywords, REGISTER_WORDS) >= 3) | (overlap(keywords, FIELD_WORDS) >= 3) | (overlap(keywords, MEMORY_WORDS) >= 2)


def table_type(keywords) -> Column:
    """The vocabulary with the largest overlap; ties go to register map, then bit fields."""
    r, f, m = (overlap(keywords, v) for v in (REGISTER_WORDS, FIELD_WORDS, MEMORY_WORDS))
    top = F.greatest(r, f, m)
    return F.when(top == 0, "other").when(r == top, "register_map").when(f == top, "bitfield_definition").otherwise("memory_map")


def grid_keywords(grid) -> Column:
    """Keywords of a grid's first two rows."""
    text = F.array_join(F.flatten(F.slice(col(grid), 1, 2)), " ", "")
    return header_keywords(text)


def find_column(header: Column, names: list[str]) -> Column:
    """1-based first column whose header contains one of the names; null if none does."""
    hit = F.transform(header, lambda h: F.exists(words(names), lambda n: F.contains(h, n)))
    return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)).cast("int")


def _cell(row: Column, at: Column) -> Column:
    """A cleaned cell: null where the column or the cell's place is missing, '' if blank."""
    return F.when(at.isNotNull() & (at <= F.size(row)), collapse(F.get(row, at - 1)))


def _headers(row: Column) -> Column:
    return F.transform(row, lambda c: F.lower(strip_blank(F.coalesce(c, F.lit("")))))


def _filled(row: Column) -> Column:
    return F.exists(row, lambda c: F.coalesce(c, F.lit("")) != "")


def _register(name: Column, **given: Column) -> Column:
    none = F.lit(None).cast("string")
    parts = {"name": name, "address": none, "offset": none, "width": F.lit(32), "reset_value": none, "access": F.lit(""), "description": F.lit(""), "fields": F.array().cast("array<struct<name string, bits string, msb int, lsb int, access string, description string, reset_value string>>")} | given
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _table(peripheral: Column, kind: str, context: Column, registers: Column) -> Column:
    return F.struct(peripheral.alias("peripheral"), F.lit(kind).alias("table_type"), context.alias("context"), registers.alias("registers"))


def _bound(value: Column, build) -> Column:
    """build(value) with the value worked out once."""
    return F.transform(F.array(value), build)[0]


def register_map(grid, context) -> Column:
    """Registers of a map whose header is among the first three rows."""
    g, ctx = col(grid), F.coalesce(col(context), F.lit(""))
    found = F.array_position(F.transform(F.slice(g, 1, 3), lambda row: F.exists(words(HEADER_HINTS), lambda k: F.contains(F.array_join(_headers(row), " "), k))), F.lit(True)).cast("int")
    at = F.greatest(found, F.lit(1))

    def parse(header: Column) -> Column:
        columns = [find_column(header, names) for names in (NAME, OFFSET, ADDRESS, WIDTH, RESET, ACCESS, DESCRIPTION)]
        spots = F.struct(*[c.alias(n) for c, n in zip(columns, "noawrxd", strict=True)])

        def rows(s: Column) -> Column:
            body = F.filter(F.slice(g, at + 1, F.greatest(F.size(g) - at, F.lit(0))), _filled)
            made = F.transform(body, lambda row: _register(F.coalesce(_cell(row, s["n"]), F.lit("")), offset=_cell(row, s["o"]), address=_cell(row, s["a"]), width=width(_cell(row, s["w"])), reset_value=_cell(row, s["r"]), access=F.coalesce(_cell(row, s["x"]), F.lit("RW")), description=F.coalesce(_cell(row, s["d"]), F.lit(""))))
            return F.filter(made, lambda r: r["name"] != "")

        return _bound(spots, rows)

    registers = _bound(_headers(F.get(g, at - 1)), parse)
    return _table(context_peripheral(ctx), "register_map", ctx, registers)


def bitfield_table(grid, context) -> Column:
    """One register, named by the context, with a field per row with readable bits."""
    g, ctx = col(grid), F.coalesce(col(context), F.lit(""))

    def parse(header: Column) -> Column:
        spots = F.struct(*[find_column(header, names).alias(n) for names, n in ((FIELD_NAME, "n"), (FIELD_BITS, "b"), (ACCESS, "x"), (RESET, "r"), (DESCRIPTION, "d"))])

        def rows(s: Column) -> Column:
            body = F.filter(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), _filled)

            def field(row: Column) -> Column:
                bits = F.coalesce(_cell(row, s["b"]), F.lit(""))
                pair = bit_notation(bits)
                return F.struct(F.coalesce(_cell(row, s["n"]), F.lit("")).alias("name"), bits.alias("bits"), pair["msb"].alias("msb"), pair["lsb"].alias("lsb"), F.coalesce(_cell(row, s["x"]), F.lit("RW")).alias("access"), F.coalesce(_cell(row, s["d"]), F.lit("")).alias("description"), _cell(row, s["r"]).alias("reset_value"))

            return F.filter(F.transform(body, field), lambda f: (f["name"] != "") & f["msb"].isNotNull())

        return _bound(spots, rows)

    fields = _bound(_headers(F.get(g, F.lit(0))), parse)
    register = _register(caption_name(ctx), access=F.lit("RW"), description=ctx, fields=fields)
    return _table(context_peripheral(ctx), "bitfield_definition", ctx, F.array(register))


def extract_table(kind, grid, context) -> Column:
    """Parser by table type; null for other types and for grids of under two rows. Memory
    maps are read as register maps."""
    k, enough = col(kind), F.size(col(grid)) >= 2
    return F.when(enough & k.isin("register_map", "memory_map"), register_map(grid, context)).when(enough & (k == "bitfield_definition"), bitfield_table(grid, context))


def summary_grid(grid, peripheral=None) -> Column:
    """(name, offset) pairs of a grid with an offset, a name and bit-number columns."""
    g = col(grid)
    given = F.nullif(col(peripheral), F.lit("")) if peripheral is not None else F.lit(None).cast("string")

    def parse(header: Column) -> Column:
        o, n = find_column(header, OFFSET), find_column(header, SUMMARY_NAME)
        others = F.filter(header, lambda h, i: (i + 1 != F.coalesce(o, F.lit(0))) & (i + 1 != F.coalesce(n, F.lit(0))) & (h != ""))
        numbers = F.filter(others, lambda h: h.rlike(r"^\d{1,2}$"))
        bits = (F.size(others) >= 4) & (F.size(numbers) >= F.size(others) * 0.6)
        made = F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda row: _register(F.coalesce(_cell(row, n), F.lit("")), offset=F.coalesce(_cell(row, o), F.lit(""))))
        kept = F.filter(made, lambda r: (r["name"] != "") & (r["offset"] != ""))
        return F.when(o.isNotNull() & n.isNotNull() & bits & (F.size(kept) > 0), kept)

    registers = _bound(F.transform(F.get(g, F.lit(0)), lambda c: F.lower(collapse(c))), parse)
    return F.when((F.size(g) >= 2) & registers.isNotNull(), _table(F.coalesce(given, F.lit("Unknown")), "register_map", F.lit(""), registers))


def widest_header(grids) -> Column:
    """'Columns: A | B' from the widest first row among grids; null below two cells."""
    firsts = F.filter(F.transform(col(grids), lambda g: F.get(g, F.lit(0))), lambda r: r.isNotNull())
    widest = F.aggregate(firsts, F.array().cast("array<string>"), lambda best, r: F.when(F.size(r) > F.size(best), r).otherwise(best))
    cells = F.filter(F.transform(widest, collapse), lambda c: c != "")
    return F.when(F.size(cells) >= 2, F.concat(F.lit("Columns: "), F.array_join(cells, " | ")))


def bounding_box(boxes) -> Column:
    """Smallest box around struct(x0, y0, x1, y1) boxes."""
    b = col(boxes)

    def side(name: str, pick) -> Column:
        return pick(F.transform(b, lambda box: box[name])).alias(name)

    return F.struct(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))
