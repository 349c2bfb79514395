"""Register records from prose: titles, offsets, reset values, bit fields, captions.

Patterns are compact (no verbose mode: Java drops blanks inside classes there) and use
numbered groups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import col, collapse, strip_blank

# The wording of register sections, captions and headings.
TITLE = r"([A-Za-z][\w \-/,]*?\s+registers?)(?:\s+[^()\n]+?)?\s*\(\s*([A-Z][A-Z0-9_]+)\s*\)"
OFFSET = r"(?i)Address\s+offset\s*:\s*([^\n]+)"
RESET = r"(?i)Reset\s+value\s*:\s*(0x[0-9A-Fa-f][0-9A-Fa-f \t]*)"
BITS_LINE = r"[ \t]*Bits?[ \t]+\d+(?::\d+)?[ \t]+"
NAME_COLON = r"^([A-Za-z_][A-Za-z0-9_]*)(?:\[\d+(?::\d+)?\])?\s*:\s*([^\n]*)$"
ARM_CAPTION = r"(?i)Table\s+\d+\s*\.\s+([A-Za-z][A-Za-z0-9_]+)[^\n]*?\bbit\s+assignments\b"
NUMBERED_HEADING = r"\b\d+(?:\.\d+)+\s+([A-Z][\w\-]*(?:\s+[A-Z][\w\-]*)*)\s+[Aa]ddress\b"

FIELD = "struct<name string, bits string, msb int, lsb int, access string, description string, reset_value string>"
REGISTER = f"struct<name string, address string, offset string, width int, reset_value string, access string, description string, fields array<{FIELD}>>"
TABLE = f"struct<peripheral string, table_type string, context string, registers array<{REGISTER}>>"


def group(text, pattern: str, n: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(col(text), pattern, n), F.lit(""))


def abbreviation(title) -> Column:
    return group(title, f"(?U){TITLE}", 2)


def offset(content) -> Column:
    return F.nullif(collapse(group(content, OFFSET)), F.lit(""))


def reset_value(content) -> Column:
    return F.nullif(collapse(group(content, RESET)), F.lit(""))


def msb(bits) -> Column:
    return F.split(col(bits), ":")[0].try_cast("int")


def lsb(bits) -> Column:
    return F.element_at(F.split(col(bits), ":"), -1).try_cast("int")


def bit_notation(cell) -> Column:
    """'[31:24]', '31:24' or '[7]' as struct(msb, lsb); null for anything else."""
    clean = F.regexp_replace(col(cell), r"[\[\]\s]", "")
    high, low = group(clean, r"^(\d+):(\d+)"), group(clean, r"^(\d+):(\d+)", 2)
    single = group(clean, r"^(\d+)$")
    pair = F.struct(F.coalesce(high, single).try_cast("int").alias("msb"), F.coalesce(low, single).try_cast("int").alias("lsb"))
    return F.when(F.coalesce(high, single).isNotNull(), pair)


def width(cell) -> Column:
    return F.coalesce(group(cell, r"(\d+)").try_cast("int"), F.lit(32))


def infer_peripheral(abbrev) -> Column:
    return F.substring_index(col(abbrev), "_", 1)


def bit_fields(content) -> Column:
    """Bit-field paragraphs: a marker line and all lines up to the next marker. Reserved
    and nameless ones are left out."""
    blocks = F.regexp_extract_all(col(content), F.lit(rf"(?md)^{BITS_LINE}[^\n]*(?:\n(?!{BITS_LINE})[^\n]*)*"), F.lit(0))

    def field(block: Column) -> Column:
        bits = F.regexp_extract(block, r"^[ \t]*Bits?[ \t]+(\d+(?::\d+)?)", 1)
        rest = strip_blank(F.regexp_extract(block, rf"^{BITS_LINE}([^\n]*)", 1))
        behind = F.locate("\n", block)
        following = F.when(behind > 0, strip_blank(F.substr(block, behind + 1, F.length(block)))).otherwise("")
        name, first = F.regexp_extract(rest, NAME_COLON, 1), strip_blank(F.regexp_extract(rest, NAME_COLON, 2))
        both = F.array_join(F.filter(F.array(first, following), lambda x: x != ""), "\n")
        return F.struct(name.alias("name"), bits.alias("bits"), msb(bits).alias("msb"), lsb(bits).alias("lsb"), F.lit("").alias("access"), both.alias("description"), F.lit(None).cast("string").alias("reset_value"))

    return F.filter(F.transform(blocks, field), lambda f: (f["name"] != "") & (F.lower(f["name"]) != "reserved"))


def register_section(title, content, peripheral=None) -> Column:
    """The register table of a prose section; null without an abbreviation in the title
    or without a bit field."""
    name, fields = abbreviation(title), bit_fields(content)
    given = F.nullif(col(peripheral), F.lit("")) if peripheral is not None else F.lit(None).cast("string")
    register = F.struct(name.alias("name"), F.lit(None).cast("string").alias("address"), offset(content).alias("offset"), F.lit(32).alias("width"), reset_value(content).alias("reset_value"), F.lit("").alias("access"), col(title).alias("description"), fields.alias("fields"))
    table = F.struct(F.coalesce(given, infer_peripheral(name)).alias("peripheral"), F.lit("bitfield_definition").alias("table_type"), col(title).alias("context"), F.array(register).alias("registers"))
    return F.when(name.isNotNull() & (F.size(fields) > 0), table)


def caption_name(context) -> Column:
    """Register name of a caption or heading, else the first all-capitals word, else
    'Unknown'."""
    words = F.split(F.coalesce(col(context), F.lit("")), r"(?U)\s+")
    capital = F.get(F.filter(words, lambda w: w.rlike(r"^[A-Z_]{2,10}$")), F.lit(0))
    return F.coalesce(F.upper(group(context, ARM_CAPTION)), strip_blank(group(context, NUMBERED_HEADING)), capital, F.lit("Unknown"))


def context_peripheral(context) -> Column:
    words = F.split(F.coalesce(col(context), F.lit("")), r"(?U)\s+")
    return F.coalesce(F.get(F.filter(words, lambda w: w.rlike(r"^[A-Z][A-Za-z0-9_]*$")), F.lit(0)), F.lit("Unknown"))


def table_text(table) -> Column:
    """A register table as compact text."""
    t = col(table)

    def field(f: Column) -> Column:
        return F.concat(F.lit("  - "), f["name"], F.lit(" ["), f["bits"], F.lit("]: "), f["description"], F.lit(" ("), f["access"], F.lit(")"))

    def register(r: Column) -> Column:
        def part(label: str, value: Column) -> Column:
            return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

        details = F.array(part("Address: ", r["address"]), part("Offset: ", r["offset"]), F.concat(F.lit("Width: "), r["width"].cast("string"), F.lit("-bit")), part("Reset: ", r["reset_value"]), F.concat(F.lit("Access: "), r["access"]))
        lines = F.array(F.concat(F.lit("## "), r["name"]), F.array_join(F.filter(details, lambda x: x.isNotNull()), " | "), part("Description: ", r["description"]))
        listed = F.when(F.size(r["fields"]) > 0, F.concat(F.array(F.lit("\nFields:")), F.transform(r["fields"], field))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.filter(lines, lambda x: x.isNotNull()), listed, F.array(F.lit("")))

    head = F.array(F.concat(F.lit("# "), t["peripheral"], F.lit(" - "), F.initcap(F.replace(t["table_type"], F.lit("_"), F.lit(" ")))), F.lit(""))
    context = F.when(F.coalesce(t["context"], F.lit("")) != "", F.array(F.concat(F.lit("Context: "), t["context"]), F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, context, F.flatten(F.transform(t["registers"], register))), "\n")


def table_json(table) -> Column:
    """A register table as JSON; a field's bit range is a two-element list."""
    t = col(table)

    def field(f: Column) -> Column:
        return F.struct(f["name"].alias("name"), f["bits"].alias("bits"), F.array(f["msb"], f["lsb"]).alias("bit_range"), f["access"].alias("access"), f["description"].alias("description"), f["reset_value"].alias("reset_value"))

    def register(r: Column) -> Column:
        return F.struct(*[r[c].alias(c) for c in ("name", "address", "offset", "width", "reset_value", "access", "description")], F.transform(r["fields"], field).alias("fields"))

    return F.to_json(F.struct(t["peripheral"].alias("peripheral"), t["table_type"].alias("table_type"), t["context"].alias("context"), F.transform(t["registers"], register).alias("registers")), {"ignoreNullFields": "false"})


def table_markdown(table) -> Column:
    """A register table as markdown for results."""
    t = col(table)

    def register(r: Column) -> Column:
        full = lambda v: F.coalesce(v, F.lit("")) != ""
        place = F.when(full(r["address"]), F.concat(F.lit(" ("), r["address"], F.lit(")"))).when(full(r["offset"]), F.concat(F.lit(" (Offset: "), r["offset"], F.lit(")"))).otherwise("")
        details = F.array(F.concat(F.lit("**Width:** "), r["width"].cast("string"), F.lit("-bit")), F.when(full(r["reset_value"]), F.concat(F.lit("**Reset:** "), r["reset_value"])), F.concat(F.lit("**Access:** "), r["access"]))
        lines = F.array(F.concat(F.lit("### "), r["name"], place), F.array_join(F.filter(details, lambda x: x.isNotNull()), " | "), F.when(full(r["description"]), F.concat(F.lit("\n"), r["description"])))
        rows = F.transform(r["fields"], lambda f: F.concat(F.lit("- **"), f["name"], F.lit("** ["), f["bits"], F.lit("]: "), f["description"], F.lit(" ("), f["access"], F.lit(")")))
        listed = F.when(F.size(r["fields"]) > 0, F.concat(F.array(F.lit("\n**Fields:**")), rows)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.filter(lines, lambda x: x.isNotNull()), listed, F.array(F.lit("")))

    head = F.array(F.concat(F.lit("**"), t["peripheral"], F.lit("** - "), F.initcap(F.replace(t["table_type"], F.lit("_"), F.lit(" ")))), F.lit(""))
    return F.array_join(F.concat(head, F.flatten(F.transform(t["registers"], register))), "\n")
