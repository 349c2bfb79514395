"""Register prose, captions and grids."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docquarry.functions import grids as G
from docquarry.functions import registers as R
from docquarry.functions import text as T

TITLE = "4.9.1 Cache access control register (CACHE_ACR) "
BODY = """Address offset: 0x000 or 0x100
Reset value: 0x0000 0037
31 30 29 28 27
   Bits 31:6 Reserved, must be kept at reset value.
   Bits 5:4 SIGDELAY[1:0]: Signal delay
set by software
  Bits 3:0 WAITS: Wait states
0000: none
"""


def table(spark, title, body, peripheral=None):
    df = spark.createDataFrame([(title, body)], "t string, b string")
    return df.select(R.register_section("t", "b", F.lit(peripheral) if peripheral else None).alias("x")).first()["x"]


def test_register_section(spark):
    found = table(spark, TITLE, BODY)
    register = found.registers[0]
    assert (found.peripheral, register.name, register.offset, register.reset_value) == ("CACHE", "CACHE_ACR", "0x000 or 0x100", "0x0000 0037")
    assert [(f.name, f.bits, f.msb, f.lsb) for f in register.fields] == [("SIGDELAY", "5:4", 5, 4), ("WAITS", "3:0", 3, 0)]
    assert register.fields[0].description == "Signal delay\nset by software"


def test_given_peripheral_wins(spark):
    assert table(spark, TITLE, BODY, "Cache block").peripheral == "Cache block"


@pytest.mark.parametrize("title, body", [(TITLE, "no fields here"), ("Introduction", BODY), (TITLE, None), (TITLE, "Bits 3:0 Reserved, keep")])
def test_no_register(spark, title, body):
    assert table(spark, title, body) is None


def test_title_keeps_blanks_in_words(one):
    assert one(R.group(F.lit("Cache access control register for bank 1 (CACHE_KEY1R)"), R.TITLE, 1)) == "Cache access control register"
    assert one(R.abbreviation(F.lit("Cache key register for bank 1 (CACHE_KEY1R)"))) == "CACHE_KEY1R"


def test_full_width_field(one):
    assert [(f.name, f.msb, f.lsb) for f in one(R.bit_fields(F.lit("Bits 31:0 KEY1: key\n")))] == [("KEY1", 31, 0)]


def test_reset_value_takes_hex_like_letters(one):
    assert one(R.reset_value(F.lit("Reset value: 0x0000 0000 Access: word"))) == "0x0000 0000 Acce"


CAPTIONS = [
    ("Table 7. CTRL bit assignments", "CTRL"),
    ("Table 8. STAT register bit assignments", "STAT"),
    ("Table 9 . Control register bit assignments", "CONTROL"),
    ("Table 22. Fault state and fault place registers", "Unknown"),
    ("see the DMA_X words", "DMA_X"),
    ("", "Unknown"),
    (None, "Unknown"),
    ("7.1.1.5     Function Control Address = 04-06h", "Function Control"),
    ("7.2 Scratch Register\nAddress: 16h", "Scratch Register"),
    ("7.3 Other Heading without it", "Unknown"),
]


@pytest.mark.parametrize("caption, name", CAPTIONS)
def test_caption_names(spark, caption, name):
    assert spark.createDataFrame([(caption,)], "c string").select(R.caption_name("c")).first()[0] == name


@pytest.mark.parametrize("label, clean", [("4.9.1 CACHE registers", "CACHE registers"), ("4. Cache", "Cache"), ("Cache 4.1 x", "Cache 4.1 x"), ("CACHE", "CACHE")])
def test_section_labels(one, label, clean):
    assert one(T.strip_section_number(F.lit(label))) == clean


def grid(*rows):
    return F.array(*[F.array(*[F.lit(c) for c in row]) for row in rows])


def test_summary_grid(one):
    bits = [str(31 - i) for i in range(32)]
    found = one(G.summary_grid(grid(["Offset", "Register name", *bits], ["0x00", "CACHE_ACR", *["x"] * 32], ["0x04", "CACHE_KEYR", *[""] * 32])))
    assert [(r.name, r.offset) for r in found.registers] == [("CACHE_ACR", "0x00"), ("CACHE_KEYR", "0x04")] and found.peripheral == "Unknown"
    assert one(G.summary_grid(grid(["Mode", "Description"], ["a", "b"]))) is None


def test_register_map_keeps_blank_cells(one):
    found = one(G.register_map(grid(["some map"], ["Name", "Offset", "Access"], ["A", "", "RO"], ["", "0x1", ""], ["B"]), F.lit("UART0 map")))
    assert [(r.name, r.offset, r.access, r.width) for r in found.registers] == [("A", "", "RO", 32), ("B", None, "RW", 32)]
    assert found.peripheral == "UART0"


def test_tables_of_one_row_or_other_type_are_none(one):
    assert one(G.extract_table(F.lit("register_map"), grid(["Name"]), F.lit(""))) is None
    assert one(G.extract_table(F.lit("other"), grid(["Name"], ["a"]), F.lit(""))) is None
    assert one(G.extract_table(F.lit("memory_map"), grid(["Name"], ["a"]), F.lit(""))).table_type == "register_map"


@pytest.mark.parametrize("cell, pair", [("[31:24]", (31, 24)), ("7", (7, 7)), ("3 : 0", (3, 0)), ("7:0 rw", (7, 0)), ("x", None), ("", None)])
def test_bit_notation(one, cell, pair):
    found = one(R.bit_notation(F.lit(cell)))
    assert (found and tuple(found)) == pair


def test_header_types(one):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(G.is_header(words("address", "offset", "name"))) and not one(G.is_header(words("name", "value")))
    assert one(G.table_type(words("name", "access"))) == "register_map"  # a tie
    assert one(G.table_type(words("bits", "field", "type"))) == "bitfield_definition"
    assert one(G.table_type(words("x"))) == "other"


def test_bounding_box(one):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    assert tuple(one(G.bounding_box(F.array(box(1, 2, 3, 4), box(0, 5, 2, 9))))) == (0, 2, 3, 9)
