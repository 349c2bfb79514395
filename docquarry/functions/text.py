"""Text column expressions: folding, tokens, query words, table-of-contents tests."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining diacritical marks, which fold to nothing.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _composed() -> dict[str, str]:
    """Lower-case letters that decompose canonically into one letter and such marks."""
    parts = ((chr(p), unicodedata.normalize("NFD", chr(p))) for p in range(0x80, 0x3000))
    return {ch: d[0] for ch, d in parts if len(d) > 1 and d[0].isalpha() and ch == ch.lower() and set(d[1:]) <= set(MARKS)}


_FOLDED = _composed()
#: What translate() turns into what; marks have no counterpart and go.
ACCENTED, PLAIN = "".join(_FOLDED) + MARKS, "".join(_FOLDED.values())

#: Characters outside letters and digits split tokens.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# What marks a query word as literal, and dot leaders of contents lines.
LITERAL = r"(?i)^0x|[:./_\-\[\]()]"
TOC_LEADER = r"\.\s\.\s\.|\.{4,}"
TOC_SHARE = 0.4
SECTION_NUMBER = r"^\s*\d+(?:\.\d+)*\.?\s+"
TABLE_TITLE = r"(?i)^\s*Table\s+\d+\."


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(text) -> Column:
    """Lower case without diacritics, composed or as combining marks."""
    low = F.lower(col(text))
    return F.when(is_ascii(text), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def is_ascii(text) -> Column:
    return ~col(text).rlike(r"[^\x00-\x7F]")


def fold_python(word: str) -> str:
    """The same for a query's word."""
    return word.lower().translate(str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, MARKS))


def tokens(text) -> Column:
    """Folded letter-digit tokens in order; empty array for null."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), TOKEN_SPLIT), lambda t: t != "")


def collapse(text) -> Column:
    """White-space runs become single blanks, ends are trimmed; null becomes ''."""
    return F.array_join(F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda t: t != ""), " ")


def strip_blank(text) -> Column:
    """Without white space, Unicode kinds included, at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+\z", "")


def is_literal(word) -> Column:
    return col(word).rlike(LITERAL)


def strip_section_number(title) -> Column:
    return strip_blank(F.regexp_replace(col(title), f"(?U){SECTION_NUMBER}", ""))


def is_table_title(title) -> Column:
    return col(title).rlike(TABLE_TITLE)


def is_toc(text, share: float = TOC_SHARE) -> Column:
    """Most of the non-blank lines behind the hierarchy line end in dot leaders."""
    whole = col(text)
    at = F.locate("]\n", whole)
    body = F.when(at > 0, F.substr(whole, at + 2, F.length(whole))).otherwise(whole)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"(?U)\S"))
    return F.transform(F.array(lines), lambda found: (F.size(found) >= 4) & (F.size(F.filter(found, lambda x: x.rlike(TOC_LEADER))) >= share * F.size(found)))[0]


def context_prefix(title, hierarchy) -> Column:
    """'[Document > Section > ...]' and a line end; '' where no part is left."""
    parts = F.filter(F.concat(F.array(col(title)), col(hierarchy)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " > "), F.lit("]\n"))).otherwise(F.lit(""))


def chunk_id(doc_id, text) -> Column:
    return F.concat(col(doc_id), F.lit("_"), F.substring(F.md5(col(text)), 1, 12))


def document_id(filename) -> Column:
    return F.substring(F.md5(F.substring_index(col(filename), "/", -1)), 1, 16)


def excerpt(text, length: int = 500) -> Column:
    """At most `length` characters, cut behind the last full stop or line end if that is
    beyond seven tenths, with '...' wherever something was cut."""
    whole = col(text)
    head = F.substring(whole, 1, length)
    back = F.reverse(head)
    gap = F.least(*[F.when(F.locate(mark, back) > 0, F.locate(mark, back)).otherwise(length + 1) for mark in (".", "\n")])
    cut = length - gap  # 0-based place of the last mark
    short = F.when(cut > length * 0.7, F.substr(whole, F.lit(1), cut + 1)).otherwise(head)
    return F.when(F.length(whole) <= length, whole).otherwise(F.concat(short, F.lit("...")))
