"""Text functions of document structure as Column expressions. Patterns behave as Unicode-aware ones do in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Latin-1 decoding makes of the bytes 0x80 to 0xFF, and what they mean in code page 1251.
LATIN = "".join(map(chr, range(0x80, 0x100)))
CYRILLIC = bytes(range(0x80, 0x100)).replace(b"\x98", b"\x80").decode("cp1251")
_VOWEL = "[аеиоуыэюя]"
_ENDINGS = "у ю ут ют утся ются ешь ет ете ем емте ишь ит ите им имте ат атся ят ятся йте ти тись чь чься".split()
#: Three letters or more, then an ending that verbs have.
VERB = rf"(?iuU)\b[а-яё]{{3,}}(?:{_VOWEL}(?:ть(?:ся)?|л[аои]?(?:с[ья])?)|{'|'.join(sorted(_ENDINGS, key=len, reverse=True))})\b"
#: Words that may stand before a number.
LABEL = "(?:Раздел|Пункт|Часть)?"
FENCE = "```"
#: White space of any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any script around."""
    return F.btrim(c, F.lit(WHITE))


def normalize_whitespace(c: Column) -> Column:
    """Runs of blanks and tabs become one blank; newlines stay."""
    return F.regexp_replace(c, r"[ \t]+", " ")


def contains_verb(c: Column) -> Column:
    """Whether a Cyrillic word has a verb's ending; false for null and blank texts."""
    return F.coalesce(F.regexp_like(c, F.lit(VERB)), F.lit(False))


def is_section_header(c: Column) -> Column:
    """A number with dots, a number with a bracket, or a Roman number, then white space."""
    return F.regexp_like(c, F.lit(r"(?U)^\s*(?:\d+(?:\.\d+)*\.|\d+\)|[IVX]+\.|[ivx]+\.)\s+"))


def is_table_reference(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"(?iuU)(?:Таблица|Table)\s+\d+"))


def table_name(c: Column) -> Column:
    """The name in a caption, or null; a name that is only a number isn't one."""
    name = F.regexp_extract(strip(c), r"(?iuUs)^Таблица\s+\d+(?:\.\d+)*[:.\s]+(.+)$", 1)
    return F.when((name != "") & ~F.regexp_like(strip(name), F.lit(r"^\d+(?:\.\d+)*$")), strip(name))


def is_likely_number(number: Column) -> Column:
    """Neither a year of the last two centuries nor a date."""
    return ~F.regexp_like(number, F.lit(r"^(?:(?:19|20)\d{2}|\d{1,2}\.\d{1,2}\.(?:\d{2}|\d{4}))$"))


def section_title(line: Column) -> Column:
    """A heading without its number."""
    return strip(F.regexp_replace(line, r"(?U)^\s*\d+(?:\.\d+)*\.?\s*", ""))


def section_level(number: Column) -> Column:
    return (F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).cast("int")


def contains_lists(c: Column) -> Column:
    """Whether any line is an item of a numbered, bulleted or lettered list."""
    return F.exists(F.split(c, "\n"), lambda line: F.regexp_like(strip(line), F.lit(r"^(?:\d+\)|[•*-]|[a-zа-я]\.)")))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")).cast("int")


def char_count(c: Column) -> Column:
    return F.length(c)


def escape_cell(c: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"[\n\r]", " ")


def is_table_number(number: Column) -> Column:
    return F.contains(number, F.lit(".T"))


def short_title(line: Column) -> Column:
    """The first 50 characters, and dots if there are more."""
    return F.when(F.length(line) > 50, F.concat(F.left(line, F.lit(50)), F.lit("..."))).otherwise(line)


def json_string(c: Column) -> Column:
    """A JSON string literal with letters of any script as they are."""
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for raw, name in ((x, short.get(x, f"\\u{ord(x):04x}")) for x in map(chr, range(32))):
        quoted = F.replace(quoted, F.lit(raw), F.lit(name))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def fact_json(fact: Column) -> Column:
    """A fact, struct of attributes, value and col, as JSON with a blank after colons and commas."""
    names = F.array_join(F.transform(fact["attributes"], json_string), ", ")
    return F.concat(F.lit('{"attributes": ['), names, F.lit('], "value": '), json_string(fact["value"]), F.lit(', "col": '), fact["col"].cast("string"), F.lit("}"))


def item_json(item: Column) -> Column:
    """An item, struct of item_name, row and facts, as JSON."""
    facts = F.array_join(F.transform(item["facts"], fact_json), ", ")
    return F.concat(F.lit('{"item_name": '), json_string(item["item_name"]), F.lit(', "row": '), item["row"].cast("string"), F.lit(', "facts": ['), facts, F.lit("]}"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 without its mark, else code page 1251, else, with a byte that page lacks, Latin-1."""
    raw = F.decode(content, "ISO-8859-1")
    page = F.translate(raw, LATIN, CYRILLIC)
    eight = F.when(F.contains(raw, F.lit("\x98")), raw).otherwise(page)
    utf = F.is_valid_utf8(content.cast("string"))
    return F.when(utf, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(eight)


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def printable(c: Column) -> Column:
    """Letters, numbers, punctuation, symbols, separators, tabs and line ends; question marks at line starts go."""
    kept = F.regexp_replace(F.replace(c, F.lit("﻿"), F.lit("")), r"[^\p{L}\p{N}\p{P}\p{S}\p{Z}\t\r\n]", "")
    return F.regexp_replace(kept, r"(?m)^\?+", "")


def plain_text(content: Column) -> Column:
    """Bytes of a text file as clean text."""
    return printable(newlines(decoded(content)))
