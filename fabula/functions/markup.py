"""Markup to text as Column builders: no Python runs, and a page is read in one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Elements whose content isn't text, page furniture, and those that begin and end a paragraph; names of the characters that pages escape most.
RAW, FURNITURE = ("script", "style"), ("nav", "header", "footer")
BLOCKS = "p div h1 h2 h3 h4 h5 h6 li blockquote pre".split()
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "laquo": "«", "raquo": "»", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "deg": "°", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ugrave": "ù", "ocirc": "ô", "icirc": "î", "ntilde": "ñ", "szlig": "ß", "auml": "ä", "ouml": "ö", "uuml": "ü"}
#: How deep page furniture may stand in page furniture.
DEPTH = 4

_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_CUT = "\x01"


def unescaped(c: Column) -> Column:
    """Character references: by number, and the names above."""
    numbered = F.array_distinct(F.regexp_extract_all(c, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def put(text: Column, ref: Column) -> Column:
        body = F.regexp_replace(ref, "[&#xX;]", "")
        code = F.when(F.lower(ref).startswith("&#x"), F.conv(body, 16, 10)).otherwise(body).cast("long")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.replace(text, ref, F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("�")))

    named = reduce(lambda out, x: F.replace(out, F.lit(f"&{x[0]};"), F.lit(x[1])), NAMED.items(), F.aggregate(numbered, c, put))
    return F.replace(named, F.lit("&amp;"), F.lit("&"))


def block_text(markup: Column) -> Column:
    """Text of the block elements in document order, each text once, parted by blank lines; scripts, styles, comments and page furniture are left out.

    What is never closed reaches to the end; null gives an empty text.
    """
    out = F.coalesce(markup, F.lit(""))
    for tag in RAW:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b{_REST}.*?(?:</{tag}\s*+>|\z)", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?(?:-->|\z)", "")
    furniture = "|".join(FURNITURE)
    for _ in range(DEPTH):  # innermost first
        out = F.regexp_replace(out, rf"(?is)<({furniture})\b{_REST}(?:(?!<(?:{furniture})\b).)*?</\1\s*+>", "")
    out = F.regexp_replace(out, rf"(?is)<(?:{furniture})\b{_REST}.*\z", "")
    out = F.regexp_replace(out, rf"(?i)<br\b{_REST}", "\n")
    out = F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b{_REST}", _CUT)
    out = F.regexp_replace(out, rf"<[a-zA-Z/!?]{_REST}", "")
    parts = F.filter(F.transform(F.split(out, _CUT), lambda p: strip(unescaped(p))), lambda p: p != "")
    return F.array_join(parts, "\n\n")
