"""Label normalisation and matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are folded, by the letter that they become.
FOLDED = {
    "a": "ÀÁÂÃÄàáâãäĄą",
    "e": "ÉÈÊËéèêëĚěĘę",
    "i": "ÎÏÍîïí",
    "o": "ÔÖÓôöó",
    "u": "ÙÛÜÚùûüúŮů",
    "c": "ÇçČč",
    "n": "ÑñŃńŇň",
    "s": "ŠšŚśŞş",
    "z": "ŽžŹźŻż",
    "r": "Řř",
    "d": "Ďď",
    "t": "Ťť",
    "y": "Ýý",
    "g": "Ğğ",
}
_FROM = "".join(FOLDED.values())
_TO = "".join(k * len(v) for k, v in FOLDED.items())


def normalize_label(label: Column) -> Column:
    """Trim, open ligatures, fold accents, keep ``[A-Za-z0-9 _-]``, lower-case."""
    opened = F.regexp_replace(F.regexp_replace(F.trim(label), "[œŒ]", "oe"), "[æÆ]", "ae")
    return F.lower(F.regexp_replace(F.translate(opened, _FROM, _TO), "[^A-Za-z0-9 _-]", ""))


def match_score(label: Column, query: Column) -> Column:
    """0 if the normal forms are equal, 1 for a prefix, 2 if contained, else null."""
    own, asked = normalize_label(label), normalize_label(query)
    return F.when(own == asked, 0).when(own.startswith(asked), 1).when(own.contains(asked), 2)


def pascal_case(name: Column) -> Column:
    return F.regexp_replace(F.initcap(F.regexp_replace(name, "_", " ")), " ", "")
