"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(text: Column) -> Column:
    """Words of an identifier: split at case changes and at what is neither letter nor digit."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(spaced, r"[^A-Za-z0-9]+"), lambda w: w != "")


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def normal_label(text: Column) -> Column:
    return F.array_join(F.transform(_parts(text), _capital), "")


def normal_property(text: Column) -> Column:
    label = normal_label(text)
    return F.concat(F.lower(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30))


def normal_relationship(text: Column) -> Column:
    return F.upper(F.array_join(_parts(text), "_"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, most: int = 160) -> Column:
    return F.substring(collapsed(text), 1, most)


def failure_category(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_"), 1, 80)


def cleaned(text: Column) -> Column:
    """No-break spaces to spaces, all line ends to line feeds, stripped."""
    out = F.regexp_replace(F.regexp_replace(text, " ", " "), r"\r\n?", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


#: The patterns of property types, in the order they are tried.
TYPES = (
    ("boolean", r"^(?i:true|false)$"),
    ("integer", r"^[+-]?\d+$"),
    ("number", r"^[+-]?\d*\.\d+$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("datetime", r"^\d{4}-\d{2}-\d{2}[Tt ][0-2]\d:[0-5]\d:[0-5]\d(?:\.\d{1,9})?(?:[Zz]|[+-][0-2]\d:[0-5]\d)?$"),
)


def inferred_type(text: Column) -> Column:
    """The type of a property by the look of its value; null and blank are strings."""
    t, out = F.trim(text), F.lit("string")
    for name, pattern in reversed(TYPES):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def key_properties(names: Column) -> Column:
    """The first two names that look like keys (id, *Id, *Code, *Number), else the first two."""
    own = F.filter(names, lambda n: (n == "id") | n.endswith("Id") | n.endswith("Code") | n.endswith("Number"))
    known = F.filter(names, lambda n: n.isNotNull())
    return F.slice(F.when(F.size(own) > 0, own).otherwise(known), 1, 2)


def sanitised_label(text: Column, fallback: str = "Entity") -> Column:
    """Other characters than letters, digits and _ become _, the first letter a capital."""
    clean = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.when(~text.rlike(r"^\s*$"), F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30))).otherwise(fallback)


def sanitised_relation(text: Column, fallback: str = "RELATED_TO") -> Column:
    """Capitals, digits, and single _ between them."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(fallback)


def safe_name(text: Column) -> Column:
    """Is it an identifier that needs no quoting?"""
    return F.coalesce(text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def document_format(filename: Column, content_type: Column) -> Column:
    """TXT, PDF or DOCX by suffix or type; null where neither is known."""
    name, kind = F.lower(filename), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(name.endswith(".txt") | kind.startswith("text/plain"), "TXT")
        .when(name.endswith(".pdf") | kind.contains("pdf"), "PDF")
        .when(name.endswith(".docx") | kind.contains("officedocument.wordprocessingml.document"), "DOCX")
    )


#: Characters that the full-text syntax escapes one by one, and pairs that it escapes together.
ESCAPED, ESCAPED_PAIRS = '+-!(){}[]^"~*?:\\/', ("&&", "||")


def lexical_query(text: str, most: int = 16) -> str:
    """A query string for full-text search: the phrase, boosted, or all of its terms; a single term alone."""

    def escape(term: str) -> str:
        single = re.sub(f"[{re.escape(ESCAPED)}]", lambda m: f"\\{m[0]}", term)
        return re.sub("|".join(map(re.escape, ESCAPED_PAIRS)), lambda m: f"\\{m[0][0]}\\{m[0][1]}", single)

    escaped = [escape(t) for t in text.split()[:most]]
    if len(escaped) < 2:
        return "".join(escaped)
    return f'("{" ".join(escaped)}")^3 OR ({" AND ".join(escaped)})'
