"""Column expressions for text rules: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from findery.config import STOPWORDS, Rules

#: A token is a run of these characters.
TOKEN_BREAK = "[^a-zA-Z0-9&가-힣]+"


def normalize(value: Column) -> Column:
    """Trimmed and lower-cased text; empty becomes null."""
    return F.nullif(F.lower(F.trim(value.cast("string"))), F.lit(""))


def spaced(text: Column) -> Column:
    return F.translate(text, "_", " ")


def label(text: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """First label, in order, one of whose patterns occurs in ``text``, regardless of case."""
    out = None
    for name, ways in patterns.items():
        if ways:
            hit = text.rlike("(?iU)" + "|".join(f"(?:{w})" for w in ways))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def tag(text: Column, pattern: str) -> Column:
    return F.upper(F.regexp_substr(text, F.lit("(?iU)" + pattern)))


def year(text: Column, pattern: str) -> Column:
    return F.regexp_substr(text, F.lit("(?U)" + pattern)).try_cast("int")


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more that are no stop words, in order, repeats included."""
    lowered = F.transform(F.split(text, TOKEN_BREAK), F.lower)
    return F.filter(lowered, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def metadata(text: Column, rules: Rules) -> dict[str, Column]:
    """The six fields that free text gives under ``rules``."""
    plain = spaced(text)
    return {
        "project_name": label(plain, rules.project_name),
        "doc_type": label(plain, rules.doc_type),
        "department": label(plain, rules.department),
        "equipment_tag": tag(plain, rules.tag),
        "year": year(plain, rules.year),
        "keywords": F.coalesce(tokens(text), F.array().cast("array<string>")),
    }


def parts(path: Column) -> Column:
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def file_ext(path: Column) -> Column:
    """Last suffix, lower-case, with its dot; empty for none, for a leading dot alone and for a final dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def parse_text(path: Column) -> Column:
    """Stem, then the folders from the root down, separated by `` / ``."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")
    return F.concat_ws(" / ", F.array(stem), F.slice(parts(path), F.lit(1), F.size(parts(path)) - 1))


def top_folder(path: Column) -> Column:
    """First part of the path; a file at the root is its own folder."""
    return F.get(parts(path), 0)


def doc_id(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def is_junk(name: Column) -> Column:
    return F.lower(name).isin("desktop.ini", "thumbs.db") | name.startswith("~$") | name.startswith(".")


def within_one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion or substitution apart."""
    return F.levenshtein(a, b, 1) >= 0


def digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def loose(a: Column, b: Column) -> Column:
    """Equal; or, unless either is all digits, one holds the other, or both have 4 characters or more and are one edit apart."""
    number = digits(a) | digits(b)
    sizes = (F.least(F.length(a), F.length(b)) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 1)
    return (a == b) | (~number & (F.contains(a, b) | F.contains(b, a) | (sizes & within_one_edit(a, b))))


def local_minute(stamp: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in the session's zone; null if the text is no timestamp."""
    return F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd HH:mm")
