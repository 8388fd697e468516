"""Identifiers, names, dates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenarc.functions.text import col

DOI_PREFIX = r"^(https?://(dx\.)?doi\.org/|(dx\.)?doi\.org/|doi:)\s*"
DOI = r"10\.\d{4,9}/[^\s\"<>]+"
MILLISECONDS_FROM = 1e12


def normalize_doi(doi: Column | str) -> Column:
    """Lower case without resolver or scheme; null unless it begins with 10."""
    d = F.regexp_replace(F.lower(F.trim(col(doi))), DOI_PREFIX, "")
    return F.when(d.startswith("10."), d)


def find_dois(text: Column | str) -> Column:
    """Distinct DOIs in a text, lower case, without closing dots."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(DOI), F.lit(0))
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;)]+$", "")))


def author_string(names: Column | str) -> Column:
    a = col(names)
    n = F.coalesce(F.size(a), F.lit(0))
    return F.when(n <= 0, "Unknown").when(n == 1, a[0]).when(n == 2, F.concat_ws(" and ", a)).otherwise(F.concat(a[0], F.lit(" et al.")))


def year_of(date: Column | str) -> Column:
    """First year of the 20th or 21st century in a date text."""
    y = F.regexp_extract(F.coalesce(col(date), F.lit("")), r"\b((?:19|20)\d{2})\b", 1)
    return F.when(y != "", y).cast("int")


def first_match(text: Column | str, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return F.coalesce(*[F.when(col(text).rlike(p), F.regexp_extract(col(text), p, 1)) for p in patterns])


ARXIV = [r"(?i)arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5})", r"(?i)arxiv[:.\s]*(\d{4}\.\d{4,5})"]
ISBN = [r"(?i)isbn(?:-1[03])?[:\s]*((?:97[89][-\s]?)?\d{1,5}[-\s]?\d{1,7}[-\s]?\d{1,7}[-\s]?[\dX])"]


def arxiv_id(*sources: Column | str) -> Column:
    return F.coalesce(*[first_match(s, ARXIV) for s in sources])


def isbn(text: Column | str) -> Column:
    return F.regexp_replace(first_match(text, ISBN), r"[-\s]", "")


def parse_time(value: Column | str) -> Column:
    """ISO 8601 with Z or offset; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(col(value), "Z$", "+00:00"))


def epoch_time(value: Column | str) -> Column:
    """Seconds or, from a million millions on, milliseconds since 1970."""
    v = col(value).cast("double")
    return F.when(v > MILLISECONDS_FROM, v / 1000).otherwise(v).cast("timestamp")


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 over values in the given order; nulls and empty texts differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def content_hash(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[col(p).cast("string") for p in parts]), 256), 1, 16)


def int_id(key: Column | str) -> Column:
    """A positive 31-bit number from a text key."""
    return F.pmod(F.conv(F.substring(F.sha2(col(key), 256), 1, 8), 16, 10).cast("long"), F.lit(2**31 - 1)).cast("int")


def citation_key(last_name: Column | str, year: Column | str) -> Column:
    return F.regexp_replace(F.concat(F.coalesce(col(last_name), F.lit("Unknown")), F.coalesce(col(year).cast("string"), F.lit("nd"))), "[^A-Za-z0-9]", "")
