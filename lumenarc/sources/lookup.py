"""Metadata services: answers of a caller's fetch function and their parsing into one set of fields.

No network is used here; `fetch` is the caller's. Each service's JSON becomes a struct of FIELDS.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions.text import col

AUTHORS = "array<struct<given:string,family:string>>"
FIELDS = ("doi", "title", "authors", "year", "journal", "publisher", "volume", "issue", "pages")


def fetch_json(rows: DataFrame, url: str, fetch: Callable[[str], str | None], out: str = "json", seconds: float = 1.0) -> DataFrame:
    """rows with what `fetch` gives for their URL, one call at a time in a task and `seconds` apart; null where it fails or the URL is null."""

    @F.arrow_udf("string")
    def ask(urls):
        import pyarrow as pa

        got, last = [], 0.0
        for u in urls.to_pylist():
            answer = None
            if u is not None:
                time.sleep(max(0.0, last + seconds - time.monotonic()))
                last = time.monotonic()
                try:
                    answer = fetch(u)
                except Exception:  # a service that fails has no answer
                    answer = None
            got.append(answer)
        return pa.array(got, pa.string())

    return rows.withColumn(out, ask(F.col(url)))


def fields(**given: Column) -> Column:
    kinds = {"authors": AUTHORS, "year": "int"}
    return F.struct(*[given.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in FIELDS])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def crossref_fields(json: Column | str) -> Column:
    """A Crossref work: the first title and journal, print year before online year."""
    date = "struct<`date-parts`: array<array<int>>>"
    w = F.from_json(col(json), f"DOI string, title array<string>, author {AUTHORS}, publisher string, `container-title` array<string>, volume string, issue string, page string, `published-print` {date}, `published-online` {date}")
    year = lambda n: F.get(F.get(w[n]["date-parts"], F.lit(0)), F.lit(0))
    return fields(doi=w["DOI"], title=F.get(w["title"], F.lit(0)), authors=w["author"], year=F.coalesce(year("published-print"), year("published-online")), journal=F.get(w["container-title"], F.lit(0)), publisher=w["publisher"], volume=w["volume"], issue=w["issue"], pages=w["page"])


def split_name(name: Column) -> Column:
    """given, family: the last word is the family's."""
    cut = F.contains(name, F.lit(" "))
    given = F.when(cut, F.regexp_extract(name, r"^(.*) [^ ]*$", 1))
    return F.struct(given.alias("given"), F.when(cut, F.regexp_extract(name, r"([^ ]*)$", 1)).otherwise(name).alias("family"))


def page_range(first: Column, last: Column) -> Column:
    return F.when(blank_to_null(first).isNotNull(), F.concat_ws("-", first, blank_to_null(last)))


def openalex_fields(json: Column | str) -> Column:
    """An OpenAlex work."""
    w = F.from_json(
        col(json),
        "doi string, display_name string, publication_year int, authorships array<struct<author: struct<display_name: string>>>, "
        "primary_location struct<source: struct<display_name: string, host_organization_name: string>>, biblio struct<volume: string, issue: string, first_page: string, last_page: string>",
    )
    names = F.filter(F.transform(w["authorships"], lambda a: blank_to_null(a["author"]["display_name"])), lambda n: n.isNotNull())
    source = w["primary_location"]["source"]
    return fields(
        doi=F.replace(w["doi"], F.lit("https://doi.org/"), F.lit("")),
        title=blank_to_null(w["display_name"]),
        authors=F.transform(names, split_name),
        year=w["publication_year"],
        journal=source["display_name"],
        publisher=F.when(source["display_name"].isNotNull(), source["host_organization_name"]),
        volume=w["biblio"]["volume"],
        issue=w["biblio"]["issue"],
        pages=page_range(w["biblio"]["first_page"], w["biblio"]["last_page"]),
    )


def openlibrary_fields(json: Column | str) -> Column:
    """An Open Library edition: title, the first publisher, the year in the date of publication."""
    w = F.from_json(col(json), "title string, publishers array<string>, publish_date string")
    return fields(title=w["title"], publisher=F.get(w["publishers"], F.lit(0)), year=F.nullif(F.regexp_extract(w["publish_date"], r"(\d{4})", 1), F.lit("")).cast("int"))


def semantic_scholar_fields(json: Column | str) -> Column:
    """A Semantic Scholar paper."""
    w = F.from_json(col(json), "externalIds struct<DOI: string>, title string, authors array<struct<name: string>>, year int, venue string")
    names = F.filter(F.transform(w["authors"], lambda a: blank_to_null(a["name"])), lambda n: n.isNotNull())
    return fields(doi=w["externalIds"]["DOI"], title=w["title"], authors=F.transform(names, split_name), year=w["year"], journal=blank_to_null(w["venue"]))


PARSERS = {"crossref": crossref_fields, "openalex": openalex_fields, "openlibrary": openlibrary_fields, "semantic_scholar": semantic_scholar_fields}
