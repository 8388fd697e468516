"""String and regex expressions over Columns: titles, labels, tokens, cleaning, statistics, markup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in a title, in running text, and in a topic label.
TITLE_STOPWORDS = "the and for from with that this are was were been have has had not but can will may use its our all new".split()
TEXT_STOPWORDS = TITLE_STOPWORDS + "also than more which their other these some such into they between most about".split()
TOPIC_STOPWORDS = "about across after among analysis approach based between case data design effects example from future method methods model models paper research results study studies using with".split()
#: Section words, and the expressions for a document's sections.
SECTION_MARKERS = r"(?i)\b(abstract|introduction|methods?|methodology|results?|discussion|conclusion|references|bibliography)\b"
SECTIONS = {
    "abstract": r"(?is)\babstract\b[:\s]*\n?(.+?)(?=\n\n|\n[A-Z]|\n\d\.|$)",
    "introduction": r"(?is)\b(?:1\.?\s*)?introduction\b[:\s]*\n?(.+?)(?=\n\n[A-Z]|\n2\.|$)",
    "methodology": r"(?is)\b(?:method(?:ology|s)?|research (?:design|method))\b[:\s]*\n?(.+?)(?=\n\n[A-Z]|\n\d\.|$)",
    "results": r"(?is)\b(?:results?|findings?)\b[:\s]*\n?(.+?)(?=\n\n[A-Z]|\n\d\.|$)",
    "discussion": r"(?is)\bdiscussion\b[:\s]*\n?(.+?)(?=\n\n[A-Z]|\n\d\.|$)",
    "conclusion": r"(?is)\bconclusions?\b[:\s]*\n?(.+?)(?=\n\n[A-Z]|\nreferences|$)",
    "references": r"(?is)\breferences\b[:\s]*\n?(.+?)$",
}
CUT_MARK = "\n\n[... content truncated ...]\n\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Runs of characters that are no white space; null as none."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def normalize_title(title: Column | str) -> Column:
    """Lower case, no punctuation, single spaces."""
    return squeeze(F.regexp_replace(F.lower(F.trim(col(title))), r"[^\p{L}\p{N}_\s]", ""))


def without(tokens: Column, stop: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(stop))


def title_tokens(title: Column | str) -> Column:
    """Distinct significant words of a title."""
    return F.array_distinct(without(F.filter(words(normalize_title(F.coalesce(col(title), F.lit("")))), lambda w: F.length(w) > 2), TITLE_STOPWORDS))


def text_tokens(text: Column | str) -> Column:
    """Distinct words of three letters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))
    return F.array_distinct(without(found, TEXT_STOPWORDS))


def topic_tokens(text: Column | str, min_len: int = 3) -> Column:
    """ASCII words in order, repeats kept."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("[A-Za-z0-9]{3,}"), F.lit(0))
    return without(F.filter(F.transform(found, F.lower), lambda w: F.length(w) >= min_len), TOPIC_STOPWORDS)


def normalize_label(label: Column | str) -> Column:
    return F.lower(squeeze(label))


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(part: Column | str, whole: Column | str) -> Column:
    part, whole = col(part), col(whole)
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def clean_text(text: Column | str, min_line: int = 10, markdown: bool = False) -> Column:
    """Joins hyphenated lines, drops page numbers, running heads and short lines, collapses blanks. Null as empty."""
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    t = F.regexp_replace(t, r"(?m)^\s*\d+\s*$", "")
    if not markdown:
        t = F.regexp_replace(t, r"(?im)^.{0,80}(page \d+|^\d+$).{0,80}$", "")
    t = F.regexp_replace(F.regexp_replace(t, " {2,}", " "), "\n{3,}", "\n\n")
    if not markdown:
        t = F.array_join(F.filter(F.split(t, "\n"), lambda x: (F.length(F.trim(x)) >= min_line) | (F.trim(x) == "")), "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def text_stats(text: Column | str) -> Column:
    """Characters, words, lines, page marks (one page without), mean length of lines that are not blank."""
    t = F.coalesce(col(text), F.lit(""))
    lines = F.split(t, "\n")
    full = F.filter(lines, lambda x: F.trim(x) != "")
    pages = F.regexp_count(t, F.lit(r"--- Page \d+ ---"))
    total = F.aggregate(full, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return F.struct(
        F.length(t).cast("long").alias("char_count"),
        word_count(t).cast("long").alias("word_count"),
        F.size(lines).cast("long").alias("line_count"),
        F.greatest(pages, F.lit(1)).cast("long").alias("page_count"),
        F.when(F.size(full) > 0, total / F.size(full)).otherwise(F.lit(0.0)).alias("avg_line_length"),
    )


def is_valid_extraction(text: Column | str, min_words: int = 100) -> Column:
    return word_count(text) >= min_words


def section_marker_count(text: Column | str) -> Column:
    """Distinct section words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(SECTION_MARKERS), F.lit(1))
    return F.size(F.array_distinct(found))


def extract_sections(text: Column | str, min_chars: int = 50) -> Column:
    """Section name -> content, those longer than min_chars."""
    pairs = [e for name, p in SECTIONS.items() for e in (F.lit(name), F.trim(F.regexp_extract(F.coalesce(col(text), F.lit("")), p, 1)))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.length(v) > min_chars)


def truncate_middle(text: Column | str, most: int = 3_000_000, start: int = 20_000, end: int = 10_000) -> Column:
    """Keeps the start, a centred middle and the end of texts longer than `most`."""
    t = col(text)
    middle = most - start - end - 100
    head, tail = F.substring(t, 1, start), F.right(t, F.lit(end))
    parts = [head, F.lit(CUT_MARK)]
    if middle > 0:
        parts += [F.substr(t, F.floor(F.length(t) / 2).cast("int") - middle // 2 + 1, F.lit(middle)), F.lit(CUT_MARK)]
    return F.when(F.length(t) <= most, t).otherwise(F.concat(*parts, tail))


def truncate_at_word(text: Column | str, tokens: int = 512) -> Column:
    """At most four characters a token; cut at the last space if that lies in the last fifth."""
    t, most = col(text), tokens * 4
    cut = F.substring(t, 1, most)
    gap = F.instr(F.reverse(cut), " ")
    at = F.when(gap > 0, F.lit(most) - gap).otherwise(F.lit(-1))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.when(at > most * 0.8, F.substr(t, F.lit(1), at)).otherwise(cut), F.lit("...")))


def quality_rating(prose: Column | str) -> Column:
    """An explicit rating, else the first rung of the keyword ladder that fits; 3 without any, 0 for no prose."""
    low = F.lower(col(prose))
    given = r"(\d)\s*/\s*5|(?:rat(?:ed?|ing)|score)[:\s]+(\d)"
    first, second = F.regexp_extract(low, given, 1), F.regexp_extract(low, given, 2)
    ladder = ((5, "excellent|outstanding|exceptional"), (4, "strong|high quality|rigorous|well-designed"), (2, "weak|poor|limited|significant flaws"), (1, "very weak|fundamentally flawed"))
    out = F.when(F.coalesce(col(prose), F.lit("")) == "", 0).when(low.rlike(given), F.coalesce(F.nullif(first, F.lit("")), second).cast("int"))
    for rating, any_of in ladder:
        out = out.when(low.rlike(any_of), rating)
    return out.otherwise(3)


def keyword_context(text: Column | str, needle: str, chars: int = 400, most: int = 10) -> Column:
    """Literal search without case: array of (start, end, context), hits that do not overlap, in order."""
    t = col(text)
    parts = F.split(F.lower(t), "\\Q" + needle.lower() + "\\E")
    size = len(needle)
    start = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p) + size) - size)
    hits = F.when(F.size(parts) > 1, F.slice(start, 1, most)).otherwise(F.array().cast("array<int>"))
    return F.transform(hits, lambda s: F.struct(s.alias("start"), (s + size).alias("end"), F.substr(t, F.greatest(s - chars, F.lit(0)) + 1, F.least(s, F.lit(chars)) + size + chars).alias("context")))


def escape_html(text: Column | str) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, col(text))


def highlight(text: Column | str, query: str) -> Column:
    """Escapes the text and marks the query's words of three letters or more, longest first."""
    import re

    terms = sorted(set(re.findall(r"\w{3,}", query.lower())), key=lambda w: (-len(w), w))
    safe = escape_html(text)
    return F.regexp_replace(safe, r"(?i)\b(" + "|".join(map(re.escape, terms)) + r")\b", "<mark>$1</mark>") if terms else safe


def slug(text: Column | str, most: int = 50) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(text))), r"[^a-z0-9\s_-]", ""), r"[\s_-]+", "_")
    return F.regexp_replace(F.substring(s, 1, most), "^_+|_+$", "")


def score_quality(text: Column | str) -> Column:
    """Weight of an answer by sentences, numbers and citations; half for short ones."""
    t = F.coalesce(col(text), F.lit(""))
    n = F.size(F.filter(F.split(t, "[.!?]+"), lambda s: F.trim(s) != ""))
    base = F.when(n.between(2, 5), 0.3).when(n == 1, 0.15).when(n > 5, 0.2).otherwise(0.0)
    numbers = F.least(F.regexp_count(t, F.lit(r"\b\d+(?:\.\d+)?%?\b")) * 0.05, F.lit(0.2))
    cites = F.least(F.regexp_count(t, F.lit(r"\([A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\)")) * 0.1, F.lit(0.3))
    return F.when(t == "", 0.0).otherwise(F.least((base + numbers + cites) * F.when(F.length(t) < 50, 0.5).otherwise(1.0), F.lit(1.0)))


def first_sentence_with(text: Column | str, word: Column | str, most: int = 200) -> Column:
    """The first sentence that holds the word; null if there is none."""
    hit = F.filter(F.split(col(text), r"\."), lambda s: F.contains(F.lower(s), F.lower(col(word))))
    return F.substring(F.concat(F.trim(F.get(hit, F.lit(0))), F.lit(".")), 1, most)


def strip_fence(text: Column | str) -> Column:
    """Without the code fence around a reply."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


#: Characters that each format wants escaped.
BIBTEX_ESCAPES = (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"))
MARKDOWN_ESCAPES = tuple((c, "\\" + c) for c in "\\`*_[]")


def escape(text: Column | str, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, col(text))


def csv_guard(value: Column | str) -> Column:
    """No spreadsheet formulas: a quote before values that begin like one."""
    v = col(value)
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


#: Elements that hold no reading text, and those that begin a line.
UNREAD = "script|style|noscript|svg"
FRAME = "nav|header|footer|aside|form"
BLOCKS = "p|div|section|article|main|br|h[1-6]|li|tr"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_to_text(html: Column | str) -> Column:
    """Reading text of a page: no comments, scripts, frame or tags; block elements begin lines; common entities decoded."""
    t = F.coalesce(col(html), F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    for names in (UNREAD, FRAME):
        t = F.regexp_replace(t, rf"(?is)<(?:{names})[^>]*>.*?</(?:{names})>", " ")
    t = F.regexp_replace(t, rf"(?i)<(?:{BLOCKS})[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, t)
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\n\\s*\n\\s*\n+", "\n\n"), "(?i)Page saved with SingleFile", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def preprint_html_to_text(html: Column | str) -> Column:
    """The simpler reading of preprint pages: frame elements one by one, paragraphs kept apart."""
    t = F.coalesce(col(html), F.lit(""))
    for name in ("script", "style", "nav", "header", "footer"):
        t = F.regexp_replace(t, rf"(?is)<{name}[^>]*>.*?</{name}>", " ")
    t = F.regexp_replace(t, "(?i)<(?:p|div|br|h[1-6]|li|tr)[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), (ENTITIES[-1], *ENTITIES[:-1]), t)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n\\s*\n+", "\n\n"), r"^\s+|\s+$", "")
