"""Operator 3: line-first quality rules.

Every line is judged alone. Punctuation: no end of a sentence in a line of LONG_LINE words or more, a
symbol or a shouting mark after nearly each word. Navigation: menus, breadcrumbs, link lists, in English,
German, French and Spanish. Boilerplate: notices and invitations in these languages, one phrase for
every PHRASE_WORDS words or more. Besides: no letters, too few letters for its length, a line that
repeats an earlier one, one word said over and over. Failing lines go. A document
fails if the lines left hold less than KEEP_SHARE of its words or fewer than MIN_WORDS words; the base
rules (short texts, repeated 5-word windows) hold besides.

A null or empty text has no words: all counts 0, base_failed, not kept, cleaned text empty. Repeated
rows are judged one by one, texts are whole, an empty table gives an empty result, other columns stay;
output columns replace input columns of their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import bounded_batches, drop_caches

MIN_WORDS = 10
KEEP_SHARE = 0.5
#: Words from which a line must end like a sentence, and words of a line to one phrase of boilerplate.
LONG_LINE, PHRASE_WORDS = 12, 30
#: A line of more words is tested for repeated windows on arrays.
MANY_WORDS = 20_000

#: What navigation and boilerplate lines say (English, German, French, Spanish), and how sentences end.
NAVIGATION = (
    "home menu search login register next previous prev back top contact about share tweet print sitemap faq help "
    "startseite menü suche anmelden registrieren weiter zurück kontakt impressum hilfe teilen drucken "
    "accueil recherche connexion inscription suivant précédent retour partager imprimer aide "
    "inicio buscar entrar registrarse siguiente anterior volver contacto compartir imprimir ayuda"
)
NAVIGATION_PHRASES = (
    "log in|sign in|sign up|skip to content|skip to main content|contact us|about us|nach oben|über uns|plan du site|"
    "à propos|haut de page|se connecter|mapa del sitio|quiénes somos|iniciar sesión"
)
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|terms and conditions|subscribe to our|sign up for our newsletter|click here|enable javascript|javascript is disabled|powered by|copyright ©|copyright (c)|lorem ipsum|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|newsletter abonnieren|hier klicken|cookies zu|javascript aktivieren|"
    "tous droits réservés|politique de confidentialité|conditions d'utilisation|mentions légales|abonnez-vous|cliquez ici|utilise des cookies|activer javascript|"
    "todos los derechos reservados|política de privacidad|política de cookies|términos y condiciones|aviso legal|suscríbete|haga clic aquí|utiliza cookies|habilitar javascript"
)
ENDS = ".!?…:;。！？；：।؟\"'»”’)]}"
SYMBOLS = b"#*$%&|<>"

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_bad_lines long, kept_words long, kept boolean, clean_text string"



def _choice(phrases: list[str]) -> str:
    return "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True))


_navigation = re.compile(r"(?i)\W*(?:(?:" + _choice([*NAVIGATION.split(), *NAVIGATION_PHRASES.split("|")]) + r")\b\W*)+").fullmatch
_navigation_starts = {re.match(r"\w*", p)[0] for p in (*NAVIGATION.split(), *NAVIGATION_PHRASES.split("|"))}
_first_word = re.compile(r"\W*(\w*)").match


@lru_cache(1)
def phrase_scan():
    import ahocorasick

    scan = ahocorasick.Automaton()
    for p in BOILERPLATE.split("|"):
        scan.add_word(p, p)
    scan.make_automaton()
    return scan.iter


_not_symbols = bytes(b for b in range(256) if b not in SYMBOLS)
_continuing = bytes(range(128, 192))
_ascii_space = bytes([9, 10, 11, 12, 13, 32])


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 5-word windows that the text holds twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    if len(words) <= MANY_WORDS:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        seen = set(windows)
        if len(seen) == n:
            return 0
        first: dict[tuple, int] = {}
        again = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                again[i] = again[j] = 1
        hit = np.frombuffer(again, np.uint8)
    else:  # exact ranks of growing windows, without tuples
        number: dict[bytes, int] = {}
        one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        rank, m = one, len(number)
        for k in range(1, 5):
            _, rank = np.unique(rank[: len(words) - k] * m + one[k:], return_inverse=True)
        counts = np.bincount(rank)
        hit = (counts[rank] > 1).astype(np.uint8)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[5 : n + 5] -= hit
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def bad_line(line: str, raw: bytes, words: list[bytes], phrases: bool = True) -> bool:
    """A line that has words: does it fail a rule? phrases: its text may hold phrases of boilerplate."""
    n = len(words)
    marks = len(raw.translate(None, _not_symbols))
    if 2 * marks >= n and marks >= 3:  # symbols in every second word
        return True
    if n >= 6 and 2 * raw.count(b"!") >= n:  # shouting
        return True
    if n >= 10 and len(set(words)) * 4 < n:  # the same few words over and over
        return True
    if not any(map(str.isalpha, line)):
        return True
    if n >= 3 and 3 * sum(map(str.isalpha, line)) < len(line):
        return True
    if n >= 4 and raw.count(b"|") + raw.count(b">") + raw.count("»".encode()) + raw.count("•".encode()) >= n // 3 >= 1:
        return True
    if n >= 4 and raw.count(b"http") * 2 >= n:
        return True
    if n >= LONG_LINE and line.rstrip()[-1] not in ENDS:
        return True
    if _first_word(line)[1].lower() in _navigation_starts and _navigation(line):
        return True
    return phrases and sum(1 for _ in phrase_scan()(line.lower())) * PHRASE_WORDS >= n


def judge(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _ascii_space)) - len(raw.translate(None, bytes(b for b in range(256) if b not in _continuing)))
    symbols = len(raw.translate(None, _not_symbols))
    dup = bad = lines = kept_words = 0
    seen: set[bytes] = set()
    clean = []
    phrases = next(phrase_scan()((text or "").lower()), None) is not None
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            clean.append(line)
            continue
        lines += 1
        if line in seen:
            dup += 1
            bad += 1
            continue
        seen.add(line)
        if bad_line(line.decode("utf-8", "replace"), line, own, phrases):
            bad += 1
            continue
        kept_words += len(own)
        clean.append(line)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > 20 * n
    kept = not failed and kept_words >= MIN_WORDS and kept_words >= KEEP_SHARE * n
    return n, chars, symbols, dup, repeat, failed, lines, bad, kept_words, kept, b"\n".join(clean).decode("utf-8", "replace")


def quality_column(text: Column, with_text: bool = True) -> Column:
    """A struct of RESULT's fields; clean_text is null unless with_text."""

    @F.arrow_udf(RESULT)
    def rules(texts):
        import pyarrow as pa

        drop_caches()
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        schema = [pa.field(n, kinds[k]) for n, k in (f.split(" ") for f in RESULT.split(", "))]
        rows = [judge(t.as_py()) for t in texts]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        if not with_text:
            columns[-1] = [None] * len(rows)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], fields=schema)

    return rules(text)


def apply_quality_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with RESULT's columns: counts, verdict and the text without its failing lines."""
    bounded_batches(df.sparkSession)
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    judged = df.withColumn("__q", quality_column(F.col(text_col)))
    return judged.withColumns({n: F.col("__q")[n] for n in names}).drop("__q")


def quality_report(docs: DataFrame) -> DataFrame:
    judged = docs.select("doc_id", quality_column(F.col("text"), with_text=False).alias("q"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "kept_words"]
    return judged.select("doc_id", *[F.col("q")[n].alias(n) for n in names])
