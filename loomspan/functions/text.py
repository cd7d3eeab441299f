"""Text cleaning and token extraction as column expressions (no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finance abbreviations expanded before scoring, applied in this order to lower-cased text.
ABBREVIATIONS = (
    (r"\bup\b", "up"),
    (r"\bdown\b", "down"),
    (r"\bvs\.?\b", "versus"),
    (r"\bvs\b", "versus"),
    (r"\betc\.?\b", "et cetera"),
    (r"\bapprox\.?\b", "approximately"),
    (r"\bco\.?\b", "company"),
    (r"\binc\.?\b", "incorporated"),
    (r"\bcorp\.?\b", "corporation"),
    (r"\bdept\.?\b", "department"),
    (r"\bearnings y/y\b", "earnings year over year"),
    (r"\bq/q\b", "quarter over quarter"),
    (r"\by/y\b", "year over year"),
    (r"\bq[1-4]\b", "quarter"),
    (r"\bfy\d{2,4}\b", "fiscal year"),
    (r"\bebitda\b", "earnings before interest taxes depreciation amortization"),
    (r"\bpe\b", "price earnings"),
    (r"\beps\b", "earnings per share"),
    (r"\bguidance\b", "outlook guidance"),
    (r"\bbeat\b", "exceeded expectations"),
    (r"\bmiss(?:ed)?\b", "fell short of expectations"),
    (r"\bbuyback\b", "share repurchase"),
    (r"\bdividend\b", "dividend"),
)
# Patterns of markup, links and ticker symbols.
HTML = r"<[^>]+>"
URL = r"https?://\S+|www\.\S+"
TICKER = r"[$]([A-Z]{1,5})\b"

# Word characters, digits and spaces follow Unicode, as the texts are in several languages.
UNICODE = "(?U)"


def _replace(text: Column, pattern: str, replacement: str, literals: tuple[str, ...]) -> Column:
    """regexp_replace behind a plain substring test: most texts hold none of the literals a pattern needs.

    The one-element transform names the text once, so a chain of these does not copy its input expression.
    """
    def step(t: Column) -> Column:
        found = t.contains(literals[0])
        for x in literals[1:]:
            found = found | t.contains(x)
        return F.when(found, F.regexp_replace(t, F.lit(pattern), F.lit(replacement))).otherwise(t)

    return F.element_at(F.transform(F.array(text), step), 1)


def _literal_first(pattern: str) -> tuple[str, str]:
    """(pattern, literal): a leading word boundary is moved behind the literal it precedes, which is found faster."""
    literal = re.match(r"\\b([a-z]+)", pattern).group(1)
    return pattern.replace(rf"\b{literal}", rf"{literal}(?<=\b{literal})", 1), literal


def clean_text(text: Column) -> Column:
    """Strip markup and links, unwrap $SYMBOLS, lower-case, expand abbreviations, collapse spaces; NULL -> ''."""
    out = _replace(F.coalesce(text, F.lit("")), UNICODE + HTML, " ", ("<",))
    out = _replace(out, UNICODE + URL, " ", ("://", "www."))
    out = F.lower(_replace(out, UNICODE + TICKER, "$1", ("$",)))
    for pattern, replacement in ABBREVIATIONS:
        fast, literal = _literal_first(pattern)
        if replacement != literal:
            out = _replace(out, UNICODE + fast, replacement, (literal,))
    # a lone plain space already is what a run of spaces becomes
    return F.trim(F.regexp_replace(out, F.lit(UNICODE + r"\s{2,}|[^\S ]"), F.lit(" ")))


def concat_text(headline: Column, summary: Column) -> Column:
    """Headline and summary joined by a period; NULL counts as empty."""
    empty = F.lit("")
    return F.trim(F.concat(F.coalesce(headline, empty), F.lit(". "), F.coalesce(summary, empty)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def mood_label(score: Column, bullish: float, bearish: float) -> Column:
    return F.when(score > bullish, "Bullish").when(score < bearish, "Bearish").otherwise("Neutral")


def contains_any_case(text: Column, term: str) -> Column:
    """Whether a text holds a literal term, whatever the case of either; NULL for NULL."""
    return F.contains(F.lower(text), F.lit(term.lower()))
