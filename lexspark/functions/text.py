"""Scalar text functions as columns: citations, canonical article ids, encoder inputs, terms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on.
TOKEN = r"([\p{L}\p{N}]+)"
MARKER = r"§\s*(\d+(?:\^[0-9a-z]+)*)\.\s*"
HEADING = r"(?iu)^(DZIAŁ|Rozdział|Oddział)\s+(\S+)\s*$"
LEVELS = ("dział", "rozdział", "oddział")
ARTICLE = r"^([\[<])?Art\.\s*(\d+(?:\^\[?[0-9a-ząćęłńóśźż]+\]?)*)\.\s*"
EMBEDDED_HEADING = r"(?U)(?<![\w.])Art\.\s*\d+(?:\^[0-9a-ząćęłńóśźż]+)*\."
NOT_IN_FORCE = (
    r"(?iu)^\((uchylony|uchylona|uchylone|utracił[ay]?\s+moc|utraciło\s+moc|pominięty|pominięte)\)(?:\s*\^?\d*\)?)*$"
)
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘʷˣʸᶻ"
LOWERED = "0123456789abcdefghijklmnoprstuwxyz"
#: The raised letters that citations in sources are known to use.
CITED_RAISED, CITED_LOWERED = "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉᶠᵍʰⁱ", "0123456789abcdefghi"
SENTENCE_END = r"(?<=[.;:])\s+"
CHARS_PER_TOKEN = 3.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, also where body uses it inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def terms(text: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-cased runs of letters and digits, in order, without stop words; empty for null."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1), F.array().cast("array<string>"))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def n_words(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def normalise_article(raw: Column) -> Column:
    """A citation's article in canonical form: `Art. 151¹`, `151(1)` and `151-1` are `151^1`."""
    text = F.regexp_replace(strip(raw), f"([{CITED_RAISED}]+)", r"^$1")
    text = F.translate(text, CITED_RAISED, CITED_LOWERED)
    text = F.regexp_replace(text, r"(?iU)^art\.?\s*", "")
    text = F.translate(F.regexp_replace(text, r"(?U)\s+", ""), "(-)", "^^")
    return F.regexp_replace(F.regexp_replace(text, r"\^+", "^"), r"^\^|\^$", "")


def to_display(canonical: Column) -> Column:
    """`9^1` as `Art. 9¹`."""
    parts = F.split(canonical, r"\^")
    tail = F.translate(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), ""), LOWERED, RAISED)
    return F.concat(F.lit("Art. "), parts[0], F.when(F.size(parts) > 1, tail).otherwise(""))


def sort_key(canonical: Column) -> Column:
    """Statutory order: an array of (number, letters), so that 9 < 9^1 < 10 and 94^9 < 94^10."""

    def part(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(\d*)([a-ząćęłńóśźż]*)", 1)
        return F.struct(
            F.when(digits == "", 0).otherwise(digits.cast("int")).alias("number"),
            F.regexp_extract(p, r"^(\d*)([a-ząćęłńóśźż]*)", 2).alias("letters"),
        )

    return F.transform(F.split(canonical, r"\^"), part)


def clean_id(raw: Column) -> Column:
    return F.translate(raw, "[]", "")


def strip_brackets(text: Column) -> Column:
    """Without the brackets that bound pending amendments."""
    return strip(F.translate(text, "[]<>", ""))


def repeal_kind(body: Column) -> Column:
    """Why a text is not in force, if it is nothing but that marker; else empty."""
    return F.lower(F.regexp_extract(strip(body), NOT_IN_FORCE, 1))


def citation(display: Column, paragraph: Column) -> Column:
    return F.when(paragraph != "", F.concat(display, F.lit(" § "), F.translate(paragraph, "^", ""))).otherwise(display)


def search_text(path: Column, content: Column) -> Column:
    """What is indexed: the structural path, then the content."""
    return strip(F.concat_ws(" ", F.array_join(path, " "), content))


def embedding_input(path: Column, content: Column) -> Column:
    """What the encoder gets for a passage."""
    head = F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("passage: "), head, content)


def query_input(question: Column) -> Column:
    return F.concat(F.lit("query: "), question)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")
