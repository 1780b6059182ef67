"""Text rules of result tables: labels, terms, sample sizes, what tells a spread from an error, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.columns import once

# What says that a spread is an error or an interval, a visit or a change, and that (..) holds an SD.
ERROR_OR_INTERVAL = r"(?iU)(?:\b(?:s\s*[\W_]*e\s*[\W_]*m|s\s*[\W_]*e|c\s*[\W_]*i)(?:[\W_]*s)?\b|\b(?:standard|std)\s*[\W_]*(?:error|errors|err|errs)\b|\bconfidence\s*[\W_]*intervals?\b)"
#: Letters (and what equals them but for case) of which every match of ERROR_OR_INTERVAL has one: told faster.
IN_ERRORS = "[eEiI\u0130\u0131]"
ENDPOINT = r"(?iU)\b(?:baseline|pre[- ]?(?:treatment|intervention)|change\s+from\s+baseline|change|delta|post[- ]?(?:treatment|intervention)|follow[- ]?up)\b"
TIMEPOINT = r"(?iU)\b(?:week|weeks|month|months|day|days|hour|hours|year|years|visit|timepoint|time\s*point|endpoint)\s*[-+]?\s*\d*\b"
SD_DECLARED = r"(?iU)mean\s*s?\s*\(\s*(?:sd|standard\s+deviations?)\s*\)"
# Doses at the end of an arm's label.
DOSE = r"(?i)\s+(?:\d+(?:\.\d+)?\s*(?:mg|g|kg|μg|mcg)(?:\s*/\s*(?:kg|day|d))?\s*)+$"


def term_key(text: Column) -> Column:
    """Lower case, dashes alike, n = ... left out, runs of anything but word characters as one blank, trimmed."""

    def key(low: Column) -> Column:
        sized = F.regexp_replace(F.translate(low, "−–", "--"), r"(?U)\bn\s*=\s*\d+\b", "")
        return F.trim(F.regexp_replace(F.when(F.contains(low, F.lit("=")), sized).otherwise(low), r"(?U)[^\w]+", " "))

    # Most texts are one word of a-z and digits, which stands as it is.
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.when(low.rlike(r"^[a-z0-9]*\z"), low).otherwise(key(low)))


def holds(key: Column, term: Column) -> Column:
    """Whether the words of ``term`` stand in ``key`` side by side (both by :func:`term_key`); an empty one never does."""
    return (term != "") & F.contains(padded(key), padded(term))


def padded(key: Column) -> Column:
    """A key between blanks: of two such the one with the words of the other contains it."""
    return F.concat(F.lit(" "), key, F.lit(" "))


def bare(text: Column) -> Column:
    """The text with what is in brackets left out."""
    return F.regexp_replace(text, r"[\(\[][^\)\]]*[\)\]]", " ")


def term_fits(descriptor: Column, term: Column) -> Column:
    """Whether a descriptor holds a term, or is it where both stand without brackets. The shorter never fits the longer."""
    left = term_key(bare(descriptor))
    return holds(term_key(descriptor), term_key(term)) | ((left != "") & (left == term_key(bare(term))))


def keyed_term(term: Column) -> Column:
    """struct(term, key, bare) of a term: its key between blanks, and its key without brackets."""
    return F.struct(term.alias("term"), padded(term_key(term)).alias("key"), term_key(bare(term)).alias("bare"))


def terms_fit(descriptor: Column, terms: Column) -> Column:
    """Those of a list of terms (see :func:`keyed_term`) that fit (see :func:`term_fits`)."""
    fits = lambda d, t: ((F.trim(t["key"]) != "") & F.contains(d["key"], t["key"])) | ((d["bare"] != "") & (d["bare"] == t["bare"]))
    return once(keyed_term(descriptor), lambda d: F.filter(terms, lambda t: fits(d, t)))


def sample_size(text: Column) -> Column:
    """struct(said, n) of the first ``n =``: whether there is one, and its number; null where that isn't a whole one."""
    at = F.regexp_instr(text, F.lit(r"(?iU)\bn\s*="))
    rest = F.substring(text, at, F.length(text))
    token = F.regexp_extract(rest, r"(?iU)^n\s*=\s*([+-]?\d[\d.,]*)(?![\w.,'’]|\s*(?:\d|['’]))", 1)
    return F.struct((at > 0).alias("said"), F.when((at > 0) & token.rlike(r"^[+-]?\d+$"), token.try_cast("long")).alias("n"))


def any_matches(texts: Column, pattern: str) -> Column:
    """Whether any of an array of texts matches."""
    return F.coalesce(F.exists(texts, lambda t: t.rlike(pattern)), F.lit(False))


def tells_error(texts: Column) -> Column:
    """Whether any of an array of texts speaks of standard errors or intervals."""
    return F.coalesce(F.exists(texts, lambda t: t.rlike(IN_ERRORS) & t.rlike(ERROR_OR_INTERVAL)), F.lit(False))


def first_word(text: Column) -> Column:
    """The first run of a-z and digits, in lower case; empty without."""
    return F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), "[a-z0-9]+", 0)


def has_word(text: Column, word: Column) -> Column:
    """Whether a text has ``word`` (a-z and digits), between other characters."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", " "), F.lit(" "))
    return (word != "") & F.contains(spaced, F.concat(F.lit(" "), word, F.lit(" ")))


def label_aliases(label: Column, described: Column) -> Column:
    """What a header may call an arm, each once: its label, without brackets, without doses, its description, and the
    beginnings of its first word, from two letters on."""
    plain = F.trim(F.regexp_replace(label, r"\s*\([^)]*\)", ""))
    said = F.when(F.trim(described) != "", described)
    whole = once(plain, lambda p: F.filter(F.array(label, p, F.trim(F.regexp_replace(p, DOSE, "")), said), lambda x: x != ""))
    none = F.array().cast("array<string>")
    starts = once(F.regexp_extract(label, "^[A-Za-z]+", 0), lambda w: F.when(F.length(w) >= 2, F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: F.substring(w, F.lit(1), i))).otherwise(none))
    return F.array_distinct(F.concat(whole, starts))


def all_texts(table: dict[str, Column]) -> Column:
    """All texts of a table (caption, notes, columns, rows) as one array."""
    return F.concat(F.array(table["caption"]), table["notes"], table["columns"], F.flatten(table["rows"]))


