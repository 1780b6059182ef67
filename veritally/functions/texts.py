"""Scalar rules of texts: labels, queries, link lines, facts in prose, dates, doses and formats, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_key(label: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank, trimmed; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def query_key(query: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")))


def links(text: Column) -> Column:
    """The distinct http(s) addresses of the JSON array after ``Links:``, in order; null in an unparsable array."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^Links:\s*(\[.*\])", 1)
    urls = F.transform(F.from_json(F.nullif(line, F.lit("")), "array<struct<title:string,url:string>>"), lambda x: x["url"])
    return F.coalesce(F.array_distinct(F.filter(urls, lambda u: u.rlike(r"^https?://[\x21-\x7e]+$"))), F.array().cast("array<string>"))


def without_echo(text: Column, request: Column) -> Column:
    """The text with every verbatim copy of the request as a blank; an empty request takes nothing away."""
    return F.when(F.length(request) > 0, F.replace(text, request, F.lit(" "))).otherwise(text)


def percent_decoded(text: Column, passes: int = 3) -> Column:
    """Escapes of ASCII characters decoded, ``passes`` times; malformed ones and those from %80 on stay as they are."""

    def once(t: Column) -> Column:
        def part(p: Column) -> Column:
            code = F.conv(F.substring(p, 1, 2), 16, 10).cast("long")
            return F.when(p.rlike("^[0-7][0-9A-Fa-f]"), F.concat(F.char(code), F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p))

        parts = F.split(t, "%", -1)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), ""))

    for _ in range(passes):
        text = once(text)
    return text


def elided(text: Column, most: int, mark: str = "\n[...]\n") -> Column:
    """At most ``most`` characters of a text: its two halves around a mark, whole where it is short enough."""
    keep = most - len(mark)
    head = keep // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(keep - head))))


def snippets(text: Column, reach: int = 110, most: int = 5) -> Column:
    """Up to ``most`` windows of ``reach`` characters around a dose; windows that begin alike count once."""
    dose = rf"(?is).{{0,{reach}}}\b\d+(?:\.\d+)?\s*(?:mg|mcg|g)\b.{{0,{reach}}}"
    found = F.transform(F.regexp_extract_all(text, F.lit(dose), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    first = F.filter(found, lambda s, i: F.array_position(F.transform(found, lambda x: F.substring(x, 1, 80)), F.substring(s, 1, 80)) == i + 1)
    return F.slice(first, 1, most)


def mean_sd(cell: Column, declared: Column | None = None) -> Column:
    """struct(mean, sd) of a cell like 1.5 ± 0.2 or 1.5 +/- 0.2, or 1.5 (0.2) where ``declared`` says that it holds an SD;
    null else, for an sd that isn't above 0, and where a comma may part thousands."""
    number = r"[+-]?\d+(?:[.,]\d+)?"
    signed = rf"(?i)^\s*(?:mean\s*=\s*)?({number})\s*(?:±|\+/-|\+−)\s*(?:sd\s*=\s*)?({number})\s*(?:[a-z%]+)?\s*(?:\([^)]*\)|\[[^]]*\]|[*†‡])?\s*$"
    bracketed = rf"^\s*({number})\s*\(\s*({number})\s*\)\s*[*†‡]?\s*$"

    def value(pattern: str, i: int) -> Column:
        token = F.regexp_extract(cell, pattern, i)
        return F.when(~token.rlike(r"^[+-]?\d+,\d{3}$"), F.replace(token, F.lit(","), F.lit(".")).try_cast("double"))

    def read(pattern: str) -> Column:
        mean, sd = value(pattern, 1), value(pattern, 2)
        return F.when(cell.rlike(pattern) & mean.isNotNull() & (sd > 0), F.struct(mean.alias("mean"), sd.alias("sd")))

    told = read(signed)
    return told if declared is None else F.when(cell.rlike(signed), told).when(declared, read(bracketed))


def facts_kept(source: Column, out: Column) -> Column:
    """Whether two texts hold the same numbers, with their units of percent, and the same quoted spans, as multisets."""

    def facts(t: Column, pattern: str) -> Column:
        return F.array_sort(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(0)))

    number, quoted = r"\d+(?:\.\d+)?%?", r'"[^"]*"'
    return (facts(source, number) == facts(out, number)) & (facts(source, quoted) == facts(out, quoted))


def partial_date(text: Column) -> Column:
    """struct(day, month_only) of YYYY-MM-DD or YYYY-MM (its first day); null for anything else."""
    whole, month = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.rlike(r"^\d{4}-\d{1,2}$")
    day = F.try_to_timestamp(F.when(month, F.concat(text, F.lit("-1"))).when(whole, text), F.lit("yyyy-M-d")).cast("date")
    return F.when(day.isNotNull(), F.struct(day.alias("day"), month.alias("month_only")))


def compact_date(text: Column) -> Column:
    """The date of eight digits, else null."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def registered_before(registered: Column, start: Column) -> Column:
    """1 if registered up to the start, 0 if after; null without both, and where a start known by month leaves it open."""
    r, s = partial_date(registered), partial_date(start)
    open_ = s["month_only"] & (F.trunc(r["day"], "month") == F.trunc(s["day"], "month"))
    return F.when(r.isNull() | s.isNull() | open_, None).otherwise((r["day"] <= s["day"]).cast("int"))


def overdue_unpublished(status: Column, completion: Column, has_results: Column, has_publication: Column, today: Column, years: int = 2) -> Column:
    """Completed over ``years`` * 365 days ago, and neither results nor a publication of them."""
    done = partial_date(completion)["day"]
    late = F.coalesce(F.datediff(today, done) > years * 365, F.lit(False))
    return F.coalesce(status == "COMPLETED", F.lit(False)) & late & ~F.coalesce(has_results, F.lit(False)) & ~F.coalesce(has_publication, F.lit(False))


def attrition(started: Column, completed: Column) -> Column:
    """struct(n_started, n_completed, dropout_rate) of arrays of counts as text; only digits count, the rate to 3 digits."""

    def total(counts: Column) -> Column:
        return F.aggregate(F.filter(counts, lambda x: x.rlike(r"^\d+$")), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

    a, b = total(started), total(completed)
    return F.struct(a.alias("n_started"), b.alias("n_completed"), F.when(a > 0, F.round((a - b) / a, 3)).alias("dropout_rate"))


# Words that make an estimate a ratio.
RATIO_WORDS = ("rr", "or", "hr", "risk ratio", "odds ratio", "hazard ratio", "relative risk", "irr", "rate ratio")

# Milligrams of a unit, and the most milligrams and servings a day that are believed.
UNITS = {"mg": 1.0, "g": 1000.0, "mcg": 0.001}
MOST_MG, MOST_SERVINGS = 100_000, 24


def dose_mg(amount: Column, unit: Column) -> Column:
    """Milligrams to 6 digits; null where :func:`dose_error` tells why."""
    return F.when(dose_error(amount, unit).isNull(), _milligrams(amount, unit))


def _milligrams(amount: Column, unit: Column) -> Column:
    factor = F.when(unit == "mg", UNITS["mg"]).when(unit == "g", UNITS["g"]).when(unit == "mcg", UNITS["mcg"])
    return F.round(amount * factor, 6)


def dose_error(amount: Column, unit: Column) -> Column:
    """Why a dose is refused, null where it isn't."""
    mg = _milligrams(amount, unit)
    bad = amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount <= 0)
    return F.when(~F.coalesce(unit.isin(*UNITS), F.lit(False)), "unit").when(bad, "not_positive").when(mg > MOST_MG, "over_ceiling").when(mg <= 0, "not_positive")


def servings_error(servings: Column) -> Column:
    """Why a number of servings a day is refused, null where it isn't."""
    return F.when(servings.isNull() | (servings != F.floor(servings)) | (servings <= 0), "not_whole").when(servings > MOST_SERVINGS, "too_many")


def email_key(raw: Column) -> Column:
    """Trimmed, without mailto:, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(raw), r"(?i)^mailto:", "")))


def email_error(raw: Column) -> Column:
    """Why an address is refused, null where it isn't; the first rule that holds."""
    key = F.coalesce(email_key(raw), F.lit(""))
    local, domain = F.substring_index(key, "@", 1), F.substring_index(key, "@", -1)
    good = domain.rlike(r"^[a-z0-9.-]+$") & domain.rlike(r"\.[a-z]{2,}$") & ~domain.rlike(r"^[.-]|[.-]$|\.\.")
    signs = F.length(key) - F.length(F.replace(key, F.lit("@"), F.lit("")))
    return (
        F.when(key == "", "empty")
        .when(F.length(key) > 254, "too_long")
        .when(key.rlike(r"\s"), "has_whitespace")
        .when(signs == 0, "no_at")
        .when(signs > 1, "multiple_at")
        .when(local == "", "empty_local")
        .when(F.length(local) > 64, "local_too_long")
        .when(~good, "bad_domain")
    )


def signed(value: Column, digits: int = 3) -> Column:
    """+3, −2.5, 0 with up to ``digits`` digits; a dash for null."""
    fixed = F.regexp_replace(F.format_number(F.abs(value), digits), ",", "")
    short = F.regexp_replace(fixed, r"\.?0+$", "") if digits else fixed
    return F.when(value > 0, F.concat(F.lit("+"), short)).when(value < 0, F.concat(F.lit("−"), short)).when(value == 0, "0").otherwise("—")


def percent_text(share: Column, digits: int = 1) -> Column:
    """A share as percent; Unavailable for null."""
    return F.coalesce(F.concat(F.regexp_replace(F.format_number(100 * share, digits), ",", ""), F.lit("%")), F.lit("Unavailable"))


def dose_text(mg: Column) -> Column:
    """Milligrams as 500 mg, from 1,000 on as grams with up to two digits; a dash for null."""
    grams = F.regexp_replace(F.regexp_replace(F.format_number(mg / 1000, 2), ",", ""), r"\.?0+$", "")
    return F.coalesce(F.when(mg >= 1000, F.concat(grams, F.lit(" g"))).otherwise(F.concat(F.floor(mg + 0.5).cast("string"), F.lit(" mg"))), F.lit("—"))


def confidence_words(c: Column) -> Column:
    """Words of a confidence."""
    return F.when(c.isNull(), "no evidence mass").when(c < 0.10, "almost no evidence yet").when(c < 0.30, "very little evidence").when(c < 0.60, "some evidence").when(c < 0.85, "substantial evidence").otherwise("extensive evidence")


def dose_reading(dose: Column, low: Column, high: Column) -> Column:
    """struct(tone, text): where a dose lies against the range that worked."""
    tone = F.when(dose.isNull() | low.isNull() | high.isNull(), "unassessable").when(dose < low, "below").when(dose > high, "above").otherwise("in_range")
    span = F.concat(dose_text(low), F.lit(" to "), dose_text(high))
    text = (
        F.when(tone == "in_range", F.concat(dose_text(dose), F.lit(" lies in the range that worked, "), span))
        .when(tone == "below", F.concat(dose_text(dose), F.lit(" is less than what worked, "), span))
        .when(tone == "above", F.concat(dose_text(dose), F.lit(" is more than what worked, "), span))
        .otherwise("the dose can't be compared")
    )
    return F.struct(tone.alias("tone"), text.alias("text"))


def design_of(text: Column) -> Column:
    """Design rank from words, the first rule that fits; what denies randomisation comes before what states it."""
    t = F.lower(text)

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))

    return (
        F.when(has("non-randomis", "non-randomiz", "nonrandomis", "nonrandomiz", "quasi-experimental", "open-label trial"), 5)
        .when(has("randomis", "randomiz", "rct"), 4)
        .when(has("prospective cohort"), 6)
        .when(has("retrospective cohort"), 7)
        .when(has("case-control", "case control"), 8)
        .when(has("cross-sectional", "cross sectional"), 9)
    )


def interval_of(text: Column) -> Column:
    """struct(low, high), in order: the numbers after "95% CI" or "confidence interval", else the two at the end."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    n = r"(-?\d+(?:\.\d+)?)"
    named = rf"(?i)(?:95\s*%?\s*ci|confidence interval)\s*[:=]?\s*[\[\(]?\s*{n}\s*(?:to|,|;|–|—)\s*{n}"
    at_end = rf"{n}\s*(?:to|,|;|–|—|-)\s*{n}\s*\)?\s*$"
    a, b = (F.when(t.rlike(named), F.regexp_extract(t, named, i)).when(t.rlike(at_end), F.regexp_extract(t, at_end, i)).try_cast("double") for i in (1, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def direction_of(text: Column, polarity: Column) -> Column:
    """Direction by the interval in a text: null_effect where it spans no effect (1 of a ratio, else 0); else the
    ``polarity`` (higher_better, lower_better) decides; null where either isn't known."""
    ci, t = interval_of(text), F.lower(text)
    ratio = reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in RATIO_WORDS))
    no_effect = F.when(ratio, 1.0).otherwise(0.0)
    up = ci["low"] > no_effect
    good = F.when(polarity == "higher_better", up).when(polarity == "lower_better", ~up)
    return F.when((ci["low"] <= no_effect) & (ci["high"] >= no_effect), "null_effect").when(good, "benefit").when(~good, "harm")