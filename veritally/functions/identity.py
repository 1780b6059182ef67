"""Scalar rules of identity: registry numbers, canonical keys, addresses and the study identifiers they carry."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trial registries' numbers; a bare prefix is none.
REGISTRY = r"(?i)(NCT\d{8}|ISRCTN\d{6,8}|ChiCTR[-A-Z0-9]{6,}|CTRI/\d{4}/\d+/\d+|UMIN\d{6,9}|EudraCT[\s:-]*\d{4}-\d{6}-\d{2})"


def _folds() -> tuple[str, str, dict[str, str]]:
    """By the rule of compatibility decomposition: characters that fold to one of ASCII, these, and those to several."""
    one, to, several = [], [], {}
    for point in (*range(0x80, 0x10000), *range(0x1D400, 0x1D800)):  # the basic plane, and letters of formulas
        if 0xAC00 <= point < 0xE000:
            continue  # syllables that decompose to none of ASCII, and surrogates
        char = chr(point)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one.append(char)
            to.append(folded)
        elif folded:
            several[char] = folded
    return "".join(one), "".join(to), several


_ONE, _TO, _SEVERAL = _folds()


def ascii_fold(text: Column) -> Column:
    """Compatibility-decomposed and cut to ASCII; plain ASCII is passed on, and no row leaves the JVM."""
    wide = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")  # a constant, which is folded once
    single = F.translate(text, _ONE, _TO)
    each = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(wide, c), c)), "")
    folded = F.regexp_replace(F.when(single.rlike("[" + "".join(_SEVERAL) + "]"), each).otherwise(single), r"[^\x00-\x7F]", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def key_text(text: Column) -> Column:
    """Lower-case letters and digits alone, accents folded away; empty for null."""
    return F.regexp_replace(F.lower(ascii_fold(F.coalesce(text.cast("string"), F.lit("")))), "[^a-z0-9]", "")


def registry_id(text: Column) -> Column:
    """The registry number inside a text, as a key; null if it has none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), REGISTRY, 1)
    return F.when(found != "", key_text(found))


def canonical_id(r: dict[str, Column]) -> Column:
    """kind:id of a record by its registry number, else DOI, else PMID, else a fingerprint of what describes it.

    ``r`` names nct, doi, pmid, first_author, year, n, country, dose_text, and may name registration_id, which is read
    where nct has no registry number; empty is as good as missing.
    """
    registry = registry_id(r["nct"])
    if "registration_id" in r:
        registry = F.coalesce(registry, registry_id(r["registration_id"]))
    doi, pmid = F.nullif(r["doi"], F.lit("")), F.nullif(r["pmid"], F.lit(""))

    def number(x: Column) -> Column:
        return F.when(x != 0, x.cast("string")).otherwise("")

    fingerprint = F.concat_ws(
        "|",
        key_text(r["first_author"]),
        F.coalesce(number(r["year"]), F.lit("")),
        F.coalesce(number(r["n"]), F.lit("")),
        key_text(r["country"]),
        key_text(r["dose_text"]),
    )
    return (
        F.when(registry.isNotNull(), F.concat(F.lit("registry:"), registry))
        .when(doi.isNotNull(), F.concat(F.lit("doi:"), key_text(doi)))
        .when(pmid.isNotNull(), F.concat(F.lit("pmid:"), key_text(pmid)))
        .otherwise(F.concat(F.lit("fingerprint:"), fingerprint))
    )


# Languages that make a path's first part a locale, and parameters that say nothing of the page.
LANGUAGES = (
    "en es fr de it pt nl sv no nb da fi pl cs sk hu ro bg el tr ru uk ar he fa hi bn th vi id ms zh ja ko ca "
    "hr sr sl lt lv et is ga cy sq mk bs ur ta te ml kn mr gu pa sw af"
).split()
DROPPED = ("lang", "locale", "hl", "language", "lng", "fbclid", "gclid", "ref")
LOCALE = f"(?i)^({'|'.join(LANGUAGES)})([-_]([a-z]{{2}}|[a-z]{{4}}|[0-9]{{3}}))?$"
ADDRESS = r"(?i)^https?://([^/?#@\s]+)((?:/[^?#\s]*)?)(?:\?([^#\s]*))?(?:#[^\s]*)?$"
HOST_PORT = r"^([A-Za-z0-9.-]+)(?::([0-9]{1,5}))?$"
MOST_CHARS = 2000


def valid_address(url: Column) -> Column:
    """A plain http(s) address in printable ASCII, 8 to MOST_CHARS long."""
    # Two tests, as a repeat of at most 1000 is what other engines' expressions allow.
    return F.coalesce(url.rlike(r"^[\x21-\x7e]{8,}$") & (F.length(url) <= MOST_CHARS) & url.rlike(ADDRESS), F.lit(False))


def address_key(url: Column) -> Column:
    """What names a page however it is linked to; null for what isn't a plain address.

    Host without www. and default port, path without a leading locale and closing slashes, parameters without
    languages and tracking, sorted. Scheme and fragment don't count.
    """
    place = F.regexp_extract(url, ADDRESS, 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, HOST_PORT, 1)), r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    port = F.regexp_extract(place, HOST_PORT, 2)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+(?=[0-9])", "")))
    path = F.regexp_extract(url, ADDRESS, 2)
    parts = F.split(path, "/", -1)
    local = (F.size(parts) > 2) & (F.get(parts, F.lit(2)) != "") & F.get(parts, F.lit(1)).rlike(LOCALE)
    path = F.when(local, F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/"))).otherwise(path)
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    name = lambda p: F.lower(F.element_at(F.split(p, "=", 2), 1))
    kept = F.filter(F.split(F.regexp_extract(url, ADDRESS, 3), "&", -1), lambda p: (p != "") & ~name(p).isin(*DROPPED) & ~name(p).startswith("utm_"))
    query = F.array_join(F.array_sort(kept), "&")
    key = F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(valid_address(url) & (host != ""), key)


# Identifiers in addresses, and views of a paper that follow a DOI.
PMID_URLS = (r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/([0-9]{5,9})(?![0-9])", r"(?i)ncbi\.nlm\.nih\.gov/pubmed/([0-9]{5,9})(?![0-9])", r"(?i)europepmc\.org/(?:article|abstract)/med/([0-9]{5,9})(?![0-9])")
PMC, NCT = r"(?i)\b(PMC[0-9]{5,9})\b", r"(?i)\b(NCT[0-9]{8})\b"
DOI = r"""(?i)(10\.[0-9]{4,9}/[^\s"'<>)\]},;?#&]+)"""
VIEWS = r"^(10\.[0-9]+/.+)/(full|pdf|abstract|fulltext|epdf)$"


def address_ids(url: Column) -> Column:
    """The study identifiers that an address carries, sorted: pmid:, PMC, NCT, doi: (with and without its view)."""
    rest = F.regexp_replace(F.concat(F.regexp_extract(url, ADDRESS, 2), F.lit("?"), F.regexp_extract(url, ADDRESS, 3)), "(?i)%2f", "/")
    whole = F.concat(F.regexp_extract(url, ADDRESS, 1), rest)
    pmids = [F.transform(F.regexp_extract_all(whole, F.lit(p), F.lit(1)), lambda x: F.concat(F.lit("pmid:"), x)) for p in PMID_URLS]
    names = [F.transform(F.regexp_extract_all(whole, F.lit(p), F.lit(1)), F.upper) for p in (PMC, NCT)]
    dois = F.transform(F.regexp_extract_all(rest, F.lit(DOI), F.lit(1)), lambda d: F.lower(F.regexp_replace(d, r"\.+$", "")))
    bare = F.transform(F.filter(dois, lambda d: d.rlike(VIEWS)), lambda d: F.regexp_extract(d, VIEWS, 1))
    dois = F.transform(F.concat(dois, bare), lambda d: F.concat(F.lit("doi:"), d))
    return F.when(valid_address(url), F.array_sort(F.array_distinct(F.concat(*pmids, *names, dois)))).otherwise(F.array().cast("array<string>"))
