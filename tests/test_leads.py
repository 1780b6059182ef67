"""Lead accounting on small logs: leads over records, ledgers by record, fallbacks, runs without events."""

import json

from veritally.operators import leads


def told(*urls):
    return "Links: " + json.dumps([{"title": "t", "url": u} for u in urls])


PUBMED, EUROPE, BOTH = "https://pubmed.ncbi.nlm.nih.gov/123456/", "https://europepmc.org/abstract/med/123456", "https://x.org/10.1000/abc?u=PMC77777"
EVENTS = "run int, seq int, tool string, kind string, query string, url string, returned string"


def accounts(spark, events, ledger, runs):
    frames = (spark.createDataFrame(events, EVENTS), spark.createDataFrame(ledger, "run int, address string, disposition string"), spark.createDataFrame(runs, "run int, inventory_empty boolean"))
    found, problems = leads.lead_accounts(*frames)
    summary = {r["run"]: r.asDict() for r in leads.lead_summary(*frames, found, problems).collect()}
    return {(r["run"], r["address"]): r.asDict() for r in found.collect()}, {(r["run"], r["code"], r["address"]) for r in problems.collect()}, summary


def test_leads(spark):
    events = [
        (1, 0, "WebSearch", "request", "a  Query", None, told(PUBMED, "https://doi.org/10.1000/abc", "https://plain.org/x/", "ftp://no.org")),
        (1, 1, "WebFetch", "error", None, EUROPE, ""),
        (1, 2, "WebFetch", "request", None, BOTH, "text"),
        (1, 3, "WebFetch", "wall", None, "http://www.plain.org/x#top", None),
        (1, 4, "WebSearch", "request", "A query", None, "none"),
        (2, 0, "WebSearch", "error", " ", None, told(PUBMED)),
        (2, 1, "WebFetch", "request", None, "https://own.org/", ""),
    ]
    ledger = [(1, "https://www.ncbi.nlm.nih.gov/pubmed/123456", "opened"), (1, "https://plain.org/x", "not_opened_off_topic"), (1, "https://nowhere.org/", "opened"), (1, None, "opened"), (3, "gone", "opened")]
    found, problems, summary = accounts(spark, events, ledger, [(1, True), (2, True), (3, False)])
    assert set(found) == {(1, PUBMED), (1, "https://doi.org/10.1000/abc"), (1, "https://plain.org/x/"), (2, "https://own.org/")}
    assert [found[1, PUBMED][c] for c in ("outcome", "via", "ids", "rows")] == ["blocked", None, 1, 1]
    assert [found[1, "https://doi.org/10.1000/abc"][c] for c in ("outcome", "via", "ids", "rows")] == ["content", "mirror_same_record", 2, 0]
    assert [found[2, "https://own.org/"][c] for c in ("outcome", "via", "from_search")] == ["content", "model_chosen_address", False]
    assert problems == {
        (1, leads.UNACCOUNTED, "https://doi.org/10.1000/abc"),
        (1, leads.NO_FALLBACK, "https://plain.org/x/"),
        (1, leads.SAYS_UNOPENED, "https://plain.org/x/"),
        (1, leads.UNKNOWN_ADDRESS, "https://nowhere.org/"),
        (1, leads.UNKNOWN_ADDRESS, ""),
        (2, leads.NO_PAGE, ""),
        (3, leads.NO_PAGE, ""),
        (3, leads.UNKNOWN_ADDRESS, "gone"),
    }
    assert summary[1]["searches"] == 2 and summary[1]["distinct_queries"] == 1 and summary[1]["fetches_with_content"] == 1 and summary[1]["leads_blocked"] == 2
    assert summary[3]["searches"] == 0 and summary[3]["ledger_rows"] == 1 and not any(s["satisfied"] for s in summary.values())


def test_satisfied(spark):
    events = [(1, 0, "WebSearch", "request", "q", None, told(PUBMED)), (1, 1, "WebFetch", "request", None, PUBMED, "page")]
    found, problems, summary = accounts(spark, events, [(1, PUBMED, "opened")], [(1, True)])
    assert found[1, PUBMED]["via"] == "listed_address" and not problems and summary[1]["satisfied"] and summary[1]["problems"] == ""


def test_an_address_is_read_once(spark):
    """Rows keep their number, nulls and copies; key and ids are those of each row's own address, told once for all its rows."""
    urls = [PUBMED, EUROPE, None, PUBMED, "no address", BOTH, PUBMED, ""]
    rows = spark.createDataFrame([*enumerate(urls)], "row int, url string")
    each = rows.withColumns({"key": leads.address_key(rows.url), "ids": leads.address_ids(rows.url)})
    plain = lambda df: sorted((r["row"], r["url"], r["key"], tuple(r["ids"] or ())) for r in df.collect())
    got = leads.told(rows, "url")
    assert plain(got) == plain(each)
    read = [f for f in got.inputFiles() if "told-addresses" in f]
    assert read and spark.read.parquet(*read).count() == len(set(urls))
