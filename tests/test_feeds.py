"""Readers of recorded pages, and the paged source."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from pulsegrid.sources import feeds


def test_registry_pages(spark, tmp_path):
    page = {"studies": [{"protocolSection": {
        "identificationModule": {"nctId": "N1", "briefTitle": "A <b>trial</b> &amp; more"},
        "statusModule": {"overallStatus": "RECRUITING", "lastUpdatePostDateStruct": {"date": "2026-03"}},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Acme"}, "collaborators": [{"name": "Beta"}]},
        "designModule": {"phases": ["PHASE1", "PHASE2"], "enrollmentInfo": {"count": 40}},
        "contactsLocationsModule": {"centralContacts": [{"email": "x@y.z"}], "locations": [{"country": "Spain", "contacts": [{"email": "q@y.z"}]}, {"country": "France"}, {"country": "Spain"}]}}}, {"protocolSection": {}}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    rows = feeds.clinical_trials(feeds.pages(spark, str(tmp_path))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["published_at"], r["phase"], r["countries"], r["collaborators"]) == ("A trial & more", dt.date(2026, 3, 1), "PHASE1/PHASE2", ["France", "Spain"], ["Beta"])
    assert "@" not in str(r) and len(r["content_hash"]) == 64


def test_literature_and_articles(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"resultList": {"result": [{"id": "7", "title": "<i>mRNA</i> x", "pubYear": "2024", "doi": "10.1/AB"}]}}))
    r = feeds.literature(feeds.pages(spark, str(tmp_path / "l.json"))).collect()[0]
    assert (r["title"], r["published_at"], r["doi"]) == ("mRNA x", dt.date(2024, 1, 1), "10.1/ab")
    article = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><JournalIssue><PubDate>{}</PubDate></JournalIssue></Journal>{}</Article></MedlineCitation></PubmedArticle>"
    dates = ["<Year>2024</Year><Month>Mar</Month><Day>31</Day>", "<MedlineDate>2024 Mar-Apr</MedlineDate>", "<Year>2023</Year>"]
    electronic = ["", "", "<ArticleDate><Year>2022</Year><Month>12</Month><Day>05</Day></ArticleDate>"]
    (tmp_path / "a.xml").write_text("<Set>" + "".join(article.format(i, d, e) for i, (d, e) in enumerate(zip(dates, electronic, strict=True))) + "</Set>")
    got = {r["source_record_id"]: r["published_at"] for r in feeds.articles(feeds.split_elements(feeds.pages(spark, str(tmp_path / "a.xml")), "page", "PubmedArticle")).collect()}
    assert got == {"0": dt.date(2024, 3, 31), "1": dt.date(2024, 3, 1), "2": dt.date(2022, 12, 5)}


def test_feed_window(spark, tmp_path):
    items = "".join(f"<item><title>t{d}</title><guid>g{d}</guid><pubDate>Mon, {d:02d} Jun 2026 10:00:00 GMT</pubDate></item>" for d in (1, 2, 3)) + "<item><title>undated</title></item>"
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    items = feeds.split_elements(feeds.pages(spark, str(tmp_path / "f.xml")).withColumn("feed", F.col("at")), "page", "item")
    rows = feeds.feed(items, "2026-06-01", "2026-06-03").collect()
    assert {r["title"] for r in rows} == {"t1", "t2"} and all(len(r["source_record_id"]) == 40 for r in rows)


def test_paged_source_reads_slices(spark):
    def fetch(first, last, page):
        return [(d, f"{d}-{page}") for d in range(first, last)] if page < 2 else None

    spark.dataSource.register(feeds.PagedSource)
    df = spark.read.format("paged").options(start="0", end="10", slice="4", pages=feeds.packed(fetch)).load()
    assert sorted(r["item"] for r in df.collect()) == sorted(f"{d}-{p}" for d in range(10) for p in range(2))
    assert df.rdd.getNumPartitions() == 3


def test_a_year_alone_comes_after_the_day_of_entry(spark):
    page = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><JournalIssue><PubDate>{}</PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><History><PubMedPubDate PubStatus='entrez'><Year>2024</Year><Month>5</Month><Day>7</Day></PubMedPubDate></History></PubmedData></PubmedArticle>"
    rows = [(page.format(1, "<Year>2023</Year>"),), (page.format(2, "<Year>2023</Year><Month>Nov</Month>"),), (page.format(3, "<MedlineDate>2023</MedlineDate>"),)]
    got = {r["source_record_id"]: r["published_at"] for r in feeds.articles(spark.createDataFrame(rows, "page string")).collect()}
    assert got == {"1": dt.date(2024, 5, 7), "2": dt.date(2023, 11, 1), "3": dt.date(2024, 5, 7)}


def test_atom_entries(spark):
    entry = "<entry><title>A &amp; B</title><id>urn:1</id><link href='https://x.org/a'/><updated>2026-06-01T10:00:00Z</updated><category term='news'/></entry>"
    rows = feeds.feed(spark.createDataFrame([(entry, "f")], "page string, feed string"), "2026-06-01", "2026-06-03").collect()
    assert [(r["title"], r["link"], r["tags"]) for r in rows] == [("A & B", "https://x.org/a", ["news"])]
