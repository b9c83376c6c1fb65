"""Recorded source pages as DataFrames: registry studies, literature searches, article XML, news feeds.

Schemas are declared, so fields that must not be kept (contacts, officials) are
never read, and a malformed page becomes a row with nulls rather than an error.
All readers return the record columns: source, source_record_id, record_type,
title, abstract, published_at, content_hash.
"""

from __future__ import annotations

import base64
import importlib
import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulsegrid.functions.text import bound, clean_text, clip, normalize_date, normalize_doi, valid_url

STUDIES = """studies ARRAY<STRUCT<protocolSection STRUCT<
  identificationModule STRUCT<nctId STRING, briefTitle STRING, officialTitle STRING>,
  statusModule STRUCT<overallStatus STRING, startDateStruct STRUCT<date STRING>, lastUpdatePostDateStruct STRUCT<date STRING>>,
  sponsorCollaboratorsModule STRUCT<leadSponsor STRUCT<name STRING>, collaborators ARRAY<STRUCT<name STRING>>>,
  descriptionModule STRUCT<briefSummary STRING>, conditionsModule STRUCT<conditions ARRAY<STRING>>,
  designModule STRUCT<phases ARRAY<STRING>, enrollmentInfo STRUCT<count INT>>,
  contactsLocationsModule STRUCT<locations ARRAY<STRUCT<country STRING>>>>>>, nextPageToken STRING"""
RESULTS = """hitCount INT, nextCursorMark STRING, resultList STRUCT<result ARRAY<STRUCT<id STRING, source STRING, doi STRING, title STRING,
  authorString STRING, pubYear STRING, abstractText STRING, citedByCount INT, firstPublicationDate STRING>>>"""
ARTICLE = """MedlineCitation STRUCT<PMID STRING, DateRevised STRUCT<Year STRING, Month STRING, Day STRING>,
  Article STRUCT<ArticleTitle STRING, Abstract STRUCT<AbstractText ARRAY<STRUCT<_VALUE STRING, _Label STRING>>>, Language STRING,
    AuthorList STRUCT<Author ARRAY<STRUCT<LastName STRING, ForeName STRING, CollectiveName STRING, AffiliationInfo ARRAY<STRUCT<Affiliation STRING>>>>>,
    Journal STRUCT<Title STRING, ISOAbbreviation STRING, JournalIssue STRUCT<PubDate STRUCT<Year STRING, Month STRING, Day STRING, MedlineDate STRING>>>,
    PublicationTypeList STRUCT<PublicationType ARRAY<STRING>>, ArticleDate ARRAY<STRUCT<_DateType STRING, Year STRING, Month STRING, Day STRING>>>,
  MeshHeadingList STRUCT<MeshHeading ARRAY<STRUCT<DescriptorName STRING>>>, KeywordList STRUCT<Keyword ARRAY<STRING>>>,
  PubmedData STRUCT<History STRUCT<PubMedPubDate ARRAY<STRUCT<_PubStatus STRING, Year STRING, Month STRING, Day STRING>>>, ArticleIdList STRUCT<ArticleId ARRAY<STRUCT<_VALUE STRING, _IdType STRING>>>>"""
#: An item of RSS or an entry of Atom.
ITEM = """title STRING, link ARRAY<STRUCT<_VALUE STRING, _href STRING>>, description STRING, summary STRING, content STRING, pubDate STRING, published STRING, updated STRING,
  guid STRUCT<_VALUE STRING>, id STRING, category ARRAY<STRUCT<_VALUE STRING, _term STRING>>"""
#: Characters kept of an abstract, and MeSH terms of an article.
MOST_CHARS, MOST_TERMS = 20_000, 30


def content_hash(*cols: Column) -> Column:
    """sha256 of the fields with white space collapsed; the time of fetching is no part of it."""
    one = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.sha2(F.concat_ws("\x1f", *[one(c) for c in cols]), 256)


def _records(df: DataFrame, source: str, kind: str, *more: str) -> DataFrame:
    title, abstract = clean_text(F.col("title")), clip(clean_text(F.col("abstract")), MOST_CHARS)
    return df.where("source_record_id is not null").select(F.lit(source).alias("source"), "source_record_id", F.lit(kind).alias("record_type"), title.alias("title"), abstract.alias("abstract"), "published_at", content_hash(F.lit(source), F.col("source_record_id"), title, abstract).alias("content_hash"), *more)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded pages, one whole file in each row, as column ``page``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("page"), F.col("_metadata.file_path").alias("at"))


def clinical_trials(pages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Registry pages (column ``page``); also sponsor, collaborators, phase, status, enrollment, countries (distinct, sorted).

    With a window, studies last updated in [start, end) only.
    """
    p = pages.select(F.explode(F.from_json("page", STUDIES)["studies"]["protocolSection"]).alias("s"))
    flat = p.select(
        F.col("s.identificationModule.nctId").alias("source_record_id"),
        F.coalesce("s.identificationModule.briefTitle", "s.identificationModule.officialTitle").alias("title"),
        F.col("s.descriptionModule.briefSummary").alias("abstract"),
        normalize_date(F.col("s.statusModule.lastUpdatePostDateStruct.date")).alias("published_at"),
        normalize_date(F.col("s.statusModule.startDateStruct.date")).alias("started_at"),
        F.col("s.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        F.col("s.sponsorCollaboratorsModule.collaborators.name").alias("collaborators"),
        F.col("s.conditionsModule.conditions").alias("conditions"),
        F.array_join("s.designModule.phases", "/").alias("phase"),
        F.col("s.statusModule.overallStatus").alias("status"),
        F.col("s.designModule.enrollmentInfo.count").alias("enrollment"),
        F.array_sort(F.array_distinct(F.col("s.contactsLocationsModule.locations.country"))).alias("countries"),
    )
    if start and end:
        flat = flat.where((F.col("published_at") >= start) & (F.col("published_at") < end))
    return _records(flat, "clinical_trials", "clinical_trial", "started_at", "sponsor", "collaborators", "conditions", "phase", "status", "enrollment", "countries")


def next_cursor(pages: DataFrame, sent: str = "sent") -> DataFrame:
    """``pages`` with next: the cursor of the page that follows, null where paging stops: an empty page, or a cursor that does not move."""
    body = F.from_json("page", "nextPageToken STRING, nextCursorMark STRING, studies ARRAY<STRING>, resultList STRUCT<result ARRAY<STRING>>")
    told = F.coalesce(body["nextPageToken"], body["nextCursorMark"])
    some = F.coalesce(F.size(body["studies"]), F.lit(0)) + F.coalesce(F.size(body["resultList"]["result"]), F.lit(0)) > 0
    return pages.withColumn("next", F.when(some & (told != "") & (told != F.coalesce(F.col(sent), F.lit("*"))), told))


def literature(pages: DataFrame, preprints_only: bool = False) -> DataFrame:
    """Search pages of a literature index; also doi, authors, citations, preprint. What the article source has is left out if asked for."""
    r = pages.select(F.explode(F.from_json("page", RESULTS)["resultList"]["result"]).alias("r"))
    if preprints_only:
        r = r.where(F.upper("r.source") == "PPR")
    key = F.when(F.col("r.id").isNotNull(), F.concat_ws(":", F.nullif(F.upper(F.trim("r.source")), F.lit("")), "r.id"))
    flat = r.select(key.alias("source_record_id"), F.col("r.title").alias("title"), F.col("r.abstractText").alias("abstract"), normalize_date(F.coalesce("r.firstPublicationDate", "r.pubYear")).alias("published_at"), normalize_doi(F.col("r.doi")).alias("doi"), F.filter(F.transform(F.split(F.regexp_replace("r.authorString", r"\.$", ""), ","), lambda a: F.trim(a)), lambda a: a != "").alias("authors"), F.col("r.citedByCount").alias("citations"), (F.upper("r.source") == "PPR").alias("preprint"))
    return _records(flat, "literature", "publication", "doi", "authors", "citations", "preprint")


def dated(part: Column) -> Column:
    """(date, precision) of Year, Month and Day, or of a MedlineDate: day, month or year, as far as it goes."""
    get = lambda n: F.nullif(F.trim(part[n]), F.lit(""))
    plain = normalize_date(F.when(get("Month").rlike("^[0-9]+$"), F.concat_ws("-", get("Year"), get("Month"), get("Day"))).otherwise(F.concat_ws(" ", get("Year"), get("Month"), get("Day"))))
    precision = F.when(get("Month").isNotNull() & get("Day").isNotNull(), "day").when(get("Month").isNotNull(), "month").otherwise("year")
    return F.struct(F.when(get("Year").isNotNull(), plain).alias("date"), F.when(get("Year").isNotNull() & plain.isNotNull(), precision).alias("precision"))


def medline(text: Column) -> Column:
    day = normalize_date(text)
    return F.struct(day.alias("date"), F.when(day.isNotNull(), F.when(F.trim(text).rlike(r"^[0-9]{4}\s+[A-Za-z]"), "month").otherwise("year")).alias("precision"))


def choose_date(electronic: Column, issue: Column, precision: Column, entered: Column) -> Column:
    """The electronic date; an issue date of at least a month; the day the record was entered; a year alone comes last, or January would gather all of them."""
    return F.coalesce(electronic, F.when(precision.isin("day", "month"), issue), entered, issue)


def articles(pages: DataFrame) -> DataFrame:
    """Articles (column ``page``: one PubmedArticle element each): the chosen date, authors, affiliations, MeSH terms, identifiers."""
    # read once: below a generator the parse is not repeated for every field
    a = pages.select(F.explode(F.array(F.from_xml("page", ARTICLE))).alias("x")).select(F.col("x.MedlineCitation").alias("c"), F.col("x.MedlineCitation.Article").alias("a"), F.col("x.PubmedData").alias("p"))
    a = a.withColumn("pub", F.col("a.Journal.JournalIssue.PubDate"))
    issue_part = F.col("pub")
    issue = F.when(F.trim(issue_part["MedlineDate"]) != "", medline(issue_part["MedlineDate"])).otherwise(dated(issue_part))
    numeric = lambda d: dated(F.struct(d["Year"].alias("Year"), d["Month"].alias("Month"), d["Day"].alias("Day")))["date"]
    first = lambda items, test: F.get(F.filter(items, test), F.lit(0))
    online = first(F.col("a.ArticleDate"), lambda d: F.coalesce(d["_DateType"], F.lit("Electronic")) == "Electronic")
    history = F.col("p.History.PubMedPubDate")
    entered = F.coalesce(first(history, lambda d: d["_PubStatus"] == "entrez"), first(history, lambda d: d["_PubStatus"] == "pubmed"))
    identifier = lambda kind: F.trim(first(F.col("p.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == kind)["_VALUE"])
    person = lambda n: F.coalesce(n["CollectiveName"], F.nullif(F.concat_ws(" ", n["ForeName"], n["LastName"]), F.lit("")))
    some = lambda items: F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    parts = F.transform("a.Abstract.AbstractText", lambda t: F.concat_ws(": ", t["_Label"], t["_VALUE"]))
    parts_of_date = F.struct(numeric(online).alias("online"), issue.alias("issue"), numeric(entered).alias("entered"))
    dates = bound(parts_of_date, lambda x: F.struct(choose_date(x["online"], x["issue"]["date"], x["issue"]["precision"], x["entered"]).alias("day"), x["issue"]["precision"].alias("precision")))
    fields = F.struct(
        F.col("c.PMID").alias("source_record_id"), F.col("a.ArticleTitle").alias("title"), F.array_join(parts, " ").alias("abstract"), dates.alias("dates"), F.col("a.Journal.Title").alias("journal"),
        some(F.transform("a.AuthorList.Author", person)).alias("authors"), some(F.flatten(F.transform("a.AuthorList.Author", lambda n: F.coalesce(n["AffiliationInfo"]["Affiliation"], F.array())))).alias("affiliations"),
        F.slice(some(F.col("c.MeshHeadingList.MeshHeading.DescriptorName")), 1, MOST_TERMS).alias("mesh_terms"), normalize_doi(identifier("doi")).alias("doi"), identifier("pmc").alias("pmcid"),
    )
    # and so are all fields, below a generator of their own
    flat = a.select(F.explode(F.array(fields)).alias("r")).select("r.*").withColumns({"published_at": F.col("dates.day"), "precision": F.col("dates.precision")})
    return _records(flat, "articles", "publication", "precision", "journal", "authors", "affiliations", "mesh_terms", "doi", "pmcid")


def split_elements(df: DataFrame, column: str, tag: str) -> DataFrame:
    """A row for each ``tag`` element in a column of XML, as column ``page``; the other columns stay."""
    found = F.regexp_extract_all(F.col(column), F.lit(rf"(?s)(<{tag}[\s>].*?</{tag}>)"), F.lit(1))
    return df.withColumn("page", F.explode(found))


def feed(items: DataFrame, start: str, end: str) -> DataFrame:
    """RSS items or Atom entries (columns ``page``, ``feed``) dated in [start, end); undated ones and those without a title are left out.

    The id is a hash of the feed and the item's own key.
    """
    i = items.select("feed", F.explode(F.array(F.from_xml("page", ITEM))).alias("i")).select("feed", "i.*")
    link = F.coalesce(F.get("link", F.lit(0))["_href"], F.get("link", F.lit(0))["_VALUE"])
    moment = lambda c: F.coalesce(normalize_date(F.regexp_extract(c, r"([0-9]{1,2} [A-Za-z]{3,9} [0-9]{4})", 1)), normalize_date(c))
    day = F.coalesce(moment(F.col("pubDate")), moment(F.col("published")), moment(F.col("updated")))
    key = F.coalesce("guid._VALUE", "id", link, F.concat_ws("|", "title", "pubDate"))
    tags = F.filter(F.transform("category", lambda c: F.coalesce(c["_term"], c["_VALUE"])), lambda t: t.isNotNull())
    flat = i.select(F.substring(F.sha2(F.concat_ws("\n", "feed", key), 256), 1, 40).alias("source_record_id"), "title", F.coalesce("description", "summary", "content").alias("abstract"), day.alias("published_at"), F.when(valid_url(link), link).alias("link"), tags.alias("tags"))
    return _records(flat.where((F.col("published_at") >= start) & (F.col("published_at") < end) & F.col("title").isNotNull()), "feed", "announcement", "link", "tags")


#: Kinds of sources by name, as a lookup for what is configured.
REGISTRY = {"clinical_trials": clinical_trials, "literature": literature, "articles": articles, "feed": feed}


def adapter(name: str):
    """The reader of a source by its name."""
    if name not in REGISTRY:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


class _Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PagedSource(DataSource):
    """A paged collection: a window of days cut into slices, one task each, paged inside the task.

    Options: ``start`` and ``end`` (days as numbers), ``slice`` (days in one),
    ``pages``: what fetches a page, (first, last, page) -> rows or None, as
    ``module:function`` or as ``packed`` gives it. It is found in the worker that reads.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "day int, item string"

    def reader(self, schema):
        return _PagedReader(self.options)


def packed(fetch) -> str:
    """A function of any module or none as an option's text."""
    from pyspark import cloudpickle

    return "packed:" + base64.b64encode(cloudpickle.dumps(fetch)).decode()


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.start, self.end, self.step = (int(options[k]) for k in ("start", "end", "slice"))
        self.pages = options["pages"]

    def partitions(self):
        return [_Slice(d, min(d + self.step, self.end)) for d in range(self.start, self.end, self.step)]

    def read(self, partition):
        where, _, what = self.pages.partition(":")
        fetch = pickle.loads(base64.b64decode(what)) if where == "packed" else getattr(importlib.import_module(where), what)
        page = 0
        while (rows := fetch(partition.first, partition.last, page)) is not None:
            yield from rows
            page += 1
