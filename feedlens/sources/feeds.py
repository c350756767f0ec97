"""Feed documents to items: RSS, RDF and Atom through one explicit schema, in which every field may repeat and carry attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import normal_text, sanitized, unwrapped_link

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string, _url: string, href: string, url: string>>"
_TEXT = "array<struct<_VALUE: string>>"
_SOURCE = "array<struct<_VALUE: string, _url: string, _href: string, text: string, name: string, title: string, url: string, href: string>>"
_TAG = "array<struct<_VALUE: string, _term: string, _label: string, _nicename: string, name: string, term: string, label: string>>"
#: The fields that hold tags, in this order.
TAG_FIELDS = ("category", "categories", "dc:subject", "dcSubject", "subject", "wp:term", "wpTerm")
_FIELDS = {
    "title": _TEXT, "link": _LINK, "links": _LINK, "atom:link": _LINK, "guid": _TEXT, "id": _TEXT, "url": _TEXT, "source": _SOURCE, **dict.fromkeys(TAG_FIELDS, _TAG),
    "pubDate": _TEXT, "published": _TEXT, "updated": _TEXT, "dc:date": _TEXT, "description": _TEXT, "summary": _TEXT, "content:encoded": _TEXT,
}
_ITEM = "array<struct<" + ", ".join(f"`{k}`: {v}" for k, v in _FIELDS.items()) + ">>"
SCHEMA = f"channel struct<item: {_ITEM}>, item {_ITEM}, entry {_ITEM}"


def accepted(landed: DataFrame, most_bytes: int = 4 << 20, most_redirects: int = 5) -> DataFrame:
    """Landed responses (xml, status, redirects) with refused: empty, or why a fetcher's limits rule the document out."""
    return landed.withColumn(
        "refused",
        F.when(F.coalesce("redirects", F.lit(0)) > most_redirects, "too_many_redirects")
        .when(~F.coalesce(F.col("status").between(200, 399), F.lit(False)), "bad_status")
        .when(F.octet_length(F.coalesce("xml", F.lit(""))) > most_bytes, "too_large")
        .otherwise(""),
    )


def _some(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _first(*columns: Column) -> Column:
    return F.coalesce(*[_some(c) for c in columns])


def _each(field: Column, take) -> Column:  # noqa: ANN001
    """What is there of the entries of a field that may be missing, in order."""
    return F.coalesce(F.array_compact(F.transform(field, take)), F.array().cast("array<string>"))


def _text(i: Column, name: str) -> Column:
    return F.get(_each(i[name], lambda e: _some(e["_VALUE"])), F.lit(0))


def _href(e: Column) -> Column:
    return _first(e["_href"], e["_url"], e["href"], e["url"])


def item_link(i: Column) -> Column:
    """The first there is of: the link's text or its alternate address, guid, id, url, and any address of a link field."""
    alternate = lambda e: F.when(F.coalesce(e["_rel"], F.lit("alternate")) == "alternate", _href(e))
    found = F.concat(
        _each(i["link"], lambda e: _some(e["_VALUE"])), _each(i["link"], alternate), *[_each(i[c], lambda e: _some(e["_VALUE"])) for c in ("guid", "id", "url")],
        *[_each(i[c], _href) for c in ("link", "links", "atom:link")],
    )
    return F.coalesce(F.get(F.filter(F.transform(found, lambda x: unwrapped_link(normal_text(x))), lambda x: x != ""), F.lit(0)), F.lit(""))


def item_source(i: Column) -> Column:
    """struct<name, url> of the first source that has either, as text, children or attributes."""
    entry = lambda e: F.struct(sanitized(_first(e["_VALUE"], e["text"], e["name"], e["title"]), numeric=False).alias("name"), F.coalesce(_first(e["url"], e["href"], e["_url"], e["_href"]), F.lit("")).alias("url"))
    usable = F.filter(F.transform(i["source"], entry), lambda e: (e["name"] != "") | (e["url"] != ""))
    return F.coalesce(F.get(usable, F.lit(0)), F.struct(F.lit("").alias("name"), F.lit("").alias("url")))


def item_tags(i: Column) -> Column:
    """The tags of all seven fields: texts, names, terms and labels, without a leading #, of 2 to 80 characters, each once."""
    parts = lambda e: F.array(e["_VALUE"], e["name"], e["term"], e["label"], e["_term"], e["_label"], e["_nicename"])
    every = F.concat(*[F.coalesce(F.flatten(F.transform(i[c], parts)), F.array().cast("array<string>")) for c in TAG_FIELDS])
    clean = F.transform(F.array_compact(every), lambda t: F.trim(F.regexp_replace(sanitized(t, numeric=False), "^#", "")))
    return F.array_distinct(F.filter(clean, lambda t: F.length(t).between(2, 80)))


def feed_items(landed: DataFrame, xml: str = "xml") -> DataFrame:
    """Landed documents (feedId, xml) to a row for each item: pos, title, link, source, sourceUrl, tags, pubDate, description.

    Items of a broken document, and of none, are none; within a document RSS items come before those of RDF and Atom.
    """
    read = landed.select("feedId", F.from_xml(xml, SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))
    none = F.array().cast(_ITEM)
    items = F.concat(*[F.coalesce(F.col(c), none) for c in ("x.channel.item", "x.item", "x.entry")])
    i = F.col("i")
    return read.select("feedId", F.posexplode(items).alias("pos", "i")).select(
        "feedId", "pos", normal_text(_text(i, "title")).alias("title"), item_link(i).alias("link"), item_source(i).alias("_s"), item_tags(i).alias("tags"),
        F.coalesce(*[_text(i, c) for c in ("pubDate", "published", "dc:date", "updated")]).alias("pubDate"), F.coalesce(*[_text(i, c) for c in ("description", "summary", "content:encoded")]).alias("description"),
    ).select("feedId", "pos", "title", "link", F.col("_s.name").alias("source"), F.col("_s.url").alias("sourceUrl"), "tags", "pubDate", "description")
