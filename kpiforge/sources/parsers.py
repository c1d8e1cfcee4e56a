"""Parsers of landed payloads, as functions from DataFrame to DataFrame.

Each takes the landed text (one document a row) and gives rows; broken
documents give none. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How listing cards and their parts are marked, in order of preference.
CARD_MARKS = ['data-testid="listing-card"', 'class="tms-qa-property-listing-card"', 'class="listing-card"']
PRICE_MARKS = ['data-testid="price"', 'class="price"']
ADDRESS_MARKS = ['data-testid="address"', 'class="address"']
CARD_CAP = 50

GEOJSON = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson_features(docs: DataFrame, text: str = "value", name: str = "name") -> DataFrame:
    """The columns of docs but ``text``, and for each feature of a
    FeatureCollection its place, name, region code (upper case, no
    apostrophes, '-' to '_', 10 characters), geometry type, coordinates
    (JSON) and properties."""
    keep = [c for c in docs.columns if c != text]
    doc = F.from_json(text, GEOJSON)
    rows = docs.select(*keep, doc.alias("_d")).filter(F.col("_d.type") == "FeatureCollection").select(*keep, F.posexplode("_d.features").alias("feature_no", "_f"))
    label = F.col("_f.properties")[name]
    code = F.substring(F.regexp_replace(F.regexp_replace(F.upper(label), "'", ""), "-", "_"), 1, 10)
    return rows.select(*keep, "feature_no", label.alias("name"), code.alias("region_code"), F.col("_f.geometry.type").alias("geometry_type"),
                       F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.properties").alias("properties"))


def _inner(html: Column, marks: list[str]) -> Column:
    """Text of the first element that has one of the marks, tags taken out."""
    found = [F.regexp_extract(html, f"(?s)<(\\w+)[^>]*{m}[^>]*>(.*?)</\\1>", 2) for m in marks]
    texts = [F.trim(F.regexp_replace(x, "<[^>]*>", "")) for x in found]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def listing_cards(pages: DataFrame, html: str = "html", cap: int = CARD_CAP) -> DataFrame:
    """The columns of pages but ``html``, and for each of the first
    ``cap`` cards of a page its number, title and url (of the first link),
    price and address. Cards without both title and price are dropped. A
    page's cards carry the first of CARD_MARKS that occurs in it."""
    keep = [c for c in pages.columns if c != html]
    cards = F.lit(None).cast("array<string>")
    for mark in reversed(CARD_MARKS):
        parts = F.split(html, f"<\\w+[^>]*{mark}[^>]*>")
        cards = F.when(F.contains(F.col(html), F.lit(mark)), F.slice(parts, 2, cap)).otherwise(cards)
    rows = pages.select(*keep, F.posexplode(cards).alias("_n", "_c"))
    rows = rows.withColumn("_c", F.regexp_replace("_c", f"(?s)<\\w+[^>]*(?:{'|'.join(CARD_MARKS)}).*$", ""))     # a card of another mark ends it
    link = "(?s)<a\\b([^>]*)>(.*?)</a>"
    title = F.trim(F.regexp_replace(F.regexp_extract("_c", link, 2), "<[^>]*>", ""))
    url = F.trim(F.regexp_extract(F.regexp_extract("_c", link, 1), 'href="([^"]*)"', 1))
    out = rows.select(*keep, (F.col("_n") + 1).alias("card_no"), title.alias("title"), url.alias("url"),
                      _inner(F.col("_c"), PRICE_MARKS).alias("price"), _inner(F.col("_c"), ADDRESS_MARKS).alias("address"))
    return out.filter((F.col("title") != "") | (F.col("price") != ""))
