"""Parsers on literal payloads."""

from kpiforge.plans.q_sources import parse_wrapped_json, wrapped_json
from kpiforge.sources.parsers import geojson_features, listing_cards


def test_geojson_features(spark):
    good = """{
  "type": "FeatureCollection",
  "features": [
    {"type": "Feature", "properties": {"name": "Hawke's Bay", "id": 6}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [1, 2]]]}},
    {"type": "Feature", "properties": {"name": "Bay-of-Plenty"}, "geometry": null}
  ]
}"""
    df = spark.createDataFrame([("a", good), ("b", "{broken"), ("c", '{"type": "Feature"}'), ("d", None)], "file string, value string")
    rows = geojson_features(df).collect()
    assert [(r.file, r.feature_no, r["name"], r.region_code, r.geometry_type, r.coordinates) for r in rows] == [
        ("a", 0, "Hawke's Bay", "HAWKES BAY", "Polygon", "[[[1,2],[3,4],[1,2]]]"), ("a", 1, "Bay-of-Plenty", "BAY_OF_PLE", None, None)]
    assert rows[0].properties["id"] == "6"


def test_listing_cards(spark):
    page = """<div data-testid="listing-card"><a href="/1"> Villa <b>one</b></a><span class="price">$1</span><p data-testid="address">Road 1</p></div>
<div data-testid="listing-card"><a href="/2"></a><span data-testid="price">By negotiation</span></div>
<div data-testid="listing-card"><p class="address">no title, no price</p></div>
<div class="listing-card"><a href="/x">other mark</a></div>"""
    old = '<li class="listing-card"><a class="listing-title" href="/9">Flat</a></li>' * 3
    df = spark.createDataFrame([(1, page), (2, old), (3, "<p>none</p>"), (4, None)], "page_id long, html string")
    got = [tuple(r) for r in listing_cards(df, cap=3).orderBy("page_id", "card_no").collect()]
    assert got == [(1, 1, "Villa one", "/1", "$1", "Road 1"), (1, 2, "", "/2", "By negotiation", ""),
                   (2, 1, "Flat", "/9", "", ""), (2, 2, "Flat", "/9", "", ""), (2, 3, "Flat", "/9", "", "")]


def test_indented_wrapped_json(spark, tmp_path):
    """Indented files count; contract files do not."""
    (tmp_path / "world_bank_gdp.json").write_text('{\n  "metadata": {"source": "s", "record_count": 2},\n  "data": [\n    {"year": "2000", "value": "1.5"},\n    {"year": "x", "value": null}\n  ]\n}')
    (tmp_path / "world_bank_gdp_contract.json").write_text('{"metadata": {"source": "c"}, "data": [{"year": "1", "value": "1"}]}')
    rows = parse_wrapped_json(wrapped_json(spark, str(tmp_path))).orderBy("year").collect()
    assert [(r.indicator, r.source, r.record_count, r.year, r.value) for r in rows] == [("gdp", "s", 2, None, None), ("gdp", "s", 2, 2000, 1.5)]
