import json

import pytest

from riverlake.functions.guards import require_rows
from riverlake.operators import sites
from riverlake.plans.loading import load_metadata
from riverlake.session import scratch_dir
from riverlake.sources.metadata import read_metadata, write_metadata
from riverlake.sources.pages import read_metadata_pages
from tests.helpers import readings


def series(site, code="00060", name="Discharge", **more):
    fields = {"monitoring_location_id": site, "parameter_code": code, "parameter_name": name}
    return {"properties": fields | more}


def landed(spark, path, *pages):
    for i, features in enumerate(pages):
        (path / f"page-{i}.json").write_text(json.dumps({"features": features, "links": []}))
    return read_metadata_pages(spark, str(path))


@pytest.fixture
def pages(spark, tmp_path):
    return landed(
        spark,
        tmp_path,
        [
            series("B", monitoring_location_name="Beta", drainage_area=12.0, state_name="Ohio",
                   county_name="Lucas", hydrologic_unit_code="0410", statistic_id="00003",
                   begin="2000-01-01T00:00:00", end="2020-01-01T00:00:00", primary="Primary"),
            series("A", monitoring_location_name="Alpha", drainage_area=2.5),
        ],
        [
            series("B", code="00065", name="Gage height", monitoring_location_name="Other"),
            series("B", name=None),
            series("C", code=None, name=None),
        ],
    )


def test_one_row_per_site_in_order_of_appearance(spark, pages):
    rows = sites.site_metadata(sites.metadata_rows(pages)).collect()
    assert [r.site_no for r in rows] == ["B", "A", "C"]
    beta, alpha, gamma = rows
    assert (beta.name, alpha.name, gamma.name) == ("Beta", "Alpha", "")
    assert [s.parameter_code for s in beta.series] == ["00060", "00065"]
    assert (len(alpha.series), gamma.series) == (1, [])
    assert (beta.drainage_area, beta.altitude, alpha.state_name) == (12.0, None, None)


def test_third_row_without_a_name_adds_no_series(spark, tmp_path):
    pages = landed(spark, tmp_path, [series("A"), series("B"), series("A", name=None)])
    rows = sites.site_metadata(sites.metadata_rows(pages)).collect()
    assert [(r.site_no, len(r.series)) for r in rows] == [("A", 1), ("B", 1)]


def test_flat_form_holds_the_same(spark, pages):
    flat = sites.site_series(sites.metadata_rows(pages)).collect()
    assert sorted((r.site_no, r.parameter_code) for r in flat if r.parameter_code) == [
        ("A", "00060"),
        ("B", "00060"),
        ("B", "00065"),
    ]
    assert {r.name for r in flat if r.site_no == "B"} == {"Beta"}
    assert [r.parameter_code for r in flat if r.site_no == "C"] == [None]


def test_parameter_filter(spark, pages):
    rows = sites.site_metadata(sites.metadata_rows(pages, "00065")).collect()
    assert [(r.site_no, r.name) for r in rows] == [("B", "Other")]


def test_no_metadata_is_an_error(spark, pages):
    with pytest.raises(ValueError, match="no metadata"):
        require_rows(sites.metadata_rows(pages, "99999"), "no metadata")


def test_row_without_site_fails(spark, tmp_path):
    pages = landed(spark, tmp_path, [series(None)])
    (tmp_path / "other").mkdir()
    other = landed(spark, tmp_path / "other", None)
    with pytest.raises(Exception, match="without a site"):
        sites.metadata_rows(other).collect()
    with pytest.raises(Exception, match="without a site"):
        sites.metadata_rows(pages).collect()


def test_metadata_file(spark, pages, tmp_path_factory):
    path = scratch_dir(spark, "test-metadata")
    metadata = sites.site_metadata(sites.metadata_rows(pages))
    write_metadata(metadata, path)
    back = read_metadata(spark, path)
    assert sorted(back.collect(), key=str) == sorted(metadata.collect(), key=str)
    array = tmp_path_factory.mktemp("array") / "sites.json"
    array.write_text(json.dumps([r.asDict(recursive=True) for r in back.collect()], indent=2))
    assert read_metadata(spark, str(array), one_array=True).count() == 3
    assert read_metadata(spark, path + "-missing").collect() == []
    flat = sites.flatten_metadata(back).collect()
    assert sorted((r.site_no, r.place) for r in flat if r.place is not None) == [
        ("A", 0),
        ("B", 0),
        ("B", 1),
    ]


def test_report(spark, pages):
    flat = sites.site_series(sites.metadata_rows(pages))
    lines = {(r.heading, r.details, r.line) for r in sites.site_report(flat).collect()}
    assert lines == {
        (
            "B -- Beta",
            "Lucas, Ohio | drainage area: 12 sq mi | HUC 0410",
            "Discharge (00060)  stat 00003  2000-01-01 .. 2020-01-01  [Primary]",
        ),
        (
            "B -- Beta",
            "Lucas, Ohio | drainage area: 12 sq mi | HUC 0410",
            "Gage height (00065)  stat -  ? .. ?  [Provisional]",
        ),
        (
            "A -- Alpha",
            "drainage area: 2.5 sq mi",
            "Discharge (00060)  stat -  ? .. ?  [Provisional]",
        ),
        ("C -- ", "", "(no matching parameter/statistic series)"),
    }
    panel = sites.site_report(flat, unknown_date="").filter("site_no = 'A'").first()
    assert panel.line.startswith("Discharge (00060)  stat -   ..   [")


@pytest.mark.parametrize(
    "value,text",
    [(12.0, "12"), (2.5, "2.5"), (0.0, "0"), (12345678.5, "12345678.5"), (100.0, "100"), (1e7, "10000000")],
)
def test_plain_number(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(sites.plain_number(df.v)).first()[0] == text


def test_site_list_takes_independent_minima(spark):
    daily = readings(spark, [("b", "p", "2024-01-01", 1.0), ("a", "p", "2024-01-01", 1.0)])
    other = readings(spark, [("b", "p", "2024-01-01", 1.0)], "continuous")
    other = other.selectExpr("site_no", "42.0D latitude", "-86.0D longitude")
    assert [tuple(r) for r in sites.site_list(daily, other).collect()] == [
        ("a", 41.0, -85.0),
        ("b", 41.0, -86.0),
    ]


def test_geojson_features(spark):
    path = scratch_dir(spark, "test-geojson")
    df = spark.createDataFrame(
        [("a", 41.5, -85.0)], "site_no string, latitude double, longitude double"
    )
    sites.write_features(sites.sites_geojson(df), path)
    (line,) = spark.read.text(path).collect()
    assert json.loads(line.value) == {
        "type": "Feature",
        "geometry": {"type": "Point", "coordinates": [-85.0, 41.5]},
        "properties": {"site_no": "a"},
    }


def _page(*features):
    properties = [{"monitoring_location_id": site, **more} for site, more in features]
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p} for p in properties]})


def test_lines_of_a_file_have_places_of_their_own(spark, tmp_path):
    lines = [_page(("A", {"monitoring_location_name": "first"})), _page(("A", {"monitoring_location_name": "second"}))]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    rows = sites.metadata_rows(read_metadata_pages(spark, str(tmp_path), one_per_line=True))
    assert [(r.site_no, r.name) for r in sites.site_series(rows).collect()] == [("A", "first")]


def test_pages_are_in_the_order_of_their_numbers(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"page_{n}.json").write_text(_page((f"S{n}", {"monitoring_location_name": "x"}), ("A", {"monitoring_location_name": str(n)})))
    rows = sites.metadata_rows(read_metadata_pages(spark, str(tmp_path)))
    found = sites.site_metadata(rows).collect()
    assert [r.site_no for r in found] == ["S1", "A", "S2", "S10"]
    assert [r.name for r in found if r.site_no == "A"] == ["1"]


def test_metadata_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "page_1.json").write_text(_page(("A", {"parameter_code": "00060", "parameter_name": "flow"})))
    load_metadata(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [r.site_no for r in read_metadata(spark, str(tmp_path / "out")).collect()] == ["A"]
    with pytest.raises(ValueError, match="no metadata"):
        load_metadata(spark, str(tmp_path / "in"), str(tmp_path / "out2"), "99999")
