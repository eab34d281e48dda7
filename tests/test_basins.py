import json
import math
import random

import pytest

from riverlake.operators import basins
from riverlake.session import scratch_dir
from riverlake.sources.basins import read_basins, write_basins

CELL_KM2 = 12_364.0


def square(x, y, size):
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


def document(*geometries):
    features = [{"type": "Feature", "properties": {}, "geometry": g} for g in geometries]
    return json.dumps({"type": "FeatureCollection", "features": features})


def table(spark, **documents):
    return spark.createDataFrame(list(documents.items()), "site_no string, document string")


def area(spark, text):
    return basins.basin_areas(table(spark, a=text)).first().nldi_area_km2


def test_square(spark):
    assert area(spark, document(polygon(square(0, 0, 1)))) == pytest.approx(12_363.718, abs=0.001)


def test_direction_does_not_matter(spark):
    assert area(spark, document(polygon(square(0, 0, 1)[::-1]))) == pytest.approx(CELL_KM2, abs=1)


def test_hole_is_taken_off(spark):
    found = area(spark, document(polygon(square(0, 0, 2), square(0.5, 0.5, 1))))
    assert found == pytest.approx(3 * CELL_KM2, abs=50)


def test_parts_and_features_add_up(spark):
    many = {"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(5, 0, 1)]]}
    assert area(spark, document(many)) == pytest.approx(2 * CELL_KM2, abs=10)
    both = document(many, polygon(square(9, 0, 1)))
    assert area(spark, both) == pytest.approx(3 * CELL_KM2, abs=10)


def test_less_than_three_points_have_no_area(spark):
    assert area(spark, document(polygon([[0, 0], [1, 1]]), polygon([]), polygon())) == 0.0
    assert area(spark, document()) == 0.0


def test_ring_against_plain_sum(spark):
    dice = random.Random(5)
    ring = [[dice.uniform(-90, -80), dice.uniform(38, 44), 7.0] for _ in range(40)]
    lon, lat = ([math.radians(p[k]) for p in ring] for k in (0, 1))
    total = sum((lon[(i + 1) % 40] - lon[i - 1]) * math.sin(lat[i]) for i in range(40))
    expected = abs(total) * 6_371_008.8**2 / 2 / 1e6
    assert area(spark, document(polygon(ring))) == pytest.approx(expected, rel=1e-12)


@pytest.mark.parametrize(
    "bad",
    [
        document({"type": "Point", "coordinates": [0, 0]}),
        document(polygon([[0, 0], [1], [1, 1]])),
        document({"type": "Polygon"}),
        '{"type": "FeatureCollection"}',
        "<html>",
    ],
)
def test_other_documents_fail(spark, bad):
    df = basins.basin_areas(table(spark, ok=document(polygon(square(0, 0, 1))), bad=bad))
    with pytest.raises(Exception, match="not a basin of polygons: bad"):
        df.select("site_no").collect()


def checked(spark, *rows):
    areas = spark.createDataFrame([r[:2] for r in rows], "site_no string, nldi_area_km2 double")
    known = [(r[0], r[2]) for r in rows if len(r) == 3]
    meta = spark.createDataFrame(known, "site_no string, drainage_area double")
    return {r.site_no: r for r in basins.basin_check(areas, meta).collect()}


def test_check_against_published_area(spark):
    unit = basins.SQ_MI_TO_KM2
    rows = checked(
        spark,
        ("near", 105 * unit, 100.0),
        ("low", 88 * unit, 100.0),
        ("high", 112 * unit, 100.0),
        ("unknown", 5.0),
        ("null", 5.0, None),
        ("zero", 5.0, 0.0),
        ("nothing", 0.0, 0.0),
    )
    assert {k: r.mismatch for k, r in rows.items()} == {
        "near": False,
        "low": True,
        "high": True,
        "unknown": None,
        "null": None,
        "zero": True,
        "nothing": False,
    }
    assert rows["zero"].area_ratio == math.inf and math.isnan(rows["nothing"].area_ratio)


def test_without_metadata_nothing_is_compared(spark):
    areas = spark.createDataFrame([("a", 5.0)], "site_no string, nldi_area_km2 double")
    row = basins.basin_check(areas).first()
    assert tuple(row) == ("a", 5.0, None, None, None)


def test_names_that_a_path_spells_differently(spark, tmp_path):
    names = ["b=c", "d+e f", "%41", "é"]
    for name in names:
        (tmp_path / f"{name}.geojson").write_text(document(polygon(square(0, 0, 1))))
    landed = read_basins(spark, str(tmp_path))
    out = scratch_dir(spark, "test-basins")
    write_basins(landed, out)
    for table in (landed, read_basins(spark, out)):
        assert sorted(r.site_no for r in table.collect()) == sorted(names)


def test_files_and_summary(spark, tmp_path):
    for name in ("USGS-1", "USGS-2"):
        (tmp_path / f"{name}.geojson").write_text(document(polygon(square(0, 0, 1))))
    landed = read_basins(spark, str(tmp_path))
    out = scratch_dir(spark, "test-basins")
    meta = spark.createDataFrame([("USGS-1", 4800.0)], "site_no string, drainage_area double")
    requested = spark.createDataFrame([("USGS-1",), ("USGS-2",), ("USGS-3",)], "site_no string")
    with pytest.raises(ValueError, match="1 requested sites.*missing_basins.csv"):
        basins.run_basins(requested, landed, meta, out)
    assert [r.site_no for r in basins.read_missing_basins(spark, out).collect()] == ["USGS-3"]
    again = read_basins(spark, f"{out}/basins")
    assert sorted(again.collect()) == sorted(landed.collect())
    lines = {r.value for r in spark.read.text(f"{out}/basins.csv").collect()}
    assert lines == {
        "site_no,nldi_area_km2,nwis_drainage_area_km2,area_ratio",
        "USGS-1,12363.718,12431.942,0.9945",
        "USGS-2,12363.718,,",
    }
    basins.run_basins(requested.filter("site_no <> 'USGS-3'"), landed, None, out)
