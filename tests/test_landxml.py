"""LandXML written and read back: the same rings and triangles, points shared, documents well formed."""

import datetime as dt
import glob
import xml.etree.ElementTree as ET

from cadastre.sources import landxml

NS = "{http://www.landxml.org/schema/LandXML-1.2}"
PARCELS = "survey string, parcel int, name string, area double, description string, ring array<struct<x:double,y:double>>"
FACES = "survey string, surface string, ring array<struct<x:double,y:double,z:double>>"
SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
NEXT = [(10.0, 10.0), (20.1234567, 10.0), (20.0, 0.0), (10.0, 0.0)]  # clockwise and open


def surveys(spark):
    parcels = [("a", 1, 'Lot "1" & <2>', 2.5, "north of <Elm> & 5th", SQUARE), ("a", 2, "Lot 2", None, None, NEXT), ("b", 1, None, None, None, SQUARE), ("b", 2, "no ring", None, None, None), ("b", 3, "a line", None, None, SQUARE[:2])]
    faces = [("a", "ground", [(0.0, 0.0, 1.0), (10.0, 0.0, 2.0), (0.0, 10.0, 3.5)]), ("a", "ground", [(10.0, 0.0, 2.0), (10.0, 10.0, 1.0), (0.0, 10.0, 3.5)]), ("a", "roof", [(0.0, 0.0, 9.0), (1.0, 0.0, 9.0), (0.0, 1.0, 9.0)]), ("c", "alone", [(0.0, 0.0, 9.0), (1.0, 0.0, 9.0), (0.0, 1.0, 9.0)])]
    return spark.createDataFrame(parcels, PARCELS), spark.createDataFrame(faces, FACES)


def test_round_trip(spark, tmp_path):
    parcels, faces = surveys(spark)
    landxml.write_landxml(f"{tmp_path}/out", parcels, faces, 32614, dt.datetime(2024, 5, 1, 12, 0, 0))
    files = sorted(glob.glob(f"{tmp_path}/out/survey=*/*.txt"))
    assert len(files) == 3
    root = ET.parse(files[0]).getroot()
    points = root.findall(f"{NS}CgPoints/{NS}CgPoint")
    assert [p.get("name") for p in points] == [f"P{i}" for i in range(1, 7)] and points[1].text == "0.000000 10.000000 0.000000"  # two corners are shared
    assert [p.get("name") for p in root.findall(f"{NS}Parcels/{NS}Parcel")] == ['Lot "1" & <2>', "Lot 2"] and root.get("date") == "2024-05-01"
    assert [len(s.findall(f".//{NS}P")) for s in root.iter(f"{NS}Surface")] == [4, 3]
    back = landxml.read_landxml(spark, f"{tmp_path}/out")
    got = {(r.file.split("survey=")[1][0], r.name): r for r in back.parcels.collect()}
    assert set(got) == {("a", 'Lot "1" & <2>'), ("a", "Lot 2"), ("b", None)}
    one, two = got["a", 'Lot "1" & <2>'], got["a", "Lot 2"]
    assert one.ring == SQUARE and (one.area, one.description, one.epsg) == (2.5, "north of <Elm> & 5th", 32614)
    assert two.ring == [(10.0, 10.0), (10.0, 0.0), (20.0, 0.0), (20.123457, 10.0), (10.0, 10.0)]
    read = sorted((r.surface, sorted(tuple(p) for p in r.ring[:3]), r.ring[0] == r.ring[3]) for r in back.faces.collect())
    assert read == sorted((r.surface, sorted(tuple(p) for p in r.ring), True) for r in faces.collect())


def test_read_files_of_others(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        """<?xml version="1.0"?><LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2"><Surfaces>
<Surface name="s"><Definition><Pnts><P id="1">0 0 5</P><P id="2">0 10 5</P><P id="3">10 0 6</P><P id="3">10 1 7</P><P id="4">5 5</P><P id="5">a b c</P></Pnts>
<Faces><F>1 2 3</F><F i="1">1  2\n3 9</F><F>1 2 4</F><F>1 2</F></Faces></Definition></Surface>
<Surface name="s"><Definition><Pnts><P id="1">0 0 50</P><P id="2">0 10 50</P><P id="3">10 0 60</P></Pnts><Faces><F>3 2 1</F></Faces></Definition></Surface><Surface name="none"/></Surfaces>
<Parcels><Parcel name="A"><CoordGeom><Line><Start pntRef="1">0 0</Start><End>0 10</End></Line><Line><Start>0 10 5</Start><End>10 10</End></Line><Curve/><Line><Start>10 10</Start><End>10 0</End></Line></CoordGeom></Parcel>
<Parcel name="two"><CoordGeom><Line><Start>0 0</Start><End>0 10</End></Line></CoordGeom></Parcel><Parcel name="bare"/></Parcels></LandXML>"""
    )
    back = landxml.read_landxml(spark, str(tmp_path), 2277)
    (only,) = back.parcels.collect()
    assert (only.name, only.epsg) == ("A", 2277) and only.ring == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    got = sorted((r.face, r.ring[0].z, [(p.x, p.y, p.z) for p in r.ring]) for r in back.faces.collect())
    a, b, c = (0.0, 0.0, 5.0), (10.0, 0.0, 5.0), (1.0, 10.0, 7.0)
    assert got == [(0, 5.0, [a, b, c, a]), (0, 60.0, [(0.0, 10.0, 60.0), (10.0, 0.0, 50.0), (0.0, 0.0, 50.0), (0.0, 10.0, 60.0)]), (1, 5.0, [a, b, c, a])]


def test_no_surveys(spark, tmp_path):
    parcels, _ = surveys(spark)
    assert landxml.landxml_lines(parcels.where("false")).isEmpty()
    landxml.write_landxml(f"{tmp_path}/out", parcels.where("survey = 'b'"))
    back = landxml.read_landxml(spark, f"{tmp_path}/out")
    assert [r.epsg for r in back.parcels.collect()] == [None] and back.faces.isEmpty()


def test_surfaces_of_one_name_and_points(spark, tmp_path):
    surface = '<Surface name="same"><Definition surfType="TIN"><Pnts><P id="a">0 0 1</P><P id="b">0 9 2</P><P id="c">9 0 3</P><P id="a">5 5 5</P><P>7 7 7</P></Pnts><Faces><F n="1">{}</F></Faces></Definition></Surface>'
    (tmp_path / "two.xml").write_text("<LandXML><Surfaces>" + surface.format("a b c") + surface.format(" c  b a ") + surface.format("a b x") + "</Surfaces></LandXML>")
    found = landxml.read_landxml(spark, str(tmp_path)).faces.collect()
    assert sorted([p.z for p in r.ring] for r in found) == [[3.0, 2.0, 5.0, 3.0], [5.0, 2.0, 3.0, 5.0]]


def test_packed_files(spark, tmp_path):
    corner = lambda x, y: {"x": x, "y": y}
    parcels = spark.createDataFrame([(1, 1, "a", [corner(0.0, 0.0), corner(5.0, 0.0), corner(5.0, 5.0)])], "survey int, parcel int, name string, ring array<struct<x:double,y:double>>")
    landxml.write_landxml(f"{tmp_path}/out", parcels, compression="gzip")
    assert list(tmp_path.glob("out/survey=1/*.gz")) and landxml.read_landxml(spark, f"{tmp_path}/out").parcels.first().name == "a"


def test_surfaces_are_read_as_text_unless_they_have_escapes(spark, tmp_path):
    """Points and faces meet in a surface's task, without arrays that Spark's reader copies; escapes in a surface are kept."""
    of = lambda points, faces: f'<?xml version="1.0"?><LandXML><Surfaces><Surface name="A &amp; B"><Definition>{points}{faces}<Other><P id="b">0 0 0</P><F>a b c</F></Other></Definition></Surface></Surfaces><Parcels><Parcel name="Lot &lt;1&gt;"/></Parcels></LandXML>'
    points = '<Pnts><P id="{0}">1 2 3</P><P id=" b ">4.5d 5e1 6 7</P><P>8 8 8</P><P id="c"> 7\n 8   Infinity </P><P id="{0}x">x 1 2</P><P id="d"/></Pnts>'
    faces = "<Faces><F>{0} b c</F><F/><F i='0'>{0} b {0}x</F><F>c  b\n {0} late</F></Faces><Pnts><P id='late'>9 9 9</P></Pnts>"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.xml").write_text(of(points, faces.replace("'", '"')).replace("{0}", "a"))
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "y.xml").write_text(of(points, faces).replace("{0}", "&lt;a&amp;"))
    (tmp_path / "odd" / "z.xml").write_text(of(points, faces.replace("'", '"').replace("<F>{0} b c</F>", "<F><![CDATA[<&a b c]]></F>")).replace("{0}", "&lt;&amp;a"))
    a, b, c, late = (2.0, 1.0, 3.0), (50.0, 4.5, 6.0), (8.0, 7.0, float("inf")), (9.0, 9.0, 9.0)
    want = [(0, [a, b, c, a]), (3, [c, b, a, late, c])]
    for folder, files in (("plain", ["x.xml"]), ("odd", ["y.xml", "z.xml"])):
        found = landxml.read_landxml(spark, str(tmp_path / folder)).faces
        got = sorted((r.file.rsplit("/", 1)[-1], r.surface, r.face, [(p.x, p.y, p.z) for p in r.ring]) for r in found.collect())
        assert got == [(f, "A & B", n, ring) for f in files for n, ring in want]
        assert ("Window" in found._jdf.queryExecution().executedPlan().toString()) == (folder == "odd")
    assert landxml.read_landxml(spark, str(tmp_path)).faces.count() == 6
