"""Rooms against a flood fill, topology with supports by hand, and building models read from files."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from girder.operators import planar, rules
from girder.sources import ifc


def walls(spark, rows):
    """(drawing, x1, y1, x2, y2) with numbers."""
    return spark.createDataFrame([(d, i, *map(float, xy), 200.0) for i, (d, *xy) in enumerate(rows)], "drawing long, seg_id long, x1 double, y1 double, x2 double, y2 double, thickness double")


def box(d, x1, y1, x2, y2):
    return [(d, x1, y1, x2, y1), (d, x2, y1, x2, y2), (d, x2, y2, x1, y2), (d, x1, y2, x1, y1)]


def flood(rows, size):
    """Areas of enclosed regions of axis-parallel walls on whole coordinates below ``size``, by walking free cells of the doubled grid."""
    out = defaultdict(list)
    for d in {r[0] for r in rows}:
        taken = set()
        for _, x1, y1, x2, y2 in (r for r in rows if r[0] == d):
            for x in range(2 * min(x1, x2), 2 * max(x1, x2) + 1):
                for y in range(2 * min(y1, y2), 2 * max(y1, y2) + 1):
                    taken.add((x, y))
        seen = set(taken)
        for start in [(-1, -1)] + [(x, y) for x in range(2 * size) for y in range(2 * size)]:
            if start in seen:
                continue
            seen.add(start)
            todo, cells = [start], 0
            while todo:
                x, y = todo.pop()
                cells += x % 2 and y % 2
                for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if p not in seen and -1 <= p[0] <= 2 * size + 1 and -1 <= p[1] <= 2 * size + 1:
                        seen.add(p)
                        todo.append(p)
            if start != (-1, -1):
                out[d].append(float(cells))
    return {d: sorted(a) for d, a in out.items()}


def test_rooms_against_flood_fill(spark):
    rng = random.Random(2)
    rows = []
    for d in range(6):
        for _ in range(12 + 6 * d):
            x, y, n = rng.randrange(15), rng.randrange(15), rng.randrange(1, 9)
            rows.append((d, x, y, min(x + n, 15), y) if rng.random() < 0.5 else (d, x, y, x, min(y + n, 15)))
    rows = [r for r in rows if r[1:3] != r[3:5]]
    got = defaultdict(list)
    for r in planar.rooms(walls(spark, rows), ["drawing"]).collect():
        got[r.drawing].append(round(r.area, 9))
    assert {d: sorted(a) for d, a in got.items()} == flood(rows, 16)


def test_rooms_nested_dangling_and_slanted(spark):
    rows = box(1, 0, 0, 10, 10) + box(1, 2, 2, 5, 5) + box(1, 3, 3, 4, 4) + [(1, 10, 5, 8, 5)]  # nested twice, one dangling wall
    rows += box(2, 0, 0, 4, 4) + [(2, 4, 2, 7, 2)] + box(2, 7, 0, 9, 4)  # two rooms tied by a wall
    rows += [(3, 0, 0, 1, 0), (3, 1, 0, 1, 1)]  # no room
    rows += box(4, 0, 0, 2, 2) + [(4, 0, 0, 2, 2), (4, 2, 0, 0, 2)]  # four triangles
    rows += box(5, 0, 0, 6, 6) + [(5, 6, 3, 4, 3)] + box(5, 2, 2, 4, 4)  # an island tied to its shell
    rows += box(6, 0, 0, 1, 1) + box(6, 0, 0, 1, 1) + [(6, 0.5, 0, 0.5, 1)]  # repeated walls
    got = defaultdict(list)
    for r in planar.rooms(walls(spark, rows), ["drawing"]).collect():
        got[r.drawing].append(round(r.area, 6))
    assert {d: sorted(a) for d, a in got.items()} == {1: [1, 8, 91], 2: [8, 16], 4: [1, 1, 1, 1], 5: [4, 32], 6: [0.5, 0.5]}
    assert planar.rooms(walls(spark, []), ["drawing"]).count() == 0


def test_rings_of_long_chains(spark):
    n = 500
    pointers = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)] + [(1000 + i, 1000 + (i + 1) % 3) for i in range(3)] + [(2000, 2000)], "h long, next long")
    assert {r.h: r.label for r in planar.rings(pointers).collect()} == {i: 0 for i in range(n)} | {1000 + i: 1000 for i in range(3)} | {2000: 2000}


def test_topology_with_support(spark):
    rows = walls(spark, [(1, 0, 0, 4, 0), (1, 4, 0, 4, 4), (1, 20, 0, 24, 0)]).withColumnRenamed("seg_id", "wall_id")
    support = walls(spark, [(1, 4, 4, 0, 4)]).withColumnRenamed("seg_id", "wall_id")
    bridges = walls(spark, [(1, 0, 4, 0, 0)]).withColumnRenamed("seg_id", "wall_id").withColumn("thickness", F.lit(None).cast("double"))
    columns = spark.createDataFrame([(1, 24.0, 0.5, 0.6, 0.6)], "drawing long, cx double, cy double, w double, d double")
    (r,) = planar.topology_with_support(rows, ["drawing"], support=support, columns=columns, bridges=bridges).collect()
    # Ends of the first two walls meet others; of the third only the one in the column's box (0.3 + 0.3 in y).
    assert (r.walls, r.support_walls, r.opening_bridges, r.connected_ends, r.fully_connected, r.rooms, r.room_area) == (3, 1, 1, 5, 2, 1, 16.0)
    assert r.endpoint_coverage == 5 / 6 and math.isclose(r.fully_connected_rate, 2 / 3)
    (alone,) = planar.topology_with_support(rows, ["drawing"]).collect()
    assert (alone.connected_ends, alone.rooms, alone.room_area) == (2, 0, 0.0)


# --- building models ---

HEAD = ["ISO-10303-21", "HEADER", "FILE_SCHEMA(('IFC4'))", "DATA"]
BODY = r"""#1=IFCBUILDINGSTOREY('s',$,'L1; (one)',$,$,#5,$,$,.ELEMENT.,1500.);
#5=IFCLOCALPLACEMENT($,#6);
#6=IFCAXIS2PLACEMENT3D(#7,#8,#9);
#7=IFCCARTESIANPOINT((10.,0.,0.));
#8=IFCDIRECTION((0.,0.,2.));
#9=IFCDIRECTION((0.,3.,0.));
#10=IFCWALLSTANDARDCASE('w1',$,'It''s \X2\5899\X0\ A',$,'type A',#11,#40,'t');
#11=IFCLOCALPLACEMENT(#5,#12);
#12=IFCAXIS2PLACEMENT3D(#13,$,#14);
#13=IFCCARTESIANPOINT((1.,2.,3.));
#14=IFCDIRECTION((1.,1.,0.));
#15=IFCOPENINGELEMENT('o1',$,$,$,$,#16,$,$,.OPENING.);
#16=IFCLOCALPLACEMENT(#11,#17);
#17=IFCAXIS2PLACEMENT3D(#18,$,$);
#18=IFCCARTESIANPOINT((1.,0.,0.));
#19=IFCRELVOIDSELEMENT('v',$,$,$,#10,#15);
#20=IFCDOOR('d1',$,'D',$,$,#16,$,$,2.1,.9,.DOOR.,.SINGLE.,$);
#21=IFCRELFILLSELEMENT('f',$,$,$,#15,#20);
#22=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,$,$,(#10,#60),#1);
#30=IFCRELDEFINESBYPROPERTIES('p',$,$,$,(#10,#20),#31);
#31=IFCPROPERTYSET('ps',$,'Pset',$,(#32,#33,#34));
#32=IFCPROPERTYSINGLEVALUE('Load',$,IFCREAL(3.),$);
#33=IFCPROPERTYSINGLEVALUE('External',$,IFCBOOLEAN(.F.),$);
#34=IFCPROPERTYSINGLEVALUE('Note',$,$,$);
#40=IFCPRODUCTDEFINITIONSHAPE($,$,(#41,#42));
#41=IFCSHAPEREPRESENTATION(#99,'Axis','Curve2D',(#98));
#42=IFCSHAPEREPRESENTATION(#99,'Body','Clipping',(#43));
#43=IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,#44,#97);
#44=IFCBOOLEANCLIPPINGRESULT(.DIFFERENCE.,#45,#96);
#45=IFCEXTRUDEDAREASOLID(#46,#12,#8,3000.);
#46=IFCRECTANGLEPROFILEDEF(.AREA.,$,$,240.,5000.);
#50=IFCRELASSOCIATESMATERIAL('m',$,$,$,(#10),#51);
#51=IFCMATERIALLIST((#53,#52,#53));
#52=IFCMATERIAL('Brick','red');
#53=IFCMATERIAL('Plaster');
#60=IFCSLAB('sl',$,'S',$,$,$,#61,$,.FLOOR.);
#61=IFCPRODUCTDEFINITIONSHAPE($,$,(#62));
#62=IFCSHAPEREPRESENTATION(#99,'Body','Brep',(#63));
#63=IFCFACETEDBREP(#64);
#64=IFCCLOSEDSHELL((#65,#66));
#65=IFCFACE((#67));
#67=IFCFACEOUTERBOUND(#68,.T.);
#68=IFCPOLYLOOP((#69,#7,#13));
#69=IFCCARTESIANPOINT((0.,0.,-120.));
#70=IFCSLAB('round',$,'R',$,$,#71,$,$,$);
#71=IFCLOCALPLACEMENT(#72,#12);
#72=IFCLOCALPLACEMENT(#71,#12);
#73=IFCRELAGGREGATES('a',$,$,$,#70,(#74));
#74=IFCSLAB('part',$,'P',$,$,#1234,$,$,$);
#75=IFCRELAGGREGATES('a',$,$,$,#74,(#70));
#80=IFCWALLTYPE('wt',$,'W',$,$,(#31),$,$,$,.STANDARD.);
END-ISO-10303-21;
"""


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ifc_file(spark, tmp_path, end):
    path = tmp_path / "model.ifc"
    path.write_bytes((";\n".join(HEAD) + ";\n" + BODY).replace("\n", end).encode())
    inst = ifc.instances(ifc.read_statements(spark, str(path)))
    found = {r.global_id: r for r in ifc.elements(inst).collect()}
    assert sorted(found) == ["d1", "o1", "part", "round", "sl", "w1"]
    w, o, d, s = found["w1"], found["o1"], found["d1"], found["sl"]
    assert (w.name, w.ifc_type, w.type, w.object_type, w.description) == ("It's 墙 A", "IFCWALLSTANDARDCASE", "墙", "type A", None)
    assert o.name == "未命名" and (d.predefined_type, o.predefined_type, s.predefined_type) == ("DOOR", "OPENING", "FLOOR")
    # The opening is in the wall and the door in the opening: both are where the wall is.
    assert {e.container.name for e in (w, o, d, s)} == {"L1; (one)"} and found["round"].container is None and found["part"].container is None
    assert tuple(w.placement) == (11.0, 2.0, 3.0) and tuple(o.placement) == (12.0, 2.0, 3.0)
    # The storey is turned by 90 degrees, the wall by another 45 on its own axis.
    assert tuple(w.origin) == (8.0, 1.0, 3.0)
    r = math.sqrt(0.5)
    assert tuple(o.origin) == (round(8 - r, 2), round(1 + r, 2), 3.0)
    assert w.psets == d.psets == {"Pset": {"Load": "3.0", "External": "False", "Note": None}} and w.quantities == {} == s.psets
    assert [tuple(m) for m in w.materials] == [("Plaster", None), ("Brick", "red"), ("Plaster", None)] and s.materials == []
    assert (w.geom_thickness, s.geom_thickness, w.geom_elevation, s.geom_elevation) == (240.0, None, None, -120.0)
    assert [e.has_geometry for e in (w, o, d, s)] == [True, False, False, True] and found["round"].placement is not None and found["part"].placement is None
    rows = {r.element_id: r for r in ifc.baseline(ifc.elements(inst)).collect()}
    assert rows["w1"].ifc_type == "IFCWALL" and rows["w1"].location == "L1; (one)"
    assert rows["w1"].properties == {"Load": "3.0", "External": "False", "Material": "Plaster", "Thickness": "240.0"}
    hits = {(r.element_id, r.rule_id) for r in rules.check_rules(ifc.baseline(ifc.elements(inst))).collect()}
    assert hits == {("o1", "HR-003"), ("round", "HR-002"), ("part", "HR-002")}


def test_ifc_chains_and_lists(spark):
    """A chain of 300 placements sums up, and an argument of 20,000 points is taken apart."""
    lines = ["#1=IFCCARTESIANPOINT((1.,0.5,0.))", "#2=IFCAXIS2PLACEMENT3D(#1,$,$)"]
    lines += [f"#{100 + i}=IFCLOCALPLACEMENT({'$' if i == 0 else f'#{99 + i}'},#2)" for i in range(300)]
    lines += ["#9=IFCBEAM('b',$,'B',$,$,#399,$,$)", "#3=IFCCARTESIANPOINTLIST3D((" + ",".join("(1.,2.,3.)" for _ in range(20_000)) + "),$)", "no instance"]
    inst = ifc.instances(spark.createDataFrame([("f", x) for x in lines] + [("g", lines[-3].replace("#399", "#100"))], "file string, statement string"))
    assert {r.id: len(r.args) for r in inst.filter("file = 'f' and id in (3, 9)").collect()} == {3: 2, 9: 8}
    found = {r.file: r for r in ifc.elements(inst).collect()}
    assert tuple(found["f"].placement) == tuple(found["f"].origin) == (300.0, 150.0, 0.0) and found["g"].placement is None
    assert ifc.elements(inst.limit(0)).count() == 0
