"""Behaviour of operators on small scenes built in metres."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions import geo, shade, shapes, tags
from pointlake.operators import cells, fit, generate, graph, ranking, raster, sequence, spatial
from pointlake.plans import corridor, ground
from pointlake.sources import scene
from pointlake.sources.ply import PlyDataSource

M = 1 / 111320


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_date_ranking_prefers_new_dots(spark):
    rows = [(d, date) for date, dots in {"2023-04": [0, 1, 2, 3], "2022-09": [0, 1, 2], "2017-09": [0, 1], "2015-12": [4, 5, 6]}.items() for d in dots]
    assert corridor.rank_dates(spark.createDataFrame(rows, "dot int, date string")) == ["2023-04", "2015-12", "2022-09", "2017-09"]


def test_bridges_join_what_is_near(spark):
    dots = spark.createDataFrame([(k, 0.0, float(y)) for k, y in enumerate([0, 10, 20, 30, 40, 50, 200])], "node long, x double, y double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5)], "a long, b long")
    assert [(r.a, r.b, r.distance) for r in graph.bridges(dots, edges, ["x", "y"], 15.0).collect()] == [(2, 3, 10.0)]
    assert graph.bridges(dots.where("node in (0, 6)"), edges.limit(0), ["x", "y"], 15.0).count() == 0


def test_folding_keeps_the_first(spark):
    rows = [("c", k, 0.0, y) for k, y in enumerate([0.0, 3.0, 20.0, 8.0, 28.1])]
    got = graph.fold_in_order(spark.createDataFrame(rows, "corridor string, seq long, x double, y double"), "seq").collect()
    assert {r.seq: r.dot for r in got} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_reaching_a_goal(spark):
    dots = spark.createDataFrame([(k, n * M, 0.0) for k, n in enumerate([0, 10, 100, 110])], "node long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    goal = lambda n: spark.createDataFrame([(n * M, 0.0)], "lat double, lon double")
    some = lambda *ks: spark.createDataFrame([(k,) for k in ks], "node long")
    assert graph.connects(dots, edges, some(2, 3), (0.0, 0.0), goal(110))
    assert not graph.connects(dots, edges, some(2), (0.0, 0.0), goal(10))
    with pytest.raises(ValueError):
        corridor.date_graphs(spark.createDataFrame([], "date string, dot long, id long, lat double, lon double"), dots, edges, (0.0, 0.0), goal(0).limit(0))


def test_set_cover_by_rating(spark):
    rows = [("A0", 1, 5.0), ("A0", 2, 12.0), ("A1", 1, 1.0), ("A1", 2, 12.0), ("B1", 3, 9.0)]
    assert graph.set_cover(spark.createDataFrame(rows, "name string, item int, r double"), "name", "item", "r") == ["A0", "B1"]


def test_walk_grows_over_links(spark):
    panos = spark.createDataFrame([(f"p{k}", k * 10.0) for k in range(21)], "node string, y double")
    links = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(20)], "a string, b string")
    area = panos.where("abs(y - 100) <= 25").select("node")
    assert {r.node for r in corridor.grow(panos, links, "p10", area).collect()} == {f"p{k}" for k in range(8, 13)}


def test_pieces_need_a_pose(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "node long, posed boolean")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert {r.node: r.component for r in graph.pieces(nodes, edges, F.col("posed")).collect()} == {1: 1, 2: 1, 4: 4}


def test_confirmation_by_another_cloud(spark):
    wall = lambda cloud, x: [(cloud, x, y / 4, z / 4) for y in range(8) for z in range(8)]
    points = spark.createDataFrame(wall("a", 15.0) + wall("a", 16.0) + wall("b", 15.0), "cloud string, x double, y double, z double")
    cameras = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 8.0, 2.0, 2.0)], "cloud string, x double, y double, z double")
    got = spatial.confirmed(points, cameras).where("cloud = 'a'").select("x").distinct().collect()
    assert [r.x for r in got] == [15.0]


def test_sparse_sheet(spark):
    rng = np.random.default_rng(0)
    dense = [(float(x), float(y), 0.0) for x, y in rng.uniform(0, 2, (1500, 2))]
    loose = [(float(x), float(y), -0.3) for x, y in rng.uniform(0, 2, (50, 2))]
    rows = [(k, *p) for k, p in enumerate(dense + loose)]
    got = {r.id for r in spatial.sparse_points(spark.createDataFrame(rows, "id long, x double, y double, z double"), ["id"], ["x", "y", "z"]).collect()}
    assert len([k for k in got if k >= 1500]) > 40 and len([k for k in got if k < 1500]) < 75


def test_blobs_go_unless_they_hang_together(spark):
    wall = [("a", k, 30.0, (k % 40) * 0.1, (k // 40) * 0.1) for k in range(1600)]
    ball = [("a", 5000 + k, 35.0 + 0.01 * k, 20.0, 0.0) for k in range(20)]
    near = [("a", 9000, 5.0, 5.0, 0.0)]
    points = spark.createDataFrame(wall + ball + near, "cloud string, id long, x double, y double, z double")
    cameras = spark.createDataFrame([("a", 0.0, 0.0, 0.0)], "cloud string, x double, y double, z double")
    left = {r.id for r in ground.drop_blobs(points, cameras).collect()}
    assert left == {k for k in range(1600)} | {9000}


def test_flood_stops_at_steps(spark):
    cells_ = spark.createDataFrame([("a", i, 0, 0.1 * i if i < 5 else 9.0) for i in range(8)], "cloud string, i long, j long, height double")
    got = graph.flood(cells_, spark.createDataFrame([("a", 0, 0)], "cloud string, i long, j long")).collect()
    assert sorted(r.i for r in got) == [0, 1, 2, 3, 4]


def test_pose_fit_recovers_a_transform(spark):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    s = rng.normal(size=(12, 3)) * 20
    rows = [("p", *map(float, a), *map(float, 1.2 * turn @ a + [1, 2, 3])) for a in s]
    flat = np.array([[math.cos(0.3), 0, math.sin(0.3)], [0, 1, 0], [-math.sin(0.3), 0, math.cos(0.3)]])
    rows = [("p", *map(float, a), *map(float, 1.2 * flat @ a + [1, 2, 3])) for a in s] or rows
    [got] = fit.piece_transforms(spark.createDataFrame(rows, "piece string, x double, y double, z double, tx double, ty double, tz double")).collect()
    assert np.allclose(np.array(got.rotation).reshape(3, 3), flat, atol=1e-6) and np.allclose(got.move, [1, 2, 3], atol=1e-6)
    assert got.scale == pytest.approx(1.2) and got.residual < 1e-6
    alone = spark.createDataFrame([("q", 0.0, 0.0, 0.0, 5.0, 5.0, 5.0)], "piece string, x double, y double, z double, tx double, ty double, tz double")
    assert fit.piece_transforms(alone).first().scale == 1.3


def test_shifts_are_bounded(spark):
    rows = [("s", "a", "b", 0.2, 50), ("s", "b", "c", 2.0, 50)]
    got = {r.piece: r.shift for r in fit.bounded_shifts(spark.createDataFrame(rows, "scene string, piece_a string, piece_b string, step double, cells int")).collect()}
    assert all(abs(v) <= 0.4 for v in got.values()) and got["a"] - got["b"] == pytest.approx(0.2, abs=0.25)


def test_normals_and_heading(spark):
    plane = [(k, x * 0.1, y * 0.1, 0.0) for k, (x, y) in enumerate((x, y) for x in range(5) for y in range(5))]
    p = spark.createDataFrame(plane, "id long, x double, y double, z double")
    got = fit.normals(spatial.k_nearest(p, p, ["id"], ["x", "y", "z"], 8, 0.3, ["id"]), ["id"]).collect()
    assert all(abs(r.normal[2]) == pytest.approx(1) for r in got)
    pairs = p.select("x", "y", (-2 * F.col("y") + 1).alias("tx"), (2 * F.col("x")).alias("ty"))
    assert fit.heading(pairs).first().turn == pytest.approx(math.pi / 2) and fit.heading(pairs).first().scale == pytest.approx(2)


def test_best_shift_finds_the_move(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 6, (300, 3))
    make = lambda x: spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double, z double")
    got = graph.best_shift(make(a), make(a + [1.3, -0.7, 0.3]), steps=(1.0, 0.3))
    assert np.abs(np.array(got) - [1.3, -0.7, 0.3]).max() < 0.35


def test_gaps_fill_from_near(spark):
    c = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6) if (i, j) != (3, 3)], "i long, j long, h double")
    got = raster.filled(c, spark.createDataFrame([(3, 3), (0, 0), (500, 0)], "i long, j long"), "h").collect()
    assert {(r.i, r.j): r.h for r in got} == {(3, 3): pytest.approx(1.0), (0, 0): 1.0, (500, 0): None}
    assert raster.closed(c.select("i", "j")).where("i = 3 and j = 3").count() == 1
    with pytest.raises(ValueError):
        raster.mask_of_classes(c, [99], [1, 2])


def test_water_bodies(spark):
    rows = [(i, j, 0.9 if j < 5 else 0.0, 2.0 if j < 5 else 9.0) for i in range(5) for j in range(8)] + [(20, 20, 1.0, 3.0)]
    got = ground.water_cells(spark.createDataFrame(rows, "i long, j long, wet double, height double")).collect()
    assert len(got) == 25 and {(r.cells, r.level) for r in got} == {(25, 2.0)}


def test_elevation_off_the_ground(spark):
    rows = [(float(x), 0.0, 5.0 + (6.0 if 200 <= x < 225 else 0.0)) for x in range(0, 400, 10)]
    got = ground.thinned_elevations(spark.createDataFrame(rows, "x double, y double, z double")).collect()
    assert {r.i for r in got} == set(range(16)) - {8}


def test_lines(spark):
    line = spark.createDataFrame([("a", k, float(x), 0.0) for k, x in enumerate([0, 1, 4, 10])], "l string, k int, x double, y double")
    assert [r.at for r in sequence.resample(line, ["l"], ["k"], ["x", "y"], 3.0).orderBy("at").collect()] == [0.0, 3.0, 6.0, 9.0, 10.0]
    evenly = sequence.spread_evenly(line, ["l"], ["k"], 3).collect()
    assert sorted(r.k for r in evenly) == [0, 2, 3]
    closed = sequence.smooth(line, ["l"], ["k"], "x", 0.5, "s", closed=True).collect()
    assert sum(r.s for r in closed) == pytest.approx(15.0)


def test_generated_points(spark):
    square = shapes.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(0.0))
    house = spark.range(1).select(F.col("id"), square.alias("ring"), F.lit(0.0).alias("base_m"), F.lit(3.0).alias("height_m"), F.lit("gabled").alias("roof"), F.lit(1.0).alias("roof_m"))
    walls = generate.wall_points(house, "id", 1.0).collect()
    assert len(walls) == (4 + 2 + 4 + 2) * 3 and all(abs(r.x) == 2.0 or abs(r.y) == 1.0 for r in walls)
    roof = generate.roof_points(house, "id", 0.5).collect()
    assert len(roof) == 32 and 2.0 <= min(r.z for r in roof) < max(r.z for r in roof) <= 3.0
    road = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 6.0, 2, {"sidewalk": "both"})], "id long, x0 double, y0 double, x1 double, y1 double, width double, lanes int, tags map<string,string>")
    assert generate.road_points(road, "id", 2.0).count() == 15 and generate.lane_marks(road, "id").count() == 1
    assert {r.side: r.offset for r in generate.pavements(road, "id").collect()} == {"left": 4.25, "right": -4.25}
    box = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "id long, x double, y double, z double, sx double, sy double, sz double")
    assert generate.on_quads(generate.boxes(box, ["id"]), 1.0).count() == 2 * (1 * 2 + 1 * 3 + 2 * 3)
    near = generate.lattice_points(spark.createDataFrame([("c", 0.0, 0.0)], "camera string, x double, y double"), [(2.0, 1.0), (4.0, 2.0)])
    assert near.count() == 25 + 24 and near.select("x", "y").distinct().count() == 49


def test_shades(spark):
    r, g, b = shade.from_lab(*shade.to_lab(F.lit(0.2), F.lit(0.5), F.lit(0.8)))
    assert tuple(one(spark, r, g, b)) == pytest.approx((0.2, 0.5, 0.8), abs=1e-3)
    got = one(spark, shade.meet(F.lit(5.0), F.lit(1.0), F.lit(0.0), 10.0), shade.meet(F.lit(5.0), F.lit(1.0), F.lit(0.0), 10.0, 2.0), shade.meet(F.lit(5.0), F.lit(None).cast("double"), F.lit(0.0), 10.0), shade.gap_level(F.lit(0.07)))
    assert tuple(got) == pytest.approx((1.0, 5.0, 5.0, 0.05 * 1.25**2))
    assert one(spark, shade.terrarium_m(F.lit(128), F.lit(10), F.lit(128)))[0] == 10.5
    h, keep = shade.beneath(F.lit(3.0), F.lit(2.0), F.lit(0.5))
    assert tuple(one(spark, h, keep)) == (1.9, True)


def test_places(spark):
    lat, lon = geo.tile_latlon(*geo.tile_xy(F.lit(48.1), F.lit(11.6), 17), 17)
    assert tuple(one(spark, lat, lon)) == pytest.approx((48.1, 11.6))
    source, ident = geo.key_parts(F.lit("google:a:b"))
    got = one(spark, geo.capture_date(F.lit(2020), F.lit(3), F.lit(None)), geo.capture_date(F.lit(2020), F.lit(3), F.lit(7)), geo.capture_date(F.lit(None), F.lit(3), F.lit(7)), source, ident, geo.driving_side(F.lit("JP")), geo.driving_side(F.lit("FR")))
    assert tuple(got) == ("2020-03", "2020-03-07", "unknown date", "google", "a:b", "left", "right")
    paths = [("a/b.ply", True), ("/a", False), ("a/../b", False), ("a..b", True), ("a\\b", False), ("c:a", False), ("", False), (None, False)]
    rows = spark.createDataFrame(paths, "p string, ok boolean").select("ok", geo.relative_path(F.col("p")).alias("got")).collect()
    assert all(r.ok == r.got for r in rows)


def test_tags(spark):
    t = spark.createDataFrame([({"building": "office", "height": "12,5 m", "min_height": "20", "start_date": "c. 1930", "roof:direction": "sw", "name": "A"},), ({"highway": "path", "width": "-1", "layer": "x", "tunnel": "no"},)], "t map<string,string>")
    height, guessed = tags.building_height(F.col("t"))
    a, b = t.select(height.alias("h"), guessed.alias("g"), tags.building_base(F.col("t"), height).alias("base"), tags.built_before(F.col("t")).alias("old"), tags.roof_direction(F.element_at("t", "roof:direction")).alias("d"), tags.road_width(F.col("t")).alias("w"), tags.on_open_ground(F.col("t")).alias("open"), tags.place_name(F.col("t"), [["name", "ref"], ["name"]]).alias("n")).collect()
    assert (a.h, a.g, a.base, a.old, a.d, a.n) == (12.5, False, 10.0, True, 225.0, "A")
    assert (b.h, b.g, b.w, b.open, b.n) == (12.0, True, 2.0, True, "")


def test_cameras_look(spark):
    unit = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    u, v, far, below = shapes.look(unit, F.lit(0.0), F.lit(3.0), F.lit(4.0))
    assert tuple(one(spark, u, v, far, below)) == pytest.approx((0.5, 0.5 + math.degrees(math.asin(0.6)) / 180, 5.0, math.degrees(math.asin(0.6))))
    move = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 5, 0, 1, 0, 6, 0, 0, 1, 7, 0, 0, 0, 1)])
    assert tuple(one(spark, *shapes.affine(move, F.lit(1.0), F.lit(1.0), F.lit(1.0)))) == (6.0, 7.0, 8.0)


def test_ply_append_and_overwrite(spark, tmp_path):
    spark.dataSource.register(PlyDataSource)
    path = str(tmp_path / "points")
    points = lambda n, k: spark.range(n).selectExpr("cast(id as float) as x", "cast(id as double) as y").repartition(k)
    read = lambda: spark.read.format("ply").load(path)
    points(10, 4).write.format("ply").mode("append").save(path)
    points(3, 2).write.format("ply").mode("append").save(path)
    assert sorted(r.x for r in read().collect()) == sorted([*range(10), *range(3)])
    points(3, 1).write.format("ply").mode("overwrite").save(path)
    assert sorted(r.x for r in read().collect()) == [0, 1, 2]
    points(0, 1).write.format("ply").mode("overwrite").save(path)
    assert read().count() == 0 and read().columns == ["x", "y"]


def test_ply_round_trip(spark, tmp_path):
    spark.dataSource.register(PlyDataSource)
    rows = [(float(k), -float(k), 0.5, k % 256 / 255, 0.0, 1.0, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "x float, y float, z float, r float, g float, b float, kind int").repartition(3)
    df.write.format("ply").mode("append").save(str(tmp_path / "cloud"))
    got = spark.read.format("ply").load(str(tmp_path / "cloud"))
    assert got.columns == ["x", "y", "z", "red", "green", "blue", "kind"] and got.count() == 1000
    assert got.where("abs(red - kind % 256) > 1 or blue <> 255 or x <> -y").count() == 0
    assert spark.read.format("ply").option("every", "4").load(str(tmp_path / "cloud")).count() in (250, 251, 252, 253)
    (tmp_path / "bad.ply").write_bytes(b"ply\nformat ascii 1.0\nend_header\n")
    with pytest.raises(Exception, match="binary little-endian"):
        spark.read.format("ply").load(str(tmp_path / "bad.ply")).count()


def test_scene_tables(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"center": [1.3, 103.7], "nodes": [{"pano": {"source": "google", "id": "a", "lat": 1.3, "lon": 103.7}, "ply": "n0.ply", "transform": [[1,0,0,0]]}, {"pano": {"source": "google", "id": "b"}}], "adjacency": {"0": [1], "1": [0]}, "edges": [{"a": 0, "b": 1}]}')
    scenes = scene.read_scenes(spark, str(tmp_path / "s.json"))
    assert scene.nodes(scenes).count() == 2 and scene.placed(scene.nodes(scenes)).count() == 1
    assert {(r.src, r.dst) for r in scene.adjacency(scenes).collect()} == {(0, 1), (1, 0)}
    scene.write_scenes(scenes, str(tmp_path / "out"))
    assert scene.edges(scene.read_scenes(spark, str(tmp_path / "out"))).count() == 1


def test_looked_up_panoramas(spark):
    kinds = "id string, lat double, lon double, date string, elevation double, heading double, pitch double, roll double, links array<struct<id:string,lat:double,lon:double>>, neighbors array<struct<id:string,lat:double,lon:double>>, historical array<struct<id:string,date:string>>"
    rows = [("a", 1.0, 2.0, "2020-01", None, 0.0, 0.0, 0.0, [], [("b", 1.0, 2.0), ("c", None, None)], [("a0", "2015-05")])]
    _, near, dates = scene.panoramas(spark.createDataFrame(rows, kinds))
    assert [r.neighbour for r in near.collect()] == ["b"] and {r.date for r in dates.collect()} == {"2020-01", "2015-05"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, x double, y double, z double")
    assert cells.voxel_mean(none, ["x", "y", "z"], [], 0.1).count() == 0
    assert spatial.within(none, none, ["x", "y", "z"], 1.0).count() == 0
    assert spatial.nearest(none, none, ["id"], ["x", "y", "z"], 1.0, ["id"]).count() == 0
    assert graph.components(none, "id", none.select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
    assert ranking.dense_index(none, ["id"], "k").count() == 0
    assert sequence.runs(none, ["id"], ["x"], F.col("y") > 0, "x").count() == 0
