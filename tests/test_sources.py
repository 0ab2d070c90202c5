"""Readers and writers on small trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.operators import joins, projections, sampling, validation
from corpuslab.plans import tables
from corpuslab.sources import files, manifest, store, web


@pytest.fixture
def tree(tmp_path):
    for name in ("a.png", "b.PNG", ".hid.png", "n.txt", "cats/c.b.jpg", "cats/deep/d.jpg", ".git/e.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (len(name)))
    return str(tmp_path)


def test_listing(spark, tree):
    flat = files.read_listing(spark, tree, [".png"])
    assert sorted(r["rel_path"] for r in flat.collect()) == ["a.png", "b.PNG"]
    deep = {r["rel_path"]: r for r in files.read_listing(spark, tree, recursive=True).collect()}
    assert sorted(deep) == ["a.png", "b.PNG", "cats/c.b.jpg", "cats/deep/d.jpg", "n.txt"]
    row = deep["cats/c.b.jpg"]
    assert (row["category"], row["name"], row["ext"], row["bytes"]) == ("cats", "c.b.jpg", ".jpg", 12)


def test_listing_never_reads_contents(spark, tree, monkeypatch):
    monkeypatch.setattr("builtins.open", lambda *a, **k: pytest.fail("a file was opened on the driver"))
    plan = files.read_listing(spark, tree, recursive=True)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_listing_of_odd_trees(spark, tmp_path):
    for name in ("_a/b=1/.c/x.png", "_a/b=1/_x.png", "_a/.x.png", "a=b.png", "e/empty.png", "_SUCCESS", "ü/ö ä.png"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"" if name == "e/empty.png" else b"xy")
    (tmp_path / "nothing").mkdir()
    rows = {r["rel_path"]: r for r in files.read_listing(spark, str(tmp_path), recursive=True).collect()}
    assert {k: v["bytes"] for k, v in rows.items()} == {"_a/b=1/_x.png": 2, "a=b.png": 2, "e/empty.png": 0, "_SUCCESS": 2, "ü/ö ä.png": 2}
    assert rows["_a/b=1/_x.png"]["path"] == f"file:{tmp_path}/_a/b=1/_x.png" and rows["_SUCCESS"]["ext"] == ""
    assert rows["a=b.png"]["mtime"].timestamp() == pytest.approx((tmp_path / "a=b.png").stat().st_mtime, abs=0.002)
    assert sorted(r["rel_path"] for r in files.read_listing(spark, str(tmp_path)).collect()) == ["_SUCCESS", "a=b.png"]
    assert files.read_listing(spark, str(tmp_path / "nothing"), recursive=True).collect() == []
    with pytest.raises(Exception):
        files.read_listing(spark, str(tmp_path / "absent")).collect()


def test_listing_brings_no_file_to_the_driver(spark, tmp_path, monkeypatch):
    """Two hundred folders, four levels: one job a level, and only counts come back."""
    for k in range(200):
        folder = tmp_path / f"a{k % 10}" / f"b{k % 20}" / f"c{k}"
        folder.mkdir(parents=True)
        (folder / "f.txt").write_text("x")
    seen = []
    levels = files._levels
    monkeypatch.setattr(files, "_levels", lambda *a: seen.append(levels(*a)) or seen[-1])
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: pytest.fail("rows were brought to the driver"))
    listing = files.read_listing(spark, str(tmp_path), recursive=True)
    monkeypatch.undo()
    assert len(seen[0]) == 4 and listing.count() == 200


def test_listing_where_only_hadoop_reaches(spark, tree):
    root = files.qualified(spark, tree)
    found = files._driver_listing(spark, root, True)
    assert sorted(r["rel_path"] for r in found.collect()) == ["a.png", "b.PNG", "cats/c.b.jpg", "cats/deep/d.jpg", "n.txt"]
    assert not files._arrow_reaches("viewfs://x/y") and files._arrow_reaches("file:/tmp")


def test_first_available(spark, tmp_path):
    good = str(tmp_path / "good")
    spark.range(3).write.parquet(good)
    df, uri = files.read_first_available(spark, [str(tmp_path / "none"), good])
    assert uri == good and df.count() == 3
    with pytest.raises(ValueError, match="no source is readable"):
        files.read_first_available(spark, [str(tmp_path / "none")])


def test_payload_column(spark):
    df = spark.createDataFrame([(1, (bytearray(b"ab"), "p")), (2, (bytearray(b""), "q")), (3, None)], "id int, image struct<bytes: binary, path: string>")
    assert files.detect_payload_column(df) == "image"
    assert [(r["id"], bytes(r["payload"])) for r in files.extract_payload(df).collect()] == [(1, b"ab")]
    with pytest.raises(ValueError):
        files.detect_payload_column(df.select("id"))


def test_posts(spark):
    docs = ['[{"id": 7, "file_url": "//h/a.png"}, {"id": 8}, {"file_url": "x"}, {"id": 0, "file_url": "y"}]', "[]", '{"id": 1, "file_url": "z"}', "oops", None]
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    assert [tuple(r) for r in web.parse_posts(df, "j").collect()] == [(7, "//h/a.png")]


def test_image_links(spark):
    html = """<img src="a.PNG"><a href='z.png'></a><IMG alt="q" src='b.jpg'><img src="a.PNG"><img src="c.svg"><img
      src="d.jpeg">"""
    df = spark.createDataFrame([(1, "s", html), (2, "s", '<img src="b.jpg"><img src="e.jpg">')], "page int, source string, html string")
    per_page = web.extract_links(df, "html", "page", "src", "img", [".png", ".jpg", ".jpeg"], limit=2)
    assert sorted((r["page"], r["pos"], r["link"]) for r in per_page.collect()) == [(1, 0, "a.PNG"), (1, 1, "b.jpg"), (2, 0, "b.jpg"), (2, 1, "e.jpg")]
    whole = web.extract_links(df, "html", "page", "src", "img", [".png", ".jpg", ".jpeg"], limit=4, group="source")
    assert sorted(r["link"] for r in whole.collect()) == ["a.PNG", "b.jpg", "d.jpeg", "e.jpg"]


def test_manifest_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(f"faces/{i}.JPG", "faces") for i in range(6)], "key string, category string")
    chosen = sampling.select_holdout(items, "key", 3)
    ranked = chosen.selectExpr("key", "category", "row_number() over (order by order_key) as rank")
    manifest.write_manifest(ranked, str(tmp_path / "m"))
    manifest.write_holdout(ranked, str(tmp_path / "h"))
    back = manifest.read_manifest(spark, str(tmp_path / "m"), "/bench")
    rows = back.orderBy("id").collect()
    assert [r["id"] for r in rows] == ["portrait_0001", "portrait_0002", "portrait_0003"]
    assert rows[0]["reference_path"] == "/bench/references/portrait_0001.jpg"
    assert validation.validate_manifest(back).count() == 0
    held = manifest.read_holdout(spark, str(tmp_path / "h"))
    train = joins.exclude_holdout(items, held, "key")
    assert train.count() == 3
    assert joins.audit_leakage(train, held, "key").collect()[0] == (3, 0)
    with pytest.raises(ValueError):
        joins.exclude_holdout(items, None)
    with pytest.raises(ValueError, match="need 7"):
        sampling.select_holdout(items, "key", 7)


def test_manifest_columns_and_violations(spark, tmp_path):
    (tmp_path / "m.csv").write_text("category,id,input_path,reference_path,notes,extra\nblur, s1 ,in/a.jpg,,n,1\n")
    row = manifest.read_manifest(spark, str(tmp_path / "m.csv")).collect()[0]
    assert (row["id"], row["input_path"], row["reference_path"]) == ("s1", f"{tmp_path}/in/a.jpg", None)
    (tmp_path / "bad.csv").write_text("id,input_path\n1,a.jpg\n")
    with pytest.raises(ValueError, match="category, notes, reference_path"):
        manifest.read_manifest(spark, str(tmp_path / "bad.csv"))
    rows = [("a", "x.jpg", None, "c", ""), ("a", "x.bmp", "r.webp", "c", ""), ("", "", "r.gif", "", "")]
    df = spark.createDataFrame(rows, "id string, input_path string, reference_path string, category string, notes string")
    found = sorted((r["id"], r["violation"]) for r in validation.validate_manifest(df).collect())
    assert found == [("", "bad_reference_suffix"), ("", "blank_category"), ("", "blank_id"), ("", "blank_input"), ("a", "bad_input_suffix"), ("a", "duplicate_id")]
    with pytest.raises(ValueError, match="not valid"):
        validation.validate_manifest(df, strict=True)
    assert validation.validate_manifest(df.limit(0)).collect()[0]["violation"] == "empty_manifest"


def test_missing_files(spark):
    m = spark.createDataFrame([("s", "/b/i.jpg", "/b/r.jpg"), ("t", "/b/j.jpg", None)], "id string, input_path string, reference_path string")
    have = spark.createDataFrame([("/b/i.jpg",), ("/b/j.jpg",)], "path string")
    assert [tuple(r) for r in joins.check_files(m, have).collect()] == [("s", "reference", "/b/r.jpg")]
    assert sorted(tuple(r) for r in joins.file_counts(m, have).collect()) == [("input", 2, 0), ("reference", 1, 1)]


def test_sidecar_layouts_and_round_trip(spark, tmp_path):
    (tmp_path / "meta.txt").write_text("b.c.png (480,320,3) 1\na.png 1\nz.png\n\n")
    meta = manifest.read_meta_info(spark, str(tmp_path / "meta.txt"))
    got = {r["key"]: (r["h"], r["w"], r["c"], r["level"]) for r in meta.collect()}
    assert got == {"b.c": (480, 320, 3, 1), "a": (None, None, None, 1), "z": (None, None, None, None)}
    manifest.write_meta_info(meta, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ["a.png 1", "b.c.png (480,320,3) 1", "z.png"]


def test_packed_store(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:02d}", bytearray([i])) for i in range(20)], "key string, payload binary")
    path = str(tmp_path / "store")
    store.write_packed(df, path, 3)
    keys = spark.createDataFrame([("k03",), ("k19",), ("nope",)], "key string")
    assert sorted((r["key"], bytes(r["payload"])) for r in store.read_store(spark, path, keys).collect()) == [("k03", b"\x03"), ("k19", b"\x13")]
    again = keys.unionByName(keys).unionByName(spark.createDataFrame([(None,)], "key string"))
    assert store.read_store(spark, path, again).count() == 2
    with pytest.raises(ValueError, match="unique"):
        store.write_packed(df.unionByName(df.limit(1)), str(tmp_path / "again"))


def test_text_functions(spark):
    names = {
        "a.b.png": (".png", "a.b", "enhanced_a.b.png"),
        "C:\\x\\..\\My photo!.JPEG": (".jpeg", "My photo!", "enhanced_My_photo.png"),
        ".hidden": ("", ".hidden", "enhanced_hidden.png"),
        "dir.d/plain": ("", "plain", "enhanced_plain.png"),
        "ünï.webp": (".webp", "ünï", "enhanced_n.png"),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    c = F.col("n")
    got = {r["n"]: (r["s"], r["k"], r["f"]) for r in df.select("n", text.suffix(c).alias("s"), text.store_key(c).alias("k"), text.safe_filename(c).alias("f")).collect()}
    assert got == names
    sizes = {0: "0.0 B", 1023: "1023.0 B", 1280: "1.2 KB", 1792: "1.8 KB", 5 * 1024**3: "5.0 GB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r["n"]: r["s"] for r in df.select("n", text.human_bytes(F.col("n")).alias("s")).collect()} == sizes
    durations = {"0:00:07": 7, "1 day, 2:03:04": 93784, "12 days, 0:00:00": 1036800, "soon": None}
    df = spark.createDataFrame([(d,) for d in durations], "d string")
    assert {r["d"]: r["s"] for r in df.select("d", text.duration_seconds(F.col("d")).alias("s")).collect()} == durations


def test_limits_are_inclusive_and_unknown_sizes_pass(spark):
    df = spark.createDataFrame([(5, 10, 10), (6, 10, 10), (None, 10, 11), (1, None, 3)], "bytes long, w int, h int")
    assert projections.filter_size(df, 5, 100).count() == 2
    assert projections.filter_size(df, 5, 100, null_passes=False).count() == 1
    score = spark.createDataFrame([(0.8, [(0.0, 0.0), (3.0, 4.0)]), (0.81, [(0.0, 0.0), (3.0, 4.0)]), (0.9, [(0.0, 0.0), (1.0, 1.0)])], "score double, lm array<struct<x: double, y: double>>")
    assert [r["score"] for r in projections.filter_detections(score).collect()] == [0.81]
    assert projections.filter_detections(score, 0.8, None).count() == 2


def test_pairing_reports_and_refuses(spark):
    gt = spark.createDataFrame([("g/a.png",), ("g/b.png",)], "path string")
    lq = spark.createDataFrame([("l/a_lq.png",), ("l/c_lq.png",)], "path string")
    pairs = joins.pair_lq_gt(lq, gt, "{}_lq")
    assert sorted(r["status"] for r in pairs.collect()) == ["missing_gt", "missing_lq", "paired"]
    with pytest.raises(ValueError, match="do not match"):
        joins.assert_paired(pairs)
    assert joins.assert_paired(pairs.where("status = 'paired'")).collect()[0] == ("l/a_lq.png", "g/a.png")


def test_presets(spark):
    df = spark.createDataFrame([("Custom", 0.1, 0.2, True, True, True, True, True)], "preset string, w double, skin_grain double, eye_enhancement boolean, color_match boolean, enable_eyes boolean, enable_lips boolean, enable_skin boolean")
    assert joins.resolve_presets(df).collect()[0]["w"] == 0.1
    with pytest.raises(Exception, match="unknown preset"):
        joins.resolve_presets(df.withColumn("preset", F.lit("portrait"))).collect()


def test_presets_from_a_table(spark):
    requests = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("Custom", 0.9)], "preset string, w double")
    table = spark.createDataFrame([("a", 0.1), ("b", None), (None, 0.5)], "preset string, w double")
    assert sorted(map(tuple, joins.resolve_presets(requests, table).collect())) == [("Custom", 0.9), ("a", 0.1), ("b", 0.9)]
    for bad in ("c", None):
        with pytest.raises(Exception, match="unknown preset"):
            joins.resolve_presets(spark.createDataFrame([(bad, 0.1)], "preset string, w double"), table).collect()
    with pytest.raises(ValueError, match="more than once"):
        joins.resolve_presets(requests, table.unionByName(table))
    swept = joins.sweep(spark.range(2), table.where("preset IS NOT NULL")).collect()
    assert sorted((r["id"], r["preset"], r["w"]) for r in swept) == [(0, "a", 0.1), (0, "b", None), (1, "a", 0.1), (1, "b", None)]


def test_gates(spark):
    df = spark.range(4)
    assert validation.require(df, F.count(F.lit(1)) == 4, "x").count() == 4
    with pytest.raises(ValueError, match="too few"):
        validation.require_rows(df, 5, "too few")
    with pytest.raises(Exception, match="not small"):
        validation.checked(df, F.col("id") < 3, "not small").collect()


def test_a_table_streams_from_one_file_or_a_folder(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("v"))
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "t.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "one").mkdir()
    (file,) = (tmp_path / "parts").glob("*.parquet")
    file.rename(tmp_path / "one" / "t.parquet")
    rows.write.parquet(str(tmp_path / "one" / "other.parquet"))
    for kind in ("many", "one"):
        out = str(tmp_path / f"{kind}-out")
        stream = tables.stream(spark, str(tmp_path / kind), "t").writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
        stream.trigger(availableNow=True).start(out).awaitTermination(120)
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(40))
