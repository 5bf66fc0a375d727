"""The dataset as a data source: reads of both files, pushed filters, and commits."""

import json
import os

import pytest
from pyspark.sql import functions as F

from orthoquad.sources import dataset_source as ds

ORDER = ["qr_top_left", "qr_top_right", "qr_bottom_right", "qr_bottom_left"]


def rows_of(spark, n, bad=()):
    ids = spark.range(n, numPartitions=4)
    split = F.when(F.col("id") % 5 == 0, "val").when(F.col("id").isin(*bad) if bad else F.lit(False), "nowhere").otherwise("train")
    point = lambda x, y: F.array((F.col("id") + x).cast("double"), F.lit(float(y)))
    corners = F.when(F.col("id") % 7 != 0, F.array(point(0, 0), point(5, 0), point(5, 5.5), point(0, 5)))
    return ids.select(split.alias("split"), F.format_string("images/a %d.jpg", "id").alias("image"), F.lit(240).alias("width"), F.lit(320).alias("height"), F.lit("qrcode").alias("label"), corners.alias("corners"), F.array(*map(F.lit, ORDER)).alias("corner_order"), F.encode(F.repeat(F.col("id").cast("string"), 3), "utf-8").alias("content"), F.lit(None).cast("string").alias("reject"))


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_written_rows_are_read_back_once_each_in_small_slices(spark, tmp_path):
    ds.register(spark)
    rows_of(spark, 60).write.format("quads").mode("append").option("path", str(tmp_path)).save()
    got = spark.read.format("quads").option("slice_bytes", 100).load(str(tmp_path))
    want = {r.image: r for r in rows_of(spark, 60).collect()}
    found = got.collect()
    assert got.rdd.getNumPartitions() > 60 and len(found) == 60
    for r in found:
        w = want[r.image]
        assert (r.split, r.width, r.height, r.label, r.corners, r.corner_order, bytes(r.content)) == (w.split, 240, 320, "qrcode", w.corners, ORDER, bytes(w.content))
        assert r.reject == (None if w.corners else "not four finite points")
    assert not any("_attempts" in f for f in files(tmp_path)) and sum(f.endswith(".jpg") for f in files(tmp_path)) == 60


def test_filters_on_split_reach_the_source(spark, tmp_path):
    ds.register(spark)
    rows_of(spark, 20).write.format("quads").mode("append").option("path", str(tmp_path)).save()
    got = spark.read.format("quads").load(str(tmp_path)).where("split = 'val'")
    assert got.count() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("Filter" in line and "= val" in line for line in plan.split("\n"))  # the source took it
    reader = ds.Reader(str(tmp_path), 10**6)
    left = list(reader.pushFilters([ds.EqualTo(("split",), "val"), ds.EqualTo(("width",), 240)]))
    assert [f.attribute for f in left] == [("width",)] and {p.split for p in reader.partitions()} == {"val"}
    assert spark.read.format("quads").load(str(tmp_path)).where("split = 'none'").count() == 0


def test_odd_lines_and_images_become_rejects(spark, tmp_path):
    (tmp_path / "train" / "images").mkdir(parents=True)
    good = {"image": "images/a.jpg", "width": 240, "height": 320, "label": "é", "corners": [[1, 2], [3, 4], [5, 6], [7, 8.5]], "corner_order": ORDER}
    lines = [json.dumps(good), "", "{", "[1]", "null", json.dumps(good | {"image": "images/none.jpg"}), json.dumps(good | {"image": "../../etc/x"}), json.dumps(good | {"corners": [[1, 2]]}), json.dumps(good | {"width": "wide"}), json.dumps(good | {"corners": [[1e400, 0]] * 4})]
    (tmp_path / "train" / "annotations.jsonl").write_text("\n".join(lines))
    (tmp_path / "train" / "images" / "a.jpg").write_bytes(b"\xff\xd8")
    ds.register(spark)
    got = sorted(((r.image, r.reject) for r in spark.read.format("quads").load(str(tmp_path)).collect()), key=repr)
    want = [("images/a.jpg", None), ("images/none.jpg", "no image"), ("../../etc/x", "image outside the split"), ("images/a.jpg", "not four finite points"), ("images/a.jpg", "not four finite points"), *[(None, "not a record")] * 4]
    assert got == sorted(want, key=repr)


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    ds.register(spark)
    root = tmp_path / "out"
    with pytest.raises(Exception, match="nowhere is no split"):
        rows_of(spark, 40, bad=(38,)).write.format("quads").mode("append").option("path", str(root)).save()
    assert files(root) == []


def test_a_doubled_task_shows_its_rows_once(spark, tmp_path):
    rows = rows_of(spark, 10).collect()
    writer = ds.Writer(str(tmp_path), False)
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([second, None])
    assert first.attempt != second.attempt and sum(f.endswith(".jpg") for f in files(tmp_path)) == 10 and not any("_attempts" in f for f in files(tmp_path))
    ds.register(spark)
    assert spark.read.format("quads").load(str(tmp_path)).count() == 10


def test_overwrite_replaces_all_splits(spark, tmp_path):
    ds.register(spark)
    save = lambda n, mode: rows_of(spark, n).write.format("quads").mode(mode).option("path", str(tmp_path)).save()
    save(20, "append"), save(10, "overwrite")
    assert spark.read.format("quads").load(str(tmp_path)).count() == 10 and sum(f.endswith(".jpg") for f in files(tmp_path)) == 10
