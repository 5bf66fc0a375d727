"""What grows with the table is dealt over tasks and compared in batches."""

import time
from collections import namedtuple

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orthoquad.operators import head, pixels, synthetic
from orthoquad.operators.nms import CHUNK, Kept
from orthoquad.plans import catalog
from orthoquad.plans.table_functions import Suppress
from orthoquad.sources import jpeg

SF = "/root/testdata/sf0.001"


def test_frames_are_dealt_before_pixels_are_made(spark):
    assert spark.read.parquet(f"{SF}/supplier.parquet").rdd.getNumPartitions() == 1
    assert catalog.frames(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pixels.dealt(spark.range(9001), "id").rdd.getNumPartitions() == 10


def test_first_places(spark):
    rows = spark.createDataFrame([("a", 2, 3, 1, bytearray([0, 200, 1, 200, 5, 6])), ("b", 0, 0, 3, bytearray())], "image string, height int, width int, channels int, data binary")
    assert sorted(map(tuple, pixels.first_places(rows, (200, 1, 7)).collect())) == [("a", 2, 3, 6, [1, 2, -1]), ("b", 0, 0, 0, [-1, -1, -1])]
    assert sorted(map(tuple, pixels.rotated_places(rows, (200, 1, 7)).collect())) == [("a", 3, 2, 6, [0, 5, -1]), ("b", 0, 0, 0, [-1, -1, -1])]


def test_marked_frames_are_drawn_where_they_are_turned(spark):
    """As frames drawn before and turned one by one; more than ``LANES``, of several sizes, with corners that meet, lie outside or are null."""
    noise = np.random.default_rng(7)
    sizes = [(3, 5), (5, 3), (4, 4), (1, 9), (0, 0)]
    rows = [(str(i), *sizes[i % 5], [[int(noise.integers(-1, 6)), int(noise.integers(-1, 5))] for _ in range(4)]) for i in range(203)]

    def data(height, width, corners):
        a = np.zeros((height, width), np.uint8)
        for v, (x, y) in zip((1, 200, 3, 255), corners, strict=True):
            if 0 <= x < width and 0 <= y < height:
                a[y, x] = v
        return bytearray(a.tobytes())

    schema = "image string, height int, width int, corners array<array<int>>"
    drawn = spark.createDataFrame([(*r, 1, data(*r[1:])) for r in rows], f"{schema}, channels int, data binary")
    want = pixels.rotated_places(drawn, (1, 200, 3, 255), keep=("image", "corners"))
    got = pixels.rotated_drawn_places(spark.createDataFrame(rows, schema).repartition(2), (1, 200, 3, 255), keep=("image", "corners"))
    assert got.dtypes == want.dtypes and len(set(map(str, got.collect()))) == 203
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    odd = spark.createDataFrame([("a", 2, 3, [[0, 0], [None, 1], None, [2, 1]]), ("b", None, 3, [[0, 0]] * 4), ("c", 2, 3, None)], schema)
    assert sorted(tuple(r) for r in pixels.rotated_drawn_places(odd, (1, 2, 3, 4)).collect()) == [("a", 3, 2, 6, [1, None, None, 4]), ("b", None, None, None, [None] * 4), ("c", 3, 2, 6, [None] * 4)]


def test_pixel_rotate_sends_no_pixels_to_python(spark, tmp_path):
    plan = catalog.pixel_rotate(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "overlay" not in plan and "repeat" not in plan
    rows = spark.read.parquet(f"{SF}/events.parquet").limit(2)
    rows.withColumn("event_id", F.when(F.col("event_id") > 0, F.col("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    blank = catalog.pixel_rotate(spark, str(tmp_path)).where("image IS NULL").collect()
    assert [tuple(r) for r in blank] == [(None, 240, 320, [None] * 8, 76800, [None] * 4, True)]  # as its SQL


def test_turned_frames_are_moved_in_wide_items():
    noise = np.random.default_rng(9)
    points = np.stack([noise.integers(0, 320, (64, 4)), noise.integers(0, 240, (64, 4))], axis=2)

    def one_by_one():
        for part in points:
            a = np.zeros((240, 320, 1), np.uint8)
            a[part[:, 1], part[:, 0], 0] = 1, 2, 3, 4
            data = pixels.upright(a).tobytes()
            yield [data.find(v) for v in (1, 2, 3, 4)]

    height, width, places = pixels._drawn_places(points, (1, 2, 3, 4), 240, 320, pixels.upright)
    assert (height, width) == (320, 240) and places.tolist() == list(one_by_one())
    found, before = quickest(lambda: pixels._drawn_places(points, (1, 2, 3, 4), 240, 320, pixels.upright), lambda: list(one_by_one()), rounds=5)
    assert found < before / 4  # a tenth of it or less


def test_backgrounds_are_drawn_over_where_they_are_read(spark):
    behind = spark.createDataFrame([(i, 64, 48, bytearray([i or 0] * 64 * 48 * 3)) for i in (0, 1, 2, None, 7)], "index long, height int, width int, data binary")
    made = synthetic.generate(spark, 8, backgrounds=behind, of=3)
    assert "Join" not in made._jdf.queryExecution().toString()
    got = {r["image"][-11:-4]: r["data"][0] for r in made.collect()}
    assert got == {f"{i:07d}": i % 3 for i in range(8)}


def test_tensors_reach_the_model_in_order(spark):
    rows = spark.range(70).select(F.col("id").cast("string").alias("image"), F.lit(1).alias("height"), F.lit(2).alias("width"), F.lit(3).alias("channels"), F.unhex(F.concat(*(F.lpad(F.hex(F.col("id") + i), 2, "0") for i in range(6)))).alias("data")).repartition(1)

    def load():
        return lambda b: pd.DataFrame({"image": b["image"], "prior_id": 0, "confidence": [t[:2] for t in b["tensor"]], "ordered_corners": [t[2:] for t in b["tensor"]]})

    got = {int(r["image"]): r["confidence"] + r["ordered_corners"] for r in head.forward(pixels.channels_first(rows), load).collect()}
    assert got == {i: [i, i + 3, i + 1, i + 4, i + 2, i + 5] for i in range(70)}


def test_suppression_compares_rows_in_chunks(monkeypatch):
    sizes, offer = [], Kept.offer
    monkeypatch.setattr(Kept, "offer", lambda self, boxes, t: sizes.append(len(boxes)) or offer(self, boxes, t))
    row = namedtuple("row", "image id score x0 y0 x1 y1")
    one, taken = Suppress(), []
    fields = [row(1, i, 1000 - i, 10 * i, 0, 10 * i + 8, 8) for i in range(700)] + [row(1, 700 + i, 0, 10 * i, 0, 10 * i + 8, 8) for i in range(100)]
    for r in fields:
        taken += one.eval(r._asdict(), 3, 10)
    taken += one.terminate()
    assert taken == [(1, i) for i in range(700)] and sizes == [CHUNK] * 3 + [800 - 3 * CHUNK]


def test_frames_reach_the_model_in_one_pass(spark):
    """As by one step after another, without frames or tensors between them."""
    rows = spark.createDataFrame([(str(i), 3 + i % 3, 4, 3, bytearray((i * 7 + k) % 256 for k in range((3 + i % 3) * 12))) for i in range(70)], "image string, height int, width int, channels int, data binary").repartition(2)

    def load():
        return lambda b: pd.DataFrame({"image": b["image"], "prior_id": [len(t) for t in b["tensor"]], "confidence": [[t[0], t[-1]] for t in b["tensor"]], "ordered_corners": [t[100:108] for t in b["tensor"]]})

    one = head.forward_frames(rows, load, lambda a: pixels.resize(pixels.upright(a)))
    steps = head.forward(pixels.channels_first(pixels.fit(pixels.rotate_landscape(rows))), load)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, steps.collect())) and one.count() == 70
    assert one.first()["prior_id"] == 3 * 240 * 320
    plan = catalog.forward_outputs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def quickest(*works, rounds=40):
    """The least seconds of each, taken in turns."""
    seconds = [[] for _ in works]
    for _ in range(rounds):
        for work, taken in zip(works, seconds, strict=True):
            began = time.perf_counter()
            work()
            taken.append(time.perf_counter() - began)
    return [min(s) for s in seconds]


def block_by_block(pixels, step):
    """Coefficients before they are rounded: planes by formula, then each block between two small matrices."""
    height, width = pixels.shape[:2]
    r, g, b = np.moveaxis(np.pad(pixels.astype(np.float64), ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge"), 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cuts = [p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8) for p in (y - 128, (b - y) * 0.5 / 0.886, (r - y) * 0.5 / 0.701)]
    return np.stack([(jpeg._DCT @ c @ jpeg._DCT.T / step).reshape(-1, 64)[:, jpeg._ORDER] for c in cuts], axis=1)


def test_all_blocks_of_a_frame_are_transformed_at_once():
    noise = np.random.default_rng(3)
    for shape in ((120, 160, 3), (9, 13, 3), (8, 8, 3), (1, 1, 3)):
        a = noise.integers(0, 256, shape, dtype=np.uint8)
        for step in (1, 4):
            assert np.abs(jpeg.coefficients(a, step) - block_by_block(a, step)).max() <= 0.5 + 1e-9
    frame = np.full((120, 160, 3), 40, np.uint8)
    frame[:60, :80] = 200
    encoded, transformed = quickest(lambda: jpeg.encode(frame), lambda: block_by_block(frame, 4))
    assert encoded < transformed * 1.4  # it was 1.8 and is 0.8 to 1


def test_outlines_are_found_channel_by_channel():
    noise = np.random.default_rng(5)

    def pixel_by_pixel(a):
        y, x = np.nonzero(a[:, :, 0].astype(int) - a[:, :, 1:].max(axis=2) > 100)
        return (x.min(), y.min(), x.max(), y.max()) if len(x) else (None,) * 4

    for shape in ((120, 160, 3), (1, 1, 3), (7, 5, 4), (6, 3, 2)):
        a = noise.integers(0, 256, shape, dtype=np.uint8)
        assert pixels.marked_box(a) == pixel_by_pixel(a)
    assert pixels.marked_box(np.zeros((2, 2, 3), np.uint8)) == (None,) * 4
    frame = pixels.outline(np.full((120, 160, 3), 40, np.uint8), (30, 20, 90, 70))
    assert pixels.marked_box(frame) == (30, 20, 90, 70)
    found, before = quickest(lambda: pixels.marked_box(frame), lambda: pixel_by_pixel(frame))
    assert found < before / 2  # a seventh of it
