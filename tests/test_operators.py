"""Priors, matching, suppression, head rows, manifests and dataset steps."""

import random
from fractions import Fraction

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orthoquad.operators import dataset, head, manifest, matching, nms, priors
from orthoquad.plans.catalog import SIDES

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_prior_grid(spark):
    rows = priors.prior_grid(spark).collect()
    assert sorted(r.prior_id for r in rows) == list(range(4420))
    cells = {n: len({(r.row, r.col) for r in rows if r.level == n}) for n in range(4)}
    assert cells == {0: 1200, 1: 300, 2: 80, 3: 20}


def overlap(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / union if union else 0.0


@pytest.fixture(scope="module")
def truth(spark):
    boxes = [(0, (10.0, 10.0, 60.0, 80.0)), (1, (100.0, 120.0, 101.0, 121.0)), (2, (0.0, 0.0, 240.0, 320.0)), (3, (64.0, 64.0, 128.0, 128.0))]
    return boxes, spark.createDataFrame(boxes, f"id int, box {BOX}")


def test_best_prior_against_all_pairs(spark, truth):
    boxes, frame = truth
    grid = priors.with_boxes(priors.prior_grid(spark), SIDES)
    all_priors = [(r.prior_id, tuple(r.box)) for r in grid.collect()]
    got = {r.id: (r.prior_id, r.iou) for r in matching.best_prior(frame, grid, "id").collect()}
    for key, box in boxes:
        want = max(((overlap(box, b), -p) for p, b in all_priors))
        assert got[key] == (-want[1], pytest.approx(want[0]))


def test_closed_form_equals_the_join(spark):
    rng = random.Random(3)
    boxes = [(i, (x := rng.choice([rng.randint(-300, 300), rng.uniform(-90, 300)]), y := rng.uniform(-90, 400), x + rng.choice([0.0, rng.randint(1, 300)]), y + rng.uniform(0, 300))) for i in range(300)]
    boxes = [(i, tuple(map(float, b))) for i, b in boxes]
    frame = spark.createDataFrame(boxes, f"id int, box {BOX}")
    grid = priors.with_boxes(priors.prior_grid(spark), SIDES)
    all_priors = [(r.prior_id, tuple(r.box)) for r in grid.collect()]
    got = {r.id: (r.prior_id, r.iou) for r in matching.best_grid_prior(frame, "id", SIDES).collect()}
    assert len(got) > 100
    for key, box in boxes:
        iou, prior = max(((overlap(box, b), -p) for p, b in all_priors))
        assert (key in got) == (iou > 0) and (iou == 0 or got[key][1] == pytest.approx(iou))
        if iou > 0:  # ties within rounding aside
            assert got[key][0] == -prior or overlap(box, dict(all_priors)[got[key][0]]) == pytest.approx(iou, abs=1e-12)
    plan = matching.best_grid_prior(frame, "id", SIDES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_nms_of_one_large_image(spark):
    rows = spark.range(60_000).selectExpr("'a' AS image", "id", "id * 7919 % 1000 AS score", "struct(id % 200 AS x0, id % 170 AS y0, id % 200 + 20 AS x1, id % 170 + 20 AS y1) AS box", "id AS more")
    kept = nms.nms(rows, "image", "id", "score", Fraction(1, 10), keep=("more", "box")).collect()
    assert 20 < len(kept) < 400 and all(r.more == r.id for r in kept)
    boxes = [tuple(r.box) for r in kept]
    assert all(overlap(a, b) <= 0.1 for i, a in enumerate(boxes) for b in boxes[:i])


def test_nms_leaves_unusable_rows_out_and_compares_large_boxes(spark):
    nan, inf, far = float("nan"), float("inf"), 3_000_000_000
    rows = [("a", 1, 5.0, (0.0, 0.0, 2.0, 2.0)), ("a", 2, 4.0, None), ("a", 3, 4.0, (None, 0.0, 1.0, 1.0)), ("a", 4, nan, (0.0, 0.0, 1.0, 1.0)), ("a", 5, 3.0, (nan, 0.0, 1.0, 1.0)), ("a", 6, 3.0, (0.0, 0.0, inf, 1.0))]
    rows += [(None, 7, 1.0, (0.0, 0.0, 1.0, 1.0)), ("a", None, 1.0, (0.0, 0.0, 1.0, 1.0)), ("a", 8, None, (0.0, 0.0, 1.0, 1.0)), ("a", 9, 2.0, (5.0, 5.0, 4.0, 6.0)), ("a", 10, 1.0, (0.0, 0.0, 2.0, 1.9)), ("b", 11, 1.0, (1.0, 1.0, 1.0, 1.0)), ("b", 12, 0.0, (1.0, 1.0, 1.0, 1.0))]
    frame = spark.createDataFrame(rows, f"image string, id int, score double, box {BOX}")
    assert {r.id for r in nms.nms(frame, "image", "id", "score", Fraction(1, 2)).collect()} == {1, 11, 12}
    assert nms.nms(frame.limit(0), "image", "id", "score", Fraction(1, 2)).collect() == []
    large = [("a", i, -i, (0, 0, far, far + i)) for i in range(4)] + [("b", i, -i, (0, 0, 1 << 30, (1 << 30) - i)) for i in range(4)] + [("c", 1, 2, (0, 0, 5, 5)), ("c", 2, 1, (0, 0, far, far)), ("c", 3, 0, (0, 0, far, far - 1))]
    frame = spark.createDataFrame(large, "image string, id int, score int, box struct<x0: bigint, y0: bigint, x1: bigint, y1: bigint>")
    for threshold in (Fraction(1, 2), Fraction(499_999_999, 1_000_000_000)):
        got = sorted((r.image, r.id) for r in nms.nms(frame, "image", "id", "score", threshold).collect())
        assert got == [("a", 0), ("b", 0), ("c", 1), ("c", 2)]


def test_detection_leaves_rows_without_corners_out(spark):
    rows = spark.createDataFrame([("a", 1, [0.0, 1.0], [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0]), ("a", 2, [0.0, 2.0], None), ("a", 3, None, [0.0] * 8), ("a", 4, [0.0, 3.0], [0.0] * 7)], "image string, prior_id int, confidence array<float>, ordered_corners array<float>")
    assert [r.prior_id for r in head.detect(rows, Fraction(1, 2)).collect()] == [1]


def test_assignment_holds_threshold_and_best(spark, truth):
    boxes, frame = truth
    grid = priors.with_boxes(priors.prior_grid(spark), SIDES)
    rows = matching.assign(frame, grid, "id", 0.35).collect()
    counts = {r.prior_id: tuple(r.box) for r in grid.collect()}
    want = {(k, p) for k, b in boxes for p, x in counts.items() if overlap(b, x) >= 0.35}
    assert want <= {(r.id, r.prior_id) for r in rows} and {r.id for r in rows} == {0, 1, 2, 3}


def greedy(rows, limit):
    kept = []
    for _, key, box in sorted(rows, key=lambda r: (-r[0], r[1])):
        if all(overlap(box, k[1]) <= limit for k in kept):
            kept.append((key, box))
    return {k for k, _ in kept}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 30), st.integers(0, 30), st.integers(1, 20)), min_size=1, max_size=30))
def test_nms_matches_greedy_loop(spark, made):
    rows = [(s, i, (float(x), float(y), float(x + n), float(y + n))) for i, (s, x, y, n) in enumerate(made)]
    frame = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in rows], f"image string, score int, id int, box {BOX}")
    got = nms.nms(frame, "image", "id", "score", Fraction(1, 2)).collect()
    want = greedy(rows, 0.5)
    assert {r.id for r in got if r.image == "a"} == want == {r.id for r in got if r.image == "b"}
    again = nms.nms(frame.join(nms.nms(frame, "image", "id", "score", Fraction(1, 2)), ["image", "id"]), "image", "id", "score", Fraction(1, 2))
    assert again.count() == len(got)


def test_margin_ranks_as_probability(spark):
    rows = spark.createDataFrame([([0.1, 0.9],), ([2.0, -1.0],), ([0.0, 0.0],)], "c array<float>")
    got = rows.select(head.margin("c").alias("m"), head.probability("c").alias("p")).orderBy("m").collect()
    assert [r.p for r in got] == sorted(r.p for r in got) and got[1].p == 0.5


def test_detect_flow(spark):
    square = lambda x: [float(v) for v in (x, 0, x + 10, 0, x + 10, 10, x, 10)]
    rows = [("a", 0, [0.0, 2.0], square(0)), ("a", 1, [0.0, 1.0], square(1)), ("a", 2, [0.0, 0.5], square(50)), ("a", 3, [0.0, -5.0], square(90))]
    frame = spark.createDataFrame(rows, head.OUTPUT)
    got = head.detect(frame, Fraction(3, 10), min_margin=0.0).collect()
    assert {r.prior_id for r in got} == {0, 2} and got[0].ordered_corners in (square(0), square(50))
    assert head.outputs(frame).columns == ["image", "prior_id", "confidence", "ordered_corners"]


def test_prior_decoder(spark):
    rows = spark.createDataFrame([([float(v) for v in (-5, -5, 5, -5, 5, 5, -5, 5)], 100.0, 60.0, 32)], "ordered_corners array<float>, cx double, cy double, side int")
    points = rows.select(head.decode("ordered_corners", head.prior_decoder("cx", "cy", "side")).alias("p")).first().p
    assert points == [[84.0, 44.0], [116.0, 44.0], [116.0, 76.0], [84.0, 76.0]]


def test_forward_loads_once_a_task(spark):
    def load():
        def model(batch):
            return pd.DataFrame({"image": batch["image"], "prior_id": 0, "confidence": [[0.0, 1.0]] * len(batch), "ordered_corners": [[0.0] * 8] * len(batch)})

        return model

    rows = head.forward(spark.createDataFrame([("a",), ("b",)], "image string"), load).collect()
    assert {r.image for r in rows} == {"a", "b"}


def test_manifest_check(spark):
    frame = lambda rows: spark.createDataFrame(rows, "name string, shape array<bigint>")
    model = frame([("base.0.weight", [3, 3]), ("regression_headers.0.weight", [24, 8])])
    good = frame([("base.0.weight", [3, 3]), ("regression_headers.0.weight", [12, 8])])
    manifest.check_load(model, good)
    for bad in ([("base.0.weight", [3, 4])], [("base.0.weight", [3, 3]), ("other", [1])], []):
        with pytest.raises(ValueError):
            manifest.check_load(model, frame(bad))


def test_widened_header(spark):
    rows = [("base.0.weight", [3, 3]), ("regression_headers.0.0.weight", [16, 4]), ("regression_headers.0.2.weight", [12, 16]), ("regression_headers.0.2.bias", [12]), ("regression_headers.3.weight", [12, 8])]
    got = {r.name: (r.shape, r.reinitialise) for r in manifest.widen_header(spark.createDataFrame(rows, "name string, shape array<bigint>")).collect()}
    assert got == {"base.0.weight": ([3, 3], False), "regression_headers.0.0.weight": ([16, 4], False), "regression_headers.0.2.weight": ([24, 16], True), "regression_headers.0.2.bias": ([24], True), "regression_headers.3.weight": ([24, 8], True)}


def test_header_reshape(spark):
    rows = spark.createDataFrame([(1, [float(i) for i in range(16)])], "cell int, header array<double>")
    got = {r.anchor: r["values"] for r in manifest.header_reshape(rows).collect()}
    assert got == {0: [float(i) for i in range(8)], 1: [float(i) for i in range(8, 16)]}


def test_splits_and_names(spark):
    rows = spark.range(5000).select(dataset.assign_split("id", 80, 10).alias("split"), "id")
    share = {r.split: r["count"] / 5000 for r in rows.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["val"] - 0.1) < 0.03
    assert rows.select(dataset.image_name(F.lit("train"), F.lit(0)).alias("n")).first().n == "images/train_0000000.jpg"


def test_polygons(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    shape = lambda points: {"label": "qrcode", "shape_type": "polygon", "points": points}
    schema = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
    rows = [("a", 4, 4, [shape(square[::-1])]), ("b", 4, 4, [shape(square), shape(square)]), ("c", 4, 4, [shape(square[:3])]), ("d", 4, 4, []), ("e", 4, 4, None)]
    good, bad = dataset.from_polygons(spark.createDataFrame(rows, schema))
    assert [(r.image, r.corners) for r in good.collect()] == [("a", square[::-1])]
    assert {r.imagePath: r.reject_reason for r in bad.collect()} == {"b": "not one polygon", "c": "not four finite points", "d": "not one polygon", "e": "not one polygon"}


def test_evaluation(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    truth = spark.createDataFrame([("a", square), ("b", square)], "image string, corners array<array<double>>")
    found = spark.createDataFrame([("a", [[x + 3, y + 4] for x, y in square])], "image string, corners array<array<double>>")
    row = dataset.evaluate(found, truth).first()
    assert (row.n, row.n_found, row.mean_error) == (2, 1, 5.0)
