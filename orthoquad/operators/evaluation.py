"""Evaluation of detections by score: one-to-one assignment per image, then precision and recall over all images.

A prediction takes the free truth of its image that it overlaps most, if by
``threshold`` or more; predictions come by falling score, so a better one goes
first.  The assignment is made image by image, and only between predictions and
truths that do overlap so far.  Precision and recall follow from the number of
hits among the predictions with a score of at least that of a row, over all
images.  That running count is made in two passes: predictions are dealt into
ranges of the score and counted there, the few counts of ranges are summed, and
each row adds the sum of the ranges before to its own place in its range.  No
task sees all rows.

Predictions of one score stand or fall together: all rows of a score have the
counts at its end.  Rows that are null in image, id, score or box, or not finite,
take no part; truths so in image, id or box neither.  Images without a truth
have false hits only; images without a prediction count in recall.  Ties of
score go to the smaller id, ties of overlap to the smaller truth.  Without
predictions the curve is empty and the average precision 0; without truths it is
null.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.shared import keep_to_end, shared_path
from .nms import usable
from .numbering import ROW_BITS


def overlaps(predicted: DataFrame, truth: DataFrame, threshold: Fraction, box: str = "box", image: str = "image") -> DataFrame:
    """Pairs of an image with IoU of ``threshold`` or more (n/d, as d * I >= n * (A + B - I)): _image, _p, _score, _t and _iou."""
    p = predicted.select(F.col(image).alias("_image"), F.col("prediction_id").alias("_p"), F.col("score").alias("_score"), F.col(box).alias("_a"))
    t = truth.select(F.col(image).alias("_image"), F.col("truth_id").alias("_t"), F.col(box).alias("_b"))
    pairs = p.join(t, "_image").withColumn("_i", g.intersection("_a", "_b")).withColumn("_u", g.box_area("_a") + g.box_area("_b") - F.col("_i"))
    near = pairs.where((F.col("_i") > 0) & (F.lit(threshold.denominator) * F.col("_i") >= F.lit(threshold.numerator) * F.col("_u")))
    return near.select("_image", "_p", "_score", "_t", (F.col("_i") / F.col("_u")).alias("_iou"))


def assign(predicted: DataFrame, truth: DataFrame, threshold: Fraction, box: str = "box", image: str = "image") -> DataFrame:
    """Each usable prediction: image, prediction_id, score and truth_id, null for a false hit.

    Pairs come by image, and within one by score and overlap; only the ids that
    an image has assigned so far are held.
    """
    sound = predicted.where(usable(image, "prediction_id", "score", box))
    pairs = overlaps(sound, truth.where(usable_truth(image, box)), threshold, box, image)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    dealt = pairs.withColumn("_key", F.xxhash64("_image")).repartition("_image").sortWithinPartitions("_image", F.desc("_score"), "_p", F.desc("_iou"), "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given, taken = None, set(), set()
        for batch in batches:
            keep = []
            for key, p, t in zip(*(batch.column(c).to_pylist() for c in ("_key", "_p", "_t")), strict=True):
                if key != now:
                    now, given, taken = key, set(), set()
                free = p not in given and t not in taken
                if free:
                    given.add(p), taken.add(t)
                keep.append(free)
            yield batch.select(["_image", "_p", "_t"]).filter(pa.array(keep, pa.bool_()))

    hits = dealt.mapInArrow(run, f"_image {kinds['_image']}, _p {kinds['_p']}, _t {kinds['_t']}")
    found = hits.select(F.col("_image").alias(image), F.col("_p").alias("prediction_id"), F.col("_t").alias("truth_id"))
    return sound.select(image, "prediction_id", "score").join(found, [image, "prediction_id"], "left")


def usable_truth(image: str, box: str) -> Column:
    """As ``usable``, for rows without a score."""
    return usable(image, "truth_id", "truth_id", box)


def curve(assigned: DataFrame, truths: int) -> DataFrame:
    """Per distinct score: score, n (predictions of at least that), hits, precision, recall and gain, the recall that the score adds.

    Scores are counted once before they are ordered, so a hot score is one row.
    """
    spark = assigned.sparkSession
    counts = assigned.groupBy("score").agg(F.count("*").alias("_n"), F.count("truth_id").alias("_h"))
    path = keep_to_end(spark, shared_path(spark, "curve"))
    order = F.desc("score")
    counts.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", ROW_BITS))
    # one row per range, of which there are as many as shuffle partitions
    sums = placed.groupBy("_range").agg(F.sum("_n").alias("_sn"), F.sum("_h").alias("_sh"))
    of = sums.select(F.col("_range").alias("_of"), F.col("_sn").alias("_on"), F.col("_sh").alias("_oh"))
    before = sums.join(F.broadcast(of), F.col("_of") < F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("_on"), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_oh"), F.lit(0)).alias("_bh"))
    own = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({"_rn": F.sum("_n").over(own), "_rh": F.sum("_h").over(own)})
    summed = inside.join(before, "_range").select("score", (F.col("_rn") + F.col("_bn")).alias("n"), (F.col("_rh") + F.col("_bh")).alias("hits"), F.col("_h").alias("gain"))
    share = lambda c: (F.col(c) / F.lit(truths) if truths else F.lit(None).cast("double")).alias(c if c == "gain" else "recall")
    return summed.select("score", "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), share("hits"), share("gain"))


def average_precision(points: DataFrame) -> DataFrame:
    """One row, average_precision: precision by the recall that each score adds; null without truths.  Nothing is ordered again."""
    product = F.col("precision") * F.col("gain")
    return points.agg(F.when(F.count("*") == 0, 0.0).otherwise(F.sum(product)).alias("average_precision"))


def evaluate(predicted: DataFrame, truth: DataFrame, threshold: Fraction, box: str = "box", image: str = "image") -> tuple[DataFrame, DataFrame]:
    """The precision-recall curve by score, and the average precision.

    ``predicted`` has image, prediction_id, score and box; ``truth`` image,
    truth_id and box; ids are unique within an image.
    """
    spark = predicted.sparkSession
    path = keep_to_end(spark, shared_path(spark, "assigned"))
    assign(predicted, truth, threshold, box, image).write.parquet(path)
    assigned = spark.read.parquet(path)
    truths = truth.where(usable_truth(image, box)).count()
    points = curve(assigned, truths)
    return points, average_precision(points)
