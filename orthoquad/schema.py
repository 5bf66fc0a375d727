"""Record layouts of a dataset of images with one identity-ordered quadrilateral each."""

# Fixed values of the record format.
LABEL = "qrcode"
CORNER_ORDER = ("qr_top_left", "qr_top_right", "qr_bottom_right", "qr_bottom_left")
SPLITS = ("train", "val", "test")
WIDTH, HEIGHT = 240, 320
ANNOTATION = "image STRING, width INT, height INT, label STRING, corners ARRAY<ARRAY<DOUBLE>>, corner_order ARRAY<STRING>"
MANIFEST = "name STRING, shape ARRAY<BIGINT>"
#: The usual polygon file of the LabelMe tool.
LABELME = "imagePath STRING, imageWidth INT, imageHeight INT, shapes ARRAY<STRUCT<label: STRING, shape_type: STRING, points: ARRAY<ARRAY<DOUBLE>>>>"
REJECT = "reject_reason"
