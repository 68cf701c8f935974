"""Images and their layout: gates, first-seen copies, rows on the page, table grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

MIN_WIDTH, MIN_HEIGHT, MIN_TEXT, VLM_WIDTH, VLM_HEIGHT, ROW_GAP = 200, 100, 2, 500, 200, 1.5


def ocr_gate(width, height, text, min_width: int = MIN_WIDTH, min_height: int = MIN_HEIGHT, min_text: int = MIN_TEXT) -> Column:
    """struct<status,reason>: images too small or with too little text are excluded, others applied."""
    w, h, t = F.col(width), F.col(height), F.col(text)
    reason = F.when(F.coalesce((w < min_width) | (h < min_height), F.lit(True)), "image_too_small").when(F.length(F.coalesce(t, F.lit(""))) < min_text, "ocr_text_too_short")
    return F.struct(F.when(reason.isNull(), "applied").otherwise("excluded").alias("status"), reason.alias("reason"))


def model_gate(width, height, image_type, min_width: int = VLM_WIDTH, min_height: int = VLM_HEIGHT) -> Column:
    """struct<image_type,status,keeps_text>: small images aren't classified; the text of logos and photos goes."""
    small = F.coalesce((F.col(width) < min_width) | (F.col(height) < min_height), F.lit(True))
    t = F.when(small, "unclassified").otherwise(F.coalesce(image_type, F.lit("other")))
    return F.struct(t.alias("image_type"), F.when(small, "skipped").otherwise("applied").alias("status"), (~small & ~t.isin("logo", "photo")).alias("keeps_text"))


def layout_items(images: DataFrame) -> DataFrame:
    """(record_id, text, x, y, height, row_index, item_no) of every box of the stored layouts."""
    r = images.select("record_id", F.explode("spatial_layout.layout_rows").alias("r"))
    i = r.select("record_id", F.col("r.row_index").alias("row_index"), F.posexplode("r.items").alias("item_no", "i"))
    b = "i.bbox."
    return i.select("record_id", F.col("i.text").alias("text"), ((F.col(b + "x_left") + F.col(b + "x_right")) / 2).alias("x"), ((F.col(b + "y_top") + F.col(b + "y_bottom")) / 2).alias("y"), (F.col(b + "y_bottom") - F.col(b + "y_top")).alias("height"), "row_index", "item_no")


def layout_rows(items: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """(record_id, row_no, text): boxes in rows. Boxes in the order of y and x begin a new row where y is
    more than gap times the median height below the box before; in a row they go by x."""
    order = W.partitionBy("record_id").orderBy("y", "x", "text")
    limit = items.groupBy("record_id").agg((F.median("height") * gap).alias("limit"))
    d = items.join(limit, "record_id").withColumn("jump", F.coalesce((F.col("y") - F.lag("y").over(order)) > F.col("limit"), F.lit(False)).cast("int"))
    rows = d.withColumn("row_no", F.sum("jump").over(order) + 1)
    # the boxes of one row of one page
    return rows.groupBy("record_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda v: v["text"]), " | ").alias("text"))


def largest_image(images: DataFrame, page: int | None = None) -> DataFrame:
    """(doc_id, record_id, area) of the largest image per document; with a page, of that page if it has any."""
    area = F.coalesce(F.col("width") * F.col("height"), F.lit(0)).cast("long")
    best = lambda d, n: d.groupBy("doc_id").agg(F.max(F.struct(area.alias("area"), (-F.col("record_id")).alias("neg"))).alias(n))
    everywhere = best(images, "a")
    if page is None:
        return everywhere.select("doc_id", (-F.col("a.neg")).alias("record_id"), F.col("a.area").alias("area"))
    here = best(images.where(F.col("page_number") == page), "b")
    j = everywhere.join(here, "doc_id", "left").withColumn("c", F.coalesce("b", "a"))
    return j.select("doc_id", (-F.col("c.neg")).alias("record_id"), F.col("c.area").alias("area"))


def line_runs(strong: np.ndarray, least: int = 2) -> list[float]:
    """Centres of the runs of true values that are `least` long at least."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], strong.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    return [(a + b - 1) / 2 for a, b in zip(starts, ends) if b - a >= least]


def has_grid(gray: np.ndarray, dark: int = 128, share: float = 0.5, lines: int = 2, least: int = 2) -> bool:
    """Whether a grey image shows a table: `lines` dark lines at least in either direction, each over `share`
    of the image and `least` pixels thick."""
    if gray.size == 0:
        return False
    black = gray < dark
    return all(len(line_runs(black.mean(axis=a) > share, least)) >= lines for a in (0, 1))
