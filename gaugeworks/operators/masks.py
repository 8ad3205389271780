"""Pixel counts of overlapping masks, 64 pixels at a time.

A mask is rows of words, those with pixels only: a word's number and 64 bits. All masks that touch a word meet in one row;
there the first of a side keeps a pixel (and-not of what is taken), and the pixels of two labels are counted as bits of an
and. Rows follow words and masks, never pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("groundtruths", "predictions")


def _fails(test: Column, message: str) -> Column:
    """True where the test holds; an error elsewhere."""
    return F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def _below(k: str) -> str:
    """SQL for a word with its lowest k bits set, k from 0 to 64."""
    return f"if({k} <= 0, 0L, shiftrightunsigned(-1L, cast(64 - {k} AS int)))"


def _words(masks: DataFrame, form: str) -> DataFrame:
    """``word, bits`` and the rest of ``masks``, of masks as lists of ``pixels``, as ``runs`` of (start, length) or as packed ``words``."""
    outside = "a mask has a pixel outside the shape"
    keys = [c for c in masks.columns if c != form]
    if form == "words":
        rows = masks.select(*keys, F.posexplode(form).alias("word", "bits")).where("bits <> 0")
        return rows.where(_fails(F.expr("word < area div 64 or (word = area div 64 and area % 64 > 0 and shiftrightunsigned(bits, cast(area % 64 AS int)) = 0)"), outside))
    if form == "pixels":
        rows = masks.select(*keys, F.explode(form).alias("pixel")).withColumn("pixel", F.col("pixel").cast("long")).where(_fails((F.col("pixel") >= 0) & (F.col("pixel") < F.col("area")), outside))
        rows = rows.select(*keys, F.expr("cast(pixel div 64 AS int)").alias("word"), F.expr("shiftleft(1L, cast(pixel % 64 AS int))").alias("bits"))
        return rows.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))  # combined before the shuffle
    rows = masks.select(*keys, F.inline(form)).where(_fails(F.expr("start >= 0 and length > 0 and start + length <= area"), outside))
    rows = rows.withColumn("end", F.col("start") + F.col("length")).withColumn("word", F.explode(F.sequence(F.expr("cast(start div 64 AS int)"), F.expr("cast((end - 1) div 64 AS int)"))))
    return rows.select(*keys, "word", F.expr(f"{_below('least(64L, end - word * 64L)')} & ~{_below('greatest(0L, start - word * 64L)')}").alias("bits"))


def word_rows(data: DataFrame) -> DataFrame:
    """``datum_uid, area, side, turn, label, word, bits`` of ``uid, height, width, groundtruths, predictions``; each mask has a
    ``label`` and ``pixels``, ``runs`` or ``words``. Raises where a shape isn't positive or a pixel lies outside."""
    area = F.col("height").cast("long") * F.col("width").cast("long")
    sound = data.where(_fails((F.col("height") > 0) & (F.col("width") > 0), "a shape needs two positive sides"))
    out = None
    for k, name in enumerate(SIDES):
        fields = data.schema[name].dataType.elementType.fieldNames()
        (form,) = set(fields) & {"pixels", "runs", "words"}
        masks = sound.select(F.col("uid").alias("datum_uid"), area.alias("area"), F.lit(k).alias("side"), F.posexplode(name).alias("turn", "m")).select("datum_uid", "area", "side", "turn", F.col("m.label").alias("label"), F.col(f"m.{form}").alias(form))
        rows = _words(masks, form).select("datum_uid", "area", "side", "turn", "label", "word", "bits")
        out = rows if out is None else out.union(rows)
    return out


def _first_wins(masks: Column) -> Column:
    """Struct of ``taken`` bits and ``own``: for each label the bits of the sorted masks that are left to it. So what follows goes
    by labels, however many masks touch a word."""
    labels = F.array_distinct(F.transform(masks, lambda m: m["label"]))
    zero = F.lit(0).cast("long")

    def left(label: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            free = m["bits"].bitwiseAND(F.bitwise_not(acc["taken"]))
            mine = F.when(m["label"].eqNullSafe(label), free).otherwise(zero)
            return F.struct(acc["taken"].bitwiseOR(m["bits"]).alias("taken"), acc["bits"].bitwiseOR(mine).alias("bits"))

        return F.aggregate(masks, F.struct(zero.alias("taken"), zero.alias("bits")), step, lambda acc: acc["bits"])

    taken = F.aggregate(masks, zero, lambda acc, m: acc.bitwiseOR(m["bits"]))
    return F.struct(taken.alias("taken"), F.transform(labels, lambda x: F.struct(x.alias("label"), left(x).alias("bits"))).alias("own"))


def counts_of_words(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """``datum_uid, gt_label, pd_label, count`` (null: background) of ``word_rows``; ``shapes``: ``datum_uid, area``.

    A word's row holds the masks that touch its 64 pixels. Background is the area less what is counted.
    """
    met = rows.groupBy("datum_uid", "word").agg(F.array_sort(F.collect_list(F.struct("side", "turn", "label", "bits"))).alias("m"))
    of = lambda k: F.filter("m", lambda m: m["side"] == k)
    met = met.select("datum_uid", _first_wins(of(0)).alias("g"), _first_wins(of(1)).alias("p"))
    none = F.lit(None).cast("string")

    def cell(gt: Column, pd: Column, bits: Column) -> Column:
        return F.struct(gt.alias("gt_label"), pd.alias("pd_label"), F.bit_count(bits).cast("long").alias("count"))

    pairs = F.flatten(F.transform("g.own", lambda g: F.transform("p.own", lambda p: cell(g["label"], p["label"], g["bits"].bitwiseAND(p["bits"])))))
    alone_g = F.transform("g.own", lambda g: cell(g["label"], none, g["bits"].bitwiseAND(F.bitwise_not(F.col("p.taken")))))
    alone_p = F.transform("p.own", lambda p: cell(none, p["label"], p["bits"].bitwiseAND(F.bitwise_not(F.col("g.taken")))))
    covered = cell(none, none, F.col("g.taken").bitwiseOR(F.col("p.taken")))
    covered = covered.withField("count", -covered["count"])
    cells = met.select("datum_uid", F.inline(F.filter(F.concat(pairs, alone_g, alone_p, F.array(covered)), lambda c: c["count"] != 0)))
    whole = shapes.select("datum_uid", none.alias("gt_label"), none.alias("pd_label"), F.col("area").alias("count"))
    return cells.union(whole).groupBy("datum_uid", "gt_label", "pd_label").agg(F.sum("count").alias("count")).where("count > 0")


def mask_counts(data: DataFrame) -> DataFrame:
    """The pair table of segmentation from masks as in ``word_rows``; the first mask of a side keeps a pixel that several hold.
    A datum without masks is all background."""
    shapes = data.select(F.col("uid").alias("datum_uid"), (F.col("height").cast("long") * F.col("width").cast("long")).alias("area"))
    return counts_of_words(word_rows(data), shapes)
