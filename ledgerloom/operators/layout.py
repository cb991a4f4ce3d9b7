"""Words with coordinates: lines, regions, anchors and blocks.

Words have doc_id, x0, y0, x1, y1, text, block, word (position in reading order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import boxes_in_regions


def reading_text(words: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    """Text of each key's words, by rows of three units, then from left to right."""
    order = F.struct(F.floor(F.col("y0") / 3).alias("r"), F.col("x0").alias("x"), F.col("word").alias("w"), F.col("text").alias("t"))
    return words.groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["t"]), " ")).alias(out))


def anchors(words: DataFrame, phrase: str) -> DataFrame:
    """Box of the first occurrence of a phrase of up to a few words in each document: ax0, ay0, ax1, ay1."""
    parts = phrase.upper().split()
    w = Window.partitionBy("doc_id").orderBy("word")
    hit: Column = F.contains(F.upper("text"), F.lit(parts[0]))
    d = words
    for i, p in enumerate(parts[1:], 1):
        d = d.withColumn(f"_t{i}", F.lead("text", i).over(w))
        hit = hit & F.contains(F.upper(f"_t{i}"), F.lit(p))
    last = len(parts) - 1
    d = d.withColumn("_x1", F.lead("x1", last).over(w) if last else F.col("x1")).withColumn("_y1", F.lead("y1", last).over(w) if last else F.col("y1"))
    box = F.struct(F.col("x0").alias("ax0"), F.col("y0").alias("ay0"), F.greatest("x1", "_x1").alias("ax1"), F.greatest("y1", "_y1").alias("ay1"))
    return d.filter(hit).groupBy("doc_id").agg(F.min_by(box, "word").alias("b")).select("doc_id", "b.*")


def value_near(words: DataFrame, phrase: str, where: str, reach: float = 200.0, width: float = 150.0) -> DataFrame:
    """(doc_id, value): text to the ``right`` of or ``below`` the anchor, as far as ``reach``."""
    a = anchors(words, phrase)
    if where == "right":
        r = a.select("doc_id", F.col("ax1").alias("rx0"), (F.col("ay0") - 2).alias("ry0"), (F.col("ax1") + reach).alias("rx1"), (F.col("ay1") + 2).alias("ry1"))
    else:
        r = a.select("doc_id", (F.col("ax0") - 5).alias("rx0"), F.col("ay1").alias("ry0"), (F.col("ax0") + width).alias("rx1"), (F.col("ay1") + reach).alias("ry1"))
    return reading_text(boxes_in_regions(words, r), ["doc_id"], "value")


def region_text(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """(doc_id, text) of one region of every document; a plain filter, as the region is the same for all."""
    w = F.greatest(F.lit(0.0), F.least(F.col("x1"), F.lit(x1)) - F.greatest(F.col("x0"), F.lit(x0)))
    h = F.greatest(F.lit(0.0), F.least(F.col("y1"), F.lit(y1)) - F.greatest(F.col("y0"), F.lit(y0)))
    return reading_text(words.filter(w * h > (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 0.4), ["doc_id"])


def top_blocks(words: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, place, text) of the ``n`` topmost blocks."""
    y = words.groupBy("doc_id", "block").agg(F.min("y0").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda s: s["text"]), " ").alias("text"))
    return y.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "block"))).filter(F.col("place") <= n).select("doc_id", "place", "text")


# Words of headers that name no supplier.
HEADERS = ["DANFE", "NOTA FISCAL", "BOLETO", "COMPROVANTE"]


def supplier_header(words: DataFrame, below: float = 200.0) -> DataFrame:
    """(doc_id, header): the first block near the top that is long enough and no header of a form."""
    b = words.filter(F.col("y1") < below).groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda s: s["text"]), " ").alias("t"))
    known = F.lit(False)
    for h in HEADERS:
        known = known | F.contains(F.upper("t"), F.lit(h))
    return b.filter((F.length("t") > 5) & ~known).groupBy("doc_id").agg(F.min_by("t", "block").alias("header"))


def anchored_lines(words: DataFrame, gap: float = 15.0) -> DataFrame:
    """(doc_id, line, text): a word opens a line if it lies more than ``gap`` below the line's first word.

    The opening word matters, not the word before, so a fold over the sorted words
    of a document decides; a document's words are a bounded list.
    """
    s = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), "x0", "word", "text"))).alias("ws"))
    state = "struct<top: double, n: int, lines: array<int>>"
    fold = F.aggregate("ws", F.lit(None).cast(state), lambda a, w: F.when(a.isNull(), F.struct(w["y"].cast("double").alias("top"), F.lit(1).alias("n"), F.array(F.lit(1)).alias("lines"))).when(F.abs(w["y"] - a["top"]) <= gap, F.struct(a["top"].alias("top"), a["n"].alias("n"), F.concat(a["lines"], F.array(a["n"])).alias("lines"))).otherwise(F.struct(w["y"].cast("double").alias("top"), (a["n"] + 1).alias("n"), F.concat(a["lines"], F.array(a["n"] + 1)).alias("lines"))))
    e = s.select("doc_id", F.inline(F.arrays_zip("ws", fold["lines"].alias("line"))))
    return e.groupBy("doc_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ws.x0", "ws.word", "ws.text"))), lambda x: x["text"]), " ").alias("text"))


def gapped_lines(words: DataFrame, gap: float = 10.0) -> DataFrame:
    """(doc_id, line, text): a word opens a line if it lies ``gap`` or more below the word before."""
    y = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy("doc_id").orderBy("_y", "x0", "word")
    d = words.withColumn("_y", y).withColumn("_n", F.coalesce((F.col("_y") - F.lag("_y").over(w) >= gap).cast("int"), F.lit(1)))
    d = d.withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("doc_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "text"))), lambda x: x["text"]), " ").alias("text"))


def slip_anchors(words: DataFrame) -> DataFrame:
    """(doc_id, field, value): the date below the last 'VENCIMENTO' and the number below the last 'VALOR .. DOCUMENTO' of every document."""
    w = Window.partitionBy("doc_id").orderBy("word")
    d = words.withColumns({"_t1": F.lead("text").over(w), "_t2": F.lead("text", 2).over(w), "_bx0": F.lead("x0", 2).over(w), "_bx1": F.lead("x1", 2).over(w), "_by1": F.lead("y1", 2).over(w)})

    def box(rows: DataFrame, field: str, left: str, right: str, low: str, reach: float) -> DataFrame:
        last = F.max(F.struct("word", F.col(left).alias("l"), F.col(right).alias("r"), F.col(low).alias("y"))).alias("b")
        return rows.groupBy("doc_id").agg(last).select("doc_id", F.lit(field).alias("field"), (F.col("b.l") - 20).alias("rx0"), F.col("b.y").alias("ry0"), (F.col("b.r") + reach).alias("rx1"), (F.col("b.y") + 35).alias("ry1"))

    due = box(d.filter(F.contains(F.upper("text"), F.lit("VENCIMENTO"))), "due", "x0", "x1", "y1", 100)
    said = F.contains(F.upper("text"), F.lit("VALOR")) & F.contains(F.concat_ws(" ", F.upper("_t1"), F.upper("_t2")), F.lit("DOCUMENTO")) & F.col("_t2").isNotNull()
    amount = box(d.filter(said), "amount", "_bx0", "_bx1", "_by1", 80)
    t = reading_text(boxes_in_regions(words, due.unionByName(amount)), ["doc_id", "field"], "t")
    value = F.when(F.col("field") == "due", F.regexp_extract("t", "([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)).otherwise(F.regexp_extract("t", "([0-9.]*[0-9][0-9.]*,?[0-9]*)", 1))
    return t.select("doc_id", "field", value.alias("value")).filter("value <> ''")


def largest_below(words: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, cents): the largest of the first amounts of the blocks that reach below ``share`` of the page's height."""
    h = words.groupBy("doc_id").agg((F.max("y1") * share).alias("cut"))
    b = words.groupBy("doc_id", "block").agg(F.max("y1").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda s: s["text"]), " ").alias("t"))
    v = b.join(h, "doc_id").filter("y > cut").withColumn("cents", F.regexp_replace(F.regexp_extract("t", "[0-9][0-9.]*,[0-9]{2}", 0), "[.,]", "").try_cast("bigint"))
    return v.filter("cents is not null").groupBy("doc_id").agg(F.max("cents").alias("cents"))


def sure_text(words: DataFrame, confidence: str, least: float) -> DataFrame:
    """(doc_id, text): words of at least this confidence in reading order, joined by line breaks."""
    s = words.filter(F.col(confidence) >= least).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "text"))).alias("ws"))
    return s.select("doc_id", F.array_join(F.transform("ws", lambda x: x["text"]), "\n").alias("text"))
