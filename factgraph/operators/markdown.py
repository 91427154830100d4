"""Heading-based chunking with window functions (no Python).

Approximates CommonMark: ATX and setext headings outside fences split; headings in quotes and lists do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def chunk(docs: DataFrame, id_col: str = "document_id", text_col: str = "text", tokens=T.token_estimate) -> DataFrame:
    """``document_id``, ``sequence_number``, ``section_path``, ``heading``, ``content``, ``normalized_content``, ``chunk_checksum``, ``token_estimate``.

    ``tokens`` counts the tokens of a chunk's text: an estimate, or ``token_counter`` of a vocabulary. One document's lines are in one task, as a chunk needs the headings before it; documents are independent.
    """
    line, doc = F.col("line"), Window.partitionBy(id_col).orderBy("pos")
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    fence = F.regexp_like(line, F.lit(r"^ {0,3}(```|~~~)"))
    lines = lines.withColumn("fence", fence).withColumn("inside", (F.sum(fence.cast("int")).over(doc) % 2 == 1) | fence)
    blank_before = F.coalesce(F.trim(F.lag("line").over(doc)) == "", F.lit(True))
    under = F.lead("line").over(doc)
    atx = ~F.col("inside") & F.regexp_like(line, F.lit(r"^ {0,3}#{1,6}([ \t]|$)"))
    plain = ~F.col("inside") & (F.trim(line) != "") & ~atx & ~F.regexp_like(line, F.lit(r"^( {4}| {0,3}([>*+-]|[0-9]+[.)]) )"))
    setext = plain & blank_before & F.coalesce(F.regexp_like(under, F.lit(r"^ {0,3}(=+|-+)[ \t]*$")), F.lit(False))
    level = F.when(atx, F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})", 1))).when(setext, F.when(F.ltrim(under).startswith("="), 1).otherwise(2))
    title = F.when(atx, F.trim(F.regexp_replace(F.regexp_replace(line, r"^ {0,3}#{1,6}[ \t]*", ""), r"[ \t]+#+[ \t]*$", ""))).when(setext, F.trim(line))
    lines = lines.withColumn("level", level).withColumn("title", title)
    lines = lines.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(doc))
    # A level is on the path where its last heading came after the last heading of a higher rank.
    for k in range(1, 7):
        lines = lines.withColumn(f"p{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(doc)).withColumn(f"r{k}", F.max(F.when(F.col("level") < k, F.col("pos"))).over(doc))
    heads = F.array_compact(F.array(*(F.when(F.col(f"p{k}.pos") > F.coalesce(f"r{k}", F.lit(-1)), F.col(f"p{k}.title")) for k in range(1, 7))))
    lines = lines.withColumn("path", F.when(F.size(heads) > 0, F.array_join(heads, ">")).otherwise("Document"))
    parts = lines.groupBy(id_col, "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("raw"),
        F.max_by("path", "pos").alias("section_path"), F.min_by("title", "pos").alias("heading"),
    )
    parts = parts.withColumn("content", T.trim_control(F.col("raw"))).where("content != ''").withColumn("normalized_content", T.normalize_chunk(F.col("raw")))
    order = Window.partitionBy(id_col).orderBy("section")
    return parts.select(
        id_col, F.row_number().over(order).alias("sequence_number"), "section_path", F.nullif("heading", F.lit("")).alias("heading"), "content", "normalized_content",
        T.chunk_checksum(F.col("section_path"), F.col("normalized_content")).alias("chunk_checksum"), tokens(F.col("raw")).alias("token_estimate"),
    )
