"""Markdown into chunks: sections between headings, with the trail of headings above them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import HEADING, trim_space


def lines_of(text: Column) -> Column:
    """The lines of a text, without line ends; a final line end starts no line."""
    return F.split(F.regexp_replace(text, r"\r?\n\r?\z|\r\z", ""), "\r?\n", -1)


def split_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, breadcrumb, content, line_start, line_end)``: one row for each section with content.

    A section begins at a heading, also inside fenced code, and its content leaves the heading out;
    its breadcrumb joins the headings it stands under, ``(top)`` before the first.  ``line_start``
    is the heading's line, ``line_end`` that of the next heading (of the last line for the last
    section).  Null and empty texts give no rows; repeated rows give repeated rows.

    Everything happens inside the row, so the texts are not shuffled.
    """
    lines = docs.select(F.col(id_col), F.col(text_col).alias("_text")).filter("_text is not null and _text != ''").select(id_col, lines_of(F.col("_text")).alias("_lines"))

    def heading(line: Column, k: Column) -> Column:
        return F.struct(
            (k + 1).cast("int").alias("line"),
            F.length(F.regexp_extract(line, HEADING, 1)).alias("level"),
            trim_space(F.regexp_extract(line, HEADING, 2)).alias("title"),
        )

    top = F.struct(F.lit(0).alias("line"), F.lit(0).alias("level"), F.lit("").alias("title"))
    marked = lines.withColumn("_starts", F.concat(F.array(top), F.filter(F.transform("_lines", heading), lambda h: h["level"] > 0)))
    starts, size = F.col("_starts"), F.size("_lines")

    def under(state: Column, h: Column) -> Column:
        # the titles that a section stands under, by level, and the trails of the sections so far
        titles = F.transform(state["titles"], lambda title, i: F.when(i + 1 < h["level"], title).when(i + 1 == h["level"], h["title"]).otherwise(""))
        joined = F.array_join(F.filter(titles, lambda title: title != ""), " > ")
        return F.struct(titles.alias("titles"), F.concat(state["trails"], F.array(F.when(joined == "", "(top)").otherwise(joined))).alias("trails"))

    nothing = F.struct(F.array_repeat(F.lit(""), 6).alias("titles"), F.array(F.lit("(top)")).alias("trails"))
    marked = marked.withColumn("_trails", F.aggregate(F.slice("_starts", 2, F.size("_starts")), nothing, under, lambda state: state["trails"]))

    def section(start: Column, k: Column) -> Column:
        last = k + 1 >= F.size(starts)
        following = F.when(last, size + 1).otherwise(F.get(starts, k + 1)["line"])
        content = F.slice(F.col("_lines"), start["line"] + 1, F.greatest(following - start["line"] - 1, F.lit(0)))
        return F.struct(
            F.get("_trails", k).alias("breadcrumb"),
            trim_space(F.array_join(content, "\n")).alias("content"),
            F.greatest(start["line"], F.lit(1)).alias("line_start"),
            F.when(last, size).otherwise(following).alias("line_end"),
        )

    sections = marked.select(id_col, F.explode(F.transform(starts, section)).alias("_s"))
    return sections.select(id_col, "_s.breadcrumb", "_s.content", "_s.line_start", "_s.line_end").filter("content != ''")
