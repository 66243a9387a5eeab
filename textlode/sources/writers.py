"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.functions.text import BLANK, escape_lines
from textlode.sources.readers import CSV_NULL


def write_csv(df: DataFrame, path: str) -> None:
    """CSV of one row a line that `read_csv(own=True)` reads back as it was: blanks, line breaks, empty texts and nulls."""
    df = df.withColumns({f.name: escape_lines(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"})
    writer = df.write.option("nullValue", CSV_NULL).option("emptyValue", "")
    writer = writer.mode("overwrite").option("header", "true").option("escape", '"').option("quoteAll", "true")
    writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, for tuning results."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_by_category(df: DataFrame, category_col: str, path: str) -> None:
    """Gzip JSON lines, one folder per category, as `read_json_lines(by="folder")` reads them."""
    df.write.mode("overwrite").partitionBy(category_col).option("compression", "gzip").json(path)


def write_label_lines(df: DataFrame, path: str, label_col: str = "label", text_col: str = "text") -> None:
    """Lines `label text` in latin-1; blanks and line breaks in the text become one space."""
    text = F.regexp_replace(text_col, f"{BLANK}+", " ")
    line = df.select(F.concat(label_col, F.lit(" "), text).alias("line"))
    writer = line.write.mode("overwrite").option("sep", "\u0001").option("quote", "\u0000")
    writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option(
        "encoding", "ISO-8859-1"
    ).csv(path)
