"""Readers. Each returns a DataFrame; corpus readers return at least text and label."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.functions import text as T
from textlode.operators.clean import drop_nulls, rename_columns, require_columns, strip_messages

JSON_NAME = r"([^/]+)\.json(?:\.gz)?$"
CORRUPT = "_corrupt_record"
# How `write_csv` writes null. Escaped texts have no single backslash before N.
CSV_NULL = "\\N"


def _path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str | None = None, by: str = "file") -> DataFrame:
    """JSON lines, plain or gzip, with column main_category.

    by="file": one file per category, named after it. by="folder": one folder of files per category, the better layout
    for large sources, as a gzip file cannot be split. A line that is not JSON is kept in _corrupt_record if the
    schema has that column. Give a schema to save the pass that infers it.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if by == "folder":
        reader = reader.option("recursiveFileLookup", "true")
    if schema:
        reader = reader.schema(schema)
    df = reader.json(paths)
    path = F.col("_metadata.file_path")
    if by == "file":
        category = F.regexp_extract(path, JSON_NAME, 1)
    else:
        category = F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^[^=]*=", "")
    return df.withColumn("main_category", F.url_decode(category))


def _place(path: str) -> str:
    """A pattern for the files of a path, without scheme and host: the path itself or what lies below it."""
    plain = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "", path).rstrip("/")
    begin = "^" if plain.startswith("/") else "(?:^|/)"
    parts = [{"*": "[^/]*", "?": "[^/]"}.get(x) or re.escape(x) for x in re.sub("^[.]/", "", plain)]
    return begin + "".join(parts).replace("//", "/") + "(?:/|$)"


def read_sources(
    spark: SparkSession, paths: dict[str, str], schema: str
) -> tuple[DataFrame | None, DataFrame]:
    """Read several JSON-lines sources in one scan; a missing one is reported, not fatal.

    Returns the rows, with column main_category, and (source, status, records, bad_lines) per source. `schema` names
    the fields to read; lines that are not JSON are counted as bad and left out of the rows. A row's source is known from its file's path; where
    one source lies within another, the longer path counts. A path may hold the wildcards * and ?.
    """
    present = {name: path for name, path in paths.items() if _path_exists(spark, path)}
    listed = F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in paths]), F.array(*[F.lit(n in present) for n in paths])
    )).alias("source", "found")
    sources = spark.range(1).select(listed)
    if not present:
        status = sources.select(
            "source", F.lit("missing").alias("status"), F.lit(0).cast("bigint").alias("records"),
            F.lit(0).cast("bigint").alias("bad_lines"),
        )
        return None, status
    reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT)
    file = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    source = F.lit(None).cast("string")
    for name, path in sorted(present.items(), key=lambda x: len(x[1])):
        source = F.when(file.rlike(_place(path)), F.lit(name)).otherwise(source)
    frame = reader.json(list(dict.fromkeys(present.values()))).withColumn("main_category", source)
    bad = F.col(CORRUPT).isNotNull()
    counts = frame.groupBy(F.col("main_category").alias("source")).agg(
        # Counting the whole record makes the scan parse its fields, which is what finds bad lines.
        F.count(F.when(~bad, F.struct(*[c for c in frame.columns if c != CORRUPT]))).alias("records"),
        F.count_if(bad).alias("bad_lines"),
    )
    status = sources.join(counts, "source", "left").select(
        "source",
        F.when(F.col("found"), "read").otherwise("missing").alias("status"),
        F.coalesce("records", F.lit(0)).cast("bigint").alias("records"),
        F.coalesce("bad_lines", F.lit(0)).cast("bigint").alias("bad_lines"),
    )
    return frame.where(~bad).drop(CORRUPT), status


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str | None = None, multiline: bool = False, own: bool = False
) -> DataFrame:
    """CSV with header and quoted fields.

    A file is split over tasks, one row a line. `multiline` reads line breaks inside fields, one task a file. `own` reads what `write_csv`
    wrote: escaped line breaks, and null apart from empty.
    """
    reader = spark.read.option("header", "true").option("multiLine", str(multiline).lower()).option("escape", '"')
    if own:
        reader = reader.option("nullValue", CSV_NULL)
    if schema:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", "true")
    df = reader.csv(path)
    if own:
        df = df.withColumns({f.name: T.unescape_lines(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"})
    return df


def read_csv_corpus(spark: SparkSession, path: str | list[str], schema: str | None = None, **options) -> DataFrame:
    """A CSV of reviews with columns text and label (or their raw names), rows without either dropped."""
    return drop_nulls(require_columns(rename_columns(read_csv(spark, path, schema, **options))))


def read_label_lines(spark: SparkSession, paths: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """(label, text) from lines `label text`; lines without a blank are left out.

    Any encoding that Spark decodes and whose line ends are single bytes. Bytes that UTF-8 does not allow become U+FFFD.
    """
    # The text source hands bytes on as they are, whatever they encode.
    raw = spark.read.text(paths)
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    lines = raw.select((F.make_valid_utf8("value") if utf8 else F.decode(F.col("value").cast("binary"), encoding)).alias("line"))
    parts = F.split(T.strip("line"), " ", 2)
    return lines.select(parts.alias("p")).where(F.size("p") == 2).select(
        F.col("p")[0].alias("label"), F.col("p")[1].alias("text")
    )


def read_label_files(spark: SparkSession, files: dict[str, str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Several label-line files as one corpus (label, text, origin)."""
    out = None
    for origin, path in files.items():
        part = read_label_lines(spark, path, encoding).withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part)
    return out


def _named(names: list[str] | None) -> str:
    """Glob for folders of these names, plain or as `key=name`."""
    return "{" + ",".join(f"{n},*={n}" for n in names) + "}" if names else "*"


def read_newsgroups(
    spark: SparkSession,
    root: str,
    subset: str | None = None,
    categories: list[str] | None = None,
    remove=("headers", "footers", "quotes"),
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """(text, label, subset, message) from root/<subset>/<class>/<message>, one file per message.

    Subset and categories pick folders, so other files are not opened. Folders may be named `key=value`.
    """
    folders = f"{root}/{_named([subset] if subset in ('train', 'test') else None)}/{_named(categories)}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    # Spark names files with a scheme, which the root may write in another way or leave out.
    below = re.sub(r"^\w+:(//[^/]*)?", "", root.rstrip("/"))
    place = F.split(F.element_at(F.split("path", rf"\Q{below}/\E"), -1), "/")

    def part(i):
        return F.url_decode(F.regexp_replace(place[i], "^[^=/]*=", ""))

    messages = files.select(
        F.decode("content", encoding).alias("text"),
        part(1).alias("label"),
        part(0).alias("subset"),
        part(2).alias("message"),
    )
    return strip_messages(messages, "text", remove)


def head_slice(df: DataFrame, order_by: str, n: int = 20_000) -> DataFrame:
    """The first n rows by a key."""
    return df.orderBy(order_by).limit(n)


# Source contract: any function of (spark, **options) that returns text and label.
CORPORA: dict[str, Callable[..., DataFrame]] = {
    "reviews_json": lambda spark, **o: drop_nulls(require_columns(rename_columns(read_json_lines(spark, **o)))),
    "reviews_csv": read_csv_corpus,
    "label_lines": read_label_files,
    "newsgroups": read_newsgroups,
}


def load_corpus(spark: SparkSession, source: str | Callable[..., DataFrame], **options) -> DataFrame:
    """Load a corpus from a named or a given source and check that it has text and label."""
    read = CORPORA[source] if isinstance(source, str) else source
    return require_columns(read(spark, **options))
