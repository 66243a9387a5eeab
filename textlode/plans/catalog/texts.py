"""Projections, filters and set operations on the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.functions.text import explode_words
from textlode.operators import clean
from textlode.operators.labels import encode_labels
from textlode.operators.pairs import text_with_empty
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import documents, embeddings, query, rated_documents, table


@query("p1_rename_columns", "SELECT doc_id AS id, text, lang AS label, n_chars AS rating FROM documents")
def p1(spark, folder):
    raw = table(spark, folder, "documents").toDF("id", "reviewText", "main_category", "source", "overall")
    return clean.rename_columns(raw).select("id", "text", "label", "rating")


@query("p2_require_columns", "SELECT doc_id AS id, lang AS label, length(text) AS chars FROM documents")
def p2(spark, folder):
    docs = clean.require_columns(documents(spark, folder))
    return docs.select("id", "label", F.length("text").cast("bigint").alias("chars"))


@query(
    "p3_drop_nulls",
    "SELECT d.doc_id AS id, d.text, l.quality AS label FROM documents d JOIN labels l USING (doc_id) "
    "WHERE d.text IS NOT NULL AND l.quality IS NOT NULL",
)
def p3(spark, folder):
    rated = rated_documents(spark, folder).select("id", "text", F.col("rating").alias("label"))
    return clean.drop_nulls(rated)


@query(
    "p4_trim_drop_blank",
    r"SELECT doc_id AS id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM documents "
    r"WHERE doc_id % 7 <> 0 AND regexp_replace(text, '\s+', '', 'g') <> ''",
)
def p4(spark, folder):
    # Every text gets blanks around it; every seventh is nothing but blanks.
    docs = documents(spark, folder)
    padded = F.when(F.col("id") % 7 == 0, F.lit(" \t \n")).otherwise(F.concat(F.lit("\n  "), "text", F.lit("\t ")))
    return clean.trim_text(docs.withColumn("text", padded)).select("id", "text")


@query("p5_keep_categories", "SELECT doc_id AS id, lang AS label FROM documents WHERE lang IN ('de', 'fr')")
def p5(spark, folder):
    return clean.keep_categories(documents(spark, folder), ["de", "fr"]).select("id", "label")


@query(
    "p6_holdout_classes",
    "SELECT doc_id AS id, lang AS label, CASE WHEN lang = 'es' THEN 'held' ELSE 'kept' END AS part FROM documents",
)
def p6(spark, folder):
    docs = documents(spark, folder).select("id", "label")
    held = ["es", "no such class"]
    kept = clean.drop_categories(docs, held).withColumn("part", F.lit("kept"))
    return kept.unionByName(clean.keep_categories(docs, held).withColumn("part", F.lit("held")))


MESSAGE = "'From: ' || source || chr(10) || 'Subject: ' || lang || chr(10) || chr(10) || '> quoted' || chr(10) || text || chr(10) || '--' || chr(10) || source"


@query(
    "p7_strip_messages",
    rf"""WITH messages AS (SELECT doc_id AS id, {MESSAGE} AS text FROM documents),
    bodies AS (SELECT id, CASE WHEN strpos(text, chr(10) || chr(10)) > 0
        THEN substr(text, strpos(text, chr(10) || chr(10)) + 2) ELSE '' END AS text FROM messages),
    split AS (SELECT id, text, string_split(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10)) AS lines
        FROM bodies),
    breaks AS (SELECT id, text, lines, list_max(list_filter(range(len(lines)),
        lambda i: regexp_matches(lines[i + 1], '^\s*-*\s*$'))) AS last FROM split),
    cut AS (SELECT id, CASE WHEN last > 0 THEN array_to_string(lines[1:last], chr(10)) ELSE text END AS text FROM breaks)
    SELECT id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l,
        '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)')), chr(10)) AS text FROM cut""",
)
def p7(spark, folder):
    docs = table(spark, folder, "documents")
    message = F.concat_ws(
        "\n",
        F.concat(F.lit("From: "), "source"),
        F.concat(F.lit("Subject: "), "lang"),
        F.lit(""),
        F.lit("> quoted"),
        "text",
        F.lit("--"),
        "source",
    )
    return clean.strip_messages(docs.select(F.col("doc_id").alias("id"), message.alias("text")))


@query("p8_column_subset", "SELECT text, lang AS label FROM documents")
def p8(spark, folder):
    return documents(spark, folder).select("text", "label")


@query("p9_char_length", "SELECT doc_id AS id, length(text) AS char_length FROM documents")
def p9(spark, folder):
    lengths = clean.add_lengths(documents(spark, folder))
    return lengths.select("id", F.col("char_length").cast("bigint").alias("char_length"))


@query("p10_word_count", f"SELECT doc_id AS id, len({sql.words()}) AS word_count FROM documents")
def p10(spark, folder):
    lengths = clean.add_lengths(documents(spark, folder))
    return lengths.select("id", F.col("word_count").cast("bigint").alias("word_count"))


@query("p11_preview", "SELECT doc_id AS id, text, lang AS label FROM documents ORDER BY doc_id LIMIT 5")
def p11(spark, folder):
    return clean.preview(documents(spark, folder).select("id", "text", "label"), "id")


@query(
    "u1_union_all",
    "SELECT doc_id AS id, text, lang AS label, NULL AS role FROM documents "
    "UNION ALL SELECT conv_id * 1000 + turn, text, NULL, role FROM conversations",
)
def u1(spark, folder):
    talk = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text"
    )
    return clean.union_all([documents(spark, folder).select("id", "text", "label"), talk])


@query("u2_distinct_values", f"SELECT DISTINCT unnest({sql.words()}) AS word FROM documents")
def u2(spark, folder):
    return clean.distinct_values(explode_words(documents(spark, folder), "text"), "word")


@query("u3_label_union", "SELECT lang AS label FROM documents UNION SELECT role FROM conversations")
def u3(spark, folder):
    roles = table(spark, folder, "conversations").select(F.col("role").alias("label"))
    return clean.label_union(documents(spark, folder).select("label"), roles)


@query(
    "j3_zip_by_id",
    "SELECT d.doc_id AS id, length(d.text) AS chars, e.embedding[1]::DOUBLE AS first, l.quality AS label FROM documents d "
    "JOIN embeddings e ON e.vec_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id",
)
def j3(spark, folder):
    rated = clean.drop_nulls(rated_documents(spark, folder), ["rating"])
    vectors = embeddings(spark, folder).select("id", "embedding")
    return rated.join(vectors, "id").select(
        "id",
        F.length("text").cast("bigint").alias("chars"),
        F.col("embedding")[0].cast("double").alias("first"),
        F.col("rating").alias("label"),
    )


@query(
    "j4_semi_anti_classes",
    "SELECT doc_id AS id, lang AS label, CASE WHEN source IN (SELECT source FROM documents JOIN labels USING (doc_id) "
    "WHERE toxic = 1) THEN 'semi' ELSE 'anti' END AS part FROM documents",
)
def j4(spark, folder):
    docs = documents(spark, folder).select("id", "label", "source")
    toxic = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    classes = docs.join(toxic, "id", "left_semi").select("source")
    semi = clean.semi_on_classes(docs, classes, "source").withColumn("part", F.lit("semi"))
    anti = clean.anti_on_classes(docs, classes, "source").withColumn("part", F.lit("anti"))
    return semi.unionByName(anti).select("id", "label", "part")


@query(
    "t7_text_with_empty",
    f"""WITH {sql.DOCS}, names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM docs GROUP BY 1)
    SELECT id AS pair_id, text AS text_a, '' AS text_b, label_id::DOUBLE AS label FROM docs JOIN names USING (label)""",
)
def t7(spark, folder):
    return text_with_empty(encode_labels(documents(spark, folder)))


@query("s12_row_ids", "SELECT lang AS label, count(*) AS rows, count(*) AS ids, true AS same_again FROM documents GROUP BY 1")
def s12_row_ids(spark, folder):
    """Keys for rows without one: no two alike, copies included, and the same however the rows are dealt out."""
    rows = documents(spark, folder).select("text", "label", "source")

    def summed(df, name):
        ids = clean.with_row_id(df).groupBy("label")
        return ids.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.bit_xor(F.xxhash64("id")).alias(name))

    once, again = summed(rows, "once"), summed(rows.repartition(7), "again").select("label", "again")
    return once.join(again, "label").select("label", "rows", "ids", (F.col("once") == F.col("again")).alias("same_again"))
