"""Sources and sinks. The given tables are written in the source's format first, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlode.operators.classify import fit_logistic, load_model, predict, save_model, search_k
from textlode.operators.scale import new_path
from textlode.operators.splits import cap_per_source, rows_of, sample_rows
from textlode.plans.catalog import sql
from textlode.plans.catalog.registry import documents, embeddings, query, rated_documents, split_embeddings, table
from textlode.sources import readers, writers


def _json_by_category(spark, folder):
    path = new_path(spark, "json")
    raw = documents(spark, folder).select("id", F.col("text").alias("reviewText"), F.col("label").alias("main_category"))
    writers.write_json_by_category(raw, "main_category", path)
    return path


@query("s1_read_json_lines", 'SELECT doc_id AS id, text AS "reviewText", lang AS main_category FROM documents')
def s1(spark, folder):
    return readers.read_json_lines(spark, _json_by_category(spark, folder), "id bigint, reviewText string", by="folder")


CAP = 150


@query(
    "s2_cap_per_source",
    f"""WITH {sql.DOCS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql.key('cap')}, id) AS r FROM docs)
    SELECT id, label, length(text) AS chars FROM ranked WHERE r <= {CAP}""",
)
def s2(spark, folder):
    capped = cap_per_source(documents(spark, folder), CAP, "label")
    return capped.select("id", "label", F.length("text").cast("bigint").alias("chars"))


@query(
    "s2_cap_per_nullable_source",
    f"""WITH {sql.RATED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {sql.key('cap')}, id) AS r FROM rated)
    SELECT id, rating FROM ranked WHERE r <= {CAP}""",
)
def s2_nullable(spark, folder):
    return cap_per_source(rated_documents(spark, folder).select("id", "rating"), CAP, "rating")


@query(
    "s3_source_status",
    """SELECT lang AS source, 'read' AS status, count(*) AS records, 0::BIGINT AS bad_lines FROM documents GROUP BY 1
    UNION ALL SELECT 'absent', 'missing', 0, 0""",
)
def s3(spark, folder):
    path = _json_by_category(spark, folder)
    names = ["de", "en", "es", "fr"]
    paths = {name: f"{path}/main_category={name}" for name in names} | {"absent": f"{path}/main_category=absent"}
    return readers.read_sources(spark, paths, "id bigint, reviewText string")[1]


@query("s4_read_csv_corpus", "SELECT doc_id AS id, text, lang AS label, n_chars AS rating FROM documents")
def s4(spark, folder):
    path = new_path(spark, "csv")
    raw = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("reviewText"),
        F.col("lang").alias("main_category"),
        F.col("n_chars").alias("overall"),
    )
    writers.write_csv(raw, path)
    return readers.read_csv_corpus(
        spark, path, "id bigint, reviewText string, main_category string, overall bigint", own=True
    )


ONE_LINE = r"""regexp_replace({0}, '\s+', ' ', 'g')"""


@query(
    "s5_read_label_lines",
    f"""SELECT lang || ':' || source AS label, trim({ONE_LINE.format('text')}) AS text FROM documents""",
)
def s5(spark, folder):
    path = new_path(spark, "lines")
    docs = documents(spark, folder)
    writers.write_label_lines(docs.withColumn("label", F.concat_ws(":", "label", "source")), path)
    return readers.read_label_lines(spark, path)


@query(
    "s6_concat_origins",
    f"""SELECT lang AS label, trim({ONE_LINE.format('text')}) AS text, 'train' AS origin FROM documents
    UNION ALL SELECT role, trim({ONE_LINE.format('text')}), 'test' FROM conversations""",
)
def s6(spark, folder):
    train, test = new_path(spark, "lines"), new_path(spark, "lines")
    writers.write_label_lines(documents(spark, folder), train)
    writers.write_label_lines(table(spark, folder, "conversations"), test, "role")
    return readers.read_label_files(spark, {"train": train, "test": test})


@query(
    "s7_read_newsgroups",
    """SELECT CAST(item_id AS VARCHAR) AS message, text || chr(10) AS text, 'group.' || item_id % 4 AS label,
    'train' AS subset FROM benchmark WHERE item_id % 5 <> 0""",
)
def s7(spark, folder):
    # The format has one file per message, so each row of the table becomes a file.
    path = new_path(spark, "newsgroups")
    table(spark, folder, "benchmark").select(
        F.when(F.col("item_id") % 5 == 0, "test").otherwise("train").alias("subset"),
        F.concat(F.lit("group."), F.col("item_id") % 4).alias("class"),
        F.col("item_id").alias("message"),
        F.concat(F.lit("From: someone\nSubject: something\n\n"), "text").alias("value"),
    ).write.partitionBy("subset", "class", "message").text(path)
    groups = [f"group.{i}" for i in range(4)]
    return readers.read_newsgroups(spark, path, "train", groups, remove=("headers",), encoding="UTF-8")


HEAD = 500


@query("s8_head_slice", f"SELECT doc_id AS id, lang AS label FROM documents ORDER BY doc_id LIMIT {HEAD}")
def s8(spark, folder):
    return readers.head_slice(documents(spark, folder).select("id", "label"), "id", HEAD)


SAMPLE = 300


@query(
    "s9_csv_sink",
    f"WITH {sql.DOCS} SELECT id, text, label FROM docs ORDER BY {sql.key('sample')}, id LIMIT {SAMPLE}",
)
def s9(spark, folder):
    path = new_path(spark, "csv")
    writers.write_csv(sample_rows(documents(spark, folder), SAMPLE).select("id", "text", "label"), path)
    return readers.read_csv(spark, path, "id bigint, text string, label string", own=True)


KS = [1, 3, 5, 7]

SEARCH_K = f"""{sql.VECS}, {sql.three_way('vecs', 'label_id')},
queries AS (SELECT * FROM split WHERE split = 'val'), points AS (SELECT * FROM split WHERE split = 'train'),
{sql.knn('queries', 'points', max(KS))},
counts AS (SELECT k, query_id, label_id, count(*) AS n FROM near, unnest({KS}) t(k) WHERE rank <= k GROUP BY ALL),
best AS (SELECT k, query_id, first(label_id ORDER BY n DESC, label_id) AS pred FROM counts GROUP BY ALL),
scored AS (SELECT k, label_id, pred FROM best JOIN queries ON id = query_id),
{sql.class_scores(by='k')}
SELECT k, round(sum(f * support) / sum(support), 6) AS f1 FROM classes GROUP BY k"""


def _search_k(spark, folder):
    split = split_embeddings(spark, folder)
    found = search_k(rows_of(split, "train"), rows_of(split, "val"), KS)
    return found.select("k", F.round("f1", 6).alias("f1"))


@query("c6_grid_search_k", f"WITH {SEARCH_K}")
def c6_k(spark, folder):
    return _search_k(spark, folder)


@query("s10_json_sink", f"WITH {SEARCH_K}")
def s10(spark, folder):
    path = new_path(spark, "tuning")
    writers.write_json(_search_k(spark, folder), path)
    return spark.read.schema("k int, f1 double").json(path)


@query(
    "s11_save_load_classifier",
    f"WITH {sql.VECS}, {sql.three_way('vecs', 'label_id')} "
    "SELECT count(*) AS rows, count(*) AS same FROM split WHERE split = 'test'",
)
def s11(spark, folder):
    split = split_embeddings(spark, folder)
    model = fit_logistic(rows_of(split, "train"))
    path = new_path(spark, "model")
    save_model(model, path)
    test = rows_of(split, "test")
    fresh = predict(model, test).select("id", F.col("pred").alias("fresh"), F.col("probabilities").alias("p"))
    loaded = predict(load_model(path), test).select("id", "pred", "probabilities")
    both = fresh.join(loaded, "id")
    same = (F.col("fresh") == F.col("pred")) & (F.col("p") == F.col("probabilities"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("same"))


@query("s12_source_contract", "SELECT lang AS label, text FROM documents")
def s12(spark, folder):
    path = _json_by_category(spark, folder)
    corpus = readers.load_corpus(
        spark, "reviews_json", paths=path, schema="id bigint, reviewText string", by="folder"
    )
    return corpus.select("label", "text")
