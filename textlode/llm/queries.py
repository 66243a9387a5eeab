"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import chat, extract, language, merkle, mixing, nearjoin, packing, piece_bpe, quality, topk, toxicity, trie, urls
from textlode.llm.common import held_out, staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text: eight shifts for each of its bytes."""
    bits = f"flatten(list_transform(string_split({value}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), {step}), 4294967295)"


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 2,048 tokens."""
    return packing.pack(packing.pieces_of(table(spark, folder, "documents"), tokenizer_path()))


@query("op2_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base test, and the label model's verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    q = F.col("_quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return quality.quality_verdicts(docs, keep_text=False).select("doc_id", *[q[c].alias(c) for c in names])


@query("op3_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near copies of every document."""
    return nearjoin.similar_classes(table(spark, folder, "documents"))


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled documents that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~held_out("doc_id", 5, 0))
    model = toxicity.train(*toxicity.sample(docs, labels))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op7_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents")
    out = held_out("doc_id", 4, 2)
    model = language.train(docs.where(~out).select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


INTEGER_VECTORS = """
SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query(
    "op10_exact_top_k",
    f"""
WITH vectors AS ({INTEGER_VECTORS}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
)
def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best other vectors of each vector whose id is divisible by 100."""
    vectors = topk.as_integers(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 100 = 0"))


@query("op9_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = extract.extract(pages, extract.weights_of(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "op5_chat_formatting",
    """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
lines AS (
  SELECT conv_id, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM turns),
prefixes AS (
  SELECT *, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far,
    count(*) OVER (PARTITION BY conv_id) AS turns FROM lines),
whole AS (SELECT so_far, min(conv_id) AS conv_id FROM prefixes WHERE place = turns GROUP BY so_far),
kept AS (SELECT conv_id FROM whole WHERE so_far NOT IN (SELECT so_far FROM prefixes WHERE place < turns))
SELECT conv_id, CAST((place - 1) // 256 AS INTEGER) AS part, count(*) AS n_turns, string_agg(line, '' ORDER BY place) AS text
FROM lines JOIN kept USING (conv_id) GROUP BY ALL""",
)
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return chat.format_chats(table(spark, folder, "conversations"))


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


#: What does not count when texts are compared: white space of any kind and the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def text_key(text: Column) -> Column:
    """Digest of a whole text without its white space; null for a text that has nothing else."""
    bare = F.regexp_replace(text, SPACE, "")
    return F.when(bare != "", F.md5(bare))


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good, pages): pages of a host whose article is the text of a labelled document, good if most documents of that text are.

    The article is the page's whole main text, with or without its first line, which may be a heading. Texts are compared as digests
    of all they hold but white space. A document whose labels differ is good if all say so; a tie of documents is good. Each text's
    labels and each host's pages of one text are counted before they meet, so that a text of many copies is one row a host.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    texts = docs.select("doc_id", text_key(F.col("text")).alias("key")).where("key IS NOT NULL").join(labels, "doc_id")
    texts = texts.groupBy("key").agg(F.when(2 * F.sum("good") >= F.count(F.lit(1)), 1).otherwise(0).alias("good"))
    found = extract.extract(pages.select("page_id", "url", "html"), extract.weights_of(pages))
    behind = F.regexp_replace("text", r"^[^\n]*\n?", "")
    keys = F.array_distinct(F.array_compact(F.array(text_key(behind), text_key(F.col("text")))))
    # Written once: the text is searched by one pass, whatever reads the keys.
    found = staged(found.select(urls.host_of(F.col("url")).alias("host"), keys.alias("keys")), "articles")
    found = found.groupBy("host", "keys").agg(F.count(F.lit(1)).alias("pages"))
    tried = found.select("host", "keys", "pages", F.posexplode("keys").alias("nth", "key")).join(texts, "key")
    # Behind the heading first: a page counts once.
    one = tried.groupBy("host", "keys").agg(F.first("pages").alias("pages"), F.min(F.struct("nth", "good")).alias("of"))
    return one.select("host", F.col("of.good").alias("good"), "pages")


@query(
    "op6_url_filters",
    r"""
WITH parsed AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(says, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
found AS (
  SELECT p.page_id, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
  FROM parsed p JOIN rules r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY p.page_id),
labelled AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
texts AS (
  SELECT key, CASE WHEN 2 * sum(good) >= count(*) THEN 1 ELSE 0 END AS good
  FROM (SELECT doc_id, md5(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g')) AS key FROM documents)
  JOIN labelled USING (doc_id) WHERE key <> md5('') GROUP BY key),
articles AS (
  SELECT host, regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '(?s)<h1[^>]*>.*?</h1>', '') AS marked FROM parsed),
bare AS (
  SELECT host, regexp_replace(regexp_replace(marked, '(?s)<(aside|nav|form|script|style)\b.*?</(aside|nav|form|script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS escaped FROM articles),
plain AS (
  SELECT host, replace(replace(replace(replace(replace(replace(escaped, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&') AS article FROM bare),
seen AS (
  SELECT host, count(*) AS n, sum(good) AS good
  FROM (SELECT host, md5(regexp_replace(article, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', '', 'g')) AS key FROM plain) JOIN texts USING (key) GROUP BY host),
labels_of AS (SELECT DISTINCT host, string_split(host, '.') AS part FROM parsed),
units AS (
  SELECT host, coalesce(n, 0) AS n, coalesce(good, 0) AS good,
    two IN ('ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'org.uk') AS long,
    CASE WHEN long THEN two ELSE part[-1] END AS suffix, CASE WHEN long THEN array_to_string(part[-3:], '.') ELSE two END AS domain
  FROM (SELECT host, part, array_to_string(part[-2:], '.') AS two FROM labels_of) LEFT JOIN seen USING (host)),
whole AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(good) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) ELSE 0.5::DOUBLE END AS m FROM units),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, any_value(m) AS m FROM units, whole GROUP BY suffix),
s1 AS (SELECT 1 / least(0.5, greatest(1e-4, CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0 THEN sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 1e-4 END)) - 1 AS k FROM s0),
s2 AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM s0, s1),
d0 AS (SELECT domain, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, any_value(m) AS m FROM units JOIN s2 USING (suffix) GROUP BY domain),
d1 AS (SELECT 1 / least(0.5, greatest(1e-4, CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0 THEN sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 1e-4 END)) - 1 AS k FROM d0),
d2 AS (SELECT domain, (good + k * m) / (n + k) AS m FROM d0, d1),
h0 AS (SELECT host, n::DOUBLE AS n, good::DOUBLE AS good, m FROM units JOIN d2 USING (domain)),
h1 AS (SELECT 1 / least(0.5, greatest(1e-4, CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0 THEN sum((good - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) ELSE 1e-4 END)) - 1 AS k FROM h0),
h2 AS (SELECT host, (good + k * m) / (n + k) AS rate, n + k AS weight FROM h0, h1)
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN (SELECT sum(n) FROM units) > 0 AND rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) < 0.6 THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN found USING (page_id) LEFT JOIN h2 USING (host)""",
)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page; hosts are judged by the labels of the documents their pages show."""
    pages = table(spark, folder, "pages")
    outcomes = page_outcomes(pages, table(spark, folder, "documents"), table(spark, folder, "labels"))
    return urls.judge(pages.select("page_id", "url"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Target shares of the mix: the hot source is thinned out, two are repeated, all others share the rest.
MIX = {"src0": 0.15, "src1": 0.1, "src2": 0.05, mixing.REST: 0.7}


@query(
    "op8_mixing_sources",
    """
WITH weights(source, w) AS (VALUES ('src0', 0.15::DOUBLE), ('src1', 0.1::DOUBLE), ('src2', 0.05::DOUBLE), ('', 0.7::DOUBLE)),
keyed AS (
  SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE '' END AS g,
    coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS key FROM documents),
sizes AS (SELECT g, sum(coalesce(length(text), 0)) AS size FROM keyed GROUP BY g),
rates AS (
  SELECT g, CASE WHEN size > 0 THEN (w / (SELECT sum(w) FROM weights)) * (SELECT sum(size) FROM sizes) / size ELSE 0 END AS rate
  FROM sizes JOIN weights ON g = weights.source),
draws AS (SELECT g, greatest(1, ceil(rate / 64.0))::BIGINT AS draws, rate / draws AS mean FROM rates WHERE rate > 0),
steps AS (
  SELECT g, draws, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS step
  FROM (SELECT g, draws, mean, unnest(generate_series(0, CAST(mean + 16 * sqrt(mean) + 31 AS BIGINT))) AS k FROM draws)),
drawn AS (
  SELECT doc_id, source, key, g, CAST('0x' || substr(md5('8:' || j || ':' || key), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT doc_id, source, key, g, unnest(generate_series(1, draws)) AS j FROM keyed JOIN draws USING (g))),
counted AS (SELECT key, count(*) AS copies FROM drawn JOIN steps ON drawn.g = steps.g AND step <= u GROUP BY ALL)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, md5('8:place:' || key || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, copies)) AS copy FROM counted) JOIN keyed USING (key)""",
)
def mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every document repeated to the target weights and dealt to a random place, with its text."""
    mixed = mixing.mix(table(spark, folder, "documents"), MIX)
    return mixed.select("doc_id", "source", "text", "copy", "shuffle_key")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(changed: str) -> str:
    values = [f"CAST({changed if c == 'n_chars' else c} AS VARCHAR)" for c in FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


@query(
    "op11_merkle_manifest",
    f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS now
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2),
tops AS MATERIALIZED (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 2),
climb AS (
  SELECT row, lang, 0 AS level, pos, n, now AS node, '' AS proof FROM placed
  UNION ALL
  SELECT row, u.lang, u.level + 1, u.pos // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.node IS NULL THEN u.node WHEN u.pos % 2 = 1 THEN s.node || u.node ELSE u.node || s.node END), proof || coalesce(s.node, '')
  FROM climb u LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1),
climbed AS (
  SELECT row, 0 AS level, t.pos, t.n, node, proof FROM climb c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT row, u.level + 1, u.pos // 2, (u.n + 1) // 2,
    sha256(CASE WHEN s.node IS NULL THEN u.node WHEN u.pos % 2 = 1 THEN s.node || u.node ELSE u.node || s.node END), proof || coalesce(s.node, '')
  FROM climbed u LEFT JOIN crown s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, c.node AS folded_root, c.node = root AS verified
FROM placed p JOIN climbed c ON c.row = p.row AND c.n = 1 JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang
CROSS JOIN (SELECT node AS root FROM crown WHERE n = 1)""",
)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root and witness digest of every document, and the root that its possibly tampered row folds to."""
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = docs.select("doc_id", "lang", merkle.leaf_of(*map(F.col, FIELDS)).alias("leaf"), F.when(changed, merkle.leaf_of(*tampered)).alias("now"))
    proved = merkle.prove(rows, "lang", "doc_id")
    out = proved.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("now", "leaf"), F.col("witness")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of the text they decode to."""
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = piece_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), model).drop("text")
    return piece_bpe.decode(encoded, model).select("doc_id", *piece_bpe.digests())


#: Conversations are rebuilt from one in so many, up to so many turns of it.
FAMILY, SHARED_TURNS = 5, 9


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns (conv_id, place, digest, bytes) with the first h of each conversation c replaced by those of c - c % FAMILY."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("there"))
    convs = convs.select("conv_id", h.alias("h"), base.alias("base")).join(sizes.withColumnRenamed("conv_id", "base"), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "bytes")
    heads = turns.where(F.col("place") < SHARED_TURNS).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs.select("base", "conv_id", "h"), "base").where("place <= h").select("conv_id", "place", "digest", "bytes")
    return own.unionByName(lent)


@query(
    "op13_conversation_trie",
    f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, {crc32_sql("CAST(c.conv_id AS VARCHAR)")} % {SHARED_TURNS} AS h, c.conv_id - c.conv_id % {FAMILY} AS base, coalesce(b.n, 0) AS there
  FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
rebuilt AS (
  SELECT c.conv_id, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND place <= h
  UNION ALL
  SELECT c.conv_id, place - h + least(h, there), role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
members AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS path, NULL AS above, 0 AS bytes FROM convs
  UNION ALL
  SELECT conv_id, depth, md5(string_agg(turn, '' ORDER BY depth) OVER w), coalesce(md5(string_agg(turn, '' ORDER BY depth) OVER b), ''), bytes
  FROM (SELECT conv_id, place AS depth, length(role) || ':' || length(text) || ':' || role || text AS turn, strlen(text) AS bytes FROM rebuilt)
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
nodes AS MATERIALIZED (
  SELECT path, depth, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM members GROUP BY path, depth),
children AS (SELECT above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
totals AS (
  SELECT m.path, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM nodes v LEFT JOIN children c ON c.path = v.path JOIN members m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.path),
ends AS (
  SELECT m.path, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids
  FROM members m JOIN (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) l USING (conv_id, depth) GROUP BY m.path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v JOIN totals t ON t.path = v.path LEFT JOIN nodes p ON p.path = v.above LEFT JOIN children c ON c.path = v.path LEFT JOIN ends e ON e.path = v.path""",
)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with totals over what follows it."""
    turns = staged(trie.turns_of(table(spark, folder, "conversations")), "turns")
    convs = turns.select("conv_id").distinct()
    return trie.prefix_trie(rebuilt(turns, convs), convs)
