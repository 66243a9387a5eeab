"""Building blocks of the comparison SQL."""

from __future__ import annotations

from textlode.functions.keys import SEED

DOCS = "docs AS (SELECT doc_id AS id, text, lang AS label, source FROM documents)"
VECS = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS label_id FROM embeddings)"
RATED = "rated AS (SELECT doc_id AS id, quality AS rating FROM documents LEFT JOIN labels USING (doc_id))"
WORDS = r"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"
TERMS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def words(text: str = "text") -> str:
    return WORDS.format(text=text)


def terms(text: str = "text") -> str:
    return TERMS.format(text=text)


def key(salt: str, id_: str = "id") -> str:
    return f"md5(concat_ws(':', '{SEED}', '{salt}', CAST({id_} AS VARCHAR)))"


def draw(salt: str, id_: str = "id") -> str:
    return f"('0x' || substr({key(salt, id_)}, 1, 15))::BIGINT"


def share(name: str, source: str, n: str, wanted: str, out: str) -> str:
    """CTEs that share out `wanted` rows by largest remainder; the last is called `name`."""
    return f"""
{name}0 AS (SELECT *, sum({n}) OVER () AS total_ FROM {source}),
{name}1 AS (SELECT *, CAST({wanted} AS BIGINT) AS wanted_ FROM {name}0),
{name}2 AS (SELECT *, (wanted_::HUGEINT * {n}) // total_ AS floor_, (wanted_::HUGEINT * {n}) % total_ AS left_ FROM {name}1),
{name}3 AS (SELECT *, wanted_ - sum(floor_) OVER () AS spare_, row_number() OVER (ORDER BY left_ DESC, grp) AS rank_
           FROM {name}2),
{name} AS (SELECT * EXCLUDE (total_, wanted_, floor_, left_, spare_, rank_),
                  CAST(floor_ + CASE WHEN rank_ <= spare_ THEN 1 ELSE 0 END AS BIGINT) AS {out} FROM {name}3)"""


def three_way(source: str, label: str, out: str = "split", test: float = 0.2, val: float = 0.1) -> str:
    """CTEs; `split` has the rows of `source` with their part."""
    return f"""
sizes AS (SELECT {label} AS grp, count(*) AS n FROM {source} GROUP BY 1),
{share('testq', 'sizes', 'n', f'ceil({test}::DOUBLE * total_)', 'take_test')},
rests AS (SELECT *, n - take_test AS rest FROM testq),
{share('valq', 'rests', 'rest', f'ceil({val}::DOUBLE * total_)', 'take_val')},
placed_ AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {key('strat')}, id) AS place_ FROM {source}),
{out} AS MATERIALIZED (SELECT placed_.* EXCLUDE (place_),
  CASE WHEN place_ <= take_test THEN 'test' WHEN place_ <= take_test + take_val THEN 'val' ELSE 'train' END AS split
  FROM placed_ JOIN valq ON placed_.{label} IS NOT DISTINCT FROM valq.grp)"""


def holdout(source: str, label: str, out: str = "held", examples: int = 5) -> str:
    """CTE: the rows of `source`, all of hold-out classes, as example or test."""
    return f"""
{out} AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY {key('holdout')}, id) <= {examples}
  THEN 'holdout_example' ELSE 'holdout_test' END AS split FROM {source})"""


def knn(queries: str, index: str, k: int = 5, out: str = "near", v: str = "v") -> str:
    """CTE (query_id, rank, neighbour_id, dist, label_id)."""
    return f"""
{out} AS MATERIALIZED (SELECT * FROM (
  SELECT q.id AS query_id, x.id AS neighbour_id, list_distance(q.{v}, x.{v}) AS d, x.label_id,
         row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.{v}, x.{v}), x.id) AS rank
  FROM {queries} q, {index} x) WHERE rank <= {k})"""


def votes(near: str = "near", queries: str = "queries", out: str = "scored") -> str:
    """CTE (query_id, label_id, pred, labels) from neighbours."""
    return f"""
per_label AS (SELECT query_id, label_id, count(*) AS n, min(rank) AS first FROM {near} GROUP BY 1, 2),
{out} AS MATERIALIZED (SELECT p.query_id, q.label_id,
    first(p.label_id ORDER BY n DESC, p.label_id) AS pred,
    list(p.label_id ORDER BY n DESC, first) AS labels,
    coalesce(sum(CASE WHEN p.label_id = q.label_id THEN n END), 0) / sum(n) AS own_share
  FROM per_label p JOIN {queries} q ON q.id = p.query_id GROUP BY 1, 2)"""


KNN_SPLIT = f"""{VECS}, {three_way('vecs', 'label_id')},
queries AS (SELECT * FROM split WHERE split = 'test'), points AS (SELECT * FROM split WHERE split = 'train'),
{knn('queries', 'points')}"""

SCORED = f"{KNN_SPLIT}, {votes()}"

FEW_SHOT = f"""{VECS}, known AS (SELECT * FROM vecs WHERE label_id NOT IN (8, 9)),
heldrows AS (SELECT * FROM vecs WHERE label_id IN (8, 9)), {three_way('known', 'label_id')}, {holdout('heldrows', 'label_id')},
everything AS (SELECT * FROM split UNION ALL BY NAME SELECT * FROM held)"""


def class_scores(scored: str = "scored", out: str = "classes", by: str = "") -> str:
    """CTE (class, support, predicted, hits, p, r, f)."""
    extra = f"{by}, " if by else ""
    return f"""
{out} AS (SELECT {extra}class, support, predicted, hits,
    CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p,
    CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r,
    CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f
  FROM (SELECT {extra}class, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
    SELECT {extra}label_id AS class, 1 AS s, 0 AS p, CASE WHEN label_id = pred THEN 1 ELSE 0 END AS h FROM {scored}
    UNION ALL SELECT {extra}pred, 0, 1, 0 FROM {scored}) GROUP BY ALL))"""


WEIGHTED = """round(sum(hits) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
  round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1"""

PER_QUERY = """avg(CASE WHEN list_contains(labels, label_id) THEN 1.0 ELSE 0.0 END) AS topk_accuracy,
  avg(coalesce(1.0 / nullif(list_position(labels, label_id), 0), 0)) AS mrr"""

EVALUATION = f"""SELECT * FROM (SELECT CAST(sum(support) AS BIGINT) AS queries, {WEIGHTED}, round(avg(p), 6) AS macro_precision,
  round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1 FROM classes),
  (SELECT round(mrr, 6) AS mrr, round(topk_accuracy, 6) AS topk_accuracy, round(log_loss, 6) AS log_loss, unscored FROM (SELECT {PER_QUERY},
  avg(-ln(least(greatest(own_share, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))) AS log_loss,
  count(*) - count(pred) AS unscored FROM scored))"""


def classes(source: str, label: str = "label") -> str:
    """CTEs class_table, members: the classes and the position of each row in its class."""
    return f"""
class_sizes AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1),
class_table AS MATERIALIZED (SELECT row_number() OVER (ORDER BY label) - 1 AS cid, label, n,
  CAST(sum(n) OVER (ORDER BY label) - n AS BIGINT) AS start, CAST(sum(n) OVER () AS BIGINT) AS everything FROM class_sizes),
members AS MATERIALIZED (SELECT id, {label} AS label,
  row_number() OVER (PARTITION BY {label} ORDER BY {key('pair-order')}, id) - 1 AS pos FROM {source})"""


def drawn(draws: int) -> str:
    """CTE drawn: a class and two positions per draw."""
    return f"""
class_draws AS MATERIALIZED (SELECT draw_id, {draw('label', 'draw_id')} % (SELECT count(*) FROM class_table) AS cid
  FROM range({draws}) t(draw_id)),
first_draws AS MATERIALIZED (SELECT draw_id, cid, label, n, start, everything, {draw('first', 'draw_id')} % n AS pos_a
  FROM class_draws JOIN class_table USING (cid) WHERE n >= 2),
drawn AS MATERIALIZED (SELECT *, (pos_a + 1 + {draw('second', 'draw_id')} % (n - 1)) % n AS pos_b FROM first_draws)"""


def positives() -> str:
    """CTE positives (draw_id, label, id_a, id_b, ...)."""
    return """
positives AS MATERIALIZED (SELECT d.*, a.id AS id_a, b.id AS id_b FROM drawn d
  JOIN members a ON a.label = d.label AND a.pos = d.pos_a JOIN members b ON b.label = d.label AND b.pos = d.pos_b)"""


def labelled_pairs(draws: int) -> str:
    """CTE pairs (pair_id, id_a, id_b, label)."""
    return f"""{drawn(draws)}, {positives()},
others AS MATERIALIZED (SELECT p.draw_id, p.id_a, o.label AS other, {draw('third', 'p.draw_id')} % o.n AS pos_c FROM positives p
  JOIN class_table o ON o.cid = (p.cid + 1 + {draw('other', 'p.draw_id')} % ((SELECT count(*) FROM class_table) - 1))
    % (SELECT count(*) FROM class_table)),
pairs AS MATERIALIZED (SELECT draw_id * 2 AS pair_id, id_a, id_b, 1.0::DOUBLE AS label FROM positives
  UNION ALL SELECT o.draw_id * 2 + 1, o.id_a, c.id, 0.0::DOUBLE FROM others o
    JOIN members c ON c.label = o.other AND c.pos = o.pos_c)"""


def tfidf(source: str = "docs") -> str:
    """CTE weights (id, term, weight)."""
    return f"""
tokens AS (SELECT id, unnest({terms()}) AS term FROM {source}),
counts AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM tokens GROUP BY 1, 2),
idf AS MATERIALIZED (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1.0::DOUBLE + count(*))) + 1.0 AS idf
  FROM counts GROUP BY 1),
raw AS MATERIALIZED (SELECT id, term, tf * idf AS raw FROM counts JOIN idf USING (term)),
lengths AS (SELECT id, sqrt(sum(raw * raw)) AS length FROM raw GROUP BY 1),
weights AS MATERIALIZED (SELECT id, term, raw / length AS weight FROM raw JOIN lengths USING (id))"""


def hardest(anchors: str, candidates: int = 5) -> str:
    """CTE hardest (draw_id, id_a, id_b): the most similar of a few rows outside the anchor's class.

    `anchors` has (draw_id, id_a, n, start, everything)."""
    return f"""
tries0 AS (SELECT *, everything - n AS outside, least({candidates}, everything - n) AS cnt FROM {anchors}),
tries1 AS (SELECT *, unnest(range(cnt)) AS nth FROM tries0),
tries2 AS (SELECT *, (nth * outside) // cnt AS low, ((nth + 1) * outside) // cnt AS high FROM tries1),
tries3 AS MATERIALIZED (SELECT *, low + {draw('candidate', "concat_ws('-', draw_id, nth)")} % (high - low) AS spot0 FROM tries2),
tries AS MATERIALIZED (SELECT t.draw_id, t.nth, t.id_a, m.id AS id_b
  FROM (SELECT *, CASE WHEN spot0 < start THEN spot0 ELSE spot0 + n END AS spot FROM tries3) t
  JOIN (SELECT members.id, class_table.start + members.pos AS spot FROM members JOIN class_table USING (label)) m
  ON m.spot = t.spot),
terms_a AS MATERIALIZED (SELECT t.draw_id, t.nth, t.id_b, a.term, a.weight FROM tries t JOIN weights a ON a.id = t.id_a),
alike AS (SELECT a.draw_id, a.nth, sum(a.weight * b.weight) AS similarity
  FROM terms_a a JOIN weights b ON b.id = a.id_b AND b.term = a.term GROUP BY ALL),
ranked_tries AS (SELECT t.*, row_number() OVER (PARTITION BY t.draw_id ORDER BY round(coalesce(s.similarity, 0), 9) DESC, t.nth) AS place,
  coalesce(s.similarity, 0) AS similarity FROM tries t LEFT JOIN alike s ON s.draw_id = t.draw_id AND s.nth = t.nth),
hardest AS MATERIALIZED (SELECT draw_id, id_a, id_b, similarity FROM ranked_tries WHERE place = 1)"""
