"""ANSI-SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from labelloom.plans.catalog import (
    BALANCED_SIZE,
    CONFIDENCE,
    CRITERIA_MAXIMUM,
    CRITERIA_PER_REQUEST,
    DEV_SIZE,
    LM_START_SCALE,
    SAMPLE_SIZE,
    SPLIT_SEED,
    VOTE_WEIGHTS,
)
from labelloom.plans.documents import LANGUAGE_CRITERIA


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_RULES = ", ".join(f"({i}, {quoted(n)}, {quoted(d)}, {quoted(c)})" for i, (n, d, c) in enumerate(LANGUAGE_CRITERIA))
_WEIGHTS = ", ".join(
    f"({quoted(n)}, CAST({VOTE_WEIGHTS.get(n, 1.0)} AS DOUBLE))" for n, _, _ in LANGUAGE_CRITERIA
)

# hits: every criterion that holds for a document; votes: those with a class
VOTES = f"""
crit(ord, criterion, description, class) AS (VALUES {_RULES}),
classes AS (
  SELECT CAST(row_number() OVER (ORDER BY class_name) - 1 AS INTEGER) AS class_idx, class_name
  FROM (SELECT DISTINCT lang AS class_name FROM documents)),
hits AS MATERIALIZED (
  SELECT d.doc_id AS item_id, c.ord, c.criterion, c.class
  FROM (SELECT doc_id, lower(text) AS t FROM documents) d JOIN crit c
    ON len(list_filter(string_split(lower(c.description), '+'), lambda k: NOT contains(d.t, k))) = 0),
votes AS MATERIALIZED (
  SELECT h.item_id, h.ord, h.criterion, k.class_idx FROM hits h JOIN classes k ON h.class = k.class_name),
gold AS (
  SELECT d.doc_id AS item_id, d.lang AS label, k.class_idx AS label_idx
  FROM documents d JOIN classes k ON d.lang = k.class_name)"""

# vote mass of every item and class seen in the votes, with the vote-share prior
GRID = f"""
weights(criterion, weight) AS (VALUES {_WEIGHTS}),
prior AS (SELECT class_idx, count(*) / (SELECT count(*) FROM votes) AS p FROM votes GROUP BY class_idx),
grid AS MATERIALIZED (
  SELECT d.doc_id AS item_id, p.class_idx, p.p,
         coalesce(v.w, 0) AS w, coalesce(v.weighted, 0) AS weighted
  FROM documents d CROSS JOIN prior p
  LEFT JOIN (
    SELECT item_id, class_idx, CAST(count(*) AS DOUBLE) AS w, sum(weight) AS weighted
    FROM votes JOIN weights USING (criterion) GROUP BY item_id, class_idx) v
    ON v.item_id = d.doc_id AND v.class_idx = p.class_idx),
proba AS (
  SELECT item_id, class_idx,
         CASE WHEN sum(w) OVER t = 0 THEN p ELSE w / sum(w) OVER t END AS p,
         CASE WHEN sum(weighted) OVER t = 0 THEN p ELSE weighted / sum(weighted) OVER t END AS weighted_p
  FROM grid WINDOW t AS (PARTITION BY item_id))"""


def _best(source: str, order: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT item_id, class_idx AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)"""


MV_PRIOR = _best("grid", "w DESC, p DESC, class_idx", "mv")
MV_FIRST = _best("grid", "w DESC, class_idx", "mv_first")
WITH_VOTES = f"WITH {VOTES}"
WITH_GRID = f"WITH {VOTES}, {GRID}"
WITH_MV = f"WITH {VOTES}, {GRID}, {MV_PRIOR}"


def _scores(cells: str, by: str = "") -> str:
    """CTEs from a confusion table (by, label, pred, n) to one row of macro scores."""
    pre = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
sides AS (
  SELECT {pre}label AS cls, CASE WHEN label = pred THEN n ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN label = pred THEN 0 ELSE n END AS fn FROM {cells}
  UNION ALL
  SELECT {pre}pred, 0, CASE WHEN label = pred THEN 0 ELSE n END, 0 FROM {cells}),
per_class AS (
  SELECT {pre}cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sides GROUP BY {pre}cls),
scores AS (
  SELECT {pre}
    avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS f1,
    avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END) AS precision,
    avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END) AS recall,
    sum(tp) / (sum(tp) + sum(fn)) AS acc
  FROM per_class {group})"""


_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in ("f1", "precision", "recall", "acc"))

RUNS = f"""
runs AS (
  SELECT 0 AS run, g.item_id, g.label_idx, m.pred FROM gold g JOIN mv m USING (item_id)
  UNION ALL
  SELECT 1, g.item_id, g.label_idx, m.pred FROM gold g JOIN mv_first m USING (item_id)
  UNION ALL
  SELECT 2, g.item_id, g.label_idx, CASE WHEN v.item_id IS NULL THEN -1 ELSE m.pred END
  FROM gold g JOIN mv m USING (item_id) LEFT JOIN (SELECT DISTINCT item_id FROM votes) v USING (item_id)),
cells AS (SELECT run, label_idx AS label, pred, count(*) AS n FROM runs GROUP BY run, label_idx, pred)"""
WITH_RUNS = f"{WITH_MV}, {MV_FIRST}, {RUNS}"

# --- Dawid-Skene ---------------------------------------------------------------------

# ps 50, smoothing 20 and 20/10, class support 0.1 as in Options
DS_START = """
k AS (SELECT class_idx AS c FROM prior),
dim AS (SELECT (SELECT count(*) FROM k) AS kk, (SELECT count(*) FROM documents) AS n),
counted AS (
  SELECT c.ord, c.criterion, k.c, coalesce(v.n, 0) AS n
  FROM crit c CROSS JOIN k
  LEFT JOIN (SELECT ord, class_idx, count(*) AS n FROM votes GROUP BY ord, class_idx) v
    ON v.ord = c.ord AND v.class_idx = k.c),
n_votes AS (SELECT ord, sum(n) AS n FROM counted GROUP BY ord),
smoothed AS (
  SELECT c, greatest((sum(counted.n) + 50.0) / ((SELECT sum(n) FROM counted) + 50.0 * kk), 0.1 / kk) AS p
  FROM counted CROSS JOIN dim GROUP BY c, kk),
prior0 AS (SELECT c, p / sum(p) OVER () AS p FROM smoothed),
accuracy AS (
  SELECT x.ord, CASE WHEN v.n < 5 THEN 0.7 ELSE
    least(greatest(1 - sum(abs(x.n - p.p * v.n)) / (2.0 * greatest(v.n, 1)), 0.3), 0.9) END AS a
  FROM counted x JOIN prior0 p USING (c) JOIN n_votes v ON v.ord = x.ord GROUP BY x.ord, v.n),
plain AS (
  SELECT a.ord, t.c AS t, p.c AS p,
    ((CASE WHEN t.c = p.c THEN a ELSE (1 - a) / (kk - 1) END) + 2.0) / (1 + 2.0 * kk) AS v
  FROM accuracy a CROSS JOIN k t CROSS JOIN k p CROSS JOIN dim),
cm0 AS MATERIALIZED (SELECT ord, t, p, v / sum(v) OVER (PARTITION BY ord, t) AS v FROM plain)"""


def _estep(i: int) -> str:
    return f"""
logit{i} AS MATERIALIZED (
  SELECT d.doc_id AS item_id, q.c, ln(q.p + 1e-15) + coalesce(s.ll, 0) AS x
  FROM documents d CROSS JOIN prior{i} q
  LEFT JOIN (
    SELECT v.item_id, m.p AS c, sum(ln(m.v + 1e-15)) AS ll
    FROM votes v JOIN cm{i} m ON m.ord = v.ord AND m.t = v.class_idx GROUP BY v.item_id, m.p) s
    ON s.item_id = d.doc_id AND s.c = q.c),
post{i} AS MATERIALIZED (
  SELECT item_id, c, e / sum(e) OVER (PARTITION BY item_id) AS p
  FROM (SELECT item_id, c, exp(x - max(x) OVER (PARTITION BY item_id)) AS e FROM logit{i}))"""


def _mstep(i: int) -> str:
    j = i + 1
    return f"""
prior{j} AS MATERIALIZED (
  SELECT c, (greatest(sum(p), 0.1 * n) + 50.0) / (n + 50.0 * kk) AS p FROM post{i}, dim GROUP BY c, n, kk),
soft{j} AS (
  SELECT v.ord, q.c AS t, v.class_idx AS p, sum(q.p) AS s
  FROM votes v JOIN post{i} q USING (item_id) GROUP BY v.ord, q.c, v.class_idx),
fresh{j} AS (
  SELECT m.ord, m.t, m.p, m.v AS old, coalesce(s.s, 0) AS s,
         sum(coalesce(s.s, 0)) OVER (PARTITION BY m.ord, m.t) AS total
  FROM cm{i} m LEFT JOIN soft{j} s ON s.ord = m.ord AND s.t = m.t AND s.p = m.p),
mixed{j} AS (
  SELECT f.ord, f.t, f.p, v.n, CASE WHEN f.t = f.p THEN 0.7 ELSE 0.3 / (kk - 1) END AS base,
    (least(0.8, v.n / (100.0 * kk)) * (CASE WHEN total = 0 THEN 0 ELSE s / total END)
     + (1 - least(0.8, v.n / (100.0 * kk)) - 0.1) * old
     + 0.1 * (CASE WHEN f.t = f.p THEN 0.7 ELSE 0.3 / (kk - 1) END) + 20.0) / (1 + 20.0 * kk) AS v
  FROM fresh{j} f JOIN n_votes v USING (ord) CROSS JOIN dim),
clipped{j} AS (
  SELECT ord, t, p, n, base,
    least(greatest(v / sum(v) OVER (PARTITION BY ord, t), 1e-6), 1 - 1e-6) AS v FROM mixed{j}),
cm{j} AS MATERIALIZED (
  SELECT ord, t, p, CASE WHEN n = 0 THEN base ELSE v / sum(v) OVER (PARTITION BY ord, t) END AS v FROM clipped{j})"""


def _em(passes: int) -> str:
    parts = [WITH_GRID, DS_START]
    for i in range(passes):
        parts += [_estep(i), _mstep(i)]
    return ", ".join(parts)


def _cm(i: int, decimals: int) -> str:
    return (
        f"SELECT c.criterion, m.t AS true_idx, m.p AS pred_idx, round(m.v, {decimals}) AS p "
        f"FROM cm{i} m JOIN crit c USING (ord)"
    )


def _em_until(max_iter: int, tol: float) -> str:
    """All passes unrolled; ``stopped`` has the number of the last one, ``final`` the predictions after it."""
    passes = "\n  UNION ALL ".join(
        f"""SELECT {i} AS i, (SELECT sum(ln(top + 1e-10)) FROM (SELECT max(p) AS top FROM post{i} GROUP BY item_id)) AS ll,
    (SELECT count(DISTINCT c) FROM best{i}) AS n_best"""
        for i in range(max_iter)
    )
    best = ", ".join(
        f"best{i} AS MATERIALIZED (SELECT item_id, arg_min(c, {{'p': -p, 'c': c}}) AS c FROM post{i} GROUP BY item_id)"
        for i in range(max_iter + 1)
    )
    preds = "\n  UNION ALL ".join(f"SELECT {i} AS n, item_id, c AS pred FROM best{i}" for i in range(1, max_iter + 1))
    return f"""{_em(max_iter)}, {_estep(max_iter)}, {best},
likelihoods AS MATERIALIZED (SELECT *, lag(ll) OVER (ORDER BY i) AS earlier FROM ({passes})),
stopped AS (
  SELECT coalesce(min(i) FILTER (WHERE i > 5 AND n_best >= 0.1 * (SELECT kk FROM dim) AND abs(ll - earlier) < {tol}) + 1, {max_iter}) AS n
  FROM likelihoods),
final AS (SELECT item_id, pred FROM ({preds}) WHERE n = (SELECT n FROM stopped))"""


# --- document-derived criteria -------------------------------------------------------

def _word(n: str) -> str:
    """The n-th longest different word of a text."""
    words = "list_filter(list_distinct(string_split(text, ' ')), lambda w: w <> '')"
    return f"coalesce(list_sort(list_transform({words}, lambda w: {{'k': -length(w), 'w': w}}))[{n}].w, '')"


PROPOSED = f"""
proposed AS (
  SELECT doc_id AS ord, source, lang, {_word("1")} AS criterion,
    lower({_word("1")}) || '+' || lower({_word("2")}) AS description,
    CASE WHEN lang = 'de' THEN lang ELSE '0' || substr(source, 4) END AS class
  FROM documents)"""

LAST_WINS = """
merged AS (
  SELECT min(ord) AS ord, criterion, arg_max(description, ord) AS description,
    coalesce(CAST(TRY_CAST(arg_max(class, ord) AS BIGINT) AS VARCHAR), arg_max(class, ord)) AS class
  FROM proposed GROUP BY criterion)"""

GOLD_SPLITS = """
train AS (SELECT doc_id AS item_id, lang AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
valid AS (SELECT d.doc_id AS item_id, d.lang AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
test AS (SELECT d.doc_id AS item_id, d.lang AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0)"""


def _balanced(source: str, size: int, name: str) -> str:
    """Rank within the class by md5, then take cycle by cycle."""
    return f"""
{name} AS (
  SELECT item_id, label, row_number() OVER (ORDER BY rn, md5('{SPLIT_SEED}|' || rn || '|' || cls), cls) <= {size} AS chosen
  FROM (
    SELECT item_id, label, coalesce(label, 'NaN') AS cls,
      row_number() OVER (PARTITION BY coalesce(label, 'NaN') ORDER BY md5('{SPLIT_SEED}|' || item_id)) AS rn
    FROM {source}))"""


PREPARED = f"""
pool AS (SELECT * FROM train UNION ALL SELECT * FROM valid), {_balanced("pool", DEV_SIZE, "marked")},
splits AS (
  SELECT item_id, label, CASE WHEN chosen THEN 'dev' ELSE 'train' END AS split FROM marked
  UNION ALL SELECT item_id, label, 'test' FROM test)"""

JUDGED = """
judged AS (
  SELECT g.item_id, g.label, d.text, g.label_idx, m.pred,
    CASE WHEN m.pred = g.label_idx THEN 'correct' ELSE 'wrong' END AS outcome
  FROM gold g JOIN mv m USING (item_id) JOIN documents d ON d.doc_id = g.item_id)"""


_FLAG = """
CASE source WHEN 'src2' THEN 0 WHEN 'src5' THEN 1 WHEN 'src6' THEN 1 WHEN 'src7' THEN 1 ELSE n_chars END"""

_RESPONSES = f"""{WITH_VOTES},
asked AS (SELECT doc_id AS item_id, source, ch.chunk FROM documents CROSS JOIN (VALUES (0), (1)) ch(chunk)),
usable AS (
  SELECT a.item_id, a.source, h.criterion FROM asked a JOIN hits h
    ON h.item_id = a.item_id AND (h.criterion LIKE 'e%') = (a.chunk = 0)
  WHERE NOT (a.source = 'src5' AND a.chunk = 1)),
state AS (
  SELECT d.doc_id AS item_id,
    d.source IN ('src3', 'src5') OR (d.source <> 'src6' AND count(u.criterion) = 0) AS blank
  FROM documents d LEFT JOIN usable u ON u.item_id = d.doc_id GROUP BY d.doc_id, d.source)
SELECT s.item_id, c.criterion,
  CASE WHEN s.blank THEN NULL ELSE u.criterion IS NOT NULL END AS hit
FROM state s CROSS JOIN crit c LEFT JOIN usable u ON u.item_id = s.item_id AND u.criterion = c.criterion"""

_LM_FIXED = f"""{WITH_VOTES},
logit AS (
  SELECT d.doc_id AS item_id, k.class_idx AS c,
    ln(1.0 / (SELECT count(*) FROM classes)) + coalesce(s.ll, 0) AS x
  FROM documents d CROSS JOIN classes k
  LEFT JOIN (
    SELECT v.item_id, y.class_idx AS c,
      sum(ln(CASE WHEN y.class_idx = v.class_idx THEN 0.5 + 0.02 * v.ord ELSE 0.05 END)) AS ll
    FROM votes v CROSS JOIN classes y GROUP BY v.item_id, y.class_idx) s ON s.item_id = d.doc_id AND s.c = k.class_idx),
post AS (
  SELECT item_id, c, exp(x) / sum(exp(x)) OVER (PARTITION BY item_id) AS p FROM logit),
topped AS (SELECT *, max(p) OVER (PARTITION BY item_id) AS top FROM post)
SELECT item_id, round(max(top), 6) AS p,
  CASE WHEN count(*) FILTER (WHERE abs(p - top) < 1e-5) > 1 THEN -1
       ELSE min(c) FILTER (WHERE p = top) END AS pred
FROM topped GROUP BY item_id"""

# 1000 epochs of Adam at rate 0.001 with ridge 2, from the planted start times the scale that seed 0 draws
_LM_PARAMS = f"""WITH RECURSIVE {WITH_VOTES.strip().removeprefix("WITH")},
lm_size AS (SELECT CAST(count(*) AS DOUBLE) AS n, (SELECT count(*) FROM classes) AS k FROM documents),
own AS MATERIALIZED (
  SELECT c.ord AS i, c.criterion, coalesce(k.class_idx, 0) AS c FROM crit c LEFT JOIN classes k ON c.class = k.class_name),
met AS MATERIALIZED (
  SELECT a.ord AS i, b.ord AS j, count(*) / (SELECT n FROM lm_size) AS rate
  FROM votes a JOIN votes b ON a.item_id = b.item_id GROUP BY a.ord, b.ord),
anchored AS MATERIALIZED (
  SELECT o.i, y.class_idx AS y, coalesce(m.rate, 0.0) AS rate, CAST(1.0 / z.k AS DOUBLE) AS p,
    CASE WHEN y.class_idx = o.c THEN least(greatest(coalesce(m.rate, 0.0) * 0.7 * z.k, 0.0), 1.0) ELSE 0.0 END AS anchor
  FROM own o LEFT JOIN met m ON m.i = o.i AND m.j = o.i CROSS JOIN classes y CROSS JOIN lm_size z),
g AS (
  SELECT 0 AS step, i, y, CAST(anchor * {LM_START_SCALE!r} AS DOUBLE) AS mu, CAST(0 AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS s
  FROM anchored
  UNION ALL
  SELECT step + 1, i, y, mu - 0.001 * (f / (1 - pow(0.9, step + 1))) / (sqrt(s / (1 - pow(0.999, step + 1))) + 1e-8), f, s
  FROM (
    SELECT step, i, y, mu, 0.9 * f + 0.1 * slope AS f, 0.999 * s + 0.001 * slope * slope AS s
    FROM (
      SELECT g.*, 2 * (d.mass - a.rate) * a.p + 8 * (g.mu - a.anchor) - 4 * coalesce(t.gap, 0) AS slope
      FROM g JOIN anchored a ON a.i = g.i AND a.y = g.y
      JOIN (SELECT g.i, sum(g.mu * x.p) AS mass FROM g JOIN anchored x ON x.i = g.i AND x.y = g.y GROUP BY g.i) d ON d.i = g.i
      LEFT JOIN (
        SELECT q.i, h.y, sum((coalesce(m.rate, 0) - q.model) * h.mu * x.p) AS gap
        FROM (
          SELECT a.i, b.i AS j, sum(a.mu * b.mu * x.p) AS model
          FROM g a JOIN g b ON a.y = b.y AND a.i <> b.i JOIN anchored x ON x.i = a.i AND x.y = a.y GROUP BY a.i, b.i) q
        JOIN g h ON h.i = q.j JOIN anchored x ON x.i = h.i AND x.y = h.y
        LEFT JOIN met m ON m.i = q.i AND m.j = q.j
        GROUP BY q.i, h.y) t ON t.i = g.i AND t.y = g.y
      WHERE g.step < 1000))),
fitted AS MATERIALIZED (
  SELECT i, y, least(greatest(mu, edge), 1 - edge) AS p
  FROM g CROSS JOIN (SELECT least(0.01, 1 / pow(10, ceil(log10(n)))) AS edge FROM lm_size) WHERE step = 1000)"""

_LM_FIT = f"""{_LM_PARAMS},
logit AS (
  SELECT d.doc_id AS item_id, k.class_idx AS c, ln(1.0 / z.k) + coalesce(s.ll, 0) AS x
  FROM documents d CROSS JOIN classes k CROSS JOIN lm_size z
  LEFT JOIN (
    SELECT v.item_id, m.y AS c, sum(ln(m.p)) AS ll FROM votes v JOIN fitted m ON m.i = v.ord GROUP BY v.item_id, m.y) s
    ON s.item_id = d.doc_id AND s.c = k.class_idx),
post AS (SELECT item_id, c, exp(x) / sum(exp(x)) OVER (PARTITION BY item_id) AS p FROM logit),
topped AS (SELECT *, max(p) OVER (PARTITION BY item_id) AS top FROM post),
picked AS (
  SELECT item_id, CASE WHEN count(*) FILTER (WHERE abs(p - top) < 1e-5) > 1 THEN -1
                       ELSE min(c) FILTER (WHERE p = top) END AS pred
  FROM topped GROUP BY item_id),
cells AS (SELECT label_idx AS label, pred, count(*) AS n FROM gold JOIN picked USING (item_id) GROUP BY label_idx, pred),
{_scores("cells")} SELECT {_ROUNDED} FROM scores"""

_SUMMARY = f"""
stats AS (
  SELECT v.*, g.label_idx, count(*) OVER (PARTITION BY v.item_id) AS per_item
  FROM votes v JOIN gold g USING (item_id)),
spread AS (SELECT item_id, count(DISTINCT class_idx) AS n_classes FROM votes GROUP BY item_id),
summary AS (
  SELECT c.ord, c.criterion, c.description, c.class,
    coalesce(string_agg(DISTINCT CAST(s.class_idx AS VARCHAR), ','), '') AS polarity,
    count(s.item_id) / (SELECT count(*) FROM documents) AS coverage,
    count(*) FILTER (WHERE s.per_item > 1) / (SELECT count(*) FROM documents) AS "overlaps",
    count(*) FILTER (WHERE p.n_classes > 1) / (SELECT count(*) FROM documents) AS conflicts,
    count(*) FILTER (WHERE s.class_idx = s.label_idx) AS correct,
    count(*) FILTER (WHERE s.class_idx <> s.label_idx) AS incorrect,
    CASE WHEN count(s.item_id) = 0 THEN 0
         ELSE count(*) FILTER (WHERE s.class_idx = s.label_idx) / count(s.item_id) END AS emp_acc
  FROM crit c LEFT JOIN stats s ON s.ord = c.ord LEFT JOIN spread p ON p.item_id = s.item_id
  GROUP BY c.ord, c.criterion, c.description, c.class)"""

_VERDICTS = f"""{WITH_VOTES}
SELECT d.doc_id AS item_id, c.criterion, h.item_id IS NOT NULL AS hit
FROM documents d CROSS JOIN crit c LEFT JOIN hits h ON h.item_id = d.doc_id AND h.ord = c.ord"""

# a text whose length leaves 3 by 7 never gets an answer about the first criteria
_MODEL_VERDICTS = f"""{WITH_VOTES},
state AS (
  SELECT d.doc_id AS item_id, coalesce(length(d.text) % 7 = 3, false) OR count(h.item_id) = 0 AS blank
  FROM documents d LEFT JOIN hits h ON h.item_id = d.doc_id GROUP BY d.doc_id, d.text)
SELECT s.item_id, c.criterion, CASE WHEN s.blank THEN NULL ELSE h.item_id IS NOT NULL END AS hit
FROM state s CROSS JOIN crit c LEFT JOIN hits h ON h.item_id = s.item_id AND h.ord = c.ord"""

_VOTES_LONG = f"{WITH_VOTES} SELECT item_id, criterion, class_idx FROM votes"

_BLOCKS = """frag AS (
  SELECT outcome, label, item_id // 64 AS f, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY item_id) AS body
  FROM judged WHERE text IS NOT NULL AND label IS NOT NULL GROUP BY outcome, label, item_id // 64),
cut AS (
  SELECT *, CAST(sum(length(body) + 2) OVER (PARTITION BY outcome, label ORDER BY f) AS BIGINT) - length(body) - 2 AS start FROM frag),
blk AS (
  SELECT outcome, label, start // 20000 AS part, CAST(sum(n) AS BIGINT) AS n, CAST(sum(length(body) + 2) AS BIGINT) AS chars,
    string_agg(body, chr(10) || chr(10) ORDER BY f) AS body
  FROM cut GROUP BY outcome, label, start // 20000),
led AS (SELECT label, min(f) AS led FROM frag WHERE outcome = 'wrong' GROUP BY label),
grp AS (
  SELECT b.outcome, b.label, min(l.led) AS led, max(b.part) + 1 AS size, sum(b.n) AS n, sum(b.chars) AS chars
  FROM blk b LEFT JOIN led l USING (label) GROUP BY b.outcome, b.label),
pos AS (
  SELECT *, row_number() OVER o - 1 AS place, CAST(sum(size) OVER o - size AS BIGINT) AS first
  FROM grp WINDOW o AS (ORDER BY outcome = 'correct', led NULLS LAST, label)),
blocks AS (SELECT p.first + b.part AS block, b.* , p.place FROM blk b JOIN pos p ON p.outcome = b.outcome AND p.label = b.label)"""

ORACLE: dict[str, str] = {
    "weak_label_scores": f"""{WITH_MV},
cells AS (SELECT label_idx AS label, pred, count(*) AS n FROM gold JOIN mv USING (item_id) GROUP BY label_idx, pred),
{_scores("cells")} SELECT {_ROUNDED} FROM scores""",
    "src_keyed_json": "SELECT doc_id AS item_id, text, lang AS label FROM documents",
    "src_tolerant_jsonl": f"""
SELECT text, CAST({_FLAG} AS INTEGER) AS label FROM documents
WHERE source NOT IN ('src0', 'src1', 'src3', 'src4', 'src8')""",
    "src_criteria": f"""WITH {PROPOSED}
SELECT ord, criterion, description, class FROM proposed WHERE source <> 'src2'""",
    "criteria_last_wins": f"WITH {PROPOSED}, {LAST_WINS} SELECT ord, criterion, description, class FROM merged",
    "verdicts_flatten": f"""{WITH_VOTES}
SELECT d.doc_id AS item_id, c.criterion,
  CASE WHEN d.doc_id IN (SELECT item_id FROM hits) THEN h.item_id IS NOT NULL END AS hit
FROM documents d CROSS JOIN crit c LEFT JOIN hits h ON h.item_id = d.doc_id AND h.ord = c.ord""",
    "sample_loader": f"SELECT doc_id AS item_id, text, lang AS label FROM documents ORDER BY doc_id LIMIT {SAMPLE_SIZE}",
    "sample_loader_named": "SELECT p_partkey AS item_id, p_name AS text, 'size ' || p_size AS label FROM part",
    "prepare_splits": f"WITH {GOLD_SPLITS}, {PREPARED} SELECT item_id, label, split FROM splits",
    "prepare_colliding_ids": f"""WITH {GOLD_SPLITS},
renumbered AS (
  SELECT item_id AS real_id, 'train' AS old_split, row_number() OVER (ORDER BY item_id) - 1 AS old_id, label FROM train
  UNION ALL SELECT item_id, 'valid', row_number() OVER (ORDER BY item_id) - 1, label FROM valid
  UNION ALL SELECT item_id, 'test', row_number() OVER (ORDER BY item_id) - 1, label FROM test),
keyed AS (
  SELECT *, old_id * 3 + CASE old_split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS item_id FROM renumbered),
pool2 AS (SELECT item_id, label FROM keyed WHERE old_split <> 'test'), {_balanced("pool2", DEV_SIZE, "marked2")}
SELECT k.item_id, k.old_split, k.old_id, k.label, k.real_id,
  CASE WHEN k.old_split = 'test' THEN 'test' WHEN m.chosen THEN 'dev' ELSE 'train' END AS split
FROM keyed k LEFT JOIN marked2 m ON m.item_id = k.item_id AND k.old_split <> 'test'""",
    "prepare_splits_valid_only": f"""WITH {GOLD_SPLITS}, {_balanced("valid", DEV_SIZE, "marked")}
SELECT item_id, label, 'train' AS split FROM train
UNION ALL SELECT item_id, label, 'dev' FROM marked WHERE chosen
UNION ALL SELECT item_id, label, 'test' FROM test""",
    "split_class_check": f"""WITH {GOLD_SPLITS}, {PREPARED}
SELECT split, count(*) AS n_items, count(DISTINCT coalesce(label, 'NaN')) AS n_classes FROM splits GROUP BY split""",
    "balanced_split": f"""WITH
docs AS (SELECT doc_id AS item_id, CASE WHEN source <> 'src0' THEN lang END AS label FROM documents),
{_balanced("docs", BALANCED_SIZE, "marked")} SELECT item_id, label, chosen FROM marked""",
    "balanced_lineitems": f"""WITH
lines AS (SELECT l_orderkey * 8 + l_linenumber AS item_id, l_returnflag || '-' || l_linestatus AS label FROM lineitem),
{_balanced("lines", BALANCED_SIZE, "marked")}
SELECT label, chosen, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS ids FROM marked GROUP BY label, chosen""",
    "holdout_split": """
SELECT item_id, row_number() OVER (ORDER BY md5('42|' || item_id)) <= ceil(0.1 * (SELECT count(*) FROM documents)) AS held_out
FROM (SELECT doc_id AS item_id FROM documents)""",
    "lf_keyword_verdicts": _VERDICTS,
    "votes_long": _VOTES_LONG,
    "votes_in_blocks": _VOTES_LONG,
    "votes_many_criteria": f"""WITH {PROPOSED}, {LAST_WINS},
names AS (
  SELECT DISTINCT coalesce(CAST(TRY_CAST(class AS BIGINT) AS VARCHAR), class) AS name FROM proposed WHERE class IS NOT NULL),
numbered AS (
  SELECT name, CAST(row_number() OVER (ORDER BY TRY_CAST(name AS BIGINT) IS NULL, TRY_CAST(name AS BIGINT), name) - 1 AS INTEGER) AS class_idx
  FROM names),
rules AS MATERIALIZED (SELECT criterion, class, string_split(lower(description), '+') AS kws FROM merged),
texts AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents)
SELECT d.doc_id AS item_id, r.criterion, n.class_idx
FROM texts d JOIN rules r ON contains(d.t, r.kws[1]) AND len(list_filter(r.kws, lambda k: NOT contains(d.t, k))) = 0
JOIN numbered n ON r.class = n.name""",
    "votes_per_item": f"""{WITH_VOTES}
SELECT d.doc_id AS item_id, count(v.item_id) AS n_votes,
  coalesce(string_agg(v.ord || ':' || v.class_idx, ',' ORDER BY v.ord), '') AS votes
FROM documents d LEFT JOIN votes v ON v.item_id = d.doc_id GROUP BY d.doc_id""",
    "vote_matrix_wide": f"""{WITH_VOTES}
SELECT d.doc_id AS item_id, {", ".join(
    f"coalesce(max(v.class_idx) FILTER (WHERE v.ord = {i}), -1) AS {n}" for i, (n, _, _) in enumerate(LANGUAGE_CRITERIA))}
FROM documents d LEFT JOIN votes v ON v.item_id = d.doc_id GROUP BY d.doc_id""",
    "vote_matrix_json": f"""{WITH_VOTES}
SELECT '{{' || string_agg('"' || c.criterion || '":' || coalesce(v.class_idx, -1), ',' ORDER BY c.ord) || '}}' AS value
FROM documents d CROSS JOIN crit c LEFT JOIN votes v ON v.item_id = d.doc_id AND v.ord = c.ord GROUP BY d.doc_id""",
    "lf_request_chunks": f"""WITH crit(ord, criterion, description, class) AS (VALUES {_RULES}),
c AS (
  SELECT CAST(ord // {CRITERIA_PER_REQUEST} AS INTEGER) AS chunk,
    '## Domain' || chr(10) || 'Short prose.' || chr(10) || chr(10)
    || 'Decide which of the criteria below hold for the text you are given. Answer with a JSON object with the keys '
    || '"thoughts" (your reasoning) and "found_criteria" (names of the criteria that hold).'
    || chr(10) || chr(10) || '## Criteria' || chr(10)
    || string_agg('- ' || criterion || ': ' || description, chr(10) ORDER BY ord) AS prompt
  FROM crit GROUP BY ord // {CRITERIA_PER_REQUEST})
SELECT doc_id AS item_id, c.chunk, md5(c.prompt) AS prompt_md5, CAST(length(text) AS INTEGER) AS n_chars
FROM documents CROSS JOIN c""",
    "lf_response_verdicts": _RESPONSES,
    "lf_summary": f"""{WITH_VOTES}, {_SUMMARY}
SELECT criterion, polarity, round(coverage, 6) AS coverage, round("overlaps", 6) AS "overlaps",
  round(conflicts, 6) AS conflicts, correct, incorrect, round(emp_acc, 6) AS emp_acc FROM summary""",
    "lf_filter": f"""{WITH_VOTES}, {_SUMMARY}
SELECT CAST(ord AS BIGINT) AS ord, criterion, class FROM summary WHERE emp_acc > 0.5""",
    "mv_prior": f"{WITH_GRID} SELECT class_idx, round(p, 6) AS prior FROM prior",
    "mv_vote_counts": f"{WITH_GRID} SELECT item_id, class_idx, weighted AS weight FROM grid",
    "mv_hard_prior": f"{WITH_MV} SELECT item_id, pred FROM mv",
    "mv_hard_first": f"{WITH_GRID}, {MV_FIRST} SELECT item_id, pred FROM mv_first",
    "mv_hard_random": f"""{WITH_GRID},
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY class_idx) - 1 AS place FROM grid),
{_best("placed", f"w DESC, md5('{SPLIT_SEED}|' || item_id || '|' || place)", "mv_random")}
SELECT item_id, pred FROM mv_random""",
    "mv_proba": f"{WITH_GRID} SELECT item_id, class_idx, round(p, 6) AS p FROM proba",
    "mv_soft": f"{WITH_GRID}, {_best('proba', 'weighted_p DESC, class_idx', 'soft')} SELECT item_id, pred FROM soft",
    "confident_weak_labels": f"""{WITH_GRID},
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, class_idx) AS rn FROM proba)
SELECT item_id, class_idx AS weak_label, round(p, 6) AS p FROM ranked WHERE rn = 1 AND p > {CONFIDENCE}""",
    "annotator_stats": f"""{WITH_GRID},
cell AS (SELECT ord, class_idx, count(*) AS n FROM votes GROUP BY ord, class_idx),
total AS (SELECT ord, count(*) AS n FROM votes GROUP BY ord),
size AS (SELECT count(*) AS n FROM documents)
SELECT c.criterion, p.class_idx, s.n AS n_annotations, coalesce(t.n, 0) AS n_valid,
  round((s.n - coalesce(t.n, 0)) / s.n, 6) AS missing_rate, w.weight, coalesce(x.n, 0) AS class_count,
  round(CASE WHEN t.n IS NULL THEN 0 ELSE coalesce(x.n, 0) / t.n END, 6) AS class_prop
FROM crit c JOIN weights w USING (criterion) CROSS JOIN prior p CROSS JOIN size s
LEFT JOIN total t ON t.ord = c.ord LEFT JOIN cell x ON x.ord = c.ord AND x.class_idx = p.class_idx""",
    "consensus_metrics": f"""{WITH_GRID},
item AS (
  SELECT item_id, sum(w) AS mass, max(w) AS top, count(*) FILTER (WHERE w > 0) AS n_voted FROM grid GROUP BY item_id)
SELECT count(*) AS total_objects,
  count(*) FILTER (WHERE mass > 0 AND top > mass / 2) AS objects_with_consensus,
  round(count(*) FILTER (WHERE mass > 0 AND top > mass / 2) / count(*), 6) AS consensus_rate,
  round(coalesce(sum(mass) FILTER (WHERE n_voted = 1), 0) / sum(mass), 6) AS total_agreement_rate FROM item""",
    "predictions_frame": f"""{WITH_MV}
SELECT g.item_id, d.text, g.label_idx AS label, m.pred, 'majority_vote' AS model, 'all' AS split
FROM gold g JOIN mv m USING (item_id) JOIN documents d ON d.doc_id = g.item_id""",
    "confusion_matrix": f"{WITH_RUNS} SELECT run, label, pred, n FROM cells",
    "macro_metrics": f"{WITH_RUNS}, {_scores('cells', 'run')} SELECT run, {_ROUNDED} FROM scores",
    "run_summary": f"""{WITH_RUNS}, {_scores("cells", "run")},
long AS ({" UNION ALL ".join(
    f"SELECT run, '{m}' AS metric, {m} AS value FROM scores" for m in ("f1", "precision", "recall", "acc"))})
SELECT metric, {", ".join(f"round(max(value) FILTER (WHERE run = {i}), 6) AS iter{i}" for i in range(3))},
  round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY metric""",
    "error_split": f"{WITH_MV}, {JUDGED} SELECT item_id, label, label_idx, pred, outcome FROM judged",
    "ds_init_prior": f"{_em(0)} SELECT c AS class_idx, round(p, 6) AS p FROM prior0",
    "ds_init_cm": f"{_em(0)} {_cm(0, 6)}",
    "ds_estep": f"{_em(1)} SELECT item_id, c AS class_idx, round(p, 6) AS p FROM post0",
    "ds_mstep": f"{_em(1)} {_cm(1, 6)}",
    "ds_mstep_prior": f"{_em(1)} SELECT c AS class_idx, round(p, 6) AS p FROM prior1",
    "ds_fit_3iter": f"{_em(3)} {_cm(3, 4)}",
    "ds_predict": f"""{_em(3)}, {_estep(3)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, c) AS rn FROM post3)
SELECT item_id, c AS pred FROM ranked WHERE rn = 1""",
    "ds_annotator_quality": f"""{_em(3)}
SELECT c.criterion, round(avg(m.v) FILTER (WHERE m.t = m.p), 4) AS accuracy,
  round(-sum(m.v * ln(m.v + 1e-15)) / (max(kk) * max(kk)), 4) AS entropy,
  count(*) FILTER (WHERE m.t = m.p AND m.v > 0.5) AS n_diagonal_strong
FROM cm3 m JOIN crit c USING (ord) CROSS JOIN dim GROUP BY c.criterion""",
    "ds_fit": f"""{_em_until(30, 1e-4)},
cells AS (SELECT label_idx AS label, pred, count(*) AS n FROM gold JOIN final USING (item_id) GROUP BY label_idx, pred),
{_scores("cells")} SELECT {_ROUNDED}, CAST((SELECT n FROM stopped) AS INTEGER) AS n_iter FROM scores""",
    "lm_moments": f"""{WITH_VOTES}
SELECT a.criterion AS criterion_a, b.criterion AS criterion_b, count(*) AS n_both,
  round(count(*) / (SELECT count(*) FROM documents), 6) AS rate
FROM votes a JOIN votes b ON a.item_id = b.item_id AND a.ord <= b.ord GROUP BY a.criterion, b.criterion""",
    "lm_predict_fixed_params": _LM_FIXED,
    "lm_params": f"""{_LM_PARAMS}
SELECT o.criterion, f.y AS true_idx, round(f.p, 6) AS p FROM fitted f JOIN own o ON o.i = f.i""",
    "lm_fit": _LM_FIT,
    "valid_label_projection": """
WITH seen AS (SELECT DISTINCT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
SELECT d.doc_id, CASE WHEN d.source IN (SELECT source FROM seen) THEN d.source ELSE 'src1' END AS label
FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)""",
    "label_encode": """
SELECT doc_id, substr(source, 4) AS label,
  CAST(dense_rank() OVER (ORDER BY CAST(substr(source, 4) AS INTEGER)) - 1 AS INTEGER) AS label_id FROM documents""",
    "label_index_check": """
SELECT source AS label, count(*) AS n_items FROM documents WHERE source NOT IN (
  SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND l.quality = 0)
GROUP BY source""",
    "criteria_cap": f"""WITH {PROPOSED}, {LAST_WINS},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SPLIT_SEED}|' || ord || '|' || criterion)) AS rn FROM merged)
SELECT ord, criterion, description, class FROM ranked WHERE rn <= {CRITERIA_MAXIMUM - len(LANGUAGE_CRITERIA)}""",
    "criteria_accumulate": f"""WITH {PROPOSED}
SELECT ord, criterion, description, class FROM proposed WHERE lang = 'fr'
UNION ALL
SELECT ord + (SELECT max(ord) + 1 FROM proposed WHERE lang = 'fr'), criterion, description, class
FROM proposed WHERE lang <> 'fr'""",
    "criteria_dedup": f"""WITH {PROPOSED}
SELECT ord, criterion, description, class FROM proposed
WHERE criterion IN (SELECT criterion FROM proposed WHERE lang = 'fr')""",
    "criteria_dedup_unreadable": f"WITH {PROPOSED} SELECT ord, criterion, description, class FROM proposed",
    "criteria_ingest": f"""
SELECT doc_id * 4294967296 + i AS ord, {_word("i + 1")} AS criterion,
  lower({_word("i + 2")}) AS description, lang AS class
FROM documents CROSS JOIN (VALUES (0), (1)) p(i) WHERE source NOT IN ('src3', 'src4')""",
    "generation_context": f"""{WITH_MV}, {JUDGED}
SELECT label, outcome, CAST(item_id // 64 AS BIGINT) AS fragment, count(*) AS n_texts,
  md5(string_agg(text, chr(10) || chr(10) ORDER BY item_id)) AS body_md5
FROM judged GROUP BY label, outcome, item_id // 64""",
    "generation_sizes": f"""{WITH_MV}, {JUDGED}
SELECT label, count(*) FILTER (WHERE outcome = 'wrong') AS n_positive,
  count(*) FILTER (WHERE outcome = 'correct') AS n_correct,
  (SELECT count(*) FROM judged) - count(*) AS n_negative FROM judged GROUP BY label""",
    "generation_blocks": f"""{WITH_MV}, {JUDGED}, {_BLOCKS}
SELECT CAST(block AS BIGINT) AS block, label, outcome, n AS n_texts, chars AS n_chars, md5(body) AS body_md5 FROM blocks""",
    "generation_requests": f"""{WITH_MV}, {JUDGED}, {_BLOCKS},
own AS (SELECT w.label, w.place, coalesce(c.place, (SELECT count(*) FROM pos)) AS covered
  FROM pos w LEFT JOIN pos c ON c.label = w.label AND c.outcome = 'correct' WHERE w.outcome = 'wrong'),
shown AS (
  SELECT o.place AS request_no, o.label, CASE WHEN p.label <> o.label THEN 'avoid' WHEN p.outcome = 'wrong' THEN 'cover' ELSE 'covered' END AS role,
    CASE WHEN p.label = o.label OR p.place < o.place THEN 0 WHEN p.place < o.covered THEN 1 ELSE 2 END AS range_no,
    p.first, p.first + p.size AS ends, p.n, p.chars
  FROM own o CROSS JOIN pos p)
SELECT CAST(request_no AS INTEGER) AS request_no, label, role, range_no, CAST(min(first) AS BIGINT) AS first_block,
  CAST(max(ends) AS BIGINT) AS end_block, CAST(sum(n) AS BIGINT) AS n_texts, CAST(sum(chars) AS BIGINT) AS n_chars,
  (SELECT count(*) FROM judged WHERE text IS NULL OR label IS NULL) AS n_unusable
FROM shown GROUP BY request_no, label, role, range_no""",
    "resume_remaining": """
SELECT doc_id AS item_id, lang AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "next_experiment_id": """
SELECT coalesce(max(CAST(substr(source, 4) AS BIGINT)), 0) + 1 AS next_experiment FROM documents""",
    "stream_labelling": _VERDICTS,
    "model_labelling": _MODEL_VERDICTS,
    "stream_model_labelling": _MODEL_VERDICTS,
}
