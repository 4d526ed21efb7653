"""Queries of the general corpus problems: drifting schemas (p2), repeated deliveries (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import dedup, drift
from leafmill.runtime import table

ARRIVAL = ("received_at", "delivery_id")


def _messages(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    key = dedup.page_message_key()
    log = table(spark, d, "usage_log")
    return log.where(key["page"].isNotNull()), key


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "usage_raw"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "usage_raw"))


def p2_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return drift.catalogue(table(spark, d, "usage_raw"))


def p2_aliases(spark: SparkSession, d: str) -> DataFrame:
    return drift.aliases(table(spark, d, "usage_raw"))


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    return drift.cells(table(spark, d, "usage_raw"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    log, key = _messages(spark, d)
    return dedup.surplus_copies(log, key, [F.col("received_at")], "delivery_id")


def p5_new_in_batch(spark: SparkSession, d: str) -> DataFrame:
    """The batches of the last tenth against the messages stored before: what each really adds."""
    log, key = _messages(spark, d)
    cut = log.agg((F.max("batch_no") * 0.9).cast("long")).first()[0]
    marked = log.withColumn("late", F.col("batch_no") > F.lit(cut))
    stored = marked.where("not late").select(*(c.alias(n) for n, c in key.items()))
    return dedup.new_messages(marked.where("late"), stored, key, [F.col("received_at")], "delivery_id").select("delivery_id", "batch_no")


QUERIES = {"p2_found": p2_found, "p2_table": p2_table, "p2_catalogue": p2_catalogue, "p2_aliases": p2_aliases, "p2_cells": p2_cells, "p5_found": p5_found, "p5_new_in_batch": p5_new_in_batch}

_MESSAGES = r"""
WITH m AS (SELECT delivery_id, batch_no, received_at, run_id, coalesce(pno_0based, page_number - 1) AS page, attempt,
             lower(regexp_replace(status, '^\s+|\s+$', '', 'g')) AS st
           FROM usage_log WHERE coalesce(pno_0based, page_number - 1) IS NOT NULL)
"""

_FIELDS = """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY file_seq) AS ord, count(*) OVER (PARTITION BY stream_id) AS n FROM (SELECT DISTINCT stream_id, file_seq FROM usage_raw)),
r AS (SELECT stream_id, ord, line_no, rec_uid, CAST(record AS JSON) AS j FROM usage_raw JOIN f USING (stream_id, file_seq) WHERE json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record ELSE 'null' END) = 'OBJECT'),
k0 AS (SELECT stream_id, ord, line_no, rec_uid, j, unnest(json_keys(j)) AS field FROM r),
v AS (SELECT stream_id, ord, line_no, rec_uid, field, CASE json_type(j, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object'
        WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN NULL ELSE 'integer' END AS kind, j ->> ('$."' || field || '"') AS txt FROM k0),
c AS (SELECT stream_id, ord, field, coalesce(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), []) AS kinds FROM v GROUP BY ALL),
gone AS (SELECT a.stream_id, a.ord + 1 AS ord, a.field, a.kinds FROM c a JOIN f ON f.stream_id = a.stream_id AND f.ord = a.ord + 1 WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.stream_id = a.stream_id AND b.ord = a.ord + 1 AND b.field = a.field)),
come AS (SELECT a.stream_id, a.ord, a.field, a.kinds FROM c a WHERE a.ord > 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.stream_id = a.stream_id AND b.ord = a.ord - 1 AND b.field = a.field)),
p AS (SELECT DISTINCT stream_id, ord, rec_uid FROM r WHERE rec_uid IS NOT NULL),
x AS (SELECT g.stream_id, g.ord, g.field AS old, n.field AS new, g.kinds AS ok, n.kinds AS nk, bool_and(w.txt IS NOT NULL AND w.txt = o.txt) AS same
      FROM gone g JOIN come n USING (stream_id, ord) JOIN v o ON o.stream_id = g.stream_id AND o.ord = g.ord - 1 AND o.field = g.field AND o.txt IS NOT NULL AND o.kind IS NOT NULL
      JOIN p ON p.stream_id = g.stream_id AND p.ord = g.ord AND p.rec_uid = o.rec_uid
      LEFT JOIN v w ON w.stream_id = g.stream_id AND w.ord = g.ord AND w.field = n.field AND w.rec_uid = o.rec_uid AND w.kind IS NOT NULL GROUP BY ALL),
y AS (SELECT * FROM x WHERE same)"""

_LOG = _FIELDS + """,
z AS (SELECT stream_id, ord, 'renamed' AS change_kind, old AS field, new AS new_field FROM y
  UNION SELECT stream_id, ord, 'removed', field, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.stream_id = g.stream_id AND y.ord = g.ord AND y.old = g.field)
  UNION SELECT stream_id, ord, 'added', field, '' FROM come g WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.stream_id = g.stream_id AND y.ord = g.ord AND y.new = g.field)
  UNION SELECT a.stream_id, a.ord, 'type_changed', a.field, '' FROM c a JOIN c b ON a.stream_id = b.stream_id AND a.ord = b.ord + 1 AND a.field = b.field WHERE a.kinds <> b.kinds AND len(a.kinds) > 0 AND len(b.kinds) > 0
  UNION SELECT stream_id, ord, 'type_changed', new, '' FROM y WHERE ok <> nk AND len(ok) > 0 AND len(nk) > 0)
SELECT z.stream_id, f.file_seq, change_kind, field, new_field FROM z JOIN f USING (stream_id, ord)"""

_SPANS = _FIELDS + """,
g AS (SELECT *, CASE WHEN lag(ord) OVER w IS DISTINCT FROM ord - 1 THEN 1 ELSE 0 END AS s, CASE WHEN lag(ord) OVER w IS DISTINCT FROM ord - 1 OR lag(kinds) OVER w <> kinds THEN 1 ELSE 0 END AS t
  FROM c WINDOW w AS (PARTITION BY stream_id, field ORDER BY ord)),
i AS (SELECT *, sum(s) OVER w AS life, sum(t) OVER w AS island FROM g WINDOW w AS (PARTITION BY stream_id, field ORDER BY ord ROWS UNBOUNDED PRECEDING))"""

_CLASH = "greatest(coalesce(CASE WHEN max(z) OVER (PARTITION BY stream_id, name ORDER BY a, z, root, rlife ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 1 END, 0), coalesce(CASE WHEN lead(a) OVER w <= z THEN 1 END, 0)) AS meets, row_number() OVER w AS nth"
_NUMBERED = "CASE WHEN meets = 1 AND nth > 1 THEN name || '__' || nth ELSE name END AS name"
_BY_NAME = "WINDOW w AS (PARTITION BY stream_id, name ORDER BY a, z, root, rlife)"
_ALIASES = _SPANS.replace("WITH f", "WITH RECURSIVE f", 1) + f""",
l AS (SELECT stream_id, field, life, min(ord) AS a, max(ord) AS z FROM i GROUP BY ALL),
k1 AS (SELECT o.stream_id, o.field AS old, o.life AS ol, n.field AS new, n.life AS nl FROM y JOIN l o ON o.stream_id = y.stream_id AND o.field = y.old AND o.z = y.ord - 1 JOIN l n ON n.stream_id = y.stream_id AND n.field = y.new AND n.a = y.ord),
k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY stream_id, new, nl ORDER BY old) = 1),
k AS (SELECT * FROM k2 QUALIFY row_number() OVER (PARTITION BY stream_id, old, ol ORDER BY new) = 1),
up AS (SELECT stream_id, field, life, a, z, field AS root, life AS rlife FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.stream_id = l.stream_id AND k.new = l.field AND k.nl = l.life)
  UNION ALL SELECT l.stream_id, l.field, l.life, l.a, l.z, up.root, up.rlife FROM up JOIN k ON k.stream_id = up.stream_id AND k.old = up.field AND k.ol = up.life JOIN l ON l.stream_id = k.stream_id AND l.field = k.new AND l.life = k.nl),
age AS (SELECT field, min(a) AS age FROM l GROUP BY 1),
e AS (SELECT q.old, q.new, q.n FROM (SELECT old, new, count(*) AS n FROM k1 GROUP BY 1, 2) q JOIN age o ON o.field = q.old JOIN age m ON m.field = q.new WHERE o.age < m.age OR (o.age = m.age AND q.old < q.new)
  QUALIFY row_number() OVER (PARTITION BY q.new ORDER BY q.n DESC, q.old) = 1),
nm AS (SELECT field AS root, field AS name FROM age WHERE field NOT IN (SELECT new FROM e) UNION ALL SELECT e.new, nm.name FROM nm JOIN e ON e.old = nm.root),
h0 AS (SELECT up.stream_id, up.root, up.rlife, nm.name, min(a) AS a, max(z) AS z FROM up JOIN nm ON nm.root = up.root GROUP BY ALL),
h1 AS (SELECT * EXCLUDE (name, meets, nth), CASE WHEN meets = 1 THEN root ELSE name END AS name FROM (SELECT *, {_CLASH} FROM h0 {_BY_NAME})),
h2 AS (SELECT * EXCLUDE (name, meets, nth), {_NUMBERED} FROM (SELECT *, {_CLASH} FROM h1 {_BY_NAME})),
h3 AS (SELECT * EXCLUDE (name, meets, nth), {_NUMBERED} FROM (SELECT *, {_CLASH} FROM h2 {_BY_NAME})),
alias AS (SELECT up.stream_id, up.field, up.a, up.z, h3.name FROM up JOIN h3 USING (stream_id, root, rlife))"""

ORACLE = {
    "p2_catalogue": _SPANS + " SELECT i.stream_id, field, array_to_string(kinds, ' ') AS kinds, min(file_seq) AS first_seq, max(file_seq) AS last_seq FROM i JOIN f USING (stream_id, ord) GROUP BY i.stream_id, field, island, kinds",
    "p2_aliases": _ALIASES + " SELECT alias.stream_id, field, p.file_seq AS first_seq, q.file_seq AS last_seq, name FROM alias JOIN f p ON p.stream_id = alias.stream_id AND p.ord = a JOIN f q ON q.stream_id = alias.stream_id AND q.ord = z",
    "p2_cells": _ALIASES + " SELECT v.stream_id, f.file_seq, v.line_no, alias.name, txt AS text FROM v JOIN alias ON alias.stream_id = v.stream_id AND alias.field = v.field AND v.ord BETWEEN a AND z JOIN f ON f.stream_id = v.stream_id AND f.ord = v.ord WHERE kind IS NOT NULL",
    "p2_found": _LOG,
    "p5_found": _MESSAGES
    + """, r AS (SELECT delivery_id, row_number() OVER (PARTITION BY run_id, page, attempt, st ORDER BY received_at, delivery_id) AS n FROM m)
SELECT delivery_id FROM r WHERE n > 1""",
    "p5_new_in_batch": _MESSAGES
    + """, c AS (SELECT CAST(floor(max(batch_no) * 0.9) AS BIGINT) AS cut FROM m),
r AS (SELECT m.*, row_number() OVER (PARTITION BY run_id, page, attempt, st ORDER BY received_at, delivery_id) AS n FROM m, c WHERE batch_no > cut)
SELECT delivery_id, batch_no FROM r WHERE n = 1 AND NOT EXISTS (
  SELECT 1 FROM m o, c WHERE o.batch_no <= c.cut AND o.run_id IS NOT DISTINCT FROM r.run_id AND o.page = r.page
    AND o.attempt IS NOT DISTINCT FROM r.attempt AND o.st IS NOT DISTINCT FROM r.st)""",
}
