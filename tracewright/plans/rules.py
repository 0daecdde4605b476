"""Declarative rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import declare
from ..sources.tables import DAY_SQL, LINE_SQL, day_log, line_log
from .registry import query

#: Every rule's activations and violations from event-level windows, template by template.
RULES_SQL = """al AS (SELECT DISTINCT case_id FROM {cases}), nt AS (SELECT count(*) AS cases FROM al),
e AS (SELECT case_id, activity, row_number() OVER w AS p, lead(activity) OVER w AS nx FROM log WINDOW w AS (PARTITION BY case_id ORDER BY ts NULLS LAST, event_id)),
pa AS (SELECT case_id, activity, count(*) AS k, min(p) = 1 AS i, bool_or(nx IS NULL) AS l FROM e GROUP BY 1, 2),
wn AS (SELECT activity, count(*) AS w, count(*) FILTER (WHERE k = 1) AS one, count(*) FILTER (WHERE i) AS i, count(*) FILTER (WHERE l) AS l FROM pa GROUP BY 1),
pr AS (SELECT x.case_id, x.activity AS a, y.activity AS b FROM pa x JOIN pa y ON x.case_id = y.case_id AND x.activity <> y.activity),
m AS (SELECT pr.case_id, a, b, activity = a AS isa, p, lead(activity = a) OVER v AS na, lead(p) OVER v AS np, lag(activity = a) OVER v AS ba, lag(p) OVER v AS bp FROM pr JOIN e ON e.case_id = pr.case_id AND e.activity IN (a, b) WINDOW v AS (PARTITION BY pr.case_id, a, b ORDER BY p)),
fl AS (SELECT case_id, a, b, min(p) FILTER (WHERE isa) AS fa, max(p) FILTER (WHERE isa) AS la, min(p) FILTER (WHERE NOT isa) AS fb, max(p) FILTER (WHERE NOT isa) AS lb,
 bool_or(isa AND coalesce(na, true)) AS ar, bool_or(NOT isa AND NOT coalesce(ba, false)) AS ap, bool_or(isa AND (coalesce(na, true) OR np <> p + 1)) AS cr, bool_or(NOT isa AND (NOT coalesce(ba, false) OR bp <> p - 1)) AS cp, bool_or(isa AND NOT coalesce(na, true) AND np = p + 1) AS nc FROM m GROUP BY 1, 2, 3),
ct AS (SELECT case_id, a, b, unnest(['respondedExistence','response','precedence','succession','altResponse','altPrecedence','altSuccession','chainResponse','chainPrecedence','chainSuccession','notCoExistence','notSuccession','notChainSuccession']) AS template,
 unnest([false, lb < la, fa > fb, lb < la OR fa > fb, ar, ap, ar OR ap, cr, cp, cr OR cp, true, fa < lb, nc]) AS bad FROM fl),
kd(template, kind, ord) AS (VALUES ('respondedExistence','a',6),('response','a',7),('precedence','b',8),('succession','ab',9),('altResponse','a',10),('altPrecedence','b',11),('altSuccession','ab',12),('chainResponse','a',13),('chainPrecedence','b',14),('chainSuccession','ab',15),('notCoExistence','ab',16),('notSuccession','a',17),('notChainSuccession','a',18)),
gr AS (SELECT template, kind, x.activity AS a, y.activity AS b, x.w AS wa, y.w AS wb FROM kd, wn x JOIN wn y ON x.activity <> y.activity),
cn AS (SELECT template, a, b, count(*) AS two, count(*) FILTER (WHERE bad) AS bad FROM ct GROUP BY 1, 2, 3),
bi AS (SELECT template, a, b, CASE kind WHEN 'a' THEN wa WHEN 'b' THEN wb ELSE wa + wb - coalesce(two, 0) END AS activations,
 coalesce(bad, 0) + CASE WHEN template LIKE 'not%' THEN 0 WHEN kind = 'a' THEN wa - coalesce(two, 0) WHEN kind = 'b' THEN wb - coalesce(two, 0) ELSE wa + wb - 2 * coalesce(two, 0) END AS violations FROM gr LEFT JOIN cn USING (template, a, b)),
un AS (SELECT unnest(['existence','absence','exactlyOne','init','end']) AS template, activity AS a, NULL AS b, cases AS activations, unnest([cases - w, w, cases - one, cases - i, cases - l]) AS violations FROM wn, nt),
ru AS (SELECT template, a, CAST(b AS VARCHAR) AS b, activations, violations, cases FROM (SELECT * FROM un UNION ALL SELECT * FROM bi), nt)"""
IMPLIED_SQL = "im(s, w, sw) AS (VALUES ('chainResponse','altResponse',false),('chainResponse','response',false),('chainResponse','respondedExistence',false),('altResponse','response',false),('altResponse','respondedExistence',false),('response','respondedExistence',false),('chainPrecedence','altPrecedence',false),('chainPrecedence','precedence',false),('altPrecedence','precedence',false),('succession','response',false),('succession','precedence',false),('succession','respondedExistence',false),('altSuccession','succession',false),('altSuccession','altResponse',false),('altSuccession','altPrecedence',false),('altSuccession','response',false),('altSuccession','precedence',false),('altSuccession','respondedExistence',false),('chainSuccession','altSuccession',false),('chainSuccession','chainResponse',false),('chainSuccession','chainPrecedence',false),('chainSuccession','succession',false),('chainSuccession','altResponse',false),('chainSuccession','altPrecedence',false),('chainSuccession','response',false),('chainSuccession','precedence',false),('chainSuccession','respondedExistence',false),('notCoExistence','notSuccession',false),('notCoExistence','notChainSuccession',false),('notSuccession','notChainSuccession',false),('exactlyOne','existence',false),('init','existence',false),('end','existence',false),('precedence','respondedExistence',true))"
_DAY, _LINE = RULES_SQL.replace("{cases}", "log"), RULES_SQL.replace("{cases}", "cases")
FOUND_SQL = "kp AS (SELECT *, 1.0 - violations::DOUBLE / cases AS support, (activations - violations)::DOUBLE / activations AS confidence FROM ru WHERE activations > 0 AND 1.0 - violations::DOUBLE / cases >= {s} - 1e-12 AND (activations - violations)::DOUBLE / activations >= {c} - 1e-12), pn AS (SELECT kp.* FROM kp WHERE NOT EXISTS (SELECT 1 FROM kp o JOIN im ON im.s = o.template WHERE im.w = kp.template AND CASE WHEN sw THEN o.a IS NOT DISTINCT FROM kp.b AND o.b IS NOT DISTINCT FROM kp.a ELSE o.a = kp.a AND o.b IS NOT DISTINCT FROM kp.b END))"
_ORDER = "list_position(['existence','absence','exactlyOne','init','end','respondedExistence','response','precedence','succession','altResponse','altPrecedence','altSuccession','chainResponse','chainPrecedence','chainSuccession','notCoExistence','notSuccession','notChainSuccession'], template)"
RANKED_SQL = f"SELECT row_number() OVER (ORDER BY confidence DESC, activations DESC, {_ORDER}, a, b) AS rank, template, a, b, support, confidence, activations, violations FROM pn"


@query(f"WITH {DAY_SQL}, {_DAY} SELECT * FROM ru")
def g19_all_templates(spark, d) -> DataFrame:
    return declare.assess(day_log(spark, d))


@query(f"WITH {LINE_SQL}, {_LINE} SELECT * FROM ru")
def g19_all_templates_lines(spark, d) -> DataFrame:
    return declare.assess(line_log(spark, d))


@query(f"WITH {DAY_SQL}, {_DAY}, {IMPLIED_SQL}, {FOUND_SQL.format(s=0.3, c=0.3)} {RANKED_SQL}")
def g19_discover(spark, d) -> DataFrame:
    return declare.discover(day_log(spark, d), 0.3, 0.3)


_CHECK = """, rl AS (SELECT template, a, b FROM pn), cs AS (SELECT template, a, b, case_id, coalesce(ct.bad, template NOT LIKE 'not%') AS violated FROM (
SELECT DISTINCT rl.template, a, b, pa.case_id FROM rl JOIN kd USING (template) JOIN pa ON (kind <> 'b' AND pa.activity = a) OR (kind <> 'a' AND pa.activity = b)) LEFT JOIN ct USING (template, a, b, case_id)
UNION ALL SELECT template, a, b, al.case_id, CASE template WHEN 'existence' THEN k IS NULL WHEN 'absence' THEN k IS NOT NULL WHEN 'exactlyOne' THEN coalesce(k <> 1, true) WHEN 'init' THEN NOT coalesce(i, false) ELSE NOT coalesce(l, false) END FROM rl CROSS JOIN al LEFT JOIN pa ON pa.case_id = al.case_id AND pa.activity = a WHERE rl.b IS NULL)"""


@query(f"WITH {DAY_SQL}, {_DAY}, {IMPLIED_SQL}, {FOUND_SQL.format(s=0.3, c=0.3)}{_CHECK} SELECT template, a, b, count(*) AS activations, count(*) FILTER (WHERE violated) AS violations FROM cs GROUP BY 1, 2, 3")
def h4_rule_totals(spark, d) -> DataFrame:
    log = day_log(spark, d)
    c = declare.check(log, declare.discover(log, 0.3, 0.3))
    return c.groupBy("template", "a", "b").agg(F.count("*").alias("activations"), F.count_if("violated").alias("violations"))


@query(f"WITH {DAY_SQL}, {_DAY}, {IMPLIED_SQL}, {FOUND_SQL.format(s=0.3, c=0.3)}{_CHECK} SELECT case_id, count(*) AS activated, count(*) FILTER (WHERE violated) AS violated FROM cs GROUP BY 1")
def h4_case_list(spark, d) -> DataFrame:
    log = day_log(spark, d)
    c = declare.check(log, declare.discover(log, 0.3, 0.3))
    return c.groupBy("case_id").agg(F.count("*").alias("activated"), F.count_if("violated").alias("violated"))
