"""Conformance, verification, comparison and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conform, executions, miners, olap, relations
from ..sources.tables import DAY_SQL, FLAT_SQL, LINE_SQL, OCEL_SQL, day_log, line_log, order_ocel
from .discovery import DF, RULE
from .registry import query
from .transforms import ABLATE


def day_net(spark, d) -> miners.Net:
    """The net mined from the day log."""
    return miners.tree_to_net(miners.mine_table(relations.variants(day_log(spark, d)), 0.2))


@query()
def h1_alignments(spark, d) -> DataFrame:
    return conform.alignments(relations.variants(day_log(spark, d)).repartition("seq"), day_net(spark, d))


@query()
def h2_token_replay(spark, d) -> DataFrame:
    return conform.token_replay(relations.variants(day_log(spark, d)).repartition("seq"), day_net(spark, d))


@query(f"WITH {DAY_SQL}, {RULE} SELECT 'response' AS template, a, b, activations, response AS violations, response = 0 AS holds FROM rc UNION ALL SELECT 'precedence', a, b, activations, preceded, preceded = 0 FROM rc")
def h4_declare_check(spark, d) -> DataFrame:
    names = day_log(spark, d).events.select("activity").distinct()
    grid = names.select(F.col("activity").alias("a")).crossJoin(F.broadcast(names.select(F.col("activity").alias("b")))).where("a <> b")  # pairs of names
    rules = grid.select(F.lit("response").alias("template"), "a", "b").unionAll(grid.select(F.lit("precedence"), "a", "b"))
    return conform.check_rules(day_log(spark, d), rules)


@query(f"""WITH {LINE_SQL}, {RULE}, x AS (SELECT a.case_id, a.activity AS a, y.activity AS b, a.f AS fa, a.l AS la, p.f AS fb, p.l AS lb FROM po a JOIN nm y ON y.activity <> a.activity LEFT JOIN po p ON p.case_id = a.case_id AND p.activity = y.activity)
SELECT 'always-after' AS relation, a, b, count(DISTINCT case_id) AS cases FROM x WHERE (lb IS NULL OR lb < la) GROUP BY 1, 2, 3 UNION ALL SELECT 'always-before', a, b, count(DISTINCT case_id) FROM x WHERE (fb IS NULL OR fb > fa) GROUP BY 1, 2, 3 UNION ALL SELECT 'never-together', a, b, count(DISTINCT case_id) FROM x WHERE fb IS NOT NULL GROUP BY 1, 2, 3""")
def h5_skeleton_check(spark, d) -> DataFrame:
    names = line_log(spark, d).events.select("activity").distinct()
    grid = names.select(F.col("activity").alias("a")).crossJoin(F.broadcast(names.select(F.col("activity").alias("b")))).where("a <> b")  # pairs of names
    rules = None
    for r in ("always-after", "always-before", "never-together"):
        x = grid.select(F.lit(r).alias("relation"), "a", "b")
        rules = x if rules is None else rules.unionAll(x)
    return conform.skeleton_violations(line_log(spark, d), rules)


@query()
def h7_soundness(spark, d) -> DataFrame:
    return conform.soundness(spark, day_net(spark, d))


@query()
def h8_net_reduction(spark, d) -> DataFrame:
    return miners.net_table(spark, conform.simplified(day_net(spark, d)))


@query(f"WITH {OCEL_SQL}, {ABLATE}, r2 AS (SELECT DISTINCT x.* FROM e2o x LEFT JOIN dr USING (event_id, object_id) WHERE dr.event_id IS NULL), r1 AS (SELECT DISTINCT * FROM e2o) SELECT 'events' AS relation, CAST(0 AS BIGINT) AS only_one, CAST(0 AS BIGINT) AS only_two, (SELECT count(DISTINCT (event_id, activity, ts)) FROM ev) AS \"both\", 1.0::DOUBLE AS jaccard UNION ALL SELECT 'objects', 0, 0, (SELECT count(*) FROM ob), 1.0 UNION ALL SELECT 'e2o', (SELECT count(*) FROM r1) - (SELECT count(*) FROM r2), 0, (SELECT count(*) FROM r2), (SELECT count(*) FROM r2) / (SELECT count(*) FROM r1)")
def h10_compare(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return conform.compare(log, olap.without(log, olap.ablate(log)))


@query(f"WITH {OCEL_SQL} SELECT 'activity' AS kind, activity AS name, count(*) AS n_one, count(*) AS n_two, CAST(0 AS BIGINT) AS delta FROM ev WHERE activity <> 'ship' GROUP BY 2 UNION ALL SELECT 'activity', 'ship', count(*), 0, -count(*) FROM ev WHERE activity = 'ship' UNION ALL SELECT 'activity', '(ship, Part)', 0, count(*), count(*) FROM ev WHERE activity = 'ship' UNION ALL SELECT 'type', object_type, count(*), count(*), 0 FROM ob GROUP BY 2")
def h10_count_deltas(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return conform.type_count_deltas(log, olap.unfold(log, "ship", "Part"))


RECON = f"""{ABLATE}, kp AS (SELECT DISTINCT x.event_id, x.object_id FROM e2o x LEFT JOIN dr USING (event_id, object_id) WHERE dr.event_id IS NULL), tr AS (SELECT * FROM kp WHERE event_id NOT IN (SELECT event_id FROM dr)), lf AS (SELECT * FROM kp WHERE event_id IN (SELECT event_id FROM dr)),
n AS (SELECT object_id AS o, count(*) AS n FROM tr GROUP BY 1), pk AS (SELECT x.object_id AS o, y.object_id AS c, count(*) AS k FROM tr x JOIN tr y ON x.event_id = y.event_id AND x.object_id <> y.object_id GROUP BY 1, 2),
p AS (SELECT o, c, ln(k / n + 1e-9) AS w FROM pk JOIN n USING (o)), m AS (SELECT event_id, count(*) AS m FROM lf GROUP BY 1), s AS (SELECT event_id, c, sum(w - ln(1e-9)) AS gain FROM lf JOIN p ON o = object_id GROUP BY 1, 2),
t AS (SELECT s.event_id, c, round(gain + m * ln(1e-9), 9) AS score FROM s JOIN m USING (event_id) WHERE NOT EXISTS (SELECT 1 FROM lf WHERE lf.event_id = s.event_id AND lf.object_id = c)),
rr AS (SELECT event_id, c AS object_id, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, c) AS rank, count(*) OVER (PARTITION BY event_id) AS candidates FROM t)"""


@query(f"WITH {OCEL_SQL}, {RECON} SELECT count(*) AS gaps, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS hits_1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS hits_3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS hits_5, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS hits_10, avg(coalesce(1.0 / rank, 0.0)) AS mrr FROM dr LEFT JOIN rr USING (event_id, object_id)")
def h11_reconstruct(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    return conform.ranking_metrics(conform.reconstruct(log, olap.ablate(log)))


@query(f"WITH {OCEL_SQL}, {ABLATE} SELECT event_id, count(*) AS gaps FROM dr GROUP BY 1")
def h12_gaps(spark, d) -> DataFrame:
    log = order_ocel(spark, d)
    less = olap.without(log, olap.ablate(log))
    pair = ["event_id", "object_id"]
    return log.e2o.select(*pair).distinct().join(less.e2o, pair, "left_anti").groupBy("event_id").agg(F.count("*").alias("gaps"))


@query()
def h15_play_out(spark, d) -> DataFrame:
    return conform.play_out(spark, day_net(spark, d), 200)


@query()
def g24_org_model(spark, d) -> DataFrame:
    return conform.agglomerate_profiles(relations.task_profiles(line_log(spark, d)), 5)


@query()
def g32_execution_variants(spark, d) -> DataFrame:
    """(n_events, variants, executions): variants of order executions by size of their graphs."""
    return executions.variant_sizes(order_ocel(spark, d), "Order")
