"""Declarative rules over cases: all 18 templates, discovery with pruning by implication, and checking.

A rule over two activities is judged once a case. What a case with both of them says is read off the two activities'
occurrences merged in order, in one fold; cases with one of them only are counted, not looked at. Tables of rules are
bounded by the number of pairs of activities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import EventLog, in_order

# The rule templates, in ranking order, and what activates them: any case, one with a, with b, with either.
UNARY = ("existence", "absence", "exactlyOne", "init", "end")
BINARY = {
    "respondedExistence": "a", "response": "a", "precedence": "b", "succession": "ab", "altResponse": "a", "altPrecedence": "b", "altSuccession": "ab",
    "chainResponse": "a", "chainPrecedence": "b", "chainSuccession": "ab", "notCoExistence": "ab", "notSuccession": "a", "notChainSuccession": "a",
}
# Which template says at least what another does, over the same activities.
IMPLIES = {
    "chainResponse": ("altResponse",), "altResponse": ("response",), "response": ("respondedExistence",), "chainPrecedence": ("altPrecedence",), "altPrecedence": ("precedence",),
    "chainSuccession": ("altSuccession", "chainResponse", "chainPrecedence"), "altSuccession": ("succession", "altResponse", "altPrecedence"), "succession": ("response", "precedence"),
    "notCoExistence": ("notSuccession",), "notSuccession": ("notChainSuccession",), "exactlyOne": ("existence",), "init": ("existence",), "end": ("existence",),
}
TEMPLATES = (*UNARY, *BINARY)


def implied_by(template: str) -> set[str]:
    """All templates that one implies, over any number of steps."""
    out = set(IMPLIES.get(template, ()))
    return out.union(*map(implied_by, out)) if out else out


def per_activity(log: EventLog) -> DataFrame:
    """(case_id, activity, at, k, first, last, init, end): each activity's places in a case, counted from 1."""
    w = in_order("case_id")
    e = log.events.select("case_id", "activity", F.row_number().over(w).alias("pos"), F.lead("activity").over(w).isNull().alias("end"))
    g = e.groupBy("case_id", "activity").agg(F.sort_array(F.collect_list("pos")).alias("at"), F.bool_or(F.col("pos") == 1).alias("init"), F.bool_or("end").alias("end"))
    return g.select("case_id", "activity", "at", F.size("at").alias("k"), F.element_at("at", 1).alias("first"), F.element_at("at", -1).alias("last"), "init", "end")


def broken_together(p: DataFrame) -> DataFrame:
    """(case_id, a, b) of activities that share a case, and for each template whether the case breaks it."""
    x = p.select("case_id", F.col("activity").alias("a"), F.col("at").alias("at_a"), F.col("first").alias("fa"), F.col("last").alias("la"))
    y = p.select("case_id", F.col("activity").alias("b"), F.col("at").alias("at_b"), F.col("first").alias("fb"), F.col("last").alias("lb"))
    place = lambda of_a: lambda t: F.struct(t.alias("t"), F.lit(of_a).alias("of_a"))
    merged = F.array_sort(F.concat(F.transform("at_a", place(True)), F.transform("at_b", place(False))))
    no = F.lit(False)
    start = F.struct(F.lit(None).cast("boolean").alias("was_a"), F.lit(0).alias("t"), *[no.alias(c) for c in ("ar", "ap", "cr", "cp", "nc")])

    def step(s: Column, x: Column) -> Column:
        after_a, is_a, near = F.coalesce(s["was_a"], no), x["of_a"], x["t"] == s["t"] + 1
        return F.struct(
            x["of_a"].alias("was_a"), x["t"].alias("t"), (s["ar"] | (after_a & is_a)).alias("ar"), (s["ap"] | (~is_a & ~after_a)).alias("ap"),
            (s["cr"] | (after_a & (is_a | ~near))).alias("cr"), (s["cp"] | (~is_a & ~(after_a & near))).alias("cp"), (s["nc"] | (after_a & ~is_a & near)).alias("nc"),
        )

    f = x.join(y, "case_id").where("a <> b").withColumn("s", F.aggregate(merged, start, step))
    ar, cr = F.col("s.ar") | F.col("s.was_a"), F.col("s.cr") | F.col("s.was_a")  # the last of the two has nothing after it
    response, precedence = F.col("lb") < F.col("la"), F.col("fa") > F.col("fb")
    bad = {
        "respondedExistence": no, "response": response, "precedence": precedence, "succession": response | precedence, "altResponse": ar, "altPrecedence": F.col("s.ap"), "altSuccession": ar | F.col("s.ap"),
        "chainResponse": cr, "chainPrecedence": F.col("s.cp"), "chainSuccession": cr | F.col("s.cp"), "notCoExistence": F.lit(True), "notSuccession": F.col("fa") < F.col("lb"), "notChainSuccession": F.col("s.nc"),
    }
    return f.select("case_id", "a", "b", *[bad[t].alias(t) for t in BINARY])


def _binary(activated: Column, alone: Column, counted: Column, template: str) -> Column:
    return F.struct(F.lit(template).alias("template"), activated.alias("activations"), (alone + counted).alias("violations"))


def assess(log: EventLog) -> DataFrame:
    """(template, a, b, activations, violations, cases) of every rule; b is null in rules over one activity."""
    p = per_activity(log)
    cases = F.broadcast(log.all_cases().agg(F.countDistinct("case_id").alias("cases")))
    n = p.groupBy("activity").agg(F.count("*").alias("w"), F.count_if(F.col("k") == 1).alias("once"), F.count_if("init").alias("init"), F.count_if("end").alias("end")).crossJoin(cases)
    held = {"existence": F.col("w"), "absence": F.col("cases") - F.col("w"), "exactlyOne": F.col("once"), "init": F.col("init"), "end": F.col("end")}
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("template"), (F.col("cases") - held[t]).alias("violations")) for t in UNARY])).alias("r")
    unary = n.select("activity", "cases", one).select("r.template", F.col("activity").alias("a"), F.lit(None).cast("string").alias("b"), F.col("cases").alias("activations"), "r.violations", "cases")
    both = broken_together(p).groupBy("a", "b").agg(F.count("*").alias("both"), *[F.count_if(t).alias(t) for t in BINARY])
    names = n.select("activity", "w", "cases")
    grid = names.withColumnsRenamed({"activity": "a", "w": "wa"}).crossJoin(F.broadcast(names.select(F.col("activity").alias("b"), F.col("w").alias("wb")))).where("a <> b")  # pairs of names
    g = grid.join(both, ["a", "b"], "left").fillna(0, ["both", *BINARY])
    wa, wb, two = F.col("wa"), F.col("wb"), F.col("both")
    zero = F.lit(0).cast("long")
    rows = []
    for t, kind in BINARY.items():
        activated = {"a": wa, "b": wb, "ab": wa + wb - two}[kind]
        alone = zero if t.startswith("not") else {"a": wa - two, "b": wb - two, "ab": wa + wb - 2 * two}[kind]
        rows.append(_binary(activated, alone, F.col(t), t))
    binary = g.select("a", "b", "cases", F.explode(F.array(*rows)).alias("r")).select("r.template", "a", "b", "r.activations", "r.violations", "cases")
    return unary.unionByName(binary)


def discover(log: EventLog, min_support: float = 0.9, min_confidence: float = 0.9, prune: bool = True, limit: int | None = 1000) -> DataFrame:
    """The rules with enough support and confidence that no other of them implies, ranked from 1 by confidence.

    Support is the share of all cases that keep a rule, confidence that of the cases that could break it.
    """
    r = assess(log).where("activations > 0").withColumn("support", F.lit(1.0) - F.col("violations") / F.col("cases")).withColumn("confidence", (F.col("activations") - F.col("violations")) / F.col("activations"))
    kept = r.where((F.col("support") >= min_support - 1e-12) & (F.col("confidence") >= min_confidence - 1e-12))
    if prune:
        weaker = kept.sparkSession.createDataFrame([(s, w, False) for s in TEMPLATES for w in sorted(implied_by(s))] + [("precedence", "respondedExistence", True)], "template string, weaker string, swapped boolean")
        said = kept.join(F.broadcast(weaker), "template").select(F.col("weaker").alias("template"), F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b")).alias("b")).distinct()
        same = reduce(lambda x, y: x & y, [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("template", "a", "b")])
        kept = kept.alias("k").join(said.alias("s"), same, "left_anti")
    order = F.array_position(F.array(*map(F.lit, TEMPLATES)), F.col("template"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("confidence"), F.desc("activations"), order, "a", "b"))  # as many rows as rules
    out = kept.withColumn("rank", rank).select("rank", "template", "a", "b", "support", "confidence", "activations", "violations")
    return out if limit is None else out.where(F.col("rank") <= limit)


def check(log: EventLog, rules: DataFrame) -> DataFrame:
    """(template, a, b, case_id, violated) of every case that activates one of ``rules`` (template, a, b)."""
    p = per_activity(log)
    every = log.all_cases().select("case_id").distinct()
    r = F.broadcast(rules.select("template", "a", "b"))
    one = r.where(F.col("template").isin(*UNARY))
    mine = p.select("case_id", F.col("activity").alias("a"), "k", "init", "end")
    held = F.when(F.col("template") == "absence", F.col("k").isNull()).when(F.col("template") == "exactlyOne", F.col("k") == 1).when(F.col("template") == "init", F.col("init")).when(F.col("template") == "end", F.col("end")).otherwise(F.col("k").isNotNull())
    unary = every.crossJoin(one).join(mine, ["case_id", "a"], "left").select("template", "a", "b", "case_id", (~F.coalesce(held, F.lit(False))).alias("violated"))
    kind = F.create_map(*[F.lit(x) for kv in BINARY.items() for x in kv])
    two = r.where(F.col("template").isin(*BINARY)).withColumn("kind", kind[F.col("template")])
    has = lambda name: p.select("case_id", F.col("activity").alias(name))
    seen = has("a").join(two.where("kind <> 'b'"), "a").select("case_id", "template", "a", "b").union(has("b").join(two.where("kind <> 'a'"), "b").select("case_id", "template", "a", "b")).distinct()
    flags = F.create_map(*[x for t in BINARY for x in (F.lit(t), F.col(t))])
    both = broken_together(p).select("case_id", "a", "b", flags.alias("flags"))
    alone = ~F.col("template").startswith("not")  # one of the two is missing: positive rules break, negative ones hold
    binary = seen.join(both, ["case_id", "a", "b"], "left").select("template", "a", "b", "case_id", F.coalesce(F.col("flags")[F.col("template")], alone).alias("violated"))
    return unary.unionByName(binary)
