"""Queries on score vectors: truncated divergences, overlaps, probabilities, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import distribution as D
from quern.operators import joins, reports
from quern.operators.sequence import array_top_k
from quern.plans.facts import PAIRS, TOKENS, pairs, r6, tokens
from quern.plans.registry import query

K = 16
_LSE = "lse AS (SELECT vec_id, max(s) + ln(sum(exp(s - ms))) AS zs, max(t) + ln(sum(exp(t - mt))) AS zt FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS ms, max(t) OVER (PARTITION BY vec_id) AS mt FROM pr) GROUP BY vec_id)"


def _kl(rank: str, p: str, q: str) -> str:
    return f"""WITH {PAIRS}, k AS (SELECT * FROM pr WHERE {rank} <= {K}), z AS (SELECT vec_id, ln(sum(exp(s))) AS zs, ln(sum(exp(t))) AS zt FROM k GROUP BY vec_id)
SELECT vec_id, round(sum(exp({p} - z{p}) * (({p} - z{p}) - ({q} - z{q}))), 6) AS kl FROM k JOIN z USING (vec_id) GROUP BY vec_id"""




@query("Z1_reverse_kl", _kl("rs", "s", "t"))
def z1(spark, sf):
    return r6(pairs(spark, sf).select("vec_id", D.reverse_kl(F.col("s"), F.col("t"), K).alias("kl")))


@query("Z2_forward_kl", _kl("rt", "t", "s"))
def z2(spark, sf):
    return r6(pairs(spark, sf).select("vec_id", D.forward_kl(F.col("s"), F.col("t"), K).alias("kl")))


@query(
    "Z3_J6_overlap",
    f"WITH {PAIRS} SELECT vec_id, round(count(*) FILTER (rs <= {K} AND rt <= {K}) / {K}, 6) AS overlap FROM pr GROUP BY vec_id",
)
def z3(spark, sf):
    return r6(pairs(spark, sf).select("vec_id", D.overlap(F.col("s"), F.col("t"), K).alias("overlap")))


@query(
    "Z4_entropy",
    f"WITH {PAIRS}, k AS (SELECT *, s - ln(sum(exp(s)) OVER (PARTITION BY vec_id)) AS lp FROM pr WHERE rs <= {K}) SELECT vec_id, round(-sum(exp(lp) * ln(greatest(exp(lp), 1e-12))), 6) AS h FROM k GROUP BY vec_id",
)
def z4(spark, sf):
    return r6(pairs(spark, sf).select("vec_id", D.entropy(F.col("s"), K).alias("h")))


@query(
    "Z5_set_probability",
    f"WITH {PAIRS}, {_LSE} SELECT vec_id, round(sum(exp(s - zs)) FILTER (i IN (3, 7, 63)), 6) AS p FROM pr JOIN lse USING (vec_id) GROUP BY vec_id",
)
def z5(spark, sf):
    return r6(pairs(spark, sf).select("vec_id", D.set_probability(F.col("s"), F.array(*[F.lit(i) for i in (3, 7, 63, 64, -1)])).alias("p")))


@query(
    "Z6_full_distribution",
    f"WITH {PAIRS}, {_LSE} SELECT vec_id, round(sum(exp(s - zs)) FILTER (rs <= {K}), 6) AS student_mass, round(sum(exp(t - zt)) FILTER (rt <= {K}), 6) AS teacher_mass, round(sum(s - zs) FILTER (i = vec_id % 64), 6) AS student_logp, round(sum(t - zt) FILTER (i = vec_id % 64), 6) AS teacher_logp FROM pr JOIN lse USING (vec_id) GROUP BY vec_id",
)
def z6(spark, sf):
    y = (F.col("vec_id") % 64).cast("int")
    return r6(pairs(spark, sf).select("vec_id", D.top_mass(F.col("s"), K).alias("student_mass"), D.top_mass(F.col("t"), K).alias("teacher_mass"), D.target_logp(F.col("s"), y).alias("student_logp"), D.target_logp(F.col("t"), y).alias("teacher_logp")))


@query(
    "Z7_target_logp",
    f"WITH {PAIRS}, {_LSE} SELECT vec_id, round(sum(s - zs) FILTER (i = 5), 6) AS logp FROM pr JOIN lse USING (vec_id) GROUP BY vec_id",
)
def z7(spark, sf):
    return r6(pairs(spark, sf).select("vec_id", D.target_logp(F.col("s"), F.lit(5)).alias("logp")))


@query(
    "Z8_advantage",
    f"WITH {TOKENS} SELECT event_id, round(student_logp - teacher_logp, 6) AS raw, round(greatest(least(student_logp - teacher_logp, 0.2), -0.2), 6) AS clipped FROM tok WHERE student_logp IS NOT NULL",
)
def z8(spark, sf):
    s, t = F.col("student_logp"), F.col("teacher_logp")
    return r6(tokens(spark, sf).where(s.isNotNull()).select("event_id", D.advantage(s, t, None).alias("raw"), D.advantage(s, t, 0.2).alias("clipped")))


@query("Z9_top1_agreement", f"WITH {PAIRS} SELECT vec_id, count(*) FILTER (rs = 1 AND rt = 1)::DOUBLE AS same FROM pr GROUP BY vec_id")
def z9(spark, sf):
    return pairs(spark, sf).select("vec_id", D.top1_agreement(F.col("s"), F.col("t")).alias("same"))


_LOW, _PW = "(active AND overlap < 0.65)", "CASE WHEN active THEN weight ELSE 0 END"
_ROUTES = {
    "reverse_kl": ("1", "0", "1"), "forward_kl": ("0", "1", "2"), "fixed_mixture": ("0.5", "0.5", "3"),
    "prune_opd": ("weight", "0", "CASE WHEN weight < 1 THEN 4 ELSE 1 END"),
    "adaptive_v1": (f"CASE WHEN {_LOW} THEN 0 ELSE 1 END", f"CASE WHEN {_LOW} THEN 1.0 ELSE 0 END", f"CASE WHEN {_LOW} THEN 2 ELSE 1 END"),
    "adaptive_v2": ("1", f"CASE WHEN {_LOW} THEN 0.1 ELSE 0 END", f"CASE WHEN {_LOW} THEN 3 ELSE 1 END"),
    "prune_plus_forward": ("weight", f"CASE WHEN {_LOW} THEN 0.1 ELSE 0 END", f"CASE WHEN {_LOW} THEN 5 WHEN weight < 1 THEN 4 ELSE 1 END"),
}


@query("Z10_Z12_routing", f"""WITH {TOKENS}, pw AS (SELECT *, sum({_LOW}::INT) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM tok),
w AS (SELECT *, CASE WHEN active THEN least(greatest(1.0 - 0.01::DOUBLE * n, 0.5), 1.0) ELSE 0.0 END::DOUBLE AS weight FROM pw), m AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS mode, event_id, reverse_kl, forward_kl, CASE WHEN active THEN {r} ELSE 0 END::DOUBLE AS rc, CASE WHEN active THEN {f} ELSE 0 END::DOUBLE AS fc, CASE WHEN active THEN {c} ELSE 0 END::INT AS code FROM w" for m, (r, f, c) in _ROUTES.items()) + """)
SELECT mode, code, CASE code WHEN 0 THEN 'inactive' WHEN 1 THEN 'reverse' WHEN 2 THEN 'forward' WHEN 3 THEN 'reverse+forward' WHEN 4 THEN 'reverse_pruned' ELSE 'pruned_reverse+forward' END AS name,
count(*) AS n, round(sum(rc), 6) AS reverse_coef, round(sum(fc), 6) AS forward_coef, round(avg(rc * reverse_kl + fc * forward_kl), 6) AS mean_loss FROM m GROUP BY mode, code""")
def z10(spark, sf):
    """All modes in one pass: a row of coefficients for each mode, then loss and route (Z10, Z11, Z12)."""
    from quern.operators.sequence import prune_weights

    w = prune_weights(tokens(spark, sf))
    plans = []
    for mode in _ROUTES:
        rc, fc, code = D.routing(mode, F.col("active"), F.col("overlap"), F.col("weight"))
        plans.append(
            F.struct(
                F.lit(mode).alias("mode"),
                rc.cast("double").alias("rc"),
                fc.cast("double").alias("fc"),
                code.cast("int").alias("code"),
            )
        )
    m = w.select("reverse_kl", "forward_kl", F.explode(F.array(*plans)).alias("m")).select(
        "m.*",
        (F.col("m.rc") * F.col("reverse_kl") + F.col("m.fc") * F.col("forward_kl")).alias("loss"),
    )
    out = m.groupBy("mode", "code").agg(
        F.count("*").alias("n"),
        F.sum("rc").alias("reverse_coef"),
        F.sum("fc").alias("forward_coef"),
        F.avg("loss").alias("mean_loss"),
    )
    return r6(out.withColumn("name", D.route_name(F.col("code"))))


@query(
    "J7_target_rank",
    f"WITH {PAIRS} SELECT vec_id, max(CASE WHEN rs <= {K} THEN 1 ELSE 0 END) FILTER (i = vec_id % 64) = 1 AS inside, max(CASE WHEN rs <= {K} THEN rs END) FILTER (i = vec_id % 64) AS rank FROM pr GROUP BY vec_id",
)
def j7(spark, sf):
    ids, y = array_top_k(F.col("s"), K), (F.col("vec_id") % 64).cast("int")
    return pairs(spark, sf).select("vec_id", F.array_contains(ids, y).alias("inside"), joins.rank_in(ids, y).alias("rank"))


@query(
    "H1_ordered_intersection",
    f"WITH {PAIRS} SELECT vec_id, coalesce(string_agg(i::VARCHAR, ',' ORDER BY rs) FILTER (rs <= {K} AND rt <= {K}), '') AS ids FROM pr GROUP BY vec_id",
)
def h1(spark, sf):
    return pairs(spark, sf).select(
        "vec_id",
        F.array_join(
            F.transform(F.array_intersect(array_top_k(F.col("s"), K), array_top_k(F.col("t"), K)), lambda i: i.cast("string")),
            ",",
        ).alias("ids"),
    )


@query(
    "C14_common_vocabulary",
    f"WITH {PAIRS} SELECT vec_id, round(sum(s), 6) AS s, round(sum(t), 6) AS t FROM pr WHERE i < 50 GROUP BY vec_id",
)
def c14(spark, sf):
    short = F.slice(F.col("t"), 1, 50)
    return r6(pairs(spark, sf).select("vec_id", D.total(D.cropped(F.col("s"), short)).alias("s"), D.total(short).alias("t")))


#: Positions of rollouts: sixteen pairs are a sequence; the target is an entry's number.
_AT = f"""{PAIRS}, {_LSE}, spots AS (SELECT DISTINCT vec_id, vec_id // 16 AS seq_id, vec_id % 16 AS pos, vec_id % 10 <> 0 AS active, CASE WHEN (vec_id // 16) % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS seq_weight FROM pr)"""


def _positions(spark, sf):
    seq = F.floor(F.col("vec_id") / 16)
    weight = F.when(seq % 3 == 0, 0.0).otherwise(1.0)
    return pairs(spark, sf).select(
        "vec_id",
        seq.alias("seq_id"),
        (F.col("vec_id") % 16).alias("pos"),
        (F.col("vec_id") % 10 != 0).alias("active"),
        weight.alias("seq_weight"),
        "s",
        "t",
    )


def _local(rank: str, a: str, b: str, name: str) -> str:
    """Divergence of a from b and the entropy of a, normalised on the best of a."""
    return f"""{name}0 AS (SELECT vec_id, {a} - ln(sum(exp({a})) OVER w) AS p, {b} - ln(sum(exp({b})) OVER w) AS q FROM pr WHERE {rank} <= {K} WINDOW w AS (PARTITION BY vec_id)),
{name} AS (SELECT vec_id, sum(exp(p) * (p - q)) AS kl, -sum(exp(p) * ln(greatest(exp(p), 1e-12))) AS h FROM {name}0 GROUP BY vec_id)"""


_NAMES = {"overlap": "overlap", "reverse": "rev", "forward": "fwd", "token": "token"}
_MEANS = {
    "mean_reverse_loss": "rev",
    "mean_forward_loss": "fwd",
    "mean_token_loss": "token",
    "mean_overlap": "overlap",
    "low_overlap_fraction": "low::INT",
    "reverse_active_fraction": "(rc > 0)::INT",
    "forward_active_fraction": "(fc > 0)::INT",
    "reverse_plus_forward_fraction": "(rc > 0 AND fc > 0)::INT",
    "mean_reverse_coefficient": "rc",
    "mean_forward_coefficient": "fc",
    "mean_prune_weight": "weight",
    "mean_student_entropy": "hs",
    "mean_teacher_entropy": "ht",
    "mean_student_mass": "ms",
    "mean_teacher_mass": "mt",
    "top1_agreement": "same::INT",
}


@query("E16_loss_report", f"""WITH {_AT}, {_local("rs", "s", "t", "a")}, {_local("rt", "t", "s", "b")},
c AS (SELECT vec_id, count(*) FILTER (rs <= {K} AND rt <= {K}) / {K} AS overlap, sum(exp(s - zs)) FILTER (rs <= {K}) AS ms, sum(exp(t - zt)) FILTER (rt <= {K}) AS mt, count(*) FILTER (rs = 1 AND rt = 1) = 1 AS same FROM pr JOIN lse USING (vec_id) GROUP BY vec_id),
j AS (SELECT spots.*, c.* EXCLUDE (vec_id), a.kl AS rev, a.h AS hs, b.kl AS fwd, b.h AS ht, active AND overlap < 0.65 AS low FROM spots JOIN a USING (vec_id) JOIN b USING (vec_id) JOIN c USING (vec_id)),
w AS (SELECT *, CASE WHEN active THEN least(greatest(1.0 - 0.01::DOUBLE * sum(low::INT) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0.5), 1.0) ELSE 0 END AS weight,
  sum(active::INT) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS place, greatest(sum(active::INT) OVER (PARTITION BY seq_id), 1) AS n FROM j),
x AS (SELECT *, weight AS rc, CASE WHEN low THEN 0.1 ELSE 0 END::DOUBLE AS fc, place::DOUBLE / n AS rel FROM w), y AS (SELECT *, rc * rev + fc * fwd AS token FROM x),
per AS (SELECT seq_id, any_value(seq_weight) AS sw, coalesce(avg(token) FILTER (active), 0) AS m FROM y GROUP BY seq_id)
SELECT (SELECT round(sum(m * sw) / greatest(sum(sw), 1.0), 6) FROM per) AS loss, (SELECT round(avg(m), 6) FROM per) AS mean_per_sequence_loss, (SELECT round(avg((sw > 0)::INT), 6) FROM per) AS effective_sequence_fraction,
coalesce(min(place) FILTER (low), -1)::BIGINT AS first_low_overlap_position, 64 AS common_vocab_size, 64 AS student_vocab_size, 64 AS teacher_vocab_size, {K} AS reverse_top_k, {K} AS forward_top_k, {K} AS overlap_top_k,
""" + ", ".join(
    [f"round(avg({c}) FILTER (active), 6) AS {n}" for n, c in _MEANS.items()]
    + [f"round(corr(overlap, {_NAMES[n]}) FILTER (active), 6) AS overlap_{n}_corr" for n in ("reverse", "forward", "token")]
    + [f"round(quantile_cont({c}, {q}) FILTER (active), 6) AS {n}_p{round(q * 100)}" for n, c in _NAMES.items() for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)]
    + [f"round(coalesce(avg({c}) FILTER (active AND {w}), 0), 6) AS {n}_{r}" for n, c in _NAMES.items() for r, w in (("early", "rel <= 1.0::DOUBLE / 3"), ("middle", "rel > 1.0::DOUBLE / 3 AND rel <= 2.0::DOUBLE / 3"), ("late", "rel > 2.0::DOUBLE / 3"))]
) + " FROM y")
def e16(spark, sf):
    return r6(reports.loss_report(reports.scored_positions(_positions(spark, sf), K, "prune_plus_forward"), K))


@query("E27_eos_diagnostics", f"""WITH {_AT}, p AS (SELECT vec_id, sum(exp(s - zs)) FILTER (i IN (3, 7)) AS sp, sum(exp(t - zt)) FILTER (i IN (3, 7)) AS tp, bool_or(i = vec_id % 8 AND rs <= {K}) AS si, bool_or(i = vec_id % 8 AND rt <= {K}) AS ti FROM pr JOIN lse USING (vec_id) GROUP BY vec_id),
x AS (SELECT *, active AND vec_id % 8 IN (3, 7) AS fin, max(pos) OVER (PARTITION BY seq_id) AS last, CASE seq_id % 3 WHEN 1 THEN 'truncated' WHEN 2 THEN 'boxed' END AS kind, CASE WHEN seq_id % 6 = 2 THEN 1 ELSE 0 END AS app FROM spots JOIN p USING (vec_id)),
y AS (SELECT *, CASE WHEN pos = last - app THEN kind END AS cut FROM x)
SELECT round(count(*) FILTER (fin) / greatest(count(*) FILTER (active), 1), 6) AS eos_target_fraction, """ + ", ".join(
    f"round(coalesce(avg({s}p) FILTER (fin), 0), 6) AS {n}_eos_target_probability, round(coalesce(avg({s}i::INT) FILTER (fin), 0), 6) AS eos_target_in_{n}_top_k, " + ", ".join(
        f"round(coalesce(avg({s}p) FILTER (cut = '{c}'), 0), 6) AS {c}_{n}_next_eos_probability" for c in ("truncated", "boxed")
    )
    for s, n in (("s", "student"), ("t", "teacher"))
) + " FROM y")
def e27(spark, sf):
    from pyspark.sql import Window

    kind = F.when(F.col("seq_id") % 3 == 1, "truncated").when(F.col("seq_id") % 3 == 2, "boxed")
    last = F.max("pos").over(Window.partitionBy("seq_id"))
    cut = reports.next_position(kind, F.col("seq_id") % 6 == 2, F.col("pos"), last)
    rows = _positions(spark, sf).withColumns({"target": (F.col("vec_id") % 8).cast("int"), "cut": cut})
    return r6(reports.end_diagnostics(rows, [3, 7], K))
