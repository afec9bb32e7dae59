"""Queries on token statistics: groupings, masked aggregates, windows, top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import masked, sequence, token_stats
from quern.operators.quantiles import quantiles
from quern.plans.facts import POSITIONS, TOKENS, r6, read, tokens
from quern.plans.registry import query
from quern.sources.tables import stored

_M = "round(avg(overlap), 6) AS mean_overlap, round(avg(reverse_kl), 6) AS mean_reverse_kl, round(avg(forward_kl), 6) AS mean_forward_kl, round(avg(final_loss), 6) AS mean_final_loss, round(coalesce(avg(student_logp), 0), 6) AS mean_student_target_logp, round(coalesce(avg(teacher_logp), 0), 6) AS mean_teacher_target_logp"


def stats_sql(keys: str, names: str, extra: str = "") -> str:
    return f"""WITH {TOKENS}{extra}, g AS (SELECT {keys}, count(*) AS "count", {_M} FROM src GROUP BY ALL),
h AS (SELECT {names}, '{{' || string_agg('"' || r || '": ' || n, ', ' ORDER BY r) || '}}' AS routes FROM (SELECT {keys}, route AS r, count(*) AS n FROM src GROUP BY ALL) GROUP BY ALL)
SELECT g.*, h.routes FROM g JOIN h USING ({names})"""


@query("E1_group_stats", stats_sql("token_id, token", "token_id, token").replace("FROM src", "FROM tok"))
def e1(spark, sf):
    return r6(token_stats.group_stats(tokens(spark, sf), "token_id", "token"))


@query(
    "E2_by_route",
    f'WITH {TOKENS} SELECT route, count(*) AS "count", {_M}, \'{{"\' || route || \'": \' || count(*) || \'}}\' AS routes FROM tok GROUP BY route',
)
def e2(spark, sf):
    t = tokens(spark, sf)
    return r6(token_stats.group_stats(t, "route"))


_OBIN = "'[0.' || least(floor(greatest(least(overlap, 1.0), 0.0) * 10), 9)::INT || ',' || CASE WHEN least(floor(overlap * 10), 9) = 9 THEN '1.0' ELSE '0.' || (floor(overlap * 10)::INT + 1) END || ']'"
_PBIN = "(((position - 1) // 50) * 50 + 1) || '-' || (((position - 1) // 50 + 1) * 50)"


@query("E3_by_overlap_bin", stats_sql("overlap_bin", "overlap_bin", f", src AS (SELECT *, {_OBIN} AS overlap_bin FROM tok)"))
def e3(spark, sf):
    return r6(token_stats.group_stats(token_stats.binned(tokens(spark, sf)), "overlap_bin"))


@query("E4_by_position_bin", stats_sql("position_bin", "position_bin", f", src AS (SELECT *, {_PBIN} AS position_bin FROM tok)"))
def e4(spark, sf):
    return r6(token_stats.group_stats(token_stats.binned(tokens(spark, sf)), "position_bin"))


@query(
    "E5_route_histogram",
    f"""WITH {TOKENS} SELECT token_id, '{{' || string_agg('"' || route || '": ' || n, ', ' ORDER BY route) || '}}' AS routes FROM (SELECT token_id, route, count(*) AS n FROM tok GROUP BY ALL) GROUP BY token_id""",
)
def e5(spark, sf):
    return token_stats.group_stats(tokens(spark, sf), "token_id").select("token_id", "routes")


@query("E6_all_groupings", f"""WITH {TOKENS}, src AS (SELECT *, {_OBIN} AS overlap_bin, {_PBIN} AS position_bin FROM tok)
SELECT 'token' AS "grouping", token_id || ':' || token AS token_key, NULL AS route, NULL AS overlap_bin, NULL AS position_bin, count(*) AS "count", {_M} FROM src GROUP BY token_id, token
UNION ALL SELECT 'route', '', route, NULL, NULL, count(*), {_M} FROM src GROUP BY route
UNION ALL SELECT 'overlap', '', NULL, overlap_bin, NULL, count(*), {_M} FROM src GROUP BY overlap_bin
UNION ALL SELECT 'position', '', NULL, NULL, position_bin, count(*), {_M} FROM src GROUP BY position_bin""")
def e6(spark, sf):
    return r6(token_stats.all_groupings(tokens(spark, sf)))


@query(
    "E7_counters",
    f"WITH {TOKENS} SELECT count(DISTINCT seq_id) AS samples, count(*) AS tokens, count(DISTINCT (token_id, token)) AS unique_tokens FROM tok",
)
def e7(spark, sf):
    return token_stats.counters(tokens(spark, sf))


@query(
    "E8_masked_mean",
    f"WITH {TOKENS} SELECT route, round(coalesce(avg(final_loss) FILTER (active), 0), 6) AS m, round(coalesce(avg(final_loss) FILTER (overlap > 5), 0), 6) AS none FROM tok GROUP BY route",
)
def e8(spark, sf):
    return r6(tokens(spark, sf).groupBy("route").agg(masked.masked_mean(F.col("final_loss"), F.col("active")).alias("m"), masked.masked_mean(F.col("final_loss"), F.col("overlap") > 5).alias("none")))


@query(
    "E9_sequence_mean",
    f"WITH {TOKENS} SELECT round(sum(m * w) / greatest(sum(w), 1.0), 6) AS loss FROM (SELECT avg(final_loss) AS m, first(seq_weight) AS w FROM tok WHERE active GROUP BY seq_id)",
)
def e9(spark, sf):
    return r6(masked.sequence_mean(tokens(spark, sf), "final_loss"))


@query(
    "E10_token_mean",
    f"WITH {TOKENS} SELECT round(sum(final_loss * seq_weight) / greatest(sum(seq_weight), 1.0), 6) AS loss FROM tok WHERE active",
)
def e10(spark, sf):
    return r6(masked.token_mean(tokens(spark, sf), "final_loss"))


_Q = ", ".join(f"round(coalesce(quantile_cont(overlap, {q}) FILTER (active), 0), 6) AS p{round(q * 100)}" for q in masked.QUANTILES)


@query("E11_masked_quantiles", f"WITH {TOKENS} SELECT route, {_Q} FROM tok GROUP BY route")
def e11(spark, sf):
    got = masked.masked_quantiles(tokens(spark, sf), ["route"], {"overlap": F.col("overlap")}, F.col("active"))
    return r6(got.toDF(*[c.removeprefix("overlap_") for c in got.columns]))


@query(
    "E12_masked_correlation",
    f"WITH {TOKENS} SELECT route, round(coalesce(corr(reverse_kl, forward_kl) FILTER (active), 0), 6) AS r, 0.0::DOUBLE AS flat FROM tok GROUP BY route",
)
def e12(spark, sf):
    return r6(tokens(spark, sf).groupBy("route").agg(masked.masked_correlation(F.col("reverse_kl"), F.col("forward_kl"), F.col("active")).alias("r"), masked.masked_correlation(F.col("reverse_kl"), F.lit(1.0), F.col("active")).alias("flat")))


@query("E15_median", f"WITH {TOKENS} SELECT route, round(median(final_loss), 6) AS med FROM tok GROUP BY route")
def e15(spark, sf):
    return r6(quantiles(tokens(spark, sf), ["route"], {"med": F.col("final_loss")}, (0.5,)).withColumnRenamed("med_p50", "med"))


_THIRDS = {
    "early": "relative_pos <= 1.0::DOUBLE / 3",
    "middle": "relative_pos > 1.0::DOUBLE / 3 AND relative_pos <= 2.0::DOUBLE / 3",
    "late": "relative_pos > 2.0::DOUBLE / 3",
}


@query(
    "E17_region_means",
    f"WITH {TOKENS}, {POSITIONS} SELECT " + ", ".join(f"round(coalesce(avg({v}) FILTER (active AND {c}), 0), 6) AS {v}_{n}" for v in ("overlap", "final_loss") for n, c in _THIRDS.items()) + " FROM posn",
)
def e17(spark, sf):
    return r6(masked.region_means(sequence.response_positions(tokens(spark, sf)), ["overlap", "final_loss"]))


@query(
    "E18_cut_means",
    f"WITH {TOKENS}, {POSITIONS} SELECT round(coalesce(avg(overlap) FILTER (active AND response_pos >= 0 AND response_pos < 8), 0), 6) AS overlap_0_8, round(coalesce(avg(overlap) FILTER (active AND response_pos >= 8), 0), 6) AS overlap_8_end, round(coalesce(avg(overlap) FILTER (active AND response_pos = 0), 0), 6) AS overlap_at_0, round(coalesce(avg(overlap) FILTER (active AND response_pos = 5), 0), 6) AS overlap_at_5 FROM posn",
)
def e18(spark, sf):
    return r6(masked.cut_means(sequence.response_positions(tokens(spark, sf)), "overlap", cuts=(0, 8), points=(0, 5)))


@query(
    "E19_first_position",
    f"WITH {TOKENS}, {POSITIONS} SELECT seq_id, coalesce(min(response_pos + 1) FILTER (active AND overlap < 0.1), -1) AS first_pos FROM posn GROUP BY seq_id",
)
def e19(spark, sf):
    return masked.first_position(sequence.response_positions(tokens(spark, sf)), F.col("overlap") < 0.1)


@query(
    "E20_kl_ratio",
    f"WITH {TOKENS} SELECT round(avg(reverse_kl) FILTER (active), 6) AS reverse_mean, round(avg(forward_kl) FILTER (active), 6) AS forward_mean, round(avg(forward_kl) FILTER (active) / (avg(reverse_kl) FILTER (active) + 1e-8), 6) AS ratio FROM tok",
)
def e20(spark, sf):
    rev, fwd = (masked.masked_mean(F.col(c), F.col("active")) for c in ("reverse_kl", "forward_kl"))
    return r6(tokens(spark, sf).agg(rev.alias("reverse_mean"), fwd.alias("forward_mean"), (fwd / (rev + 1e-8)).alias("ratio")))


_PRUNED = f"""{TOKENS}, pw AS (SELECT *, sum((active AND overlap < 0.65)::INT) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS low_count FROM tok),
pr AS (SELECT *, CASE WHEN active THEN least(greatest(1.0 - 0.01::DOUBLE * low_count, 0.5), 1.0) ELSE 0.0 END::DOUBLE AS weight FROM pw)"""


@query(
    "E21_prune_statistics",
    f"WITH {_PRUNED} SELECT seq_id, round(coalesce(quantile_cont(weight, 0.5) FILTER (active), 0), 6) AS median_weight, coalesce(min(pos) FILTER (active AND weight < 1), -1) AS first_pruned, round(sum(weight), 6) AS effective_length FROM pr GROUP BY seq_id",
)
def e21(spark, sf):
    p = stored(sequence.prune_weights(tokens(spark, sf)).select("seq_id", "pos", "active", "weight"), "pruned")
    on = F.col("active")
    sums = p.groupBy("seq_id").agg(
        F.coalesce(F.min(F.when(on & (F.col("weight") < 1), F.col("pos"))), F.lit(-1)).alias("first_pruned"),
        F.sum("weight").alias("effective_length"),
    )
    medians = masked.masked_quantiles(p, ["seq_id"], {"weight": F.col("weight")}, on, (0.5,))
    return r6(medians.join(sums, "seq_id").select("seq_id", F.col("weight_p50").alias("median_weight"), "first_pruned", "effective_length"))


@query("F1_prune_weight", f"WITH {_PRUNED} SELECT event_id, low_count, round(weight, 6) AS weight FROM pr")
def f1(spark, sf):
    return r6(sequence.prune_weights(tokens(spark, sf)).select("event_id", "low_count", "weight"))


@query(
    "F2_prune_weight_plain",
    f"WITH {TOKENS} SELECT event_id, CASE WHEN NOT active THEN 0.0 WHEN overlap < 0.65 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM tok",
)
def f2(spark, sf):
    return sequence.prune_weights(tokens(spark, sf), cumulative=False).select("event_id", "weight")


@query(
    "F3_F4_response_position",
    f"WITH {TOKENS}, {POSITIONS} SELECT event_id, response_pos, round(relative_pos, 6) AS relative_pos FROM posn",
)
def f34(spark, sf):
    return r6(sequence.response_positions(tokens(spark, sf)).select("event_id", "response_pos", "relative_pos"))


@query(
    "F5_char_spans",
    f"WITH {TOKENS} SELECT event_id, sum(length(route)) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS end_char, sum(length(route)) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT - length(route) AS start_char FROM tok",
)
def f5(spark, sf):
    return sequence.char_spans(tokens(spark, sf), "route").select("event_id", "end_char", "start_char")


@query(
    "F6_top_k",
    f"WITH {TOKENS} SELECT seq_id, event_id, rank FROM (SELECT seq_id, event_id, row_number() OVER (PARTITION BY seq_id ORDER BY final_loss DESC, event_id)::INT AS rank FROM tok) WHERE rank <= 5",
)
def f6(spark, sf):
    return sequence.top_k(tokens(spark, sf), 5, ["seq_id"], "final_loss", "event_id").select("seq_id", "event_id", "rank")


@query("F7_round_robin", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 7 AS part FROM events")
def f7(spark, sf):
    return sequence.round_robin(read(spark, sf, "events").select("event_id"), 7, "event_id")


@query(
    "F9_groups_of_n",
    "SELECT g, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS g FROM events) GROUP BY g",
)
def f9(spark, sf):
    numbered = sequence.row_index(read(spark, sf, "events").select("event_id"), "event_id")
    return numbered.groupBy(F.floor(F.col("row_index") / 16).alias("g")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("C12_masks", f"WITH {TOKENS} SELECT event_id, active, active AND overlap < 0.65 AS low FROM tok")
def c12(spark, sf):
    return tokens(spark, sf).select("event_id", "active", (F.col("active") & (F.col("overlap") < 0.65)).alias("low"))


@query(
    "C13_shift",
    f"WITH {TOKENS} SELECT event_id, next_label FROM (SELECT event_id, lead(token_id) OVER (PARTITION BY seq_id ORDER BY pos) AS next_label FROM tok) WHERE next_label IS NOT NULL",
)
def c13(spark, sf):
    return sequence.shifted(tokens(spark, sf), "token_id").select("event_id", "next_label")


@query("C15_debug_rows", f"WITH {TOKENS} SELECT seq_id, event_id FROM tok WHERE pos < 3 AND seq_id % 4 = 0")
def c15(spark, sf):
    return tokens(spark, sf).where((F.col("pos") < 3) & (F.pmod("seq_id", F.lit(4)) == 0)).select("seq_id", "event_id")


@query(
    "G1_highest_loss",
    f"WITH {TOKENS} SELECT row_id, round(final_loss, 6) AS final_loss FROM tok ORDER BY tok.final_loss DESC, row_id DESC LIMIT 500",
)
def g1(spark, sf):
    return r6(token_stats.highest_loss(tokens(spark, sf)).select("row_id", "final_loss"))


@query(
    "G2_sorted_tokens",
    f"WITH {TOKENS} SELECT token_id, rank FROM (SELECT token_id, row_number() OVER (ORDER BY round(m, 6) DESC, n DESC, token_id)::INT AS rank FROM (SELECT token_id, avg(final_loss) AS m, count(*) AS n FROM tok GROUP BY token_id))",
)
def g2(spark, sf):
    from pyspark.sql import Window

    means = tokens(spark, sf).groupBy("token_id").agg(F.round(F.avg("final_loss"), 6).alias("m"), F.count("*").alias("n"))
    return means.select("token_id", F.row_number().over(Window.orderBy(F.desc("m"), F.desc("n"), "token_id")).alias("rank"))


@query(
    "G3_position_bins_in_order",
    f"WITH {TOKENS} SELECT {_PBIN} AS position_bin, (position - 1) // 50 AS position_no, count(*) AS n FROM tok GROUP BY ALL",
)
def g3(spark, sf):
    return token_stats.binned(tokens(spark, sf)).groupBy("position_bin", "position_no").agg(F.count("*").alias("n")).orderBy("position_no")


@query("G5_head", "SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def g5(spark, sf):
    return read(spark, sf, "events").select("event_id").orderBy("event_id").limit(100)


@query("G6_offset_limit", "SELECT event_id FROM events ORDER BY event_id LIMIT 20 OFFSET 30")
def g6(spark, sf):
    return read(spark, sf, "events").select("event_id").orderBy("event_id").offset(30).limit(20)


@query("G7_cut_after_filter", "SELECT event_id FROM events WHERE value > 0 ORDER BY event_id LIMIT 50")
def g7(spark, sf):
    return read(spark, sf, "events").where("value > 0").select("event_id").orderBy("event_id").limit(50)


@query("G4_shuffle", "SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS place FROM events")
def g4(spark, sf):
    """The place of every row in a seeded shuffle."""
    e = read(spark, sf, "events").select("event_id")
    return sequence.shuffled(e, 42, "event_id")
