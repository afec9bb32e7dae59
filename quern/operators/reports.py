"""Reports over scored positions: one aggregation each, whatever the number of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import distribution as D
from quern.operators import masked
from quern.operators.sequence import array_top_k, prune_weights, response_positions
from quern.sources.tables import stored

LOSSES = ("overlap", "reverse", "forward", "token")


def scored_positions(pairs: DataFrame, k: int, mode: str, threshold: float = 0.65) -> DataFrame:
    """Divergences, overlap, entropies, coefficients and token loss of positions with score vectors ``s`` and ``t``.

    ``pairs`` has seq_id, pos, active, seq_weight, s, t.
    """
    s, t = D.cropped(F.col("s"), F.col("t")), D.cropped(F.col("t"), F.col("s"))
    sizes = {"student_size": F.size("s"), "teacher_size": F.size("t")}
    rows = pairs.withColumns(sizes | {"s": s, "t": t}).withColumns(
        {"ids": array_top_k(F.col("s"), k), "teacher_ids": array_top_k(F.col("t"), k)}
    )
    s, t = F.col("s"), F.col("t")
    rows = rows.withColumns({
        "overlap": F.size(F.array_intersect("ids", "teacher_ids")) / F.size("ids"),
        "reverse": D.reverse_kl(s, t, k),
        "forward": D.forward_kl(s, t, k),
        "student_entropy": D.entropy(s, k),
        "teacher_entropy": D.entropy(t, k),
        "student_mass": D.set_probability(s, F.col("ids")),
        "teacher_mass": D.set_probability(t, F.col("teacher_ids")),
        "same_top": F.get("ids", 0) == F.get("teacher_ids", 0),
    }).drop("s", "t", "ids", "teacher_ids")
    weighted = prune_weights(rows, threshold)
    reverse, forward, _ = D.routing(mode, F.col("active"), F.col("overlap"), F.col("weight"), threshold)
    weighted = weighted.withColumns({"reverse_coef": reverse.cast("double"), "forward_coef": forward.cast("double")})
    token = F.col("reverse_coef") * F.col("reverse") + F.col("forward_coef") * F.col("forward")
    return response_positions(weighted.withColumn("token", token))


def loss_report(scored: DataFrame, k: int, threshold: float = 0.65) -> DataFrame:
    """24 scalars, six quantiles and three regions of overlap and losses, two entropies and three full-distribution means."""
    on = F.col("active")
    own = Window.partitionBy("seq_id")
    rows = stored(scored, "scored").withColumns({
        "seq_loss": F.coalesce(F.avg(F.when(on, F.col("token"))).over(own), F.lit(0.0)),
        "head": F.col("pos") == F.min("pos").over(own),
    })
    mean = lambda c: masked.masked_mean(c.cast("double"), on)
    head = lambda c: F.when(F.col("head"), c)
    low = on & (F.col("overlap") < threshold)
    weight, rev, fwd = F.col("seq_weight"), F.col("reverse_coef"), F.col("forward_coef")
    full = F.greatest(F.sum(head(weight)), F.lit(1.0))
    scalars = {
        "loss": F.coalesce(F.sum(head(F.col("seq_loss") * weight)) / full, F.lit(0.0)),
        "mean_per_sequence_loss": F.coalesce(F.avg(head(F.col("seq_loss"))), F.lit(0.0)),
        "effective_sequence_fraction": F.coalesce(F.avg(head((weight > 0).cast("double"))), F.lit(0.0)),
        "mean_reverse_loss": mean(F.col("reverse")),
        "mean_forward_loss": mean(F.col("forward")),
        "mean_token_loss": mean(F.col("token")),
        "mean_overlap": mean(F.col("overlap")),
        "low_overlap_fraction": mean(low),
        "reverse_active_fraction": mean(rev > 0),
        "forward_active_fraction": mean(fwd > 0),
        "reverse_plus_forward_fraction": mean((rev > 0) & (fwd > 0)),
        "mean_reverse_coefficient": mean(rev),
        "mean_forward_coefficient": mean(fwd),
        "mean_prune_weight": mean(F.col("weight")),
        "first_low_overlap_position": F.coalesce(F.min(F.when(low, F.col("response_pos") + 1)), F.lit(-1)),
        "common_vocab_size": F.max(F.least("student_size", "teacher_size")),
        "student_vocab_size": F.max("student_size"),
        "teacher_vocab_size": F.max("teacher_size"),
        **{f"{n}_top_k": F.max(F.least(F.lit(k), "student_size", "teacher_size")) for n in ("reverse", "forward", "overlap")},
        **{f"overlap_{n}_corr": masked.masked_correlation(F.col("overlap"), F.col(n), on) for n in LOSSES[1:]},
        "mean_student_entropy": mean(F.col("student_entropy")),
        "mean_teacher_entropy": mean(F.col("teacher_entropy")),
        "mean_student_mass": mean(F.col("student_mass")),
        "mean_teacher_mass": mean(F.col("teacher_mass")),
        "top1_agreement": mean(F.col("same_top")),
    }
    third = masked.region(F.col("relative_pos"))
    regions = [
        masked.masked_mean(F.col(n), on & (third == name)).alias(f"{n}_{name}") for n in LOSSES for name in ("early", "middle", "late")
    ]
    report = rows.agg(*[c.alias(n) for n, c in scalars.items()], *regions).withColumn("__one", F.lit(1))
    quantiles = masked.masked_quantiles(rows, [], {n: F.col(n) for n in LOSSES}, on).withColumn("__one", F.lit(1))
    return report.join(quantiles, "__one").drop("__one")


def end_diagnostics(positions: DataFrame, stops: list[int], k: int) -> DataFrame:
    """How likely ends are: where the target is one, and behind rollouts that were cut.

    ``positions`` has active, target, s and t, and ``cut``: ``truncated`` or
    ``boxed`` on the position whose scores predict what would follow, else null.
    """
    ids = F.array(*[F.lit(i) for i in stops])
    end = F.col("active") & F.col("target").isin(stops)
    mean = lambda c, mask: masked.masked_mean(c.cast("double"), mask)
    sides = {"student": F.col("s"), "teacher": F.col("t")}
    rows = positions.withColumns(
        {f"{n}_p": D.set_probability(v, ids) for n, v in sides.items()}
        | {f"{n}_in": F.array_contains(array_top_k(v, k), F.col("target")) for n, v in sides.items()}
    )
    out = [(F.count_if(end) / F.greatest(F.count_if(F.col("active")), F.lit(1))).alias("eos_target_fraction")]
    for n in sides:
        out.append(mean(F.col(f"{n}_p"), end).alias(f"{n}_eos_target_probability"))
        out.append(mean(F.col(f"{n}_in"), end).alias(f"eos_target_in_{n}_top_k"))
        for cut in ("truncated", "boxed"):
            out.append(mean(F.col(f"{n}_p"), F.coalesce(F.col("cut") == cut, F.lit(False))).alias(f"{cut}_{n}_next_eos_probability"))
    return rows.agg(*out)


def next_position(cut: Column, appended: Column, pos: Column, last: Column) -> Column:
    """``cut`` on the position that predicts what follows a rollout: the last, or the one before an appended end."""
    return F.when(pos == last - F.coalesce(appended, F.lit(False)).cast("int"), cut)
