"""Truncated divergences and related quantities of two score vectors at a position.

Vectors are arrays of double; only their best ``k`` entries and a log-sum-exp
enter, so a wide vocabulary is never exploded into rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.sequence import array_top_k, bound


def gather(values: Column, ids: Column) -> Column:
    return F.transform(ids, lambda i: F.get(values, i))


def log_sum_exp(values: Column) -> Column:
    def of(v: Column) -> Column:
        total = lambda top: top + F.ln(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
        return bound(F.array_max(v), total)

    return bound(values, of)


def log_softmax(values: Column) -> Column:
    return bound(values, lambda v: bound(log_sum_exp(v), lambda z: F.transform(v, lambda x: x - z)))


def cropped(values: Column, other: Column) -> Column:
    """The entries of the common vocabulary: the first min(size, size)."""
    return F.slice(values, F.lit(1), F.least(F.size(values), F.size(other)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def divergence(p: Column, q: Column) -> Column:
    """Sum of p (log p - log q) from arrays of log-probabilities."""
    return total(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)))


def _truncated_kl(first: Column, second: Column, k: int) -> Column:
    """KL(first || second) on the first's top k, both sides normalised on it."""
    return bound(
        array_top_k(first, k),
        lambda ids: divergence(log_softmax(gather(first, ids)), log_softmax(gather(second, ids))),
    )


def reverse_kl(student: Column, teacher: Column, k: int) -> Column:
    """KL(student || teacher) on the student's top k."""
    return _truncated_kl(student, teacher, k)


def forward_kl(student: Column, teacher: Column, k: int) -> Column:
    """KL(teacher || student) on the teacher's top k."""
    return _truncated_kl(teacher, student, k)


def overlap(student: Column, teacher: Column, k: int) -> Column:
    return F.size(F.array_intersect(array_top_k(student, k), array_top_k(teacher, k))) / F.least(F.lit(k), F.size(student))


def entropy(student: Column, k: int) -> Column:
    """Entropy of the normalised top k."""
    logs = log_softmax(bound(array_top_k(student, k), lambda ids: gather(student, ids)))
    return -total(F.transform(logs, lambda p: F.exp(p) * F.ln(F.greatest(F.exp(p), F.lit(1e-12)))))


def set_probability(values: Column, ids: Column) -> Column:
    """Probability of a set of ids; ids out of range count nothing."""

    def of(v: Column) -> Column:
        inside = F.filter(ids, lambda i: (i >= 0) & (i < F.size(v)))
        return bound(log_sum_exp(v), lambda z: total(F.transform(inside, lambda i: F.exp(F.get(v, i) - z))))

    return bound(values, of)


def top_mass(values: Column, k: int) -> Column:
    return set_probability(values, array_top_k(values, k))


def target_logp(values: Column, target: Column) -> Column:
    return F.get(values, F.greatest(target, F.lit(0))) - log_sum_exp(values)


def advantage(student: Column, teacher: Column, clip: float | None) -> Column:
    """student - teacher, held to [-clip, clip] where a clip is given."""
    raw = student - teacher
    return raw if clip is None else F.greatest(F.least(raw, F.lit(clip)), F.lit(-clip))


def top1_agreement(student: Column, teacher: Column) -> Column:
    return (array_top_k(student, 1)[0] == array_top_k(teacher, 1)[0]).cast("double")


#: Codes of loss routes. Fixed values.
ROUTES = {0: "inactive", 1: "reverse", 2: "forward", 3: "reverse+forward", 4: "reverse_pruned", 5: "pruned_reverse+forward"}


def route_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("unknown_"), code.cast("string")))


def routing(
    mode: str,
    active: Column,
    overlap_: Column,
    weight: Column,
    threshold: float = 0.65,
    alpha: float = 0.5,
    forward_lambda: float | None = None,
) -> tuple[Column, Column, Column]:
    """(reverse coefficient, forward coefficient, route code) of a mode; inactive rows get 0, 0, 0."""
    low = active & (overlap_ < threshold)
    one, none = F.lit(1.0), F.lit(0.0)
    lam = F.lit(forward_lambda if forward_lambda is not None else {"adaptive_v1": 1.0}.get(mode, 0.1))
    plans = {
        "reverse_kl": (one, none, F.lit(1)),
        "forward_kl": (none, one, F.lit(2)),
        "fixed_mixture": (F.lit(1 - alpha), F.lit(alpha), F.lit(3)),
        "prune_opd": (weight, none, F.when(weight < 1, 4).otherwise(1)),
        "adaptive_v1": (F.when(low, none).otherwise(one), F.when(low, lam).otherwise(none), F.when(low, 2).otherwise(1)),
        "adaptive_v2": (one, F.when(low, lam).otherwise(none), F.when(low, 3).otherwise(1)),
        "prune_plus_forward": (weight, F.when(low, lam).otherwise(none), F.when(low, 5).when(weight < 1, 4).otherwise(1)),
    }
    if mode not in plans:
        raise ValueError(f"unknown mode {mode}")
    return tuple(F.when(active, c).otherwise(F.lit(0) if i == 2 else none) for i, c in enumerate(plans[mode]))
