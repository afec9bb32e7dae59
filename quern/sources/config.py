"""Experiment settings: inheritance, overrides, derived lengths and validation, on the driver."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

BACKENDS, STRATEGIES = {"adaptive_opd", "sampled_rkl"}, {"full", "esr"}
MODES = {"reverse_kl", "forward_kl", "fixed_mixture", "prune_opd", "adaptive_v1", "adaptive_v2", "prune_plus_forward"}
OBSOLETE = {
    "kd_top_k",
    "kl_renorm_topk",
    "curriculum_lengths",
    "curriculum_boundaries",
    "reflection_rollout_max_tokens",
    "reflection_chunk_size",
    "beta",
    "seq_kd",
    "lmbda",
}


def parsed(text: str) -> Any:
    """YAML where its reader is installed, else JSON, else the text itself."""
    try:
        import yaml
    except ImportError:
        try:
            return json.loads(text)
        except ValueError:
            return {"null": None, "~": None, "": None}.get(text.strip(), text.strip())
    return yaml.safe_load(text)


def merged(base: dict, over: dict) -> dict:
    """Maps merge by key, all else is replaced."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load(path: str | Path, overrides: list[str] = (), _chain: tuple[Path, ...] = ()) -> dict[str, Any]:
    """A file merged over its ``base_config`` and so on, with ``a.b=value`` overrides on top."""
    path = Path(path).resolve()
    if path in _chain:
        raise ValueError(f"base_config runs in a circle at {path}")
    own = parsed(path.read_text("utf-8")) or {}
    if not isinstance(own, dict):
        raise ValueError(f"{path} is not a mapping")
    base = own.pop("base_config", None)
    if base is not None:
        found = [p for p in (Path(base), path.parent / base) if p.exists()]
        if not found:
            raise FileNotFoundError(f"base_config {base} of {path}")
        own = merged(load(found[0], (), (*_chain, path)), own)
    for item in overrides:
        key, sign, value = item.partition("=")
        if not sign:
            raise ValueError(f"{item} is not KEY=VALUE")
        *outer, last = key.split(".")
        at = own
        for name in outer:
            at = at.setdefault(name, {})
        at[last] = parsed(value)
    return own


def with_lengths(cfg: dict[str, Any]) -> dict[str, Any]:
    source = {"full": "full_max_new_tokens", "esr": "prefix_length"}.get(cfg.get("strategy", "full"))
    if source is None:
        raise ValueError(f"unknown strategy {cfg['strategy']}")
    horizon, longest = int(cfg[source]), int(cfg["max_length"])
    if cfg.get("auto_shrink_max_length"):
        longest = min(longest, int(cfg["max_prompt_length"]) + horizon)
    return cfg | {"effective_max_new_tokens": horizon, "effective_max_new_tokens_source": source, "effective_max_length": longest}


def problems(cfg: dict[str, Any]) -> list[str]:
    """All that is wrong with a configuration, in words; empty if it is valid."""
    out = []
    backend, strategy, mode = (str(cfg.get(k, "")) for k in ("loss_backend", "strategy", "opd_loss_mode"))

    def must(ok: bool, said: str) -> None:
        if not ok:
            out.append(said)

    def share(key: str, default: float) -> None:
        must(0 <= float(cfg.get(key, default)) <= 1, f"{key} must be in [0, 1]")

    must(backend in BACKENDS, f"loss_backend {backend!r} is unknown")
    must(strategy in STRATEGIES, f"strategy {strategy!r} is unknown")
    if backend == "adaptive_opd":
        must(mode in MODES, f"opd_loss_mode {mode!r} is unknown")
        for key in ("reverse_top_k", "forward_top_k", "overlap_top_k"):
            must(int(cfg.get(key, 0)) > 0, f"{key} must be above 0")
    if backend == "sampled_rkl":
        must(mode == "sampled_rkl", "sampled_rkl needs the mode of that name")
    if strategy == "esr":
        must(int(cfg.get("prefix_length", 0)) > 0, "prefix_length must be above 0")
    if mode == "fixed_mixture":
        share("mixture_forward_alpha", 0.5)
    if mode in ("prune_opd", "prune_plus_forward"):
        share("prune_w_base", 0.5)
    share("truncated_rollout_weight", 0.0)
    must(cfg.get("loss_normalization", "per_sequence") in ("per_sequence", "per_token"), "loss_normalization is unknown")
    must(int(cfg.get("rollout_repetition_ngram_size", 4)) > 0, "rollout_repetition_ngram_size must be above 0")
    cut, append = (cfg.get(k, False) for k in ("rollout_truncate_after_boxed_answer", "rollout_append_eos_after_boxed_answer"))
    must(isinstance(cut, bool) and isinstance(append, bool), "switches of the boxed answer must be booleans")
    must(not append or bool(cut), "appending an end needs truncation after the boxed answer")
    must(isinstance(cfg.get("rollout_extra_eos_tokens", []), (str, list, tuple)), "rollout_extra_eos_tokens must be text or a list")
    out += [f"{k} is obsolete" for k in sorted(OBSOLETE & cfg.keys())]
    return out


def validate(cfg: dict[str, Any]) -> None:
    if found := problems(cfg):
        raise ValueError("; ".join(found))


def dump(cfg: dict[str, Any], path: str | Path) -> None:
    Path(path).write_text(json.dumps(cfg, indent=2, ensure_ascii=False, default=str), "utf-8")
