"""Run configuration from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

STAGES = ("exact", "near")


@dataclass(frozen=True)
class AuditConfig:
    out_dir: str
    stages: tuple[str, ...]
    modality: str = "T1w"
    root: str | None = None
    candidates_csv: str | None = None
    valid_csv: str | None = None
    verify: bool = False
    min_similarity: float = 0.92
    topk: int = 500
    use_ivf: bool = True
    nlist: int = 4096
    nprobe: int = 64
    train_size: int = 200_000
    filter_mode: str = "post"
    max_candidates: int | None = None
    extra: dict = field(default_factory=dict)


def resolve_stages(stages) -> tuple[str, ...]:
    """Known stages in their order, each once; ValueError on others or none."""
    names = [stages] if isinstance(stages, str) else list(stages)
    unknown = sorted(set(names) - set(STAGES))
    if unknown or not names:
        raise ValueError(f"stages are any of {STAGES}, not {unknown or 'none'}")
    return tuple(s for s in STAGES if s in names)


def _table(raw: dict, name: str) -> dict:
    t = raw.get(name)
    if not isinstance(t, dict):
        raise ValueError(f"table [{name}] is missing")
    return t


def _text(t: dict, key: str) -> str | None:
    v = t.get(key)
    if v is not None and not isinstance(v, str):
        raise ValueError(f"{key} must be a string")
    return v.strip() or None if v else None


def read_config(path: str) -> AuditConfig:
    """An AuditConfig; exactly one of root, candidates_csv and valid_csv for the exact stage."""
    raw = tomllib.loads(Path(path).read_text())
    run, exact, near = _table(raw, "run"), raw.get("exact", {}), raw.get("near", {})
    stages = resolve_stages(run.get("stages", STAGES))
    inputs = {k: _text(exact, k) for k in ("root", "candidates_csv", "valid_csv")}
    if "exact" in stages and sum(v is not None for v in inputs.values()) != 1:
        raise ValueError("the exact stage needs exactly one of root, candidates_csv and valid_csv")
    out = _text(run, "out_dir") or _text(run, "out")
    if not out:
        raise ValueError("out_dir is missing")
    known = {k: near[k] for k in ("min_similarity", "topk", "use_ivf", "nlist", "nprobe", "train_size", "filter_mode", "max_candidates") if k in near}
    return AuditConfig(out_dir=out, stages=stages, modality=_text(exact, "modality") or "T1w", verify=bool(exact.get("verify", False)), **inputs, **known, extra=raw)
