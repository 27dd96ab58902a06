"""Engine settings: defaults, environment and command-line flags."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds of one engine; `decisive` has no flag."""

    knn: int = 6
    grounded: float = 0.8
    refuse: float = 0.5
    decisive: float = 0.5
    evidence_min_score: float = 0.35
    verify_timeout_ms: int = 30_000
    embedding: str = "local"
    verifier: str = "auto"
    reindex: bool = False
    watch_polling: bool = False
    log_level: str = "info"

    @classmethod
    def from_args(cls, args: list[str], env: dict[str, str] | None = None) -> EngineConfig:
        """Settings from flags over environment over defaults; flags that are unknown or not numeric are ignored."""
        env = dict(os.environ) if env is None else env
        out = cls(
            embedding=env.get("FACTLOOM_EMBEDDING", cls.embedding),
            verifier=env.get("FACTLOOM_VERIFIER", cls.verifier),
            watch_polling=env.get("FACTLOOM_WATCH_POLLING", "").lower() in ("1", "true"),
            log_level=env.get("FACTLOOM_LOG_LEVEL", cls.log_level),
        )
        kinds = {f.name: type(getattr(out, f.name)) for f in fields(cls)}
        it = iter(args)
        for arg in it:
            name, given, value = arg.partition("=")
            name = name.removeprefix("--").replace("-", "_").replace("_threshold", "")
            if not arg.startswith("--") or name not in kinds or name == "decisive":
                continue
            if kinds[name] is bool:
                out = replace(out, **{name: True})
                continue
            value = value if given else next(it, "")
            try:
                out = replace(out, **{name: kinds[name](value)})
            except ValueError:
                continue
        return out
