"""Settings of a run: defaults, a YAML file over them, and ${NAME} from the environment."""

from __future__ import annotations

import os
import re
from copy import deepcopy
from pathlib import Path
from typing import Any

#: Defaults by section; a YAML file need only have what differs.
DEFAULTS: dict[str, dict[str, Any]] = {
    "text": {"detector": "rules", "verify_checksums": True, "chunk_size": 6000, "title_level_limit": "auto", "value_lengths": [2, 64], "min_title_sections": 3},
    "image": {"enabled": False, "classes": [], "fields": None, "score_threshold": 0.5, "mosaic_factor": 16, "text_confidence": 0.5},
    "output": {"audit": False, "recoverable": False},
}


def expanded(value: Any) -> Any:
    """Strings with ${NAME} as the environment has it (empty where it doesn't), in lists and mappings too."""
    match value:
        case str():
            return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
        case list():
            return [expanded(x) for x in value]
        case dict():
            return {k: expanded(x) for k, x in value.items()}
    return value


def merged(base: dict, over: dict | None) -> dict:
    """base with what `over` says, mapping by mapping; lists and values are replaced."""
    out = deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def load(path: str | Path | None = None, section: str | None = None) -> dict:
    """The settings, or one section of them; a file that is absent or empty changes nothing."""
    told: Any = {}
    if path is not None and Path(path).is_file():
        import yaml

        told = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    whole = merged(DEFAULTS, expanded(told) if isinstance(told, dict) else {})
    return whole if section is None else whole.get(section, {})


def models(path: str | Path, name: str | None = None) -> dict:
    """One model's entry of a YAML file (models: {name: {...}}, default: name)."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no model configuration at {path}")
    import yaml

    told = expanded(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    known = told.get("models", {})
    chosen = name or told.get("default")
    if chosen not in known:
        raise ValueError(f"unknown model {chosen!r}; known: {', '.join(sorted(known))}")
    return known[chosen]
