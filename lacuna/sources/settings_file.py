"""Settings from YAML: defaults, own deviations on top, or one file named by an environment variable instead of both."""

from __future__ import annotations

import os
from pathlib import Path

import yaml

from lacuna.operators import settings as st

VARIABLE = "LACUNA_SETTINGS"


def _tree(path: Path) -> dict:
    return (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else {}


def _merged(base: dict, own: dict) -> dict:
    """Deep for mappings; lists are replaced as a whole."""
    return {**base, **{k: _merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}}


def load(defaults: Path, own: Path | None = None) -> dict:
    if os.environ.get(VARIABLE):
        return _tree(Path(os.environ[VARIABLE]))
    base = _tree(defaults)
    return _merged(base, st.adapted(_tree(own), base)) if own else base


def _deviation(base, own):
    out = {}
    for k, v in own.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            if inner := _deviation(base[k], v):
                out[k] = inner
        elif k not in base or isinstance(v, bool) != isinstance(base[k], bool) or v != base[k]:
            out[k] = v
    return out


def save(tree: dict, defaults: Path, own: Path) -> None:
    """Only what deviates is stored; without deviations there is no file."""
    left = _deviation(_tree(defaults), tree)
    if left:
        own.write_text(yaml.safe_dump(left, allow_unicode=True, sort_keys=False), encoding="utf-8")
    else:
        own.unlink(missing_ok=True)
