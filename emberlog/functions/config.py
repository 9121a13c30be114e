"""Scoring configuration from a file, over the defaults."""

from __future__ import annotations

import json
import os
from typing import Any

from emberlog import rules


def load(path: str | None) -> dict[str, Any]:
    """Weights and thresholds from JSON or, where a YAML reader is installed, YAML; a missing file leaves the defaults."""
    out: dict[str, Any] = {"weights": dict(rules.WEIGHTS), "thresholds": dict(rules.THRESHOLDS), "effort": {}, "multipliers": {}}
    if not path or not os.path.exists(path):
        return out
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        found = yaml.safe_load(text)
    names = {"scoring_weights": "weights", "priority_thresholds": "thresholds", "response_effort_map": "effort", "cloud_provider_multipliers": "multipliers"}
    for name, own in names.items():
        out[own].update((found or {}).get(name) or {})
    return out
