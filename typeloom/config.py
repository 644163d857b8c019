"""Settings: a nested mapping, read from a YAML or JSON file, with the keys that the chosen features need."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from typeloom.operators.sequences import Knobs


class ConfigError(Exception):
    """A settings file that can't be read, or that lacks keys."""


#: Keys and defaults of the settings.
DEFAULTS = {
    "tier1": {
        "keys": {"exclude_repeats": True, "deletion_keys": ["Backspace", "Delete"], "insertion_special_keys": ["Enter", "Tab"]},
        "pause": {"long_pause_multiplier": 2.0, "entropy_bins": 10},
        "burst": {"gap_threshold_ms": 1000},
        "mouse": {"path_length_per_keys": 100},
        "filtering": {"sanity_check_min_keydown_count": 100},
    },
    "tier2": {"text": {"lowercase": True, "strip_punctuation": True}, "indentation": {"canonical_unit": "\t"}},
    "tier3": {},
}


def load(path: str | Path) -> dict:
    """The mapping in a settings file; YAML needs a YAML library, JSON doesn't."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as problem:
        raise ConfigError(f"can't read settings {path}: {problem}") from problem
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        found = _yaml(text, path)
    if not isinstance(found, dict) or not found:
        raise ConfigError(f"settings {path} have no mapping")
    return found


def _yaml(text: str, path: str | Path) -> object:
    try:
        import yaml
    except ImportError as missing:
        raise ConfigError(f"settings {path} aren't JSON, and no YAML library is installed") from missing
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as problem:
        raise ConfigError(f"settings {path} aren't YAML: {problem}") from problem


def value(settings: dict, key: str) -> object:
    """The value at a dotted key; KeyError if there is none."""
    at: object = settings
    for part in key.split("."):
        if not isinstance(at, dict):
            raise KeyError(key)
        at = at[part]
    return at


def missing(settings: dict, keys: Iterable[str]) -> list[str]:
    """Those of some dotted keys that the settings don't have, sorted."""

    def there(key: str) -> bool:
        try:
            value(settings, key)
        except KeyError:
            return False
        return True

    return sorted({k for k in keys if not there(k)})


def knobs(settings: dict) -> Knobs:
    """The sequence operators' part of the settings; defaults where a key isn't there."""
    of = lambda key: value(settings if not missing(settings, [key]) else DEFAULTS, key)
    return Knobs(
        exclude_repeats=bool(of("tier1.keys.exclude_repeats")),
        deletion_keys=tuple(of("tier1.keys.deletion_keys")),
        insertion_keys=tuple(of("tier1.keys.insertion_special_keys")),
        long_pause_multiplier=float(of("tier1.pause.long_pause_multiplier")),
        entropy_bins=int(of("tier1.pause.entropy_bins")),
        burst_gap_ms=float(of("tier1.burst.gap_threshold_ms")),
        path_per_keys=float(of("tier1.mouse.path_length_per_keys")),
    )


def digest(path: str | Path) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
