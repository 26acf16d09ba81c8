"""Settings of a scan, from defaults, a JSON file and overrides (the last wins)."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    state_dir: str = "fathom_state"
    quarantine_dir: str = "quarantine"
    checksum: str = "sha256"
    detect_ransomware: bool = True
    entropy_threshold: float = 7.95
    entropy_jump_threshold: float = 2.0
    exclude_quarantine: bool = True
    follow_symlinks: bool = False
    include_hidden: bool = True
    deep_validators: bool = True


#: Where a setting stands in a config file: section, key, field, how to read it.
_KEYS = (
    ("database", "path", "state_dir", str),
    ("quarantine", "directory", "quarantine_dir", str),
    ("scanning", "skip_hidden_files", "include_hidden", lambda v: not v),
    ("scanning", "follow_symlinks", "follow_symlinks", bool),
    ("detection", "checksum_algorithm", "checksum", str),
    ("detection", "structure_validation_enabled", "deep_validators", bool),
    ("detection", "ransomware_detection_enabled", "detect_ransomware", bool),
    ("detection", "entropy_threshold", "entropy_threshold", float),
    ("detection", "entropy_jump_threshold", "entropy_jump_threshold", float),
)


def load_config_file(path: str | Path | None) -> dict[str, Any]:
    """The file's settings; ``{}`` if it is absent, unreadable or not an object."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    except (OSError, ValueError) as e:
        LOG.warning("config %s not used: %s", path, e)
        return {}
    return data if isinstance(data, dict) else {}


def config_from(data: Mapping[str, Any] | None, **overrides: Any) -> Config:
    """Defaults, then the mapping's sections, then overrides that are not None. Unknown keys are dropped."""
    found: dict[str, Any] = {}
    for section, key, field, read in _KEYS:
        part = (data or {}).get(section)
        if isinstance(part, Mapping) and part.get(key) is not None:
            try:
                found[field] = read(part[key])
            except (TypeError, ValueError):
                LOG.warning("%s.%s: %r is not usable, the default stays", section, key, part[key])
    known = {f.name for f in fields(Config)}
    found |= {k: v for k, v in overrides.items() if k in known and v is not None}
    return replace(Config(), **found)
