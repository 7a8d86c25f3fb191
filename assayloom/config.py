"""Run configuration: thresholds, design and their fingerprints, checked on the driver before any job."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from .constants import CONFIG_ERRORS, DESIGN, JUDGED_DESIGN, NOT_SPECIFIED, THRESHOLDS, ASSIGNED

_TRUE_WORDS = {"true", "1", "y", "yes", "on"}


def coerce(value, default):
    """value in the type of default: words for booleans, half-even rounding for whole numbers."""
    kind = type(default)
    if kind is bool:
        return value.strip().lower() in _TRUE_WORDS if isinstance(value, str) else bool(value)
    return int(round(float(value))) if kind is int else kind(value)


def fingerprint(values: Mapping) -> str:
    """The first 8 hex digits of the md5 of sorted JSON."""
    return hashlib.md5(json.dumps(dict(values), sort_keys=True).encode()).hexdigest()[:8]


@dataclass(frozen=True)
class QcConfig:
    """Thresholds and design of one run; cfg["key"] reads either."""

    thresholds: dict
    design: dict
    batches: tuple[str, ...] = ()
    errors: tuple[str, ...] = field(default=())

    def __getitem__(self, key: str):
        return self.thresholds[key] if key in self.thresholds else self.design[key]

    @property
    def param_hash(self) -> str:
        return fingerprint(self.thresholds)

    @property
    def design_hash(self) -> str:
        return fingerprint({k: self.design[k] for k in JUDGED_DESIGN})

    @property
    def nondefault(self) -> list[str]:
        return [k for k, v in THRESHOLDS.items() if self.thresholds[k] != v]

    @property
    def rna_source(self) -> str:
        """One name if the three fragments agree, else all three."""
        names = [self.design[f"rna_frag{i}"] for i in (1, 2, 3)]
        return names[0] if len(set(names)) == 1 else " / ".join(f"frag{i} {x}" for i, x in enumerate(names, 1))

    @property
    def vh_family(self) -> str | None:
        """The family that the batch should show; None where none is assigned."""
        v = self.design["batch_vh_family"]
        return v if self.design["analysis_mode"] == ASSIGNED and v != NOT_SPECIFIED else None

    @property
    def chain(self) -> str | None:
        v = self.design["batch_chain"]
        return v if self.design["analysis_mode"] == ASSIGNED and v != NOT_SPECIFIED else None

    @property
    def assignment(self) -> dict[str, list[str]] | None:
        """Families and chains that primers are expected from; None outside assigned mode."""
        if self.design["analysis_mode"] != ASSIGNED:
            return None
        return {"vh_families": [self.vh_family] if self.vh_family else [], "chains": [self.chain] if self.chain else []}


def build_config(overrides: Mapping | None = None, batches: list[str] | None = None) -> QcConfig:
    """Defaults with overrides (None keeps the default); `errors` lists contradictory thresholds."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    t, d = ({k: coerce(given[k], v) if k in given else v for k, v in table.items()} for table in (THRESHOLDS, DESIGN))
    wrong = {
        **{k: t[f"{k}_min"] >= t[f"{k}_max"] for k in ("insert", "d1", "d2")},
        "gap": t["lm_gap_warn"] > t["lm_gap_fail"],
        "window": t["trim_win"] < 1,
    }
    return QcConfig(t, d, tuple(batches or ()), tuple(CONFIG_ERRORS[k] for k, bad in wrong.items() if bad))
