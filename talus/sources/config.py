"""A site's configuration: a typed record read on the driver and used as literals."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from datetime import date, datetime, timezone
from pathlib import Path

from talus.functions.physics import Soil, Suction

REQUIRED = ("name", "slug", "start", "end")


@dataclass(frozen=True)
class Site:
    """What the pipelines need to know of a site; only REQUIRED has no default."""

    name: str
    slug: str
    start: datetime
    end: datetime
    aoi: str = ""
    operational_m: float = 0.5
    watch_m: float = 0.7
    kappa: float = 0.0
    alert_k: float = 2.0
    watch_k: float = 1.0
    soil: Soil = field(default_factory=Soil)
    suction: Suction | None = None


def utc(value: str | date | datetime) -> datetime:
    """A date or time as a time in UTC; one without zone is taken to be in UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def _raw(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    import yaml  # only for YAML files

    return yaml.safe_load(text) or {}


def load_site(path: str | None = None) -> Site:
    """The site of a JSON or YAML file, of TALUS_SITE by default; a file of one `site_file` points to another, one step far."""
    at = Path(path or os.environ["TALUS_SITE"])
    raw = _raw(at)
    if "site_file" in raw:
        raw = _raw(at.parent / raw["site_file"])
    if missing := [k for k in REQUIRED if k not in raw]:
        raise ValueError(f"{at}: missing {', '.join(missing)}")
    known = {f.name for f in fields(Site)}
    values = {k: v for k, v in raw.items() if k in known}
    values |= {k: utc(values[k]) for k in ("start", "end")}
    if "soil" in values:
        values["soil"] = Soil(**values["soil"])
    if values.get("suction"):
        values["suction"] = Suction(**values["suction"])
    return Site(**values)
