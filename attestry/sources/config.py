"""Registry, profile and dictionary files, validated as they are loaded."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.corroborate import Policy
from ..operators.registry import SCHEMA

STATUSES = ("active", "paused", "retired")


class ConfigError(ValueError):
    """A configuration file says something that it may not."""


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a YAML file: a list, or ``sources: [...]``. An empty file, a repeated id, a missing license,
    tag or endpoint, a tier outside 1 to 3 or an unknown status is an error."""
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    entries = data.get("sources") if isinstance(data, dict) else data
    if not entries:
        raise ConfigError(f"{path} has no sources")
    rows, seen = [], set()
    for e in entries:
        i = str(e.get("id", ""))
        tags = {k: int(v["tier"]) for k, v in (e.get("tags") or {}).items()}
        fetch = e.get("fetch") or {}
        checks = {
            "id": re.fullmatch(r"[a-z0-9_\-]+", i), "repeated id": i not in seen, "name": e.get("name"), "license": e.get("license"), "tags": tags,
            "tier": all(1 <= t <= 3 for t in tags.values()), "endpoints": fetch.get("endpoints"), "status": e.get("status", "active") in STATUSES,
        }
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ConfigError(f"source {i!r}: {', '.join(bad)}")
        seen.add(i)
        rows.append((i, e["name"], fetch.get("adapter", ""), e.get("language", "en"), e["license"], tags, e.get("independence_group") or i, e.get("status", "active"), [str(x["url"] if isinstance(x, dict) else x) for x in fetch["endpoints"]]))
    return spark.createDataFrame(rows, SCHEMA)


@dataclass(frozen=True)
class Profile:
    """What a domain asks for."""

    domain: str
    include_tags: list[str]
    min_tier: int = 3
    event: Policy = Policy()
    quantitative: Policy = Policy()
    relative: float | None = None
    absolute: float | None = None
    window_hours: int = 24
    top_k: int = 24
    max_iterations: int = 4
    cron: str | None = None
    dictionaries: list[str] = field(default_factory=list)


def load_profile(path: str) -> Profile:
    """A domain's YAML profile."""
    import yaml

    d = yaml.safe_load(Path(path).read_text()) or {}
    scope, rules, find = d.get("registry_scope") or {}, d.get("corroboration") or {}, d.get("retrieval") or {}
    if not d.get("domain") or not scope.get("include_tags"):
        raise ConfigError(f"{path}: domain and registry_scope.include_tags are needed")
    fallback = rules.get("fallback", "attribute")
    if fallback not in ("attribute", "flag", "drop"):
        raise ConfigError(f"{path}: unknown fallback {fallback!r}")
    policy = lambda k: Policy(int((rules.get(k) or {}).get("min_sources", 2)), int((rules.get(k) or {}).get("min_tier1", 1)), fallback)
    near = ((d.get("claims") or {}).get("quantitative") or {}).get("tolerance") or {}
    relative, absolute = near.get("relative"), near.get("absolute")
    if (own := (rules.get("quantitative") or {}).get("value_tolerance", "inherit")) != "inherit":
        relative, absolute = float(own), None
    return Profile(d["domain"], list(scope["include_tags"]), int(scope.get("min_tier", 3)), policy("event"), policy("quantitative"), relative, absolute, int(find.get("window_hours", 24)), int(find.get("top_k", 24)), int(find.get("max_iterations", 4)), (d.get("schedule") or {}).get("cron"), [x["path"] if isinstance(x, dict) else str(x) for x in (d.get("entities") or {}).get("dictionaries", [])])


def load_dictionary(path: str) -> list[tuple[str, str, str]]:
    """(surface, canonical, type) rows of a CSV; header and rows whose first cell is just "#" are passed over."""
    with open(path, newline="", encoding="utf-8") as f:
        rows = [[c.strip() for c in r] for r in csv.reader(f) if r]
    return [(r[0], r[1] if len(r) > 1 else r[0], r[2] if len(r) > 2 else "") for r in rows if r[0] and r[0].lower() not in ("surface_form", "#")]


def load_dictionaries(folder: str) -> list[tuple[str, str, str]]:
    """The rows of all dictionaries that the profiles of a folder of domains (``<domain>/profile.yaml``) name, by
    domain and in the profile's order; missing files are passed over, equal rows count once."""
    rows: dict[tuple[str, str, str], None] = {}
    for path in sorted(Path(folder).glob("*/profile.yaml")):
        for name in load_profile(str(path)).dictionaries:
            if (own := path.parent / name).exists():
                rows |= dict.fromkeys(load_dictionary(str(own)))
    return list(rows)
