"""Target profile (what columns come out) and quality settings (how records are judged)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from leadspark import fixed_values as fv


def normalize_header(text: str) -> str:
    """Driver-side header key for the handful of names in a profile."""
    return re.sub(r"[^a-z0-9]+", " ", str(text).lower()).strip()


@dataclass(frozen=True)
class Profile:
    """Target columns in output order, their types and where their values may come from."""

    name: str
    columns: list[str]
    aux_columns: list[str]
    types: dict[str, str]
    aliases: dict[str, str]
    drop_names: list[str]
    compose: dict[str, list[list[str]]]
    dedupe_on: list[str]
    sort_by: list[str] = field(default_factory=list)

    @property
    def all_columns(self) -> list[str]:
        return self.columns + self.aux_columns

    def separator(self, column: str) -> str:
        """Text between the parts of a composed value."""
        return " " if self.types[column] == "name" else ", "

    @property
    def synthesized_column(self) -> str | None:
        """The column stamped with the processing time when no input column feeds it."""
        return "Timestamp" if self.types.get("Timestamp") == "datetime" and "Timestamp" in self.columns else None


def make_profile(spec: dict) -> Profile:
    listed = spec["columns"] + spec.get("aux_columns", [])
    aliases: dict[str, str] = {}
    for column in listed:
        for alias in [column["name"], *column.get("aliases", [])]:
            aliases[normalize_header(alias)] = column["name"]
    dedupe = spec.get("dedupe_on") or []
    return Profile(
        name=spec.get("name", "custom"),
        columns=[c["name"] for c in spec["columns"]],
        aux_columns=[c["name"] for c in spec.get("aux_columns", [])],
        types={c["name"]: c.get("type", "text") for c in listed},
        aliases=aliases,
        drop_names=list(dict.fromkeys(normalize_header(d) for d in spec.get("drop_columns", []))),
        compose={t: [[normalize_header(a) for a in part] for part in parts]
                 for t, parts in spec.get("compose", {}).items()},
        dedupe_on=[dedupe] if isinstance(dedupe, str) else list(dedupe),
        sort_by=list(spec.get("sort_by", [])),
    )


PROFILES: dict[str, dict] = {"default": fv.DEFAULT_PROFILE}


def load_profile(source: str | dict | Profile = "default") -> Profile:
    """A profile by registered name, JSON path, or dict. Unknown names are an error."""
    if isinstance(source, Profile):
        return source
    if isinstance(source, dict):
        return make_profile(source)
    if source in PROFILES:
        return make_profile(PROFILES[source])
    if source.endswith(".json"):
        with open(source, encoding="utf-8") as handle:
            return make_profile(json.load(handle))
    raise ValueError(f"unknown profile: {source}")


def load_quality(source: str | dict | None = None) -> dict:
    """Quality settings: the default, a dict, or a JSON path."""
    if source is None:
        return fv.DEFAULT_QUALITY
    if isinstance(source, dict):
        return source
    with open(source, encoding="utf-8") as handle:
        return json.load(handle)
