"""Settings: the office's network, from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

TEMPLATE = '[office]\n# The name of the office network.\nssid = ""\n'


class ConfigError(ValueError):
    """The file is missing, no TOML, or names no network."""


@dataclass(frozen=True)
class Config:
    office_ssid: str


def parse(text: str) -> Config:
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"no TOML: {e}") from e
    ssid = found.get("office", {}).get("ssid", "") if isinstance(found.get("office", {}), dict) else ""
    if not isinstance(ssid, str) or not ssid.strip():
        raise ConfigError("office.ssid is missing")
    return Config(ssid)


def load(path: str | Path) -> Config:
    """Read the settings; where there is no file, write a template and say so."""
    path = Path(path)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(TEMPLATE)
        raise ConfigError(f"fill in {path}")
    return parse(path.read_text())
