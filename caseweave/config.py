"""Settings from a file: a contract that a corpus keeps, and a profile that may change between runs.

The file is JSON, or YAML where a YAML reader is installed. ``${NAME}`` and
``${NAME:-default}`` in strings are taken from the environment. A key that is
not known is an error, as is a value that can't work.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields

from caseweave.errors import ConfigError
from caseweave.identity import Contract

PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


#: Engines that may recognise pages; what they run is registered with the readers.
OCR = ("none", "eslav", "cyrillic", "latin")


@dataclass(frozen=True)
class Profile:
    """How a run works; nothing here changes what a corpus holds."""

    store: str = "store"
    window_max_chars: int = 3000
    rerank_depth: int = 50
    quality_floor: int = 100
    summary_concurrency: int = 8
    language: str = "en"
    host: str = "127.0.0.1"
    port: int = 8000
    embed_model: str = ""
    rerank_model: str = ""
    summary_url: str = ""
    ocr: str = "none"

    def __post_init__(self) -> None:
        for name in ("window_max_chars", "rerank_depth", "quality_floor", "summary_concurrency", "port"):
            if getattr(self, name) < 1:
                raise ConfigError(f"{name} must be positive")
        if self.summary_concurrency > 64 or self.port > 65535:
            raise ConfigError("summary_concurrency is at most 64, port at most 65535")
        if not re.fullmatch(r"[a-z]{2,3}(-[A-Za-z0-9]+)*", self.language):
            raise ConfigError(f"{self.language!r} is not a language tag")
        if not re.fullmatch(r"[A-Za-z0-9.:-]+", self.host):
            raise ConfigError(f"{self.host!r} is not a host")
        if self.ocr not in OCR:
            raise ConfigError(f"ocr is one of {', '.join(OCR)}")
        if self.summary_url and not re.fullmatch(r"https?://[^\s/]+(/\S*)?", self.summary_url):
            raise ConfigError(f"{self.summary_url!r} is not a web address")


def interpolate(value, env: dict[str, str]):
    """Placeholders filled from ``env``; one without a value or default is an error."""
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    if not isinstance(value, str):
        return value

    def fill(m: re.Match[str]) -> str:
        got = env.get(m[1], m[2])
        if got is None:
            raise ConfigError(f"the environment has no {m[1]}")
        return got

    return PLACEHOLDER.sub(fill, value)


def typed(kind: type, given: dict, where: str):
    known = {f.name: f.type for f in fields(kind)}
    if unknown := sorted(given.keys() - known.keys()):
        raise ConfigError(f"{where} has unknown keys: {', '.join(unknown)}")
    out = {}
    for name, value in given.items():
        if known[name] == "int":
            if isinstance(value, bool) or not re.fullmatch("-?[0-9]+", str(value)):
                raise ConfigError(f"{where}.{name} must be a whole number")
            value = int(value)
        elif not isinstance(value, str):
            raise ConfigError(f"{where}.{name} must be text")
        out[name] = value
    return kind(**out)


def parse(text: str, env: dict[str, str] | None = None) -> tuple[Contract, Profile]:
    """(contract, profile) of a configuration's text."""
    try:
        given = json.loads(text) if text.strip() else {}
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("the configuration is not JSON, and no YAML reader is installed") from e
        given = yaml.safe_load(text) or {}
    if not isinstance(given, dict) or (unknown := sorted(given.keys() - {"contract", "profile"})):
        raise ConfigError(f"unknown sections: {', '.join(unknown) if isinstance(given, dict) else given!r}")
    given = interpolate(given, dict(os.environ) if env is None else env)
    return typed(Contract, given.get("contract", {}), "contract"), typed(Profile, given.get("profile", {}), "profile")


def select(profiles: dict[str, Profile], name: str = "") -> Profile:
    """The named profile, or the only one; a name that isn't there is an error."""
    if not name and len(profiles) == 1:
        return next(iter(profiles.values()))
    if name not in profiles:
        raise ConfigError(f"no profile {name!r}; there are {', '.join(sorted(profiles)) or 'none'}")
    return profiles[name]
