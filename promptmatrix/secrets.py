"""Credentials: from the environment first, then from YAML files; never written into the environment.

Order: real environment variables; the file that PROMPTMATRIX_SECRETS names;
``promptmatrix.secrets.yaml`` beside the configuration; the user's own file.
"""

from __future__ import annotations

import os
import stat
from pathlib import Path

from promptmatrix.errors import ConfigError
from promptmatrix.spec import Config, read_yaml

VARIABLE, NAME = "PROMPTMATRIX_SECRETS", "promptmatrix.secrets.yaml"
#: Shorter values are not replaced in texts: they would be found everywhere.
LEAST = 8
# The variables that hold the keys of providers by default.
DEFAULT_KEYS = {"anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY", "openai-compatible": "OPENAI_API_KEY"}


def user_path(env: dict[str, str]) -> Path:
    home = env.get("XDG_CONFIG_HOME") or Path(env.get("HOME", "~")).expanduser() / ".config"
    return Path(home) / "promptmatrix" / "secrets.yaml"


def load(base: Path | str, env: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """All names and values in their order of precedence, and warnings about files that others can read."""
    env = dict(os.environ if env is None else env)
    out, warnings = {}, []
    named = env.get(VARIABLE)
    for path, must in ((user_path(env), False), (Path(base) / NAME, False), (Path(named) if named else None, True)):
        if path is None or not must and not path.is_file():
            continue
        data = read_yaml(path, "secrets file")
        if not isinstance(data, dict) or not all(isinstance(k, str) and isinstance(v, (str, int, float)) for k, v in data.items()):
            raise ConfigError(f"secrets file must map names to values: {path}")
        if os.name == "posix" and path.stat().st_mode & (stat.S_IROTH | stat.S_IRGRP):
            warnings.append(f"{path} can be read by others; chmod 600 it")
        out |= {k: str(v) for k, v in data.items()}
    return out | env, warnings


def keys(config: Config, env: dict[str, str] | None = None) -> dict[str, str]:
    """What the configuration's providers need: the credentials of its models by variable, wherever they are kept."""
    known, _ = load(config.base, env)
    wanted = {m.api_key_env or DEFAULT_KEYS.get(m.provider) for m in config.models}
    return {name: known[name] for name in wanted if name and known.get(name)}


def values(base: Path | str, env: dict[str, str] | None = None) -> list[str]:
    """The secret values to scrub: those from files, and environment variables that are named like keys."""
    everything, _ = load(base, env)
    real = dict(os.environ if env is None else env)
    like = ("KEY", "TOKEN", "SECRET", "PASSWORD")
    return sorted({v for k, v in everything.items() if len(v) >= LEAST and (k not in real or any(w in k.upper() for w in like))})


def redact(text: str, secrets: list[str], mark: str = "[redacted]") -> str:
    for value in sorted(set(secrets), key=len, reverse=True):
        if len(value) >= LEAST:
            text = text.replace(value, mark)
    return text


def describe(base: Path | str, env: dict[str, str] | None = None) -> list[dict[str, str]]:
    """Where each file secret comes from, without its value."""
    real = dict(os.environ if env is None else env)
    found = []
    for path in (user_path(real), Path(base) / NAME, Path(real.get(VARIABLE, "")) if real.get(VARIABLE) else None):
        if path is not None and path.is_file():
            found += [{"name": str(k), "source": "environment" if k in real else str(path)} for k in (read_yaml(path, "secrets file") or {})]
    return found
