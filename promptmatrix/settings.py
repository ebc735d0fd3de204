"""Settings in layers: the command line, then the environment, the configuration, the user's file, and the defaults."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pydantic import ValidationError

from promptmatrix.errors import ConfigError
from promptmatrix.spec import Config, Settings, read_yaml

PREFIX, USER_FILE = "PROMPTMATRIX_", "PROMPTMATRIX_USER_CONFIG"
FOLDERS = ("output_dir", "cache_dir")
# The words that say yes and no in an environment variable.
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def _flag(text: str) -> bool:
    word = text.strip().lower()
    if word not in YES + NO:
        raise ValueError(f"one of {', '.join(YES + NO)}")
    return word in YES


_READ: dict[str, Callable[[str], Any]] = {"output_dir": str, "cache_dir": str, "concurrency": int, "cache": _flag}


def from_environment(env: Mapping[str, str]) -> dict[str, Any]:
    """Settings from variables such as PROMPTMATRIX_CONCURRENCY; an empty one counts as not set."""
    out = {}
    for name, read in _READ.items():
        text = env.get(PREFIX + name.upper(), "")
        if text:
            try:
                out[name] = read(text)
            except ValueError as e:
                raise ConfigError(f"{PREFIX}{name.upper()} is {text!r}: {e}") from None
    return out


def user_file(env: Mapping[str, str]) -> Path:
    named = env.get(USER_FILE)
    return Path(named) if named else Path(env.get("XDG_CONFIG_HOME") or Path(env.get("HOME", "~")).expanduser() / ".config") / "promptmatrix" / "config.yaml"


def from_user(env: Mapping[str, str]) -> dict[str, Any]:
    path = user_file(env)
    if not path.is_file():
        return {}
    data = read_yaml(path, "user configuration")
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: the user configuration is a mapping of settings")
    try:
        return Settings.model_validate(data).model_dump(exclude_unset=True)
    except ValidationError as e:
        first = e.errors()[0]
        raise ConfigError(f"{path}: {'.'.join(map(str, first['loc']))}: {first['msg']}") from e


def resolve(config: Config, given: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Config:
    """The configuration with its settings resolved; ``given`` are command line values, None where not given.

    Folders from a file start from the configuration's folder; those from the
    environment or the command line from the working directory.
    """
    env = os.environ if env is None else env
    given = {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := sorted(set(given) - set(Settings.model_fields)):
        raise ConfigError(f"no such setting: {', '.join(unknown)}")
    typed = from_environment(env) | given
    for name in FOLDERS:
        if name in typed and "://" not in str(typed[name]):
            typed[name] = str(Path(typed[name]).absolute())
    merged = from_user(env) | config.settings.model_dump(exclude_unset=True) | typed
    try:
        settings = Settings.model_validate(merged)
    except ValidationError as e:
        first = e.errors()[0]
        raise ConfigError(f"settings.{'.'.join(map(str, first['loc']))}: {first['msg']}") from e
    out = config.model_copy(update={"settings": settings})
    out._base = config.base
    return out
