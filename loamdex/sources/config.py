"""Settings of a project: nine keys in a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from loamdex.functions.text import EXCLUDES, INCLUDES, closest

CONFIG_NAME, STATE_DIR = "loamdex.toml", ".loamdex"
MODES = ("auto", "lexical", "semantic", "hybrid")


class ConfigError(ValueError):
    """What is wrong with a configuration."""


@dataclass(frozen=True)
class Config:
    """Defaults apply to every key that a file leaves out."""

    include: tuple[str, ...] = tuple(INCLUDES)
    exclude: tuple[str, ...] = tuple(EXCLUDES)
    max_file_bytes: int = 5 << 20
    max_tokens: int = 256
    overlap_tokens: int = 32
    semantic: bool = False
    concurrency: int = 2
    mode: str = "auto"
    store: str = f"{STATE_DIR}/index"
    warnings: tuple[str, ...] = field(default=(), compare=False)


KEYS = {
    "index.include": "include", "index.exclude": "exclude", "index.max_file_bytes": "max_file_bytes", "chunk.max_tokens": "max_tokens", "chunk.overlap_tokens": "overlap_tokens",
    "semantic.enabled": "semantic", "embed.concurrency": "concurrency", "search.mode": "mode", "store.path": "store",
}


def parse_config(text: str) -> Config:
    """Reads TOML text; a leading BOM is fine. Unknown keys warn, with the closest known one; wrong types and values are errors."""
    try:
        data = tomllib.loads(text.removeprefix("﻿"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"not valid TOML: {e}") from e
    flat: dict[str, object] = {}
    for k, v in data.items():
        flat |= {f"{k}.{n}": x for n, x in v.items()} if isinstance(v, dict) else {k: v}
    values, warnings = {}, []
    kinds = {f.name: f.type for f in fields(Config)}
    for key, v in flat.items():
        if key not in KEYS:
            near = closest(key, list(KEYS))
            warnings.append(f"unknown key {key}" + (f"; did you mean {near}?" if near else ""))
            continue
        name, kind = KEYS[key], kinds[KEYS[key]]
        if kind.startswith("tuple"):
            if not isinstance(v, list) or not all(isinstance(x, str) and x for x in v):
                raise ConfigError(f"{key} must be a list of patterns")
            v = tuple(v)
        elif kind == "int":
            if not isinstance(v, int) or isinstance(v, bool) or not -(2**31) <= v < 2**31:
                raise ConfigError(f"{key} must be a 32-bit whole number")
        elif kind == "bool" and not isinstance(v, bool) or kind == "str" and not isinstance(v, str):
            raise ConfigError(f"{key} must be {'true or false' if kind == 'bool' else 'a text'}")
        values[name] = v
    out = Config(**values, warnings=tuple(warnings))
    if out.mode not in MODES:
        raise ConfigError(f"search.mode must be one of {', '.join(MODES)}")
    if not 2 < out.max_tokens <= 256 or not 0 <= out.overlap_tokens < out.max_tokens - 2:
        raise ConfigError("chunk.max_tokens must be 3 to 256, and the overlap below the rest")
    if out.max_file_bytes < 1 or not 1 <= out.concurrency <= 64:
        raise ConfigError("index.max_file_bytes and embed.concurrency must be positive")
    if os.path.isabs(out.store) or ".." in out.store.split("/"):
        raise ConfigError("store.path must stay inside the project")
    return out


def write_default(path: str) -> None:
    """A file with every key at its default; an existing one is left alone."""
    c = Config()

    def listed(xs: tuple[str, ...]) -> str:
        return "[\n" + "".join(f'  "{x}",\n' for x in xs) + "]"

    body = f"[index]\ninclude = {listed(c.include)}\nexclude = {listed(c.exclude)}\nmax_file_bytes = {c.max_file_bytes}\n\n[chunk]\nmax_tokens = {c.max_tokens}\noverlap_tokens = {c.overlap_tokens}\n\n"
    body += f'[semantic]\nenabled = false\n\n[embed]\nconcurrency = {c.concurrency}\n\n[search]\nmode = "{c.mode}"\n\n[store]\npath = "{c.store}"\n'
    with open(path, "x", encoding="utf-8") as f:
        f.write(body)


def find_project(target: str) -> tuple[str, str, Config]:
    """(project root, real target, settings): the nearest folder upwards that holds a settings file or .git, else the target's own."""
    if not os.path.exists(target):
        raise ConfigError(f"{target} does not exist")
    if os.path.islink(target):
        raise ConfigError(f"{target} is a symbolic link")
    real = os.path.realpath(target)
    folder = here = real if os.path.isdir(real) else os.path.dirname(real)
    while True:
        if os.path.isfile(os.path.join(here, CONFIG_NAME)) or os.path.isdir(os.path.join(here, ".git")):
            break
        if os.path.dirname(here) == here:
            here = folder
            break
        here = os.path.dirname(here)
    path = os.path.join(here, CONFIG_NAME)
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return here, real, parse_config(f.read())
    return here, real, Config()
