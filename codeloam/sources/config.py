"""The optional configuration file: strict JSON with excludes and test_globs."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from ..functions.paths import glob_regex
from ..schema import CONFIG_FILE, MAX_BYTES
from . import git as G


@dataclass
class Config:
    excludes: list[str] = field(default_factory=list)
    test_globs: list[str] = field(default_factory=list)


def parse(content: bytes) -> Config:
    value = json.loads(content)
    if not isinstance(value, dict) or set(value) - {"excludes", "test_globs"}:
        raise ValueError(f"{CONFIG_FILE}: only excludes and test_globs are known")
    config = Config(**{k: v for k, v in value.items() if v is not None})
    for patterns in (config.excludes, config.test_globs):
        if not isinstance(patterns, list) or any(not isinstance(p, str) for p in patterns):
            raise ValueError(f"{CONFIG_FILE}: patterns are a list of strings")
        for p in patterns:
            glob_regex(p.rstrip("/"))
    return config


def of_directory(root: str) -> Config:
    path = os.path.join(root, CONFIG_FILE)
    if os.path.islink(path) or not os.path.isfile(path):
        return Config()
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError(f"{CONFIG_FILE} is larger than {MAX_BYTES} bytes")
    with open(path, "rb") as f:
        return parse(f.read())


def of_revision(repository: str, rev: str) -> Config:
    entry = G.git(repository, "ls-tree", "-l", "-z", rev, "--", CONFIG_FILE).rstrip(b"\0")
    if not entry:
        return Config()
    mode, _, oid, size = entry.partition(b"\t")[0].split()
    if mode not in (b"100644", b"100755"):
        return Config()
    if int(size) > MAX_BYTES:
        raise ValueError(f"{CONFIG_FILE} is larger than {MAX_BYTES} bytes")
    return parse(G.git(repository, "cat-file", "blob", oid.decode()))
