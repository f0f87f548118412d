"""The configuration file: loaded, resolved against its folder, checked."""

from __future__ import annotations

import hashlib
import os
import re
import tomllib
from dataclasses import dataclass

from ..functions import trees

SIZES = {p[0]: p[2] for p in trees.PRIMS}
WIDTHS = (8, 16, 32, 64)  # of pointers, in bits


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    """hash: of the file's text; extract: the section of that name, as written; symbols: the symbol lists with their paths resolved."""

    hash: str
    folder: str
    build_command: list[str]
    build_output: str | None
    compile_db: str | None
    symbols: dict[str, dict]
    extract: dict

    @property
    def width(self) -> int:
        return self.extract.get("pointer-width", 64)

    @property
    def pointer_type(self) -> str:
        return f"u{self.width}"

    @property
    def pointer_size(self) -> int:
        return self.width // 8

    def member_pointer_size(self, kind: str) -> int:
        """kind: ptmd or ptmf; a primitive and how many of it."""
        prim, n = self.extract[f"{kind}-repr"]
        return SIZES[prim] * n

    def rules(self) -> tuple[list[str], list[str]]:
        """Patterns of preferred names, and of disliked ones: those after <default>."""
        rules = self.extract.get("name-resolution", {}).get("rules", [])
        at = rules.index("<default>") if "<default>" in rules else len(rules)
        return rules[:at], rules[at + 1 :]


def rank(name: str, prefer: list[str], dislike: list[str]) -> int:
    """As functions.names.sort_key, for the checks at load."""
    first = lambda rs: next((i for i, r in enumerate(rs) if re.search(r, name)), None)
    p, d = first(prefer), first(dislike)
    return (len(prefer) if p is None else p) << 16 | (0 if d is None else d + 1)


def parse(text: str, folder: str) -> Config:
    raw = tomllib.loads(text)
    paths, extract = raw.get("paths", {}), raw.get("extract", {})
    at = lambda p: None if p is None else os.path.normpath(os.path.join(folder, p))
    lists = {k: v | {"path": at(v["path"])} for k, v in paths.items() if isinstance(v, dict) and "path" in v}
    out = Config(hashlib.sha256(text.encode()).hexdigest(), folder, paths.get("build-command", extract.get("build-command", [])), at(paths.get("elf")), at(paths.get("compdb")), lists, extract)
    check(out)
    return out


def check(c: Config) -> None:
    """Raises ConfigError for what can't be run with."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ConfigError(what)

    need(c.width in WIDTHS, f"pointer-width must be one of {WIDTHS}")
    need(bool(c.build_command), "build-command must not be empty")
    for kind in ("ptmd-repr", "ptmf-repr"):
        if kind in c.extract:
            prim, n = c.extract[kind]
            need(prim in SIZES and prim != "void" and n > 0, f"{kind} must be a primitive other than void and a number above 0")
    prefer, dislike = c.rules()
    need(len(prefer) <= 60_000 and len(dislike) <= 60_000, "too many name rules")
    for r in prefer + dislike:
        try:
            re.compile(r)
        except re.error as e:
            raise ConfigError(f"pattern {r}: {e}") from e
    for better, worse in c.extract.get("name-resolution", {}).get("test", []):
        need(rank(better, prefer, dislike) < rank(worse, prefer, dislike), f"{better} must sort before {worse}")
    seen = set()
    for rule in c.extract.get("type-optimizer", {}).get("pick-union-member", []):
        need(rule["regex"] not in seen, f"two rules pick for {rule['regex']}")
        seen.add(rule["regex"])
        need(bool(rule["members"]), f"{rule['regex']} names no members")
        need(0 <= rule["pick"] < len(rule["members"]), f"{rule['regex']} picks none of its members")


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), os.path.dirname(os.path.abspath(path)))
