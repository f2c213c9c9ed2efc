"""Identities: deterministic content hashes, and an injectable factory for the random ones."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

_PROJECT = re.compile(r"^proj_[a-f0-9]{12}$")


def _short(n: int, *parts) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, n)


def node_id(project, core_type, file_path, name, parent=None) -> Column:
    """project:type:hash; the hashed key has the parent before the name and leaves it out if null."""
    key = [project, core_type, file_path, *([parent] if parent is not None else []), name]
    return F.concat(project, F.lit(":"), core_type, F.lit(":"), _short(16, *key))


def edge_id(kind, start, end) -> Column:
    return F.concat(kind, F.lit(":"), _short(16, kind, start, end))


def rule_edge_id(kind, start, end) -> Column:
    """Edges made by rules have a prefix of their own."""
    return F.concat(F.lit("SEM:"), _short(16, kind, start, end))


def call_edge_id(start, end, line) -> Column:
    kind = F.lit("CALLS")
    return F.concat(F.lit("CALLS:"), _short(16, kind, start, end, F.coalesce(line, F.lit(0)).cast("string")))


def project_id(path) -> Column:
    return F.concat(F.lit("proj_"), F.substring(F.sha2(path, 256), 1, 12))


def is_project_id(text: str) -> bool:
    return bool(_PROJECT.match(text or ""))


def base36(n: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out or "0"


class IdFactory:
    """prefix_time_random ids; give clock and seed to get the same ones again."""

    def __init__(self, clock=lambda: int(time.time() * 1000), seed: int | None = None):
        self.clock, self.random = clock, random.Random(seed)

    def make(self, prefix: str) -> str:
        tail = "".join(self.random.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(6))
        return f"{prefix}_{base36(self.clock())}_{tail}"

    def job(self) -> str:
        return "job_" + "".join(self.random.choice("0123456789abcdef") for _ in range(16))

    @staticmethod
    def agent(swarm: str, index: int) -> str:
        return f"{swarm}_agent_{index}"
