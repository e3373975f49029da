"""A log of commits in a folder: what a table consists of, agreed on by writers that don't know of each other."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from .storage import ages, create_text, delete, exists, names, read_text, write_text


class Log:
    """Numbered entries (JSON) below ``folder``/_log. A number is taken by one writer only; entries never change.

    An entry with ``"base": true`` stands for all before it, so readers begin at the last one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/_log"

    def entries(self) -> list[dict]:
        """The last base entry and those after it, in order, each with its number as ``version``."""
        hint = f"{self.folder}/base.txt"
        first = int(read_text(self.spark, hint)) if exists(self.spark, hint) else 0
        numbers = [int(n[:12]) for n in names(self.spark, self.folder) if n[:12].isdigit() and n[12:] == ".json" and int(n[:12]) >= first]
        if not numbers:
            return []
        rows = self.spark.read.text([self._path(n) for n in numbers], wholetext=True).collect()
        found = sorted((json.loads(r[0]) for r in rows), key=lambda e: e["version"])
        last = max((k for k, e in enumerate(found) if e.get("base")), default=0)
        return found[last:]

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def commit(self, version: int, entry: dict) -> bool:
        """Whether the entry got this number."""
        done = create_text(self.spark, self._path(version), json.dumps(entry | {"version": version}))
        if done and entry.get("base"):
            write_text(self.spark, f"{self.folder}/base.txt", str(version))
        return done

    def append(self, entry: dict) -> int:
        """Commit under the next free number, for entries that hold whatever came before them."""
        known = self.entries()
        version = (known[-1]["version"] if known else 0) + 1
        while not self.commit(version, entry):
            version += 1
        return version

    def vacuum(self, part: Callable[[dict], str | None], kind: str, age: float = 86_400) -> list[str]:
        """Delete what no entry names any more: parts (named ``kind``...) of writers that lost or died, and of entries before
        the last base one, with these. ``part`` gives the part of an entry. Younger ones than ``age`` seconds stay, since a
        writer may be about to commit them or a reader still reads them. Returns the names of the parts that went."""
        entries, now, home = self.entries(), time.time(), self.folder.removesuffix("/_log")
        used, gone = {part(e) for e in entries}, []
        for name, changed in ages(self.spark, home):
            if name.startswith(kind) and name not in used and now - changed >= age:
                delete(self.spark, f"{home}/{name}")
                gone.append(name)
        for name, changed in ages(self.spark, self.folder):
            if name[:12].isdigit() and entries and int(name[:12]) < entries[0]["version"] and now - changed >= age:
                delete(self.spark, f"{self.folder}/{name}")
        return gone
