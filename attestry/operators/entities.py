"""Entity tagging and query expansion from a dictionary of surface forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strings

#: Surface forms up to which a dictionary is one pattern of alternatives; more are looked up by their first characters.
MOST = 20_000
#: Characters by which surface forms are looked up.
HEAD = 3
_SPECIAL = re.compile(r"([\\.\[\]{}()*+\-?^$|&~#\s])")


class Lookup:
    """Finds what the pattern of a dictionary finds: at each word boundary, from left to right, the longest form."""

    def __init__(self, canonical: dict[str, str]):
        self.canonical, lengths = canonical, {}
        for s in canonical:
            lengths.setdefault(s[:HEAD], set()).add(len(s))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def ids(self, text: str | None) -> set[str]:
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text or "")
        edges = [m.start() for m in re.finditer(r"\b", low)]
        ends, out, upto = set(edges), set(), 0
        for i in edges:
            if i < upto:
                continue
            sizes = {n for k in range(1, HEAD + 1) for n in self.lengths.get(low[i : i + k], ()) if n >= HEAD or n == k}
            for n in sorted(sizes, reverse=True):
                if i + n in ends and (found := self.canonical.get(low[i : i + n])) is not None:
                    out.add(found)
                    upto = i + n
                    break
        return out


class Dictionary:
    """Rows (surface, canonical, type). The first row of a surface, case aside, gives its canonical id."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.rows = [(s, c or s, t) for s, c, t in rows if s]
        self.canonical: dict[str, str] = {}
        self.surfaces: dict[str, list[str]] = {}
        for surface, canonical, _ in self.rows:
            self.canonical.setdefault(surface.lower(), canonical)
            if surface not in self.surfaces.setdefault(canonical, []):
                self.surfaces[canonical].append(surface)

    def pattern(self, flags: str = "(?iuU)") -> str:
        """Longest surface first, at word boundaries."""
        forms = sorted({s for s, _, _ in self.rows}, key=lambda s: (-len(s), s))
        return flags + r"\b(?:" + "|".join(_SPECIAL.sub(r"\\\1", s) for s in forms) + r")\b"

    def tag(self, text: Column) -> Column:
        """The distinct canonical ids of a text, sorted. Null text or an empty dictionary: none."""
        if not self.rows:
            return strings([])
        if len(self.rows) > MOST:
            return self._looked_up(text, lambda ids: ids)
        ids = F.create_map(*[F.lit(x) for kv in self.canonical.items() for x in kv])
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern()), F.lit(0))
        return F.array_sort(F.array_distinct(F.transform(F.transform(found, F.lower), lambda s: F.element_at(ids, s))))

    def _looked_up(self, text: Column, told: Callable[[list[str]], list[str]]) -> Column:
        """told(sorted ids) of a text, by lookups: the dictionary is sent to the workers, which index it once each."""
        canonical = self.canonical

        @F.pandas_udf("array<string>")
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lookup = Lookup(canonical)
            for texts in batches:
                yield pd.Series([told(sorted(lookup.ids(t))) for t in texts], dtype=object)

        return found(text)

    def expand(self, query: Column) -> Column:
        """The query followed by the sorted ids and surfaces of its entities."""
        if not self.rows:
            return query
        if len(self.rows) > MOST:
            surfaces = self.surfaces
            extra = self._looked_up(query, lambda ids: sorted({*ids, *(s for i in ids for s in surfaces[i])}))
            return F.when(F.size(extra) == 0, query).otherwise(F.concat_ws(" ", query, F.array_join(extra, " ")))
        forms = F.create_map(*[x for k, v in self.surfaces.items() for x in (F.lit(k), strings(v))])
        ids = self.tag(query)
        extra = F.array_sort(F.array_distinct(F.concat(ids, F.flatten(F.transform(ids, lambda i: F.element_at(forms, i))))))
        return F.when(F.size(extra) == 0, query).otherwise(F.concat_ws(" ", query, F.array_join(extra, " ")))


def relevant(text: Column, dictionary: Dictionary, keywords: list[str] | None = None, min_matches: int = 1) -> Column:
    """Whether a page has ``min_matches`` distinct entities or keywords."""
    rows = dictionary.rows + [(k, k, "keyword") for k in keywords or []]
    return F.size(Dictionary(rows).tag(text)) >= min_matches
