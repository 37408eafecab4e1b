"""Converters between scripts: phrases replaced by longest match, or any function of a text.

A converter runs once a record, in the pass that makes keys ready, and its result is folded like the title itself; pairs only compare columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import _folded


class Phrases:
    """Replaces phrases from left to right, at each place the longest one that begins there; other characters stay. Held as a trie, so a text costs its length times the longest phrase at most."""

    def __init__(self, phrases: Mapping[str, str]) -> None:
        self.trie: dict = {}
        for phrase, other in phrases.items():
            if not phrase:
                continue
            node = self.trie
            for c in phrase:
                node = node.setdefault(c, {})
            node[""] = other

    def __call__(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            node, j, end, found = self.trie, i, i + 1, text[i]
            while j < len(text) and text[j] in node:
                node, j = node[text[j]], j + 1
                if "" in node:
                    end, found = j, node[""]
            out.append(found)
            i = end
        return "".join(out)


Converter = Callable[[str], str] | Mapping[str, str]


def converted(raw: Column, converter: Converter) -> Column:
    """The folded conversion of a text; null where the converter fails, so nothing is equivalent to it. Phrases travel with the plan: dictionaries of some megabytes at most."""
    convert = Phrases(converter) if isinstance(converter, Mapping) else converter

    def attempt(text: str | None) -> str | None:
        try:
            return _folded(convert(text or ""))
        except Exception:  # whatever another's converter raises: the record has no such key
            return None

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([attempt(t) for t in texts.to_pylist()], pa.string())

    return run(raw)
