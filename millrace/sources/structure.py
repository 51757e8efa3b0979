"""Structure files, a nested format of named, typed groups of attributes, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, node string, parent string, type string, attribute string, value string"
#: Quoted text, words, and the marks of the format.
TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'|([{}=;,])|([^\s{}=;,"\']+)', re.S)


def attributes(text: str) -> Iterator[tuple[str, str | None, str, str | None, str | None]]:
    """(node, parent, type, attribute, value) of each attribute; a group without attributes gives one row with nulls. Nodes are paths of
    names. Several values of an attribute are several rows."""
    tokens = []
    for m in TOKEN.finditer(text):
        if m[0].startswith(("//", "/*")):
            continue
        tokens.append((m[3] is not None, m[3] or (re.sub(r"\\(.)", r"\1", m[1] if m[1] is not None else m[2]) if m[4] is None else m[4])))
    stack: list[tuple[str, str, bool]] = []
    words: list[str] = []
    name = None
    for mark, word in tokens:
        if not mark:
            words.append(word)
        elif word == "{":
            parent = stack[-1][0] if stack else None
            label, kind = (words[-2:] + ["", ""])[:2]  # what stands before is the header of the file
            if stack:
                stack[-1] = (*stack[-1][:2], True)
            stack.append((f"{parent or ''}/{label}", kind, False))
            words = []
        elif word == "=":
            name, words = words[-1] if words else "", []
        elif word in ";,":
            if name is not None and stack:
                stack[-1] = (*stack[-1][:2], True)
                yield stack[-1][0], stack[-2][0] if len(stack) > 1 else None, stack[-1][1], name, " ".join(words)
            name, words = name if word == "," else None, []
        elif word == "}" and stack:
            node, kind, used = stack.pop()
            if not used:
                yield node, stack[-1][0] if stack else None, kind, None, None
            name, words = None, []


def read_structure(spark: SparkSession, path: str) -> DataFrame:
    """Attributes of all structure files that the path names. A file is one row of the parser: these are files of settings, of some kilobytes."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(where, *a) for where, text in frame.itertuples(index=False) for a in attributes(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(parse, SCHEMA)
