"""Checks of the arguments of an audit; all are made before anything is read."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .errors import ArgumentError

USAGE = "fasta must be one or more FASTA paths, a set of named sequences, or a list of these"
MODES = ("exact", "pansn", "prefix")


@dataclass
class Source:
    """One FASTA file or set of sequences in memory."""

    label: str
    path: str | None = None
    frame: Any = None
    mode: str = "exact"
    sample: str = ""
    haplotype: str = ""
    prefix: str = ""


@dataclass
class Arguments:
    sources: list[Source]
    gfa: str
    statistics: str = "basic"
    threads: int = 1
    memory_mib: int = 1024
    alignment_max_cells: int = 10_000_000
    mapping: list[dict[str, str]] = field(default_factory=list)


def whole(value: Any, name: str, most: int = 2**53 - 1) -> int:
    number = not isinstance(value, bool) and isinstance(value, (int, float))
    if not number or not math.isfinite(value) or value <= 0 or value != math.floor(value) or value > most:
        raise ArgumentError(f"{name} must be one positive whole number")
    return int(value)


def absolute(path: str) -> str:
    """An absolute path with ~ expanded; addresses with a scheme stay as they are."""
    return path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path) else os.path.abspath(os.path.expanduser(path))


def _is_path(x: Any) -> bool:
    return isinstance(x, (str, os.PathLike)) and str(x) != ""


def _is_frame(x: Any) -> bool:
    return hasattr(x, "sparkSession") and hasattr(x, "columns")


def _is_set(x: Any) -> bool:
    """A DataFrame (name, sequence), a mapping of names to sequences, or a list of pairs."""
    return _is_frame(x) or isinstance(x, Mapping) or (isinstance(x, (list, tuple)) and all(isinstance(p, tuple) and len(p) == 2 for p in x))


def _pairs(x: Any, place: int) -> Any:
    if _is_frame(x):
        if not {"name", "sequence"} <= set(x.columns):
            raise ArgumentError(f"the DataFrame in fasta element {place} must have the columns name and sequence")
        return x
    pairs = list(x.items() if isinstance(x, Mapping) else x)
    for name, _ in pairs:
        if not isinstance(name, str) or not name.strip():
            raise ArgumentError(f"the sequence set in fasta element {place} must have a non-empty name for every sequence")
        if re.search(r"[\r\n]", name):
            raise ArgumentError(f"the sequence set in fasta element {place} has sequence names containing line breaks")
    return [(name, str(sequence)) for name, sequence in pairs]


def sources_of(fasta: Any) -> list[Source]:
    """Sources in order. A dict of sets or paths names its elements; a dict of plain sequences is one set."""
    names: list[str | None]
    if _is_path(fasta):
        entries, names = [fasta], [None]
    elif _is_frame(fasta):
        entries, names = [fasta], [None]
    elif isinstance(fasta, Mapping) and fasta and all(isinstance(v, str) for v in fasta.values()):
        entries, names = [fasta], [None]
    elif isinstance(fasta, Mapping):
        entries, names = list(fasta.values()), [str(k) for k in fasta]
    elif isinstance(fasta, (list, tuple)):
        named = bool(fasta) and all(isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], str) and not isinstance(x[1], str) for x in fasta)
        if named:  # (name, element) pairs, whose names may repeat
            entries, names = [x[1] for x in fasta], [x[0] for x in fasta]
        elif fasta and all(isinstance(x, tuple) and len(x) == 2 for x in fasta):
            entries, names = [list(fasta)], [None]
        else:
            entries, names = list(fasta), [None] * len(fasta)
    else:
        raise ArgumentError(USAGE)
    if not entries:
        raise ArgumentError(USAGE)
    out = []
    for place, (entry, name) in enumerate(zip(entries, names), 1):
        if isinstance(entry, (str, os.PathLike)) and str(entry) == "":
            raise ArgumentError("fasta paths must be non-empty")
        if _is_path(entry):
            path = absolute(str(entry))
            out.append(Source(label=path, path=path))
        elif _is_set(entry):
            label = name or str(place)
            if name and names.count(name) > 1:
                label = f"{name}, element {place}"
            out.append(Source(label=f"<DataFrame {label}>", frame=_pairs(entry, place)))
        else:
            raise ArgumentError(f"{USAGE}; element {place} is neither")
    return out


def mapping_rows(mapping: Any, count: int) -> list[dict[str, str]]:
    """mode, sample, haplotype and prefix for each source."""
    fields = ("mode", "sample", "haplotype", "prefix")
    if mapping is None:
        return [{"mode": "exact", "sample": "", "haplotype": "", "prefix": ""} for _ in range(count)]
    if hasattr(mapping, "toPandas"):
        mapping = mapping.toPandas()
    if hasattr(mapping, "to_dict") and hasattr(mapping, "columns"):
        if len(mapping) and "mode" not in mapping.columns:
            raise ArgumentError("mapping must contain a mode column")
        mapping = mapping.to_dict("records")
    if not isinstance(mapping, (list, tuple)) or not all(isinstance(r, Mapping) for r in mapping):
        raise ArgumentError("mapping must be None, a DataFrame, or a list of dicts")
    if len(mapping) != count:
        raise ArgumentError("mapping must have one row per FASTA")
    if not all("mode" in r for r in mapping):
        raise ArgumentError("mapping must contain a mode column")
    text = lambda v: "" if v is None or v != v else str(v)
    rows = [{f: text(r.get(f, "")) for f in fields} for r in mapping]
    for r in rows:
        if r["mode"] not in MODES:
            raise ArgumentError("mapping mode must be exact, pansn, or prefix")
    for r in rows:
        if r["mode"] == "pansn" and (r["sample"] == "" or not re.fullmatch("[0-9]+", r["haplotype"])):
            raise ArgumentError("PanSN mappings require a sample and numeric haplotype")
    for r in rows:
        if r["mode"] == "prefix" and r["prefix"] == "":
            raise ArgumentError("prefix mappings require a non-empty prefix")
    return rows


def arguments(fasta, gfa, mapping, statistics, threads, memory_mib, alignment_max_cells) -> Arguments:
    sources = sources_of(fasta)
    if not _is_path(gfa):
        raise ArgumentError("gfa must be one non-empty path")
    if statistics not in ("basic", "comprehensive"):
        raise ArgumentError("statistics must be basic or comprehensive")
    threads = whole(threads, "threads", 2**31 - 1)
    memory_mib = whole(memory_mib, "memory_mib", (2**53 - 1) // 1024**2)
    cells = whole(alignment_max_cells, "alignment_max_cells")
    rows = mapping_rows(mapping, len(sources))
    for source, row in zip(sources, rows):
        source.mode, source.sample, source.haplotype, source.prefix = (row[k] for k in ("mode", "sample", "haplotype", "prefix"))
    return Arguments(sources, absolute(str(gfa)), statistics, threads, memory_mib, cells, rows)
