"""Channel models as documents: checks, defaults, overrides, registry by name and version (S16, C11, M28 rows)."""

from __future__ import annotations

import re
from dataclasses import fields

from ..functions.text import canonical, strict_document, with_value
from .channel import Channel, Runs

SCHEMA = "strandlake-channel/1"
_NAME = re.compile(r"[a-z0-9][a-z0-9._+-]{0,63}")
_VERSION = re.compile(r"[0-9]+(\.[0-9]+)*(-[0-9A-Za-z.]+)?")
#: Where each parameter of a channel stands in a document.
SECTIONS = {
    "synthesis": ["dropout"],
    "amplification": ["coverage", "model", "dispersion", "gc_bias", "gc_optimum", "duplication"],
    "sequencing": ["substitution", "insertion", "deletion", "unknown", "reverse", "burst", "burst_length", "quality", "quality_error", "informative", "matrix", "profile", "insertion_runs", "deletion_runs", "spread", "states", "homopolymer"],
}
RATES = ["dropout", "substitution", "insertion", "deletion", "unknown", "reverse", "burst", "duplication", "informative", "gc_optimum"]


def to_document(name: str, version: str, channel: Channel) -> dict:
    """The document of a channel; its seed is no part of the model."""
    plain = lambda v: {"kind": v.kind, "p": v.p, "weights": list(v.weights)} if isinstance(v, Runs) else [list(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, tuple) else v
    return {"schema": SCHEMA, "name": name, "version": version, "stages": {s: {n: plain(getattr(channel, n)) for n in names} for s, names in SECTIONS.items()}}


def faults(document: dict) -> list[str]:
    """What is wrong with a model document; empty if nothing is."""
    out = []
    if document.get("schema") != SCHEMA:
        out.append("the schema is not known")
    if not _NAME.fullmatch(str(document.get("name"))) or not _VERSION.fullmatch(str(document.get("version"))):
        out.append("name or version is not well formed")
    stages = document.get("stages")
    if not isinstance(stages, dict) or set(stages) - set(SECTIONS):
        return [*out, "stages are missing or not known"]
    known = {f.name: f.default for f in fields(Channel)}
    for s, values in stages.items():
        out += [f"{s}.{n} is not known" for n in values if n not in SECTIONS[s]]
        for n, v in values.items():
            if n in RATES and not (isinstance(v, int | float) and 0 <= v <= 1):
                out.append(f"{s}.{n} is no probability")
            elif isinstance(known.get(n), int | float) and not isinstance(v, int | float):
                out.append(f"{s}.{n} is no number")
    sequencing = stages.get("sequencing", {})
    if not out and sum(sequencing.get(n, known[n]) for n in ("substitution", "insertion", "deletion")) > 1:
        out.append("the error rates exceed one in all")
    if (m := sequencing.get("matrix")) and (len(m) != 4 or any(len(r) != 4 or min(r) < 0 or sum(r) - r[i] <= 0 for i, r in enumerate(m))):
        out.append("the matrix is not 4 x 4 with weights for other bases")
    return out


def from_document(document: dict, seed: int = 0) -> Channel:
    """The channel of a document; what it leaves out has its default. ValueError if it has faults."""
    if bad := faults(document):
        raise ValueError("; ".join(bad))
    values = {n: v for part in document["stages"].values() for n, v in part.items()}
    for n, v in values.items():
        if n.endswith("_runs"):
            values[n] = Runs(v.get("kind", "single"), v.get("p", 1.0), tuple(v.get("weights", ())))
        elif isinstance(v, list):
            values[n] = tuple(tuple(x) if isinstance(x, list) else x for x in v)
    return Channel(seed=seed, **values)


def overridden(document: dict, changes: dict[str, object]) -> dict:
    """A copy with values at dotted paths ("sequencing.deletion") replaced."""
    for path, value in changes.items():
        document = with_value(document, f"stages.{path}", value)
    return document


class Registry:
    """Documents by name and version; "name" alone is the latest release, else the latest pre-release."""

    def __init__(self) -> None:
        self._all: dict[tuple[str, str], dict] = {}

    def add(self, text: str) -> None:
        document = strict_document(text)
        if bad := faults(document):
            raise ValueError("; ".join(bad))
        key = (document["name"], document["version"])
        if key in self._all:
            raise ValueError(f"{key[0]}@{key[1]} is there already")
        self._all[key] = document

    @staticmethod
    def order(version: str) -> tuple:
        core, _, rest = version.partition("-")
        return tuple(map(int, core.split("."))), not rest, rest

    def resolve(self, reference: str) -> dict:
        name, _, version = reference.partition("@")
        versions = sorted((v for n, v in self._all if n == name), key=self.order)
        if not versions or (version and version not in versions):
            raise KeyError(reference)
        return self._all[name, version or versions[-1]]


def digest_text(document: dict) -> str:
    return canonical(document)
