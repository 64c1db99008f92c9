"""Constraint rules over many sequences at once, as bits (F1 rows)."""

from __future__ import annotations

import numpy as np

from .frames import _runs

BASES = np.frombuffer(b"ACGT", np.uint8)
_TURNED = str.maketrans("ACGT", "TGCA")


def both_strands(motifs) -> list[str]:
    """The motifs and their reverse complements, each once."""
    return sorted({*motifs, *(m.translate(_TURNED)[::-1] for m in motifs)})


def violations(x: np.ndarray, rules) -> dict[str, np.ndarray]:
    """rule -> which rows of ``x`` (letters as ASCII, all of one length) violate it; ``rules``: as screening.Rules."""
    n, length = x.shape
    strong = (x == BASES[1]) | (x == BASES[2])
    base = np.isin(x, BASES)
    out = {"invalid_base": ~(base | (x == ord("N"))).all(1)}
    if rules.gc:
        share = 100 * strong.sum(1)
        out["gc_content"] = (share < rules.gc[0] * length) | (share > rules.gc[1] * length)
    if rules.window:
        width, low, high = rules.window
        bad = np.zeros(n, bool)
        if width <= length:
            sums = np.cumsum(np.pad(strong, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
            share = 100 * (sums[:, width:] - sums[:, :-width])
            bad = ((share < low * width) | (share > high * width)).any(1)
        out["gc_window"] = bad
    if rules.homopolymer is not None:
        out["homopolymer"] = _runs((x[:, 1:] == x[:, :-1]) & base[:, 1:], rules.homopolymer) if rules.homopolymer else base.any(1)
    if rules.tandem is not None:
        out["tandem_repeat"] = np.any([_runs(x[:, p:] == x[:, :-p], rules.tandem - p + 1) for p in (2, 3) if p < length] or [np.zeros(n, bool)], axis=0)
    if rules.motifs:
        bad = np.zeros(n, bool)
        for m in both_strands(rules.motifs):
            places = length - len(m) + 1
            if places > 0:
                found = np.ones((n, places), bool)
                for k, letter in enumerate(m.encode()):
                    found &= x[:, k : k + places] == letter
                bad |= found.any(1)
        out["motif"] = bad
    if rules.length:
        out["length"] = np.full(n, not rules.length[0] <= length <= rules.length[1])
    return out
