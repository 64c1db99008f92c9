"""Codes, frames, alignment and channel without Spark."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.kernels import cauchy, channel, frames, gf256, reed_solomon
from strandlake.operators import planning


def test_inverse_of_matrix():
    m = cauchy.matrix(20, 20)
    assert (gf256.combine(gf256.inverse(m), m) == np.eye(20)).all()
    with pytest.raises(ValueError):
        gf256.inverse(np.zeros((2, 2), np.uint8))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([4, 12, 16, 20]))
def test_reed_solomon_up_to_the_bound(seed, r):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 256, (12, 40)).astype(np.uint8)
    word = np.concatenate([data, reed_solomon.parity(data, r)], axis=1)
    bad, erased = word.copy(), np.zeros(word.shape, bool)
    for i in range(len(word)):
        f = int(rng.integers(0, r + 1))
        at = rng.permutation(word.shape[1])[: f + (r - f) // 2]
        erased[i, at[:f]] = True
        bad[i, at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
    out, ok, _ = reed_solomon.decode(bad, r, erased)
    assert ok.all() and (out == word).all()


def test_reed_solomon_beyond_the_bound_keeps_the_word():
    data = np.arange(40, dtype=np.uint8)[None]
    word = np.concatenate([data, reed_solomon.parity(data, 4)], axis=1)
    word[0, :5] ^= 77
    out, ok, fixed = reed_solomon.decode(word, 4)
    assert not ok[0] or not reed_solomon.syndromes(out, 4).any()
    if not ok[0]:
        assert (out == word).all() and fixed[0] == 0


@pytest.mark.parametrize(("k", "m"), [(6, 3), (32, 32), (64, 16), (160, 48)])
def test_any_k_of_n(k, m):
    rng = np.random.default_rng(k)
    data = rng.integers(0, 256, (k, 9)).astype(np.uint8)
    whole = dict(enumerate(np.concatenate([data, cauchy.encode(data, k, m)])))
    keep = [int(i) for i in rng.permutation(k + m)[:k]]
    assert (cauchy.decode({i: whole[i] for i in keep}, k, m) == data).all()
    assert cauchy.decode({i: whole[i] for i in keep[:-1]}, k, m) is None


def test_stripe_columns_repair_rows():
    rng = np.random.default_rng(3)
    k, m, d, mc = 6, 2, 4, 2
    data = rng.integers(0, 256, (d, k, 5)).astype(np.uint8)
    rows = [np.concatenate([x, cauchy.encode(x, k, m)]) for x in data]
    columns = np.stack([np.concatenate([np.stack([r[j] for r in rows]), cauchy.encode(np.stack([r[j] for r in rows]), d, mc)]) for j in range(k + m)], axis=1)
    known = [{j: columns[i, j] for j in range(k + m)} for i in range(d + mc)]
    known[1], known[2] = {}, {0: columns[2, 0]}
    out, ok = cauchy.decode_stripe(known, k, m, d, mc)
    assert ok and all((out[i][j] == columns[i, j]).all() for i in range(d) for j in range(k))
    assert not cauchy.decode_stripe([{} for _ in range(d + mc)], k, m, d, mc)[1]


@pytest.mark.parametrize(("name", "nt"), [("v4-balanced", 313), ("v4-dense", 280), ("v6-high-dropout", 256)])
def test_strand_lengths(name, nt):
    assert frames.PROFILES[name][0].strand_nt == nt


def test_frames_round_trip_and_screen():
    layout, _, _ = frames.PROFILES["v4-balanced"]
    payloads = np.random.default_rng(1).integers(0, 256, (50, 40)).astype(np.uint8)
    strands, variants = frames.build(layout, frames.Screen(), 513, frames.DATA, range(50), range(50), payloads)
    assert (variants >= 0).all() and frames.Screen().passes(strands).all()
    f, e, wrong = frames.strip(layout, strands)
    p = frames.parse(layout, f, e)
    assert p.ok.all() and (p.payload == payloads).all() and (p.group == np.arange(50)).all() and (p.tag == 513).all() and not wrong.any()


def test_alignment_repairs_one_indel():
    layout, _, _ = frames.PROFILES["v4-balanced"]
    rng = np.random.default_rng(2)
    payloads = rng.integers(0, 256, (40, 40)).astype(np.uint8)
    strands, _ = frames.build(layout, frames.Screen(), 1, frames.DATA, [0] * 40, range(40), payloads)
    reads = [np.delete(s, int(rng.integers(0, 313))) if i % 2 else np.insert(s, int(rng.integers(0, 313)), 1) for i, s in enumerate(strands)]
    f, e, cost = frames.align(layout, [*reads, strands[0][:200]])
    p = frames.parse(layout, f, e)
    assert (p.ok[:40] & (p.payload[:40] == payloads).all(1)).sum() >= 36
    assert cost[-1] == -1 and not p.ok[-1]


def test_channel_is_a_function_of_seed_and_batch():
    strands = np.random.default_rng(0).integers(0, 4, (20, 60)).astype(np.uint8)
    a, b = (channel.simulate(strands, channel.Channel(seed=5), 3) for _ in range(2))
    assert all((x == y).all() for x, y in zip(a.codes, b.codes, strict=True))
    clean = channel.simulate(strands, channel.Channel(substitution=0, insertion=0, deletion=0, coverage=2, model="fixed"), 0)
    assert len(clean.codes) == 40 and all((c == strands[s]).all() for c, s in zip(clean.codes, clean.source, strict=True))


def test_failure_bound_and_slots():
    assert planning.failure_bound(80, 16, 0.0) == 0.0
    loss = planning.tolerated_loss(64, 16, 1e-6)
    assert planning.failure_bound(80, 16, loss) <= 1e-6 < planning.failure_bound(80, 16, loss + 0.01)
    assert planning.superblock_slots(100, 2) == [25, 75]
    assert planning.symbol_positions(2, 1, 2, 0, True)[:2] == [(0, 0), (1, 0)]


def test_word_hashes_and_least(monkeypatch):
    import hashlib

    from strandlake.kernels import sketches

    plain = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
    for k in (3, 4, 12, 55, 60):
        words = np.random.default_rng(k).integers(0, 128, (300, k), dtype=np.uint8)
        assert sketches.hash60(words).tolist() == [plain(w.tobytes().decode()) for w in words]
    turn = str.maketrans("ACGT", "TGCA")
    texts = ["ACGTTGCAACGGT" * 5, None, "", "ACG", "ACGTAäöGTTACGA", "GATTACA", "TGTAATC"]
    for both in (False, True):
        want = []
        for t in texts:
            slots = [sketches.NONE] * 4
            for i in range(len(t or "") - 4):
                word = t[i : i + 5]
                own = min(word, word.translate(turn)[::-1]) if both else word
                h = plain(own)
                slots[h % 4] = min(slots[h % 4], 2 * h + (own != word))
            want.append(slots)
        for letters in (7, 1 << 18):  # pieces of a long text share what a word needs
            monkeypatch.setattr(sketches, "LETTERS", letters)
            assert sketches.least(texts, 5, 4, both).tolist() == want


def test_distances_of_many_pairs(monkeypatch):
    from strandlake.kernels import alignment, distance

    rng = np.random.default_rng(5)
    left, right = [], []
    for i in range(120):
        a = "".join(rng.choice(list("ab日"), rng.choice([0, 1, 5, 63, 64, 65, 130])))
        b = "".join(rng.choice(list("ab日"), rng.choice([0, 1, 64, 100]))) if i % 2 else a[:3] + a[4:20] + "b" + a[21:]
        left.append(a), right.append(b)
    exact = np.array([alignment.align(a, b)[0] for a, b in zip(left, right, strict=True)])
    for pairs, masks in ((1024, 1 << 24), (7, 1 << 12)):
        monkeypatch.setattr(distance, "PAIRS", pairs), monkeypatch.setattr(distance, "MASKS", masks)
        for share in (0.0, 0.3, 1.0):
            most = np.array([int(share * max(len(a), len(b))) for a, b in zip(left, right, strict=True)])
            assert distance.within(left, right, most).tolist() == np.where(exact <= most, exact, -1).tolist()


def test_alignments_of_many_pairs(monkeypatch):
    from strandlake.kernels import alignment

    rng = np.random.default_rng(9)
    refs, reads = [], []
    for _ in range(150):
        a = "".join(rng.choice(list("ab日"), rng.choice([0, 1, 2, 9, 40, 70])))
        cut = int(rng.integers(0, len(a) + 1))
        refs.append(a), reads.append(a[:cut] + "".join(rng.choice(list("ab"), rng.integers(0, 4))) + a[cut + int(rng.integers(0, 5)) :])
    for band in (0, 3, 8):
        for pairs, steps in ((512, 1 << 25), (7, 1 << 10)):
            monkeypatch.setattr(alignment, "PAIRS", pairs), monkeypatch.setattr(alignment, "STEPS", steps)
            assert alignment.align_many(refs, reads, band) == [alignment.align(a, b, band) for a, b in zip(refs, reads, strict=True)]
    assert alignment.align_many([], [], 8) == []
