"""Whether similar sets have a signature in common, tried on pairs right at the threshold; how many rows a set signs."""

import numpy as np
import pytest

from trelliq.llm.near_duplicates import least_overlap, signatures


def pair(r, n, size, threshold, n_common):
    """Two sets of ``n`` and ``size`` features with just the overlap that the threshold asks for; (sets, digits)."""
    shared = int(np.ceil(threshold / (1 + threshold) * (n + size) - 1e-9))
    f = r.integers(1, 1 << 62, n + size - shared)
    digits = np.zeros(len(f), np.uint8)
    # Common features first among the shared ones, then among the others.
    digits[:n_common] = 12
    return (f[:n], np.r_[f[:shared], f[n:]]), (digits[:n], np.r_[digits[:shared], digits[n:]])


def meet(sets, digits, threshold):
    row, sig, reach, role = signatures(np.concatenate(sets), np.array([len(x) for x in sets]), np.concatenate(digits), threshold)
    need = threshold / (1 + threshold) * sum(map(len, sets)) - 1e-9
    first = {}
    for s, k, o in zip(sig[row == 0].tolist(), reach[row == 0].tolist(), role[row == 0].tolist()):
        first.setdefault(s, []).append((k, o))
    return any(k >= need and k2 >= need and not o & o2 for s, k, o in zip(sig[row == 1].tolist(), reach[row == 1].tolist(), role[row == 1].tolist()) for k2, o2 in first.get(s, []))


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.65])
def test_no_pair_is_lost_below_the_coarse_parts(threshold):
    """Every size, every mixture of common and rare shared features: always a signature in common."""
    r = np.random.default_rng(int(threshold * 100))
    for _ in range(3000):
        n = int(r.integers(1, 90))
        size = int(r.integers(least_overlap(threshold, np.array([n]))[0], int(n / threshold + 1e-9) + 1))
        shared = int(np.ceil(threshold / (1 + threshold) * (n + size) - 1e-9))
        if shared <= min(n, size):
            n_common = int(r.choice([0, shared, r.integers(0, shared + 1), r.integers(0, n + size - shared + 1)]))
            assert meet(*pair(r, n, size, threshold, n_common), threshold), (n, size, n_common)


@pytest.mark.parametrize("n", [4, 12, 28, 33, 40, 60, 110, 250, 500])
@pytest.mark.parametrize("commons", [0.0, 0.3, 0.5, 0.9])
def test_pairs_lost_by_coarse_parts(n, commons):
    """Simulation at 0.8: of 400 pairs right at the threshold a case, sizes equal and as far apart as they may be, none is lost."""
    r = np.random.default_rng(n)
    for size in {n, int(n / 0.8)}:
        shared = int(np.ceil(0.8 / 1.8 * (n + size) - 1e-9))
        if shared <= n:
            lost = sum(not meet(*pair(r, n, size, 0.8, int(commons * shared)), 0.8) for _ in range(200))
            assert lost == 0


@pytest.mark.parametrize("threshold,n_heavy,n_light,n_more", [(0.5, 30, 3, 31), (0.5, 32, 1, 31), (0.5, 60, 1, 61), (0.5, 30, 32, 62), (0.5, 200, 5, 190), (0.8, 39, 1, 10), (0.8, 100, 3, 25)])
def test_contained_sets_with_few_rare_features_are_found(threshold, n_heavy, n_light, n_more):
    r = np.random.default_rng(n_heavy * 1000 + n_light)
    for _ in range(200):
        f = r.integers(1, 1 << 60, n_heavy + n_light + n_more)
        digits = np.where(np.arange(len(f)) < n_heavy, 12, 0).astype(np.uint8)
        k = n_heavy + n_light
        assert k > 32 and k / len(f) >= threshold
        assert meet((f[:k], f), (digits[:k], digits), threshold)


def test_rows_of_a_set_are_linear_in_its_features():
    r = np.random.default_rng(0)
    for n in (50, 500, 5000):
        for commons in (0.0, 0.4, 0.6, 1.0):
            f, digits = r.integers(1, 1 << 60, n), np.where(np.arange(n) < commons * n, 12, 0).astype(np.uint8)
            row, *_ = signatures(f, np.array([n]), digits, 0.5)
            assert len(row) <= 8 * n + 2000


def test_records_with_just_a_common_passage_do_not_meet():
    """60 common features and 40 of their own: no pair of them is similar, and none is compared; the passage alone meets all."""
    r = np.random.default_rng(1)
    passage = r.integers(1, 1 << 60, 60)
    sets = [np.r_[passage, r.integers(1, 1 << 60, 40)] for _ in range(20)] + [passage]
    digits = [np.where(np.arange(len(x)) < 60, 12, 0).astype(np.uint8) for x in sets]
    assert not any(meet((sets[i], sets[j]), (digits[i], digits[j]), 0.5) for i in range(20) for j in range(i))
    assert all(meet((sets[i], sets[20]), (digits[i], digits[20]), 0.5) for i in range(20))


def test_words_are_runs_of_letters_and_digits():
    import sys
    import unicodedata

    from trelliq.llm.near_duplicates import WORD, Words, feature_sets

    odd = [c for i in range(sys.maxunicode + 1) if (c := chr(i)) and bool(WORD.fullmatch(c)) != (unicodedata.category(c)[0] in "LN")]
    assert not odd
    known = Words()
    flat, sizes = feature_sets(["a b c", "a_b-c", "", "b a", "A b c d"], 3, known)
    assert sizes.tolist() == [1, 1, 0, 0, 2] and flat[0] == flat[1] and len(set(flat.tolist())) == 3
