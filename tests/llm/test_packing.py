import random
from collections import Counter, defaultdict

import pytest

from folioscan.llm.packing import best_fit_pack, best_size, plan


def one_by_one(lengths, sizes, per_bin):
    """Best fit decreasing, piece by piece: contents of the bins."""
    left, bins = Counter(lengths), []
    for length in sorted(lengths, reverse=True):
        fitting = [b for b in bins if b[0] >= length]
        if fitting:
            b = min(fitting, key=lambda b: (b[0], -sum(b[1])))
        else:
            size = best_size(length, left[length], sizes, per_bin)
            b = [size, []]
            bins.append(b)
        b[0] -= length
        b[1].append(length)
        left[length] -= 1
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_groups_pack_as_single_pieces_do(seed):
    rng = random.Random(seed)
    sizes = [8, 16, 40]
    lengths = [min(40, max(1, int(rng.lognormvariate(2, 1)))) for _ in range(400)]
    if seed % 3 == 0:
        lengths = [rng.choice([7, 13, 3]) for _ in range(300)]
    made = plan(Counter(lengths), sizes, 1.0)
    # Which of several bins with equal room and contents a piece joins is open; how full they get is not.
    assert fill(made, Counter(lengths), sizes) == Counter(sum(b[1]) for b in one_by_one(lengths, sizes, 1.0))


def fill(made, counts, sizes):
    bins = defaultdict(list)
    for length, n in counts.items():
        slots = made.slots[length]
        for rank in range(n):
            first, per, start, _ = max(s for s in slots if s[0] <= rank)
            bins[start + (rank - first) // per].append(length)
    assert sorted(bins) == list(range(made.bins))
    for i, content in bins.items():
        size = max(s for s in made.sizes if s[0] <= i)
        assert size[2] == sum(content) and size[1] == min(s for s in sizes if s >= sum(content))
    return Counter(map(sum, bins.values()))


def test_lengths_must_fit():
    with pytest.raises(ValueError, match="lengths"):
        plan({9: 1}, [4, 8])


def packed(table, rows, **kw):
    docs = table(rows, "doc_id long, n_tokens int, bin_id string, rank int, part int")
    return best_fit_pack(docs, **kw).collect()


def test_every_token_has_one_place(table):
    rng = random.Random(5)
    rows = [(i, rng.choice([3, 3, 3, rng.randint(1, 900)]), "x", 1, 2) for i in range(600)] + [(7, 3, "x", 1, 2)] * 40
    found = packed(table, rows, sizes=(32, 64, 128), per_bin=2.0)
    total = defaultdict(int)
    for r in found:
        assert r.start == r.piece * 128 and 1 <= r.length <= 128
        total[r.doc_id] += r.length
    expected = defaultdict(int)
    for r in rows:
        expected[r[0]] += r[1]
    assert total == expected
    bins = defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r)
    for content in bins.values():
        at = 0
        for r in sorted(content, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert at == content[0].bin_used <= content[0].bin_size and len({(r.bin_size, r.bin_used) for r in content}) == 1
    used = Counter(sum(r.length for r in b) for b in bins.values())
    assert used == Counter(sum(b[1]) for b in one_by_one([r.length for r in found], (32, 64, 128), 2.0))


def test_nothing_to_pack(table):
    assert packed(table, []) == []
    assert packed(table, [(1, None, "", 0, 0), (2, 0, "", 0, 0), (3, -4, "", 0, 0)]) == []
    [row] = packed(table, [(None, 5, "", 0, 0)], sizes=(4, 8))
    assert row.doc_id is None and (row.bin_size, row.bin_used) == (8, 5)
