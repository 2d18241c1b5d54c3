"""Anchored pieces in the family of suffix arrays: one suffix and one prefix are ordered per piece, every repeat is found."""

import collections
import random

import pytest

from foldwise.llm import suffix_dedup, suffix_levels

LENGTH, WIDTH = 60, 24


def texts(seed):
    rng = random.Random(seed)
    draw = lambda n: bytes(rng.choice(b"ab\0") for _ in range(n))
    passages = [draw(n) for n in (59, 60, 61, 150, 400)]
    out = [draw(rng.randint(0, 90)) + rng.choice(passages) + draw(rng.randint(0, 90)) for _ in range(80)]
    return [*out, out[3], out[3][:200], b"", b"ab" * 200, b"\0" * 130]


@pytest.mark.parametrize("block", [90, 1 << 22])
def test_stretches_hold_every_window_once(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    cores = collections.defaultdict(set)
    for data in texts(1):
        rows = [r for part in suffix_dedup.stretches(data, LENGTH, WIDTH) for r in zip(*[x.tolist() for x in part], strict=True)]
        assert [s + k for _, _, s, n, _ in rows for k in range(n)] == list(range(max(len(data) - LENGTH + 1, 0)))
        for key, _, s, n, off in rows:
            assert 0 < n <= off + 1 <= WIDTH
            cores[key].add(data[s + off : s + off + LENGTH + 1 - WIDTH])
    assert all(len(c) == 1 and len(min(c)) == LENGTH + 1 - WIDTH for c in cores.values())


@pytest.mark.parametrize(("batch", "room"), [(7, 1 << 24), (100, 500), (10_000, 1 << 24)])
def test_anchored_pieces_order_one_suffix_each(monkeypatch, batch, room):
    monkeypatch.setattr(suffix_levels, "ROOM", room)
    pieces, windows = [], []
    for data in texts(2):
        for part in suffix_dedup.stretches(data, LENGTH, WIDTH):
            for _, _, s, n, off in zip(*[x.tolist() for x in part], strict=True):
                pieces.append((data[s : s + n + LENGTH - 1], n, len(windows), 1, off))
                windows += [data[s + k : s + k + LENGTH] for k in range(n)]
    family, found = suffix_levels.Family(LENGTH), set()
    for k in range(0, len(pieces), batch):
        found |= set(family.add(pieces[k : k + batch]).tolist())
    seen = collections.Counter(windows)
    assert found == {k for k, w in enumerate(windows) if seen[w] > 1} and len(found) > 100
    # the cost: as many suffixes are ordered as there are pieces, not as there are bytes or windows
    assert sum(len(level.suffixes) for level in family.levels) == len(pieces) < len(windows) / 3
    assert sum(map(len, family.levels)) == len(windows)


def test_weights_count_as_occurrences():
    family = suffix_levels.Family(4)
    assert family.add([(b"abcdef", 3, 0, 1, 2), (b"uvwxyz", 3, 3, 2, 2)]).tolist() == [3, 4, 5]
    assert family.add([(b"bcdeX", 2, 6, 1, 1)]).tolist() == [1, 6]
