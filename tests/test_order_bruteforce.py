import numpy as np
import pytest

from sealwright.operators.pages import _touching_roots, cut_positions


def free_bands(boxes, axis):
    """All empty bands between boxes along an axis: (width, end), found by marking the occupied unit cells."""
    occupied = set()
    for b in boxes:
        occupied.update(range(b[axis], b[axis] + b[axis + 2]))
    ends = [p for p in occupied if p - 1 not in occupied and p > min(occupied)]
    return [(p - max(q for q in occupied if q < p) - 1, p) for p in ends]


def violations(order, min_gap, mode):
    """Where an order breaks the rule that every region is read one side of its cut after the other.

    A stretch of the order that is a region is tested on its own: the cut the rule names must part the stretch
    into two that follow each other, and each of these is a region again.
    """
    found, regions = [], [order]
    while regions:
        boxes = regions.pop()
        if len(boxes) < 2:
            continue
        bands = [free_bands(boxes, axis) for axis in (0, 1)]
        width = [max((w for w, _ in b), default=0) for b in bands]
        by_column = width[0] >= max(min_gap, 1) and (mode == "gutter_first" or width[0] >= width[1])
        axis = 0 if by_column else 1
        if not width[axis]:
            if boxes != sorted(boxes, key=lambda b: (b[1], b[0])):
                found.append(boxes)
            continue
        cut = min(end for w, end in bands[axis] if w == width[axis])
        after = [b[axis] >= cut for b in boxes]
        if after != sorted(after):
            found.append(boxes)
        regions += [[b for b, late in zip(boxes, after) if late is side] for side in (False, True)]
    return found


def fast_order(pages, min_gap, mode):
    rows = sorted(((p, *b) for p, boxes in enumerate(pages) for b in boxes), key=lambda r: (r[0], r[2], r[1], r[3], r[4]))
    a = np.array(rows, dtype=np.int64)
    place = cut_positions(a[:, 0], *(a[:, k] for k in range(1, 5)), np.full(len(a), min_gap), mode)
    assert sorted(place) == list(range(len(a)))
    out = a[np.argsort(place)]
    return [[tuple(r[1:]) for r in out if r[0] == p] for p in range(len(pages))]


@pytest.mark.parametrize("mode", ["gutter_first", "widest"])
@pytest.mark.parametrize("spread,size", [(60, 12), (400, 40), (1000, 6)])
def test_every_cut_is_respected(mode, spread, size):
    rng = np.random.default_rng(spread + size)
    pages = []
    for _ in range(60):
        n = int(rng.integers(1, size))
        boxes = {tuple(int(v) for v in (rng.integers(0, spread), rng.integers(0, spread), rng.integers(1, 40), rng.integers(1, 20)))
                 for _ in range(n)}
        # one box per corner: exact ties have no order of their own
        pages.append(list({(b[0], b[1]): b for b in boxes}.values()))
    got = fast_order(pages, 5, mode)
    for boxes, order in zip(pages, got):
        assert sorted(order) == sorted(boxes) and violations(order, 5, mode) == []


def test_title_and_two_columns():
    boxes = [(10, 0, 500, 20), (10, 40, 200, 10), (300, 45, 200, 10), (10, 60, 200, 10), (300, 65, 200, 10)]
    assert fast_order([boxes], 9, "gutter_first")[0] == [boxes[i] for i in (0, 1, 3, 2, 4)]


def test_stacked_and_stairs():
    stacked = [(0, i * 2, 5, 1) for i in range(1001)]
    assert fast_order([stacked], 1, "gutter_first")[0] == stacked
    stairs = [(i * 3, i * 3, 2, 2) for i in range(3000)]
    assert fast_order([stairs], 1, "gutter_first")[0] == stairs


def test_runs_join_like_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(40):
        grid = rng.random((12, 15)) < 0.45
        runs = []
        for y in range(12):
            x = 0
            while x < 15:
                if grid[y, x]:
                    start = x
                    while x + 1 < 15 and grid[y, x + 1]:
                        x += 1
                    runs.append((y, start, x))
                x += 1
        if not runs:
            continue
        a = np.array(runs)
        roots = _touching_roots(a[:, 0], a[:, 1], a[:, 2])
        seen, label = {}, 0
        for y in range(12):
            for x in range(15):
                if grid[y, x] and (y, x) not in seen:
                    todo = [(y, x)]
                    while todo:
                        p = todo.pop()
                        if p in seen:
                            continue
                        seen[p] = label
                        todo += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                                 if 0 <= p[0] + dy < 12 and 0 <= p[1] + dx < 15 and grid[p[0] + dy, p[1] + dx]]
                    label += 1
        want = [seen[(r[0], r[1])] for r in runs]
        pairs = set(zip(want, roots.tolist()))
        assert len(pairs) == len(set(want)) == len(set(roots.tolist()))
