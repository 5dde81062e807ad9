"""The order in which DuckDB's list sort leaves equal elements: that of its unstable quicksort, element by element.

Only comparisons decide it, so that ranks stand for the values.  Written after pattern-defeating quicksort with
branchless partitions, as DuckDB 2.0 runs it for lists below ``LONGEST``; longer ones are sorted by radix there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lists shorter than SHORTEST are sorted by insertion, which is stable.
SHORTEST, LONGEST = 24, 128


def insertion(k: list[int], v: list[int], begin: int, end: int) -> None:
    for i in range(begin + 1, end):
        x, j = v[i], i
        while j > begin and k[x] < k[v[j - 1]]:
            v[j] = v[j - 1]
            j -= 1
        v[j] = x


def nearly_sorted(k: list[int], v: list[int], begin: int, end: int) -> bool:
    """Insertion that gives up after moving more than eight places."""
    moved = 0
    for i in range(begin + 1, end):
        x, j = v[i], i
        while j > begin and k[x] < k[v[j - 1]]:
            v[j] = v[j - 1]
            j -= 1
        v[j] = x
        moved += i - j
        if moved > 8:
            return False
    return True


def sift(k: list[int], v: list[int], begin: int, hole: int, n: int, x: int) -> None:
    top = child = hole
    while child < (n - 1) // 2:
        child = 2 * (child + 1)
        if k[v[begin + child]] < k[v[begin + child - 1]]:
            child -= 1
        v[begin + hole] = v[begin + child]
        hole = child
    if n % 2 == 0 and child == (n - 2) // 2:
        child = 2 * (child + 1)
        v[begin + hole] = v[begin + child - 1]
        hole = child - 1
    while hole > top and k[v[begin + (hole - 1) // 2]] < k[x]:
        v[begin + hole] = v[begin + (hole - 1) // 2]
        hole = (hole - 1) // 2
    v[begin + hole] = x


def heap(k: list[int], v: list[int], begin: int, end: int) -> None:
    for parent in range((end - begin - 2) // 2, -1, -1):
        sift(k, v, begin, parent, end - begin, v[begin + parent])
    for last in range(end - 1, begin, -1):
        x, v[last] = v[last], v[begin]
        sift(k, v, begin, 0, last - begin, x)


def below(k: list[int], v: list[int], begin: int, end: int) -> tuple[int, bool]:
    """Parts into less than the first element, and the rest; its place, and whether nothing had to move."""
    pivot, first, last = v[begin], begin + 1, end - 1
    p = k[pivot]
    while k[v[first]] < p:
        first += 1
    while (first - 1 != begin or first < last) and k[v[last]] >= p:
        last -= 1
    done = first >= last
    if not done:
        v[first], v[last] = v[last], v[first]
        first += 1
        low, high, left, right = first, last, [], []
        while first < last:
            unknown = last - first
            on_left = 0 if left else unknown if right else unknown // 2
            on_right = 0 if right else unknown - on_left
            on_left, on_right = min(on_left, 64), min(on_right, 64)
            left += [i for i in range(on_left) if k[v[first + i]] >= p]
            first += on_left
            right += [i for i in range(1, on_right + 1) if k[v[last - i]] < p]
            last -= on_right
            n = min(len(left), len(right))
            if len(left) == len(right):
                for i, j in zip(left, right):
                    v[low + i], v[high - j] = v[high - j], v[low + i]
            elif n:
                at = high - right[0]
                held, v[low + left[0]] = v[low + left[0]], v[at]
                for i, j in zip(left[1:n], right[1:n]):
                    v[at] = v[low + i]
                    at = high - j
                    v[low + i] = v[at]
                v[at] = held
            left, right = left[n:], right[n:]
            low, high = low if left else first, high if right else last
        while left:
            last -= 1
            at = low + left.pop()
            v[at], v[last] = v[last], v[at]
            first = last
        while right:
            at = high - right.pop()
            v[at], v[first] = v[first], v[at]
            first += 1
    v[begin], v[first - 1] = v[first - 1], pivot
    return first - 1, done


def equal(k: list[int], v: list[int], begin: int, end: int) -> int:
    """Parts into equal to the first element, which nothing is less than, and the rest."""
    pivot, first, last = v[begin], begin, end - 1
    p = k[pivot]
    while p < k[v[last]]:
        last -= 1
    first += 1
    while (last + 1 != end or first < last) and p >= k[v[first]]:
        first += 1
    while first < last:
        v[first], v[last] = v[last], v[first]
        last -= 1
        while p < k[v[last]]:
            last -= 1
        first += 1
        while p >= k[v[first]]:
            first += 1
    v[begin], v[last] = v[last], pivot
    return last


def quicksort(k: list[int], v: list[int], begin: int, end: int, bad: int, leftmost: bool = True) -> None:
    while end - begin >= SHORTEST:
        half = (end - begin) // 2
        for a, b in ((begin + half, begin), (begin, end - 1), (begin + half, begin)):  # the median comes first
            if k[v[b]] < k[v[a]]:
                v[a], v[b] = v[b], v[a]
        if not leftmost and k[v[begin - 1]] >= k[v[begin]]:
            begin = equal(k, v, begin, end) + 1
            continue
        at, done = below(k, v, begin, end)
        left, right = at - begin, end - at - 1
        if min(left, right) < (end - begin) // 8:
            bad -= 1
            if not bad:
                return heap(k, v, begin, end)
            if left >= SHORTEST:
                q = left // 4
                v[begin], v[begin + q] = v[begin + q], v[begin]
                v[at - 1], v[at - q] = v[at - q], v[at - 1]
            if right >= SHORTEST:
                q = right // 4
                v[at + 1], v[at + 1 + q] = v[at + 1 + q], v[at + 1]
                v[end - 1], v[end - q] = v[end - q], v[end - 1]
        elif done and nearly_sorted(k, v, begin, at) and nearly_sorted(k, v, at + 1, end):
            return None
        quicksort(k, v, begin, at, bad, leftmost)
        begin, leftmost = at + 1, False
    return insertion(k, v, begin, end)


def grade_up(values) -> list[int]:
    """Positions, from 0, in ascending order of value, NaN last; equals as DuckDB leaves them, or in their order where it would use a radix."""
    x = np.asarray(values, dtype=float) + 0.0  # no negative zero
    if not SHORTEST <= len(x) < LONGEST:
        return np.argsort(x, kind="stable").tolist()
    ranks, order = np.unique(x, return_inverse=True)[1].tolist(), list(range(len(x)))
    quicksort(ranks, order, 0, len(x), len(x).bit_length() - 1)
    return order


def orders(lists: pa.Array) -> pa.Array:
    """``grade_up`` of each list; nulls, as SQL has them, last.  Lists of one width without nulls are sorted at once."""
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.unique(pc.list_value_length(lists).drop_null())
    values = lists.flatten()
    if len(lengths) > 1 or values.null_count:
        return pa.array([None if x is None else with_nulls(x) for x in lists.to_pylist()], pa.list_(pa.int32()))
    width = lengths[0].as_py() if len(lengths) else 0
    rows = values.to_numpy(zero_copy_only=False).reshape(int(there.sum()), width) + 0.0
    order = np.argsort(rows, axis=1, kind="stable").astype(np.int32)
    if SHORTEST <= width < LONGEST:
        found = np.take_along_axis(rows, order, axis=1)
        equals = (found[:, 1:] == found[:, :-1]) | np.isnan(found[:, :-1])
        for i in np.flatnonzero(equals.any(axis=1)):
            order[i] = grade_up(rows[i])
    ends = np.concatenate([[0], np.cumsum(np.where(there, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(order.ravel()), mask=pa.array(~there))


def with_nulls(values: list) -> list[int]:
    empty = [x is None for x in values]
    if not any(empty):
        return grade_up(values)
    x = np.array([np.nan if x is None else x for x in values], dtype=float)
    return np.lexsort((x, empty)).tolist()
