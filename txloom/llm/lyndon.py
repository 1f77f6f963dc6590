"""Linear suffix sorting by grouping Lyndon prefixes.

Suffixes are kept in groups that share a prefix.  Groups are taken in descending
order; each member finds the nearest suffix to its left that lies in a lower group
(previous-smaller pointers, already known ones are skipped over), and the suffixes
so found leave their group for a higher one, ordered by how many members point to
them.  At the end a group holds the suffixes with the same longest Lyndon prefix.
A second pass in ascending order emits every group's order from the pointers; no
rank is ever renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_order(text: list[int]) -> list[int]:
    """Start positions of the sorted suffixes of ``text``, whose last symbol must be its unique smallest."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # groups by first symbol, each contiguous
    place = [0] * n  # where a suffix stands in order
    group = [0] * n  # index in order where its group begins
    size = [0] * n  # size of the group that begins at an index
    start, seen = 0, None
    for i, s in enumerate(order):
        if text[s] != seen:
            start, seen = i, text[s]
        place[s], group[s] = i, start
        size[start] += 1
    before = [-1] * n

    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            s = order[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:  # p leaves for the end of its group
                g = group[p]
                rest = size[g] - 1
                if rest:
                    i, last = place[p], g + rest
                    q = order[last]
                    order[i], order[last] = q, p
                    place[q], place[p] = i, last
                    group[p], size[g], size[last] = last, rest, 1
        else:
            counts: dict[int, int] = {}
            for s in sorted(order[start:end]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            if counts:
                by_count: dict[int, list[int]] = {}
                for p, c in counts.items():
                    by_count.setdefault(c, []).append(p)
                for c in sorted(by_count, reverse=True):
                    moved: dict[int, int] = {}
                    for p in by_count[c]:
                        g = group[p]
                        k = moved[g] = moved.get(g, 0) + 1
                        i, last = place[p], g + size[g] - k
                        q = order[last]
                        order[i], order[last] = q, p
                        place[q], place[p] = i, last
                    begins = {}
                    for g, k in moved.items():
                        size[g] -= k
                        begins[g] = g + size[g]
                        size[begins[g]] = k
                    for p in by_count[c]:
                        group[p] = begins[group[p]]
        end = start

    slot = list(range(n))
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    slot[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[slot[g]] = s
            slot[g] += 1
            placed[s] = 1
            s = before[s]
    return out
