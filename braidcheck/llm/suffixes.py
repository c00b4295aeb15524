"""Deep-shallow suffix sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

#: Suffixes that agree in so many bytes go from quicksort to a blind trie.
SHALLOW = 96


class _Node:
    """An inner node of a blind trie: where its suffixes part, and the children by the byte there (-1: the end)."""

    __slots__ = ("depth", "children")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.children: dict[int, object] = {}


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix of a and b, which agree up to start."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of the group and common prefix of each with the one before it; all agree up to depth."""
    root: object = [group[0]]
    for i in group[1:]:
        s = strings[i]
        node = root
        while isinstance(node, _Node):  # blind: only the branching bytes are looked at
            node = node.children.get(s[node.depth] if node.depth < len(s) else -1) or next(iter(node.children.values()))
        leaf = strings[node[0]]
        shared = common_prefix(s, leaf, depth)
        if shared == len(s) == len(leaf):
            node.append(i)
            continue
        node, above, way = root, None, -1
        while isinstance(node, _Node) and node.depth < shared:
            above, way = node, s[node.depth] if node.depth < len(s) else -1
            node = node.children[way]
        branch = s[shared] if shared < len(s) else -1
        if isinstance(node, _Node) and node.depth == shared:
            node.children[branch] = [i]
            continue
        new = _Node(shared)
        new.children[leaf[shared] if shared < len(leaf) else -1] = node
        new.children[branch] = [i]
        if above is None:
            root = new
        else:
            above.children[way] = new
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[object, int]] = [(root, 0)]
    while stack:
        node, before = stack.pop()
        if isinstance(node, _Node):
            ways = sorted(node.children)
            for k in range(len(ways) - 1, -1, -1):
                stack.append((node.children[ways[k]], node.depth if k else before))
        else:
            order += node
            lcp += [before] + [len(strings[node[0]])] * (len(node) - 1)
    return order, lcp


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcp): places of the strings in byte order, and the common prefix of each with the one before (first: 0).

    Equal strings stay in the order given. An empty list gives two empty lists.
    """
    order: list[int] = []
    lcp: list[int] = []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)] if strings else []
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            lcp.append(before)
            continue
        if depth >= shallow:
            some, deep = blind_trie(strings, group, depth)
            deep[0] = before
            order += some
            lcp += deep
            continue
        pivot = _byte(strings[group[len(group) // 2]], depth)
        less = [i for i in group if _byte(strings[i], depth) < pivot]
        same = [i for i in group if _byte(strings[i], depth) == pivot]
        more = [i for i in group if _byte(strings[i], depth) > pivot]
        if more:
            stack.append((more, depth, depth))
        if pivot < 0:  # all end here
            head = depth if less else before
            if less:
                raise AssertionError("nothing sorts before the end")
            order += same
            lcp += [head] + [depth] * (len(same) - 1)
        elif less:
            stack.append((same, _skip(strings, same, depth + 1), depth))
            stack.append((less, depth, before))
        else:
            stack.append((same, _skip(strings, same, depth + 1), before))
    return order, lcp


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def _skip(strings: list[bytes], group: list[int], depth: int) -> int:
    """A depth up to which the group agrees: a run of bytes that all share is passed at once."""
    first = strings[group[0]]
    far = len(first)
    for i in group[1:]:
        far = common_prefix(first[:far], strings[i], depth)
        if far <= depth:
            return depth
    return far


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """(depth, first, last) of every inner node of the tree that sorted suffixes span."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for k in range(1, len(lcp) + 1):
        now, start = (lcp[k] if k < len(lcp) else -1), k - 1
        while stack and stack[-1][0] > now:
            depth, start = stack.pop()
            out.append((depth, start, k - 1))
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, start))
    return out
