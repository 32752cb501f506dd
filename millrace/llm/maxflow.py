"""Two-label energies by minimum cut."""

from __future__ import annotations

from collections import deque


def _cut(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source side of a minimum cut (Dinic): own[i] > 0 ties i to the source, < 0 to the sink; ties go to the source side."""
    n = len(own)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), cap.append(c)
        out[b].append(len(to)), to.append(a), cap.append(back)

    for i, v in enumerate(own):
        if v > 0:
            add(s, i, v, 0.0)
        elif v < 0:
            add(i, t, -v, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-12
    while True:
        depth = [-1] * (n + 2)
        depth[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, a = [], s
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > tiny and depth[to[e]] == depth[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break
    # what cannot reach the sink is on the source side
    reach = {t}
    queue = deque([t])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            a = to[e]
            if a not in reach and cap[e ^ 1] > tiny:
                reach.add(a)
                queue.append(a)
    return [i not in reach for i in range(n)]


def label(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True labels of the least energy sum(|own| where the label is against its sign) + sum(w where the ends differ).

    Nodes whose own term outweighs all their undecided edges have a certain label and
    are taken out first, which leaves the flow a small graph or none.
    """
    n = len(own)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w)), near[b].append((a, w))
    value, loose = list(own), [sum(w for _, w in x) for x in near]
    done: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if done[i] is not None or abs(value[i]) <= loose[i]:
            continue
        done[i] = value[i] > 0
        for j, w in near[i]:
            if done[j] is None:
                value[j] += w if done[i] else -w
                loose[j] -= w
                queue.append(j)
    rest = [i for i in range(n) if done[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        cut = _cut([value[i] for i in rest], [(place[a], place[b], w) for a, b, w in edges if a in place and b in place])
        for i, side in zip(rest, cut, strict=True):
            done[i] = side
    return [bool(x) for x in done]
