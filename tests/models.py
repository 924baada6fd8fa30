"""Slow, direct models of the rules and of correlation, for comparison only.

Each works on rows (us, event_id, ...) of one entity in time order and looks at whole
prefixes, straight from the definition of the rule.
"""

from __future__ import annotations


def window_rows(rows, i, width):
    """Rows up to and including the i-th that are no older than `width` before it."""
    return [r for r in rows[: i + 1] if rows[i][0] - r[0] <= width]


def bursts(rows, width, is_hot):
    """Evidence id lists: first hot window, then every directly following hot row."""
    found, open_burst = [], None
    for i in range(len(rows)):
        inside = window_rows(rows, i, width)
        if is_hot(inside):
            if open_burst is None:
                open_burst = [r[1] for r in inside]
                found.append(open_burst)
            else:
                open_burst.append(rows[i][1])
        else:
            open_burst = None
    return [sorted(b) for b in found]


def sequences(rows, width, need):
    """rows: (us, event_id, lead, trail). Evidence id lists of every fire."""
    found, used_until = [], -1
    taken = set()
    for i, (us, event, lead, trail) in enumerate(rows):
        leads = [
            r for j, r in enumerate(rows[:i])
            if j > used_until and r[2] and us - r[0] <= width and r[1] not in taken
        ]
        if trail and len(leads) >= need:
            found.append(sorted([r[1] for r in leads] + [event]))
            used_until = i
            taken.add(event)
    return found


def components(findings, gap, breadth, event_keys):
    """findings: id -> (filing key, evidence event ids, first, last, order). Lists of id sets."""
    others: dict[str, set] = {}
    for _, evidence, *_ in findings.values():
        for e in evidence:
            for k in event_keys[e]:
                others.setdefault(k, set()).update(set(event_keys[e]) - {k})
    ambient = {k for k, o in others.items() if len(o) > breadth}
    by_key: dict[str, list] = {}
    for fid, (filed, evidence, *_rest) in findings.items():
        for k in ({filed} | {k for e in evidence for k in event_keys[e]}) - ambient:
            by_key.setdefault(k, []).append(fid)
    neighbours = {fid: set() for fid in findings}
    for ids in by_key.values():
        ids.sort(key=lambda f: (findings[f][2], findings[f][4]))
        for a, b in zip(ids, ids[1:]):
            if findings[b][2] - findings[a][3] <= gap:
                neighbours[a].add(b)
                neighbours[b].add(a)
    seen, groups = set(), []
    for fid in findings:
        if fid in seen:
            continue
        group, todo = set(), [fid]
        while todo:
            one = todo.pop()
            if one not in group:
                group.add(one)
                todo.extend(neighbours[one])
        seen |= group
        groups.append(group)
    return groups
