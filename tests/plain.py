"""Plain-Python restatements of the operators, for small inputs."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import timedelta


def histories(rows, days=None):
    """Sorted (ts, event) lists per user inside the look-back."""
    newest = max(ts for _, _, ts in rows)
    by_user = defaultdict(list)
    for user, event, ts in rows:
        if days is None or ts >= newest - timedelta(days=days):
            by_user[user].append((ts, event))
    return {user: sorted(items) for user, items in by_user.items()}


def reach(rows, users, steps, days, window_days):
    result = {}
    for user, items in histories(rows, days).items():
        level, first, last = 0, None, None
        for ts, event in items:
            if level == len(steps) or event != steps[level]:
                continue
            if level == 0:
                level, first, last = 1, ts, ts
            elif last < ts <= first + timedelta(days=window_days):
                level, last = level + 1, ts
        if level and user in users:
            result[user] = level
    return result


def squeeze(items):
    events = [event for _, event in items]
    return [e for i, e in enumerate(events) if i == 0 or events[i - 1] != e]


def journey(events, start, end):
    """(completed, events) or None without a start."""
    if start not in events:
        return None
    tail = events[events.index(start) :]
    if end not in tail:
        return False, tail
    head = tail[: tail.index(end) + 1]
    last = max(i for i, e in enumerate(head) if e == start)
    return True, head[last:]


def journeys(rows, start, end, days=None):
    found = {u: journey(squeeze(items), start, end) for u, items in histories(rows, days).items()}
    return {u: j for u, j in found.items() if j}


def path_counts(found):
    counts = Counter(" -> ".join(events) for done, events in found.values() if done)
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))


def matched(events, path):
    """How many steps of the path occur in order."""
    count = 0
    for event in events:
        if count < len(path) and event == path[count]:
            count += 1
    return count


def journey_nodes(found):
    canonical = [path.split(" -> ") for path, _ in path_counts(found)[:5]]
    if not canonical:
        return {}
    nodes = Counter()
    for _, events in found.values():
        lengths = [matched(events, path) for path in canonical]
        best = lengths.index(max(lengths))
        for step in range(lengths[best]):
            nodes[step, canonical[best][step]] += 1
    return {key: (n, round(n / len(found), 4)) for key, n in nodes.items()}


def breakdown(reached, users, properties, n, skip=(), most=8):
    """(property, value) -> (conversion, lift, users, impact); users: id -> {property: value}."""
    if not reached:
        return {}
    base = round(sum(r >= n for r in reached.values()) / len(reached), 4)
    least = max(50, -(-len(reached) // 100))
    entries = {}
    for prop in properties:
        if prop in skip:
            continue
        groups = defaultdict(list)
        for user, r in reached.items():
            if users[user][prop] is not None:
                groups[users[user][prop]].append(r)
        largest = sorted(groups.items(), key=lambda kv: (-len(kv[1]), kv[0]))[:most]
        for value, rs in largest:
            if len(rs) < least:
                continue
            conversion = round(sum(r >= n for r in rs) / len(rs), 4)
            lift = round(conversion - base, 4)
            entries[prop, value] = (conversion, lift, len(rs), round(len(rs) * abs(lift), 1))
    return entries


def drilldown(rows, users, steps, properties, days, window, max_depth):
    """Nodes by filters, running each cohort's funnel and breakdown by itself."""
    full = reach(rows, users, steps, days, window)
    pairs = [reach(rows, users, steps[k : k + 2], days, window) for k in range(len(steps) - 1)]
    nodes = {}
    level = {(): None}
    for depth in range(max_depth + 1):
        following = {}
        for filters in sorted(level):
            inside = {u for u in users if all(users[u][p] == v for p, v in filters)}
            at = [sum(full.get(u, 0) >= k for u in inside) for k in range(1, len(steps) + 1)]
            losses = [a - b for a, b in zip(at, at[1:], strict=False)]
            worst = losses.index(max(losses))
            blockers = []
            if at[0] and depth < max_depth and losses[worst] >= 200:
                cohort = {u: r for u, r in pairs[worst].items() if u in inside}
                found = breakdown(cohort, users, properties, 2, skip=dict(filters))
                worse = sorted((-e[3], key) for key, e in found.items() if e[1] < 0)[:3]
                blockers = [key for _, key in worse]
                for key in blockers:
                    if found[key][2] >= max(200, int(losses[worst] * 0.1)):
                        following.setdefault(tuple(sorted((*filters, key))), filters)
            nodes[filters] = (depth, at, worst + 1, losses[worst], blockers)
        level = following
        if not level:
            break
    return nodes
