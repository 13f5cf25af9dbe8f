"""Plain Python versions of the definitions, for small fixtures."""

import math
from collections import defaultdict


def by_user(rows):
    users = defaultdict(dict)
    for r in rows:
        users[r["user_id"]][r["item_id"]] = (r["rating"], r["ts"])
    return users


def factors(rows, strict=False, alpha=1e-6):
    """{(u, v): (rc, ru, rd, rt, score)} for pairs with a common item."""
    users = by_user(rows)
    mean = {u: sum(r for r, _ in items.values()) / len(items) for u, items in users.items()}
    found = {}
    for u, mine in users.items():
        for v, theirs in users.items():
            common = mine.keys() & theirs.keys()
            if u == v or not common:
                continue
            rd = 0
            for i in common:
                a, b = mine[i][0] - mean[u], theirs[i][0] - mean[v]
                rd += a * b > 0 if strict else (a >= 0 and b >= 0) or (a <= 0 and b <= 0)
            rt = sum(math.exp(-alpha * abs(mine[i][1] - theirs[i][1])) for i in common)
            parts = (len(common), len(theirs) - len(common), rd, rt)
            found[u, v] = (*parts, 1 / (1 + sum(1 / x for x in parts if x)))
    return found


def predict(rows, user, item, scores, k=50):
    users = by_user(rows)
    mean = {u: sum(r for r, _ in items.values()) / len(items) for u, items in users.items()}
    raters = sorted((-scores[user, v], v) for v in users if item in users[v] and (user, v) in scores)[:k]
    den = sum(-s for s, _ in raters)
    value = mean[user] + (sum(-s * (users[v][item][0] - mean[v]) for s, v in raters) / den if den else 0)
    return max(1.0, min(5.0, value))


def dense(rows):
    users = by_user(rows)
    items = sorted({i for v in users.values() for i in v})
    mean = {u: sum(r for r, _ in v.values()) / len(v) for u, v in users.items()}
    return {u: [v[i][0] if i in v else mean[u] for i in items] for u, v in users.items()}


def distance(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
