"""Small fixtures and brute-force counterparts."""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque
from datetime import datetime
from itertools import combinations

EDGE_SCHEMA = "user_id string, product_id string, rating double"
REVIEW_SCHEMA = (
    "review_id string, user_id string, product_id string, rating double, date timestamp, verified_purchase boolean"
)


def ts(text):
    return None if text is None else datetime.fromisoformat(text)


def reviews(spark, rows):
    """rows: (user, product, rating, date or None[, verified])."""
    data = [
        (f"r{i:03}", r[0], r[1], float(r[2]), ts(r[3]), r[4] if len(r) > 4 else True) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, REVIEW_SCHEMA)


def random_edges(seed, users=30, products=12, hot=None):
    """Distinct (user, product, rating); with ``hot`` a third of the users review only that product."""
    rnd = random.Random(seed)
    out = {}
    for u in range(users):
        if hot and u % 3 == 0:
            out[(f"u{u:03}", hot)] = rnd.choice([4.0, 5.0])
            continue
        for p in rnd.sample(range(products), rnd.randint(1, 4)):
            out[(f"u{u:03}", f"p{p:02}")] = float(rnd.randint(1, 5))
        if hot and rnd.random() < 0.5:
            out[(f"u{u:03}", hot)] = float(rnd.randint(1, 5))
    return [(u, p, r) for (u, p), r in sorted(out.items())]


def by_user(edges):
    found = defaultdict(dict)
    for u, p, r in edges:
        found[u][p] = r
    return found


def similar_users(edges, threshold=0.7):
    users, found = by_user(edges), {}
    for a, b in combinations(sorted(users), 2):
        common = users[a].keys() & users[b].keys()
        if common:
            jaccard = len(common) / len(users[a].keys() | users[b].keys())
            agree = sum(1 - abs(users[a][p] - users[b][p]) / 5 for p in common) / len(common)
            if (jaccard + agree) / 2 >= threshold - 1e-12:
                found[(a, b)] = (jaccard + agree) / 2
    return found


def similar_products(edges, threshold=0.7, shared=3):
    products = defaultdict(set)
    for u, p, _ in edges:
        products[p].add(u)
    found = {}
    for a, b in combinations(sorted(products), 2):
        common = products[a] & products[b]
        jaccard = len(common) / len(products[a] | products[b])
        if jaccard >= threshold and len(common) >= shared:
            found[(a, b)] = jaccard
    return found


def groups(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def projection(edges):
    users = by_user(edges)
    near = {u: set() for u in users}
    for a, b in combinations(users, 2):
        if users[a].keys() & users[b].keys():
            near[a].add(b)
            near[b].add(a)
    return near


def clustering(edges):
    near = projection(edges)
    out = {}
    for u, around in near.items():
        links = sum(1 for a, b in combinations(around, 2) if b in near[a])
        d = len(around)
        out[u] = 2 * links / (d * (d - 1)) if d >= 2 else 0.0
    return out


def similarity_stats(edges):
    users, near, out = by_user(edges), projection(edges), {}
    for u, around in near.items():
        sims = [len(users[u].keys() & users[v].keys()) / len(users[u].keys() | users[v].keys()) for v in around]
        out[u] = (sum(sims) / len(sims), max(sims), float(len(sims))) if sims else (0.0, 0.0, 0.0)
    return out


def bipartite(edges):
    graph = defaultdict(set)
    for u, p, _ in edges:
        graph[("user", u)].add(("product", p))
        graph[("product", p)].add(("user", u))
    return graph


def betweenness(edges, pivots=None):
    graph = bipartite(edges)
    n = len(graph)
    score = dict.fromkeys(graph, 0.0)
    sources = list(graph) if pivots is None else pivots
    for s in sources:
        dist, paths, order, before = {s: 0}, defaultdict(float), [], defaultdict(list)
        paths[s] = 1.0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in graph[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    scale = n / len(sources) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {k: v * scale for k, v in score.items()}


def eigenvector(edges, rounds=1000, tolerance=1e-6):
    graph = bipartite(edges)
    x = dict.fromkeys(graph, 1 / len(graph))
    for _ in range(rounds):
        last, x = x, {v: x[v] + sum(x[w] for w in graph[v]) for v in graph}
        norm = math.sqrt(sum(v * v for v in x.values()))
        x = {k: v / norm for k, v in x.items()}
        if sum(abs(x[k] - last[k]) for k in x) < sum(x.values()) * tolerance:
            return x
    return None
