import collections
import re

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text) as a table with columns of other operators' names."""

    def make(rows, **more):
        rows = [(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, kept string"
        )

    return make


@pytest.fixture(scope="session")
def brute_components():
    """(n_shingles, component) of every document, pair by pair."""

    def run(rows, width=5, percent=75):
        sets = {}
        for i, t in rows:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
            w = re.findall(r"[^\x20\x09-\x0D]+", low)
            whole = [tuple(w)] if w else []
            sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset(whole)
        lists = collections.defaultdict(list)
        for i, s in sets.items():
            for x in s:
                lists[x].append(i)
        parent = {i: i for i in sets}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, s in sets.items():
            for j, n in collections.Counter(j for x in s for j in lists[x] if j < i).items():
                if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        return {i: (len(s), find(i)) for i, s in sets.items()}

    return run
