"""Small tables for the operators, and plain Python versions of what they compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, texts, **more):
    """A row per text (id by place), with constant columns ``more``."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in more.items():
        df = df.withColumn(name, value)
    return df


def sentence(seed: int, n: int) -> str:
    """``n`` made-up words, other ones for every seed."""
    return " ".join(f"w{seed}x{i}" for i in range(n))


def shingle_set(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    w = words(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """(set size, least id reachable) by id."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    meet = defaultdict(list)
    for i, s in sets.items():
        for gram in s:
            meet[gram].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for gram in s for j in meet[gram] if j > i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}
