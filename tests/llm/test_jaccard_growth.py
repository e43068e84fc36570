"""The Jaccard join over a growing group of near copies whose similarities lie on both sides of the threshold."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")
from tessera.llm import common, jaccard_join  # noqa: E402
from tessera.llm.components import components, merged  # noqa: E402


def near_copies(n: int) -> list[tuple[int, str]]:
    rng = np.random.default_rng(11)
    base, rows = [f"word{i}" for i in rng.permutation(150)], []
    for i in range(n):
        words = list(base)
        for at in rng.choice(len(words), 2 + i % 3, replace=False):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def brute_force(rows: list[tuple[int, str]]) -> set[tuple[int, int, int]]:
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text.split() for _, text in rows)]
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}


def joined(spark, monkeypatch, n: int) -> int:
    """The rows that tests of pairs and components write for n near copies, once the result is found right."""
    rows, written = near_copies(n), Counter()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()

    def cut(spark, df, name, cut=common.cut):
        out = cut(spark, df, name)
        written[name] += out.count()
        return out

    with monkeypatch.context() as m:
        m.setattr(common, "cut", cut)
        got = {tuple(r) for r in jaccard_join.join(spark, docs).collect()}
    want = brute_force(rows)
    assert got == want
    assert 10 < len({r for *_, r in want}) < n / 2  # one large component and sets that link with none of it
    print(n, dict(written))
    return sum(v for k, v in written.items() if k not in ("profile", "sets", "members", "owned"))


def test_rows_grow_with_the_group_not_with_its_square(spark, monkeypatch):
    small, large = (joined(spark, monkeypatch, n) for n in (200, 400))
    assert large < 2.8 * small


def test_components_of_new_links_alone(spark):
    old = components(spark, spark.createDataFrame([(1, 5), (2, 6), (6, 7), (8, 9)], "a long, b long"))
    new = components(spark, spark.createDataFrame([(1, 2), (2, 10), (11, 12)], "a long, b long"))
    got = {tuple(r) for r in merged(old, new).collect()}
    assert got == {(1, 1), (5, 1), (2, 1), (6, 1), (7, 1), (10, 1), (8, 8), (9, 8), (11, 11), (12, 11)}
