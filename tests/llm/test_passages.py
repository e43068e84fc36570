import hashlib

import numpy as np
import pytest
import zstandard

passages = pytest.importorskip("tessera.llm.repeated_passages")


def plain(rows: list[tuple[int | None, str | None]], length: int = 50) -> list[tuple]:
    """The definition, byte by byte."""
    first: dict[bytes, int] = {}
    for k, text in sorted(((k, t or "") for k, t in rows if k is not None), key=lambda r: r[0]):
        b = text.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], k)
    out = []
    for k, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1 if k is not None else 0):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows: list[tuple[int | None, str | None]]) -> None:
    got = passages.remove(spark, spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, bucket string, mark int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(plain(rows), key=key)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé漢"), 4)) for _ in range(40)]
    prose = lambda n: " ".join(rng.choice(words, n))
    shared, other = prose(60), prose(60)
    edge = prose(30)[:50]
    check(spark, [
        (1, shared), (2, "x" + shared + "y" + other), (3, other + shared), (4, shared[5:70]), (5, None), (6, ""), (7, shared), (7, shared), (7, shared + "!"),
        (None, shared), (None, None), (8, "z" * 120), (9, "z" * 60), (10, "z" * 49), (11, edge), (12, "q" + edge), (13, edge[:-1]), (-1, prose(5) + shared[100:160]), (14, prose(9000)), (15, prose(50) + other * 3),
    ])


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["".join(rng.choice(list("ab"), int(rng.integers(1, 90)))) for _ in range(6)]
    rows = []
    for k in range(60):
        part = pool[int(rng.integers(6))]
        text = part * int(rng.integers(1, 8)) if rng.random() < 0.5 else "".join(pool[int(i)] for i in rng.integers(0, 6, int(rng.integers(1, 6))))
        rows.append((int(rng.integers(0, 50)), text[int(rng.integers(0, 5)) :]))
    check(spark, rows)


def test_empty_table(spark):
    assert passages.remove(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        passages.remove(spark, spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_blocks_of_a_bucket(spark, monkeypatch):
    """A bucket sorted in many blocks keeps what a bucket sorted whole keeps."""
    rng = np.random.default_rng(9)
    text = np.frombuffer("".join(rng.choice(list("ab"), 700)).encode(), np.uint8)
    pieces = [(int(k), int(a), int(n)) for k, a, n in zip(rng.integers(0, 9, 60), rng.integers(0, 500, 60), rng.integers(1, 100, 60), strict=True)]

    def lost(step: int) -> set[tuple[int, int]]:
        held, out = passages.Bucket(50), set()
        for i, (k, a, n) in enumerate(pieces):
            held.add(np.array([k]), np.array([0], np.int32), np.array([a]), np.array([n]), text[a : a + n + 49].copy())
            if i % step == step - 1 or i == len(pieces) - 1:
                for doc, _, start, count in zip(*held.sort(), strict=True):
                    out |= {(int(doc), int(start + j)) for j in range(count)}
        return out

    assert lost(1) == lost(7) == lost(60)


@pytest.mark.parametrize("length", [5, 24, 25, 50])
def test_groups_are_in_order_of_bytes(length):
    rng = np.random.default_rng(length)
    for letters in (1, 2, 3):
        text = rng.integers(97, 97 + letters, 400).astype(np.uint8)
        at = rng.permutation(len(text) - length + 1)[:200]
        strings = [text[a : a + length].tobytes() for a in at]
        number = {s: i for i, s in enumerate(sorted(set(strings)))}
        assert passages.suffix_groups(text, at, length).tolist() == [number[s] for s in strings]


def test_rows_are_dealt_for_many_slices_together(monkeypatch):
    """Rows sent to buckets grow with the input, not with its slices times its buckets."""
    rng = np.random.default_rng(3)
    part = lambda k: (False, (np.arange(50) + 0, np.full(50, k), np.zeros(50, np.int64), np.arange(50), np.ones(50, np.int64), rng.integers(97, 123, 50 * 50).astype(np.uint8), np.full(50, 50)))
    parts = [part(k) for k in range(40)]
    got = list(passages._dealt(iter(parts)))
    assert sum(b.num_rows for b in got) == 50  # not 40 * 50
    monkeypatch.setattr(passages, "SLICE", 300)  # text is packed in stretches
    small = list(passages._dealt(iter(parts)))
    assert [b.to_pylist() for b in small] == [b.to_pylist() for b in got]
    text = zstandard.ZstdDecompressor().decompress(got[0].column("text")[7].as_py())
    assert text == b"".join(p[5][7 * 50 : 8 * 50].tobytes() for _, p in parts)
    monkeypatch.setattr(passages, "TEXT", 5000)
    assert sum(b.num_rows for b in passages._dealt(iter(parts))) == 20 * 50
