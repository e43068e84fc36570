"""The operators against plain Python over a small corpus with nulls, repeated rows, ties, copies and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm.queries")
from tessera.llm import decontamination, jaccard_join, line_dedup, main_text, mixing, quality, queries, toxicity  # noqa: E402

DOC = "doc_id long, text string, source string, lang string, bits string, part int, tied int, own string, kept_text string, key string, row_key long, root long, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = "river stone bridge winter market garden letter window doctor village silver morning captain forest harbour question evening teacher island history".split()


def prose(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"{rng.choice(VOCABULARY)}{rng.integers(60)}" for _ in range(n)]


def edited(words: list[str], seed: int, n: int) -> str:
    rng, out = np.random.default_rng(seed), list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"edit{seed}"
    return " ".join(out)


ITEMS = [(1, " ".join(prose(500, 30))), (2, " ".join(prose(501, 4))), (3, None), (3, ""), (4, " ".join(prose(1, 200)[50:80]).upper() + "!")]


def corpus() -> list[tuple]:
    base, other = prose(1, 200), prose(2, 120)
    texts: list[tuple] = [(10, " ".join(base)), (11, " ".join(base)), (12, edited(base, 3, 4)), (13, edited(base, 4, 9)), (None, edited(base, 5, 5)), (None, " ".join(other)), (14, edited(other, 6, 3)), (None, " ".join(other))]
    texts += [(15, None), (16, ""), (17, " \n\t"), (18, "one two"), (18, "one two"), (19, "One\tTWO"), (20, "one two three"), (21, "é ü 漢字 " * 30)]
    texts += [(22, "a b c d\na b c x\na b c d\nsolo\nduo\nlonger line of five words\nlonger line of six good words\n\n#### $$$$"), (23, "A B  c d\nduo\nsolo line"), (24, " ".join(prose(7, 40)) + " " + ITEMS[0][1] + " " + " ".join(prose(8, 40)))]
    texts += [(25, ITEMS[1][1] + "."), (26, " ".join(prose(9, 9000))), (27, ("tick tock boom " * 40).strip()), (-3, " ".join(prose(11, 60)))]
    texts += [(100 + k, " ".join(prose(200 + k, 20 + 3 * k))) for k in range(24)]
    return [(i, t, [None, "web", "books", "é"][k % 4], "en", "b", 1, 2, "o", "k", "y", 3, 4, 5) for k, (i, t) in enumerate(texts)]


ROWS = [(r[0], r[1], r[2]) for r in corpus()]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("values") / "documents.parquet")
    spark.createDataFrame(corpus(), DOC).write.parquet(at)
    return spark.read.parquet(at)


def known(x):
    return (x is None, x if x is not None else 0)


def by_rows(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(known(x) if not isinstance(x, (list, dict)) else str(x) for x in r))


# --- shingles ---------------------------------------------------------------------------------------------------


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows: list[tuple]) -> list[int]:
    """For each row the index of its group; -1 without words."""
    sets = [shingles(WORD.findall((t or "").translate(LOWER))) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    return [find(i) if sets[i] else -1 for i in range(len(rows))]


def test_jaccard_join(spark, docs):
    of, want = groups(ROWS), []
    for (i, t, _), g in zip(ROWS, of, strict=True):
        ids = [r[0] for r, h in zip(ROWS, of, strict=True) if h == g and r[0] is not None]
        want.append((i, len(shingles(WORD.findall((t or "").translate(LOWER)))), (min(ids) if ids else None) if g >= 0 else i))
    assert by_rows(jaccard_join.join(spark, docs).collect()) == by_rows(want)


def test_tiles_against_plain_pairs():
    import pyarrow as pa

    rng, rows = np.random.default_rng(0), []
    for g in range(120):
        key = int(rng.integers(-50, 50))
        base = rng.integers(0, 2**63, int(rng.integers(8, 60))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 12))):
            s = np.unique(np.where(rng.random(len(base)) < 0.15, rng.integers(0, 2**63, len(base)).astype(np.uint64), base))
            keys = sorted({int(x) for x in rng.integers(-50, 50, 3)} | {key})
            rows.append((key, g, 0, len(rows), len(s), int(rng.integers(0, 4)), bool(rng.random() < 0.7), int(rng.integers(0, 3)), jaccard_join.bitmap(s), keys))
    rows.sort(key=lambda r: r[:3])
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    names = ["key", "band", "tile", "set_id", "n", "root", "low", "side", "bits", "keys"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    parts = [batch.slice(i, 17) for i in range(0, batch.num_rows, 17)]
    got = {(a, b) for out in jaccard_join._tile(iter(parts)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    want = set()
    for i, r in enumerate(rows):
        for q in rows[i + 1 :]:
            one_key = r[:3] == q[:3] and min(set(r[9]) & set(q[9])) == r[0]
            if one_key and r[5] != q[5] and (r[6] or q[6]) and (r[7] == 0 or r[7] != q[7]) and 4 * r[4] >= 3 * q[4] and 4 * q[4] >= 3 * r[4]:
                bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in (r[8], q[8])]
                width = min(map(len, bits))
                a, b = (x.reshape(-1, width).any(axis=0) for x in bits)
                if 7 * min(r[4] - (a & ~b).sum(), q[4] - (b & ~a).sum()) >= 3 * (r[4] + q[4]):
                    want.add((min(r[3], q[3]), max(r[3], q[3])))
    assert want <= got and len(want) > 50  # tiles fold bitmaps further, which only lets more pairs through


def first_of_groups(rows: list[tuple]) -> list[tuple]:
    of = groups(rows)
    best: dict[int, tuple] = {}
    for r, g in zip(rows, of, strict=True):
        if g >= 0 and (g not in best or known(r[0]) < known(best[g][0])):
            best[g] = r
    return [r for r, g in zip(rows, of, strict=True) if g < 0] + list(best.values())


def test_one_of_each_group_stays(spark, docs):
    got = jaccard_join.keep_first(spark, docs)
    assert got.columns == docs.columns
    rows = got.select("doc_id", "text").collect()
    assert sorted((known(r.doc_id) for r in rows)) == sorted(known(r[0]) for r in first_of_groups(ROWS))
    assert {(r.doc_id, r.text) for r in rows} <= {(r[0], r[1]) for r in ROWS}


# --- decontamination --------------------------------------------------------------------------------------------


def marks(text: str | None) -> set[tuple]:
    return shingles(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))


def held(text: str | None) -> dict[int, tuple[int, int]]:
    own, out = marks(text), {}
    for item, t in ITEMS:
        m = marks(t)
        if m and 4 * len(own & m) >= 3 * len(m):
            out[item] = (len(m), len(own & m))
    return out


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    want = [(i, item, n, c, c / n) for i, t in {(r[0], r[1]) for r in ROWS} for item, (n, c) in held(t).items()]
    best: dict = {}
    for w in want:
        best[w[:2]] = max(best.get(w[:2], w), w, key=lambda x: x[4])
    assert by_rows(decontamination.search(spark, docs, items).collect()) == by_rows(best.values())


# --- mixing -----------------------------------------------------------------------------------------------------


def draw(doc_id: int | None, text: str | None) -> int:
    own = hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"mix-1:{'' if doc_id is None else doc_id}:{own}".encode()).hexdigest()[:12], 16)


def mixed(rows: list[tuple]) -> list[tuple]:
    """(doc_id, size, source_size, target, taken, times) of each row, in its order."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    total = Counter()
    for r, s in zip(rows, size, strict=True):
        total[r[2]] += s
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    level, under = 0.0, set()
    while True:
        free = sum(weight[s] for s in names if s not in under)
        if not free:
            break
        level = (1.5 * sum(size) - sum(2 * total[s] for s in under)) / free
        now = {s for s in names if 2 * total[s] < level * weight[s]}
        if now == under:
            break
        under = now
    target = {s: float(min(2 * total[s], level * weight[s])) for s in names}
    times = [0] * len(rows)
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        goal, upto = target[s] - whole * total[s], 0
        mine = [k for k, r in enumerate(rows) if r[2] == s]
        for k in sorted(mine, key=lambda k: (draw(*rows[k][:2]), rows[k][0] is not None, rows[k][0] or 0, size[k])):
            upto += size[k]
            times[k] = whole + (upto - size[k] / 2 < goal and total[s] > 0)
    return [(r[0], n, total[r[2]], target[r[2]], n * t, t) for r, n, t in zip(rows, size, times, strict=True)]


def test_mixing(spark, docs):
    want, got = mixed(ROWS), mixing.mix(spark, docs).collect()
    assert by_rows((*r[:3], round(r[3], 6), *r[4:]) for r in got) == by_rows((*r[:3], round(r[3], 6), *r[4:]) for r in want)
    taken, target = Counter(), {}
    for r, (_, _, s) in zip(want, ROWS, strict=True):
        taken[s] += r[4]
        target[s] = r[3]
    assert all(abs(taken[s] - target[s]) <= max(len(WORD.findall(t or "")) for _, t, x in ROWS if x == s) / 2 + 1 for s in target)
    assert sorted(Counter(known(r.doc_id) for r in mixing.repeat(spark, docs).collect()).items()) == sorted(sum((Counter({known(r[0]): r[5]}) for r in want if r[5]), Counter()).items())


# --- lines ------------------------------------------------------------------------------------------------------


def near(a: tuple, b: tuple) -> bool:
    if max(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark, docs):
    texts = sorted({(r[0], r[1] or "") for r in ROWS if r[0] is not None and r[0] not in (18,)}, key=lambda r: r[0])
    some = docs.filter("doc_id IS NOT NULL AND doc_id <> 18")
    first: dict[tuple, tuple] = {}
    for i, t in texts:
        for k, line in enumerate(t.split("\n")):
            first.setdefault(tuple(w.lower() for w in WORD.findall(line)), (i, k))
    lines = [w for w in first if w]
    lost = {w for w in lines if any(first[v] < first[w] and near(v, w) for v in lines)}
    want = []
    for i, t in texts:
        parts = [(k, line, tuple(w.lower() for w in WORD.findall(line))) for k, line in enumerate(t.split("\n"))]
        equal = [bool(w) and first[w] != (i, k) for k, _, w in parts]
        gone = [e or w in lost for e, (_, _, w) in zip(equal, parts, strict=True)]
        want.append((i, len(parts), sum(equal), sum(gone) - sum(equal), "\n".join(x for g, (_, x, _) in zip(gone, parts, strict=True) if not g)))
    assert by_rows(line_dedup.dedup(spark, some).collect()) == by_rows(want)


def test_unrelated_short_lines_stay(spark):
    rows = [(1, "solo\nduo\nles.\nand ornd.\nand xyz.\nthree word line\nthree word rhyme"), (2, "un.\nxyz.\nfour words in here\nfour words in there")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "un.\nxyz.\nfour words in here"}


# --- quality ----------------------------------------------------------------------------------------------------


def test_quality_counts(spark, docs):
    want = []
    for i, t, _ in ROWS:
        w, text = WORD.findall(t or ""), t or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed))
    got = quality.judge(spark, docs).collect()
    assert by_rows((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == by_rows(want)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)


# --- toxicity ---------------------------------------------------------------------------------------------------


def plain_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """By the definition: the segment of greatest score, shortest and first of equals, then the same left and right of it."""
    if not (score > 0).any():
        return []
    best = max((round(float(score[a:b].sum()), 9), a - b, -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1))
    a = -best[2]
    b = a - best[1]
    left, right = plain_segments(score[:a]), plain_segments(score[b:])
    return [*left, (a, b, float(score[a:b].sum())), *((x + b, y + b, s) for x, y, s in right)]


def test_segments_against_the_definition():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, *rng.integers(1, 40, 200)]:
        score = np.round(rng.normal(-0.3, 1.0, int(n)), 3)
        got = toxicity.segments(score)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(score)]
        assert np.allclose([s for *_, s in got], [s for *_, s in plain_segments(score)])


def test_toxicity_finds_the_passage(spark):
    rng = np.random.default_rng(3)
    calm = lambda n: " ".join(rng.choice(VOCABULARY, n))
    rude = lambda n: " ".join(rng.choice(["vile", "scum", "rotten", "filth", "hateful"], n))
    rows = [(k, calm(60) + (" " + rude(12) + " " + calm(20) if k % 3 == 0 else "")) for k in range(300)] + [(900, None), (901, ""), (902, "123 !"), (903, calm(3000) + " " + rude(12))]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)] + [(None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, t, k % 2, 5) for k, t in rows], "doc_id long, text string, toxic int, score int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(spark, docs, labels), tuple(docs.columns)).collect()}
    text = dict(rows)
    assert all(got[k].predicted == int(k % 3 == 0) for k in range(300)) and got[903].predicted == 1
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in text) and all(got[k].kept_text == text[k] for k in text)
    assert [got[k].score for k in (900, 901, 902)] == [0, 0, 0] and not got[900].passages
    for k in (0, 903):
        found = " ".join(text[k].encode()[p.start : p.end].decode() for p in got[k].passages)
        assert set(found.split()) == {"vile", "scum", "rotten", "filth", "hateful"} & set(text[k].split())
    assert all(not got[k].passages for k in range(300) if k % 3)


# --- main text --------------------------------------------------------------------------------------------------

MENU = '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer class="footer"><p>&copy; 2024 Example Ltd. All rights reserved.</p></footer>'
TALK = '<section class="comments"><h2>Comments</h2><div class="comment"><p>I could not agree more with this piece.</p></div><div class="comment"><p>Reply: nor could I.</p></div></section>'
BAR = '<aside class="sidebar"><h3>Related</h3><p><a href="/x">Ten bridges that you should see</a></p></aside>'
ONE = "The committee met on Tuesday to review the plan. It will meet again in March."
TWO = "Members asked for more time, and the chair agreed to wait until the report is out."
#: Pages and the lines that their articles have.
PAGES = [
    (f"<body><article><p>{ONE}</p></article></body>", [ONE]),
    (f"<body>{MENU}<article><p>{ONE}</p></article>{FOOT}</body>", [ONE]),
    (f"<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><table><tr><td>June</td><td>120</td></tr><tr><td>July</td><td>98</td></tr></table><p>{TWO}</p></article>{FOOT}</body>", ["The plan", ONE, "June", "120", "July", "98", TWO]),
    (f"<body>{MENU}<main><h1>The plan</h1><p>{ONE}</p><figure><img src=a><figcaption>The hall on Tuesday evening.</figcaption></figure><p>{TWO}</p></main>{BAR}{TALK}{FOOT}</body>", ["The plan", ONE, "The hall on Tuesday evening.", TWO]),
    (f'<body><div id="top">{MENU}</div><div class="content"><h2>The plan</h2><p>{ONE}</p><ul><li>more time</li><li>a new report</li></ul><p>{TWO}</p></div>{TALK}{FOOT}</body>', ["The plan", ONE, "more time", "a new report", TWO]),
    (f"<article><h1>Areas</h1><p>The area <math><mi>A</mi><mo>=</mo><mi>x</mi></math> grows with the side, and so on.</p><p>{TWO}</p></article>", ["Areas", "The area A=x grows with the side, and so on.", TWO]),
    (f'<body><div class="cookie-banner"><p>We use cookies to improve the site.</p><button>Accept</button></div>{MENU}<article><h1>The plan</h1><p>{ONE}</p><div class="ad">Buy new shoes today, half price</div><p>{TWO}</p><blockquote>{ONE}</blockquote></article>{BAR}{FOOT}</body>', ["The plan", ONE, TWO, ONE]),
    (f"<body>{MENU}<article><h1>Terms</h1><dl><dt>plan</dt><dd>what the committee reviews</dd></dl><p>{TWO} &amp; more&hellip;</p></article><form class='search'><input><button>Search</button></form>{FOOT}</body>", ["Terms", "plan", "what the committee reviews", TWO + " & more…"]),
    # Text right in its shell, in lines, and pages with hardly any markup.
    (f"<body>{MENU}<article>{ONE}<br><br>{TWO}</article>{FOOT}</body>", [f"{ONE} {TWO}"]),
    (f'<body>{MENU}<div class=content>{ONE}<br>{TWO}</div>{FOOT}</body>', [f"{ONE} {TWO}"]),
    (f"<html><body><article>{ONE}<br/><br/>{TWO}<br/>{ONE}</article></body></html>", [f"{ONE} {TWO} {ONE}"]),
    (f"<body>{MENU}<main><h1>The plan</h1>{ONE}<h2>Time</h2>{TWO}</main>{BAR}{FOOT}</body>", ["The plan", ONE, "Time", TWO]),
    (f'<body>{MENU}<div id="story">{ONE}<blockquote>{TWO}</blockquote>{ONE}</div>{TALK}{FOOT}</body>', [ONE, TWO, ONE]),
    (f"{ONE} {TWO}", [f"{ONE} {TWO}"]), (ONE, [ONE]), (f"<p>{ONE}</p><p>{TWO}</p>", [ONE, TWO]), (f"{ONE}\n\n{TWO}", [f"{ONE} {TWO}"]),
    (f"<html><body>{ONE}<br>{TWO}</body></html>", [f"{ONE} {TWO}"]),
    # What does not belong inside an article.
    (f"<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><aside class=notice><p>This story was updated on Friday.</p></aside><p>{TWO}</p></article>{FOOT}</body>", ["The plan", ONE, TWO]),
    (f'<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><div class="newsletter"><p>Get the best stories in your inbox each week.</p></div><p>{TWO}</p></article>{FOOT}</body>', ["The plan", ONE, TWO]),
    (f"<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><div>Advertisement</div><div>Save on garden chairs and tables until Sunday.</div><p>{TWO}</p><p>{ONE}</p></article>{FOOT}</body>", ["The plan", ONE, TWO, ONE]),
    (f"<body>{MENU}<article><p>{ONE}</p><p>ADVERTISEMENT</p><p>Fly to the sea for less with Blue Wings.</p><p>{TWO}</p></article>{FOOT}</body>", [ONE, TWO]),
    (f"<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><form class=subscribe><p>Your email</p><input><button>Send</button></form><p>{TWO}</p></article>{FOOT}</body>", ["The plan", ONE, TWO]),
    (f"<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><p>{TWO}</p>{TALK}</article>{FOOT}</body>", ["The plan", ONE, TWO]),
    (f"<body>{MENU}<article><h1>The plan</h1><p>{ONE}</p><nav><ul><li><a href=#a>One</a></li><li><a href=#b>Two</a></li></ul></nav><p>{TWO}</p></article>{FOOT}</body>", ["The plan", ONE, TWO]),
    (f'<body><article><h1>The plan</h1><div class="social"><a href=#>Share</a> <a href=#>Post</a></div><p>{ONE}</p><p>{TWO}</p></article></body>', ["The plan", ONE, TWO]),
    (f'<body>{MENU}<div class="post"><h1>The plan</h1><p>{ONE}</p><div class="promo"><p>Read our guide to the best walks.</p></div><p>{TWO}</p></div>{BAR}{FOOT}</body>', ["The plan", ONE, TWO]),
    # Unseen elements inside a sentence leave it whole.
    ("<article><p>The vote <svg viewBox='0 0 1 1'><path d='M0'/><title>icon</title></svg> was close. More is to come on Monday.</p></article>", ["The vote was close. More is to come on Monday."]),
    ("<article><p>The code is a7 <button>Copy</button> and it opens the door to the hall.</p></article>", ["The code is a7 and it opens the door to the hall."]),
    ("<article><p>The hall <noscript><div>no picture</div></noscript> was full when <script>x()</script>the chair spoke.</p></article>", ["The hall was full when the chair spoke."]),
    (f"<body>{MENU}<article><div>{ONE} <select><option>a</option></select> {TWO}</div></article>{FOOT}</body>", [f"{ONE} {TWO}"]),
    (f"<article><p>{ONE}<svg><p>{TWO}</p></svg></p></article>", [ONE]),
    # Other layouts.
    (f'<body><header><h1>Daily Page</h1></header>{MENU}<div class="wrapper"><div class="entry"><h2>The plan</h2><p>{ONE}</p><pre>a = 1</pre><p>{TWO}</p></div>{BAR}</div>{FOOT}</body>', ["The plan", ONE, "a = 1", TWO]),
    (f"<body>{MENU}<section id=article><p><b>{ONE}</b></p><p><em>{TWO}</em></p></section>{TALK}</body>", [ONE, TWO]),
    (f'<body><div class="breadcrumb"><a href=/>Home</a> &gt; <a href=/n>News</a></div><article><h1>&Uuml;ber den Plan</h1><p>{ONE}</p><ol><li>first of all</li><li>last of all</li></ol></article>{FOOT}</body>', ["Über den Plan", ONE, "first of all", "last of all"]),
    (f'<body>{MENU}<div class="container"><main><article><h1>The plan</h1><p>{ONE}</p><h3>Time</h3><p>{TWO}</p></article></main><aside><p>Popular now</p><ul><li><a href=/y>How to mend a roof</a></li></ul></aside></div>{FOOT}</body>', ["The plan", ONE, "Time", TWO]),
    (f"<body>{MENU}<article><h1>计划</h1><p>委员会星期二开会讨论了计划。三月将再次开会。</p><p>成员要求更多时间，主席同意等待。</p></article>{FOOT}</body>", ["计划", "委员会星期二开会讨论了计划。三月将再次开会。", "成员要求更多时间，主席同意等待。"]),
    (f'<body>{MENU}<article><p>{ONE}</p><p hidden>{TWO}</p><p style="display: none">{TWO}</p></article>{FOOT}</body>', [ONE]),
    ("", []), (None, []), ("<script>x</script><style>p {}</style><!-- <p>no</p> -->", []),
]


def test_main_text_of_hand_made_pages(spark):
    sample = "/root/testdata/sf0.01/pages.parquet"
    rows = spark.createDataFrame([(k, f"u{k}", h, "t", 1) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    field = main_text.fit(spark, spark.read.parquet(sample)) if __import__("os").path.isdir(sample) or __import__("os").path.isfile(sample) else main_text.fit(spark, rows)
    hit = found = wanted = 0
    for r in main_text.extract(spark, rows, field).collect():
        assert r.n_chars == len(r.text)
        got, want = Counter(r.text.split("\n") if r.text else []), Counter(PAGES[r.page_id][1])
        hit, found, wanted = hit + sum((got & want).values()), found + sum(got.values()), wanted + sum(want.values())
    f1 = 2 * hit / (found + wanted)
    print(f"blocks: {hit} right of {found} found and {wanted} wanted, F1 {f1:.3f}")
    assert f1 >= 0.95


def test_no_page_with_an_article_is_empty(spark):
    rows = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in main_text.extract(spark, rows).collect()}
    assert all(texts[k] for k, (_, want) in enumerate(PAGES) if want) and not any(texts[k] for k, (_, want) in enumerate(PAGES) if not want)


def chains(rng, n: int, most: int) -> list[tuple]:
    return [([([int(x) for x in rng.integers(0, 1 << main_text.BITS, 2)], [int(x) for x in rng.integers(0, 9, 3)]) for _ in range(k)], [int(x) for x in rng.integers(0, 2, k)]) for k in rng.integers(1, most + 1, n)]


def drawn_field(rng) -> main_text.Field:
    field = main_text.Field()
    field.unary, field.step = rng.normal(0, 1, field.unary.shape), rng.normal(0, 1, (2, 2))
    return field


def score_of(field: main_text.Field, slots: list[list[int]], states: tuple) -> float:
    return sum(field.unary[s, y].sum() for s, y in zip(slots, states, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(states))


def test_decode_takes_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    for feats, _ in chains(rng, 60, 9):
        field, slots = drawn_field(rng), [a + b for a, b in feats]
        best = max(itertools.product((0, 1), repeat=len(slots)), key=lambda y: score_of(field, slots, y))
        assert tuple(field.decode(slots)) == best


def test_likelihood_and_gradient_against_all_paths_and_differences():
    rng = np.random.default_rng(6)
    pages, field = chains(rng, 7, 8), drawn_field(rng)
    held = main_text.Chains(pages)
    keep = np.ones(len(held.flat), bool)
    value, unary, step = field.likelihood(held, keep)
    plain = 0.0
    for feats, gold in pages:
        slots = [a + b for a, b in feats]
        plain += score_of(field, slots, tuple(gold)) - np.logaddexp.reduce([score_of(field, slots, y) for y in itertools.product((0, 1), repeat=len(slots))])
    assert abs(value - (plain / len(pages) - main_text.RIDGE / 2 * ((field.unary**2).sum() + (field.step**2).sum()))) < 1e-9
    spots = [(field.unary, unary, (s, y)) for s in (0, 3, 8, pages[0][0][0][0][0]) for y in (0, 1)] + [(field.step, step, (a, b)) for a in (0, 1) for b in (0, 1)]
    for weights, gradient, at in spots:
        old = weights[at]
        weights[at] = old + 1e-5
        up = field.likelihood(held, keep)[0]
        weights[at] = old - 1e-5
        down = field.likelihood(held, keep)[0]
        weights[at] = old
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6


@pytest.mark.parametrize("page", ['<p x="' * 200_000, "<p " * 200_000, "<![CDATA[" * 100_000, "<p>" * 100_000 + "x", "<div>y " * 50_000])
def test_long_and_broken_pages_take_linear_time(page):
    import time

    began = time.time()
    main_text.leaf_blocks(page * max(1, 2_000_000 // len(page)))
    assert time.time() - began < 30


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark, docs, tmp_path):
    """All five stages against plain Python, but for the scores of the toxicity model, which have tests of their own."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at = str(tmp_path)
    rng = np.random.default_rng(8)
    rude = [(1000 + k, " ".join(rng.choice(["vile", "scum", "rotten", "filth"], 30)), "web") for k in range(12)]
    rows = [(i, t, s) for i, t, s in ROWS if i is not None and i != 18] + rude
    spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, at).filter("predicted = 1").collect()}
    assert toxic == {i for i, *_ in rude}
    left = first_of_groups([r for r in rows if r[0] not in toxic])
    left = [r for r in left if not held(r[1])]
    left = [r for r, m in zip(left, mixed(left), strict=True) for _ in range(m[5])]
    tok, want, start = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), [], 0
    for i, t, _ in sorted(left, key=lambda r: r[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, at).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert by_rows(got) == by_rows(want)
