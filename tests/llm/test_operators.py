import hashlib
import os
import zlib

import pytest

pytest.importorskip("tessera.llm.queries")
import duckdb  # noqa: E402

from tessera.llm import decontamination, jaccard_join, line_dedup, mixing, quality, queries, repeated_passages, token_store  # noqa: E402, F401

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in green trees near old stone walls and rivers run".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, set_id int, times int"


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] + str((seed * 131 + i) % 97) for i in range(n))


def cases() -> list[tuple]:
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (7, "one two"), (8, "ONE\ttwo"), (9, prose(2, 30_000)),
             (10, prose(3, 60) + "\n" + base[100:400]), (11, "é" * 80 + " 漢字 " * 40), (12, "a\na\na\n\n#### $$$$"), (None, "no id at all here"), (13, base)]
    return [(i, t, "en", [None, "web", "books"][k % 3], 0, 1, "x", 2, 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(cases(), DOC).write.parquet(f"{at}/documents.parquet")
    html = "<html><body><nav><a href='#'>Home</a></nav><article><h1>Title</h1><p>" + prose(5, 60) + " &amp; more.</p></article><footer>c</footer></body></html>"
    spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text"), (4, "u", html)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, prose(1, 200)[200:500]), (2, None), (3, "never seen words in any of these texts"), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 1), (7, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_odd_rows_and_extra_columns(spark, sf_dir, name):
    n = queries.QUERIES[name](spark, sf_dir).count()
    if name.startswith("op1_"):
        assert n == 5
    elif name not in ("op3_decontamination", "op13_phrases"):  # items and phrases, not documents
        assert n == len(cases())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        at = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*' if os.path.isdir(at) else ''}')")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    short = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert short(map(tuple, got.collect())) == short(want)


def test_passages_against_brute_force(spark):
    shared = prose(9, 20)
    texts = {1: prose(1, 40), 2: "x" + shared + "y" + prose(2, 10), 3: prose(3, 10) + shared, 4: shared[5:70], 5: None, 6: "z" * 120, 7: "z" * 60, 8: prose(1, 40)}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    first: dict[bytes, int] = {}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            first.setdefault(raw[k][i : i + 50], k)
    want = {}
    for k, b in raw.items():
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = [True] * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = repeated_passages.remove(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == want


def test_token_counts_against_the_library(spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in cases())
    got = queries.op5_token_count(spark, sf_dir).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want


def test_token_store_against_the_library(spark, sf_dir):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in cases():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i if i is not None else -1, len(ids), zlib.crc32(ids.tobytes())))
    got = queries.op4_token_store(spark, sf_dir).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_pipeline_over_odd_rows(spark, sf_dir, empty_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id < 9").select("doc_id").distinct().collect()) == [1, 4, 5, 6, 7]
    corpus_pipeline.run(spark, sf_dir).collect()
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
