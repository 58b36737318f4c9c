"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and pipeline stage."""

import random
import time

import pytest

from basewright.llm import bpe, language_id, merkle, ngram_join, packing, substring_dedup, token_file, topk, url_filter, warc

#: Names that operators give to columns of their own, in what they return or on the way.
CLASHING = ["removed", "score", "lang_pred", "Fingerprint", "ids", "decoded", "id", "th", "h", "n", "part", "hot", "covered", "__id", "__th", "__covered", "__cut", "__key", "__language", "sig", "component_id", "rep", "start", "length", "tie", "task", "run", "extra", "row", "key", "payload", "digest", "host", "path", "rule", "verdict", "mean", "fold"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def rows():
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdeiourst", k=r.randint(2, 8))) for _ in range(3000)]
    run = lambda n: " ".join(r.choices(vocab, k=n))
    texts = [run(60) + "." for _ in range(12)]
    texts += [None, "", "   ", "\n\n\n", "12 !?", "One", run(40_000), "x" * 100_000, " " * 60_000 + "end", "a\n" * 30_000, "é😀" * 2000, "w " * 20_000]
    out = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], out[3], (3, texts[4], "en", "s", 1), (None, texts[5], "de", "s", 1), (None, texts[5], "de", "s", 1), (None, None, None, None, None), (100, texts[0], None, None, None)]
    return [(*x, *(f"{c}-{k}" for c in CLASHING)) for k, x in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def others(df, names):
    """The caller's other columns, whatever they are called now."""
    return sorted(map(tuple, df.select([f"`{names.get(c, c)}`" for c in CLASHING]).collect()))


def test_columns_are_kept(spark, docs, nothing):
    want = others(docs, {})
    model = language_id.train(docs)
    for done, renamed in (
        (substring_dedup.dedup(docs), ["removed"]),
        (language_id.predict(docs, model), ["lang_pred", "score"]),
        (merkle.fingerprints(docs), ["Fingerprint"]),
        (bpe.encode(docs), ["ids"]),
        (bpe.decode(bpe.encode(docs, ids_col="made"), "made").drop("made"), ["decoded"]),
    ):
        assert others(done, {c: f"{c}_input" for c in renamed}) == want
        assert len({c.lower() for c in done.columns}) == len(docs.columns) + len(renamed)
    for done in (substring_dedup.dedup(nothing), language_id.predict(nothing, model), merkle.fingerprints(nothing), bpe.encode(nothing)):
        assert done.count() == 0


def test_rows_are_kept(spark, docs, nothing):
    n = docs.count()
    for f in (bpe.round_trip, lambda d: token_file.read_all(token_file.write(d)), ngram_join.link, merkle.compare_with_next):
        assert f(docs).count() == n and f(nothing).count() == 0
    pieces = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in pieces) == n and packing.pack(nothing).count() == 0
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    same = bpe.round_trip(docs).filter("doc_id = 3").select("ids_sha256").distinct().count()
    assert same == 2  # three equal rows and another text
    got = token_file.read_all(token_file.write(docs)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows()), key=lambda i: (i is None, i))


def test_pages(spark):
    pages = spark.createDataFrame([(r[0], f"http://h.com/{k % 4}" if k % 5 else None, r[1], *r[5:]) for k, r in enumerate(rows())], "page_id long, url string, html string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    n = pages.count()
    assert url_filter.judge(pages).count() == n and url_filter.judge(pages.limit(0)).count() == 0
    captures = warc.write(pages)
    assert captures.count() == n and warc.fetch(warc.index(captures), captures.select("key", "page_id")).count() == n


def test_vectors(spark):
    r = random.Random(1)
    vectors = [(i % 40, [r.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(None, [1.0] * 4), (50, None), (50, []), (100, [1.0, float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame([(*v, *CLASHING) for v in vectors], "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in CLASHING))
    got = topk.search(table).collect()
    assert [x.rank for x in sorted(got, key=lambda x: (x.query_id, x.rank)) if x.query_id == 0] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]  # two rows of id 0 are two queries
    assert {x.query_id for x in got} == {0}


def test_stages(spark, docs, nothing, tmp_path):
    """Every stage keeps the columns and the values of the rows that stay, with repeated and null ids, on long texts and on an empty table."""
    p = pytest.importorskip("corpus_pipeline")
    own = {(r[0], r[1]): [x[5:] for x in rows() if x[:2] == r[:2]] for r in rows()}
    now = docs
    for name, stage in p.STAGES[:-1]:
        done = stage(spark, now, "")
        assert done.schema.names == docs.schema.names
        got = done.collect()
        if name != "substring_dedup":
            assert all(tuple(r[5:]) in own[r[0], r[1]] for r in got), name
        assert stage(spark, nothing, "").count() == 0
        now = spark.createDataFrame(got, SCHEMA)
        if name == "language_id":
            assert not [r for r in got if not r[1] or not any(c.isalpha() for c in r[1])] and len(got) > 15
        if name == "ngram_jaccard":
            texts = [r[1] for r in got]
            assert len(set(texts)) == len(texts)  # of each repeated text one row stays, with or without an id
            assert {r[0] for r in got if r[1] == rows()[0][1]} == {0} and {r[0] for r in got if r[1] == rows()[5][1]} == {5}
            assert {r[0] for r in got if r[1] in (rows()[3][1], rows()[4][1])} == {3, 4}
    assert p.STAGES[-1][1](spark, now, "").select("doc_id").distinct().count() == len({r[0] for r in got})
    assert p.STAGES[-1][1](spark, nothing, "").count() == 0


def test_long_texts_take_linear_time():
    blanks, words, one = " \n" * 200_000 + "x", "ab cd. " * 60_000, "x" * 400_000
    for f in (substring_dedup.spans, substring_dedup.sentences, merkle.fingerprint, lambda t: ngram_join.shingles(t, 5), language_id.features, bpe.RankArrayBpe(bpe.default_path()).encode):
        for text in (blanks, words, one):
            began = time.time()
            f(text[: len(text) // 4])
            short = time.time() - began
            began = time.time()
            f(text)
            assert time.time() - began < 8 * short + 1.5, (f, text[:8])


def test_shared_folder(spark):
    from basewright import shared

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "local-cluster[2,1,1024]"})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Cluster())
    assert shared.shared_dir(spark).startswith("file:///")


def test_ids_at_both_ends_of_a_long(spark):
    """The stage of near copies takes any long for an id, next to ids that are null or shared."""
    p = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    texts = [" ".join(r.choices([f"w{k}" for k in range(500)], k=40)) for _ in range(4)]
    top, low = (1 << 63) - 1, -(1 << 63)
    rows = [(top, texts[0]), (low, texts[0]), (None, texts[1]), (7, texts[1]), (8, texts[2]), (8, texts[3]), (None, texts[3]), (top - 1, texts[2])]
    docs = spark.createDataFrame([(*x, "en", "s", 1, "mine") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string")
    got = sorted((str(x.doc_id), texts.index(x.text)) for x in p.drop_near_copies(spark, docs, "").collect())
    assert [x for x in got if x[1] < 3] == sorted([(str(low), 0), ("7", 1), (str(top - 1), 2)]) and sum(x[1] == 3 for x in got) == 1
