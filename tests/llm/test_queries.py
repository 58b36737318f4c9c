"""The driver's queries over whole tables of the smallest size, each against brute force."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from basewright.llm import merkle, queries, substring_dedup, url_filter

from .test_llm import brute_links, library, plain_dedup, plain_likeness, plain_top, plain_url_scores
from .test_prefix_trie import COLUMNS, plain_nodes, plain_rebuilt, plain_turns
from .test_simhash_fim import plain_components, plain_fim, plain_fingerprint

WHERE = "/root/testdata/sf0.001"


def table(name, *columns):
    got = pq.read_table(f"{WHERE}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*got.values()))


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.queries()[name](spark, WHERE).collect()


@pytest.fixture(scope="module")
def docs():
    return sorted(table("documents", "doc_id", "text"))


def ids_of(docs, end):
    t = library()
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, *end], "<u4") for i, x in docs}


def test_every_query_is_here():
    assert sorted(queries.queries()) == sorted(["op1_url_filter", "op2_bpe", "op3_top_k", "op4_substring_dedup", "op5_warc", "op6_token_file", "op7_ngram_jaccard", "op8_merkle", "op9_packing", "op10_language_id", "op11_fim", "op12_prefix_trie", "op13_simhash"])


def test_op1(spark, run):
    got = run("op1_url_filter")
    pages = dict(table("pages", "page_id", "url"))
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        rest = (pages[r.page_id] or "").partition("://")[2]
        at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        path = rest[at:]
        path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
        assert (r.host, r.path) == (rest[:at].lower(), path)
        fits = [x for x in url_filter.RULES if (r.host == x.partition("/")[0] or r.host.endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        assert r.rule == max(fits, key=len, default=None)
    rows = spark.createDataFrame([(r.page_id, r.host, r.path) for r in got], "page_id long, host string, path string")
    folds = {r.page_id: r.f for r in rows.selectExpr("page_id", f"cast(pmod(xxhash64(host, path), {url_filter.FOLDS}) as int) as f").collect()}
    assert [(r.mean, r.verdict) for r in got] == plain_url_scores([(r.host + r.path, url_filter.RULES.get(r.rule), folds[r.page_id]) for r in got])


def test_op2(run, docs):
    t, got = library(), {r.doc_id: r for r in run("op2_bpe")}
    assert len(got) == len(docs)
    for i, ids in ids_of(docs, []).items():
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3(run):
    rows = [(i, [float(x) for x in v]) for i, v in table("embeddings", "vec_id", "embedding") if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in run("op3_top_k")) == plain_top(rows)


def test_op4(run, docs):
    want, got = plain_dedup(docs), {r.doc_id: r for r in run("op4_substring_dedup")}
    for i, text in docs:
        gone = want.get((i, text), set())
        assert got[i].text == (text if text is None else "".join(c for k, c in enumerate(text) if k not in gone))
        assert substring_dedup.sentences(text or "") == [(a, b) for a, b in substring_dedup.sentences(text or "") if b > a]
    assert sum(map(bool, want.values())) > 5 and len(got) == len(docs)


def test_op5(run):
    pages = {i: (h or "").encode() for i, h in table("pages", "page_id", "html")}
    last = {}
    for i, body in pages.items():
        last[body] = max(i, last.get(body, i))
    got = run("op5_warc")
    assert len(got) == len(pages)
    for r in got:
        body = pages[r.page_id]
        to = last[body] if len(body) >= 1000 and last[body] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to)


def test_op6(run, docs):
    got, start = {r.doc_id: r for r in run("op6_token_file")}, 0
    for i, ids in sorted(ids_of(docs, [1]).items()):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op7(run, docs):
    lower = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    want = brute_links([(i, t.translate(lower) if t else t) for i, t in docs], 3, 9, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op7_ngram_jaccard")} == want


def test_op8(run, docs):
    got, order = {r.doc_id: r for r in run("op8_merkle")}, sorted(docs, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (pytest.approx(plain_likeness(text, edited)), pytest.approx(plain_likeness(text, following)))
        assert merkle.parsed(r.fingerprint) == merkle.tree(text) and r.edited_fingerprint == merkle.fingerprint(edited)


def test_op9(run, docs):
    pieces = {}
    for r in run("op9_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for own in pieces.values() for r in own}) == sum(map(len, pieces.values()))
    for i, ids in ids_of(docs, [2]).items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.offset == 0 and r.length <= 4096 and r.length & r.length - 1 == 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_op10(run):
    langs = {i: (t, lang) for i, t, lang in table("documents", "doc_id", "text", "lang")}
    got = run("op10_language_id")
    assert len(got) == len(langs)
    right = held = 0
    for r in got:
        text, lang = langs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.held_out and lang:
            held += 1
            right += r.lang_pred == lang
    assert held > 10 and right >= 0.95 * held


def test_op11(run, docs):
    got, sha = {r.doc_id: r for r in run("op11_fim")}, lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert len(got) == len(docs)
    for i, text in docs:
        r, want = got[i], plain_fim(i, text, "line")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*want[:4], sha(want[4]), sha(text or ""))


def test_op12(run):
    want = plain_nodes(plain_rebuilt(plain_turns(table("conversations", "conv_id", "turn", "role", "text"))))
    got = run("op12_prefix_trie")
    assert len(got) == len(want) and {tuple(r[c] for c in COLUMNS) for r in got} == want


def test_op13(run, docs):
    own = [(i, plain_fingerprint(text)) for i, text in docs]
    want = plain_components(own, 4)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run("op13_simhash")) == sorted((i, f"{f:016x}", want[i]) for i, f in own)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(run, name):
    """Rows, names and number of columns of a query are those of its SQL."""
    import duckdb

    db = duckdb.connect()
    for path in Path(WHERE).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    want = db.sql(queries.oracle_sql()[name])
    got = run(name)
    assert sorted(got[0].__fields__) == sorted(want.columns) and len(got) > 3
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in got) == sorted(map(str, want.fetchall()))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())
