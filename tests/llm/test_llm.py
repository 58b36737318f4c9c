"""Operators of the training-data pipeline against brute force, on small and awkward tables."""

import hashlib
import itertools
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basewright.llm import bpe, language_id, merkle, ngram_join, packing, substring_dedup, token_file, topk, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdeiourst", k=r.randint(1, 9))) for _ in range(300)]
    sentence = lambda: " ".join(r.choices(vocab, k=r.randint(2, 14))).capitalize() + "."
    out = [" ".join(sentence() for _ in range(r.randint(1, 30))) for _ in range(40)]
    out += [out[3], out[3], None, "", "   ", "...!!!", "One", "Σας ΟΔΟΣ don't <|endoftext|> 3.14 é\x00\x1f　x", "x" * 3000]
    near = out[5].split(" ")
    near[len(near) // 2] = "changed"
    return [*out, " ".join(near), out[7] + "\n" + out[8]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(spark, docs, texts):
    t, own = library(), bpe.RankArrayBpe(bpe.default_path())
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == ids and got[i * 3].n_tokens == len(ids)
        assert got[i * 3].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i * 3].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    r = random.Random(1)
    for k in [*range(2, 60), 199, 200, 201, 500, 1500]:
        word = "".join(r.choices(r.choice(["abcxyz", "aeiourstlnd", "ab", "é😀ßa"]), k=k))
        want = t.encode(word, add_special_tokens=False).ids
        ids = [own.vocab[c] for c in (own.alphabet[b] for b in word.encode())]
        ids[-1] = own.vocab[own.alphabet[word.encode()[-1]] + own.end]
        assert word.count("😀") or own.scan(ids[:]) == own.heap(ids[:]) == want, word
        assert own.encode(word) == bpe.LibraryBpe(bpe.default_path()).encode(word) == want if k < 10 or k > 198 else own.encode(word) == want
    both = bpe.decode(bpe.encode(docs, ids_col="ids"), "ids").collect()
    assert all(r.decoded == own.decode(own.encode(r.text)) for r in both)
    assert bpe.round_trip(empty(spark)).count() == 0


def test_every_code_point():
    """Both coders give the library's ids for every code point, next to letters, digits and itself."""
    own, lib = bpe.RankArrayBpe(bpe.default_path()), bpe.LibraryBpe(bpe.default_path())
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b1{c}{c} 's{c}" for c in chars]
    for c, text, want in zip(chars, texts, lib.library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids, hex(ord(c))
        if c < "\u0300":
            assert lib.encode(text) == want.ids, hex(ord(c))
    two = [a + b for a in map(chr, range(0x250)) for b in map(chr, [*range(0x20, 0x80, 3), 0x27, *range(0x80, 0x250, 5)])]
    for text, want in zip(two, lib.library.encode_batch(two, add_special_tokens=False)):
        assert lib.encode(text) == want.ids, ascii(text)


def test_packing(spark, docs, texts):
    assert [packing.lengths(n) for n in (1, 6, 4096, 9000)] == [[1], [4, 2], [4096], [4096, 4096, 512, 256, 32, 8]]
    t = library()
    rows = packing.pack(docs).orderBy("doc_id", "start").collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, own in itertools.groupby(rows, lambda r: r.doc_id):
        own = list(own)
        ids = [x for r in own for x in r.ids]
        assert ids == [*t.encode(texts[i // 3] or "", add_special_tokens=False).ids, 2]
        assert all(r.offset == 0 and r.length == 1 << r.bucket == len(r.ids) and r.doc_tokens == len(ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack(empty(spark)).count() == 0
    packing.write_buckets(packing.pack(docs), folder := tempfile.mkdtemp())
    back = spark.read.parquet(folder)
    assert back.count() == len(rows) and all(len(x.ids) == 1 << 5 for x in back.filter("bucket = 5").collect())
    assert back.filter("bucket = 5").inputFiles() and all("bucket=5" in f for f in spark.read.parquet(f"{folder}/bucket=5").inputFiles())


def test_token_files(spark, docs, texts):
    t, at = library(), 0
    more = docs.union(spark.createDataFrame([(6, "again", None, None, None), (None, "no id", None, None, None)], DOCS))
    manifest = token_file.write(more)
    got = token_file.read_all(manifest).collect()
    assert len(got) == len(texts) + 2
    for r in sorted((r for r in got), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    one = {r.doc_id: r for r in got}
    for i, text in enumerate(texts):
        if i != 2:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            assert one[i * 3].ids_crc32 == zlib.crc32(ids.tobytes()) and one[i * 3].n_tokens == len(ids)
    found = token_file.lookup(manifest, spark.createDataFrame([(6,), (9,), (10,), (None,)], "doc_id long")).collect()
    assert sorted(str(r.doc_id) for r in found) == ["6", "6", "9", "None"]
    keys = token_file.mix(np.arange(5000, dtype="u8"), 1)
    assert sorted(token_file.PerfectHash.build(keys).slots(keys)) == list(range(5000))
    assert token_file.read_all(token_file.write(empty(spark))).count() == 0


def test_language(spark, docs):
    r = random.Random(3)
    words = {"en": ["the", "with", "which", "thing", "ought"], "de": ["der", "nicht", "sch", "über", "zwei"], "fr": ["le", "où", "être", "eaux", "quoi"], "es": ["el", "niño", "qué", "lla", "ción"]}
    rows = [(i, " ".join(r.choices(words[lang], k=30)), lang, "s", 0) for i, lang in enumerate(list(words) * 30)] + [(900, None, "en", "s", 0), (901, "123 !!", "en", "s", 0), (902, "the which", None, "s", 0)]
    table = spark.createDataFrame(rows, DOCS)
    model = language_id.train(table, per_language=20)
    got = {x.doc_id: x for x in language_id.predict(table, model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang, _, _ in rows[:-3])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en"
    none = language_id.train(empty(spark))
    assert {x.lang_pred for x in language_id.predict(table, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def plain_likeness(a, b):
    """Twice the characters in leaves that both texts have over all, leaves counted as often as both have them."""
    from collections import Counter

    x, y = (Counter(leaf for s in merkle.sections(t) for p in merkle.paragraphs(s) for leaf in merkle.leaves(p)) for t in (a, b))
    return 1.0 if a == b else 2 * sum(n * len(k) for k, n in (x & y).items()) / (len(a) + len(b))


def test_merkle(spark, docs, texts):
    a, b = texts[9], texts[9].replace(texts[9].split()[3], "other", 1)
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert x != y and merkle.likeness(x, x) == 1 and merkle.differing(x, x) == []
    assert all("".join(x for s in merkle.sections(t or "") for p in merkle.paragraphs(s) for x in merkle.leaves(p)) == (t or "") for t in texts)
    assert all(merkle.parsed(merkle.fingerprint(t)) == merkle.tree(t) for t in texts)
    more = docs.union(spark.createDataFrame([(6, "again. And again.\n\nOther.", None, None, None), (6, "again", None, None, None), (None, "no id", None, None, None), (None, "no id either", None, None, None)], DOCS))
    rows = [(r.doc_id, r.text or "", r.h) for r in more.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    got = merkle.compare_with_next(more).collect()
    want = []
    for (i, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        edited = merkle.edited_text(text, following)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle.fingerprint(text), merkle.fingerprint(edited), plain_likeness(text, edited), plain_likeness(text, following)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert merkle.compare_with_next(empty(spark)).count() == 0
    alone = merkle.compare_with_next(docs.filter("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    named = merkle.fingerprints(docs.withColumn("fingerprint", docs.doc_id)).collect()
    assert all(r.fingerprint_input == r.doc_id and r.fingerprint == merkle.fingerprint(r.text) for r in named)


def test_merkle_tree():
    """Every node is a function of its children; edits are found, whether inserted, deleted, changed or moved."""
    parts = ["First line. It has two sentences.\nSecond line, here.\n\n", "A section of its own, with words.\n\n", "Last one of all, at the end."]
    text = "".join(parts)
    root = merkle.tree(text)
    assert [s.size for s in root.children] == [len(x) for x in parts] and [len(s.children) for s in root.children] == [3, 2, 1]
    check = lambda node: not node.children or (merkle.over(list(node.children)) == node and all(map(check, node.children)))
    assert check(root)
    for other in ("".join(parts[::-1]), parts[0] + parts[2], text + " More words.", text.replace("Second", "Third"), "New.\n\n" + text, "", "all different"):
        at, out = 0, ""
        for i, j, k, l in merkle.differing(merkle.fingerprint(text), merkle.fingerprint(other)):  # noqa: E741
            out += text[at:i] + other[k:l]
            at = j
        assert out + text[at:] == other
        assert abs(merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) - plain_likeness(text, other)) < 1e-12
    assert merkle.differing(merkle.fingerprint(text), merkle.fingerprint(parts[0] + parts[2])) == [(len(parts[0]), len(parts[0]) + len(parts[1]), len(parts[0]), len(parts[0]))]


def test_merkle_likeness_has_no_steps():
    """Texts on different sides of a length differ only where they do, and leaves fall in again after a word is put in front."""
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdeiourstéß", k=r.randint(2, 9))) for _ in range(900)]
    for limit in (256, 2048):
        for _ in range(20):
            words = r.choices(vocab, k=limit)
            words = words[: next(k for k in range(limit) if len(" ".join(words[:k])) >= limit) - 1]
            a = " ".join(words)
            for b in (a + " " + " ".join(r.choices(vocab, k=6)), r.choice(vocab) * 4 + " " + a):
                assert len(a) < limit <= len(b)
                x, y = merkle.fingerprint(a), merkle.fingerprint(b)
                went = merkle.differing(x, y)
                assert merkle.likeness(x, y) > (0.6 if limit == 256 else 0.9) and 0 < sum(v - u for _, _, u, v in went) < (150 if limit == 256 else 200)
    a = " ".join(r.choices(vocab, k=48))
    a = a[:275]
    assert abs(merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a[:184])) - 2 * 184 / 459) < 0.12


def test_merkle_edited_text_shares_nodes(monkeypatch):
    """An edited text's paragraphs are cut and hashed once, with the texts it is made of; only those at its seam and its end are new.  Results are those of trees made alone."""
    r = random.Random(11)
    line = lambda: " ".join("".join(r.choices("abcdeioß漢", k=r.randint(1, 9))) for _ in range(r.randint(1, 15))) + r.choice([".", "!", ""])
    texts = ["".join(line() + r.choice(["\n", "\n\n", "\n \n"]) for _ in range(r.randint(1, 40))) for _ in range(60)]
    texts += ["", "", "no line end", texts[0], texts[0], "same\n" * 9, "\n", "漢" * 700, line()]
    want = []
    for i, (text, following) in enumerate(zip(texts, texts[1:])):
        edited = merkle.edited_text(text, following)
        a, b, c = map(merkle.tree, (text, edited, following))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle.shown(a), merkle.shown(b), merkle.likeness(a, b), merkle.likeness(a, c)))
    cut, leaves = [], merkle.leaves
    monkeypatch.setattr(merkle, "leaves", lambda p: cut.append(p) or leaves(p))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array(texts)], names=["run", "extra", "doc_id", "text"])
    got = [tuple(row.values()) for b in merkle.walk([batch.slice(0, 20), batch.slice(20)]) for row in b.to_pylist()]
    assert got == want
    assert len(cut) <= sum(len({p for s in merkle.sections(t) for p in merkle.paragraphs(s)}) for t in texts) + 2 * (n - 1)
    # hashes of before
    assert merkle.fingerprint("漢字" * 8) == "tyLGbkCa5Ubq|H4Wl03sFXeyc:03oyEBgmCotj=QpZTS7cScS_2.10"
    assert merkle.fingerprint("One two three. Four\nfive!\n\nSeven eight.\n") == "2t9qfihqe7AI|qPemGRny3kgq:4fNF2X1U0YFG=zzx5qU2ZS8ct.4,sS0RJxPxnMSZ.b,i2G5C8yS9GXx.5;qLauVnYzrrE3=lAIZPhhiD1QC.6;RQvthUEws2VO=LzqwSUn1j2M0.1|YDJX1j7b86YX:pyP4aN5pAEcH=54uRW3ytFUSn.d"
    assert merkle.fingerprint("\ud800 x") == "wWSo9hUlM64l|2Ju4e3dfTEcc:AEh7xtfbs9Qd=ZO6zxHzaVj_L.3"


def test_urls(spark):
    rows = [(1, "http://a.example.com/en/1"), (2, "https://EXAMPLE.com/en/7x?q"), (3, "http://x.net/de/3#t"), (4, "http://m.example.net/de/85"), (5, "http://b.org/es/"), (6, "http://b.org/fr/1"), (7, None), (8, "nothing"), (9, "http://notcom/en/"), (9, "http://é.ORG?x/es/")]
    got = sorted(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect(), key=lambda r: (r.page_id, r.host))
    assert [(r.rule, r.verdict) for r in got[:5]] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    assert (got[1].host, got[1].path) == ("example.com", "/en/7x") and all(r.rule is None and r.verdict in ("allow", "block") for r in got[5:])
    assert (got[6].host, got[6].path) == ("", "") == (got[7].host, got[7].path)
    alone = url_filter.judge(spark.createDataFrame(rows[5:8], "page_id long, url string")).collect()
    assert {r.verdict for r in alone} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_url_scores(rows):
    """Mean of each (host + path) by models counted in plain dictionaries; the threshold from other folds' models. rows: (text, kind, fold)."""
    import math
    import re
    from collections import Counter, defaultdict

    order, base = url_filter.ORDER, url_filter.BASE

    def symbols(text):
        return [0] * order + [url_filter.ALPHABET.index(c) + 2 for c in re.sub(r"[^a-z0-9./\-]", "~", text.lower())] + [1]

    def model(texts):
        counts = [defaultdict(Counter) for _ in range(order + 1)]
        for text in texts:
            s = symbols(text)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][tuple(s[i - k : i])][s[i]] += 1

        def p(context, c):
            if context is None:
                return 1 / base
            shorter = p(context[1:] if context else None, c)
            own = counts[len(context)][context]
            n, t = sum(own.values()), len(own)
            return shorter if not n else (own[c] + t * shorter) / (n + t)

        return p

    def scorer(texts_a, texts_r):
        a, r = model(texts_a), model(texts_r)

        def score(text):
            s, total = symbols(text), 0
            for i in range(order, len(s)):
                gram = tuple(s[i - order : i + 1])
                total += math.floor((math.log(a(gram[:-1], gram[-1])) - math.log(r(gram[:-1], gram[-1]))) * url_filter.SCALE + 0.5)
            return math.floor(total / (len(text) + 1) / url_filter.STEP)

        return score

    of = lambda kind, fold=None: [t for t, k, f in rows if k == kind and f != fold]
    held = []
    for fold in range(url_filter.FOLDS):
        score = scorer(of("allow", fold), of("block", fold))
        held += [(score(t), k) for t, k, f in rows if f == fold and k]
    lost = lambda cut: sum(k == "allow" and m < cut for m, k in held) * len(of("block")) + sum(k == "block" and m >= cut for m, k in held) * len(of("allow"))
    cut = min((lost(m), m) for m, _ in held)[1]
    score = scorer(of("allow"), of("block"))
    return [(score(t), k or ("block" if score(t) < cut else "allow")) for t, k, _ in rows]


def test_url_model(spark):
    """Means and verdicts of every URL against the models in plain Python."""
    r = random.Random(12)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(2, 9)))
    urls = []
    for i in range(260):
        letters, tail = ("aeioulmn", "/en/") if i % 3 else ("xzqwkj", "/de/")
        host = r.choice(["com", "net", "org", "io"])
        urls.append(f"http://{word(letters)}.{host}{r.choice([tail, '/en/', '/de/', '/es/', '/fr/'])}{word(letters)}?{word('abc')}")
    rows = [(i, u) for i, u in enumerate(urls)] + [(400, None), (401, "http://é.com/Ü~\n/x"), (402, "http://a.io/" + "xqz" * 3000)]
    got = {x.page_id: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    folds = {x.page_id: x.f for x in spark.createDataFrame([(i, got[i].host, got[i].path) for i, _ in rows], "page_id long, host string, path string").selectExpr("page_id", f"cast(pmod(xxhash64(host, path), {url_filter.FOLDS}) as int) as f").collect()}
    kinds = [url_filter.RULES.get(got[i].rule) for i, _ in rows]
    want = plain_url_scores([(got[i].host + got[i].path, k, folds[i]) for (i, _), k in zip(rows, kinds)])
    assert [(got[i].mean, got[i].verdict) for i, _ in rows] == want
    free = [got[i].verdict for i, _ in rows if got[i].rule is None]
    assert free.count("block") > 10 and free.count("allow") > 10


def test_url_time_is_linear(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        table = spark.createDataFrame([(i, f"http://h.{'com' if i else 'net'}/{'en' if i else 'de'}/" + "ab1" * n) for i in range(2)], "page_id long, url string")
        began = time.time()
        assert url_filter.judge(table).filter("length(path) > 1000").count() == 2
        url_filter.judge(table).collect()
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 5


def plain_top(rows, k=5, every=50):
    """Whole-number inner products of every query with every other row, in Python."""
    import math

    z = [(i, [math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256 for x in v]) for i, v in rows]
    out = []
    for a, (q, u) in enumerate(z):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(z) if a != b and len(u) == len(v))
            out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -score))) for r, (score, i) in enumerate(s[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).astype("f4").astype("f8")
    x[10] = x[20] = x[30]
    rows = [(i, x[i].tolist()) for i in range(300)]
    odd = [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8), (1150, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = sorted(tuple(row)[:4] for row in topk.search(table).collect())
    assert got == plain_top(rows)
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 64_000)
    monkeypatch.setattr(topk, "QUERY_BYTES", 4_000)
    again = [(100, x[7].tolist()), (100, x[8].tolist()), (100, x[8].tolist())]  # rows of one id, in several blocks
    got = topk.search(spark.createDataFrame(rows + again, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(row)[:4] for row in got) == plain_top(rows + again)
    assert all(row.evaluated <= 302 for row in got)
    # two far clusters: most of the other one is never scored
    far = [(i, [*(1000.0 + x[i][:4]), *x[i][4:]] if i % 2 else [*x[i][:4] - 1000.0, *x[i][4:]]) for i in range(300)]
    got = topk.search(spark.createDataFrame([(i, list(map(float, v))) for i, v in far], "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(row)[:4] for row in got) == plain_top(far)
    for top in (1e6, 1e15, 1e18, 1e307):
        large = [(i, [float(v) * top for v in x[i]]) for i in range(60)] + [(100, [top] * 8), (150, [top] * 8)]
        got = topk.search(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
        assert sorted(tuple(row)[:4] for row in got) == plain_top(large), top
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_warc(spark):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a.com/x y", big), (5, "http://b.a.com/", big), (3, None, big), (4, "http://c.com/?q#f", "small"), (6, "http://c.com/", "small"), (7, "u", None), (None, "http://n.com/", big), (None, "http://n.com/", "lone" * 400), (9, "http://d.com/\r\nX: y", "z" * 2000)]
    captures = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    directory = warc.index(captures)
    back = warc.fetch(directory, captures.select("key", "page_id")).collect()
    got = {(r.page_id, r.payload_digest): r for r in back}
    assert len(got) == len(back) == len(rows)
    for page_id, _, html in rows:
        body = (html or "").encode()
        r = got[page_id, hashlib.sha1(body).hexdigest()]
        revisit = html == big and page_id != 5
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(body), "revisit" if revisit else "response", 5 if revisit else None)
    found = warc.lookup(directory, ["http://c.com/?q", "http://none.com/"]).collect()
    assert [(r.page_id, bytes(r.payload)) for r in found] == [(4, b"small")]
    none = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.fetch(warc.index(none), none.select("key", "page_id")).count() == 0 and warc.lookup(warc.index(none), ["a"]).count() == 0


def test_warc_many_keys(spark, monkeypatch):
    """Every record comes back once by its key, through many blocks and files, with a URL and whole rows that repeat; record ids are unique."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(i, f"http://h{i % 37}.example.com/{i * 7919 % 100} {i % 3}", "x" * (i % 5)) for i in range(700)]
    rows += [(i, "http://hot.com/", "hot" * 400) for i in range(700, 1000)] + [(None, None, "n")] * 40 + [(5, "http://again.com/", "y")] * 40 + [(2000, "http://long.com/" + "a" * 50_000, "b" * 300_000)]
    captures = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6))
    directory = warc.index(captures)
    back = warc.fetch(directory, captures.select("key", "page_id")).collect()
    key = lambda r: str((r.page_id, r.payload_bytes, r.record_type, r.refers_to))
    want = [str((i, len(h), "revisit" if 700 <= (i or 0) < 999 else "response", 999 if 700 <= (i or 0) < 999 else None)) for i, _, h in rows]
    assert sorted(map(key, back)) == sorted(want)
    for url in ("http://h3.example.com/57 1", "http://hot.com/", "http://again.com/", rows[-1][1], "http://h3.example.com/"):
        own = sorted(i for i, u, _ in rows if u and warc.url_key(u) == warc.url_key(url))
        assert sorted(r.page_id for r in warc.lookup(directory, [url]).collect()) == own
    names = []
    for r in captures.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            names.append(warc.parse(f.read(r.length))[0]["warc-record-id"])
    assert len(set(names)) == len(rows)


def test_warc_lookup_with_spaces(spark):
    """URLs that hold white space are found, in a block of their own and among others."""
    pages = lambda urls: spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url as html")
    for urls in (["http://ex.com/a b"], ["http://ex.com/a b", "http://ex.com/a!b", "http://ex.com/a\tc", "http://ex.com/a#", "http://ex.com/a$b"]):
        directory = warc.index(warc.write(pages(urls)))
        for i, url in enumerate(urls):
            assert [r.page_id for r in warc.lookup(directory, [url]).collect()] == [i]


def brute_links(rows, width, p, q):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    of = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            s, t = sets[a], sets[b]
            if s and t and q * len(s & t) >= p * len(s | t):
                of[a] = of[b] = min(of[a], of[b])
    return {i: (len(s), of[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, width, p, q):
    r = random.Random(width)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(12):
        words = r.choices(vocab, k=r.choice([2, 4, 12, 40, 150, 400]))
        for _ in range(7):
            w = words[:]
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, "  \t"), (len(rows) + 2, "A b"), (len(rows) + 3, "a  B")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string"), width, p, q).collect()}
    assert got == brute_links([(i, t.lower() if t else t) for i, t in rows], width, p, q)
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "x y z")], "doc_id long, text string")
    assert sorted(str((x.doc_id, x.component_id)) for x in ngram_join.link(nameless, width, p, q).collect()) == ["(1, 1)", "(1, 1)", "(2, 1)", "(None, None)", "(None, None)"]
    assert ngram_join.link(empty(spark), width, p, q).count() == 0


def test_hot_signatures(spark, monkeypatch):
    """A signature that most documents share, dealt out over several tasks, leaves no link out."""
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(900)]
    base = r.choices(vocab, k=90)
    rows = []
    for i in range(260):
        words = base[:]
        for k in range(r.choice([1, 1, 2, 9])):
            words[r.randrange(45, 90)] = f"own{i}.{k}"  # the first half is in all of them
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(r.choices(vocab, k=r.randint(20, 90)))) for i in range(120)]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    of = {i: i for i in sets}
    find = lambda i: i if of[i] == i else find(of[i])
    for a, b in itertools.combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            of[y] = x
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for limit in (10_000, 48):
        monkeypatch.setattr(ngram_join, "HOT_ROWS", limit)
        got = {x.doc_id: x.component_id for x in ngram_join.link(table, 3, 9, 10).collect()}
        assert got == {i: find(i) for i in sets}, limit
    docs = table.selectExpr("doc_id as id", "text")
    assert ngram_join._hot(docs, len(rows), 3, 9, 10).filter("parts > 1").count() > 3
    assert len({find(i) for i in range(260)}) > 10 and len(got) == len(rows)


def test_components_carry_on(spark):
    """New edges between earlier components give the components of all edges."""
    from basewright.llm.common import components

    old, new = [(k, k + 1) for k in range(20, 30)] + [(5, 9), (9, 7), (50, 51)], [(30, 9), (51, 60), (60, 61), (3, 3)]
    of = components(spark.createDataFrame(old, "a long, b long"))
    got = {tuple(r) for r in components(spark.createDataFrame(new, "a long, b long"), of).collect()}
    assert got == {(k, 5) for k in [*range(20, 31), 5, 7, 9]} | {(k, 50) for k in (50, 51, 60, 61)}
    assert {tuple(r) for r in components(spark.createDataFrame([], "a long, b long"), of).collect()} == {tuple(r) for r in of.collect()}


def test_one_id_with_several_copied_texts(spark):
    """An id whose rows copy two documents ties them; other copies follow their representative."""
    rows = [(1, "a b c d e f"), (2, "p q r s t u"), (5, "a b c d e f"), (5, "p q r s t u"), (6, "p q r s t u"), (7, "l m n o p q"), (8, "l m n o p q")]
    got = {(x.doc_id, x.component_id) for x in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 7), (8, 7)}


def test_signatures_are_complete():
    """Sets within the threshold share a signature, at every size."""
    r = np.random.default_rng(5)
    for p, q in ((9, 10), (4, 5)):
        scheme = ngram_join.PartEnum(p, q)
        for n in [*range(4, 60), 100, 300, 1000, 4000]:
            for _ in range(5):
                s = np.unique(r.integers(0, 2**63, n, dtype="u8"))
                k = int(len(s) * (q - p) / q)  # so many taken away leave p / q
                t = np.delete(s, r.choice(len(s), k, replace=False))
                if len(t) < len(s):
                    assert set(scheme.signatures(s)) & set(scheme.signatures(t)), (p, q, n)
                m = (q - p) * len(s) // (q + p)  # so many exchanged
                u = np.unique(np.concatenate([np.delete(s, r.choice(len(s), m, replace=False)), r.integers(0, 2**63, m, dtype="u8")]))
                assert m == 0 or set(scheme.signatures(s)) & set(scheme.signatures(u)), (p, q, n)
                assert np.bitwise_count((ngram_join.sketch(s) ^ ngram_join.sketch(t)).view("u8")).sum() <= k


def plain_pieces(text):
    """The cutting rule word by word: (start, end, words) of each piece."""
    import re

    import xxhash

    out, sentence = [], []
    words = []  # letters of writings without spaces are words of their own
    for m in re.finditer(r"\S+\s*", text):
        parts = re.split("([\u3041-\u30ff\u4e00-\u9fff\u0e01-\u0e5b])", m[0].rstrip())
        at = m.start()
        for part in filter(None, parts):
            words.append((at, at + len(part), part))
            at += len(part)
        words[-1] = (words[-1][0], m.end(), words[-1][2] + text[at : m.end()])

    def close():
        rank = [xxhash.xxh3_64_intdigest(w.strip().lower().encode()) & ~1 | (w.strip()[-1] in ".!?。！？") for _, _, w in sentence]
        piece = []
        for i, (_, end, w) in enumerate(sentence):
            piece.append(w.strip().lower())
            inside = 3 <= i < len(sentence) - 3
            if inside and rank[i] == min(rank[i - 3 : i + 4]) or i + 1 == len(sentence):
                out.append((out[-1][1] if out else 0, end, piece))
                piece = []
        sentence.clear()

    for word in words:
        sentence.append(word)
        if word[2].strip()[-1] in ".!?。！？" or "\n" in word[2]:
            close()
    if sentence:
        close()
    return out


def plain_dedup(rows):
    """Removed characters by (id, text), every run of pieces compared word by word."""
    import re

    seen, out = {}, {}
    for i, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = plain_pieces(text)
        for k in range(len(parts)):
            n, words = 0, []
            size = lambda: sum(0.5 if re.fullmatch("[\u3041-\u30ff\u4e00-\u9fff\u0e01-\u0e5b]", w) else 1 for w in words)  # noqa: B023, E731
            while k + n < len(parts) and (n < 3 or size() < 20):
                words += parts[k + n][2]
                n += 1
            if n >= 3 and size() >= 20 and seen.setdefault(tuple(words), (i, text, k)) != (i, text, k):
                out.setdefault((i, text), set()).update(x for a, b, _ in parts[k : k + n] for x in range(a, b))
    return out


def test_texts_without_spaces(spark):
    """A copied passage of Chinese goes wherever it stands; an insertion into 5,000 characters without spaces leaves most leaves alike."""
    r = random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 2500)]
    some = lambda n: "".join(r.choices(letters, k=n))
    sentences = lambda n: "".join(some(r.randint(5, 30)) + r.choice("。！？") for _ in range(n))
    passage = some(2000)
    spoken = sentences(40)
    texts = [some(300) + passage + some(100), sentences(5) + spoken + sentences(3), some(71) + passage + some(500), sentences(9) + "English words, too. " + spoken, "สวัสดีครับ" * 9 + passage[:900], sentences(60), some(900)]
    rows = [(i, x) for i, x in enumerate(texts)]
    want = plain_dedup(rows)
    got = {x.doc_id: x for x in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        assert got[i].text == "".join(c for k, c in enumerate(x) if k not in want.get((i, x), set()))
    assert len(got[2].text) < 71 + 500 + 60 and len(got[3].text) < len(texts[3]) - len(spoken) + 60 and got[5].text == texts[5] and got[6].text == texts[6]
    for text in (some(5000), sentences(300)[:5000], "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=5000)), "".join(r.choices("0123456789", k=5000)), "あ" * 5000):
        other = text[:50] + "x" + text[50:]
        x, y = merkle.fingerprint(text), merkle.fingerprint(other)
        assert merkle.likeness(x, y) > 0.9 and "".join(merkle.leaves(text)) == text
        assert sum(v - u for _, _, u, v in merkle.differing(x, y)) < 450


def test_substring_dedup(spark, docs, texts):
    passage = "This passage has several sentences of its own. They are repeated in other documents. The second copy of all of them must go, while the first one stays. It has more than fifty words, so that a person would call it a copied passage and not a chance. Here it ends, after some more words."
    more = [(500, "Own start here. " + passage + " Own end.", "en", "s", 1), (501, "Another start.\n" + passage + "\nAnother end.", None, None, None), (501, "Another start.\n" + passage + "\nAnother end.", None, None, None), (None, passage, "x", "y", 2), (502, texts[4] + "\n" + texts[4] + " " + texts[6], "a", "b", 1)]
    table = docs.union(spark.createDataFrame(more, DOCS))
    got = substring_dedup.dedup(table).collect()
    assert len(got) == len(texts) + len(more)
    by = {r.doc_id: r for r in got}
    nameless = by[None]  # null ids sort first
    assert nameless.text == passage and nameless.removed is None
    assert by[500].text == "Own start here. Own end." and by[501].text == "Another start.\nAnother end."
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in more]
    want = plain_dedup(rows)
    for i, t in rows:
        went = want.get((i, t), set())
        assert by[i].text == (t if t is None else "".join(c for k, c in enumerate(t) if k not in went)), i
        assert {k for x in by[i].removed or [] for k in range(x.start, x.end)} == went
    assert sum(map(bool, want.values())) > 5
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_substring_dedup_hot_spans(spark, monkeypatch):
    """Spans of very many documents, dealt out over several tasks, have the same first."""
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdeiourst", k=r.randint(3, 9))) for _ in range(500)]
    run = lambda n: " ".join(r.choices(vocab, k=n))
    shared = run(60)
    rows = [(i, f"{run(9)}. {shared}. {run(12)}.") for i in range(400)] + [(i, run(40)) for i in range(400, 500)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = {x.doc_id: x.text for x in substring_dedup.dedup(table).collect()}
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 64)
    assert substring_dedup.hot_spans(table.selectExpr("doc_id as id", "xxhash64(text) as th", "text")).filter("parts > 1").count() > 3
    assert {x.doc_id: x.text for x in substring_dedup.dedup(table).collect()} == plain
    want = plain_dedup(rows)
    assert plain == {i: "".join(c for k, c in enumerate(t) if k not in want.get((i, t), set())) for i, t in rows}


def test_passages_at_any_offset(spark):
    """Passages of 55 words without full stops go wherever they stand in a long sentence; so do sentences whose neighbours lost their stop."""
    r = random.Random(11)
    vocab = ["".join(r.choices("abcdeiourst", k=r.randint(3, 9))) for _ in range(2000)]
    run = lambda n: " ".join(r.choices(vocab, k=n))
    passages = [run(55) for _ in range(4)]
    rows = [(i, f"{run(7)} {p} {run(9)}") for i, p in enumerate(passages)]
    rows += [(100 + 20 * i + k, f"{run(k)} {p} {run(21 - k)}") for i, p in enumerate(passages) for k in range(1, 18)]
    rows += [(300, f"{run(15)}. {passages[3]}."), (301, run(200))]
    got = {x.doc_id: x for x in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        gone = "".join(text[x.start : x.end] for x in got[i].removed or [])
        if 100 <= i <= 300:
            assert len(gone.split()) >= 30 and gone.strip(" .") in passages[min((i - 100) // 20, 3)], i
        else:
            assert got[i].removed is None and got[i].text == text
    for text in ("", "  a b  ", "w " * 40, " \n".join([run(30), run(3)]), run(100)):
        assert "".join(text[a:b] for a, b in substring_dedup.sentences(text)) == text


def test_pipeline(spark, docs, texts, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    letters = {i * 3 for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert ids <= letters and 9 in ids and 120 not in ids and 123 not in ids  # copies of the fourth document go
    at = [dict(corpus_pipeline.STAGES)[n] for n in ("language_id", "ngram_jaccard", "substring_dedup")]
    for stage in at:
        assert stage(spark, empty(spark), "").columns == docs.columns
