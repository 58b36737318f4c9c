"""SimHash joins and fill-in-middle against plain versions, with dense clusters, awkward rows and columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from basewright.llm import fim, simhash

from .test_cases import CLASHING, SCHEMA, rows

LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def plain_components(vertices, k):
    """vertices: (id, fingerprint) pairs, ids may repeat; id -> smallest id reachable."""
    up = {i: i for i, _ in vertices}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    f = np.array([v for _, v in vertices], "u8")
    for n, (i, _) in enumerate(vertices):
        for m in np.flatnonzero(np.bitwise_count(f[:n] ^ f[n]) <= k):
            a, b = top(i), top(vertices[m][0])
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def plain_fim(doc_id, text, unit, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s)."}[unit]
    parts = re.findall(units, text)
    assert "".join(parts) == text
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(x in text for x in fim.MARKERS) or h3 % 100 >= rate:
        return len(parts), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_masks_and_budget():
    """The budget of some trie holds at every depth for any two fingerprints that are near enough."""
    r = random.Random(2)
    for _ in range(300):
        k = r.randint(0, 9)
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, k)))
        turned = [(diff << 16 * t | diff >> 64 - 16 * t) & (1 << 64) - 1 for t in range(4)]
        assert any(all((x >> 64 - depth).bit_count() <= simhash.budget(depth, k) for depth in range(65)) for x in turned)
    for c, k in ((0, 4), (5, 4), (16, 4), (18, 4), (6, 9)):
        got = simhash.masks(c, k).tolist()
        assert sorted(got) == [m for m in range(1 << c) if all((m >> c - d).bit_count() <= simhash.budget(d, k) for d in range(c + 1))]
        below = [x for m in simhash.masks(c, k) for x in simhash.masks(c + 2, k, int(m), c).tolist()]
        assert sorted(below) == sorted(simhash.masks(c + 2, k).tolist())


def leaves_of(r, spread, clusters=6, size=60, noise=300):
    out = {0, (1 << 64) - 1}
    for _ in range(clusters):
        centre = r.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, spread))) for _ in range(size)}
    return sorted(out | {r.getrandbits(64) for _ in range(noise)})


@pytest.mark.parametrize("k", [0, 1, 3, 4, 7])
def test_joined(k):
    for seed in range(4):
        v = np.array(leaves_of(random.Random(seed), 1 + 2 * seed), "u8")
        of = simhash.joined(v, 64, 0, 0, 0)
        assert (of == 0).all()
        # one trie alone leaves out pairs that another finds; all four together find every one
        pairs = [(int(v[i]), int(v[j])) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= k)]
        tied = []
        for t in range(4):
            w = np.sort(simhash.rotated(v, t))
            of = simhash.joined(w, k, 0, 0, 0)
            back = simhash.rotated(w, (4 - t) % 4)
            tied += [(int(a), int(back[c])) for a, c in zip(back, of) if a != back[c]]
        key = {int(x): n for n, x in enumerate(v)}
        components = lambda edges: _components(len(v), [(key[a], key[b]) for a, b in edges])
        assert components(tied) == components(pairs)


def _components(n, edges):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def test_links_over_crowded_nodes(spark, monkeypatch):
    """Deep and uneven cuts of the trie give the same components as all pairs."""
    monkeypatch.setattr(simhash, "LEAVES", 16)
    v = leaves_of(random.Random(9), 3, clusters=3, size=400, noise=500)
    signed = np.array(v, "u8").view("i8").tolist()
    leaves = spark.createDataFrame([(f, 10 * n, 1) for n, f in enumerate(signed)], "fp long, rep long, copies long")
    assert max(simhash._crowded(leaves, 7, 16).values()) > 2
    got = [(r.a // 10, r.b // 10) for r in simhash.links(leaves, 4).collect()]
    want = plain_components(list(enumerate(v)), 4)
    assert _components(len(v), got) == [want[n] for n in range(len(v))]


def test_dense_cluster_is_no_square():
    """A cluster of 60,000 different fingerprints is tied without meeting all of its 1.8 billion pairs."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    v = set()
    while len(v) < 60_000:
        v.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    met, plain = [0], np.bitwise_count

    def counted(x):
        met[0] += len(x)
        return plain(x)

    v = np.array(sorted(v), "u8")
    simhash.np.bitwise_count = counted
    try:
        of = simhash.joined(v, 4, 0, 0, 0)
    finally:
        simhash.np.bitwise_count = plain
    assert len(np.unique(of)) == 1 and met[0] < 60_000 * 600


def test_simhash_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = simhash.link(docs).collect()
    own = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    assert sorted((-1 if r.doc_id is None else r.doc_id, int(r.fingerprint, 16)) for r in got) == sorted((-1 if i is None else i, f) for i, f in own)
    want = plain_components([x for x in own if x[0] is not None], 4)
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert simhash.link(docs.limit(0)).count() == 0 and simhash.link(docs, width=2, k=0).count() == len(own)


def test_fim(spark):
    r = random.Random(5)
    texts = ["", "\n", "\n\n", "a", "a\n", "a\nb", " x  y\n", "é\n😀ß\r\n\n本", "has <M> in it", "<P", "<", "<S", "S>", "x<", "日本語のテキスト\n二行目"]
    texts += ["".join(r.choices("ab \n\té😀<PSM>", k=r.randint(1, 300))) for _ in range(300)]
    for i, text in enumerate(texts):
        for unit in ("line", "word", "char"):
            for rate, spm in ((100, 50), (60, 0), (100, 100)):
                got = fim.transformed(text.encode(), i, unit, rate, spm, 7, fim.checked(fim.MARKERS))
                want = plain_fim(i, text, unit, rate, spm)
                assert got == (*want[:4], want[4].encode())
                assert fim.restored(got[4], got[1], fim.checked(fim.MARKERS)) == text.encode()
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("<P>", "S<", "M")):
        with pytest.raises(ValueError):
            fim.checked(bad)
    with pytest.raises(ValueError):
        fim.starts(b"x", "page")


def test_place():
    r = random.Random(1)
    for n in [1, 2, 3, 7, 8, 63, 1000]:
        data = bytes(r.choices(b"a\n", k=n))
        bits = fim.starts(data, "line")
        want = [i for i in range(n) if i == 0 or data[i - 1] == 10]
        assert [fim.place(bits, k, n) for k in range(len(want) + 2)] == want + [n, n]


def test_fim_rows(spark):
    docs = spark.createDataFrame([(*r, "mine", "own") for r in rows()], SCHEMA + ", Form string, output string").repartition(3)
    done = fim.restore(fim.transform(docs))
    got = done.collect()
    assert len(got) == len(rows()) and all(r.restored == (r.text or "") for r in got)
    assert {c.lower() for c in done.columns} >= {"form_input", "output_input", "n_input", "form", "n"} and {r.Form_input for r in got} == {"mine"}
    assert sorted(tuple(r[c if c != "n" else "n_input"] for c in CLASHING) for r in got) == sorted(tuple(r[5:]) for r in rows())
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text, "line")
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0
