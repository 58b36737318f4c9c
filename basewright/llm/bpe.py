"""BPE encoding and decoding.

The encoder reads a public tokenizer file and encodes words by the contiguous
rank array method: a word is a flat list of parts beside a flat list of the
ranks of adjacent parts.  The smallest rank is found by scanning, its boundary
is deleted and the two neighbouring ranks are looked up again.  Words are short,
so a scan of a small contiguous list beats a heap; words of more than
``LONG_WORD`` parts (no real word, but a text may hold one) go through a heap of
the same order, so cost stays O(n log n).

Cases: a null text encodes as an empty one (no ids, empty decoded text); the
strings of special tokens in a text become their ids; parts outside the
vocabulary give no id; texts of any length are read whole, words of any length included;
repeated rows and ids are encoded each; ``encode`` and ``decode`` keep every column, one named as their
output as ``<name>_input``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from itertools import chain

import pyarrow as pa

LONG_WORD = 200
#: Words of a generation of the cache in each Python worker.
CACHE_WORDS = 100_000
NO_RANK = 1 << 60


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes
    stand for themselves, the others count up from 256 in order."""
    spare = chain(range(256, 512))
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Words(dict):
    """Word -> its ids, filled on demand; it outlives a task, as words come again in the worker's next.

    Bounded by two generations of ``CACHE_WORDS``: when the young one is full it becomes the old one, whose words
    are taken up again when they are met, so that frequent words stay.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, word: str):
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Splitter:
    """Normalisation and word split of a tokenizer file.

    The tokenizers library's own normaliser and splitter do the work.  Its calls cost several
    times as much as the words' ids, so texts of Latin script (code points below U+0250, where
    the classes of the file's pattern are short) go through the standard module's regular
    expressions instead; the tests hold both equal over every code point.
    """

    def __init__(self, library):
        spec = json.loads(library.to_str())
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer[0].pre_tokenize_str
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or split["behavior"] != "Removed" or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("the tokenizer file asks for steps that are not supported")
        pattern = split["pattern"]["Regex"].replace(r"[\p{L}]", f"[{LATIN_LETTERS}]").replace(r"[\p{N}]", f"[{LATIN_NUMBERS}]").replace(r"\p{L}\p{N}", LATIN_LETTERS + LATIN_NUMBERS).replace(r"\s", LATIN_SPACES)
        self.find = re.compile(pattern).findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def words(self, text: str) -> list[str]:
        if beyond_latin(text):
            return [x for x, _ in self.split(self.normalize(text))]
        return self.find(text.lower())

    def parts(self, text: str) -> list[str]:
        """Texts between special tokens at even places, special tokens at odd ones."""
        if self.cut is None or not any(x in text for x in self.special):
            return [text]
        return self.cut(text)


def plain(word: str) -> bool:
    """Every byte of the word stands for itself in the byte alphabet."""
    return word.isascii() and word.isprintable()


#: Classes below U+0250 and of what lower-casing makes of them (U+0307, of U+0130, is neither letter nor number).
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
beyond_latin = re.compile("[^\x00-\u024f]").search


def open_library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class LibraryBpe:
    """Ids by the tokenizers library: whole texts by its ``encode``; in Latin texts, where words can be told
    apart cheaply, each different word once."""

    def __init__(self, path: str):
        self.library = open_library(path)
        self.splitter, self.alphabet = Splitter(self.library), byte_alphabet()
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.cache = Words(self.encode_word)

    @staticmethod
    def packed(ids) -> bytes:
        """Ids as the cache keeps them: 4 little-endian bytes each."""
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_word(self, word: str) -> bytes:
        text = word if plain(word) else "".join([self.alphabet[b] for b in word.encode()])
        return self.packed([t.id for t in self.library.model.tokenize(text)])

    def by_words(self, text: str) -> list:
        """The ids of every word and special token, each as the cache keeps them."""
        parts, s = self.splitter.parts(text), self.splitter
        out = list(map(self.cache.__getitem__, s.words(parts[0])))
        for mark, part in zip(parts[1::2], parts[2::2]):
            out.append(self.packed([s.special[mark]]))
            out += map(self.cache.__getitem__, s.words(part))
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of 4 little-endian bytes each."""
        if not text:
            return b""
        if beyond_latin(text):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(self.by_words(text))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_bytes(text)).cast("I").tolist()


class RankArrayBpe(LibraryBpe):
    """Encoder and decoder for one tokenizer file: the library's words, their ids by rank arrays."""

    packed = tuple

    def __init__(self, path: str):
        super().__init__(path)
        model = json.loads(self.library.to_str())["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.rank[self.vocab[a] << 16 | self.vocab[b]] = len(self.made)
            self.made.append(self.vocab[a + b])
        if max(self.vocab.values()) >= 1 << 16:
            raise ValueError("pair keys hold two ids of 16 bits")
        self.tokens = [""] * (1 + max(*self.vocab.values(), *self.splitter.special.values()))
        for t, i in chain(self.vocab.items(), self.splitter.special.items()):
            self.tokens[i] = t

    def encode_word(self, word: str) -> tuple[int, ...]:
        chars = list(word) if plain(word) else [self.alphabet[b] for b in word.encode()]
        chars[-1] += self.end
        ids = [i for i in map(self.vocab.get, chars) if i is not None]
        return tuple(ids if len(ids) < 2 else self.scan(ids) if len(ids) <= LONG_WORD else self.heap(ids))

    def scan(self, ids: list[int]) -> list[int]:
        get, made = self.rank.get, self.made
        ranks = [get(a << 16 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        n = len(ranks)
        while n and (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            n -= 1
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | new, NO_RANK)
            if i < n:
                ranks[i] = get(new << 16 | ids[i + 1], NO_RANK)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        """The same merges in the same order for a word of any length."""
        get, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (s := get(ids[x] << 16 | ids[y], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.by_words(text))) if text else []

    def decode(self, ids) -> str:
        """Tokens joined by spaces: the file declares no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, ids))


_coders: dict = {}


def coder(path: str, kind=RankArrayBpe):
    """One coder for each tokenizer file and Python worker."""
    if (kind, path) not in _coders:
        _coders[kind, path] = kind(path)
    return _coders[kind, path]


def encode(df, text_col: str = "text", ids_col: str = "ids", path: str | None = None):
    """``df`` with a column of token ids (array<int>) for every row's whole text."""
    return _mapped(df, text_col, ids_col, "array<int>", path or default_path(), lambda c, x: c.encode(x))


def decode(df, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None):
    """``df`` with the text of its token ids; null ids give an empty text."""
    return _mapped(df, ids_col, text_col, "string", path or default_path(), lambda c, x: c.decode(x or []))


def _mapped(df, col: str, out: str, kind: str, path: str, f):
    from pyspark.sql import functions as F

    from .common import set_aside, small_batches

    @F.arrow_udf(kind)
    def apply(xs: pa.Array) -> pa.Array:
        c = coder(path)
        return pa.array([f(c, x.as_py()) for x in xs], pa.string() if kind == "string" else pa.list_(pa.int32()))

    return set_aside(small_batches(df), *[out] * (out.lower() != col.lower())).withColumn(out, apply(F.col(col)))


def round_trip(df, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Digest of each row's ids and of their decoded text, one pass, no shuffle.

    One row for each row of ``df``: the id, n_tokens, ids_sha256 (of the decimal
    ids joined by spaces), decoded_sha256.  Only the two columns it needs are
    read; repeated rows give repeated results.
    """
    from .common import at_rest, small_batches

    path = path or default_path()

    def run(batches):
        c = coder(path)
        shown = [str(i) for i in range(len(c.tokens))].__getitem__
        for b in batches:
            n, a, d = [], [], []
            for text in b.column(1):
                ids = c.encode(text.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        at_rest()

    kind = dict(df.dtypes)[id_col]
    return small_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
