"""op7: BPE by prefix-sharing trie traversal.

The distinct pre-tokens of a batch go into a trie. A prefix's encoding ends in exactly one token: the one that is a
suffix of the prefix and may follow the last token of what stands before it. A depth-first walk carries those last
tokens down, so a prefix that many words share is worked out once, and a word's ids are read back along its path.

Whether token b may follow token a is decided by their merge histories: the pair splits only if no merge across
their border comes due while both of its sides exist. A prefix's last token is looked for among the characters that the longest token
covers, so work and memory are linear in a word's length; a word of over LONG characters is a trie of one branch and is walked without nodes,
nor is it remembered after its batch.

A null text counts as empty; a null doc_id stays null. Repeated rows are answered each. Texts of any length go through whole. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .common import LONG, STRING, hold, schema, table

#: Bounds of a worker's memory: bytes of words kept (a word's strings and what holds them), border decisions kept, characters in one trie.
BYTES, ENTRY, BORDERS, TRIE_CHARS = 280_000_000, 360, 400_000, 400_000
#: Words longer than this are walked without a trie and not kept.
LONG_WORD = 1024
FOREVER = 1 << 60


class BpeTrie:
    """Encoder and decoder of a BPE vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: when it is made, of what
        for r, (a, b) in enumerate(model["merges"]):
            a, b, c = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[a, b] = r
            self.parts.setdefault(c, (r, a, b))
        self.tails: dict[str, int] = {}  # ends of tokens: the token's id if it is one itself, else -1
        for t in self.vocab:
            body, end = (t[: -len(self.suffix)], self.suffix) if t.endswith(self.suffix) else (t, "")
            for k in range(len(body)):
                self.tails.setdefault(body[k:] + end, -1)
            self.tails[t] = self.vocab[t]
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.borders: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stand at a token's right (or left) edge while it is built, each with the rank that ends it."""
        if (got := self.edges.get((token, right))) is None:
            got, until, t = [], FOREVER, token
            while True:
                got.append((t, until))
                if t not in self.parts:
                    break
                until, a, b = self.parts[t]
                t = b if right else a
            self.edges[token, right] = got
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """True if encoding the joined texts of a and b gives just these two."""
        if (got := self.borders.get((a, b))) is None:
            got, rank = True, self.rank
            for x, x_until in self._edge(a, True):
                for y, y_until in self._edge(b, False):
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:  # at equal rank the left pair merges first
                        got = False
                        break
                if not got:
                    break
            if len(self.borders) >= BORDERS:
                self.borders.clear()
            self.borders[a, b] = got
        return got

    def _last(self, window: str, depth: int, last: Sequence[int], end: str) -> tuple[int, int]:
        """The last token of a prefix + end and how many of its characters it covers. The prefix is ``depth`` characters long and ends in
        ``window``, as many as a token can cover; last[d]: the last token of its first d characters."""
        tails, n = self.tails.get, len(window)
        text = window + end
        found = []
        for at in range(n - 1, -1, -1):
            if (i := tails(text[at:])) is None:
                break
            found.append(i)
        borders = self.borders.get
        for k in range(len(found), 0, -1):
            if (i := found[k - 1]) >= 0:
                if k == depth:
                    return i, k
                ok = borders((last[depth - k], i))
                if ok or ok is None and self.may_follow(last[depth - k], i):
                    return i, k
        raise ValueError("no token ends this text")

    def encode_long(self, word: str) -> Sequence[int]:
        """One pre-token -> ids: a trie of a single branch."""
        last, size, most = array("i", [-1]), array("H", [0]), self.longest
        for d in range(1, len(word)):
            t, k = self._last(word[max(0, d - most) : d], d, last, "")
            last.append(t)
            size.append(k)
        t, k = self._last(word[-most:], len(word), last, self.suffix)
        return self._back(t, len(word) - k, last, size)

    @staticmethod
    def _back(token: int, d: int, last: Sequence[int], size: Sequence[int]) -> Sequence[int]:
        """The ids that end in ``token``, which stands behind d characters."""
        ids = array("i", [token])
        while d:
            ids.append(last[d])
            d -= size[d]
        return ids[::-1]

    def encode_words(self, words: Iterable[str]) -> dict[str, Sequence[int]]:
        """Byte-level pre-tokens -> ids."""
        was = gc.isenabled()
        gc.disable()  # a trie has many small dicts and no cycles
        try:
            return self._walk(words)
        finally:
            if was:
                gc.enable()

    def _walk(self, words: Iterable[str]) -> dict[str, Sequence[int]]:
        root: dict = {}
        for w in words:
            node = root
            for c in w:
                if (child := node.get(c)) is None:
                    child = node[c] = {}
                node = child
            node[""] = w
        out: dict[str, Sequence[int]] = {}
        last, size, most = [-1], [0], self.longest
        todo = [(root, "", 0)]
        while todo:
            node, window, depth = todo.pop()
            # the parent wrote entries up to depth - 1; this prefix adds its own
            del last[depth:], size[depth:]
            if not depth:
                last, size = [-1], [0]
            if (word := node.get("")) is not None:  # the whole word: its last character carries the suffix
                t, k = self._last(window, depth, last, self.suffix)
                out[word] = self._back(t, depth - k, last, size)
            if depth and len(node) > (word is not None):
                t, k = self._last(window, depth, last, "")
                last.append(t)
                size.append(k)
            tail = window if len(window) < most else window[1:]
            for c, child in node.items():
                if c:
                    todo.append((child, tail + c, depth + 1))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode without a decoder: the tokens' strings, joined by a space."""
        text = self.text
        return " ".join([text[i] for i in ids])


class Rendered(dict):
    """pre-token (byte-level) -> number of ids, decimal ids, tokens' strings, the latter two joined by spaces."""

    def __init__(self, path: str):
        self.bytes, self.passing = 0, []
        self.trie = BpeTrie(path)
        self.plain = wordbpe.WordIds(path)
        self.chars = wordbpe.byte_chars()
        self.pre, self.norm = self.plain.whole.pre_tokenizer, self.plain.whole.normalizer

    def pieces(self, text: str | None) -> list[str]:
        """Pre-tokens as the library cuts them; the special tokens' strings stay whole."""
        if not text:
            return []
        if not wordbpe.odd(text):
            return wordbpe.PIECES.findall(text.lower())
        out = []
        for k, run in enumerate(self.trie.split_added.split(text) if self.trie.split_added else [text]):
            if k % 2:
                out.append("\0" + run)
            elif run:
                out += ["\1" + p for p, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(run))]
        return out

    def learn(self, words: set[str]) -> None:
        """Makes all of these words known; long ones of earlier calls, and all earlier words once they fill the memory, are forgotten."""
        for w in self.passing:
            del self[w]
        self.passing = []
        if self.bytes > BYTES:
            self.clear()
            self.bytes = 0
        mapped: dict[str, str] = {}
        size = 0
        for w in words:
            if w in self:
                continue
            if w[0] == "\0":
                i = self.trie.added[w[1:]]
                self[w] = (1, str(i).encode(), w[1:].encode())
                continue
            m = w[1:] if w[0] == "\1" else w if w.isascii() else w.encode().decode("latin-1").translate(self.chars)
            if len(m) > LONG_WORD:
                self[w] = self._render(self.trie.encode_long(m))
                self.passing.append(w)
                continue
            mapped[w] = m
            size += len(m)
            if size >= TRIE_CHARS:
                self._encode(mapped)
                mapped, size = {}, 0
        self._encode(mapped)

    def _render(self, ids: Sequence[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), self.trie.decode(ids).encode()

    def _encode(self, mapped: dict[str, str]) -> None:
        ids = self.trie.encode_words(mapped.values())
        for w, m in mapped.items():
            own = self[w] = self._render(ids[m])
            self.bytes += ENTRY + len(w) + len(own[1]) + len(own[2])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hold(("trie", path), lambda: Rendered(path))
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(docs), 1000):
                cut, new = [known.pieces(t.as_py()) for t in texts.slice(at, 1000)], set()
                for words in cut:
                    new.update(words)
                known.learn(new)
                n, ids, text = [], [], []
                for words in cut:
                    own = list(map(known.__getitem__, words))
                    n.append(sum([x[0] for x in own]))
                    ids.append(hashlib.sha256(b" ".join([x[1] for x in own])).hexdigest())
                    text.append(hashlib.sha256(b" ".join([x[2] for x in own])).hexdigest())
                yield pa.RecordBatch.from_arrays([docs.slice(at, 1000), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_digests(path or wordbpe.default_path()), schema(doc_id=LONG, n_tokens=LONG, ids_sha256=STRING, decoded_sha256=STRING))


def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
