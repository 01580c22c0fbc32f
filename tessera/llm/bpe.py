"""BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

A word is a row of symbols; the leaves of its tree hold rank * leaves + position of the pair that starts at
each symbol, an inner node the smaller of its children, so the root is the leftmost lowest-rank merge.  A merge changes three
leaves, each updated on its path to the root, until the root says that no pair merges.

Words of up to 64 symbols are merged many at a time: their trees are the rows of one array and
each step applies every word's own root merge.  Longer words have a tree of their own.  Words repeat, so a
bounded cache of encoded words, kept by the Python worker, spares most of the work.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.text import text_chunks

NO_PAIR = np.int64(1) << 40
CACHE_WORDS = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        self.normal_form = next((s["type"] for s in steps if s["type"] in ("NFC", "NFD", "NFKC", "NFKD")), None)
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.texts = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.texts[i] = token
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        self.last_id = np.array([vocab[s + end] for s in symbols], np.int64)
        self.width = len(self.texts)
        keys, merged = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] * self.width + vocab[b])
            merged.append(vocab[a + b])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array(merged, np.int64)  # by rank
        self.cache: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    # -- merging ------------------------------------------------------------------------------
    def _merge_rows(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Encode words of at most ``leaves`` bytes, one segment tree a row."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        sym = self.byte_id[flat]
        rows = np.arange(n)
        sym[rows, size - 1] = self.last_id[flat[rows, size - 1]]
        place = np.arange(leaves)
        alive = place < size[:, None]
        nxt = np.broadcast_to(place + 1, (n, leaves)).copy()
        prv = np.broadcast_to(place - 1, (n, leaves)).copy()
        tree = np.full((n, 2 * leaves), NO_PAIR * leaves, np.int64)
        rank = self.pair_ranks(sym[:, :-1], sym[:, 1:])
        rank[~alive[:, 1:]] = NO_PAIR
        tree[:, leaves:-1] = rank * leaves + place[:-1]
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        last = NO_PAIR * leaves
        act = np.flatnonzero(tree[:, 1] < last)
        while len(act):
            root = tree[act, 1]
            i = root % leaves
            j = nxt[act, i]
            sym[act, i] = self.merged[root // leaves]
            alive[act, j] = False
            after = nxt[act, j]
            nxt[act, i] = after
            has = after < size[act]
            prv[act[has], after[has]] = i[has]
            self._update(tree, act, j, np.full(len(act), last), leaves)
            right = sym[act, np.minimum(after, leaves - 1)]
            fresh = np.where(has, self.pair_ranks(sym[act, i], right) * leaves + i, last)
            self._update(tree, act, i, fresh, leaves)
            before = prv[act, i]
            b = np.flatnonzero(before >= 0)
            if len(b):
                own, p = act[b], before[b]
                self._update(tree, own, p, self.pair_ranks(sym[own, p], sym[own, i[b]]) * leaves + p, leaves)
            act = act[tree[act, 1] < last]
        ids = sym[alive].astype("<u4")
        cut = np.concatenate(([0], np.cumsum(alive.sum(1)))) * 4
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    @staticmethod
    def _update(tree, rows, leaf, value, leaves) -> None:
        node = leaf + leaves
        tree[rows, node] = value
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def _merge_long(self, word: bytes) -> bytes:
        """Encode one word of any length with its own tree: O(n log n)."""
        n = len(word)
        leaves = 1 << (n - 1).bit_length()
        code = np.frombuffer(word, np.uint8)
        start = self.byte_id[code]
        start[-1] = self.last_id[code[-1]]
        none = int(NO_PAIR) * leaves
        base = np.full(leaves, none, np.int64)
        base[:n - 1] = self.pair_ranks(start[:-1], start[1:]) * leaves + np.arange(n - 1)
        base[base >= none] = none
        levels = [base]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
        tree = [x.tolist() for x in levels]
        sym, nxt, prv = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

        def put(leaf: int, value: int) -> None:
            tree[0][leaf] = value
            for low, high in zip(tree, tree[1:], strict=False):
                leaf >>= 1
                smaller = min(low[2 * leaf], low[2 * leaf + 1])
                if high[leaf] == smaller:
                    return
                high[leaf] = smaller

        def pair(a: int, b: int) -> int:
            rank = ranks.get(sym[a] * self.width + sym[b])
            return none if rank is None else rank * leaves + a

        while (root := tree[-1][0]) < none:
            i = root % leaves
            j = nxt[i]
            sym[i] = int(self.merged[root // leaves])
            sym[j] = -1
            nxt[i] = nxt[j]
            put(j, none)
            if nxt[i] < n:
                prv[nxt[i]] = i
                put(i, pair(i, nxt[i]))
            else:
                put(i, none)
            if prv[i] >= 0:
                put(prv[i], pair(prv[i], i))
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    # -- texts --------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        if self.normal_form:
            text = unicodedata.normalize(self.normal_form, text)
        if self.lower:  # sign by sign, so a capital sigma ends no word specially
            text = text.replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def learn(self, words: set[str]) -> None:
        """Put the encodings of ``words`` into the cache."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            raw = w.encode()
            groups.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for leaves, group in groups.items():
            if leaves > 64:
                for w, raw in group:
                    self.cache[w] = self._merge_long(raw)
                continue
            for lo in range(0, len(group), 8192):
                part = group[lo:lo + 8192]
                coded = self._merge_rows([raw for _, raw in part], leaves)
                self.cache.update(zip((w for w, _ in part), coded, strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        for text in texts:
            pieces = self.split.split(text) if self.split and "<" in text else [text]
            parts.append([np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.words(p)
                          for p in pieces if p])
        self.learn({w for doc in parts for p in doc if isinstance(p, list) for w in p})
        get = self.cache.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in doc) for doc in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids``, special ones included, joined by one space (the file names no decoder)."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of ``path``, kept by the process with its cache of words."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """Encode each text of ``docs`` (doc_id, text) and decode it again.

    One row per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, ids (array) and decoded.
    Null texts read as empty: no tokens, an empty decoded text.  Other columns are ignored."""

    def run(batches):
        bpe = load(path)
        for part, texts in text_chunks(batches, size=1 << 20):
            coded = bpe.encode_batch([t.decode() for t in texts])
            decoded = [bpe.decode(c) for c in coded]
            cols = [part.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32())),
                         pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>, decoded string" * ids)
