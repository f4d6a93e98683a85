"""Byte-level BPE encoding and decoding by speculate-and-verify.

A word is first cut greedily: the longest vocabulary entry at each place (an Aho-Corasick automaton over all new words of a
batch). That proposal is what merging would give exactly when no merge could have crossed any boundary between adjacent
tokens, so every adjacent pair is tested with array operations over the two tokens' merge histories. Only words with a
failing pair are merged step by step. Results per distinct word are kept in a bounded cache of each Python worker.

Cases: null text counts as empty; empty text gives no tokens; special tokens found in a text become their own ids, as the
tokenizers library does; very long texts are encoded whole; repeated rows give repeated results; extra columns are ignored by
the query and kept by encode(); an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# The split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Ranges of letters and digits newer than Unicode 16, the version by which the tokenizers library splits (there
# they are neither letter nor digit).
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Bytes of distinct words and their tokens that a worker keeps; beyond it the cache starts anew, which costs time and changes
#: no result. Longer words than the second are never kept.
CACHE_BYTES, KEPT_WORD = 160_000_000, 256
#: Words longer than this are cut and merged on their own, outside the automaton's batch.
LONG_WORD = 4_000
_NEVER = np.int64(1) << np.int64(40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary, merges and special tokens of a tokenizer file, with the encoder and the decoder. Without specials their
    strings are plain text."""

    def __init__(self, path: str, specials: bool = True) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.alphabet = byte_alphabet()
        self.to_shown = {i: c for i, c in enumerate(self.alphabet)}
        to_byte = {c: i for i, c in enumerate(self.alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.special_cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.split = regex.compile(SPLIT)
        newer = "[" + "".join("-".join(rf"\U{x:0>8}" for x in r.split("-")) for r in NEWER.split()) + "]"
        self.newer = regex.compile(newer)
        old = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{newer})")
        self.split_newer = regex.compile(regex.sub(r" \?\\p\{([LN])\}\+", lambda m: rf" ?(?:(?!{newer})\p{{{m[1]}}})+", old))
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.piece: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.piece[i] = token.encode()
        self.vocab = vocab
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.merged_array = np.array(self.merged, np.int64)
        self.byte_id = np.array([vocab[c] for c in self.alphabet], np.int64)
        self.words = ahocorasick.Automaton()
        # Entries that no merge forms can't come out of merging, so they are not proposed.
        formed = np.full(size, -1, np.int64)
        halves = np.full((size, 2), -1, np.int64)
        for r, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if formed[i] < 0:
                formed[i], halves[i] = r, (vocab[a], vocab[b])
        for token, i in vocab.items():
            if len(token) == 1 or formed[i] >= 0:
                self.words.add_word(token, i)
        self.words.make_automaton()
        self.formed = formed
        self.right, self.left = self._spine(halves, 1), self._spine(halves, 0)
        pairs = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_rank, self.size = pairs[order], order.astype(np.int64), size
        self.byte_rank = self._ranks(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(256, 256)
        self.seen: dict[str, str] = {}
        self.held = 0

    @staticmethod
    def _spine(halves: np.ndarray, side: int) -> np.ndarray:
        """For each token: itself, its outer half on that side, that one's half, ...; -1 after the last."""
        rows = [np.arange(len(halves))]
        while (rows[-1] >= 0).any():
            rows.append(np.where(rows[-1] >= 0, halves[rows[-1], side], -1))
        return np.stack(rows[:-1], axis=1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the boundary between tokens a and b: no pair (x, y) that ever faces the boundary has a
        merge that comes while both x and y are there, i.e. after they are formed and before the tokens around them are."""
        ok = np.ones(len(a), dtype=bool)
        right, left = self.right[a], self.left[b]
        for i in range(right.shape[1]):
            x = right[:, i]
            if not (x >= 0).any():
                break
            x_gone = self.formed[right[:, i - 1]] if i else np.full(len(a), _NEVER)
            for j in range(left.shape[1]):
                y = left[:, j]
                live = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(live):
                    break
                key = x[live] * self.size + y[live]
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                hit = self.pairs[at] == key
                if hit.any():
                    live, rank = live[hit], self.pair_rank[at[hit]]
                    y_gone = self.formed[left[live, j - 1]] if j else np.full(len(live), _NEVER)
                    # Equal ranks go leftmost first: the token around x is formed before, the one around y after.
                    crosses = (rank > self.formed[x[live]]) & (rank > self.formed[y[live]]) & (rank < x_gone[live]) & (rank <= y_gone)
                    ok[live[crosses]] = False
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one long word: the lowest rank first, leftmost on ties, from a heap."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (s := rank.get((ids[p], ids[i]))) is not None:
                heapq.heappush(heap, (s, p, ids[p], ids[i]))
        return [t for t in ids if t >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges; _NEVER where it does not."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], _NEVER)

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of short words side by side: each round makes the best merge of every word that still has one."""
        n, width = len(words), max(map(len, words)) + 1
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        value = np.zeros((n, width), np.uint8)
        value[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(inside, self.byte_id[value], -1)
        rank = np.where(inside[:, 1:], self.byte_rank[value[:, :-1], value[:, 1:]], _NEVER)
        live, columns = np.arange(n), np.arange(width)
        while len(live):
            best = rank[live].argmin(axis=1)
            least = rank[live, best]
            on = least < _NEVER
            live, best, least = live[on], best[on], least[on]
            if not len(live):
                break
            row, closed = ids[live], np.minimum(columns + (columns > best[:, None]), width - 1)
            row = np.take_along_axis(row, closed, axis=1)
            row[:, -1] = -1
            row[np.arange(len(live)), best] = self.merged_array[least]
            ids[live] = row
            ranks = np.take_along_axis(rank[live], np.minimum(columns[:-1] + (columns[:-1] >= best[:, None]), width - 2), axis=1)
            ranks[:, -1] = _NEVER
            k = np.arange(len(live))
            ranks[k, best] = self._ranks(row[k, best], row[k, np.minimum(best + 1, width - 1)])
            has = best > 0
            ranks[k[has], best[has] - 1] = self._ranks(row[k[has], best[has] - 1], row[k[has], best[has]])
            rank[live] = ranks
        counts = (ids >= 0).sum(axis=1).tolist()
        return [row[:c] for row, c in zip(ids.tolist(), counts, strict=True)]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of failing words, similar lengths together and a bounded number at once."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted((len(w), i) for i, w in enumerate(words))
        start = 0
        while start < len(order):
            top = max(8, order[start][0] * 3 // 2)
            end = start
            while end < len(order) and order[end][0] <= top and end - start < 20_000:
                end += 1
            picked = [i for _, i in order[start:end]]
            done = self.merge_short([words[i] for i in picked]) if top <= 64 else [self.merge(words[i]) for i in picked]
            for i, ids in zip(picked, done, strict=True):
                out[i] = ids
            start = end
        return out

    def propose(self, shown: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: token ids, and how many tokens each word got."""
        hits = np.fromiter(chain.from_iterable(self.words.iter_long("\n".join(shown))), dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)) + 1) - 1
        return hits[:, 1], np.diff(np.searchsorted(hits[:, 0], ends), prepend=0)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words, one word after the other, and how many each has."""
        data = [w.encode() for w in words]
        long = {i for i, d in enumerate(data) if len(d) > LONG_WORD}
        shown = [d.decode("latin-1").translate(self.to_shown) if len(d) <= LONG_WORD else "" for d in data]
        ids, counts = self.propose(shown)
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        distinct, back = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        fails = ~self.compatible(distinct // self.size, distinct % self.size)[back]
        bad = sorted(set(owner[inner[fails]].tolist()) | long)
        if not bad:
            return ids, counts
        merged = self.merge_all([data[i] for i in bad])
        failed = np.zeros(len(words), bool)
        failed[bad] = True
        proposed = ids[~failed[owner]]
        counts = counts.copy()
        counts[bad] = [len(m) for m in merged]
        out = np.empty(counts.sum(), np.int64)
        exact = np.repeat(failed, counts)
        out[~exact] = proposed
        out[exact] = np.fromiter(chain.from_iterable(merged), np.int64)
        return out, counts

    def learn(self, words: list[str]) -> None:
        """Put the tokens of new words into the cache, as decimal ids joined by commas."""
        ids, counts = self.tokens(words)
        text = list(map(str, ids.tolist()))
        ends = np.cumsum(counts)
        self.seen.update(zip(words, [",".join(text[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], strict=True))

    def cut(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        split = self.split if text.isascii() or not self.newer.search(text) else self.split_newer
        out, at = [], 0
        for m in self.special_cut.finditer(text):
            out += split.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + split.findall(text[at:]) if at else split.findall(text)

    def encode_batch(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        if self.held > CACHE_BYTES or not self.held:
            self.seen, self.held = {s: str(i) for s, i in self.special.items()}, 1
        parts = [self.cut(t) for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.seen))
        if new:
            self.learn(new)
        out = [",".join(map(self.seen.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > KEPT_WORD:
                del self.seen[w]
            else:
                self.held += 2 * len(w) + len(self.seen[w]) + 200
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids: their bytes in a row, read as UTF-8."""
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ids(joined: str) -> np.ndarray:
    return np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.empty(0, np.int32)


def _batches(texts: pd.Series, most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in groups of bounded size, nulls as empty."""
    group, held = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if group and held + len(t) > most_chars:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """docs with a column of token ids added (replacing one of that name)."""
    path = vocabulary or default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in frames:
            joined = [j for g in _batches(f[text]) for j in bpe.encode_batch(g)]
            yield f.drop(columns=[out], errors="ignore").assign(**{out: [_ids(j) for j in joined]})

    kept = [f for f in docs.schema.fields if f.name != out]
    return docs.mapInPandas(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(tokens: DataFrame, vocabulary: str | None = None, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """tokens with a column of decoded text added (replacing one of that name); null ids count as none."""
    path = vocabulary or default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in frames:
            yield f.drop(columns=[out], errors="ignore").assign(**{out: ["" if x is None else bpe.decode(np.asarray(x, np.int64)) for x in f[ids]]})

    kept = [f for f in tokens.schema.fields if f.name != out]
    return tokens.mapInPandas(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode every text, decode the ids again, and keep digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary or default_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in frames:
            rows = []
            for group in _batches(f["text"]):
                for joined in bpe.encode_batch(group):
                    ids = _ids(joined)
                    rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoding and decoding of every document."""
    return round_trip(table(spark, sf_dir, "documents"))
