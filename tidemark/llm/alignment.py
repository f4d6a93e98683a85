"""Alignment of two tokenizers' tokens by byte-owner arrays: byte-level BPE (A) against a piece model with byte fallback (B).

Both tokenizers cut the same bytes (a space and the text). np.repeat writes, for each byte, the index of the A token and of
the B token that own it; wherever the pair of owners changes an overlap begins, and where both owners change at once lies a
cut. Cuts bound the groups; the A and B token that end at a cut are linked.

Neither tokenizer looks across a place where a non-space is followed by white space (other than CR), nor past a line feed that
stands alone before a non-space (this is checked on the model's pieces; else whole texts are taken), so texts fall into stretches there, each of which is aligned once
per worker and kept in a cache bounded by bytes. A linked pair ends together, so the shorter token's bytes end the longer's:
the pairs that can ever be linked are numbered from the two vocabularies alone. Their corpus-wide counts are hence a table
of bounded size (see Aligner.pairs), the only thing that is collected and broadcast.

Cases: null and empty texts, and texts whose A or B bytes differ from space and text (such as those that hold U+2581), have no
tokens, zeros and an empty string; strings of special tokens are plain text; very long texts are aligned whole; repeated rows
and null ids give rows of their own; extra columns are kept by align() (those named like its own are replaced) and ignored by
the query; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import materialize, scratch, table

#: Bytes of stretches and of their groups that a worker keeps; beyond it those used least go, which changes no result.
CACHE_BYTES, ENTRY_BYTES = 96_000_000, 400
#: Bytes of stretches that the piece model cuts in one call.
RUN_BYTES = 8_000
#: Rows whose links are looked up at once.
SCORED_ROWS = 500
#: Bytes of texts aligned at once.
BATCH_CHARS = 500_000
# Unicode's white space.
_SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"\n(?=[^{_SPACE}])|[{_SPACE}]*[^{_SPACE}]+(?:\r[{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")
_OWN = {"n_a": T.LongType(), "n_b": T.LongType(), "n_overlaps": T.LongType(), "groups": T.StringType(), "links": T.ArrayType(T.IntegerType())}


def owners(a_bytes: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the byte lengths of two tokenizations of the same bytes: the A and the B owner of each overlap, in order, and of
    each cut (the tokens that end there; the end of all bytes is a cut)."""
    a, b = np.repeat(np.arange(len(a_bytes)), a_bytes), np.repeat(np.arange(len(b_bytes)), b_bytes)
    if not len(a):
        return a, b, a, b
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    last = np.append(np.flatnonzero(new_a | new_b), len(a) - 1)
    cut = np.append(np.flatnonzero(new_a & new_b), len(a) - 1)
    return a[last], b[last], a[cut], b[cut]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, … of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _packed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, starts and the bytes of pieces in a row."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return n, np.cumsum(n) - n, np.frombuffer(b"".join(pieces), np.uint8)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Aligner:
    """Both tokenizers, the numbered pairs of tokens that can end together, and the aligned stretches seen so far."""

    def __init__(self, vocabulary: str, model: str) -> None:
        import sentencepiece

        self.a = bpe.Bpe(vocabulary, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        real = [not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)) for i in range(len(names))]
        self.b_piece = [b"" if not r else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, (p, r) in enumerate(zip(names, real, strict=True))]
        plain = [p.replace("▁", " ") for i, p in enumerate(names) if real[i] and not self.b.is_byte(i)]
        #: Whether no piece holds a line feed or goes on from a non-space to white space but CR: then stretches are independent.
        self.divides = not any("\n" in p or re.search(rf"[^{_SPACE}](?!\r)[{_SPACE}]", p) for p in plain) and self._plain("xé Ａ́\tﬁ")
        self.a_bytes, self.a_start, self.a_data = _packed(self.a.piece)
        self.b_bytes, self.b_start, self.b_data = _packed(self.b_piece)
        self.a_text = [np.array([f"{i}{end}" for i in range(len(self.a.piece))], object) for end in (",", "|")]
        self.b_text = [np.array([f"{i}{end}" for i in range(len(names))], object) for end in (",", ";")]
        self.keys = self._keys()
        self.reset()

    def _plain(self, text: str) -> bool:
        """Whether the piece model leaves characters as they are."""
        return b"".join(self.b_piece[i] for i in self.b.encode(text)) == b" " + text.encode()

    def _keys(self) -> np.ndarray:
        """A number for each pair (A token, B token) one of which ends with the other, in order: a * (B's size) + b."""
        by_a: dict[bytes, list[int]] = {}
        by_b: dict[bytes, list[int]] = {}
        for pieces, by in ((self.a.piece, by_a), (self.b_piece, by_b)):
            for i, p in enumerate(pieces):
                if p:
                    by.setdefault(p, []).append(i)
        size = len(self.b_piece)
        found = {i * size + j for i, p in enumerate(self.a.piece) for k in range(len(p)) for j in by_b.get(p[k:], ())}
        found |= {i * size + j for j, p in enumerate(self.b_piece) for k in range(len(p)) for i in by_a.get(p[k:], ())}
        return np.array(sorted(found), np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B ids of each numbered pair; there are at most as many as the tokens of both vocabularies have suffixes
        (times two for B, where a byte can also be a piece)."""
        return self.keys // len(self.b_piece), self.keys % len(self.b_piece)

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.group_text: list[str | None] = []
        self.held = 0
        self.stat = np.zeros((4, 1024), np.int64)  # A tokens, B tokens, overlaps, links
        self.link_start, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.links, self.n_links = np.zeros(4096, np.int32), 0

    def _size(self, texts: list[str], groups: list[str]) -> int:
        return sum(map(len, texts)) + sum(map(len, groups)) + ENTRY_BYTES * len(texts)

    def shrink(self) -> None:
        """Keep the stretches that were used most, up to half of the room."""
        texts, n = list(self.code), len(self.code)
        used, least = self.used[:n], 2
        while True:
            kept = np.flatnonzero(used >= least)
            groups = [self.group_text[k] for k in kept]
            names = [texts[k] for k in kept]
            if self._size(names, groups) <= CACHE_BYTES // 2:
                break
            least *= 2
        stat, links, counts = self.stat[:, kept], self.links[_ranges(self.link_start[kept], self.stat[3, kept])], used[kept] // 2
        self.reset()
        self._keep(names, groups, stat, links)
        self.used[: len(names)] = counts

    def _keep(self, texts: list[str], groups: list[str], stat: np.ndarray, links: np.ndarray) -> None:
        base, size = len(self.group_text), len(self.group_text) + len(texts)
        self.code.update(zip(texts, range(base, size), strict=True))
        self.group_text += groups
        self.held += self._size(texts, groups)
        if size > self.stat.shape[1]:
            self.stat = np.concatenate([self.stat, np.zeros((4, size), np.int64)], axis=1)
            self.link_start, self.used = (np.concatenate([x, np.zeros(size, np.int64)]) for x in (self.link_start, self.used))
        self.stat[:, base:size] = stat
        self.link_start[base:size] = self.n_links + np.cumsum(stat[3]) - stat[3]
        if self.n_links + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros(self.n_links + len(links), np.int32)])
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)

    def tokens_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [[t] if (t[1:] if t[0] == " " else t).isalpha() else self.a.cut(t) for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        ids, counts = self.a.tokens(list(place))
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64)
        found = ids[_ranges((np.cumsum(counts) - counts)[flat], counts[flat])]
        return found, _sums(counts[flat], np.fromiter(map(len, words), np.int64, len(words)))

    def tokens_b(self, texts: list[str], sizes: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with the space that the model itself would add (whole), or of stretches inside a text: a
        line feed stands before each of these, so that many are cut at once and told apart by their numbers of bytes."""
        if not whole:
            ends = np.searchsorted(np.cumsum(sizes), np.arange(RUN_BYTES, sizes.sum() + RUN_BYTES, RUN_BYTES), "right").tolist()
            runs = ["\n" + "\n".join(texts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]
            runs += ["\n" + "\n".join(texts[ends[-1] :])] if ends and ends[-1] < len(texts) else []
            # The model puts a space before each run.
            ids = np.fromiter(chain.from_iterable(x[1:] for x in self.b.encode(runs, num_threads=1)), np.int64)
            at = np.searchsorted(np.cumsum(self.b_bytes[ids]), np.cumsum(sizes + 1), "right")
            counts = np.diff(at, prepend=0)
            first = np.cumsum(counts) - counts
            if at[-1] == len(ids) and counts.min() > 0 and (_sums(self.b_bytes[ids], counts) == sizes + 1).all():
                return np.delete(ids, first), counts - 1
        found = self.b.encode([t[1:] for t in texts], num_threads=1) if whole else [x[2:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]
        return np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))

    def _rebuilds(self, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, length: np.ndarray, start: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Which texts' tokens have the bytes of the text."""
        same = _sums(length[ids], counts) == sizes
        keep = np.repeat(same, counts)
        built = pieces[_ranges(start[ids[keep]], length[ids[keep]])]
        held = np.repeat(same, sizes)
        wrong = np.zeros(len(data), np.int64)
        wrong[held] = built != data[held]
        return same & (_sums(wrong, sizes) == 0)

    def learn(self, texts: list[str], whole: bool = False) -> None:
        """Align new stretches (or whole texts with their space) side by side, and keep the results."""
        bytes_ = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes, data = np.fromiter(map(len, bytes_), np.int64, len(texts)), np.frombuffer(b"".join(bytes_), np.uint8)
        a, n_a = self.tokens_a(texts)
        b, n_b = self.tokens_b(texts, sizes, whole)
        good = self._rebuilds(data, sizes, a, n_a, self.a_bytes, self.a_start, self.a_data) & self._rebuilds(data, sizes, b, n_b, self.b_bytes, self.b_start, self.b_data)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        over_a, _, cut_a, cut_b = owners(self.a_bytes[a], self.b_bytes[b])
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        n_over, n_cut = (np.bincount(text_of_a[x], minlength=len(texts)) for x in (over_a, cut_a))
        links = np.searchsorted(self.keys, a[cut_a] * len(self.b_piece) + b[cut_b]).astype(np.int32)
        # Groups as text: each token at its place among the A and B tokens of its group, with the sign that follows it.
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cut_a] = last_b[cut_b] = True
        written = np.empty(len(a) + len(b), object)
        before_b = np.concatenate([[0], cut_b + 1])
        written[np.arange(len(a)) + before_b[np.cumsum(last_a) - last_a]] = np.where(last_a, self.a_text[1][a], self.a_text[0][a])
        after_a = np.append(cut_a + 1, 0)
        written[np.arange(len(b)) + after_a[np.cumsum(last_b) - last_b]] = np.where(last_b, self.b_text[1][b], self.b_text[0][b])
        parts, ends = written.tolist(), np.cumsum(n_a + n_b).tolist()
        groups = ["".join(parts[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        self._keep(texts, groups, np.stack([n_a, n_b, n_over, n_cut]), links)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text: A tokens, B tokens and overlaps (three rows), groups as text, number of links, and all links."""
        if self.held > CACHE_BYTES:
            self.shrink()
        full = [" " + t if t else "" for t in texts]
        parts = [STRETCH.findall(t) for t in full] if self.divides else [[t] if t else [] for t in full]
        if new := list(set(chain.from_iterable(parts)).difference(self.code)):
            self.learn(new, not self.divides)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = list(map(self.code.__getitem__, chain.from_iterable(parts)))
        flat = np.array(codes, np.int64)
        # A stretch that is not rebuilt decides nothing about the whole text: ask both tokenizers for that.
        doubtful = np.flatnonzero(_sums(self.stat[3, flat] == 0, counts))
        if len(doubtful):
            ends = np.cumsum(counts).tolist()
            if self.divides and (new := list({full[k] for k in doubtful}.difference(self.code))):
                self.learn(new, True)
            each = [codes[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]
            for k in doubtful.tolist():
                each[k] = [c] if self.stat[3, c := self.code[full[k]]] else []
            counts, codes = np.fromiter(map(len, each), np.int64, len(each)), list(chain.from_iterable(each))
            flat = np.array(codes, np.int64)
        np.add.at(self.used, flat, 1)
        strings, ends = list(map(self.group_text.__getitem__, codes)), np.cumsum(counts).tolist()
        groups = [";".join(strings[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        stats = self.stat[:, flat]
        totals = np.stack([_sums(s, counts) for s in stats])
        return totals[:3], groups, totals[3], self.links[_ranges(self.link_start[flat], stats[3])]

    def spans(self, text: str) -> dict[str, np.ndarray]:
        """Ids and byte lengths of both tokenizations of space and text, overlaps (indices into both) and cuts (byte offsets)."""
        a, _ = self.tokens_a([" " + text])
        b, _ = self.tokens_b([" " + text], np.zeros(1, np.int64), True)
        over_a, over_b, cut_a, _ = owners(self.a_bytes[a], self.b_bytes[b])
        return {"a": a, "b": b, "overlap_a": over_a, "overlap_b": over_b, "cuts": np.cumsum(self.a_bytes[a])[cut_a]}


@lru_cache(maxsize=1)
def load(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Places and texts in groups of bounded size, nulls as empty; only one group is held as Python strings."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // BATCH_CHARS
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(starts, starts[1:], strict=False):
        if a < b:
            yield a, [t or "" for t in texts.slice(a, b - a).to_pylist()]


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, text: str = "text", digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs with n_a, n_b (tokens), n_overlaps, groups (`a1,a2|b1;a3|b2,b3`) and links (the number of the linked pair at each
    cut, see Aligner.pairs). With digest, groups are given as their SHA-256 (nothing for nothing), which moves far less; keep names the
    columns of docs that are kept (else all)."""
    paths = (vocabulary or default_paths()[0], model or default_paths()[1])
    kept = [f for f in docs.schema.fields if f.name not in _OWN and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*paths)
        for batch in batches:
            for start, group in _groups(batch.column(text)):
                stats, groups, n_links, links = both.align(group)
                if digest:
                    groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32))
                own = [pa.array(stats[0]), pa.array(stats[1]), pa.array(stats[2]), pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(links))]
                part = batch.slice(start, len(group))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + own, names=names + list(_OWN))

    return docs.mapInArrow(run, T.StructType(kept + [T.StructField(n, t) for n, t in _OWN.items()]))


def pair_counts(aligned: DataFrame, vocabulary: str | None = None, model: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How often each numbered pair is linked in all rows, and whether that is the most for its B token. What is collected has
    a row for each numbered pair at most, whatever the number of rows."""
    both = load(vocabulary or default_paths()[0], model or default_paths()[1])
    counted = aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    found = counted.toArrow()
    count = np.zeros(len(both.keys), np.int64)
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    _, b = both.pairs()
    most = np.zeros(len(both.b_piece), np.int64)
    np.maximum.at(most, b, count)
    return count, (count == most[b]) & (count > 0)


def link_scores(aligned: DataFrame, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """aligned with n_links, n_best (links whose pair is the most frequent of its B token) and count_sum instead of links."""
    shared = aligned.sparkSession.sparkContext.broadcast(counts)
    names = [n for n in aligned.columns if n not in ("links", "n_links", "n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = shared.value
        for batch in (b.slice(at, SCORED_ROWS) for b in batches for at in range(0, b.num_rows, SCORED_ROWS)):
            column = batch.column("links")
            links, offsets = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            sums = np.concatenate([[0], np.cumsum(count[links])]), np.concatenate([[0], np.cumsum(best[links])])
            own = [np.diff(offsets), *(s[offsets[1:]] - s[offsets[:-1]] for s in sums[::-1])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(x.astype(np.int64)) for x in own], names=[*names, "n_links", "n_best", "count_sum"])

    fields = [aligned.schema[n] for n in names] + [T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum")]
    return aligned.mapInArrow(run, T.StructType(fields))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the alignment of every document. Texts are aligned once; what is written for the second look
    are digests and the numbers of linked pairs."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = align(docs, digest=True, keep=["doc_id"]).withColumnRenamed("groups", "groups_sha256")
    with scratch() as own:
        thin = materialize(found, "aligned")
        own.keep(thin)
        scored = link_scores(thin, pair_counts(thin))
    return scored.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
