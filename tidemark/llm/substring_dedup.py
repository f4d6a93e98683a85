"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Every text gives seeds: the least fingerprint of k words in each window of so many k-mers (winnowing), so any stretch of
   k + window - 1 equal words in two texts shares a seed, whatever stands around it.
2. A seed found in several documents links each of its places with the earliest one (least document, then least place), not
   with all others: matches grow with the seeds, however often a passage repeats.
3. The matches of a pair of documents are chained: ascending in both texts, each worth k words, less a cost for the words
   skipped in either. A Fenwick tree over places in the earlier text holds the best chain ends; where the best one lies
   beyond MAX_GAP, the best of those within it is taken.
4. Chains are aligned word by word: along a diagonal by comparing arrays, across a shift by a small dynamic programme, and
   outwards from both ends until mismatches outweigh. What holds enough equal words at enough identity is a passage.
   Words are fetched in blocks for the spans of chains only.
5. Neighbouring seeds may have their earliest places in different texts, or at different shifts, while another text holds
   the whole stretch. So where a stretch of shared seeds, as long as a passage, is in none found so far, its runs of seeds
   (four, and as many as MIN_WORDS hold) are named and linked with the earliest place of the whole run, and chained and
   aligned in the same way, every chain of a pair (a text that repeats itself has very many).

Cases: null, empty and short texts have no passages; passages repeated inside one document only are not reported; rows that
repeat both id and text count as one document; rows without id, and different texts under one id, are documents of their own
(they come before the others, in the order of a fingerprint); very long texts are read whole; ties between chains go to the
later end; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, mix64, release, table, window_hashes, word_hashes, word_hashes_of

K = 6
WINDOW = 10
MIN_WORDS = 40
IDENTITY = 0.8
GAP_COST = 0.05
#: Words skipped between two matches of a chain at most; a longer gap begins another passage.
MAX_GAP = 60
#: Words looked at beyond the ends of a chain.
FLANK = 128
BLOCK = 128
#: Ids from here on are their documents' numbers; what lies below stands for rows without an id of their own.
_LEAST_ID = -(1 << 62)


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and places of a text's winnowed k-mers."""
    h = window_hashes(words, k)
    if not len(h):
        return h, np.empty(0, np.int64)
    if len(h) <= window:
        at = np.array([int(h.argmin())])
    else:
        least = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.unique(np.concatenate([least[s : s + 65536].argmin(axis=1) + np.arange(s, min(s + 65536, len(least))) for s in range(0, len(least), 65536)]))
    return h[at], at


def all_seeds(texts: list[bytes], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """seeds() of many texts, with their words fingerprinted together."""
    words, counts = word_hashes_of(texts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(texts)), counts)
    h = window_hashes(words, k)
    fine = of[k - 1 :] == of[: len(h)] if len(h) else np.empty(0, bool)  # not across two texts
    h, of, place = h[fine], of[: len(fine)][fine], (np.arange(len(fine)) - np.repeat(ends - counts, counts)[: len(fine)])[fine]
    if not len(h):
        return [(h, place)] * len(texts)
    # The first least one of each window, by doubling the windows; shorter texts are one window.
    step, at = 1, np.arange(len(h))
    while step < window:
        on = min(step, window - step)
        if len(at) <= on:
            at = at[:0]
            break
        left, right = at[:-on], at[on:]
        at, step = np.where(h[right] < h[left], right, left), step + on
    at = at[of[: len(at)] == of[window - 1 :][: len(at)]]
    sizes = np.bincount(of, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    short = [int(s + h[s : s + n].argmin()) for s, n in zip(first.tolist(), sizes.tolist(), strict=True) if 0 < n < window]
    at = np.unique(np.concatenate([at, np.array(short, np.int64)]))
    cuts = np.searchsorted(of[at], np.arange(len(texts) + 1)).tolist()
    return [(h[at[s:e]], place[at[s:e]]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def chains(pos: np.ndarray, rpos: np.ndarray, k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Rows of each chain of matches (sorted by pos), best first; every match is in one chain at most."""
    n = len(pos)
    diagonal = rpos - pos
    if n > 1 and (diagonal == diagonal[0]).all() and (np.diff(pos) <= max_gap).all():
        return [np.arange(n)]
    ranks = (np.unique(rpos, return_inverse=True)[1] + 1).tolist()
    size = max(ranks)
    best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    total, before = [0.0] * n, [-1] * n
    ends = np.zeros(n)  # totals with the cost of all words before, as the tree compares them
    x, y = pos.tolist(), rpos.tolist()
    at = 0
    while at < n:
        end = at
        while end < n and x[end] == x[at]:
            end += 1
        for j in range(at, end):  # those at one place are asked before any of them is entered
            r, found = ranks[j] - 1, (-np.inf, -1)
            while r > 0:
                if best[r] > found:
                    found = best[r]
                r -= r & -r
            i = found[1]
            if i >= 0 and (x[j] - x[i] > max_gap or y[j] - y[i] > max_gap):  # the best of all is too far: the best near one
                first = bisect_left(x, x[j] - max_gap, 0, at)
                near = first + np.flatnonzero((rpos[first:at] < y[j]) & (rpos[first:at] >= y[j] - max_gap))
                i = -1
                if len(near):
                    i = int(near[len(near) - 1 - ends[near][::-1].argmax()])
                    found = (float(ends[i]), i)
            total[j] = float(k)
            if i >= 0:
                joined = found[0] - gap_cost * (x[j] + y[j]) + min(k, x[j] - x[i], y[j] - y[i])
                if joined > k:
                    total[j], before[j] = joined, i
        for j in range(at, end):
            ends[j] = total[j] + gap_cost * (x[j] + y[j])
            r, value = ranks[j], (float(ends[j]), j)
            while r <= size:
                if value > best[r]:
                    best[r] = value
                r += r & -r
        at = end
    out, used = [], [False] * n
    for j in np.lexsort((-np.arange(n), -np.array(total))).tolist():
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of two stretches between matches: along the diagonal, or their longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b):
        same = int((a == b).sum())
        if 2 * same >= len(a):
            return same
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def _grow(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far equal beginnings of a and b reach where mismatches cost double, and the equal words there."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    fallen = np.flatnonzero(score < np.maximum.accumulate(np.maximum(score, 0)) - 10)
    score = score[: fallen[0]] if len(fallen) else score
    end = int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0
    return end, int(same[:end].sum())


def align(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """Start and end in a, start and end in b, and equal words, of the passage around a chain's matches."""
    (i, j), equal = pairs[0], 0
    back, same = _grow(a[:i][::-1], b[:j][::-1])
    start, rstart, equal = i - back, j - back, equal + same
    end, rend = i, j
    for p, r in pairs.tolist():
        if p >= end and r >= rend:
            equal += _matched(a[end:p], b[rend:r])
            equal += int((a[p : p + k] == b[r : r + k]).sum())
            end, rend = p + k, r + k
        elif p + k > end and p - end == r - rend:
            equal += int((a[end : p + k] == b[rend : r + k]).sum())
            end, rend = p + k, r + k
    on, same = _grow(a[end:], b[rend:])
    return start, end + on, rstart, rend + on, equal + same


def _grow_all(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """_grow for many places of a and b at once: from i and j on, n words at most, onwards (step 1) or back (-1)."""
    if not len(n) or not n.max():
        return np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    t = np.arange(int(n.max()))
    held = t < n[:, None]
    same = held & (a[np.where(held, i[:, None] + step * t, 0)] == b[np.where(held, j[:, None] + step * t, 0)])
    score = np.cumsum(np.where(same, 1, -2), axis=1, dtype=np.int32)
    fallen = ~held | (score < np.maximum.accumulate(np.maximum(score, 0), axis=1) - 10)
    score[np.logical_or.accumulate(fallen, axis=1)] = -1
    end = score.argmax(axis=1)
    most = score[np.arange(len(n)), end]
    end = np.where(most > 0, end + 1, 0)
    return end, np.where(most > 0, (most + 2 * end) // 3, 0)


def _align_many(a: np.ndarray, b: np.ndarray, spans: np.ndarray, pairs: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """align for many chains. spans: first and end of each chain's words in a and in b; pairs: the matches of all chains in a and
    b, each chain's from starts on."""
    (i, j), counts = pairs[starts].T, np.diff(starts, append=len(pairs))
    turn = pairs[:, 1] - pairs[:, 0]
    straight = np.logical_and.reduceat(turn == np.repeat(turn[starts], counts), starts)
    end, rend, equal = (np.empty(len(starts), np.int64) for _ in range(3))
    if straight.any():
        held, n = pairs[np.repeat(straight, counts)], counts[straight]
        last = np.cumsum(n) - 1
        end[straight], rend[straight] = held[last].T + k
        equal[straight] = _straight(a, b, held, last - n + 1, k)
    alike = (a[pairs[:, :1] + np.arange(k)] == b[pairs[:, 1:] + np.arange(k)]).all(axis=1).tolist()
    both = pairs.tolist()
    for c in np.flatnonzero(~straight).tolist():
        x, y = both[starts[c]]
        total = 0
        for m in range(starts[c], starts[c] + counts[c]):
            p, r = both[m]
            if p >= x and r >= y:
                if p > x and r > y:
                    total += _matched(a[x:p], b[y:r])
                x, y = p, r
            elif p + k <= x or p - x != r - y:
                continue
            total += p + k - x if alike[m] else int((a[x : p + k] == b[y : r + k]).sum())
            x, y = p + k, r + k
        end[c], rend[c], equal[c] = x, y, total
    back, same = _grow_all(a, b, i - 1, j - 1, np.minimum(i - spans[:, 0], j - spans[:, 2]), -1)
    on, more = _grow_all(a, b, end, rend, np.minimum(spans[:, 1] - end, spans[:, 3] - rend), 1)
    return np.stack([i - back, end + on, j - back, rend + on, equal + same + more], axis=1)


def _straight(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Equal words from the first match to the last, for chains of one diagonal each."""
    last = np.append(starts[1:], len(pairs)) - 1
    (i, j), end = pairs[starts].T, pairs[last, 0] + k
    length = end - i
    base = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(base - i, length)
    sums = np.concatenate([[0], np.cumsum(a[at] == b[at + np.repeat(j - i, length)])])
    equal = sums[base + length] - sums[base]
    # Stretches between matches that fit badly on the diagonal may hold more equal words across a shift.
    chain = np.repeat(np.arange(len(starts)), last - starts + 1)
    inner = np.flatnonzero(chain[1:] == chain[:-1])
    low, high = pairs[inner, 0] + k, pairs[inner + 1, 0]
    move = base[chain[inner]] - i[chain[inner]]
    gap = high > low
    inner, low, high, move = inner[gap], low[gap], high[gap], move[gap]
    held = sums[high + move] - sums[low + move]
    for x in np.flatnonzero(2 * held < high - low).tolist():
        c = chain[inner[x]]
        shift = int(j[c] - i[c])
        equal[c] += _matched(a[low[x] : high[x]], b[low[x] + shift : high[x] + shift]) - held[x]
    return equal


def _streamed(key: list[str], work):
    """A function over sorted frames that hands each run of equal keys to work as one frame, across batch borders."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            values = f[key].to_numpy()
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            if held and (held[-1][key].iloc[-1].to_numpy() != values[0]).any():
                cuts = np.concatenate([[0], cuts])
            last = int(cuts[-1]) if len(cuts) else None
            if last is None:
                held.append(f)
                continue
            done = pd.concat([*held, f.iloc[:last]]) if held else f.iloc[:last]
            held = [f.iloc[last:]]
            if (got := work(done)) is not None and len(got):
                yield got
        if held and (got := work(pd.concat(held))) is not None and len(got):
            yield got

    return run


def _runs(f: pd.DataFrame, key: list[str]) -> list[tuple[int, int]]:
    values = f[key].to_numpy()
    cuts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(f)]])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


_STEP = np.uint64(0x100000001B3)
_STEP_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _open(pos: np.ndarray, spans: list[tuple[int, int]], k: int) -> np.ndarray:
    """Which places of seeds lie in none of the spans."""
    if not spans:
        return np.ones(len(pos), dtype=bool)
    spans = sorted(spans)
    starts, ends = np.array([x[0] for x in spans]), np.maximum.accumulate([x[1] for x in spans])
    at = np.searchsorted(starts, pos, side="right") - 1
    return (at < 0) | (ends[np.maximum(at, 0)] < pos + k)


def _name_runs(k: int, min_words: int, max_gap: int = MAX_GAP):
    """Names of runs of neighbouring seeds that no passage holds and no single text and shift explains, and where they stand.

    Rows are sorted by doc, then the document's passages (rpos is -1, pos to seed their span), then its seeds by pos.
    """

    def document(pos: np.ndarray, rpos: np.ndarray, seed: np.ndarray, rep: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple]:
        free = _open(pos, spans, k)
        pos, rpos, seed, rep = pos[free], rpos[free], seed[free], rep[free]
        n = len(pos)
        if n < 4:
            return []
        apart = np.concatenate([[0], np.cumsum(np.diff(pos) > max_gap)])
        first, last = np.searchsorted(apart, apart), np.searchsorted(apart, apart, side="right") - 1
        long = pos[last] + k - pos[first] >= min_words  # only stretches as long as a passage
        mixed = np.concatenate([[0], np.cumsum((rep[1:] != rep[:-1]) | (np.diff(rpos) != np.diff(pos)))])
        if not mixed[-1] or not long.any():
            return []
        # Range sums of powers, brought back to power zero: equal for equal seeds at equal distances, wherever they stand.
        steps = np.concatenate([[0], np.diff(pos)]).astype(np.uint64)
        power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_STEP, _STEP_BACK))
        own = mix64(seed.view(np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(own + steps * np.uint64(0x9E3779B97F4A7C15)) * power[:n])])
        at, out = np.arange(n), []
        for end in (at + 3, np.searchsorted(pos, pos + (min_words - k), side="right") - 1):
            i = at[(end > at) & (end < n) & long]
            e = end[i]
            fine = (apart[i] == apart[e]) & (mixed[i] != mixed[e])
            i, e = i[fine], e[fine]
            name = mix64(own[i] + (sums[e + 1] - sums[i + 1]) * back[i + 1] + (e - i).astype(np.uint64))
            out.append((name.view(np.int64), pos[i], pos[e] - pos[i]))
        return out

    def work(f: pd.DataFrame) -> pd.DataFrame | None:
        doc, pos, rpos, seed, rep = (f[c].to_numpy(np.int64) for c in ("doc", "pos", "rpos", "seed", "rep"))
        cuts = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]]).tolist()
        found, owner = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            m = s + int(np.searchsorted(rpos[s:e] >= 0, True))  # passages come first
            if e - m > 3:
                got = document(pos[m:e], rpos[m:e], seed[m:e], rep[m:e], list(zip(pos[s:m].tolist(), seed[s:m].tolist(), strict=True)))
                found += got
                owner += [np.full(len(g[0]), doc[s]) for g in got]
        if not found:
            return None
        name, at, span = (np.concatenate([g[c] for g in found]) for c in range(3))
        return pd.DataFrame({"name": name, "doc": np.concatenate(owner), "pos": at.astype(np.int32), "span": span.astype(np.int32)})

    return _streamed(["doc"], work)


def _blocks(first, last, k: int):
    """The first and last word block that the span and flanks of each chain touch."""
    return np.maximum(first - FLANK, 0) // BLOCK, (last + k + FLANK) // BLOCK


def _chain_all(k: int):
    """Chains of sorted matches (doc, rep, pos, rpos): their matches as packed pairs, a pair's best first; the first of a pair has
    the word blocks of all its chains on either side."""

    def work(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pos, rpos, doc, rep = (f[c].to_numpy() for c in ("pos", "rpos", "doc", "rep"))
        again = np.concatenate([[False], (pos[1:] == pos[:-1]) & (rpos[1:] == rpos[:-1]) & (doc[1:] == doc[:-1]) & (rep[1:] == rep[:-1])])
        if again.any():  # runs that overlap name the same match
            f = f[~again]
            pos, rpos, doc, rep = (x[~again] for x in (pos, rpos, doc, rep))
        for s, e in _runs(f, ["doc", "rep"]):
            if e - s < 2:
                continue
            own, touched = [], (set(), set())
            for n, chain in enumerate(chains(pos[s:e], rpos[s:e], k)):
                if len(chain) > 1:
                    both = np.stack([pos[s:e][chain], rpos[s:e][chain]], axis=1).astype(np.int32)
                    for held, first, last in zip(touched, both[0].tolist(), both[-1].tolist(), strict=True):
                        held.update(range(max(first - FLANK, 0) // BLOCK, (last + k + FLANK) // BLOCK + 1))
                    own.append([doc[s], rep[s], n, both.tobytes(), None, None])
            if own:
                own[0][4:] = sorted(touched[0]), sorted(touched[1])
                rows += own
        return pd.DataFrame(rows, columns=["doc", "rep", "n", "pairs", "blocks", "rblocks"])

    return _streamed(["doc", "rep"], work)


def _align_all(k: int, min_words: int, identity: float):
    """Passages from sorted pairs of documents: rows of their chains (side -1, bytes: the matches), then of their word blocks."""

    def some(f: pd.DataFrame) -> pd.DataFrame:
        f = f[~f.duplicated(["doc", "rep", "side", "place"])]  # repeated rows of a document may give its blocks twice
        side, place, data = f["side"].to_numpy(), f["place"].to_numpy(np.int64), f["bytes"].to_numpy()
        doc, rep = f["doc"].to_numpy(), f["rep"].to_numpy()
        pair = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1]))])
        chain = np.flatnonzero(side < 0)
        pairs = np.frombuffer(b"".join(data[chain]), np.int32).reshape(-1, 2).astype(np.int64)
        counts = np.fromiter(map(len, data[chain]), np.int64, len(chain)) // 8
        starts = np.cumsum(counts) - counts
        texts, spans, from_ = [], [], []
        for x in (0, 1):
            own = np.flatnonzero(side == x)
            texts.append(np.frombuffer(b"".join(data[own]), np.uint32))
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, data[own]), np.int64, len(own)) // 4)])
            low, high = _blocks(pairs[starts, x], pairs[starts + counts - 1, x], k)
            code = pair[own] << 32 | place[own]
            spans += [offsets[np.searchsorted(code, pair[chain] << 32 | b)] for b in (low, high + 1)]
            from_.append(low * BLOCK)
        spans, from_ = np.stack(spans, axis=1), np.stack(from_, axis=1)
        move = spans[:, [0, 2]] - from_  # from places in a text to places in what is held of all
        pairs += np.repeat(move, counts, axis=0)
        found = np.zeros((len(chain), 5), np.int64)
        whole = (spans[:, 0] < spans[:, 1]) & (spans[:, 2] < spans[:, 3])
        wholes = np.flatnonzero(whole)
        for c in (wholes[n : n + 4_000] for n in range(0, len(wholes), 4_000)):
            n = counts[c]
            first = np.cumsum(n) - n
            found[c] = _align_many(*texts, spans[c], pairs[np.repeat(starts[c] - first, n) + np.arange(n.sum())], first, k)
        found[:, :4] -= np.repeat(move, 2, axis=1)
        share = found[:, 4] / np.maximum(np.maximum(found[:, 1] - found[:, 0], found[:, 3] - found[:, 2]), 1)
        fine = np.flatnonzero((found[:, 4] >= min_words) & (share >= identity))
        chain, found, share = chain[fine], found[fine], share[fine]
        # Better chains of a pair come first; what lies inside one of them is left out.
        kept = np.ones(len(chain), dtype=bool)
        cuts = np.flatnonzero(np.diff(pair[chain], prepend=-1, append=-1)).tolist() if len(chain) else []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(s, e if e - s > 1 else s, 256):
                g, h = found[at : min(at + 256, e)], found[s : min(at + 256, e)]
                inside = (h[:, 0] <= g[:, None, 0]) & (g[:, None, 1] <= h[:, 1]) & (h[:, 2] <= g[:, None, 2]) & (g[:, None, 3] <= h[:, 3])
                inside &= np.arange(len(h)) < np.arange(at - s, at - s + len(g))[:, None]
                kept[at : at + len(g)] = ~inside.any(axis=1)
        chain, found, share = chain[kept], found[kept], share[kept]
        columns = dict(zip(["start", "end", "rstart", "rend", "equal"], found.T, strict=True))
        return pd.DataFrame({"doc": doc[chain], "rep": rep[chain], **columns, "identity": share})

    def work(f: pd.DataFrame) -> pd.DataFrame | None:
        """Whole pairs, some thousand rows at once."""
        ends = [e for _, e in _runs(f, ["doc", "rep"])]
        out, s = [], 0
        for e, after in zip(ends, [*ends[1:], None], strict=True):
            if after is None or after - s > 4_000:
                out.append(some(f.iloc[s:e]))
                s = e
        return pd.concat(out)

    return _streamed(["doc", "rep"], work)


def _aligned(docs: DataFrame, matches: DataFrame, k: int, min_words: int, identity: float, name: str) -> DataFrame:
    """The passages around the chains of matches (doc, rep, pos, rpos) of docs (doc, text)."""
    order = ["doc", "rep", "pos", "rpos"]
    linked = matches.select(*order).repartition("doc").sortWithinPartitions(*order)
    chained = linked.mapInPandas(_chain_all(k), "doc long, rep long, n int, pairs binary, blocks array<int>, rblocks array<int>")
    found = materialize(chained, f"{name}-chains")

    def need(side: int, owner: str, blocks: str) -> DataFrame:
        """The word blocks that the spans and flanks of a pair's chains touch, each once."""
        return found.where("blocks IS NOT NULL").select("doc", "rep", F.lit(side).alias("side"), F.col(owner).alias("owner"), F.explode(blocks).alias("block"))

    needs = need(0, "doc", "blocks").union(need(1, "rep", "rblocks"))
    wanted = needs.groupBy("owner").agg(F.collect_set("block").alias("blocks"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for f in frames:
            out = []
            for d, text, blocks in zip(f["doc"], f["text"], f["blocks"], strict=True):
                if d == last:  # rows that repeat a document lie side by side after the merge join
                    continue
                last = d
                words = (word_hashes(lower_ascii(text)) >> np.uint64(32)).astype(np.uint32)
                out += [(d, int(b), words[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in blocks if b * BLOCK < len(words)]
            if out:
                yield pd.DataFrame(out, columns=["owner", "block", "words"])

    texts = docs.join(wanted.hint("merge"), docs["doc"] == wanted["owner"]).select("doc", "text", "blocks")
    pieces = texts.mapInPandas(cut, "owner long, block int, words binary")
    words = needs.join(pieces, ["owner", "block"]).select("doc", "rep", "side", F.col("block").alias("place"), F.col("words").alias("bytes"))
    whole = found.select("doc", "rep", F.lit(-1).alias("side"), F.col("n").alias("place"), F.col("pairs").alias("bytes")).union(words)
    ready = whole.repartition("doc", "rep").sortWithinPartitions("doc", "rep", "side", "place")
    out = ready.mapInPandas(_align_all(k, min_words, identity), "doc long, rep long, start int, end int, rstart int, rend int, equal int, identity double")
    out = materialize(out, f"{name}-passages")
    release(found)
    return out


def passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """doc, rep (an earlier document), their word spans, equal words and identity of every repeated passage of docs (doc, text)."""

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            doc, texts = f["doc"].to_numpy(), [lower_ascii(t) for t in f["text"]]
            size = np.cumsum([len(t) + 1 for t in texts]) >> 20
            for s, e in zip(cuts := np.searchsorted(size, np.unique(size)), [*cuts[1:], len(texts)], strict=True):  # a megabyte at once
                parts = all_seeds(texts[s:e], k, window)
                sizes = [len(p[1]) for p in parts]
                if sum(sizes):
                    yield pd.DataFrame({"seed": np.concatenate([p[0] for p in parts]).view(np.int64), "doc": np.repeat(doc[s:e], sizes), "pos": np.concatenate([p[1] for p in parts]).astype(np.int32)})

    docs = docs.where(F.col("text").isNotNull())
    found = materialize(docs.mapInPandas(seed, "seed long, doc long, pos int"), "substring-seeds")
    shared = found.groupBy("seed").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("most")).where("first.doc != most")
    shared = materialize(shared.select("seed", "first"), "substring-shared")  # lets the join split a hot seed on the other side
    places = found.join(shared.hint("merge"), "seed").select("doc", "pos", "seed", F.col("first.doc").alias("rep"), F.col("first.pos").alias("rpos"))
    places = materialize(places, "substring-places")
    release(found, shared)
    whole = _aligned(docs, places.where("doc != rep"), k, min_words, identity, "substring")
    # What no passage holds, although its seeds are shared: linked by whole runs of seeds.
    spans = whole.select("doc", F.col("start").alias("pos"), F.col("end").cast("long").alias("seed"), F.col("doc").alias("rep"), F.lit(-1).alias("rpos"))
    ordered = places.union(spans).repartition("doc").sortWithinPartitions("doc", F.col("rpos") >= 0, "pos")
    runs = materialize(ordered.mapInPandas(_name_runs(k, min_words), "name long, doc long, pos int, span int"), "substring-runs")
    release(places)
    first = runs.groupBy("name").agg(F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("most")).where("first.doc != most")
    held = runs.join(first.select("name", "first").hint("merge"), "name").where("doc != first.doc")
    ends = F.explode(F.array(F.lit(0), F.col("span")))
    held = held.select("doc", F.col("first.doc").alias("rep"), "pos", F.col("first.pos").alias("rpos"), ends.alias("on"))
    held = held.select("doc", "rep", (F.col("pos") + F.col("on")).alias("pos"), (F.col("rpos") + F.col("on")).alias("rpos"))
    more = _aligned(docs, held, k, min_words, identity, "substring-more")
    release(runs)
    return whole.union(more)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) as (doc, text), and a table (doc, id) of the documents whose number is not their id, if any is.

    A document's number is its id where that is its own, and else a fingerprint of id and text below all ids in use.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    twice = materialize(docs.groupBy("doc_id").count().where((F.col("count") > 1) & F.col("doc_id").isNotNull() | (F.col("doc_id") < _LEAST_ID)).select(F.col("doc_id").alias("_twice")), "substring-ids")
    print_ = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    if twice.isEmpty():
        own = docs.withColumn("doc", F.when(F.col("doc_id").isNull(), print_).otherwise(F.col("doc_id")))
        return own.select("doc", "text"), None
    own = docs.join(twice, F.col("doc_id") == F.col("_twice"), "left")
    own = own.withColumn("doc", F.when(F.col("doc_id").isNull() | F.col("_twice").isNotNull(), print_).otherwise(F.col("doc_id")))
    return own.select("doc", "text"), own.where("_twice IS NOT NULL").select(F.col("doc").alias("_doc"), F.col("doc_id").alias("_id")).distinct()


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages: a row for each document and earlier document that share one."""
    return repeated(table(spark, sf_dir, "documents"))


def repeated(docs: DataFrame) -> DataFrame:
    """The repeated passages of docs (doc_id, text) by doc_id."""
    numbered, ids = keyed(docs)
    out = passages(numbered)
    for side in ("doc", "rep"):
        out = out.withColumn(f"{side}_id", F.when(F.col(side) >= _LEAST_ID, F.col(side)))
        if ids is not None:
            out = out.join(ids, F.col(side) == F.col("_doc"), "left").withColumn(f"{side}_id", F.coalesce("_id", f"{side}_id")).drop("_doc", "_id")
    names = {"doc_id": "doc_id", "rep_id": "source_doc_id", "start": "start_word", "end": "end_word", "rstart": "source_start_word", "rend": "source_end_word", "equal": "equal_words", "identity": "identity"}
    return out.select(*[F.col(c).alias(n) for c, n in names.items()])
