"""String similarity kernels by their published definitions, as Arrow functions over pairs of columns.

ratio: 200 * LCS / (len a + len b). token_sort: ratio of the sorted words. token_set: the best ratio among
the shared words and the shared words with either remainder. partial: the best ratio of the shorter
string with any window of the longer, of equally long ones in either direction. jaro_winkler: 0 to 1, prefix weight 0.1 over at most 4
characters, given above 0.7. Two empty strings: ratio, token_sort and partial 100, token_set 0,
jaro_winkler 1; one empty: 0. Null counts as empty.

The functions of two strings are the definitions. Columns are scored a batch at a time: distinct pairs are
found first, and common subsequences of all of them are counted together by bit-parallel steps, a
machine word of 64 characters of the shorter string at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits for each character of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    free = every
    for c in b:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & every
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _word_sets(a: str, b: str) -> tuple[float, str, str, int, int]:
    """(a bound that is reached already, only a's words, only b's, the shared words' length, 1 if there are shared words); with empty remainders nothing else is to be done."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0, "", "", 0, 0
    both, only_a, only_b = one & two, " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if both and (not only_a or not only_b):
        return 100.0, "", "", 0, 0
    return -1.0, only_a, only_b, len(" ".join(sorted(both))), int(bool(both))


def _of_word_sets(only_a: int, only_b: int, lcs: int, shared: int, gap: int) -> float:
    """token_set from the lengths of both remainders, of their common subsequence and of the shared words."""
    whole_a, whole_b = shared + gap + only_a, shared + gap + only_b
    best = 100.0 * (1 - (only_a + only_b - 2 * lcs) / (whole_a + whole_b))
    if gap:
        best = max(best, *(100.0 * (1 - (w - shared) / (w + shared)) for w in (whole_a, whole_b)))
    return best


def token_set_ratio(a: str, b: str) -> float:
    known, only_a, only_b, shared, gap = _word_sets(a, b)
    return known if known >= 0 else _of_word_sets(len(only_a), len(only_b), lcs_length(only_a, only_b), shared, gap)


def _best_window(short: str, long: str) -> float:
    best, n = 0.0, len(short)
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        if 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    return best


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(short) == len(long) else best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(matched, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


# --- batches --------------------------------------------------------------------------------------

#: Comparisons of characters that are held at once.
_CELLS = 1 << 22


def _codes(strings: list[str], width: int) -> np.ndarray:
    return np.array(strings, f"U{max(1, width)}").view(np.uint32).reshape(len(strings), -1)


def _masks(short: list[str], long: list[str], width: int, length: int) -> np.ndarray:
    """(pairs, length, words): where each character of the longer string stands in the shorter one, as bits."""
    a, b = _codes(short, width), _codes(long, length)
    inside = np.arange(a.shape[1]) < np.array([len(x) for x in short])[:, None]
    outside = np.arange(b.shape[1]) >= np.array([len(x) for x in long])[:, None]
    same = (b[:, :, None] == a[:, None, :]) & inside[:, None, :]
    same[outside] = False
    words = -(-a.shape[1] // 64)
    bits = np.zeros((*same.shape[:2], words * 8), np.uint8)
    packed = np.packbits(same, axis=2, bitorder="little")
    bits[:, :, : packed.shape[2]] = packed
    return bits.view("<u8")


def _steps(masks: Iterator[np.ndarray], lanes: tuple[int, ...], words: int) -> np.ndarray:
    """Lengths of common subsequences of all lanes; ``masks`` gives a (lanes, words) array for each character."""
    free = np.full((*lanes, words), np.iinfo(np.uint64).max, np.uint64)
    for mask in masks:
        hit = free & mask
        carry = None
        for w in range(words):
            x, h = free[..., w], hit[..., w]
            total = x + h
            over = total < x
            if carry is not None:
                total = total + carry
                over |= (total < carry) & carry.astype(bool)
            free[..., w] = total | (x - h)
            carry = over.astype(np.uint64)
    return np.bitwise_count(~free).sum(axis=-1, dtype=np.int64)


def _sliced(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of a batch in the order of their sizes, as slices of about _CELLS."""
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(sizes[order[end]]) <= _CELLS:
            end += 1
        yield order[at:end]
        at = end


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of each pair."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    out = np.zeros(len(pairs), np.int64)
    full = np.array([i for i, (x, _) in enumerate(pairs) if x], np.int64)
    for part in _sliced(np.array([len(pairs[i][0]) * len(pairs[i][1]) for i in full], np.int64)):
        some = full[part]
        short, long = [pairs[i][0] for i in some], [pairs[i][1] for i in some]
        masks = _masks(short, long, max(map(len, short)), max(map(len, long)))
        out[some] = _steps((masks[:, j] for j in range(masks.shape[1])), (len(some),), masks.shape[2])
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    lengths = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], float)
    return np.where(lengths > 0, 200.0 * lcs_lengths(a, b) / np.maximum(lengths, 1), 100.0)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return ratios([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(x.split())) for x in b])


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    sets = [_word_sets(x, y) for x, y in zip(a, b, strict=True)]
    lcs = lcs_lengths([s[1] for s in sets], [s[2] for s in sets])
    return np.array([s[0] if s[0] >= 0 else _of_word_sets(len(s[1]), len(s[2]), n, s[3], s[4]) for s, n in zip(sets, lcs.tolist(), strict=True)], float)


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each shorter string, all of one length, with the windows of its longer one."""
    n, length = len(short[0]), max(map(len, long))
    masks = _masks(short, long, n, length)
    padded = np.zeros((len(short), length + 2 * (n - 1), masks.shape[2]), np.uint64)
    padded[:, n - 1 : n - 1 + length] = masks
    starts = length + n - 1
    lcs = _steps((padded[:, k : k + starts] for k in range(n)), (len(short), starts), masks.shape[2])
    first = np.arange(1 - n, length)
    sizes = np.array([len(x) for x in long])[:, None]
    width = np.minimum(first + n, sizes) - np.maximum(first, 0)
    return np.where(width > 0, 200.0 * lcs / (n + np.maximum(width, 0)), 0.0).max(axis=1)


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    jobs: dict[int, list[tuple[int, str, str]]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if not short or short in long:
            out[i] = 100.0 if short or not long else 0.0
            continue
        jobs.setdefault(len(short), []).append((i, short, long))
        if len(short) == len(long):
            jobs[len(short)].append((i, long, short))
    for n, found in jobs.items():
        for part in _sliced(np.array([n * (len(y) + 2 * n) for _, _, y in found], np.int64)):
            some = [found[i] for i in part]
            np.maximum.at(out, [i for i, _, _ in some], _best_windows([x for _, x, _ in some], [y for _, _, y in some]))
    return out


def jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], float)


class _Short:
    """Texts of at most 64 characters: where each character stands in each of them, as bits, forwards and backwards."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        raw = _codes(texts, int(self.sizes.max(initial=0)))
        self.width = raw.shape[1]
        inside = np.arange(self.width) < self.sizes[:, None]
        self.letters, at = np.unique(raw[inside], return_inverse=True)
        codes = np.zeros(raw.shape, np.int64)  # 0 after the end
        codes[inside] = at + 1
        turned = np.zeros(raw.shape, np.int64)
        turned[inside] = codes[np.nonzero(inside)[0], (self.sizes[:, None] - 1 - np.arange(self.width))[inside]]
        self.codes, self._bits = (codes, turned), [None, None]

    @staticmethod
    def fits(texts: list[str]) -> bool:
        return max(map(len, texts), default=0) <= 64 and len(texts) * len(set().union(*texts)) <= 1 << 22

    def bits(self, back: int) -> np.ndarray:
        """(text, code): the places of a character in a text."""
        if self._bits[back] is None:
            rows, bits = np.arange(len(self.sizes)), np.zeros((len(self.sizes), len(self.letters) + 1), np.uint64)
            for place in range(self.width):
                bits[rows, self.codes[back][:, place]] |= np.uint64(1 << place)
            bits[:, 0] = 0
            self._bits[back] = bits
        return self._bits[back]

    def steps(self, i: np.ndarray, j: np.ndarray, back: int = 0, first: int = 0, most: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """After each character of the texts j from ``first`` on, up to ``most`` of them: bits that are 0 where the common subsequence with a prefix of the texts i grows."""
        bits, codes = self.bits(back).ravel(), self.codes[back]
        base = i * (len(self.letters) + 1)
        free = np.full(len(i), np.iinfo(np.uint64).max, np.uint64)
        for step in range(min(self.width - first, self.width if most is None else int(most.max(initial=0)))):
            mask = bits[base + codes[j, first + step]]
            if most is not None:
                mask[step >= most] = 0
            hit = free & mask
            free = (free + hit) | (free - hit)
            yield free

    def lcs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        free = np.full(len(i), np.iinfo(np.uint64).max, np.uint64)
        for free in self.steps(i, j):  # noqa: B007
            pass
        return np.bitwise_count(~free).astype(np.int64)

    def ratios(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes = self.sizes[i] + self.sizes[j]
        return np.where(sizes > 0, 200.0 * self.lcs(i, j) / np.maximum(sizes, 1), 100.0)

    def partial_ratios(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Windows at both ends are read off one pass from there; between them each has its own."""
        swap = self.sizes[i] > self.sizes[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        n, size = self.sizes[i], self.sizes[j]
        equal, best = n == size, np.zeros(len(i))

        def found(free: np.ndarray, width: int, some: np.ndarray) -> None:
            score = 200.0 * np.bitwise_count(~free) / (n[some] + width)
            best[some] = np.maximum(best[some], score)

        for back in (0, 1):
            free = None
            for step, free in enumerate(self.steps(i, j, back)):
                some = np.flatnonzero(step < n)
                found(free[some], step + 1, some)
            for width in range(1, int(n.max(initial=0)) + 1):  # of texts of one length either may be the shorter one
                some = np.flatnonzero(equal & (width <= n))
                if len(some):
                    found(free[some] | ~np.uint64((1 << width) - 1), width, some)
        for first in range(1, int((size - n).max(initial=0))):
            some = np.flatnonzero((size - n > first) & (n > 0) & (best < 100))
            if len(some):
                for free in self.steps(i[some], j[some], 0, first, n[some]):  # noqa: B007
                    pass
                best[some] = np.maximum(best[some], 200.0 * np.bitwise_count(~free) / (2 * n[some]))
        return np.where(n > 0, best, np.where(size > 0, 0.0, 100.0))


def _short_token_sets(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """token_set_ratio of pairs of texts of at most 64 characters."""
    words = [sorted(set(t.split())) for t in texts]
    place = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
    n = np.array([len(ws) for ws in words], np.int64)
    inside = np.arange(max(1, n.max(initial=0))) < n[:, None]
    ids, sizes = np.full(inside.shape, -1), np.zeros(inside.shape, np.int64)
    ids[inside] = [place[w] for ws in words for w in ws]
    sizes[inside] = [len(w) for ws in words for w in ws]
    same = ids[i][:, :, None] == ids[j][:, None, :]
    in_both = same.any(axis=2) & inside[i], same.any(axis=1) & inside[j]
    count = in_both[0].sum(axis=1)
    gap = (count > 0).astype(np.int64)
    shared = np.where(in_both[0], sizes[i], 0).sum(axis=1) + np.maximum(count - 1, 0)
    power = 1 << np.arange(inside.shape[1])
    keys, at = np.unique(np.concatenate([(k << 32) | (b @ power) for k, b in zip((i, j), in_both, strict=True)]), return_inverse=True)
    rest = _Short([" ".join(w for b, w in enumerate(words[k >> 32]) if not k >> b & 1) for k in keys.tolist()])
    a, b = at[: len(i)], at[len(i) :]
    only_a, only_b = rest.sizes[a], rest.sizes[b]
    whole = shared + gap + only_a, shared + gap + only_b
    total = np.maximum(whole[0] + whole[1], 1)
    best = 100.0 * (1 - (only_a + only_b - 2 * rest.lcs(a, b)) / total)
    for w in whole:
        best = np.where(gap > 0, np.maximum(best, 100.0 * (1 - (w - shared) / np.maximum(w + shared, 1))), best)
    best[(gap > 0) & ((only_a == 0) | (only_b == 0))] = 100.0
    best[(n[i] == 0) | (n[j] == 0)] = 0.0
    return best


def text_scores(texts: list[str], i: np.ndarray, j: np.ndarray, names: tuple[str, ...] = ("ratio", "tset", "tsort", "partial")) -> dict[str, np.ndarray]:
    """ratio, tset, tsort, partial and jw, as asked for, of the pairs texts[i] and texts[j]; what belongs to a text is made once for all its pairs in a slice."""
    out = []
    for at in range(0, len(i), 1 << 15):
        some, of = np.unique(np.concatenate([i[at : at + (1 << 15)], j[at : at + (1 << 15)]]), return_inverse=True)
        mine, (a, b) = [texts[k] for k in some.tolist()], of.reshape(2, -1)
        pairs = lambda: ([mine[k] for k in a.tolist()], [mine[k] for k in b.tolist()])  # noqa: B023, E731
        if _Short.fits(mine):
            short = _Short(mine)
            made = {
                "ratio": lambda: short.ratios(a, b), "tset": lambda: _short_token_sets(mine, a, b), "tsort": lambda: _Short([" ".join(sorted(t.split())) for t in mine]).ratios(a, b),  # noqa: B023
                "partial": lambda: short.partial_ratios(a, b), "jw": lambda: jaro_winklers(*pairs()),  # noqa: B023
            }
            out.append([made[c]() for c in names])
        else:
            longer = {"ratio": ratios, "tset": token_set_ratios, "tsort": token_sort_ratios, "partial": partial_ratios, "jw": jaro_winklers}
            out.append([longer[c](*pairs()) for c in names])
    return {c: np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k, c in enumerate(names)}


def _over_pairs(scorer: Callable[[list[str], list[str]], np.ndarray]):
    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], int] = {}
        at = [seen.setdefault((x or "", y or ""), len(seen)) for x, y in zip(a, b, strict=True)]
        return pd.Series(scorer([x for x, _ in seen], [y for _, y in seen])[at] if at else [], dtype="float64")

    return score


def col_scores(a, b, *names: str):
    """A struct of the named scores of ``text_scores`` over two string columns: one pass over a batch for all of them."""

    @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in names]))
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        i, one = pd.factorize(a.fillna(""))
        j, two = pd.factorize(b.fillna(""))
        pairs, back = np.unique(i.astype(np.int64) * max(1, len(two)) + j, return_inverse=True)
        i, j = np.divmod(pairs, max(1, len(two)))
        return pd.DataFrame({c: x[back] for c, x in text_scores([*one, *two], i, j + len(one), names).items()})

    return score(a, b)


#: Each scorer over two string columns.
col_ratio, col_token_set, col_token_sort, col_partial, col_jaro_winkler = map(_over_pairs, (ratios, token_set_ratios, token_sort_ratios, partial_ratios, jaro_winklers))
