"""A lexicon by hashes of its entries, for looking up all runs of the syllables, or of characters, of an Arrow batch at once."""

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bases of the two hashes of a run, Σ code * base^place: one modulo 2^64, one modulo a prime (fixed values).
BASE, PRIME_BASE, PRIME = 0x9E3779B97F4A7C15, 1_220_703_123, (1 << 31) - 1
INVERSE, PRIME_INVERSE = pow(BASE, -1, 1 << 64), pow(PRIME_BASE, -1, PRIME)
#: Bytes of a table for an entry, besides its meaning: both hashes, an offset, and its share of the index and of the marks.
ENTRY_BYTES = 48
#: Places whose runs are looked up at once.
PLACES = 1 << 15


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)[:n]


@lru_cache(maxsize=8)
def known_powers(base: int, bits: int, of_prime: bool = False) -> np.ndarray:
    """The first 2^bits powers of a base, kept from batch to batch: modulo PRIME or 2^64."""
    return prime_powers(base, 1 << bits) if of_prime else powers(base, 1 << bits)


def first_powers(base: int, n: int, of_prime: bool = False) -> np.ndarray:
    """base^0 to base^(n - 1)."""
    return known_powers(base, max(20, n.bit_length()), of_prime)[:n]


def prime_powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1), modulo PRIME."""
    step = 1024
    small, large = [1], [1]
    for _ in range(step - 1):
        small.append(small[-1] * base % PRIME)
    jump = small[-1] * base % PRIME
    for _ in range(n // step):
        large.append(large[-1] * jump % PRIME)
    return (np.array(large, np.uint64)[:, None] * np.array(small, np.uint64) % np.uint64(PRIME)).ravel()[:n]


class Hashes:
    """Hashes of any run of characters by the sums before its first and its last one."""

    def __init__(self, chars: np.ndarray):
        codes, self.codes = chars.astype(np.uint64), chars
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * first_powers(BASE, len(codes)), out=self.sums[1:])
        self.back = first_powers(INVERSE, len(codes) + 1)
        self.prime = None

    def first(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]

    def second(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.prime is None:
            n, p = len(self.codes), np.uint64(PRIME)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.codes.astype(np.uint64) * first_powers(PRIME_BASE, n, True) % p, out=sums[1:])
            self.prime = sums, first_powers(PRIME_INVERSE, n + 1, True)
        sums, back = self.prime
        return ((sums[ends] - sums[starts]) % np.uint64(PRIME) * back[starts] % np.uint64(PRIME)).astype(np.uint32)


def hashed(chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each of the texts, none of them null."""
    import pyarrow.compute as pc

    chars = np.frombuffer("".join(chunks.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64))
    starts, of = np.concatenate([[0], ends[:-1]]).astype(np.int64), Hashes(chars)
    return of.first(starts, ends), of.second(starts, ends)


def marks(chunks: pa.StringArray, bits: int) -> np.ndarray:
    """The upper bits of the first hash of each of the texts, none of them null."""
    return (hashed(chunks)[0] >> np.uint64(64 - bits)).astype(np.int64)


def characters(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes): the characters of all texts, one after the other, and how many each has; null ones have none."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


def letter_runs(texts: pa.StringArray) -> pa.StringArray:
    """The runs of a-z of texts, one after the other, each as often as it occurs; null texts have none."""
    texts = texts.drop_null()
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    letter = raw - np.uint8(ord("a")) < 26
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    rows = (offsets[:-1] - offsets[0])[offsets[:-1] < offsets[-1]]
    start[rows] = letter[rows]
    at = np.append(np.flatnonzero(start[letter]), np.count_nonzero(letter)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw[letter].tobytes()))


def marked(texts: pa.StringArray, table: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end), by row: the runs of characters of these lengths whose marks a table of bits has, equal ones (by 95 bits) once a row."""
    chars, sizes = characters(texts)
    of, shift, stops = Hashes(chars), np.uint64(64 - (8 * len(table)).bit_length() + 1), np.repeat(np.cumsum(sizes), sizes)
    rows, out = np.repeat(np.arange(len(sizes)), sizes), []
    places = np.arange(len(chars))
    for length in sorted(lengths):
        places = places[places + length <= stops[places]]
        if not len(places):
            break
        first = of.first(places, places + length)
        mark = (first >> shift).astype(np.int64)
        hit = np.flatnonzero(table[mark >> 3] >> (mark & 7).astype(np.uint8) & 1)
        start = places[hit]
        first, second, row = first[hit], of.second(start, start + length), rows[start]
        order = np.lexsort((second, first, row))
        first, second, row = first[order], second[order], row[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (row[1:] != row[:-1])
        out.append(np.stack([row[fresh], start[order[fresh]], start[order[fresh]] + length]))
    found = np.concatenate(out, 1) if out else np.empty((3, 0), np.int64)
    row, start, end = found[:, np.argsort(found[0], kind="stable")]
    return row, start, end


def strings(texts: pa.StringArray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(row, string) of runs of characters of texts."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    chars = characters(texts)[0][np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int32)
    raw = chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return row, pa.StringArray.from_buffers(len(row), pa.py_buffer(at.tobytes()), pa.py_buffer(raw))


class Entries:
    """A lexicon's entries in the order of their first hash, with an index by its upper bits; meanings are in the same order.

    A run is an entry if 95 bits of hashes agree. What an entry takes doesn't depend on how long it is. A bit at the uppermost bits of
    each first hash, of 16 or more for an entry, tells most runs that are none from a table that stays in a processor's cache.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, meanings: pa.StringArray):
        order = np.argsort(first, kind="stable")
        self.first, self.second = first[order], second[order]
        self.meanings = meanings.take(pa.array(order))
        bits = max(4, int(4 * len(first)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.index = np.searchsorted(self.first >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.mark_shift = self.shift - np.uint64(2)
        marked = np.zeros(1 << (bits + 2), bool)
        marked[(self.first >> self.mark_shift).astype(np.int64)] = True
        self.marks = np.packbits(marked, bitorder="little")

    @classmethod
    def of(cls, chunks: list[str], meanings: list[str]) -> "Entries":
        return cls(*hashed(pa.array(chunks, pa.string())), pa.array(meanings, pa.string()))

    def hits(self, first: np.ndarray, second=None) -> tuple[np.ndarray, np.ndarray]:
        """(which, entry): the runs with these hashes that are entries; second(which) gives the second hashes of some of them. Without it the first decides."""
        mark = (first >> self.mark_shift).view(np.int64)
        alive = np.flatnonzero(self.marks[mark >> 3] >> (mark & 7).astype(np.uint8) & 1)
        wanted, bucket = first[alive], mark[alive] >> 2
        at, stop = self.index[bucket], self.index[bucket + 1]
        out = []
        while len(alive):
            same = np.flatnonzero(self.first[at] == wanted)
            good = same if second is None else same[self.second[at[same]] == second(alive[same])]
            out.append((alive[good], at[good].astype(np.int64)))
            at = at + 1
            at[good] = stop[good]
            keep = np.flatnonzero(at < stop)
            alive, at, stop, wanted = alive[keep], at[keep], stop[keep], wanted[keep]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2

    def find(self, first: np.ndarray, second) -> np.ndarray:
        """The entries of runs with these hashes, -1 without one."""
        out = np.full(len(first), -1, np.int64)
        which, entry = self.hits(first, second)
        out[which] = entry
        return out

    def standing(self, syllables, k: int, surely: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(place, entry): where k syllables of a text are an entry. Not surely, the first hash alone decides.

        Places are taken some at a time, so that what is worked out for them stays in a processor's cache.
        """
        of, char_at, out = syllables.hashes, syllables.char_at, []
        for lo in range(0, syllables.n - k + 1 if len(self.first) else 0, PLACES):
            hi = min(lo + PLACES, syllables.n - k + 1)
            sums = of.sums[char_at[lo : hi + k]]
            second = (lambda which, lo=lo: of.second(char_at[lo + which], char_at[lo + which + k])) if surely else None
            which, entry = self.hits((sums[k:] - sums[:-k]) * of.back[char_at[lo:hi]], second)
            inside = np.flatnonzero(lo + which + k <= syllables.row_end[lo + which])
            out.append((lo + which[inside], entry[inside]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2

    def matches(self, syllables, longest: int) -> list[np.ndarray]:
        """For each number of syllables, 1 to longest, the entry that so many from each place on make, -1 without one."""
        out = [np.full(syllables.n, -1, np.int64) for _ in range(longest)]
        for k, found in enumerate(out, 1):
            places, entry = self.standing(syllables, k)
            found[places] = entry
        return out

    def held(self, syllables, longest: int, surely: bool) -> np.ndarray:
        """A row of longest + 1 booleans for each place and one behind the last: whether so many syllables from there on, one more than the column's number, make an entry.

        The last column holds nothing. Not surely, the first hash alone decides.
        """
        out = np.zeros((syllables.n + 1, longest + 1), bool)
        for k in range(1, longest + 1):
            out[self.standing(syllables, k, surely)[0], k - 1] = True
        return out

    def at(self, syllables, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entries that the runs from syllable to syllable make by both hashes, -1 without one."""
        a, z = syllables.char_at[starts], syllables.char_at[ends]
        return self.find(syllables.hashes.first(a, z), lambda which: syllables.hashes.second(a[which], z[which]))
