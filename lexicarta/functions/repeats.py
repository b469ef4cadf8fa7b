"""All repeats of a text, and the walk that leaves one copy of each."""

import re

import numpy as np

#: Texts of up to so many characters are searched with the pattern of the shortest double; of longer ones all runs are found first. Both give the same.
SHORT = 256
DOUBLE = re.compile(r"(?s)(..+?)\1")


def renamed(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def ranks(letters: np.ndarray) -> list[np.ndarray]:
    """For each power of two, the rank of the stretch of so many letters from each place on; stretches that the end cuts off rank below longer ones."""
    out, step, n = [renamed(letters)], 1, len(letters)
    while step < n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = out[-1][step:] + 1
        out.append(renamed(out[-1] * (n + 1) + ahead))
        step *= 2
    return out


def shared(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many letters from places i and j on are equal; places may be the text's length."""
    n, length = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        fits = np.maximum(i, j) + length + (1 << k) <= n
        a, b = np.where(fits, i + length, 0), np.where(fits, j + length, 0)
        length += np.where(fits & (names[k][a] == names[k][b]), 1 << k, 0)
    return length


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place, the next one of a smaller rank, or the end."""
    out, open_places = np.full(len(rank), len(rank)), []
    for i, r in enumerate(rank.tolist()):
        while open_places and open_places[-1][1] > r:
            out[open_places.pop()[0]] = i
        open_places.append((i, r))
    return out


def all_runs(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every maximal stretch that holds its smallest period at least twice.

    Each has a Lyndon word as its period, in one of the two orders of letters; the longest Lyndon word from each place ends
    where the next smaller suffix begins. Common extensions to both sides, by names of stretches, give the run.
    """
    n = len(letters)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    ahead, back = ranks(letters), ranks(letters[::-1])
    found = []
    for names in (ahead, ranks(-renamed(letters))):
        i = np.arange(n)
        period = next_smaller(names[-1]) - i
        i, period = i[i + period < n], period[i + period < n]
        right = shared(ahead, i, i + period)
        left = shared(back, n - i, n - i - period)  # letters before i, read backwards
        start, end = i - left, i + period + right
        found.append(np.stack([start, end, period])[:, end - start >= 2 * period])
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def shortest_doubles(letters: np.ndarray) -> list[int]:
    """For each place, the smallest half (of two letters or more) of a stretch from there on that is two copies of it; 0 without one."""
    start, end, period = all_runs(letters)
    half = np.maximum(period, 2)
    out = np.zeros(len(letters), np.int64)
    for k in np.argsort(-half, kind="stable").tolist():
        last = end[k] - 2 * half[k]
        if last >= start[k]:
            out[start[k] : last + 1] = half[k]
    return out.tolist()


def kept_of_rest(back: list[int], size: int) -> int:
    """How much of the last size letters is kept if they are 4, 8 or 2 copies of two letters or more, else 0; back: shared_ahead() of the reversed text."""
    return next((size // k for k in (4, 8, 2) if size % k == 0 and size >= 2 * k and back[size // k] >= size - size // k), 0)


def shared_ahead(text: str) -> list[int]:
    """For each distance, how far the text from there on equals the text (the Z function)."""
    n = len(text)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def collapse_repeats(text: str) -> str:
    """From each place, the shortest stretch that is 4, 8 or 2 copies of two characters or more becomes one copy.

    The rest of the text as a whole is tried before stretches of it, and a whole text that repeats, of any length, first. What is
    4 or 8 copies is two copies of less, so the shortest stretch is always a double. All runs of a text are found first, in
    time that grows a little faster than the text.
    """
    text = text.strip()
    for k in (8, 4, 2):
        if text and len(text) % k == 0 and text[: len(text) // k] * k == text:
            return text[: len(text) // k]
    n = len(text)
    if n <= SHORT:
        if not DOUBLE.search(text):
            return text
        half_at = lambda at: len(m[1]) if (m := DOUBLE.match(text, at)) else 0
    else:
        doubles = shortest_doubles(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        half_at = doubles.__getitem__
    back, out, at = shared_ahead(text[::-1]), [], 0
    while at < n:
        rest = kept_of_rest(back, n - at)
        if rest:
            out.append(text[at : at + rest])
            break
        half = half_at(at)
        out.append(text[at : at + (half or 1)])
        at += 2 * half or 1
    return "".join(out)
