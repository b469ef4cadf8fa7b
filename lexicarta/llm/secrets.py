"""Secret scans: patterns, and dictionary-primed zstandard novelty.

Beside the fixed patterns, each string of letters, digits and joining marks near a sensitive word, before or after it, is a candidate. Its
novelty is what it adds, in compressed bytes a character, to the text around it, in a frame primed with a dictionary of identifiers: the
words of a public vocabulary, the commonest nearest. Words of an identifier, cut at its marks, humps and digits, then cost a match each,
and each letter of a random string costs itself. Strings that hardly compress against both are reported as well.
"""

import json
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicarta.llm.shared import map_rows, worker_object

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns of the contract; letters of the assigned names come in either case.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Words that make a context sensitive, and what candidates look like.
SENSITIVE = re.compile(r"(?ia)passw|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization")
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
#: Dates, times and UUIDs, which are no secrets: what is left of a candidate without them counts.
FORMS = re.compile(
    r"(?:19|20)\d\d[-_/.]?[01]\d[-_/.]?[0-3]\d(?:[T_-]?[0-2]\d[-_.]?[0-5]\d(?:[-_.]?[0-5]\d)?Z?)?|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
)
#: Words of the vocabulary in the dictionary, those that stand in each frame before the text around, and the compressor's level.
WORDS, CARRIED, LEVEL = 25_000, 60, 12
#: Long candidates are measured in parts of so many characters, each against the same text around: a frame of random letters would soon expect them.
PART = 64
#: Series that people type, for the dictionary.
SERIES = "abcdefghijklmnopqrstuvwxyz_0123456789_1234567890_qwertyuiop_asdfghjkl_zxcvbnm_00000000000000000000_xxxxxxxxxxxxxxxxxxxx_"
#: Code points between a sensitive word and a candidate at most, text around one that counts, and novelty in bytes a character.
#: At 1.0 about one in a hundred identifiers and paths is reported, and 99 of a hundred random keys of 20 characters or more.
REACH, AROUND, NOVELTY = 64, 256, 1.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping for each kind, short ones dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def identifier_words(path: str) -> list[str]:
    """The words of a tokenizer's vocabulary, of 3 to 14 ASCII letters, commonest first."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = (p.removesuffix("</w>") for p in sorted(vocabulary, key=vocabulary.get))
    return list(dict.fromkeys(p.lower() for p in pieces if 3 <= len(p) <= 14 and p.isascii() and p.isalpha()))[:WORDS]


def plain(s: str) -> str:
    """A string as its words: cut at humps, before digits and at marks, in lower case."""
    cut = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])", "_", s)
    return re.sub(r"[^A-Za-z0-9]+", "_", cut).lower()


class Novelty:
    """What strings add to the text around them, in compressed bytes a character."""

    def __init__(self, words: list[str]):
        import zstandard

        body = "_" + "_".join(reversed(words)) + "_" + SERIES
        known = zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        self.frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.carrier = "_" + "_".join(words[:CARRIED]) + "_"

    def size(self, text: str) -> int:
        return len(self.frame.compress(text.encode()))

    def of(self, candidate: str, around: str) -> float:
        left = FORMS.sub("", candidate)
        if len(left) < SHORTEST or not mixed(left):
            return 0.0
        before = f"{self.carrier}{plain(around)}_"
        parts = range(0, max(1, len(left) - PART + 1), PART)  # the last one takes the rest
        added = sum(self.size(f"{before}{plain(left[i : i + PART] if i < parts[-1] else left[i:])}_") for i in parts)
        return (added - len(parts) * self.size(before)) / len(candidate)


def mixed(s: str) -> bool:
    """Letters and digits both: words, rules and plain numbers are no candidates."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the stretches that spans (start, kind, end) cover together, in order."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, novelty) of incompressible candidates that no base span meets.

    A candidate is an unbroken string of any length with a sensitive word within reach of either end, or inside, at most
    one span each; only if it isn't novel as a whole (or meets a base span) is it tried from each word inside it to the next.
    """
    words = [m.span() for m in SENSITIVE.finditer(text)]
    starts, out = [a for a, _ in words], []
    covered, covered_to = merged(taken)
    for c in CANDIDATE.finditer(text) if words else ():
        first, end = c.span()
        if end - first < SHORTEST:
            continue
        n = bisect_right(starts, first)
        inside = starts[n : bisect_right(starts, end - SHORTEST)]
        after = bisect_right(starts, end - 1)
        if not inside and not (n and first <= words[n - 1][1] + REACH) and not (after < len(starts) and starts[after] <= end + REACH):
            continue
        for at, to in ((first, end), *zip(inside, [*inside[1:], end], strict=False)):
            k = bisect_left(covered_to, at + 1)  # the first covered stretch that ends behind at
            if to - at < SHORTEST or not mixed(text[at:to]) or k < len(covered) and covered[k] < to:
                continue
            worth = novelty.of(text[at:to], text[max(0, at - AROUND) : at] + " " + text[to : to + AROUND])
            if worth >= NOVELTY:
                out.append((at, 3, to, worth))
                break
    return out


def scan_secrets(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(row, spans) of each row of docs: spans is an array of (kind, start, end, novelty), ends exclusive, in code points.

    Spans come by start, then kind as in KINDS; novelty is null of the fixed patterns. A null text has no spans. vocabulary is the path of a
    public tokenizer's file (JSON), for the dictionary of identifiers; word_bpe_49k.json if not given. Its words, WORDS at most, go to all tasks.
    Each row gets its own result, with a null or repeated id too; an empty table gives an empty one.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    words = identifier_words(vocabulary)

    def spans(texts):
        novelty = worker_object(("secrets", vocabulary), lambda: Novelty(words))
        out = []
        for t in texts:
            base = base_spans(t or "")
            found = [(*s, None) for s in base] + novel_spans(t or "", base, novelty)
            out.append([{"kind": KINDS[k], "start": a, "end": b, "novelty": x} for a, k, b, x in sorted(found, key=lambda s: s[:3])])
        return [out]

    return map_rows(docs, spans, "spans array<struct<kind:string,start:long,end:long,novelty:double>>", text)


def joined_spans(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
