"""Novelty tells random keys from identifiers, paths, dates and UUIDs; scans are linear in what a text holds."""

import random
import string
import time
import uuid

import pytest

from lexicarta.llm.secrets import Novelty, base_spans, identifier_words, merged, novel_spans

public_tokenizers = pytest.importorskip("public_tokenizers")
NOUNS = (
    "account settings page user profile config manager handler service request response cache index table column value button form field order "
    "customer invoice payment login project version release build test module package client server remote network stream buffer reader writer "
    "parser image audio media player queue worker thread memory storage record entry list number event listener promise result error message "
    "channel topic schema migration backup snapshot cluster node region volume bucket object policy role member owner report chart layout theme"
).split()


@pytest.fixture(scope="module")
def novelty():
    return Novelty(identifier_words(public_tokenizers.path("word_bpe_49k.json")))


def named(rng):
    parts = [rng.choice(NOUNS) for _ in range(rng.randint(2, 4))]
    n = str(rng.randint(0, 99))
    kind = rng.randrange(6)
    if kind == 0:
        return "".join(p.title() for p in parts) + n
    if kind == 1:
        return "_".join([*parts, n])
    if kind == 2:
        return "-".join([*map(str.upper, parts), "V" + n])
    if kind == 3:
        return "/" + "/".join([*parts, rng.choice(["v1", "2024", "x86_64", "lib64"])])
    if kind == 4:
        return f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}-{rng.randint(0, 59):02d}"
    return str(uuid.UUID(int=rng.getrandbits(128)))


def test_identifiers_stay_and_keys_are_found(novelty):
    rng = random.Random(21)
    context = lambda x: f"the settings say that the private key is {x} and that the host keeps it"
    names = [x for x in (named(rng) for _ in range(2000)) if len(x) >= 16][:1000]
    kept = [x for x in names if novel_spans(context(x), [], novelty)]
    assert len(names) == 1000 and len(kept) <= 50, kept
    letters = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"]
    keys = ["".join(rng.choice(letters[k % 4]) for _ in range(rng.randint(20, 31 if k % 4 == 3 else 80))) for k in range(200)]
    found = [k for k in keys if [(a, b) for a, _, b, _ in novel_spans(context(k), [], novelty)] == [(context(k).index(k), context(k).index(k) + len(k))]]
    assert len(found) >= 190


def test_what_the_text_around_says_is_not_novel(novelty):
    key = "Zq8vK2xW9rT4yB7nM3cL6pD1"
    assert novel_spans(f"secret {key} here", [], novelty)
    assert not novel_spans(f"seen {key}, and the secret is {key}-2 here"[5:], [], novelty)[1:]
    assert novelty.of(key, key) < 0.6 < 1.0 < novelty.of(key, "")


def test_tokens_with_dots_are_one(novelty):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5NXgL0n3I9"
    assert [(a, b) for a, _, b, _ in novel_spans(f"bearer {token}.", [], novelty)] == [(7, 7 + len(token))]


def test_scans_are_linear(novelty):
    text, began = " ".join(f"token=abcdefgh{i}" for i in range(100_000)), time.time()
    spans = base_spans(text)
    assert len(spans) == 100_000 and novel_spans(text, spans, novelty) == [] and time.time() - began < 10
    assert novel_spans("token_" * 20_000 + "1", [], novelty) == [] and time.time() - began < 12


def test_merged_spans():
    assert merged([(5, 0, 9), (0, 2, 3), (8, 1, 12), (3, 0, 4), (20, 1, 21)]) == ([0, 5, 20], [4, 12, 21])
    assert merged([]) == ([], [])
