"""Exact tokenizer output for whole texts, through caches of white-space-delimited pre-tokens.

The tokenizer's own pre-tokenizer never crosses ASCII white space and its normaliser composes nothing across it,
so the tokens of a text are the tokens of its pre-tokens, one after the other. Texts that hold the opening of a
special token string go to the library whole, since those strings are matched before anything is split; so do texts
with capitals whose lower case composes with a mark that follows, since the library composes before it lower-cases.
"""

from __future__ import annotations

import functools
import os
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from foliant.llm.common import worker_cache

#: Pre-tokens over this many bytes are encoded each time and not kept.
KEEP_BYTES = 64
#: Entries a worker keeps, in two generations: when the younger is half of this, it becomes the older, whose place it takes.
KEEP_WORDS = 600_000
#: Pre-tokens given to the library in one call.
AT_ONCE = 1024
#: After a lower-case ASCII letter, the tokenizer's own splitting puts a border before a run of ASCII punctuation.
MARKS = string.punctuation.encode()
#: Letters whose lower case is one letter: a word of these is one pre-token.
LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: With combining marks, the lower case of these composes otherwise than they do (W and a ring, I and a dot).
OPEN = re.compile(rb"[HIJTWY][\x80-\xff]").search
#: Bytes of text whose misses are looked up together.
BLOCK_BYTES = 1 << 18


@functools.cache
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.model._resize_cache(0)  # words come here once; the worker's cache holds them
    return found


@functools.cache
def letters_tokenizer(name: str):
    """The same model for lower-case words of LETTERS, which its normaliser leaves alone and its splitting leaves whole."""
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.model._resize_cache(0)
    found.normalizer = None
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return found


@functools.cache
def specials(name: str) -> tuple[str, int, tuple[bytes, ...]]:
    """One special string and its id, and how special strings begin."""
    added = tokenizer(name).get_added_tokens_decoder()
    k = min(added)
    return added[k].content, k, tuple({t.content[:2].encode() for t in added.values()})


def encode_whole(name: str, raw: bytes) -> bytes:
    return np.array(tokenizer(name).encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def count(ids: bytes) -> int:
    """How many ids these bytes hold."""
    return len(ids) >> 2


@functools.cache
def word_ends(name: str) -> np.ndarray:
    """By id: whether the token closes a pre-token."""
    vocab = tokenizer(name).get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
    return ends


def encode_words(name: str, words: list[bytes]) -> Iterator[bytes]:
    """The ids of each word (little-endian unsigned 32-bit), in order; no word may hold white space or a special string.

    Words of plain Latin letters are one pre-token each: they are joined by spaces and cut where a token closes a pre-token.
    The others are joined by a special string.
    """
    mark, mark_id, _ = specials(name)
    ends, tok = word_ends(name), tokenizer(name)
    for at in range(0, len(words), AT_ONCE):
        part = [w.decode() for w in words[at : at + AT_ONCE]]
        plain = [w for w in part if LETTERS(w)]
        got = {}
        if plain:
            ids = np.array(letters_tokenizer(name).encode_batch_fast([" ".join(plain).lower()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            assert len(cuts) == len(plain), "a word of letters gave other than one pre-token"
            raw = ids.tobytes()
            got.update(zip(plain, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
        if len(plain) < len(part):
            other = [w for w in part if w not in got]
            ids = np.array(tok.encode_batch_fast([mark.join(other)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == mark_id)).tolist()
            raw = ids.tobytes()
            got.update(zip(other, [raw[a:b] for a, b in zip([0, *(k + 4 for k in cuts)], [*cuts, len(raw)])]))
        yield from map(got.__getitem__, part)


def blocks(raws: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts, about BLOCK_BYTES together."""
    own, size = [], 0
    for raw in raws:
        own.append(raw)
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def composes_late(raw: bytes) -> bool:
    """Whether lower-casing before composing may give other letters than the tokenizer, which composes first (the marks begin with CC, or are CD 84)."""
    return (b"\xcc" in raw or b"\xcd\x84" in raw) and OPEN(raw) is not None


def look_up(words: list[bytes], known: dict) -> tuple[list, list[int], list[bytes]]:
    """The known values in the words' order (None: unknown), the places of the unknown words, and these words.

    The words go when the text has been looked up; a scan for None from miss to miss touches no other word."""
    values, at = list(map(known.get, words)), []
    k = -1
    for _ in range(values.count(None)):
        k = values.index(None, k + 1)
        at.append(k)
    return values, at, [words[k] for k in at]


def per_text(name: str, raws: Iterable[bytes], of: str, value, join, frequent: dict | None = None, keep: int = KEEP_WORDS) -> Iterator:
    """For each text: join over its pre-tokens' values (value(ids), to be added up), which come from the frequent tier, the worker's cache or the library."""
    marks = specials(name)[2]
    cache = worker_cache(f"{name} {of}")
    cache.setdefault("young", {}).update(frequent or {})
    cache.setdefault("old", {})
    for block in blocks(raws):
        if len(cache["young"]) > keep // 2 + len(frequent or {}):
            cache["young"], cache["old"] = dict(frequent or {}), cache["young"]
        known, old = cache["young"], cache["old"]
        # the tokenizer lower-cases after it has matched special strings, so A-Z may be lowered here in texts without any
        found = [None if any(m in raw for m in marks) or composes_late(raw) else look_up(raw.lower().split(), known) for raw in block]
        fresh = {w for own in found if own is not None for w in own[2]}
        extra = {w: old[w] for w in fresh if w in old}
        fresh.difference_update(extra)
        tails = {}
        for w in fresh:
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and stem and 97 <= stem[-1] <= 122:
                tails[w] = stem, w[len(stem) :]
        parts = set(chain.from_iterable(tails.values())).difference(known, extra)
        extra.update((w, old[w]) for w in parts if w in old)
        need = list((fresh - tails.keys()) | (parts - extra.keys()))
        extra.update(zip(need, map(value, encode_words(name, need))))
        for w, (a, b) in tails.items():
            extra[w] = (known[a] if a in known else extra[a]) + (known[b] if b in known else extra[b])
        for raw, own in zip(block, found):
            if own is None:
                yield join([value(encode_whole(name, raw))])
            else:
                values, at, words = own
                for k, w in zip(at, words):
                    values[k] = extra[w]
                yield join(values)
        known.update((w, x) for w, x in extra.items() if len(w) <= KEEP_BYTES)


def token_counts(name: str, raws: Iterable[bytes], frequent: dict[bytes, int] | None = None) -> Iterator[int]:
    return per_text(name, raws, "length", count, sum, frequent)


def token_ids(name: str, raws: Iterable[bytes], keep: int = KEEP_WORDS) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    return per_text(name, raws, "ids", bytes, b"".join, keep=keep)
