"""Byte-level BPE by the tokenizers library, one call for each distinct pre-token of a batch.

A byte-level tokenizer never merges across pre-tokens, so the tokens of a text are those of its pre-tokens one after
another. The split is done here by the same pattern; a character whose class the two pattern engines see differently
(Unicode versions drift) sends its whole text through the library, so the result is always the library's.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush

import regex
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

#: The pattern by which byte-level tokenizers of this family split a text; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
#: Pre-tokens of one generation that a worker remembers; it has two.
MEMO = 300_000


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in byte_chars().items()}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


def splits(ranks: dict[bytes, int]) -> dict[bytes, list[int]]:
    """For each token the places at which two tokens make it up."""
    return {t: [i for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks] for t in ranks}


def overlaps(ranks: dict[bytes, int]) -> set[bytes]:
    """Strings p + q + r in which p + q and q + r are one and the same token by different pairs.

    Only in text with such a string can it matter which of two pairs that make one token counts first: by rank the leftmost
    does, by the library's list of pairs the one listed first.
    """
    out = set()
    for t, at in splits(ranks).items():
        places = set(at)
        out |= {t[:i] + t for i in at if len(t) - i in places and 2 * i != len(t) and t.startswith(t[i:])}
    return out


def by_rank(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbouring parts that make a token, the lowest ranked and leftmost pair merges."""
    after, before, parts = [*range(1, len(word) + 1)], [*range(-1, len(word) - 1)], [word[i : i + 1] for i in range(len(word))]
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heappush(heap, (r, i, parts[i] + parts[j]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, made = heappop(heap)
        j = after[i] if parts[i] else len(parts)
        if j < len(parts) and parts[i] + parts[j] == made:
            parts[i], parts[j], after[i] = made, b"", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
    return [ranks[p] for p in parts if p]


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str = PATTERN) -> Tokenizer:
    """A tokenizers BPE with the merges that a rank file implies: every pair of tokens that makes a token, by its rank."""
    show = byte_chars()
    text = {t: "".join(show[b] for b in t) for t in ranks}
    at = splits(ranks)
    merges = [(text[t[:i]], text[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in at[t]]
    out = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Classes:
    """Which characters both pattern engines split alike; asked once for each character met."""

    def __init__(self, tokenizer: Tokenizer):
        self.pre, self.same, self.other = tokenizer.pre_tokenizer, set(), set()

    def _alike(self, c: str) -> bool:
        for probe in (f"a{c}a", f"1{c}1", f"!{c}!", f"a {c} a", f"a{c}{c}a"):
            at, mine = 0, []
            for m in SPLIT.finditer(probe):
                mine.append((m.start(), m.end()))
            if mine != [span for _, span in self.pre.pre_tokenize_str(probe)]:
                return False
        return True

    def agreed(self, text: str) -> bool:
        new = set(text) - self.same
        for c in new:
            if c not in self.other:
                (self.same if self._alike(c) else self.other).add(c)
        return new.isdisjoint(self.other)


def shown(word: str) -> str:
    """The word's bytes as the characters that the library's vocabulary has for them."""
    return "".join(map(byte_chars().__getitem__, word.encode()))


class Memo:
    """Values of pre-tokens, kept between batches within a bound: when the young ones are too many they become the old ones,
    and of those only what is met again stays."""

    def __init__(self, make, bound: int = MEMO):
        self.make, self.bound, self.known, self.old = make, bound, {}, {}

    def of(self, words: list[str]) -> dict:
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.bound:
                self.known, self.old, new = {}, self.known, set(words)
            again = new & self.old.keys() if self.old else ()
            self.known.update((w, self.old[w]) for w in again)
            new = list(new.difference(again))
            self.known.update(zip(new, self.make(new), strict=True))
        return self.known
