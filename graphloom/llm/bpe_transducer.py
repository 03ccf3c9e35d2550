"""Byte-pair encoding as a lazily determinised finite-state transducer, and its streaming inverse.

A sequence of tokens is what the merges make of its bytes exactly if every token is what the merges
make of its own bytes and every adjacent pair is what they make of the pair's bytes. That turns the
merge list into a transducer over bytes: it may guess a token start anywhere, reads along the
vocabulary's prefixes, and completes a token only if the pair with the token before it is stable.
After each byte exactly one guess has the whole prefix encoded; the others are tokens still open.

The transducer is determinised while it is used (subset construction with residual outputs): a
state is the set of open guesses with the tokens each of them still owes, relative to the tokens
that all of them share. What they share is emitted at once. A guess dies with the longest token at
the latest, so a token is emitted after a lookahead bounded by that length. States and transitions
are kept in bounded tables that are emptied when full, which changes no output.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import regex

# The public pre-tokenisation pattern of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

State = int
NONE = -1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Encodes the bytes of one pre-token."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 400_000) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.sorted = sorted(ranks)
        self.max_states = max_states
        self.stable: dict[tuple[int, int], bool] = {}
        self.open: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, State] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple[State, tuple[int, ...]]]] = []
        self.final: list[tuple[int, ...]] = []
        self.start = self._state(NONE, (((), b""),))

    def _state(self, last: int, guesses: tuple) -> State:
        key = (last, guesses)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.final.append(guesses[-1][0])
        return found

    def merge(self, data: bytes) -> list[int]:
        """The merges applied in order of rank: what defines the encoding."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _is_stable(self, left: int, right: int) -> bool:
        got = self.stable.get((left, right))
        if got is None:
            if len(self.stable) >= 4 * self.max_states:
                self.stable.clear()
            if left == NONE:
                got = self.merge(self.tokens[right]) == [right]
            else:
                got = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self.stable[left, right] = got
        return got

    def _is_open(self, part: bytes) -> bool:
        """Some longer token begins with part."""
        got = self.open.get(part)
        if got is None:
            if len(self.open) >= 4 * self.max_states:
                self.open.clear()
            at = bisect_left(self.sorted, part)
            at += at < len(self.sorted) and self.sorted[at] == part
            got = self.open[part] = at < len(self.sorted) and self.sorted[at].startswith(part)
        return got

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The transition of a state on a byte, made when first asked for."""
        last, guesses = self.states[state]
        c = bytes((byte,))
        guessed, whole = [], None
        for owed, part in guesses:
            part += c
            if whole is None:
                token = self.ranks.get(part)
                if token is not None and self._is_stable(owed[-1] if owed else last, token):
                    whole = (*owed, token)
            if self._is_open(part):
                guessed.append((owed, part))
        if whole is None:
            raise ValueError("the vocabulary lacks a byte or its merges are not proper")
        shared = len(whole)
        for owed, _ in guessed:
            n = 0
            while n < shared and n < len(owed) and owed[n] == whole[n]:
                n += 1
            shared = n
        emitted = whole[:shared]
        if shared:
            last = emitted[-1]
            guessed = [(owed[shared:], part) for owed, part in guessed]
        if not any(not owed for owed, _ in guessed) and whole[shared:]:
            last = NONE
        made = (self._state(last, (*guessed, (whole[shared:], b""))), emitted)
        self.next[state][byte] = made
        return made

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
        state, out, table = self.start, [], self.next
        for byte in data:
            made = table[state].get(byte)
            if made is None:
                made = self.step(state, byte)
                if len(self.states) > 2 * self.max_states:  # within one very long pre-token
                    last, guesses = self.states[made[0]]
                    self.reset()
                    table, made = self.next, (self._state(last, guesses), made[1])
            state, emitted = made
            if emitted:
                out += emitted
        out += self.final[state]
        return out


class _Memo(dict):
    """Outputs by input; emptied when full, which changes no output."""

    def __init__(self, of, most: int) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self.of(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """Encodes whole texts: pieces, then pre-tokens by the pattern, then bytes by the transducer.

    A space before a character that isn't white space always begins a pre-token, so a text is cut
    there first; pieces and pre-tokens repeat and are remembered.
    """

    PIECE = re.compile(r"(?= \S)")

    def __init__(self, path: str, memo: int = 400_000) -> None:
        self.transducer = Transducer(read_ranks(path))
        self.pattern = regex.compile(PATTERN)
        self.words = _Memo(lambda w: tuple(self.transducer.encode(w.encode("utf-8", "replace"))), memo)
        self.pieces = _Memo(self._piece, memo)

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.pattern.findall(piece))))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; [] of null and of the empty text."""
        if not text:
            return []
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.PIECE.split(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(Utf8Stream(self.transducer.tokens).feed_all(ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary."""
    return Encoder(path)


class Utf8Stream:
    """Text of a stream of ids, token by token, by a UTF-8 state machine.

    The state is what is still due: the number of continuation bytes and the range of the next one
    (which rules out overlong forms, surrogates and code points past U+10FFFF). Tokens may end
    within a character; its text comes with the token that completes it. A maximal part of a broken
    sequence gives one U+FFFD, as in the Unicode standard's recommended practice.
    """

    # Lead byte ranges of UTF-8 with continuation count and range of the second byte.
    LEADS = (
        (0xC2, 0xDF, 1, 0x80, 0xBF),
        (0xE0, 0xE0, 2, 0xA0, 0xBF),
        (0xE1, 0xEC, 2, 0x80, 0xBF),
        (0xED, 0xED, 2, 0x80, 0x9F),
        (0xEE, 0xEF, 2, 0x80, 0xBF),
        (0xF0, 0xF0, 3, 0x90, 0xBF),
        (0xF1, 0xF3, 3, 0x80, 0xBF),
        (0xF4, 0xF4, 3, 0x80, 0x8F),
    )

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.lead = {b: (n, lo, hi) for a, z, n, lo, hi in self.LEADS for b in range(a, z + 1)}
        self.due, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, token: int) -> str:
        data = self.tokens[token]
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.code = self.code << 6 | byte & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                self.due = 0
                self.low, self.high = 0x80, 0xBF
                out.append("�")
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in self.lead:
                self.due, self.low, self.high = self.lead[byte]
                self.code = byte & (0x3F >> self.due)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        cut, self.due, self.low, self.high = self.due, 0, 0x80, 0xBF
        return "�" if cut else ""

    def feed_all(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            yield self.feed(i)
        yield self.finish()
