"""BPE vocabularies compiled for exact left-to-right work (used by operators 2 and 10).

A vocabulary is a set of base symbols and a ranked list of merges.  Two facts carry everything here:

* Two neighbouring tokens can stand side by side in an encoding only if undoing their merges, latest first, never shows a
  pair across the border that would have been merged sooner (``compatible``).
* Each prefix of a word has exactly one encoding, so it has one last token: the longest token that ends there and that is
  compatible with the last token of the prefix before it.

Tokens that end at a position come from a suffix automaton: a trie of all tokens with failure links, where every state
knows the longest token that is a suffix of what was read, and every token knows its longest proper suffix token.
"""

from __future__ import annotations

import gc
import json
import re

NO_RANK = -1
#: Bits of a base symbol, of a token and of a move's gain in packed keys; vocabularies beyond them are refused.
_SYM, _ID, _GAIN = 10, 24, 24


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte value."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class BpeTables:
    """Merge tables and suffix automaton of a vocabulary file; ids are the file's ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.special.values()) + 1
        if size > 1 << _ID:
            raise ValueError(f"ids up to {size - 1}; {(1 << _ID) - 1} is the highest that can be worked with")
        self.rank, self.left, self.right = [NO_RANK] * size, [0] * size, [0] * size
        self.merge: dict[int, int] = {}
        chars = byte_characters()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + self.end] for c in chars] if self.end else self.inner
        base = {*self.inner, *self.final}
        if len(base) > 1 << _SYM:
            raise ValueError(f"{len(base)} base symbols; {1 << _SYM} at the most")
        code = {t: n for n, t in enumerate(sorted(base))}
        self.inner_code, self.final_code = [code[t] for t in self.inner], [code[t] for t in self.final]
        spelled: dict[int, tuple[int, ...]] = {t: (n,) for t, n in code.items()}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if t not in spelled:
                self.rank[t], self.left[t], self.right[t] = r, x, y
                spelled[t] = spelled[x] + spelled[y]
            self.merge[x << _ID | y] = r
        raw = {t: bytes((b,)) for b, t in [*enumerate(self.inner), *enumerate(self.final)]}
        self.bytes_of = [b""] * size
        for t in spelled:
            self.bytes_of[t] = raw[t] if t in raw else self.bytes_of[self.left[t]] + self.bytes_of[self.right[t]]
        for s, t in self.special.items():
            self.bytes_of[t] = s.encode()
        self.length = [len(spelled.get(t, ())) for t in range(size)]
        self._automaton(spelled, size)
        self._fits: dict[int, bool] = {}

    def _automaton(self, spelled: dict[int, tuple[int, ...]], size: int) -> None:
        trie: dict[int, int] = {}
        depth, here, at = [0], [-1], [0] * size
        for t, symbols in spelled.items():
            s = 0
            for c in symbols:
                k = s << _SYM | c
                s = trie.get(k, 0) or trie.setdefault(k, len(depth))
                if s == len(depth):
                    depth.append(depth[trie[k] and k >> _SYM] + 1)
                    here.append(-1)
            here[s], at[t] = t, s
        fail, longest = [0] * len(depth), here[:]
        for k in sorted(trie, key=lambda k: depth[trie[k]]):
            s, c, n = k >> _SYM, k & ((1 << _SYM) - 1), trie[k]
            f = fail[s]
            while f and f << _SYM | c not in trie:
                f = fail[f]
            fail[n] = trie.get(f << _SYM | c, 0) if s else 0
            if longest[n] < 0:
                longest[n] = longest[fail[n]]
        self.depth, self.longest, self._fail, self._trie, self._next = depth, longest, fail, trie, dict(trie)
        self._parent, self._open = [False] * len(depth), {}
        for k in trie:
            self._parent[k >> _SYM] = True
        self.shorter = [-1] * size
        for t in spelled:
            self.shorter[t] = longest[fail[at[t]]]

    def step(self, state: int, symbol: int) -> int:
        """The automaton's next state; transitions over failure links are kept once found."""
        k = state << _SYM | symbol
        n = self._next.get(k)
        if n is None:
            s = state
            while s and s << _SYM | symbol not in self._trie:
                s = self._fail[s]
            n = self._next[k] = self._trie.get(s << _SYM | symbol, 0)
            if len(self._next) > len(self._trie) + 400_000:
                self._next.clear()
                self._next.update(self._trie)
        return n

    def open_suffixes(self, state: int) -> tuple[int, ...]:
        """Lengths of the suffixes of what was read that a longer token starts with, longest first, down to 0."""
        out = self._open.get(state)
        if out is None:
            lengths, s = [], state
            while s:
                if self._parent[s]:
                    lengths.append(self.depth[s])
                s = self._fail[s]
            out = self._open[state] = (*lengths, 0)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay apart: at no point of undoing them does the pair at the border come first."""
        key = a << _ID | b
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            fits = self._fits[key] = self._stay_apart(a, b)
        return fits

    def _stay_apart(self, a: int, b: int) -> bool:
        rank, limit = self.rank, len(self.merge) + 1
        while True:
            r = self.merge.get(a << _ID | b)
            if r is not None and r < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] == NO_RANK:
                return True
            else:  # of equal ranks the left pair is merged first
                limit, b = rank[b] + 1, self.left[b]

    def symbols(self, word: bytes) -> list[int]:
        out = [self.inner_code[b] for b in word]
        if self.end and word:
            out[-1] = self.final_code[word[-1]]
        return out

    def last_tokens(self, symbols: list[int]) -> list[int]:
        """The last token of the encoding of each non-empty prefix."""
        last: list[int] = []
        state, longest, length, shorter = 0, self.longest, self.length, self.shorter
        moves, fits = self._next.get, self._fits.get
        for i, c in enumerate(symbols, 1):
            n = moves(state << _SYM | c)
            state = self.step(state, c) if n is None else n
            t = longest[state]
            while j := i - length[t]:
                before = last[j - 1]
                known = fits(before << _ID | t)
                if self.compatible(before, t) if known is None else known:
                    break
                t = shorter[t]
            last.append(t)
        return last

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Exact ids of one word: follow the last tokens back from its end."""
        last = self.last_tokens(self.symbols(word))
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= self.length[last[i - 1]]
        return tuple(reversed(out))


class PrefixMachine:
    """A deterministic transducer over a word's symbols that emits how many tokens each symbol adds.

    A state holds all that later prefixes depend on: the automaton's state, and the last token and the number of tokens
    (relative to the whole prefix) of the prefix before each suffix that a longer token may still start with.  States are
    made when first reached, and equal ones are shared.  A move holds the target and, in its
    low bits, the tokens gained (``gain``).
    """

    KEPT_STATES = 200_000
    START = (0, ((-1, 0),))

    def __init__(self, bpe: BpeTables):
        self.bpe = bpe
        self.reset()

    def reset(self) -> None:
        self.states, self.number = [self.START], {self.START: 0}
        self.moves: dict[int, int] = {}

    def _compile(self, state: int, symbol: int) -> int:
        bpe, (automaton, ends) = self.bpe, self.states[state]
        old = dict(zip(bpe.open_suffixes(automaton), ends, strict=True))
        automaton = bpe.step(automaton, symbol)
        t = bpe.longest[automaton]
        while True:
            before, count = old[bpe.length[t] - 1]
            if before < 0 or bpe.compatible(before, t):
                break
            t = bpe.shorter[t]
        gained = count + 1
        new = []
        for n in bpe.open_suffixes(automaton):
            if n:
                before, count = old[n - 1]
                new.append((before, count - gained))
            else:
                new.append((t, 0))
        target = (automaton, tuple(new))
        n = self.number.get(target)
        if n is None:
            n = self.number[target] = len(self.states)
            self.states.append(target)
        move = self.moves[state << _SYM | symbol] = n << _GAIN | gained + (1 << _GAIN - 1)
        return move

    @staticmethod
    def gain(moves: list[int]) -> int:
        """Tokens that a path's moves add."""
        return sum(move & (1 << _GAIN) - 1 for move in moves) - (len(moves) << _GAIN - 1)

    @staticmethod
    def target(move: int) -> int:
        return move >> _GAIN

    def path(self, symbols: list[int], start: tuple = START) -> list[int]:
        """The move for each symbol, from a state given by what it holds."""
        if len(self.states) > self.KEPT_STATES:
            self.reset()
        state, get, out = self.number.setdefault(start, len(self.states)), self.moves.get, []
        if state == len(self.states):
            self.states.append(start)
        for c in symbols:
            move = get(state << _SYM | c)
            if move is None:
                move = self._compile(state, c)
            state = move >> _GAIN
            out.append(move)
        return out


def tables(path: str) -> BpeTables:
    """The compiled vocabulary; keep it while it is needed, as making it takes a second."""
    out = BpeTables(path)
    gc.freeze()  # no need to visit it again and again
    return out


#: Unicode white space, as the tokenizers' own patterns have it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Letters and numbers below U+0250, and the texts that have no other characters.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN = re.compile("[\\x00-\\u024f]*")
