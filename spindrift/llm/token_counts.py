"""Token counts by a compiled finite-state tokenizer (operator 10).

``CountTransducer`` (a ``PrefixMachine`` of ``bpe.py``) is a deterministic transducer over a word's symbols whose transitions carry the number of tokens that
the encoding gains (or loses, when a merge joins tokens) by one more symbol.  Its states hold what the future can depend
on: the suffix automaton's state, and the last tokens and relative counts of the prefixes that a token ending later can
reach back to.  States are made when first reached and shared when equal.

A text of more than ``chunk`` characters is cut into chunks.  A chunk's state map takes the transducer's state before the chunk to the state after
it and the tokens between.  At white space, a number, or the change from a letter to a sign, a word ends whatever came before,
so a map needs the start state only up to its first such place: it keeps the characters before that place, which any start
state can run through, and a constant (tokens, end state) from there on.  Maps compose associatively and are combined in pairs.
An end state holds where the word splitter is and, inside a word, the transducer's state; nothing is tokenised twice.

A null text is empty and counts 0.  Special strings inside texts count as one token, as is the library's default.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATIN, LATIN_LETTERS, LATIN_NUMBERS, SPACE, BpeTables, PrefixMachine, tables
from .common import by_bytes, kept

#: Fixed pattern of the vocabulary's word splitter.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
LATIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{SPACE}{LATIN_LETTERS}{LATIN_NUMBERS}]+")
LETTERS, OTHERS = regex.compile(r"\p{L}*"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]*")
#: Places where a word ends for every state before them.
_BREAK = rf"[{SPACE}]|\p{{N}}|(?<=\p{{L}})(?=[^{SPACE}\p{{L}}\p{{N}}'])"
FIRST_BREAK, LAST_BREAK = regex.compile(_BREAK), regex.compile("(?r)" + _BREAK)
SPACES = frozenset(regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
#: Starts of contractions that more characters decide.
HELD = ("'", "'r", "'v", "'l")
CHUNK = 1 << 15
KEPT_WORDS = 200_000


class CountTransducer(PrefixMachine):
    def count(self, word: bytes) -> int:
        """Tokens of one word: the sum along its path."""
        return self.gain(self.path(self.bpe.symbols(word)))

    def advance(self, state: tuple, symbols: list[int]) -> tuple[int, tuple]:
        """Tokens gained by more symbols of a word, and the state after them."""
        moves = self.path(symbols, state)
        return self.gain(moves), self.states[self.target(moves[-1])] if moves else state


class Counts(dict):
    """word -> tokens, by the transducer when first asked for."""

    def __init__(self, bpe: BpeTables):
        self.machine = CountTransducer(bpe)

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word.encode())
        if len(word) < 64 and len(self) < KEPT_WORDS:
            self[word] = n
        return n


def counter(path: str) -> Counts:
    """The worker's words; a new task starts afresh if no more can be kept."""
    words = kept(f"counts {path}", lambda: Counts(tables(path)))
    if len(words) >= KEPT_WORDS:
        words.clear()
    return words


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is no special case here
    return text.lower()


def _split(text: str) -> list[str]:
    return (LATIN_WORDS if LATIN.fullmatch(text) else WORDS).findall(text)


def _pieces(text: str, words: Counts) -> list[str]:
    """The text cut at special strings; those have odd places."""
    special = words.machine.bpe.special
    if "<|" not in text or not any(s in text for s in special):
        return [text]
    return regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)


def count_text(text: str, words: Counts) -> int:
    pieces = _pieces(text, words)
    return len(pieces) // 2 + sum(sum(map(words.__getitem__, _split(_normal(p)))) for p in pieces[::2])


class State(NamedTuple):
    """Between two characters: ``kind`` is "" outside words, "letters" or "others" inside one, or "held" where ``held``, an
    apostrophe and perhaps a letter, may yet become a contraction.  Inside a word, ``inner`` is the transducer's state before the
    word's ``last`` byte, whose symbol depends on whether the word goes on."""

    kind: str
    held: str = ""
    inner: tuple = ()
    last: int = 0


OUTSIDE = State("")


def _open(kind: str, word: str, words: Counts) -> tuple[int, State]:
    data, machine = word.encode(), words.machine
    n, inner = machine.advance(machine.START, [machine.bpe.inner_code[b] for b in data[:-1]])
    return n, State(kind, inner=inner, last=data[-1])


def _start(text: str, words: Counts) -> tuple[int, State]:
    """Tokens of a text from outside words, without those that the state after it still withholds."""
    found = _split(text)
    if not found or text[-1] in SPACES:
        return sum(map(words.__getitem__, found)), OUTSIDE
    for k in (1, 2):
        if "".join(found[-k:]) in HELD and found[-k] == "'":
            return sum(map(words.__getitem__, found[:-k])), State("held", "".join(found[-k:]))
    before, word = sum(map(words.__getitem__, found[:-1])), found[-1]
    for kind, pattern in (("letters", LETTERS), ("others", OTHERS)):
        if pattern.fullmatch(word):
            n, state = _open(kind, word, words)
            return before + n, state
    return before + words[word], OUTSIDE


def run(state: State, text: str, words: Counts) -> tuple[int, State]:
    """The transducer from a state over a normalised text: tokens and the state after it."""
    if not text or state.kind in ("", "held"):
        return _start(state.held + text, words) if text else (0, state)
    more = (LETTERS if state.kind == "letters" else OTHERS).match(text).group()
    n = 0
    if more:
        data, machine = more.encode(), words.machine
        n, inner = machine.advance(state.inner, [machine.bpe.inner_code[b] for b in (state.last, *data[:-1])])
        state = State(state.kind, inner=inner, last=data[-1])
    if len(more) == len(text):
        return n, state
    rest, after = _start(text[len(more) :], words)
    return n + finish(state, words) + rest, after


def finish(state: State, words: Counts) -> int:
    """Tokens that a state withholds, if its word ends here."""
    if state.kind in ("", "held"):
        return sum(map(words.__getitem__, _split(state.held)))
    return words.machine.advance(state.inner, [words.machine.bpe.final_code[state.last]])[0]


class StateMap(NamedTuple):
    """start -> run(start, head), and from there, if ``end`` is set, the word ends and ``count`` tokens lead to ``end``."""

    head: str
    count: int = 0
    end: State | None = None

    def __call__(self, start: State, words: Counts) -> tuple[int, State]:
        n, state = run(start, self.head, words)
        return (n, state) if self.end is None else (n + finish(state, words) + self.count, self.end)


SPECIAL = StateMap("", 1, OUTSIDE)


def state_map(chunk: str, words: Counts) -> StateMap:
    return scan([SPECIAL if i % 2 else _plain_map(_normal(p), words) for i, p in enumerate(_pieces(chunk, words))], words)


def _plain_map(text: str, words: Counts) -> StateMap:
    first = FIRST_BREAK.search(text)
    if first is None:
        return StateMap(text)
    a, b = first.start(), LAST_BREAK.search(text).start()
    n, end = _start(text[b:], words)
    return StateMap(text[:a], sum(map(words.__getitem__, _split(text[a:b]))) + n, end)


def compose(a: StateMap, b: StateMap, words: Counts) -> StateMap:
    """First a, then b."""
    if a.end is None:
        return StateMap(a.head + b.head, b.count, b.end)
    n, end = b(a.end, words)
    return StateMap(a.head, a.count + n, end)


def scan(maps: list[StateMap], words: Counts) -> StateMap:
    """The composition of all maps, neighbours first, in log2(n) rounds."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], words) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def cut(text: str, size: int, special: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Chunks of about size characters; each but the first starts with an ASCII character, which nothing before composes with, and
    no special string lies across a border."""
    out, at, reach = [], 0, max(map(len, special), default=1) - 1
    while at < len(text):
        end = at + size
        while end < len(text):
            near = max(at, end - reach)
            inside = [k + len(s) for s in special if 0 <= (k := text.find(s, near, end + reach)) - near < end - near < k + len(s) - near]
            if inside:
                end = inside[0]
            elif text[end] > "\x7f":
                end += 1
            else:
                break
        out.append(text[at:end])
        at = end
    return out or [""]


def count_tokens(text: str, words: Counts, chunk: int = CHUNK) -> int:
    if len(text) <= chunk:
        return count_text(text, words)
    n, end = scan([state_map(c, words) for c in cut(text, chunk, list(words.machine.bpe.special))], words)(OUTSIDE, words)
    return n + finish(end, words)


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str, limit: int, chunk: int = CHUNK) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every text."""
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("_text"))

    def run(batches):
        words = counter(vocabulary)
        for batch in batches:
            for part, _ in by_bytes(batch, 2, 1 << 20, 512):
                counts = [count_tokens(t or "", words, chunk) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["_key", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))
