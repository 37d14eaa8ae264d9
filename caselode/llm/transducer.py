r"""A tokenizer file compiled into a deterministic transducer that counts tokens.

Symbols are normalised code points. The machine reads them one by one; each
transition carries the number of tokens that the text read so far gains by it
(it may be negative, where a merge joins what was apart). Two levels make a
state: the place in the split pattern (between pieces, in a run of letters, in
a run of other signs, in the middle of one of the pattern's fixed strings), and
inside a piece the place in the merges.

The merges are a finite machine too. The last token of a prefix is the one
token that ends the prefix and may follow the last token before it; two tokens
may follow each other if no merge crosses their border before both are whole,
which the right edge of the one's merge tree and the left edge of the other's
decide. So a state is, for every start of a token that may still become longer,
that start's place in the trie of the vocabulary, the last token before it and
the count there. Equal states are one state, whatever text led to them.

The compiler reads the file's normaliser, pattern and merges and refuses a file
with parts that it does not know (Unsupported). States and transitions are
numbered when first met and kept in an integer hash table of at most
TRANSITIONS entries; beyond that the table starts anew, which costs time only.
A symbol of white space leads from every state to the start state (RESET):
there the texts of a batch are cut into lanes, which all step at once.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from .bpe import _byte_of_char

#: Code points that the table knows; texts with others go to the tokenizers library.
ALPHABET, SYMBOL_BITS = 1 << 17, 17
#: Entries of the transition table.
TRANSITIONS = 1_000_000
#: Answers kept on which token may follow which.
FOLLOWS = 500_000
#: Symbols of a lane at least, of a group of texts that step together, and lanes that are worth an array step.
LANE, GROUP, FEW = 96, 1 << 21, 24
RESET = 0
#: Bits of a block of code points whose classes are asked for together.
_BLOCK = 13
SPACE, LETTER, DIGIT, OTHER = range(4)
LITERAL = 4
_NEVER = 1 << 60
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Characters of which none composes with another, so that normalisation takes them one by one.
_COMPOSING = re.compile("[^\t-\r\x20-\x7e\xa0-ɏͰ-ͷΑ-ΡΣ-ώА-я‐-‧₠-€ぁ-ゖ一-龥가-힣]")


class Unsupported(ValueError):
    """The tokenizer file holds a part that the compiler does not know."""


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise Unsupported(f"cannot compile this tokenizer file: {what}")


class Merges:
    """The merges as a machine over bytes: states are numbers, 0 is the empty prefix."""

    def __init__(self, model: dict):
        _require(model.get("type", "BPE") == "BPE", "the model is not BPE")
        _require(not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges")), "the model's options")
        self.suffix = model.get("end_of_word_suffix") or ""
        byte, vocab = _byte_of_char(), model["vocab"]
        number = {t: i for i, t in enumerate(vocab)}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank, self.parts, formed = {}, {}, {}
        for i, (a, b) in enumerate(pairs):
            _require(a + b in number and (not self.suffix or not a.endswith(self.suffix)), "a merge outside the vocabulary")
            _require(a + b not in formed, "a token formed by two merges")
            formed[a + b] = i
            self.rank[number[a], number[b]] = i
            self.parts[number[a + b]] = (number[a], number[b])
        _require(all(formed.get(x, -1) < i for i, pair in enumerate(pairs) for x in pair), "a merge before its parts")
        self.formed = {number[t]: i for t, i in formed.items()}
        self.edges: dict[tuple[int, int], tuple[list, list]] = {}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # the trie of the vocabulary's bytes: open tokens, and those that end a piece
        self.child: dict[int, int] = {}
        self.open, self.end, self.inner = [-1], [-1], [False]
        for t, i in number.items():
            ends = bool(self.suffix) and t.endswith(self.suffix)
            plain = t.removesuffix(self.suffix) if ends else t
            if not plain or not set(plain) <= byte.keys() or (len(plain) > 1 and i not in self.parts):
                continue  # an added token, or one that no merge forms
            _require(len(plain) < 1024, "a token of 1024 bytes or more")
            node = 0
            for ch in plain:
                key = node << 8 | byte[ch]
                if key not in self.child:
                    self.child[key] = len(self.open)
                    self.inner[node] = True
                    self.open.append(-1)
                    self.end.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            if ends or not self.suffix:
                self.end[node] = i
            if not ends:
                self.open[node] = i
        have = {node for key, node in self.child.items() if key >> 8 == 0 and self.open[node] >= 0 and self.end[node] >= 0}
        _require(len(have) == 256, "a byte without a token")
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(self._start(0, -1, 0),)]
        self.of: dict[tuple, int] = {self.states[0]: 0}

    @staticmethod
    def _start(node: int, last: int, at: int) -> int:
        """A start of a token in one number: its place in the trie, the token before it, the count there."""
        return node << 36 | (last + 1) << 12 | (at + 2048)

    def _starts(self, state: int):
        for x in self.states[state]:
            yield x >> 36, (x >> 12 & 0xFFFFFF) - 1, (x & 0xFFF) - 2048

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """Tokens on that side of t's merge tree from the byte up, each with the rank that takes it in."""
        key = (t, side)
        if key not in self.edges:
            way = [t]
            while way[-1] in self.parts:
                way.append(self.parts[way[-1]][side])
            way.reverse()
            self.edges[key] = [(x, self.formed[way[k + 1]] if k + 1 < len(way) else _NEVER) for k, x in enumerate(way)]
        return self.edges[key]

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b before both are whole."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, up), (y, up_y) = left[i], right[j]
            if up == up_y == _NEVER:
                return True
            m = self.rank.get((x, y), _NEVER)
            if m < up and m <= up_y:  # of two equal merges the left one comes first
                return False
            if up <= up_y:
                i += 1
            else:
                j += 1

    def _whole(self, t: int) -> bool:
        """Whether t's own bytes give t."""
        if t not in self.whole:
            p = self.parts.get(t)
            self.whole[t] = p is None or (self._whole(p[0]) and self._whole(p[1]) and self._apart(*p))
        return self.whole[t]

    def _may_follow(self, a: int, b: int) -> bool:
        key = a << 24 | b
        if key not in self.follows:
            if len(self.follows) > FOLLOWS:
                self.follows.clear()
            self.follows[key] = (a, b) not in self.rank and self._apart(a, b)
        return self.follows[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens gained) on a byte."""
        on, gain, token, child = [], None, -1, self.child
        for x in self.states[state]:  # see _start
            node = child.get(x >> 36 << 8 | byte)
            if node is None:
                continue
            if gain is None and (t := self.open[node]) >= 0:
                last = (x >> 12 & 0xFFFFFF) - 1
                if self._whole(t) and (last < 0 or self._may_follow(last, t)):
                    gain, token = (x & 0xFFF) - 2047, t
            if self.inner[node] or self.end[node] >= 0:
                on.append(node << 36 | (x & 0xFFFFFFFFF))
        key = (*[x - gain for x in on], self._start(0, token, 0))
        if key not in self.of:
            self.of[key] = len(self.states)
            self.states.append(key)
        return self.of[key], gain

    def finish(self, state: int) -> int:
        """Tokens gained by the piece's end."""
        for node, last, at in self._starts(state):
            t = self.end[node]
            if node and t >= 0 and self._whole(t) and (last < 0 or self._may_follow(last, t)):
                return at + 1
        raise AssertionError("a piece without a last token")


class Transducer:
    """The compiled file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.literals = self._pattern(spec)
        self.begun = {x[:k] for x in self.literals for k in range(1, len(x))}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        _require(not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])), "an added token that is matched after normalisation")
        self.merges = Merges(spec["model"])
        self.classes, self.learnt = np.zeros(ALPHABET, np.uint8), set()
        self._learn(0)
        self.plain = self._plain()
        self._clear()

    # -- compiling -------------------------------------------------------------

    @staticmethod
    def _pattern(spec: dict) -> list[str]:
        """Checks the normaliser and the pre-tokenizer; the pattern's fixed strings."""
        norm = spec.get("normalizer") or {}
        steps = norm.get("normalizers", [norm])
        known = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        _require(known and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " ", "its normaliser")
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [])
        _require([s.get("type") for s in steps] == ["Split", "ByteLevel"], "its pre-tokenizer")
        split, level = steps
        _require(split.get("behavior") == "Removed" and split.get("invert") is True, "how it splits")
        _require(not level.get("add_prefix_space") and not level.get("use_regex"), "its byte level")
        parts = (split.get("pattern") or {}).get("Regex", "").split("|")
        _require(parts[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"], "its pattern")
        fixed = parts[:-3]
        _require(all(re.fullmatch("'[a-z]+", x) for x in fixed) and not any(a != b and b.startswith(a) for a in fixed for b in fixed), "its pattern's fixed strings")
        _require(not spec.get("truncation") and not spec.get("padding"), "truncation or padding")
        return fixed

    def _learn(self, block: int) -> None:
        """The classes of a block of code points, asked from the library: how it splits between letters and between signs."""
        some = [c for c in range(block << _BLOCK, block + 1 << _BLOCK) if not 0xD800 <= c < 0xE000]
        self.learnt.add(block)
        if not some:
            return
        pieces = {}
        for kind, probe in ((LETTER, "x"), (OTHER, "!")):
            n = np.zeros(len(some), int)
            for _, (start, _) in self.library.pre_tokenizer.pre_tokenize_str("".join(f" {probe}{chr(c)}{probe}" for c in some)):
                n[start // 4] += 1
            pieces[kind] = n
        self.classes[some] = np.select([pieces[LETTER] == 1, pieces[OTHER] == 1, pieces[LETTER] == 3], [LETTER, OTHER, DIGIT], SPACE)

    def _plain(self) -> re.Pattern:
        """Finds a character that Python's lower case and the file's normaliser treat unlike, or that may compose."""
        odd = []
        for c in range(ALPHABET):
            ch = chr(c)
            if 0xD800 <= c < 0xE000 or _COMPOSING.match(ch):
                continue
            got = self.library.normalizer.normalize_str(ch)
            blank = c < 1 << _BLOCK and self.classes[c] == SPACE
            if got != (" " if blank else ch.replace("Σ", "σ").lower()):
                odd.append(ch)
        return re.compile(f"{_COMPOSING.pattern}|[{re.escape(''.join(odd))}]" if odd else _COMPOSING.pattern)

    def _clear(self) -> None:
        self.merges.clear()
        self.states: list[tuple] = [(RESET, 0)]
        self.of: dict[tuple, int] = {(RESET, 0): RESET}
        self.bits, self.size = 16, 0
        self.keys, self.values = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64)

    def _grow(self) -> None:
        used = self.keys >= 0
        keys, values = self.keys[used].tolist(), self.values[used].tolist()
        self.bits += 2
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self._insert(keys, values)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: list[int], values: list[int]) -> None:
        mask, shift, mult = (1 << self.bits) - 1, 64 - self.bits, int(_MULT)
        taken = self.keys.item
        for key, value in zip(keys, values, strict=True):
            at = (key * mult & 0xFFFFFFFFFFFFFFFF) >> shift
            while taken(at) >= 0:
                at = (at + 1) & mask
            self.keys[at], self.values[at] = key, value

    # -- the machine, a symbol at a time ----------------------------------------

    def _feed(self, kind: int, inside: int, symbol: int) -> tuple[tuple, int]:
        gained = 0
        for byte in chr(symbol).encode():
            inside, d = self.merges.step(inside, byte)
            gained += d
        return (kind, inside), gained

    def _begin(self, symbol: int) -> tuple[tuple, int]:
        """A piece by its class begins."""
        kind = int(self.classes[symbol])
        state, gained = self._feed(kind, 0, symbol)
        if kind == DIGIT:
            return (RESET, 0), gained + self.merges.finish(state[1])
        return state, gained

    def _next(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        kind, inside = state
        if kind == LITERAL:
            said = inside + chr(symbol)
            if said in self.begun:
                return (LITERAL, said), 0
            if said in self.literals:
                run, gained = (OTHER, 0), 0
                for ch in said:
                    run, d = self._feed(OTHER, run[1], ord(ch))
                    gained += d
                return (RESET, 0), gained + self.merges.finish(run[1])
            run, gained = self._begin(ord(inside[0]))
            for ch in said[1:]:
                run, d = self._next(run, ord(ch))
                gained += d
            return run, gained
        now, closed = int(self.classes[symbol]), 0
        if kind in (LETTER, OTHER):
            if now == kind:
                return self._feed(kind, inside, symbol)
            closed = self.merges.finish(inside)
        if now == SPACE:
            return (RESET, 0), closed
        if chr(symbol) in self.begun:
            return (LITERAL, chr(symbol)), closed
        after, gained = self._begin(symbol)
        return after, closed + gained

    def _compile(self, keys: list[int]) -> None:
        """Number new transitions and put them into the table."""
        values = []
        for key in keys:
            after, gained = self._next(self.states[key >> SYMBOL_BITS], key & (ALPHABET - 1))
            if after not in self.of:
                self.of[after] = len(self.states)
                self.states.append(after)
            values.append(self.of[after] << 32 | (gained + (1 << 31)))
        self._insert(keys, values)
        self.size += len(keys)
        if 3 * self.size > len(self.keys):
            self._grow()

    # -- all lanes at once ------------------------------------------------------

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        got = self.keys[at]
        miss = np.flatnonzero(got != keys)
        mask = len(self.keys) - 1
        while len(miss):
            empty = got[miss] < 0
            if empty.any():
                # the new ones are looked up anew, all others have their place or go on
                new = miss[empty]
                bits = self.bits
                self._compile(np.unique(keys[new]).tolist())
                if self.bits != bits:
                    return self._look_up(keys)
                got[new] = self.keys[at[new]]
                miss = miss[got[miss] != keys[miss]]
                continue
            at[miss] = (at[miss] + 1) & mask
            got[miss] = self.keys[at[miss]]
            miss = miss[got[miss] != keys[miss]]
        return self.values[at]

    def _one(self, key: int) -> int:
        at = (key * int(_MULT) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (got := self.keys.item(at)) != key:
            if got < 0:
                self._compile([key])
                return self._one(key)
            at = (at + 1) & (len(self.keys) - 1)
        return self.values.item(at)

    def run(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens gained from RESET by each stretch of symbols that ends in white space."""
        if self.size > TRANSITIONS:
            self._clear()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, size = starts[order], size[order]
        state, gained = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        longest, live = int(size[0]) if len(size) else 0, len(at)
        for k in range(longest):
            while live and size[live - 1] <= k:
                live -= 1
            if live < FEW:
                break
            value = self._look_up(state[:live] << SYMBOL_BITS | symbols[at[:live] + k])
            state[:live] = value >> 32
            gained[:live] += (value & 0xFFFFFFFF) - (1 << 31)
        else:
            k = longest
        for lane in range(live if k < longest else 0):
            now, total = int(state[lane]), 0
            for symbol in symbols[at[lane] + k : at[lane] + size[lane]].tolist():
                value = self._one(now << SYMBOL_BITS | symbol)
                now = value >> 32
                total += (value & 0xFFFFFFFF) - (1 << 31)
            gained[lane] += total
        out = np.empty(len(at), np.int64)
        out[order] = gained
        return out

    # -- texts ------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The text as the file normalises it; white space need not be squeezed."""
        if not text.isascii() and self.plain.search(text):
            return self.library.normalizer.normalize_str(text)
        return text.replace("Σ", "σ").lower() if not text.isascii() else text.lower()

    def outside(self, text: str) -> bool:
        """Whether a text holds an added token's string or a symbol beyond the table: the library counts it."""
        return any(t in text for t in self.added) or (not text.isascii() and max(text) >= chr(ALPHABET))

    def symbols(self, texts: list[str]) -> np.ndarray:
        """Symbols of normalised texts, a blank after each."""
        whole = " ".join([*texts, ""])
        if whole.isascii():
            return np.frombuffer(whole.encode("ascii"), np.uint8).astype(np.int64)
        out = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
        for block in np.flatnonzero(np.bincount(out >> _BLOCK)).tolist():
            if block not in self.learnt:
                self._learn(block)
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each normalised text."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        symbols = self.symbols(texts)
        blanks = np.flatnonzero(self.classes[symbols] == SPACE) + 1  # the last symbol is one
        cuts = blanks[np.searchsorted(blanks, np.arange(LANE, len(symbols) + 1, LANE))]
        bounds = np.unique(np.concatenate([[0], cuts, ends]))
        gained = self.run(symbols, bounds[:-1], bounds[1:])
        return np.bincount(np.searchsorted(ends, bounds[:-1], side="right"), weights=gained, minlength=len(texts)).astype(np.int64)

    def tokens(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text as the library gives them; null as empty."""
        out, held, size = [0] * len(texts), [], 0

        def flush():
            for (i, _), n in zip(held, self.counts([t for _, t in held]).tolist(), strict=True):
                out[i] = n

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.outside(text):
                out[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            held.append((i, self.normal(text)))
            size += len(text)
            if size >= GROUP:
                flush()
                held, size = [], 0
        if held:
            flush()
        return out

    # -- maps of chunks -----------------------------------------------------------

    def map_of(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, inner count, tail) of a chunk of a normalised text.

        From a state with s read since RESET the chunk leads to the state with
        `tail` read since RESET, and s + head between blanks, then the inner
        count, are gained on the way. A chunk without a blank has inner count
        None: it leads to the state with s + head.
        """
        blanks = np.flatnonzero(self.classes[self.symbols([chunk])[:-1]] == SPACE).tolist()
        if not blanks:
            return chunk, None, ""
        inner = chunk[blanks[0] + 1 : blanks[-1] + 1]
        return chunk[: blanks[0]], int(self.counts([inner])[0]) if inner else 0, chunk[blanks[-1] + 1 :]

    def compose(self, a: tuple, b: tuple) -> tuple[str, int | None, str]:
        """The map of a chunk and the one after it."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + int(self.counts([a[2] + b[0]])[0]) + b[1], b[2]

    def total(self, m: tuple) -> int:
        """Tokens of a whole text with this map."""
        return int(self.counts([m[0], m[2]]).sum()) + (m[1] or 0)


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)
