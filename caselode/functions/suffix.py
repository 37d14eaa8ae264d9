"""Longest common substrings: where they are, by a suffix automaton in linear time; their length alone, by window hashes."""

from __future__ import annotations

import numpy as np

#: Two primes and a base for each: windows are named by 62 bits, and equal names are checked.
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 69069069)


class Automaton:
    """All substrings of a text; built in time linear in it."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [0]  # of each state; end: where it occurs first
        last = 0
        for at, c in enumerate(text, 1):
            new = self._state(at, at, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][c]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(self.length[p] + 1, self.end[q], dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, length: int, end: int, ways: dict[str, int]) -> int:
        self.next.append(ways)
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest_common(self, other: str) -> tuple[int, int, int]:
        """Start in the text, start in the other, and length of a longest common substring; of several the first in the text, then in the other."""
        state = n = 0
        best = (0, 0, 0)
        for at, c in enumerate(other, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            start = self.end[state] - n
            if n > best[2] or (n == best[2] and n and start < best[0]):
                best = (start, at - n, n)
        return best


def longest_common(a: str, b: str) -> str:
    """A longest common substring: of several the first in a."""
    start, _, n = Automaton(a).longest_common(b)
    return a[start : start + n]


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out, k = np.ones(max(n, 1), np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, p)) % np.uint64(p)
        k += m
    return out


class Hashed:
    """A text whose windows of any length are hashed all at once."""

    def __init__(self, text: str):
        self.text, self.points = text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.parts = []
        for p, base in zip(_PRIMES, _BASES, strict=True):
            terms = (self.points.astype(np.uint64) + np.uint64(1)) * _powers(base, len(text), p)[: len(text)] % np.uint64(p)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % np.uint64(p)])
            self.parts.append((np.uint64(p), sums, _powers(pow(base, -1, p), len(text), p)))

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window, by where it starts."""
        n = len(self.text) - length + 1
        a, b = ((sums[length:] + p - sums[:n]) % p * back[:n] % p for p, sums, back in self.parts)
        return a << np.uint64(31) | b

    def shares(self, other: Hashed, length: int) -> bool:
        """Whether the texts have a substring of this length in common; equal hashes are held against the texts."""
        ours, theirs = self.windows(length), other.windows(length)
        for h in np.intersect1d(ours, theirs):
            named = {other.text[j : j + length] for j in np.flatnonzero(theirs == h)}
            if any(self.text[i : i + length] in named for i in np.flatnonzero(ours == h)):
                return True
        return False

    def common_length(self, other: Hashed) -> int:
        """The length of a longest common substring.

        Texts share every shorter length too, so it is searched upwards from
        what they share at their ends, in steps that double, then by halves.
        """
        most = min(len(self.text), len(other.text))
        if not most:
            return 0
        ends = [(x != y).nonzero()[0] for x, y in ((self.points[:most], other.points[:most]), (self.points[-most:][::-1], other.points[-most:][::-1]))]
        least, step = max(int(e[0]) if len(e) else most for e in ends), 1
        while least + step <= most and self.shares(other, least + step):
            least, step = least + step, 2 * step
        beyond = min(least + step, most + 1)
        while beyond - least > 1:
            half = (least + beyond) // 2
            least, beyond = (half, beyond) if self.shares(other, half) else (least, half)
        return least
