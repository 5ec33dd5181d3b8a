"""A linear-chain conditional random field over words, trained and decoded in numpy.

A word counts by its signature, a tuple of features; a position's score for a tag is the sum of what its own
signature, those of the two words beside it, and the file's features give. So scores are look-ups in small tables.

Decoding is Viterbi's, over batches of segments. A word that is outside by more than every transition could win
back is outside on any best path (see `certain`), so it ends a segment; only what lies between is decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

NONE = ("none",)


class Crf:
    """tags[0] is outside. describe(word) gives a word's features."""

    #: Words and signatures that are remembered at most.
    KEPT = 100_000

    def __init__(self, tags: Sequence[str], describe: Callable[[bytes], tuple]):
        self.tags, self.describe = list(tags), describe
        self.feature: dict[str, int] = {}
        self.words: dict[bytes, int] = {}
        self.signatures: dict[tuple, int] = {}
        self.tables: np.ndarray | None = None

    # ---------------------------------------------------------------- training

    def fit(self, texts: list[list[bytes]], tags: list[list[int]], files: list[tuple] | None = None, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Crf:
        """Maximum likelihood with an L2 penalty, by AdaGrad over all sequences at once."""
        files = files or [NONE] * len(texts)
        known: dict[tuple, int] = {NONE: 0}
        code = lambda f: known.setdefault(f, len(known))
        longest = max(map(len, texts))
        n, k = len(texts), len(self.tags)
        ids = np.zeros((n, longest + 2), np.int64)
        gold, inside, file = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool), np.zeros(n, np.int64)
        for i, (words, t) in enumerate(zip(texts, tags, strict=True)):
            ids[i, 1 : len(words) + 1] = [code(self.describe(w)) for w in words]
            gold[i, : len(words)], inside[i, : len(words)], file[i] = t, True, code(files[i])
        self.feature = {f: i for i, f in enumerate(sorted({f for s in known for f in s}))}
        has = np.zeros((len(known), len(self.feature)))
        for s, i in known.items():
            has[i, [self.feature[f] for f in s]] = 1
        self.weights = np.zeros((4, len(self.feature), k))
        self.step = np.zeros((k + 1, k + 1))  # the last row and column: before the first word, after the last one
        places = [ids[:, 1:-1], ids[:, :-2], ids[:, 2:], np.repeat(file[:, None], longest, 1)]
        squares = [np.full(self.weights.shape, 1e-8), np.full(self.step.shape, 1e-8)]
        for _ in range(rounds):
            tables = has @ self.weights
            score = sum(tables[j][p] for j, p in enumerate(places))
            at_tag, pairs = self._expected(score, inside)
            at_tag[np.nonzero(inside)[0], np.nonzero(inside)[1], gold[inside]] -= 1
            grad = np.zeros_like(self.weights)
            for j, p in enumerate(places):
                by = np.stack([np.bincount(p[inside], at_tag[inside][:, t], len(known)) for t in range(k)], 1)
                grad[j] = has.T @ by
            pairs -= self._counted(gold, inside)
            for x, g, s in ((self.weights, grad, squares[0]), (self.step, pairs, squares[1])):
                g = g / n + decay * x
                s += g * g
                x -= rate * g / np.sqrt(s)
        return self

    def _counted(self, gold: np.ndarray, inside: np.ndarray) -> np.ndarray:
        k = len(self.tags)
        out = np.zeros((k + 1, k + 1))
        last = inside.sum(1) - 1
        np.add.at(out, (np.full(len(gold), k), gold[:, 0]), 1)
        np.add.at(out, (gold[np.arange(len(gold)), last], np.full(len(gold), k)), 1)
        both = inside[:, 1:]
        np.add.at(out, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        return out

    def _expected(self, score: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward: the probabilities of tags by place, and the expected number of each step."""
        n, length, k = score.shape
        step, begin, end = self.step[:k, :k], self.step[k, :k], self.step[:k, k]
        fore, back = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = begin + score[:, 0]
        for t in range(1, length):
            fore[:, t] = np.where(inside[:, t, None], _logsum(fore[:, t - 1, :, None] + step, 1) + score[:, t], fore[:, t - 1])
        total = _logsum(fore[:, -1] + end, 1)
        back[:, -1] = end
        for t in range(length - 2, -1, -1):
            on = inside[:, t + 1, None]
            back[:, t] = np.where(on, _logsum(step + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2), end)
        at_tag = np.exp(fore + back - total[:, None, None]) * inside[:, :, None]
        pairs = np.zeros((k + 1, k + 1))
        for t in range(1, length):
            on = inside[:, t]
            p = fore[on, t - 1, :, None] + step + (score[on, t] + back[on, t])[:, None, :] - total[on, None, None]
            pairs[:k, :k] += np.exp(p).sum(0)
        pairs[k, :k] = at_tag[:, 0].sum(0)
        pairs[:k, k] = at_tag[np.arange(n), inside.sum(1) - 1].sum(0)
        return at_tag, pairs

    # ---------------------------------------------------------------- decoding

    def _score(self, signature: tuple) -> np.ndarray:
        found = [self.feature[f] for f in signature if f in self.feature]
        return self.weights[:, found].sum(1)

    def code(self, word: bytes) -> int:
        """The number of a word's signature."""
        signature = self.describe(word)
        found = self._number(signature)
        if len(self.words) < self.KEPT and len(word) < 64:
            self.words[word] = found
        return found

    def _number(self, signature: tuple) -> int:
        found = self.signatures.get(signature)
        if found is None:
            found = self.signatures[signature] = len(self.signatures)
            if self.tables is None or found >= len(self.tables):
                more = np.zeros((max(1024, 2 * found), 4, len(self.tags)))
                if self.tables is not None:
                    more[: len(self.tables)] = self.tables
                self.tables = more
            self.tables[found] = self._score(signature)
        return found

    def certain(self) -> np.ndarray:
        """What a change from each tag to outside can cost in steps at most: a larger lead makes outside certain."""
        k = len(self.tags)
        return (self.step[:, :k] - self.step[:, :1]).max(0) + (self.step[:k] - self.step[:1]).max(1)

    def spans(self, texts: list[list[bytes]], files: list[tuple] | None = None) -> list[list[tuple[int, int, int]]]:
        """Of each text, the spans (tag that begins it, first word, word after the last). Tags come as outside, then begin and inside of each kind."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if len(self.signatures) > self.KEPT:
            self.words, self.signatures, self.tables = {}, {}, None
        lead = self.certain()
        none, get = self._number(NONE), self.words.get
        rest = []  # (text, first word, scores)
        for i, words in enumerate(texts):
            if not words:
                continue
            ids = [none, *[code if (code := get(w)) is not None else self.code(w) for w in words], none]
            file = self._number(files[i]) if files else none
            ids = np.array(ids)
            tables = self.tables
            score = tables[ids[1:-1], 0] + tables[ids[:-2], 1] + tables[ids[2:], 2] + tables[file, 3]
            unsure = np.flatnonzero(((score[:, :1] - score) <= lead)[:, 1:].any(1))
            if len(unsure):
                cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
                rest += [(i, int(s[0]), int(s[-1]) + 1 == len(words), score[s]) for s in np.split(unsure, cuts)]
        rest.sort(key=lambda x: len(x[3]))
        at = 0
        while at < len(rest):
            width = len(rest[at][3])
            upto = at
            while upto < len(rest) and len(rest[upto][3]) <= 2 * width and upto - at < 20_000:
                upto += 1
            for (i, first, _, _), path in zip(rest[at:upto], self._viterbi(rest[at:upto]), strict=True):
                out[i] += [(tag, first + a, first + b) for tag, a, b in _chunks(path)]
            at = upto
        return [sorted(x, key=lambda s: s[1]) for x in out]

    def _viterbi(self, part: list[tuple]) -> list[np.ndarray]:
        k, longest = len(self.tags), len(part[-1][3])
        size = np.array([len(p[3]) for p in part])
        score = np.zeros((len(part), longest, k))
        for j, p in enumerate(part):
            score[j, : size[j]] = p[3]
        step = self.step[:k, :k]
        # beside a segment lies a word that is certainly outside, or the text's edge
        begin = np.where(np.array([p[1] == 0 for p in part])[:, None], self.step[k, :k], self.step[0, :k])
        end = np.where(np.array([p[2] for p in part])[:, None], self.step[:k, k], self.step[:k, 0])
        best, came = begin + score[:, 0], np.zeros((len(part), longest, k), np.int8)
        final = np.zeros(len(part), np.int64)
        for t in range(longest):
            if t:
                all_ = best[:, :, None] + step
                came[:, t] = all_.argmax(1)
                best = all_.max(1) + score[:, t]
            over = size == t + 1
            final[over] = (best[over] + end[over]).argmax(1)
        paths = []
        for j, n in enumerate(size.tolist()):
            path = np.zeros(n, np.int64)
            path[-1] = final[j]
            for t in range(n - 1, 0, -1):
                path[t - 1] = came[j, t, path[t]]
            paths.append(path)
        return paths


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def _chunks(path: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans from tags 0 (outside), 2j + 1 (begin) and 2j + 2 (inside) of kind j; an inside without its begin begins."""
    out: list[tuple[int, int, int]] = []
    for t, tag in enumerate(path.tolist()):
        if not tag:
            continue
        kind = (tag - 1) // 2
        if tag % 2 == 0 and out and out[-1][0] == kind and out[-1][2] == t:
            out[-1] = (kind, out[-1][1], t + 1)
        else:
            out.append((kind, t, t + 1))
    return out


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words that split() gives begin and end, in bytes."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def code_points(text: bytes) -> np.ndarray | None:
    """For each byte place, the number of code points before it; None if all are ASCII."""
    if text.isascii():
        return None
    return np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
