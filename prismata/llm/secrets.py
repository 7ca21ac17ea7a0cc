"""Secrets found by patterns, and by a linear-chain conditional random field.

Three patterns give the *base* spans. A conditional random field then tags every
token of every text as the beginning (B) of a secret, inside (I) or outside (O)
one, from the token's shape, its neighbours and features of the whole text, and
Viterbi decoding gives further spans.

The field is trained in numpy, by gradient ascent on the likelihood of tags in
windows of a bounded sample of documents. The tags are those of the secret
values in base spans. Were that all, the field could only learn the patterns
again; so windows are shown in variants too, with key words, separators, quotes
and value formats that the patterns don't have, and with things that look alike
and are no secrets (addresses, dates, versions, card numbers, prose after a key
word), tagged O.

Most tokens cannot be anything but outside: where O leads B and I by more than
transitions on both sides can make up, every best path has O there. The texts
fall into short islands between such tokens, and Viterbi on these gives the
best path of the whole. Only the tokens that a bound on their lead leaves open
are scored in full.
"""

from __future__ import annotations

import bisect
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Memo, blocks, distinct, give_back, map_arrow
from .storage import discard, materialize

#: The patterns of the base spans, in the order of their kinds.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A text without any of these has no base span.
_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

#: Bounds of the training sample: documents with a base span and without one, and windows, each drawn by hash.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 4000
#: Tokens on both sides of a window's centre, and how far back a training window may look for the beginning of its first word.
REACH, LOOK = 12, 4096
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
#: Tokens that training looks at in one product.
CUT = 8192
WORD_BUCKETS = 32
SHAPES = 28
FEATURES = SHAPES + WORD_BUCKETS
#: Features that are also looked at two and three tokens before.
FAR = [19, 20, 21, 22, 23]
FILE_FEATURES = 6
#: Empty places between texts, so that neighbours are those of the same text.
GAP = 3
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then by kind in their order."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    # runs of at least that length; shorter ones are no matches that could stand in their way
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]{24,}", text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_UPPER, _LOWER_, _DIGIT, _HEXLETTER = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_LOWER_[97:123] = 1
_DIGIT[48:58] = 1
_HEXLETTER[97:103] = 1
_KEYWORDS = "(?i)passw|passphrase|passwd|secret|token|apikey|api_key"
_NEAR_KEYWORDS = "(?i)key|pwd|auth|cred|private|bearer|sig"


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, the index of each token's value, the values, and each text's first token."""
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, empty, [], np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    mark = np.ones(len(data), bool)
    mark[1:] = kind[1:] != kind[:-1]
    mark[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], len(data))
    index, values = distinct(data, np.append(starts, len(data)))
    real = kind[starts] != 0
    return starts[real], ends[real], index[real], values, np.searchsorted(starts[real], offsets)


def features(values: list[bytes]) -> np.ndarray:
    """Shape and word features of each token value, as 0 and 1."""
    n = len(values)
    out = np.zeros((n, FEATURES), np.uint8)
    if not n:
        return out
    length = np.fromiter(map(len, values), np.int64, n)
    joined = np.frombuffer(b"".join(values), np.uint8)
    begin = np.cumsum(length) - length
    count = lambda table: np.add.reduceat(table[joined], begin)
    upper, lower, digit, hexes = count(_UPPER), count(_LOWER_), count(_DIGIT), count(_HEXLETTER)
    word = _KIND[joined[begin]] == 1
    for k, (a, b) in enumerate(((1, 3), (4, 7), (8, 11), (12, 15), (16, 19), (20, 23), (24, 39), (40, 1 << 40))):
        out[:, k] = (length >= a) & (length <= b)
    out[:, 8] = digit > 0
    out[:, 9] = upper > 0
    out[:, 10] = lower > 0
    mixed = word & (digit > 0) & (upper + lower > 0)
    out[:, 11] = mixed
    out[:, 12] = word & (digit + hexes == length) & (hexes > 0) & (digit > 0)
    out[:, 13] = word & (digit + upper == length) & (upper > 0)
    out[:, 14] = (digit == length) & word
    out[:, 15] = ~word
    out[:, 16] = mixed & (length >= 12)
    out[:, 17] = mixed & (length >= 16) & (upper + digit == length)
    out[:, 18] = mixed & (length >= 16) & (lower + digit == length)
    # changes between letters and digits, and between upper and lower case after the first letter
    sort = _UPPER[joined] + 2 * _LOWER_[joined] + 4 * _DIGIT[joined]
    turn = np.insert((sort[1:] != sort[:-1]) & (sort[1:] > 0) & (sort[:-1] > 0), 0, False).astype(np.int64)
    turn[begin] = 0
    turns = np.add.reduceat(turn, begin)
    out[:, 24] = word & (turns >= 3)
    out[:, 25] = word & (turns >= 6)
    out[:, 26] = word & (upper >= 2) & (lower >= 2) & (turns >= 4)
    out[:, 27] = word & (4 * digit >= length) & (length >= 8)
    held = pa.array(values, pa.binary())

    def having(some: np.ndarray, pattern: str) -> np.ndarray:
        """Those of the values ``some`` that have the pattern."""
        return some[pc.match_substring_regex(held.take(pa.array(some)), pattern).to_numpy(zero_copy_only=False)] if len(some) else some

    signs = np.flatnonzero(~word)
    out[having(signs, "[=:]"), 19] = 1
    out[having(signs, "[\"']"), 20] = 1
    lettered = np.flatnonzero(word & (lower + upper >= 3) & (length <= 40))
    out[having(lettered, _KEYWORDS), 21] = 1
    out[having(lettered, _NEAR_KEYWORDS), 22] = 1
    out[:, 22] &= ~out[:, 21] & 1
    out[:, 23] = word & (digit == 0) & (upper > 0) & (lower == 0) & (length >= 3)
    plain = np.flatnonzero(word & (digit == 0) & (length <= 12))
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(values[i].lower()) % WORD_BUCKETS for i in plain.tolist()), np.int64, len(plain))
    out[plain, SHAPES + bucket] = 1
    return out


def file_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each whole text: its size, its share of digits and of signs, assignments."""
    n = np.diff(offsets)
    total = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[offsets])
    size = np.maximum(n, 1)
    digits, signs, equals = total(_IS_DIGIT) / size, total(_IS_SIGN) / size, total(_IS_EQUAL)
    return np.stack([n < 500, n > 5000, digits > 0.02, digits > 0.1, signs > 0.01, equals > 0], 1).astype(np.float32)


_IS_DIGIT, _IS_SIGN, _IS_EQUAL = (np.zeros(256, np.uint8) for _ in range(3))
_IS_DIGIT[48:58] = 1
_IS_SIGN[[34, 39, 58, 61, 95]] = 1
_IS_EQUAL[61] = 1


def glued(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 where no white space stands between a token and the one before, 2 where none follows, 3 for both."""
    touch = starts[1:] == ends[:-1]
    return np.append(False, touch) + 2 * np.append(touch, False)


class Field:
    """Weights of the random field: of the token, its neighbours, how it touches them, and the text; and transitions."""

    #: Rows of ``weights``: own, previous and next token, far features two and three before, touch left and right, text, bias.
    SIZES = (FEATURES, FEATURES, FEATURES, len(FAR), len(FAR), 2, FILE_FEATURES, 1)

    def __init__(self):
        self.weights = np.zeros((sum(self.SIZES), 3))
        self.move = np.zeros((3, 3))
        self.trained = False

    def parts(self) -> list[np.ndarray]:
        return np.split(self.weights, np.cumsum(self.SIZES)[:-1])

    def fit(self, windows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``windows`` hold features of the tokens, how these touch, file features and tags; gradient ascent with Adam."""
        if not any((tags == B).any() for _, _, _, tags in windows):
            return
        n, longest = len(windows), max(len(x[3]) for x in windows)
        tags = np.zeros((n, longest), np.int64)
        real = np.zeros((n, longest), bool)
        at = np.cumsum([0, *self.SIZES])
        total = sum(len(x[3]) for x in windows)
        bits = np.zeros((total, at[6]), np.uint8)  # of the tokens that there are: what is 0 or 1 in a byte each
        text = np.ones((total, at[8] - at[6]), np.float32)  # and what their text says of them
        below = 0
        for i, (shape, touch, file, tag) in enumerate(windows):
            k = len(tag)
            tags[i, :k], real[i, :k] = tag, True
            row = bits[below : below + k]
            text[below : below + k, : at[7] - at[6]] = file
            below += k
            row[:k, at[0] : at[1]] = shape
            row[1:k, at[1] : at[2]] = shape[:-1]
            row[: k - 1, at[2] : at[3]] = shape[1:]
            row[2:k, at[3] : at[4]] = shape[:-2, FAR]
            row[3:k, at[4] : at[5]] = shape[:-3, FAR]
            row[:k, at[5]], row[:k, at[5] + 1] = touch & 1, touch >> 1
        gold = np.eye(3)[tags] * real[:, :, None]
        both = real[:, 1:] & real[:, :-1]
        gold_move = np.einsum("ntu,ntv->uv", gold[:, :-1] * both[:, :, None], gold[:, 1:])
        held = [self.weights, self.move]
        first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
        for step in range(1, STEPS + 1):
            score = np.zeros(gold.shape)
            weights = self.weights.astype(np.float32)
            score[real] = text @ weights[at[6] :]
            score[real] += np.concatenate([bits[k : k + CUT].astype(np.float32) @ weights[: at[6]] for k in range(0, total, CUT)])
            marginal, pairs = self._expect(score, real)
            off = ((gold - marginal) * real[:, :, None])[real].astype(np.float32)
            slope = sum(bits[k : k + CUT].astype(np.float32).T @ off[k : k + CUT] for k in range(0, total, CUT))
            for p, g, a, b in zip(held, [np.concatenate([slope, text.T @ off]), gold_move - pairs], first, second, strict=True):
                g = g / n - PENALTY * p
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        self.trained = True

    def _expect(self, score: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of tags and expected transitions, by the forward-backward recurrences."""
        n, length, _ = score.shape
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for t in range(1, length):
            grown = lse(alpha[:, t - 1, :, None] + self.move, 1) + score[:, t]
            alpha[:, t] = np.where(real[:, t, None], grown, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            grown = lse(self.move + (score[:, t + 1] + beta[:, t + 1])[:, None], 2)
            beta[:, t] = np.where(real[:, t + 1, None], grown, 0)
        total = lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        pairs = np.zeros((3, 3))
        for t in range(1, length):
            p = np.exp(alpha[:, t - 1, :, None] + self.move + (score[:, t] + beta[:, t])[:, None] - total[:, None, None])
            pairs += (p * real[:, t, None, None]).sum(0)
        return marginal, pairs

    def viterbi(self, score: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The best tags of all islands, side by side.

        ``begin`` are the islands' first rows of ``score``; ``left`` and ``right`` tell
        whether an O stands beside each.
        """
        n = np.diff(np.append(begin, len(score)))
        order = np.argsort(-n, kind="stable")  # those that go on are always the first ones
        begin, n, left, right = begin[order], n[order], left[order], right[order]
        best = score[begin] + np.where(left[:, None], self.move[O], 0)
        back = np.zeros((len(score), 3), np.int8)
        going = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")  # islands longer than t
        for t in range(1, int(n[0])):
            k = going[t]
            total = best[:k, :, None] + self.move
            back[begin[:k] + t] = total.argmax(1)
            best[:k] = total.max(1) + score[begin[:k] + t]
        tags = np.zeros(len(score), np.int64)
        tag = (best + np.where(right[:, None], self.move[:, O], 0)).argmax(1)
        for t in range(int(n[0]) - 1, -1, -1):
            k = going[t]
            at = begin[:k] + t
            tags[at] = tag[:k]
            tag[:k] = back[at, tag[:k]]
        return tags

    def tags(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best tags of all texts, decoded island by island."""
        tags = np.zeros(len(score), np.int64)
        if self.trained and len(score):
            self._paths(tags, np.arange(len(score)), score, first)
        return tags

    def _gains(self) -> tuple[float, float]:
        """How far a token may trail O and still be tagged otherwise, and how far if no other token helps.

        Other tags than O at one place change the transitions on both sides, and
        gain at most the first number there. A run of other tags gains at most
        the second for each of its tokens, unless its ends gain by themselves:
        then the second is no bound, and the first is given twice.
        """
        m, other = self.move, self.move[1:]
        one = max((m[:, y] - m[:, O]).max() + (m[y] - m[O]).max() for y in (B, I))
        run = float((other[:, 1:] - m[O, O]).max())
        ends = max(0.0, float((m[O, 1:] - m[O, O]).max())) + max(0.0, float((other[:, O] - m[O, O]).max()))
        return float(one), run if ends <= run else max(float(one), run)

    @staticmethod
    def _islands(at: np.ndarray, seed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the tokens ``at``, which stand in runs within a text that have a seed; and the places in these where runs begin."""
        none = np.zeros(0, np.int64)
        if not len(at):
            return np.zeros(0, bool), none
        of = np.searchsorted(first, at, "right")
        begin = np.append(0, np.flatnonzero((np.diff(at) > 1) | (np.diff(of) > 0)) + 1)
        n = np.diff(np.append(begin, len(at)))
        good = np.maximum.reduceat(seed, begin)
        size = n[good]
        return np.repeat(good, n), (np.cumsum(size) - size if len(size) else none)

    def _paths(self, tags: np.ndarray, at: np.ndarray, score: np.ndarray, first: np.ndarray) -> None:
        """Put the best tags of the tokens ``at``, with their scores, into ``tags``; all others are outside."""
        one, run = self._gains()
        lead = score[:, 1:].max(1) - score[:, O]
        open_ = lead >= -one
        at, score, lead = at[open_], score[open_], lead[open_]
        kept, begin = self._islands(at, lead >= -run, first)
        at, score = at[kept], score[kept]
        if not len(at):
            return
        text = np.searchsorted(first, at[begin], "right") - 1
        end = np.append(begin[1:], len(at)) - 1
        tags[at] = self.viterbi(score, begin, at[begin] > first[text], at[end] + 1 < first[text + 1])

    def value_scores(self, values: list[bytes]) -> np.ndarray:
        """For each token value, three scores as the token itself, as the one before, after, two and three before."""
        shape = features(values).astype(np.float32)
        own, prev, after, far2, far3 = (w.astype(np.float32) for w in self.parts()[:5])
        return np.concatenate([shape @ own, shape @ prev, shape @ after, shape[:, FAR] @ far2, shape[:, FAR] @ far3], 1)

    def decode(self, data: np.ndarray, offsets: np.ndarray, found, scores: Memo) -> np.ndarray:
        """The best tags of all tokens; ``scores`` remembers ``value_scores``."""
        starts, ends, index, values, first = found
        tags = np.zeros(len(starts), np.int64)
        if not self.trained or not len(starts):
            return tags
        table = np.frombuffer(b"".join(scores(values)), np.float32).reshape(-1, 5, 3)
        table = np.concatenate([table, np.zeros((1, 5, 3), np.float32)])
        lead = np.ascontiguousarray((table[:, :, 1:].max(2) - table[:, :, O]).T)
        _, _, _, _, _, side, text, bias = self.parts()
        touching = np.stack([np.zeros(3), side[0], side[1], side[0] + side[1]])
        whole = file_features(data, offsets) @ text + bias
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = np.arange(len(index)) + GAP * (1 + of)
        spread = np.full(len(index) + GAP * (len(first) + 1), len(values))
        spread[place] = index
        near = ((0, 0), (-1, 1), (1, 2), (-2, 3), (-3, 4))  # where the neighbour stands, and its part of the table
        bound = lambda x: x[..., 1:].max(-1) - x[..., O]
        touch = glued_in(starts, ends, first)
        most = (bound(touching)[touch] + bound(whole)[of]).astype(np.float32)
        for step, part in near:
            most += lead[part][spread[place + step]]
        one, run = self._gains()
        at = np.flatnonzero(most >= -one - 1e-2)
        at = at[self._islands(at, most[at] >= -run - 1e-2, first)[0]]
        if len(at):
            score = touching[touch[at]] + whole[of[at]]
            for step, part in near:
                score += table[spread[place[at] + step], part]
            self._paths(tags, at, score, first)
        return tags


def glued_in(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``glued`` within each text: tokens of two texts never touch."""
    touch = glued(starts, ends)
    full = np.flatnonzero(np.diff(first))
    touch[first[full]] &= 2
    touch[first[full + 1] - 1] &= 1
    return touch


def tagged_spans(tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the secrets in one text: a B with the I that follow, or a run of I."""
    spans: list[tuple[int, int]] = []
    for t in np.flatnonzero(tags).tolist():
        if tags[t] == I and spans and t and tags[t - 1] != O:
            spans[-1] = (spans[-1][0], int(ends[t]))
        else:
            spans.append((int(starts[t]), int(ends[t])))
    return spans


def outside(span: tuple[int, int], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of ``span`` that no other span covers."""
    parts = [span]
    for x, y in others:
        parts = [p for a, b in parts for p in ((a, min(b, x)), (max(a, y), b)) if p[0] < p[1]]
    return parts


#: Training variants: words before a value, what stands between, and what else has digits and signs.
_NAMES = ("password", "passwd", "secret", "token", "api_key", "pwd", "user_pwd", "auth_token", "private_key", "credential", "db_secret",
          "Authorization", "AUTH_KEY", "signing_key")
_BETWEEN = ("=", " = ", ": ", ":", " := ", '="', ' = "', ': "', '":"', "='", " '", " is ", " ")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = ("0123456789abcdef", _LETTERS + "0123456789", _LETTERS.upper() + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789",
              _LETTERS + _LETTERS.upper() + "0123456789+/", _LETTERS + _LETTERS.upper() + "0123456789-_", _LETTERS + _LETTERS.upper() + "0123456789!#$%&*?")


def _made_secret(r: random.Random) -> tuple[str, int, int]:
    """A key word, what stands between, a value in quotes or not; and where the value is."""
    bare = r.random() < 0.25  # nothing but the value
    before = "" if bare else r.choice(_NAMES) + r.choice(_BETWEEN)
    value = ""
    while not (any(map(str.isdigit, value)) and any(map(str.isalpha, value))):
        value = "".join(r.choices(r.choice(_ALPHABETS[:4] if bare else _ALPHABETS), k=r.randint(24, 64) if bare else r.randint(8, 44)))
    if r.random() < 0.2:
        value = r.choice(("pk_", "live-", "v1.", "key-", "T0")) + value
    close = next((q for q in "\"'" if before.endswith(q)), "")
    return before + value + close, len(before), len(before) + len(value)


def _made_plain(r: random.Random, words: list[str]) -> str:
    """Something with digits, signs or a key word that is no secret; ``words`` are some of the text."""
    d = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: r.choice(words)
    return r.choice((
        lambda: f"{word()}.{d(2)}@{word()}{d(1)}.example.com", lambda: f"https://{word()}.org/{word()}/{d(4)}?id={d(5)}", lambda: f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}Z",
        lambda: d(16), lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{word()}_{word()}_{d(2)} = {word()}", lambda: f"{word()} = {d(3)}", lambda: f"{word().title()}{word().title()}{d(1)}",
        lambda: f"{r.choice(_NAMES)} {word()} {word()}", lambda: f"the {r.choice(_NAMES)} is {word()}", lambda: f"ISBN {d(3)}-{d(10)}", lambda: f"{word()}-{d(2)}.jpg", lambda: f"{word().upper()}{d(3)}",
    ))()


def _word_start(text: str, at: int) -> int:
    """Where the run of non-blank characters that ends before ``at`` begins, at most ``LOOK`` characters back."""
    low = max(0, at - LOOK)
    blank = _A_BLANK.search(text[low:at][::-1])
    return at - blank.start() if blank else low


def _window(text: str, spans: list[tuple[int, int]], centre: int, file: np.ndarray) -> tuple | None:
    """Features, touch, file features and tags of the tokens about the character ``centre``; ``spans`` are in order."""
    low = _word_start(text, centre - 1499) if centre > 1500 else 0
    cut = text[low : centre + 1500]
    data = np.frombuffer(cut.encode(), np.uint8)
    starts, ends, index, values, _ = tokens(data, np.array([0, len(data)]))
    if not len(starts):
        return None
    tags = np.zeros(len(starts), np.int64)
    for k in range(max(0, bisect.bisect_left(spans, (low, 0)) - 1), bisect.bisect_left(spans, (low + len(cut), 0))):
        a, b = spans[k]
        if b <= low:
            continue
        a, b = len(cut[: max(0, a - low)].encode()), len(cut[: b - low].encode())
        inside = np.flatnonzero((starts < b) & (ends > a))
        tags[inside] = I
        if len(inside):
            tags[inside[0]] = B
    at = int(np.searchsorted(starts, len(cut[: centre - low].encode())))
    own = slice(max(0, at - REACH), min(len(starts), at + REACH))
    held = [values[i] for i in index[own]]
    return features(held), glued(starts, ends)[own], file, tags[own]


def _values(text: str) -> list[tuple[int, int]]:
    """Where the values of the base spans are, in order and without key word, sign and quote."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST["assign"]]
    own = lambda a, b: (k := bisect.bisect_left(found, (b, 0))) == 0 or found[k - 1][1] <= a
    return sorted(found + [(a, b) for a, b, k in base_spans(text) if k != "assign" and own(a, b)])


def _windows(text: str, most: int = SAMPLE_WINDOWS) -> list[tuple[int, tuple]]:
    """Training windows of one text, each with a key: its base spans, each also in two variants, or lookalikes and a secret of its own.

    Only the ``most`` of the smallest keys are made; no other could be among the
    ``most`` smallest of all texts.
    """
    digest = xxhash.xxh3_64_intdigest(text.encode())
    r = random.Random(digest)
    spans = base_spans(text)
    words = [x.group() for x in re.finditer(r"[^\W\d_]{2,12}", text)] or ["word"]
    plans: list[tuple] = [(a, a, None) for a, _, _ in spans]
    for a, b in [(a, b) for a, b, _ in spans] + [(k, k) for k in (r.randrange(len(text) + 1) for _ in range(2))]:
        if a == b:
            a = b = _word_start(text, a)
        plans += [(a, b, _made_secret(r)), (a, b, (_made_plain(r, words), 0, 0))]
    odd = [m.start() for m in re.finditer(r"\S+", text) if _ANY_DIGIT.search(text, m.start(), m.end())]
    plans += [(c, c, None) for c in r.sample(odd, min(len(odd), 2)) + [r.randrange(len(text) + 1)]]
    keys = sorted((xxhash.xxh3_64_intdigest(digest.to_bytes(8, "little"), k) >> 1, k) for k in range(len(plans)))[:most]

    data = np.frombuffer(text.encode(), np.uint8)
    file = file_features(data, np.array([0, len(data)]))[0]
    values = _values(text)
    out = []
    for key, k in keys:
        a, b, made = plans[k]
        if made is None:
            w = _window(text, values, a, file)
        else:
            put, x, y = made
            before, after = text[max(0, a - 1000) : a], text[b : b + 1000]
            own = [*_values(before), *([(len(before) + x, len(before) + y)] if y else [])]
            w = _window(f"{before}{put} {after}", own, len(before), file)
        if w is not None:
            out.append((key, w))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, id_col: str = "doc_id",
          text_col: str = "text") -> Field:
    """A field fitted to at most ``sample_windows`` windows of ``sample_docs`` documents with a base span and as many without.

    Those with the smallest hashes are taken; a window has ``2 * REACH`` tokens
    and only their features travel, so the driver's share has a fixed bound.
    Without a base span in any document the field stays untrained and adds no
    spans. A text costs time in proportion to its length, also one without any
    blank; null and empty texts count as texts without spans, rows without an id
    are left out, and of rows equal in id and text each gives its windows. Only
    ``id_col`` and ``text_col`` are read, whatever other columns there are.
    """
    import pickle

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), text.rlike(_HINT).alias("hit")).where("doc_id is not null")
    rows = materialize(rows, "secret-hits")  # the texts are searched once
    picked = [rows.where(cond).select("doc_id", "hash").distinct().orderBy("hash", "doc_id").limit(sample_docs) for cond in ("hit", "not hit")]
    chosen = picked[0].unionByName(picked[1])  # 2 * sample_docs rows at most
    held = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(chosen), ["doc_id", "hash"], "left_semi")

    def work(batches):
        for rows in batches:
            for t in rows.column(rows.schema.get_field_index("text")).to_pylist():
                found, hit = _windows(t, sample_windows), _HITS.search(t) is not None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.int64()), pa.array([hit] * len(found), pa.bool_()), pa.array([pickle.dumps(w) for _, w in found], pa.binary())], ["k", "hit", "w"]
                )

    windows = map_arrow(held.select("text"), work, "k long, hit boolean, w binary").orderBy("k", "w").limit(sample_windows).toArrow()
    discard(rows)
    field = Field()
    if pc.any(windows["hit"]).as_py():
        held = [pickle.loads(w.as_buffer()) for w in windows["w"]]
        del windows
        field.fit(held)
    give_back()
    return field


_HITS = re.compile(_HINT, re.ASCII)
_ANY_DIGIT, _A_BLANK = re.compile(r"\d"), re.compile(r"\s")


def scan(docs: DataFrame, field: Field, text_col: str = "text", mark: str | None = None) -> DataFrame:
    """``docs`` with ``secrets`` added: ``array<(kind, start, end)>`` in code points.

    All base spans, and of the field's spans (kind ``crf``) those parts that lie
    outside base spans; by start, then kind. With ``mark``, each secret of the
    text is replaced by it in the same pass.

    Null and empty texts have none, and stay as they are. Texts of any length
    are scanned whole, and repeated rows each for itself. A column of ``docs``
    named ``secrets`` is replaced; all others are kept. An empty table gives an
    empty result.
    """
    docs = docs.drop("secrets")
    names, kinds = docs.columns, dict(docs.dtypes)
    rank = {k: i for i, k in enumerate((*KINDS, "crf"))}

    def work(batches):
        scores = Memo(lambda values: [x.tobytes() for x in field.value_scores(values)], 32_000_000)
        for rows, data, offsets in blocks(batches, text_col):
            column = rows.column(rows.schema.get_field_index(text_col))
            hint = pc.fill_null(pc.match_substring_regex(column, _HINT), False).to_numpy(zero_copy_only=False)
            spans: list[list] = [[] for _ in range(rows.num_rows)]
            for i in np.flatnonzero(hint):
                spans[i] = [(a, b, k) for a, b, k in base_spans(column[int(i)].as_py())]
            if field.trained:
                found = starts, ends, _, _, first = tokens(data, offsets)
                tags = field.decode(data, offsets, found, scores)
                some = np.unique(np.searchsorted(first, np.flatnonzero(tags), "right") - 1)
                for i in some.tolist():
                    own = slice(first[i], first[i + 1])
                    base = [(x, y) for x, y, _ in spans[i]]
                    at, chars = int(offsets[i]), 0  # the byte and the code point reached
                    for a, b in tagged_spans(tags[own], starts[own], ends[own]):
                        begin = chars + len(data[at:a].tobytes().decode())
                        at, chars = b, begin + len(data[a:b].tobytes().decode())
                        spans[i] += [(x, y, "crf") for x, y in outside((begin, chars), base)]
            spans = [sorted(s, key=lambda s: (s[0], rank[s[2]], s[1])) for s in spans]
            listed = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            columns = list(rows.columns)
            if mark is not None:
                texts = [t if t is None or not s else redacted(t, [x[:2] for x in s], mark) for t, s in zip(column.to_pylist(), spans, strict=True)]
                columns[rows.schema.get_field_index(text_col)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, kind)], [*names, "secrets"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return map_arrow(docs, work, f"{schema}, secrets array<struct<kind:string,start:long,end:long>>")


def listed(spans):
    """``kind:start:end`` of each span, joined by commas, as a column."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with the spans, ordered by start, replaced; spans that overlap are replaced as one."""
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``scanned`` with each secret of the text replaced by ``mark``; other texts stay as they are, nulls too."""
    def work(batches):
        for rows in batches:
            at = rows.schema.get_field_index(text_col)
            spans = rows.column(rows.schema.get_field_index("secrets")).to_pylist()
            text = [t if t is None or not s else redacted(t, [(x["start"], x["end"]) for x in s], mark)
                    for t, s in zip(rows.column(at).to_pylist(), spans, strict=True)]
            yield rows.set_column(at, text_col, pa.array(text, pa.string()))

    return map_arrow(scanned, work, scanned.schema)
