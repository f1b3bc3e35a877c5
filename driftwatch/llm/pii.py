"""Personal data by fixed patterns and by a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The patterns give the base spans of a text. The tagger is trained on windows around such spans, on windows with digits or
at-signs that hold none, and on plain ones; in a part of the windows the span is rewritten the way people write addresses and
numbers by hand ("name (at) host", "12.34.56.78" as "12[.]34[.]56[.]78", a phone number without its plus sign), so the
tagger learns forms that the patterns miss. Training takes a sample bounded by `max_windows` of each sort, chosen by hash among
distinct windows of documents that are not held out.

Every whole text is tagged in windows that overlap by OVERLAP characters, whatever they hold; they are longer than those of
the training, so that few characters are read twice. A window decodes the best path of tags;
its spans that touch an inner edge are left to the neighbour that holds them whole. The spans of all windows of a document are then
reconciled at once: those over a base span go, and of the rest the set without overlaps that has the largest sum of log-odds against
"no span" stays. A span must be well-formed for its kind. Base spans always stay.

Defined cases: a null text is empty. An empty text has no spans. With fewer than `min_windows` distinct windows that hold
spans there is no tagger, and the base spans are the result. Spans of the tagger are shorter than OVERLAP. A null id is
tagged as any other and never held out; repeated rows are returned each. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.llm.tables import saved, text_of

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind
LESSON = 96
WINDOW, OVERLAP = 384, 48
STRIDE = WINDOW - OVERLAP
MAX_WINDOWS = 1200
MIN_WINDOWS = 30
EMBEDDING = 12
HIDDEN = 16
STEPS = 500
BATCH = 32
RATE = 0.02
REWRITTEN = 0.35
MARGIN = 2.0
SEED = 12
DECODED = 512
ROWS_OUT = 2048

_ANCHOR = re.compile("[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs of digits are taken whole, so that a text is read once whatever it holds.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: list[int]) -> bool:
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _digits(text: str) -> list[int]:
    return [int(d) for d in _DIGITS.findall(text)]


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at-signs, so that long words without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, EMAIL, domain.end()))
            free = domain.end()
        else:
            free = at + 1  # no address holds two at-signs
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap for each kind, in order of start and kind."""
    if not _ANCHOR.search(text):
        return []
    found = _emails(text)
    found += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_is_byte, m.groups()))]
    found += [(m.start(), CARD, m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        found += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


_HAND_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_HAND_IP = re.compile(r"([0-9]{1,3})(?:\.|\[\.\]|\(\.\)| \. )([0-9]{1,3})(?:\.|\[\.\]|\(\.\)| \. )([0-9]{1,3})"
                      r"(?:\.|\[\.\]|\(\.\)| \. )([0-9]{1,3})")
_HAND_CARD = re.compile(r"[0-9]+(?:[ ./_-]{0,3}[0-9]+)*")
_HAND_PHONE = re.compile(r"(?:00|\(?\+)? ?\(?[0-9]+(?:[ ()./-]{0,2}[0-9]+)+")


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the tagger is well-formed for its kind."""
    if kind == EMAIL:
        return _HAND_EMAIL.fullmatch(text) is not None
    if kind == IP:
        match = _HAND_IP.fullmatch(text)
        return match is not None and all(map(_is_byte, match.groups()))
    if kind == CARD:
        return _HAND_CARD.fullmatch(text) is not None and _is_card(text)
    digits = len(_digits(text))
    return _HAND_PHONE.fullmatch(text) is not None and 10 <= digits <= 15 and not text.isdigit()


def rewritten(kind: int, text: str, random: np.random.Generator) -> str:
    """A span as it might be written by hand."""
    pick = lambda *forms: forms[int(random.integers(len(forms)))]
    if kind == EMAIL:
        return text.replace("@", pick(" @ ", "(at)", "[at]", " (at) ", " at ", "@ "))
    if kind == IP:
        return text.replace(".", pick("[.]", "(.)", " . "))
    if kind == CARD:
        digits = "".join(_DIGITS.findall(text))
        return pick(".", "/", " - ", "  ", "_").join(digits[k:k + 4] for k in range(0, len(digits), 4))
    digits = "".join(_DIGITS.findall(text))
    area, head, tail = digits[-10:-7], digits[-7:-4], digits[-4:]
    if len(area) < 3:
        return "00" + digits
    return pick(f"({area}) {head}-{tail}", f"{area}-{head}-{tail}", f"{area}/{head} {tail}", f"{area}.{head}.{tail}",
                f"001 {area} {head} {tail}", f"({area}) {head} {tail}")


# Characters as the tagger sees them: digits are one, letters do without case, other alphabets are one.
PAD, DIGIT, LETTER, MARK, BLANK, FOREIGN, OTHER, CODES = 0, 1, 2, 28, 61, 62, 63, 64
_CODE = np.full(256, FOREIGN, np.int64)
_CODE[:128] = OTHER
_CODE[48:58] = DIGIT
_CODE[65:91] = _CODE[97:123] = LETTER + np.arange(26)
_CODE[32] = MARK
_CODE[[c for c in range(33, 127) if not chr(c).isalnum()]] = MARK + 1 + np.arange(32)
_CODE[[9, 10, 13]] = BLANK


def codes(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255)]


def tags(length: int, spans: list[Span]) -> np.ndarray:
    """Tags of the characters of a window; spans may begin before it or end behind it."""
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[max(start, 0):max(min(end, length), 0)] = 2 + 2 * kind
        if 0 <= start < length:
            out[start] = 1 + 2 * kind
    return out


def _allowed() -> np.ndarray:
    """Whether a tag may follow another: the inside of a kind only its begin or inside."""
    out = np.ones((TAGS, TAGS), bool)
    for kind in range(len(KINDS)):
        out[:, 2 + 2 * kind] = False
        out[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return out


ALLOWED = _allowed()
NEVER = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Parameters by name. The first axis of the recurrent ones is the direction."""

    def __init__(self, seed: int = SEED, dtype=np.float32):
        random = np.random.default_rng(seed)
        of = lambda scale, *shape: random.normal(0, scale, shape).astype(dtype)
        self.p = {
            "embedding": of(0.5, CODES, EMBEDDING), "inward": of(EMBEDDING ** -0.5, 2, EMBEDDING, 4 * HIDDEN),
            "bias": np.zeros((2, 1, 4 * HIDDEN), dtype), "round": of(HIDDEN ** -0.5, 2, HIDDEN, 4 * HIDDEN),
            "outward": of(0.3, 2 * HIDDEN, TAGS), "level": np.zeros(TAGS, dtype),
            "follow": np.zeros((TAGS, TAGS), dtype), "first": np.zeros(TAGS, dtype)}
        self.p["bias"][:, :, HIDDEN:2 * HIDDEN] = 1  # memories last at first

    def states(self, x: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Hidden states (length, windows, both directions) of code windows (windows, length)."""
        p, (count, length) = self.p, x.shape
        table = p["embedding"] @ p["inward"] + p["bias"]
        both = np.stack([x.T, x.T[::-1]])
        h = np.zeros((2, count, HIDDEN), table.dtype)
        c = np.zeros_like(h)
        out = np.empty((length, count, 2 * HIDDEN), table.dtype)
        for t in range(length):
            z = np.stack([table[0][both[0, t]], table[1][both[1, t]]]) + h @ p["round"]
            gates = _sigmoid(z[..., :3 * HIDDEN])
            i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN:2 * HIDDEN], gates[..., 2 * HIDDEN:]
            g = np.tanh(z[..., 3 * HIDDEN:])
            new = f * c + i * g
            bent = np.tanh(new)
            if kept is not None:
                kept.append((i, f, o, g, c, bent, h))
            c, h = new, o * bent
            out[t, :, :HIDDEN] = h[0]
            out[length - 1 - t, :, HIDDEN:] = h[1]
        return out

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        """`states` without what training keeps, as (length, both directions, windows), so that each step works on long rows."""
        p, (count, length) = self.p, x.shape
        # With signs turned and the input of g doubled, all four gates come from one over one more than the exponential; tanh is twice that less one.
        scale = np.where(np.arange(4 * HIDDEN) < 3 * HIDDEN, -1.0, -2.0).astype(p["round"].dtype)
        weight = np.concatenate([p["round"], p["inward"], p["bias"]], axis=1) * scale
        weight = np.ascontiguousarray(weight.transpose(0, 2, 1))
        seen = np.ascontiguousarray(p["embedding"].T[:, x.T].transpose(1, 0, 2))
        out = np.empty((length, 2 * HIDDEN, count), weight.dtype)
        into = np.ones((2, HIDDEN + EMBEDDING + 1, count), weight.dtype)
        h, c, z = into[:, :HIDDEN], np.zeros((2, HIDDEN, count), weight.dtype), np.empty((2, 4 * HIDDEN, count), weight.dtype)
        h[:] = 0
        i, f, o, g = (z[:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        with np.errstate(over="ignore"):
            for t in range(length):
                into[0, HIDDEN:-1], into[1, HIDDEN:-1] = seen[t], seen[length - 1 - t]
                np.exp(np.matmul(weight, into, out=z), out=z)
                z += 1
                np.reciprocal(z, out=z)
                c *= f
                g *= 2
                g -= 1
                g *= i
                c += g
                np.exp(np.multiply(c, -2, out=f), out=f)
                f += 1
                np.divide(2, f, out=f)
                f -= 1
                np.multiply(f, o, out=h)
                out[t, :HIDDEN] = h[0]
                out[length - 1 - t, HIDDEN:] = h[1]
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """By (length, windows, tags)."""
        return (np.matmul(self.p["outward"].T, self._hidden(x)) + self.p["level"][:, None]).transpose(0, 2, 1)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y (windows, length), and its gradients."""
        p, (count, length) = self.p, x.shape
        kept: list = []
        hidden = self.states(x, kept)
        level = (hidden @ p["outward"] + p["level"]).astype(np.float64)
        y = y.T
        follow = np.where(ALLOWED, p["follow"], NEVER).astype(np.float64)
        step, first = np.exp(follow), p["first"].astype(np.float64)
        # Forward and backward sums, each scaled to one; the scales add up to the logarithm of all paths.
        top = level.max(axis=2, keepdims=True)
        weight = np.exp(level - top)
        forth, back = np.empty_like(weight), np.ones_like(weight)
        forth[0] = weight[0] * np.exp(first)
        total = top.sum(axis=(0, 2))
        for t in range(length):
            if t:
                forth[t] = (forth[t - 1] @ step) * weight[t]
            scale = forth[t].sum(axis=1, keepdims=True)
            forth[t] /= scale
            total += np.log(scale[:, 0])
        for t in range(length - 2, -1, -1):
            back[t] = (back[t + 1] * weight[t + 1]) @ step.T
            back[t] /= back[t].sum(axis=1, keepdims=True)
        chance = forth * back
        chance /= chance.sum(axis=2, keepdims=True)
        right = np.eye(TAGS)[y]
        ahead = weight[1:] * back[1:]
        each = np.einsum("tbk,tbk->tb", forth[:-1] @ step, ahead)[..., None]
        pairs = step * ((forth[:-1] / each).reshape(-1, TAGS).T @ ahead.reshape(-1, TAGS))
        seen = right[:-1].reshape(-1, TAGS).T @ right[1:].reshape(-1, TAGS)
        score = (level * right).sum(axis=(0, 2)) + follow[y[:-1], y[1:]].sum(axis=0) + first[y[0]]
        grads = {"follow": np.where(ALLOWED, pairs - seen, 0) / count, "first": (chance[0] - right[0]).sum(axis=0) / count}
        outer = ((chance - right) / count).astype(hidden.dtype)
        grads["outward"] = hidden.reshape(-1, 2 * HIDDEN).T @ outer.reshape(-1, TAGS)
        grads["level"] = outer.sum(axis=(0, 1))
        inner = outer @ p["outward"].T
        dh, dc = np.zeros((2, count, HIDDEN), hidden.dtype), np.zeros((2, count, HIDDEN), hidden.dtype)
        dround, dz = np.zeros_like(p["round"]), np.empty((2, length, count, 4 * HIDDEN), hidden.dtype)
        for t in range(length - 1, -1, -1):
            i, f, o, g, before, bent, h = kept[t]
            dh = dh + np.stack([inner[t, :, :HIDDEN], inner[length - 1 - t, :, HIDDEN:]])
            dc = dc + dh * o * (1 - bent * bent)
            z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dround += h.transpose(0, 2, 1) @ z
            dh, dc = z @ p["round"].transpose(0, 2, 1), dc * f
            dz[:, t] = z
        one = np.eye(CODES, dtype=hidden.dtype)
        table = np.stack([one[line].reshape(-1, CODES).T @ dz[k].reshape(-1, 4 * HIDDEN) for k, line in enumerate((x.T, x.T[::-1]))])
        grads["round"], grads["bias"] = dround, table.sum(axis=1, keepdims=True)
        grads["inward"] = p["embedding"].T @ table
        grads["embedding"] = (table @ p["inward"].transpose(0, 2, 1)).sum(axis=0)
        return float((total - score).mean()), grads

    def _spanned(self, level: np.ndarray) -> np.ndarray:
        """Windows whose best path is not `outside` throughout: the best scores are found for all, the paths only for these."""
        follow = np.where(ALLOWED, self.p["follow"], NEVER).astype(level.dtype)
        by_tag = np.ascontiguousarray(level.transpose(0, 2, 1))
        # Outside and the begins follow any tag, the inside of a kind only two.
        free, inner = [0, *range(1, TAGS, 2)], range(2, TAGS, 2)
        any_tag = follow[:, free][:, :, None]
        best = by_tag[0] + self.p["first"][:, None]
        outside, paths = best[0], np.empty((TAGS, len(free), len(level[0])), level.dtype)
        for line in by_tag[1:]:
            after = np.empty_like(best)
            after[free] = np.add(best[:, None], any_tag, out=paths).max(axis=0)
            for tag in inner:
                np.maximum(best[tag - 1] + follow[tag - 1, tag], best[tag] + follow[tag, tag], out=after[tag])
            best = after
            best += line
            outside = outside + follow[0, 0] + line[0]
        return np.flatnonzero(best.max(axis=0) > outside)

    def decoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (windows, length), and the emissions (length, windows, tags)."""
        level = self.emissions(x)
        out, rows = np.zeros(x.shape, np.int64), self._spanned(level)
        if len(rows):
            out[rows] = self._best_paths(level[:, rows])
        return out, level

    def _best_paths(self, level: np.ndarray) -> np.ndarray:
        length, count = level.shape[:2]
        follow = np.where(ALLOWED, self.p["follow"], NEVER).astype(level.dtype)
        best, came = level[0] + self.p["first"], np.empty((length, count, TAGS), np.int8)
        for t in range(1, length):
            paths = best[:, :, None] + follow
            came[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + level[t]
        out = np.empty((length, count), np.int64)
        out[-1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[t - 1] = came[t, np.arange(count), out[t]]
        return out.T

    def log_odds(self, path: np.ndarray, level: np.ndarray, start: int, end: int) -> float:
        """How much better the path scores from start to end than `outside` there. level: (length, tags)."""
        follow, here = self.p["follow"], slice(start, end)
        with_span = level[np.arange(start, end), path[here]].sum()
        without = level[here, 0].sum()
        edges = range(max(start, 1), min(end + 1, len(path)))
        bare = path.copy()
        bare[here] = 0
        with_span += sum(follow[path[t - 1], path[t]] for t in edges)
        without += sum(follow[bare[t - 1], bare[t]] for t in edges)
        if start == 0:
            with_span, without = with_span + self.p["first"][path[0]], without + self.p["first"][0]
        return float(with_span - without)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Tagger:
        """Adam over small batches, the same number for any sample."""
        random = np.random.default_rng(seed)
        slow, fast = ({k: np.zeros_like(v, np.float64) for k, v in self.p.items()} for _ in range(2))
        order = random.permutation(len(x))
        for step in range(1, steps + 1):
            if len(order) < BATCH:
                order = np.concatenate([order, random.permutation(len(x))])
            rows, order = order[:BATCH], order[BATCH:]
            _, grads = self.loss(x[rows], y[rows])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, grad in grads.items():
                grad = grad * min(1.0, 5 / (size + 1e-12))
                slow[name] = 0.9 * slow[name] + 0.1 * grad
                fast[name] = 0.999 * fast[name] + 0.001 * grad * grad
                move = slow[name] / (1 - 0.9 ** step) / (np.sqrt(fast[name] / (1 - 0.999 ** step)) + 1e-8)
                self.p[name] -= (rate * move).astype(self.p[name].dtype)
        return self


def _path_spans(path: np.ndarray) -> list[Span]:
    """Spans of a path of tags; one that begins with `inside` comes from before the window."""
    out, start = [], None
    line = path.tolist()
    for t, tag in enumerate(line + [0]):
        if start is not None and not (tag and tag % 2 == 0):
            out.append((start, (line[start] - 1) // 2, t))
            start = None
        if tag and start is None and t < len(line):
            start = t
    return out


def windows(text: str) -> list[int]:
    """Starts of the windows of a text; they overlap and cover it."""
    last = max(-(-(len(text) - WINDOW) // STRIDE), 0)
    return list(range(0, last * STRIDE + 1, STRIDE)) if text else []


def _coded(texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Codes of all windows, some hundred at a time, with the text and start of each."""
    places: list[tuple[int, int]] = []
    x = np.zeros((DECODED, WINDOW), np.int64)
    for k, text in enumerate(texts):
        starts, done = windows(text), 0
        while done < len(starts):
            some = np.array(starts[done:done + DECODED - len(places)])
            padded = np.full(some[-1] - some[0] + WINDOW, PAD, np.int64)
            piece = codes(text[some[0]:some[-1] + WINDOW])
            padded[:len(piece)] = piece
            x[len(places):len(places) + len(some)] = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[some - some[0]]
            places += [(k, at) for at in some.tolist()]
            done += len(some)
            if len(places) == DECODED:
                yield places, x
                places = []
    if places:
        yield places, x[:len(places)]


class _Near:
    """The spans, sorted by start, that share characters with a stretch."""

    def __init__(self, spans: list[Span]):
        self.spans, self.starts = spans, [s[0] for s in spans]
        self.reach = list(accumulate((s[2] for s in spans), max))

    def __call__(self, start: int, end: int) -> list[Span]:
        part = self.spans[bisect_right(self.reach, start):bisect_left(self.starts, end)]
        return [s for s in part if s[2] > start]


def reconciled(text: str, base: list[Span], found: list[tuple[Span, float]]) -> list[Span]:
    """Base spans, and of the spans of all windows the set without overlaps of the largest sum of log-odds."""
    odds: dict[Span, float] = {}
    for span, score in found:
        if score >= MARGIN and plausible(span[1], text[span[0]:span[2]]):
            odds[span] = max(score, odds.get(span, score))
    near = _Near(base)
    free = sorted((s for s in odds if not near(s[0], s[2])), key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in free]
    best: list[tuple[float, tuple]] = [(0.0, ())]  # of the first spans by end; the choice as a chain
    for k, span in enumerate(free):
        before = bisect_right(ends, span[0], 0, k)
        with_it = best[before][0] + odds[span]
        best.append((with_it, (span, best[before][1])) if with_it > best[k][0] else best[k])
    chain, out = best[-1][1], list(base)
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return sorted(out)


def tagged(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    found: dict[int, list[tuple[Span, float]]] = {}
    for part, x in _coded(texts):
        paths, level = model.decoded(x)
        for row in np.flatnonzero(paths.any(axis=1)).tolist():
            k, at = part[row]
            length = min(len(texts[k]) - at, WINDOW)
            for start, kind, end in _path_spans(paths[row, :length]):
                cut = (start == 0 and at > 0) or (end == WINDOW and at + WINDOW < len(texts[k])) or paths[row, start] % 2 == 0
                if not cut:
                    score = model.log_odds(paths[row, :length], level[:length, row], start, end)
                    found.setdefault(k, []).append(((at + start, kind, at + end), score))
    return [(b, reconciled(texts[k], b, found.get(k, []))) for k, b in enumerate(base)]


def held_out(doc_id) -> bool:
    """Documents that take no part in training: a fifth, by checksum of the id."""
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0


def _lesson(text: str, near: _Near, at: int) -> tuple[str, str]:
    inside = [(start - at, kind, end - at) for start, kind, end in near(at, at + LESSON)]
    return text[at:at + LESSON], ",".join(f"{s}:{k}:{e}" for s, k, e in inside)


def lessons(text: str) -> Iterator[tuple[int, str, str]]:
    """Windows to learn from, as (sort, text, spans): around spans, around other digits and at-signs, and plain."""
    spans = base_spans(text)
    near = _Near(spans)
    random = np.random.default_rng(crc32(text.encode("utf-8", "surrogatepass")))
    for start, _, end in spans:
        ahead = int(random.integers(4, max(LESSON - (end - start) - 4, 5)))
        yield 0, *_lesson(text, near, max(start - ahead, 0))
    if not spans or len(text) > 4 * LESSON:
        yield 2, *_lesson(text, near, int(random.integers(max(len(text) - LESSON, 1))))
    covered = iter(spans + [(len(text) + LESSON, 0, len(text) + LESSON)])
    span, behind = next(covered), 0
    for match in _ANCHOR.finditer(text):
        while match.start() >= span[2]:
            span = next(covered)
        if match.start() < span[0] and match.start() >= behind:
            behind = match.start() + LESSON
            yield 1, *_lesson(text, near, max(match.start() - int(random.integers(4, LESSON - 4)), 0))


def _spans_of(line: str) -> list[Span]:
    return [tuple(map(int, part.split(":"))) for part in line.split(",")] if line else []


def lesson_arrays(rows: list[tuple[str, str]], share: float = REWRITTEN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of windows; a share of those with a whole span gets one of its spans rewritten."""
    random = np.random.default_rng(seed)
    x, y = np.zeros((len(rows), LESSON), np.int64), np.zeros((len(rows), LESSON), np.int64)
    for row, (text, line) in enumerate(rows):
        spans = _spans_of(line)
        whole = [s for s in spans if 0 <= s[0] and s[2] <= len(text)]
        lone = [s for s in whole if not any(o is not s and o[0] < s[2] and s[0] < o[2] for o in spans)]
        if lone and random.random() < share:
            start, kind, end = lone[int(random.integers(len(lone)))]
            new = rewritten(kind, text[start:end], random)
            text, more = text[:start] + new + text[end:], len(new) - (end - start)
            moved = lambda at: at + more if at >= end else at
            spans = [(start, kind, start + len(new)) if s == (start, kind, end) else (moved(s[0]), s[1], moved(s[2])) for s in spans]
        text = text[:LESSON]
        x[row, :len(text)] = codes(text)
        y[row, :len(text)] = tags(len(text), spans)
    return x, y


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_windows: int = MAX_WINDOWS,
          min_windows: int = MIN_WINDOWS) -> Tagger | None:
    """A tagger of a bounded sample of windows, or None where too few hold spans."""

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lesson for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    if not held_out(doc) for lesson in lessons(text.as_py())]
            for at in range(0, len(rows), ROWS_OUT):
                sort, text, spans = zip(*rows[at:at + ROWS_OUT])
                yield pa.RecordBatch.from_arrays([pa.array(sort, pa.int32()), pa.array(text), pa.array(spans, pa.string())],
                                                 names=["sort", "text", "spans"])

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    found = saved(rows.mapInArrow(teach, "sort int, text string, spans string").distinct(), "lessons")
    picked = [found.where(F.col("sort") == k).orderBy(F.xxhash64(F.lit(SEED), "text", "spans"), "text").limit(max_windows)
              for k in range(3)]
    sample = picked[0].unionAll(picked[1]).unionAll(picked[2]).collect()
    if sum(row["sort"] == 0 for row in sample) < min_windows:
        return None
    return Tagger().fit(*lesson_arrays(sorted((row["text"], row["spans"]) for row in sample)))


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def personal_data(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base (its spans as text), base_sha256, spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    counts = [f"n_{kind}" for kind in KINDS]
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in counts],
        *[T.StructField(c, T.StringType()) for c in ("base", "base_sha256", "spans")]])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                found = tagged(part.column(1).to_pylist(), model)
                lines = [_line(base) for base, _ in found]
                kinds = [[kind for _, kind, _ in base] for base, _ in found]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), *[pa.array([k.count(n) for k in kinds], pa.int64()) for n in range(len(KINDS))],
                    pa.array(lines, pa.string()), pa.array([hashlib.sha256(line.encode()).hexdigest() for line in lines], pa.string()),
                    pa.array([_line(spans) for _, spans in found], pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(find, schema)
