"""Personal data by a character-level BiLSTM-CRF beside four exact patterns.

The network reads characters as classes through a forward and a backward LSTM; a linear layer scores
the tags (outside; begin and inside of each kind) and a CRF the transitions.  It is trained in numpy, from the
labelled spans of a bounded sample of documents.  Labels are the forms that the patterns hold (an address, four numbers, a
long number, a number after a plus sign), in their own context, and corruptions of them that no pattern holds: spelled-out and
spaced addresses (``name (at) host dot com``), defanged ip addresses, cards grouped by other marks, phone
numbers without a plus, values next to other numbers.  Digits and letters are redrawn each time, so that forms are learned and not
values; dates, times, versions and plain numbers put into the same contexts teach what to leave.

Every form holds a digit, an ``@`` or a spelled-out sign; so the network reads windows around those and nothing
else can matter.  Windows overlap by half; where they do, their tag scores are averaged
(the middle of a window counts more than its edge), and one Viterbi pass over the united region decides globally.
Decoded spans that meet no pattern match and are better than the
all-outside path by a margin are checked exactly (a checksum is not learned, nor is a range of numbers) and added.

Defined cases: null and empty texts have no spans (base_sha256 is that of the empty string); a failing match is
dropped without a retry; whole texts are read, whatever their length; an added
span never overlaps a base span; without labelled spans in the sample nothing is added; repeated rows are read one by
one; a null doc_id is carried through; an empty table gives an empty result; other columns are
ignored by ``personal_spans`` and kept by ``masked``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, lean

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Fixed patterns of the base kinds.  A start inside a run of digits never helps, hence the look-behind.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a window is read around.
SPELLED = r"[\[({][\x20]?(?:at|dot|AT|DOT)[\x20]?[\])}]|\x20(?:dot|DOT)\x20"
TRIGGER = re.compile(r"[0-9@]|" + SPELLED)
#: Signs written in other ways, for the exact check of a decoded span.
AT_SIGN = re.compile(r"\x20*[\[({]\x20*at\x20*[\])}]\x20*|\x20+at\x20+|\x20*@\x20*", re.IGNORECASE)
DOT_SIGN = re.compile(r"\x20*[\[({]\x20*(?:dot|\.)\x20*[\])}]\x20*|\x20+dot\x20+|\x20*\.\x20*", re.IGNORECASE)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DAY = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}")

WINDOW, STRIDE, MARGIN = 64, 32, 40
HIDDEN = 20
#: At most so many documents, the first in a hash order of the id, of at most so many bytes each, give labelled spans.
SAMPLE_DOCUMENTS, SAMPLE_TEXT_BYTES = 3000, 1 << 17
#: Windows that are drawn from the sample and its corruptions for training, steps of the optimiser and windows of a step.
TRAIN_WINDOWS, STEPS, BATCH = 3000, 420, 40
#: Score, per character, by which a span must beat the path that stays outside.
MARGIN_SCORE = 0.1

CLASS_OF = np.full(128, 1, np.int64)
for _i, _group in enumerate(("a", "t", "d", "o", "bcefghijklmnpqrsuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "012", "3456789", " ", "\n\t\r", "@", ".", "+", "-", "(", ")", "[{", "]}", "_", "%", ":", "/", "=", "\"'", ",;", "#*$&|<>")):
    CLASS_OF[[ord(c) for c in _group]] = 2 + _i
N_CLASSES = 2 + 26 + 1
PAD, WIDE = 0, N_CLASSES - 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind's place, start, end of the pattern matches, ordered."""
    found = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, CLASS_OF[np.minimum(code, 127)], WIDE)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text around digits and @ signs, united where they meet."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def window_starts(length: int) -> list[int]:
    """Starts of windows that cover a region and overlap by half."""
    return list(range(0, max(1, length - STRIDE), STRIDE))


@dataclass
class Model:
    """Parameters: for each direction the input table, recurrent weights and bias; output; transitions."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        parts = {}
        for d in ("f", "b"):
            parts[f"x{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * h))
            parts[f"h{d}"] = rng.normal(0, 0.25, (h, 4 * h))
            parts[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        parts["out"] = rng.normal(0, 0.2, (2 * h, TAGS))
        parts["bias"] = np.zeros(TAGS)
        parts["trans"] = np.zeros((TAGS, TAGS))
        return Model(parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _lstm(p: dict[str, np.ndarray], x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, rows, both directions) over windows (rows, steps) of classes; the two directions run side by side."""
    rows, steps = x.shape
    table = np.stack([p["xf"] + p["cf"], p["xb"] + p["cb"]])
    weights = np.stack([p["hf"], p["hb"]])
    ahead = x.T
    inputs = np.stack([table[0][ahead], table[1][ahead[::-1]]], 1)
    h = np.zeros((2, rows, HIDDEN), inputs.dtype)
    c = np.zeros_like(h)
    out = np.empty((steps, 2, rows, HIDDEN), h.dtype)
    tape: list = [None] * steps
    for t in range(steps):
        gates = inputs[t] + h @ weights
        s = _sigmoid(gates[..., : 3 * HIDDEN])
        i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
        g = np.tanh(gates[..., 3 * HIDDEN :])
        new = f * c + i * g
        squashed = np.tanh(new)
        if keep:
            tape[t] = (h, c, i, f, o, g, squashed)
        c, h = new, o * squashed
        out[t] = h
    return np.concatenate([out[:, 0], out[::-1, 1]], 2), tape


def emissions(model: Model, x: np.ndarray) -> np.ndarray:
    """Tag scores (rows, steps, tags) of windows of classes."""
    p = model.parts
    return (_lstm(p, x, False)[0] @ p["out"] + p["bias"]).transpose(1, 0, 2)


def _crf_gradient(e: np.ndarray, trans: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log-likelihood by emissions (steps, rows, tags) and transitions; padding stays outside it.

    Forward and backward weights are scaled to sum to one at every step, which keeps them in range.
    """
    steps, rows, tags = e.shape
    local = np.exp(e - e.max(2, keepdims=True))
    move = np.exp(trans)
    ahead, behind = np.empty_like(local), np.ones_like(local)
    ahead[0] = local[0] / local[0].sum(1, keepdims=True)
    for t in range(1, steps):
        step = (ahead[t - 1] @ move) * local[t]
        ahead[t] = np.where(real[t][:, None], step / step.sum(1, keepdims=True), ahead[t - 1])
    for t in range(steps - 2, -1, -1):
        step = (behind[t + 1] * local[t + 1]) @ move.T
        behind[t] = np.where(real[t + 1][:, None], step / step.sum(1, keepdims=True), behind[t + 1])
    share = ahead * behind
    share *= real[:, :, None] / share.sum(2, keepdims=True)
    grad = share
    np.subtract.at(grad, (*np.nonzero(real), y[real]), 1.0)
    left, right = ahead[:-1], local[1:] * behind[1:]
    total = ((left @ move) * right).sum(2)
    weight = np.where(real[1:], 1.0 / np.maximum(total, 1e-300), 0.0)
    pair = np.einsum("tra,trb->ab", left * weight[:, :, None], right, optimize=True) * move
    np.subtract.at(pair, (y[:-1][real[1:]], y[1:][real[1:]]), 1.0)
    return grad, pair


def _gradient(model: Model, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p = model.parts
    rows, steps = x.shape
    both, tape = _lstm(p, x, True)
    grad_e, move = _crf_gradient(both @ p["out"] + p["bias"], p["trans"], y.T, (x != PAD).T)
    flat = grad_e.reshape(-1, TAGS)
    g = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(0), "trans": move}
    into = grad_e @ p["out"].T
    into = np.stack([into[:, :, :HIDDEN], into[::-1, :, HIDDEN:]], 1)
    back = np.stack([p["hf"].T, p["hb"].T])
    every = np.empty((steps, 2, rows, 4 * HIDDEN))
    weights = np.zeros((2, HIDDEN, 4 * HIDDEN))
    dh, dc = np.zeros((2, rows, HIDDEN)), np.zeros((2, rows, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, cand, squashed = tape[t]
        dh = dh + into[t]
        dc = dc + dh * o * (1 - squashed**2)
        gates = every[t]
        gates[..., :HIDDEN] = dc * cand * i * (1 - i)
        gates[..., HIDDEN : 2 * HIDDEN] = dc * c * f * (1 - f)
        gates[..., 2 * HIDDEN : 3 * HIDDEN] = dh * squashed * o * (1 - o)
        gates[..., 3 * HIDDEN :] = dc * i * (1 - cand**2)
        weights += h.transpose(0, 2, 1) @ gates
        dh, dc = gates @ back, dc * f
    of_class = (np.arange(N_CLASSES)[:, None] == x.T.reshape(1, -1)).astype(float)
    for k, d in enumerate(("f", "b")):
        own = every[:, k] if d == "f" else every[::-1, k]
        table = of_class @ own.reshape(-1, 4 * HIDDEN)
        g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = table, weights[k], table.sum(0)
    return {k: v / rows for k, v in g.items()}


def tags_of(length: int, spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    """Tags of the characters start .. start + length; where spans of two kinds meet, the earlier listed stays."""
    y = np.zeros(length, np.int64)
    for kind, a, b in reversed(spans):
        lo, hi = max(a - start, 0), min(b - start, length)
        if lo < hi:
            y[lo:hi] = 2 + 2 * kind
            if a >= start:
                y[lo] = 1 + 2 * kind
    return y


def form_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the patterns' forms, whether or not their numbers pass."""
    found = [s for s in base_spans(text) if s[0] == 0]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p) <= 3 for p in m.groups())]
    found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= sum("0" <= c <= "9" for c in m[0]) <= 19]
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def redrawn(text: str, rng: np.random.Generator) -> str:
    """The text with other digits and small letters."""
    return "".join(chr(48 + rng.integers(10)) if "0" <= c <= "9" else chr(97 + rng.integers(26)) if "a" <= c <= "z" else c for c in text)


def _one(rng: np.random.Generator, choices: tuple[str, ...]) -> str:
    return choices[rng.integers(len(choices))]


def corrupted(kind: int, value: str, rng: np.random.Generator) -> str:
    """The value of a span in a form that the pattern does not hold, with other digits and letters."""
    value = redrawn(value, rng)
    digits = "".join(c for c in value if "0" <= c <= "9")
    if kind == 0:
        at = _one(rng, (" (at) ", " [at] ", "(at)", "[at]", " at ", " @ ", " {at} "))
        dot = _one(rng, (" dot ", " (dot) ", "[dot]", "(dot)")) if at == " at " or rng.random() < 0.7 else "."
        local, _, domain = value.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return _one(rng, ("[.]", "(.)", " . ", " dot ", "[dot]", ". ")).join(value.split("."))
    if kind == 2:
        mark = _one(rng, (".", "/", "_", "  ", " - ", "–"))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = digits[-10:]
    marks = ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "{}/{}-{}", "({}) {} {}", "1-{}-{}-{}", "001 {} {} {}")
    return _one(rng, marks).format(digits[:-7], digits[-7:-4], digits[-4:])


def decoy(rng: np.random.Generator) -> str:
    """Numbers and words that are no personal data."""
    plain = ("2024-05-17", "17.05.2024", "2019-11-02 10:25", "12:30:45", "1.2.3", "10.4.1-2", "99", "2500", "84512", "905133", "7781204", "1,250,000", "3.14159",
             "50%", "12-14", "1998/99", "section 4.2.1", "0x3f9a", "at 10 dot 5", "the dot and", "(at)", "[dot]", "meet @ noon", "3 . 4", "100 - 200")
    return redrawn(_one(rng, plain), rng) if rng.random() < 0.5 else _one(rng, plain)


def examples(texts: list[str | None], rng: np.random.Generator, most: int = TRAIN_WINDOWS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled pieces of text: as they stand, with a span corrupted, or with a decoy in its place."""
    plain: list[tuple[str, list[tuple[int, int, int]]]] = []
    contexts: dict[int, list[tuple[str, str, str]]] = {}
    for text in texts:
        if not text or not TRIGGER.search(text):
            continue
        spans = form_spans(text)
        for kind, a, b in spans:
            contexts.setdefault(kind, []).append((text[max(0, a - WINDOW) : a], text[a:b], text[b : b + WINDOW]))
        for a, b in regions(text):
            for s in window_starts(b - a):
                lo, hi = a + s, min(a + s + WINDOW, b)
                plain.append((text[lo:hi], [(k, max(x, lo) - lo, min(y, hi) - lo) for k, x, y in spans if x < hi and lo < y]))
    if not contexts:
        return []
    pick = rng.permutation(len(plain))[: most // 3]
    out = [plain[i] for i in pick]
    kinds = sorted(contexts)
    while len(out) < most:
        kind = kinds[rng.integers(len(kinds))]
        before, value, after = contexts[kind][rng.integers(len(contexts[kind]))]
        draw = rng.random()
        value = decoy(rng) if draw < 0.25 else corrupted(kind, value, rng) if draw < 0.85 else redrawn(value, rng)
        spans = [(kind, 0, len(value))] if draw >= 0.25 else []
        if rng.random() < 0.15:  # another number right before or behind
            more = redrawn("0" * int(rng.integers(3, 9)), rng)
            before, after = (before + more + " ", after) if rng.random() < 0.5 else (before, " " + more + after)
        room = max(0, WINDOW - len(value))
        left = before[len(before) - min(len(before), int(rng.integers(0, room + 1))) :]
        piece = (left + value + after)[:WINDOW]
        labels = [(k, a + len(left), b + len(left)) for k, a, b in spans]
        labels += form_spans(left) + [(k, a + len(left) + len(value), b + len(left) + len(value)) for k, a, b in form_spans(after)]
        out.append((piece, [(k, a, min(b, WINDOW)) for k, a, b in labels if a < len(piece)]))
    return out


def train(texts: list[str | None], seed: int = 5) -> Model | None:
    """A model from the forms in the texts; None if there are none to learn from."""
    rng = np.random.default_rng(seed)
    pieces = examples(texts, rng)
    if not pieces:
        return None
    x_all = np.array([np.pad(classes(text), (0, WINDOW - len(text))) for text, _ in pieces])
    y_all = np.array([np.pad(tags_of(len(text), spans, 0), (0, WINDOW - len(text))) for text, spans in pieces])
    model = Model.fresh()
    move = np.full((TAGS, TAGS), 0.1)
    real = (x_all[:, 1:] != PAD)
    np.add.at(move, (y_all[:, :-1][real], y_all[:, 1:][real]), 1.0)
    model.parts["trans"] = np.maximum(np.log(move / move.sum(1, keepdims=True)), -6.0)
    first = {k: np.zeros_like(v) for k, v in model.parts.items()}
    second = {k: np.zeros_like(v) for k, v in model.parts.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(x_all))])
        rows, order = order[:BATCH], order[BATCH:]
        rate = 0.03 * (1 - 0.95 * step / STEPS)
        for k, g in _gradient(model, x_all[rows], y_all[rows]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.parts[k] = model.parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Model({k: v.astype(np.float32) for k, v in model.parts.items()})


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tag sequence of one region."""
    score = e[0].copy()
    back = np.zeros(e.shape, np.int64)
    for t in range(1, len(e)):
        through = score[:, None] + trans
        back[t] = through.argmax(0)
        score = through[back[t], np.arange(TAGS)] + e[t]
    path = np.empty(len(e), np.int64)
    path[-1] = score.argmax()
    for t in range(len(e) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def reconciled(model: Model, code: list[np.ndarray]) -> list[np.ndarray]:
    """Tag scores of whole regions from their overlapping windows."""
    owner, start, rows = [], [], []
    for r, own in enumerate(code):
        for s in window_starts(len(own)):
            part = own[s : s + WINDOW]
            owner.append(r)
            start.append(s)
            rows.append(np.pad(part, (0, WINDOW - len(part))))
    out = [np.zeros((len(own), TAGS), np.float32) for own in code]
    weight = [np.zeros((len(own), 1), np.float32) for own in code]
    trust = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]))[:, None].astype(np.float32)
    for at in range(0, len(rows), 1024):
        scores = emissions(model, np.array(rows[at : at + 1024]))
        for k, e in enumerate(scores):
            r, s = owner[at + k], start[at + k]
            n = min(WINDOW, len(code[r]) - s)
            out[r][s : s + n] += e[:n] * trust[:n]
            weight[r][s : s + n] += trust[:n]
    return [o / w for o, w in zip(out, weight)]


def decoded(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text, each better than outside by the margin."""
    where = [(i, a, b) for i, text in enumerate(texts) for a, b in regions(text)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    trans = model.parts["trans"]
    for (i, a, _), e in zip(where, reconciled(model, [classes(texts[i][a:b]) for i, a, b in where])):
        path = viterbi(e, trans)
        best = e[np.arange(len(e)), path]
        best[1:] += trans[path[:-1], path[1:]]
        outside = e[:, 0].copy()
        outside[1:] += trans[0, 0]
        at = 0
        while at < len(path):
            tag = path[at]
            if not tag:
                at += 1
                continue
            kind, end = (tag - 1) // 2, at + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            after = min(end + 1, len(path))  # with the step back outside
            gain = (best[at:after].sum() - outside[at:after].sum()) / (end - at)
            if end - at >= 7 and gain >= MARGIN_SCORE and tag == 1 + 2 * kind:
                found[i].append((int(kind), a + at, a + end))
            at = end
    return found


def fitted(text: str, span: tuple[int, int, int]) -> tuple[int, int, int]:
    """The span without marks at its ends, and with the whole of the words or numbers that it begins and ends in."""
    kind, a, b = span
    own = "0123456789" if kind else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-."
    while a < b and not (text[a] in own or (kind == 3 and text[a] in "(+")):
        a += 1
    while b > a and text[b - 1] not in own:
        b -= 1
    if a == b:
        return kind, a, b
    while a and text[a - 1] in own and text[a] in own:
        a -= 1
    while b < len(text) and text[b] in own:
        b += 1
    while not kind and b > a and text[b - 1] in "._%+-":
        b -= 1
    if kind == 3 and a and text[a - 1] in "(+" and text[a] != "(":
        a -= 1
    return kind, a, b


def plausible(text: str, span: tuple[int, int, int]) -> bool:
    """The exact check of a decoded span: an address once its signs are written plainly, or numbers that can be of the kind."""
    kind, a, b = span
    own = text[a:b]
    if kind == 0:
        return bool(EMAIL.fullmatch(DOT_SIGN.sub(".", AT_SIGN.sub("@", own))))
    if kind == 1:
        parts = DOT_SIGN.sub(".", own).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = "".join(c for c in own if "0" <= c <= "9")
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and all(c in " -–./_" for c in own if not "0" <= c <= "9")
    marks = [c for c in own if not "0" <= c <= "9"]
    return 9 <= len(digits) <= 15 and len(marks) >= 2 and all(c in " ().+-/" for c in marks) and not DAY.search(own)


def all_spans(model: Model | None, texts: list[str]) -> list[tuple[list, list]]:
    """Base and added spans of each text; added spans meet neither base spans nor each other."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    if model is not None:
        for i, found in enumerate(decoded(model, texts)):
            free = [(a, b) for _, a, b in base[i]]
            for span in (fitted(texts[i], s) for s in found):
                if not any(a < span[2] and span[1] < b for a, b in free) and plausible(texts[i], span):
                    more[i].append(span)
                    free.append(span[1:])
    return list(zip(base, more))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def texts_with_trigger(column: pa.Array) -> np.ndarray:
    """Rows whose text has anything that a window is read around."""
    found = pc.match_substring_regex(pc.fill_null(column, ""), TRIGGER.pattern.replace(r"\x20", " "))
    return np.flatnonzero(found.to_numpy(zero_copy_only=False))


def fit(docs: DataFrame, most: int = SAMPLE_DOCUMENTS) -> Model | None:
    """A model from at most ``most`` documents of docs."""
    some = docs.select("doc_id", "text").filter(f"doc_id IS NOT NULL AND octet_length(text) <= {SAMPLE_TEXT_BYTES}")
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = some.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist())


def personal_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, base counts by kind, n_added, base_sha256 and all spans of every row of docs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((5, n), np.int64)
            sha, spans = [nothing] * n, [""] * n
            column = batch.column("text")
            rows = texts_with_trigger(column)
            for i, (base, more) in zip(rows.tolist(), all_spans(model, column.take(pa.array(rows)).to_pylist())):
                for kind, _, _ in base:
                    counts[kind, i] += 1
                counts[4, i] = len(more)
                sha[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(sorted(base + more))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(sha), pa.array(spans)], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, united with those that it meets, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with personal data in text replaced by its kind; n_chars, if there, follows the new text."""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            rows = texts_with_trigger(column)
            texts = column.to_pylist()
            own = [texts[i] for i in rows.tolist()]
            changed = {}
            for i, text, (base, more) in zip(rows.tolist(), own, all_spans(model, own)):
                if base or more:
                    texts[i] = mask(text, base + more)
                    changed[i] = len(texts[i])
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, column.type)
            if "n_chars" in columns and changed:
                sizes = columns["n_chars"].to_pylist()
                for i, size in changed.items():
                    sizes[i] = size
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(lean(replace), docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return personal_spans(docs, fit(docs))
