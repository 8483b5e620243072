"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions for what they miss.

The network is trained in numpy on labelled windows: a synthetic table, and
all windows of a bounded sample of documents with the patterns' own spans. It
reads every character of every text in overlapping windows. Where windows
overlap, their tag scores are averaged, each by its distance to the window's
edge, and one Viterbi path over the whole text, with the learned transitions,
reconciles them. Its spans are added where they touch no pattern span and pass
their kind's check.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from corvid.llm.frames import extended
from corvid.llm.textbytes import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents that join the synthetic table in training, the first by a hash of their text; they are read whole.
TRAIN_DOCS = 60
#: Characters of a window, and from one window to the next; at most two windows overlap.
SPAN, STEP = 128, 104
#: Windows that run in step; small enough for a core's cache.
BATCH = 1024
HIDDEN = 12
TAGS = 1 + 2 * len(KINDS)

# Fixed patterns of the contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The look-behind changes no match (a match can't fail at the start of a run of
# digits and succeed within it); it keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def number(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Matches of EMAIL from the @ signs outward: a match begins where the run of local characters before its @ does, but not inside the match before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            free = m.end()
            yield begin, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = number(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(number(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


NUMBERS = re.compile("[0-9]+")


def holds(kind: int, s: str) -> bool:
    """Whether a decoded span passes the check of its kind: an at sign of some form, four bytes, a checksum, a count of digits; numbers hold no letters."""
    d = number(s)
    if kind == 0:
        return "@" in s or "at" in s.lower()
    if any(c.isalpha() for c in s.lower().replace("dot", "")):
        return False
    if kind == 1:
        return len(parts := NUMBERS.findall(s)) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 15 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def _symbols() -> np.ndarray:
    """Input class of every code point below 256: digits and letters fall together, letters beyond ASCII apart; signs stand alone."""
    c = np.zeros(256, dtype=np.int64)
    c[48:58], c[97:123], c[65:91], c[192:256] = 1, 2, 3, 4
    for k, sign in enumerate("@.-_%+() \n,:;/[]='\"#|!?<>"):
        c[ord(sign)] = 5 + k
    return c


SYMBOLS = _symbols()
WIDTH = int(SYMBOLS.max()) + 1


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(code < 256, SYMBOLS[np.minimum(code, 255)], np.where(code < 0x2000, 4, 0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray):
    """Hidden states [step, window, H] of symbols [step, window], and what the backward pass needs."""
    steps, n = x.shape
    h = wh.shape[0]
    hs, cs, gates = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32), np.zeros((steps, n, 4 * h), np.float32)
    for t in range(steps):
        z = wx[x[t]] + hs[t] @ wh + bias
        g = np.concatenate([sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])], axis=1)
        cs[t + 1] = g[:, h : 2 * h] * cs[t] + g[:, :h] * g[:, 3 * h :]
        hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
        gates[t] = g
    return hs, cs, gates


def lstm_gradient(x, wh, hs, cs, gates, dh):
    """Gradients (wx, wh, bias) for dh [step, window, H]."""
    steps, n, h = dh.shape
    every = np.zeros((steps, n, 4 * h), np.float32)
    nh, nc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * h : (k + 1) * h] for k in range(4))
        tc, d = np.tanh(cs[t + 1]), dh[t] + nh
        dc = d * o * (1 - tc * tc) + nc
        dz = np.concatenate([dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        every[t] = dz
        nh, nc = dz @ wh.T, dc * f
    every = every.reshape(-1, 4 * h)
    gx = (x.ravel() == np.arange(WIDTH)[:, None]).astype(np.float32) @ every
    return gx, hs[:-1].reshape(-1, h).T @ every, every.sum(axis=0)


def crf(e: np.ndarray, link: np.ndarray):
    """(log partition [window], marginals [step, window, tag], expected transitions) of scores e; forward and backward sums are scaled at every step."""
    top = e.max(axis=2, keepdims=True)
    own, step = np.exp((e - top).astype(np.float64)), np.exp(link.astype(np.float64))
    a, b = np.empty_like(own), np.empty_like(own)
    scale = np.empty(own.shape[:2])
    for t in range(len(e)):
        a[t] = own[t] * (a[t - 1] @ step) if t else own[t]
        scale[t] = a[t].sum(axis=1)
        a[t] /= scale[t][:, None]
    b[-1] = 1
    for t in range(len(e) - 2, -1, -1):
        b[t] = (own[t + 1] * b[t + 1]) @ step.T / scale[t + 1][:, None]
    to = (own * b / scale[:, :, None])[1:].reshape(-1, e.shape[2])
    pairs = a[:-1].reshape(-1, e.shape[2]).T @ to * step
    return np.log(scale).sum(axis=0) + top.sum(axis=0)[:, 0], a * b, pairs


def emissions(model: dict, x: np.ndarray):
    fore = lstm(x, *model["f"])
    back = lstm(x[::-1], *model["b"])
    both = np.concatenate([fore[0][1:], back[0][1:][::-1]], axis=2)
    return both @ model["out"] + model["bias"], both, fore, back


def train(windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 5) -> dict:
    """BiLSTM and CRF weights by Adam on (symbols, tags) windows of SPAN characters."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {"fx": shape(WIDTH, 4 * HIDDEN), "fh": shape(HIDDEN, 4 * HIDDEN), "fb": np.zeros(4 * HIDDEN, np.float32), "bx": shape(WIDTH, 4 * HIDDEN), "bh": shape(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32), "out": shape(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "link": np.zeros((TAGS, TAGS), np.float32)}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    pack = lambda: {"f": (p["fx"], p["fh"], p["fb"]), "b": (p["bx"], p["bh"], p["bb"]), "out": p["out"], "bias": p["bias"], "link": p["link"]}
    every_x, every_y, step = np.stack([w[0] for w in windows]), np.stack([w[1] for w in windows]), 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            x, y = every_x[order[lo : lo + batch]].T, every_y[order[lo : lo + batch]].T
            model = pack()
            e, both, fore, back = emissions(model, x)
            _, marginal, pairs = crf(e, p["link"])
            de = marginal.astype(np.float32)
            n, t = np.meshgrid(np.arange(x.shape[1]), np.arange(SPAN))
            de[t, n, y] -= 1
            np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
            dboth = de @ p["out"].T
            g = {"link": pairs, "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1))}
            g["fx"], g["fh"], g["fb"] = lstm_gradient(x, p["fh"], *fore, dboth[:, :, :HIDDEN])
            g["bx"], g["bh"], g["bb"] = lstm_gradient(x[::-1], p["bh"], *back, dboth[::-1, :, HIDDEN:])
            step += 1
            for k in p:
                d = g[k] / x.shape[1] + (1e-3 * p[k] if k == "link" else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                p[k] = p[k] - np.float32(rate * (1 - epoch / epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return pack()


def tagged(text: str, spans: list[tuple[int, int, int]], at: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of the SPAN characters from `at`; beyond the text's ends: blanks."""
    tags = np.zeros(len(text), np.int64)
    for kind, s, e in spans:
        tags[s:e] = 2 + 2 * kind
        tags[s] = 1 + 2 * kind
    x, y = np.full(SPAN, SYMBOLS[32]), np.zeros(SPAN, np.int64)
    lo, hi = max(0, at), min(len(text), at + SPAN)
    if lo < hi:
        x[lo - at : hi - at], y[lo - at : hi - at] = encode(text[lo:hi]), tags[lo:hi]
    return x, y


def synthetic(n: int = 2400, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: sentences with one or two items of a kind, plain or disguised, or with a decoy (version, date, key, price, book number)."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    letters = lambda k, some="abcdefghijklmnopqrstuvwxyz": "".join(pick(some) for _ in range(k))
    digits = lambda k: letters(k, "0123456789")
    out = []

    def word():
        w = letters(int(rng.integers(2, 10)), pick(["abcdefghijklmnopqrstuvwxyz"] * 3 + ["aeiouéüñstrnl"]))
        return pick([w, w, w, w, w.capitalize(), w.upper() if rng.integers(4) == 0 else w])

    def email():
        user = word() + pick([".", "_", "-", "+", ""]) + pick([digits(2), word(), word(), ""])
        dot, at = pick([(".", "@")] * 5 + [(" [dot] ", " [at] "), (".", " (at) "), ("[dot]", "[at]"), (".", "[at]"), (".", "(at)")])
        return user.strip("._-+") + at + dot.join([word(), *([word()] if rng.integers(3) == 0 else []), pick(["com", "org", "net", "de", "es", "fr", "example"])])

    def ip():
        return pick([".", ".", ".", "[.]", " . ", "(.)", "[dot]"]).join(str(rng.integers(256)) for _ in range(4))

    def card():
        body = pick(["34", "37"]) + digits(12) if rng.integers(5) == 0 else pick("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        cuts = (0, 4, 10, 15) if len(body) == 15 else (0, 4, 8, 12, 16)
        return pick(["", " ", "-", ".", "/", " - ", "_"]).join(body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def phone():
        country = pick(["+" + digits(1), "+" + digits(2), "00" + digits(2), "", "", "0"])
        rest = pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "{}/{}-{}", "({}) {} {}"]).format(digits(3), digits(3), digits(4))
        return (country + pick([" ", "", "-"]) + rest).strip(" -") if country not in ("", "0") else country + rest

    def decoy():
        return pick([
            lambda: ".".join(digits(int(rng.integers(1, 3))) for _ in range(int(rng.integers(2, 4)))), lambda: f"20{digits(2)}-0{rng.integers(1, 9)}-1{rng.integers(9)}", lambda: f"{rng.integers(1, 28)}.{rng.integers(1, 12)}.20{digits(2)}",
            lambda: "AKIA" + digits(3) + word().upper() + digits(2), lambda: f"{digits(2)}.{digits(2)} EUR", lambda: "token=" + digits(4) + word() + digits(3), lambda: digits(int(rng.integers(1, 14))), lambda: "978-" + digits(1) + "-" + digits(2) + "-" + digits(6) + "-" + digits(1),
            lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: digits(4) + pick("- ") + digits(4), lambda: f"http://www.{word()}.com/{word()}/{digits(4)}", lambda: f"@{word()}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{digits(3)} {word()} {digits(3)}", lambda: f"#{digits(6)}", lambda: f'"{letters(int(rng.integers(16, 41)), "0123456789abcdef")}"', word,
        ])()

    for i in range(n):
        kind = (0, -1, 0, 1, 0, -1, 2, 3)[i % 8]
        item = (email, ip, card, phone, decoy)[kind]()
        left = " ".join(word() for _ in range(int(rng.integers(0, 9)))) + pick([" ", " ", ": ", ". ", "\n", " (", "=", ", "])
        right = pick([" ", " ", ". ", ", ", "\n", ") ", "; ", " - "]) + " ".join(word() for _ in range(int(rng.integers(0, 9))))
        right = pick([right] * 9 + ["."])
        spans = [(kind, len(left), len(left) + len(item))] if kind >= 0 else []
        text = left + item
        if kind >= 0 and rng.integers(3) == 0:
            # Two items of a kind with a word or a sign between them.
            text += pick([", ", f" {word()} ", "; ", " / ", f" {letters(2)} "])
            more = (email, ip, card, phone)[kind]()
            spans.append((kind, len(text), len(text) + len(more)))
            text += more
        out.append((text + right, spans))
    return out


def starts(size: int) -> range:
    """Where the windows of a text of so many characters begin."""
    return range(0, max(1, size - SPAN + STEP), STEP)


def fit(docs: DataFrame | None = None, text: str = "text", sample: int = TRAIN_DOCS) -> dict:
    """The network, from the synthetic table and all windows of at most `sample` documents, labelled by the patterns."""
    rng, windows = np.random.default_rng(11), []
    for t, spans in synthetic():
        at = spans[0][1] if spans else len(t) // 2
        windows.append(tagged(t, spans, at - int(rng.integers(0, SPAN - 16))))
    if docs is not None:

        def run(batches):
            for b in batches:
                for t in b.column(0).to_pylist():
                    found = [tagged(t, base_spans(t), at) for at in starts(len(t))]
                    yield pa.RecordBatch.from_pydict({"x": pa.array([x.tobytes() for x, _ in found], pa.binary()), "y": pa.array([y.tobytes() for _, y in found], pa.binary())})

        some = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
        # About four times the sample pass the bound on the hash, so no task sorts more texts than that.
        share = min(1.0, 4.0 * (sample + 16) / max(1, some.agg(F.approx_count_distinct("h")).first()[0]))
        low = some.where(F.col("h") <= int(-(2**63) + min(2**64 - 1, share * 2**64))).groupBy("h").agg(F.min("t").alias("t"))
        picked = low.orderBy("h").limit(sample).select("t")
        windows += [(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in sorted((bytes(r.x), bytes(r.y)) for r in picked.mapInArrow(run, "x binary, y binary").collect())]
    return train(windows)


def states(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The hidden states of `lstm`, without what only its gradient needs."""
    h = wh.shape[0]
    scale = np.where(np.arange(4 * h) < 3 * h, np.float32(0.5), np.float32(1))
    table, wh = (wx + bias) * scale, wh * scale
    n = x.shape[1]
    out, hidden, cell = np.empty((*x.shape, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    g, more = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
    for t in range(len(x)):
        # The gates' sigmoids as (1 + tanh(z / 2)) / 2, in place.
        np.take(table, x[t], axis=0, out=g, mode="clip")
        np.matmul(hidden, wh, out=more)
        g += more
        np.tanh(g, out=g)
        g[:, : 3 * h] += 1
        cell *= g[:, h : 2 * h]
        new = g[:, :h]
        new *= g[:, 3 * h :]
        cell += new
        cell *= np.float32(0.5)
        hidden = out[t]
        np.tanh(cell, out=hidden)
        hidden *= g[:, 2 * h : 3 * h]
        hidden *= np.float32(0.5)
    return out


def scores(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tag scores [character, tag] of all texts end to end, the texts' offsets).

    Texts lie on a grid of blocks of STEP characters. A window covers its own block and
    the beginning of the next one, which after a text's last window is nobody else's.
    """
    code = [encode(t) for t in texts]
    size = np.array([len(c) for c in code], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    many = np.array([len(starts(n)) if n else 0 for n in size.tolist()], np.int64)
    first = np.cumsum(many + 1) - many - 1
    at = np.repeat(first * STEP - ends[:-1], size) + np.arange(ends[-1])
    blocks = int((many + 1).sum()) + 1
    grid = np.full(blocks * STEP + SPAN, SYMBOLS[32], np.int64)
    grid[at] = np.concatenate([np.zeros(0, np.int64), *code])
    view = np.lib.stride_tricks.sliding_window_view(grid, SPAN)[::STEP]
    own = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    total, weight = np.zeros((blocks, STEP, TAGS), np.float32), np.zeros((blocks, STEP, 1), np.float32)
    place = np.arange(SPAN)
    near = (np.minimum(place, SPAN - 1 - place).astype(np.float32) + 1)[:, None]
    for lo in range(0, len(own), BATCH):
        w = own[lo : lo + BATCH]
        x = np.ascontiguousarray(view[w].T)
        e = states(x, *model["f"]) @ model["out"][:HIDDEN]
        e += (states(x[::-1], *model["b"]) @ model["out"][HIDDEN:])[::-1]
        e += model["bias"]
        e = e.transpose(1, 0, 2) * near
        total[w] += e[:, :STEP]
        weight[w] += near[:STEP]
        total[w + 1, : SPAN - STEP] += e[:, STEP:]
        weight[w + 1, : SPAN - STEP] += near[STEP:]
    total /= np.maximum(weight, 1)
    return total.reshape(-1, TAGS)[at], ends


def unsettled(e: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Which characters may have a tag other than 0 on the best path.

    A run of other tags gains at most the sum of its characters' best scores over tag 0 and of the best
    transitions within it, less what leaving and reaching tag 0 costs. Only characters in a run of no loss are left open.
    """
    inner, leave, reach, stay = float(link[1:, 1:].max()), float(link[0, 1:].max()), float(link[1:, 0].max()), float(link[0, 0])
    w = (e[:, 1:].max(axis=1) - e[:, 0]).astype(np.float64) + inner - stay
    cost = max(leave + reach - inner - stay, reach - inner, leave - inner, stay - inner)
    sums = np.concatenate([[0.0], np.cumsum(w)])
    fore = sums[1:] - np.minimum.accumulate(sums)[:-1]
    back = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[:-1]
    return fore + back - w + cost >= -1e-3


def viterbi(e: np.ndarray, link: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The best tag path of each text, end to end; the stretches that tag 0 is not sure of run in step, the longest first."""
    path = np.zeros(len(e), np.int8)
    open_ = unsettled(e, link)
    first = np.zeros(len(e) + 1, bool)
    first[ends] = True
    begin = np.flatnonzero(open_ & (first[:-1] | ~np.concatenate([[False], open_[:-1]])))
    if not len(begin):
        return path
    stop = np.flatnonzero(open_ & (first[1:] | ~np.concatenate([open_[1:], [False]]))) + 1
    order = np.argsort(begin - stop, kind="stable")
    begin, stop = begin[order], stop[order]
    size = stop - begin
    active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    score = np.where(first[begin][:, None], 0, link[0]) + e[begin]
    back = np.zeros((len(e), TAGS), np.int8)
    for t, n in enumerate(active):
        if t:
            every = score[:n, :, None] + link
            back[begin[:n] + t] = every.argmax(axis=1)
            score[:n] = every.max(axis=1) + e[begin[:n] + t]
    tag = (score + np.where(first[stop][:, None], 0, link[:, 0])).argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        path[begin[:n] + t] = tag[:n]
        if t:
            tag[:n] = back[begin[:n] + t, tag[:n]]
    return path


def decoded(model: dict, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the network finds in each text."""
    e, ends = scores(model, texts)
    path = viterbi(e, model["link"], ends)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    tagged = np.flatnonzero(path)
    text = np.searchsorted(ends, tagged, side="right") - 1
    before = (None, None, None)
    for k, at, tag in zip(text.tolist(), tagged.tolist(), path[tagged].tolist(), strict=True):
        kind = (tag - 1) // 2
        if tag % 2 or before != (k, at - 1, kind):
            out[k].append((kind, at - int(ends[k]), at - int(ends[k]) + 1))
        else:
            out[k][-1] = (kind, out[k][-1][1], at - int(ends[k]) + 1)
        before = (k, at, kind)
    return out


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """A span without the blanks and signs at its ends, and with brackets in pairs where the other one adjoins."""
    while s < e and (text[s] in " \t\r\n,;:'\"<>=." or (text[s] == "(" and text.count("(", s, e) > text.count(")", s, e))):
        s += 1
    while s < e and text[e - 1] in " \t\r\n,;:'\"<>=.(":
        e -= 1
    if s and text[s - 1] == "(" and text.count(")", s, e) > text.count("(", s, e):
        s -= 1
    return s, e


def find(model: dict, column: pa.Array) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of every row."""
    out: list[tuple[list, list]] = []
    for lo, hi in slices(column):
        texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        for text, more in zip(texts, decoded(model, texts), strict=True):
            base = base_spans(text)
            free = sorted((s, e) for _, s, e in base)
            every = list(base)
            for kind, s, e in more:
                s, e = trimmed(text, s, e)
                if s < e and all(e <= a or b <= s for a, b in free) and holds(kind, text[s:e]):
                    every.append((kind, s, e))
            out.append((base, sorted(every)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with pii_base and pii_spans (kind:start:end, comma-joined; code points, end exclusive) and pii_<kind> counts of all spans.

    Null counts as empty: no spans, empty strings. Pattern spans of different
    kinds may overlap each other; added spans touch none of them. Rows and
    other columns pass unchanged; an input column of a new name is replaced.
    An empty table gives an empty table.
    """
    names = ["pii_base", "pii_spans", *(f"pii_{k}" for k in KINDS)]
    docs = docs.drop(*names)
    where, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = find(shared.value, b.column(where))
            counts = [pa.array([sum(x[0] == k for x in every) for _, every in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([written(x) for x, _ in found], pa.string()), pa.array([written(x) for _, x in found], pa.string()), *counts], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, extended(docs, pii_base=StringType(), pii_spans=StringType(), **{f"pii_{k}": LongType() for k in KINDS}))


def redact(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in angle brackets; overlapping spans become the first one's mark."""
    where, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            clean = []
            for t, (_, every) in zip(b.column(where).to_pylist(), find(shared.value, b.column(where)), strict=True):
                parts, at = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in every):
                    if s >= at:
                        parts += [t[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                clean.append("".join([*parts, t[at:]]) if every else t)
            columns = list(b.columns)
            columns[where] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, extended(docs))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs, fit(docs))
    return found.select("doc_id", *(F.col(f"pii_{k}").alias(f"n_{k}") for k in KINDS), F.sha2("pii_base", 256).alias("base_sha256"), F.col("pii_spans").alias("spans"))
