"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import io
import unicodedata

import numpy as np

from velum.llm.lookalikes import _FROM, _TO

KINDS = ("PERSONA", "EMAIL", "TELEFONO", "CODICE_FISCALE", "PARTITA_IVA", "IBAN", "NUMERO_DOCUMENTO", "INDIRIZZO")
#: Labels: 0 outside, 2k+1 first character of a datum of kind k, 2k+2 a further one.
LABELS = 1 + 2 * len(KINDS)
#: Windows: characters of one, and characters that neighbours share.
WINDOW, SHARED = 128, 32
EMBED, HIDDEN = 24, 64

_PLAIN = dict(zip(_FROM, _TO, strict=True))
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?'\"()[]{}<>/\\-_@#&%+*=|«»“”°§€ \n"
_INDEX = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_EXTRA = len(_ALPHABET) + 1
#: Classes after the alphabet: digits 0, 3 and others; lower, upper and other letters of other scripts; invisible; rest.
VOCABULARY = _EXTRA + 9
_codes: dict[str, int] = {}


def code(ch: str) -> int:
    """Class of a character; look-alikes and accented letters count as the plain letter."""
    c = _codes.get(ch)
    if c is None:
        plain = _PLAIN.get(ch, ch)
        base = unicodedata.normalize("NFD", plain)[0]
        if plain.isdigit():
            d = unicodedata.digit(plain, 5)
            c = _EXTRA + (0 if d == 0 else 1 if d == 3 else 2)
        elif plain in "\r\t\f\v  \x85" or plain.isspace():
            c = _INDEX["\n"] if plain in "\r  \x85" else _INDEX[" "]
        elif base in _INDEX:
            c = _INDEX[base]
        elif plain == "’":
            c = _INDEX["'"]
        elif plain in "–—‑":
            c = _INDEX["-"]
        elif plain.islower():
            c = _EXTRA + 3
        elif plain.isupper():
            c = _EXTRA + 4
        elif plain.isalpha():
            c = _EXTRA + 5
        elif unicodedata.category(ch) in ("Cf", "Mn"):
            c = _EXTRA + 6
        else:
            c = _EXTRA + 7
        if len(_codes) < 100_000:
            _codes[ch] = c
    return c


def codes(text: str) -> np.ndarray:
    return np.fromiter(map(code, text), np.int32, len(text))


SHAPES = {
    "embed": (VOCABULARY, EMBED),
    **{f"{d}_{n}": s for d in ("f", "b") for n, s in (("x", (EMBED, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)), ("bias", (4 * HIDDEN,)))},
    "out": (2 * HIDDEN, LABELS), "out_bias": (LABELS,), "move": (LABELS, LABELS), "begin": (LABELS,),
}


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for k, s in SHAPES.items()}
    for d in "fb":
        p[f"{d}_bias"][HIDDEN : 2 * HIDDEN] = 1  # gates that keep, at first
    p["move"] *= 0.1
    return p


def dump(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in p.items()})
    return out.getvalue()


def read(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _pass(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, B, H) of one direction over codes x (T, B); the backward one runs from the end."""
    steps, size = x.shape
    table = p["embed"] @ p[f"{d}_x"] + p[f"{d}_bias"]
    wh = p[f"{d}_h"]
    h = np.zeros((size, HIDDEN), np.float32)
    c = np.zeros((size, HIDDEN), np.float32)
    hs = np.empty((steps, size, HIDDEN), np.float32)
    saved: list = [None] * steps if keep else []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = table[x[t]]
        z += h @ wh
        g = np.tanh(z[:, 3 * HIDDEN :])
        s = z[:, : 3 * HIDDEN]
        s *= 0.5
        np.tanh(s, out=s)
        s *= 0.5
        s += 0.5
        before, h0 = c, h
        c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
        tc = np.tanh(c)
        h = s[:, 2 * HIDDEN :] * tc
        hs[t] = h
        if keep:
            saved[t] = (s, g, before, tc, h0)
    return hs, saved


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Label scores (T, B, L) of windows of codes x (T, B)."""
    f, _ = _pass(p, "f", x, False)
    b, _ = _pass(p, "b", x, False)
    return f @ p["out"][:HIDDEN] + b @ p["out"][HIDDEN:] + p["out_bias"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean negative log-likelihood a character, gradients) of codes x and labels y, both (T, B)."""
    steps, size = x.shape
    f, kept_f = _pass(p, "f", x, True)
    b, kept_b = _pass(p, "b", x, True)
    e = f @ p["out"][:HIDDEN] + b @ p["out"][HIDDEN:] + p["out_bias"]
    move = p["move"]
    alpha = np.empty_like(e)
    beta = np.zeros_like(e)
    alpha[0] = e[0] + p["begin"]
    for t in range(1, steps):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + move[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(move[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    post = np.exp(alpha + beta - z[None, :, None])
    grid = np.arange(size)
    gold = e[np.arange(steps)[:, None], grid, y].sum(0) + p["begin"][y[0]] + move[y[:-1], y[1:]].sum(0)
    n = steps * size
    g = {k: np.zeros_like(v) for k, v in p.items()}
    for t in range(steps - 1):
        joint = np.exp(alpha[t][:, :, None] + move[None] + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None])
        g["move"] += joint.sum(0)
    np.add.at(g["move"], (y[:-1].ravel(), y[1:].ravel()), -1)
    de = post
    de[np.arange(steps)[:, None], grid, y] -= 1
    g["begin"] = de[0].sum(0)
    g["move"] /= n
    g["begin"] /= n
    de /= n
    flat = de.reshape(-1, LABELS)
    g["out_bias"] = flat.sum(0)
    g["out"][:HIDDEN] = f.reshape(-1, HIDDEN).T @ flat
    g["out"][HIDDEN:] = b.reshape(-1, HIDDEN).T @ flat
    for d, kept, part in (("f", kept_f, p["out"][:HIDDEN]), ("b", kept_b, p["out"][HIDDEN:])):
        dh_out = de @ part.T
        dz = np.empty((steps, size, 4 * HIDDEN), np.float32)
        dh = np.zeros((size, HIDDEN), np.float32)
        dc = np.zeros((size, HIDDEN), np.float32)
        h0s = np.empty((steps, size, HIDDEN), np.float32)
        whT = p[f"{d}_h"].T.copy()
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            s, gg, before, tc, h0 = kept[t]
            i, fg, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t, :, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            dz[t, :, :HIDDEN] = dc * gg * i * (1 - i)
            dz[t, :, HIDDEN : 2 * HIDDEN] = dc * before * fg * (1 - fg)
            dz[t, :, 3 * HIDDEN :] = dc * i * (1 - gg * gg)
            h0s[t] = h0
            dc = dc * fg
            dh = dz[t] @ whT
        flat_z = dz.reshape(-1, 4 * HIDDEN)
        g[f"{d}_h"] = h0s.reshape(-1, HIDDEN).T @ flat_z
        g[f"{d}_bias"] = flat_z.sum(0)
        table = np.zeros((VOCABULARY, 4 * HIDDEN), np.float32)
        order = np.argsort(x.ravel(), kind="stable")
        keys = x.ravel()[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        table[keys[starts]] = np.add.reduceat(flat_z[order], starts, axis=0)
        g[f"{d}_x"] = p["embed"].T @ table
        g["embed"] += table @ p[f"{d}_x"].T
    return float((z - gold).sum() / n), g


def _moves(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(move, begin) under which a further character follows only one of its kind."""
    move = p["move"].copy()
    begin = p["begin"].copy()
    for k in range(len(KINDS)):
        inner = 2 * k + 2
        ok = np.zeros(LABELS, bool)
        ok[[inner - 1, inner]] = True
        move[~ok, inner] = -1e4
        begin[inner] = -1e4
    return move, begin


def viterbi(p: dict[str, np.ndarray], es: list[np.ndarray]) -> list[np.ndarray]:
    """Best labels of each text's scores (T, L), decoded side by side, one step for all of them; a further character
    follows only one of its kind."""
    es, all_ = [e for e in es if len(e)], es
    if not es:
        return [np.zeros(0, np.int8) for _ in all_]
    move, begin = _moves(p)
    order = sorted(range(len(es)), key=lambda k: -len(es[k]))
    sizes = np.array([len(es[k]) for k in order])
    flat = np.concatenate([es[k] for k in order])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    best = flat[starts] + begin
    back = np.empty((len(flat), LABELS), np.int8)
    across = np.ascontiguousarray(move.T)
    for t in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, "left"))  # the stretches longer than t come first
        s = best[:n, None, :] + across
        at = s.argmax(2)
        back[starts[:n] + t] = at
        best[:n] = np.take_along_axis(s, at[:, :, None], 2)[:, :, 0] + flat[starts[:n] + t]
    labels = np.empty(len(flat), np.int8)
    label = best.argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, "left"))
        labels[starts[:n] + t] = label[:n]
        if t:
            label[:n] = back[starts[:n] + t, label[:n]]
    out: list[np.ndarray] = [labels[:0]] * len(es)
    for k, s, size in zip(order, starts, sizes, strict=True):
        out[k] = labels[s : s + size]
    rest = iter(out)
    return [next(rest) if len(e) else labels[:0] for e in all_]


def scores(p: dict[str, np.ndarray], texts: list[str], batch: int = 384) -> list[np.ndarray]:
    """Scores (T, L) of every text: windows are scored in batches and averaged where they share characters, by distance from their ends."""
    xs = [codes(t) for t in texts]
    out = [np.zeros((len(x), LABELS), np.float32) for x in xs]
    weight = [np.zeros((len(x), 1), np.float32) for x in xs]
    places = [(k, s) for k, x in enumerate(xs) for s in range(0, max(1, len(x) - SHARED), WINDOW - SHARED) if len(x)]
    places.sort(key=lambda w: -min(WINDOW, len(xs[w[0]]) - w[1]))  # windows of like length together
    ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).clip(max=SHARED).astype(np.float32)[:, None]
    for i in range(0, len(places), batch):
        part = places[i : i + batch]
        steps = min(WINDOW, max(len(xs[k]) - s for k, s in part))
        x = np.zeros((steps, len(part)), np.int32)
        for j, (k, s) in enumerate(part):
            piece = xs[k][s : s + steps]
            x[: len(piece), j] = piece
        e = emissions(p, x)
        for j, (k, s) in enumerate(part):
            n = min(steps, len(xs[k]) - s)
            out[k][s : s + n] += e[:n, j] * ramp[:n]
            weight[k][s : s + n] += ramp[:n]
    return [o / np.maximum(w, 1) for o, w in zip(out, weight, strict=True)]


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the data in a text's labels."""
    marked = np.flatnonzero(labels)
    out: list[list[int]] = []
    for t in marked.tolist():
        label = int(labels[t])
        if label % 2 or not out or out[-1][1] != t:
            out.append([t, t + 1, (label - 1) // 2])
        else:
            out[-1][1] = t + 1
    return [tuple(s) for s in out]  # type: ignore[misc]


def tag(p: dict[str, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of the data in every text, decoded over the whole text at once."""
    return [spans(labels) for labels in viterbi(p, scores(p, texts))]
