"""A character-level bidirectional LSTM with CRF transitions in numpy: training from labelled spans, and decoding."""

from __future__ import annotations

import functools

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SINGLE = "@.-+()_% \n:/=\",'#"
PAD, LOWER, HEX, UPPER, DIGIT, BEYOND, OTHER = range(7)
CLASSES = 7 + len(SINGLE)
CODES = np.full(129, OTHER, np.int8)
CODES[97:123], CODES[97:103], CODES[65:91], CODES[48:58], CODES[128] = LOWER, HEX, UPPER, DIGIT, BEYOND
for _k, _c in enumerate(SINGLE):
    CODES[ord(_c)] = 7 + _k


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    return CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def sample(random: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A labelled text: words, decoys and at most a few spans (kind, start, end), in many written forms."""
    pick = lambda *x: x[random.integers(len(x))]
    digits = lambda n: "".join(map(str, random.integers(0, 10, n)))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(of[k] for k in random.integers(0, len(of), n))
    word = lambda: pick(letters(random.integers(1, 10)), letters(random.integers(1, 9)) + pick(",", ".", "!!", "###", "$$$", "é", "ß"), letters(3).upper(), letters(5, "éèàüößñabcde"))

    def email() -> str:
        local = pick(letters(6), f"{letters(4)}.{digits(2)}", f"{letters(3)}_{letters(4)}+{digits(1)}", letters(5, "éüabcß"))
        return f"{local}@{pick(letters(6), f'mail{digits(1)}.{letters(7)}', f'{letters(3)}-{letters(3)}')}{pick('.com', '.org', '.co.uk', '.net')}"

    octet = lambda: str(random.integers(0, 256))
    make = (
        email,
        lambda: ".".join(octet() for _ in range(4)),
        lambda: pick("", " ", "-", ".", "/").join(digits(4) for _ in range(4)),
        lambda: pick("+", "", "00") + pick(f"{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(2)} {digits(3)} {digits(4)} {digits(2)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}/{digits(3)}-{digits(4)}"),
    )
    decoy = lambda: pick(digits(random.integers(1, 6)), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f'token = "{letters(40, "0123456789abcdef")}"', f"v{digits(1)}.{digits(1)}.{digits(2)}", f"@{letters(5)}", f"{letters(2)}{digits(3)}", f"http://{letters(5)}.com/{digits(4)}", letters(20, "0123456789abcdef"))
    text, spans = "", []
    while len(text) < 60:
        roll = random.random()
        if roll < 0.14:
            kind = int(random.integers(len(KINDS)))
            text += pick("", "", "(", '"', ":")
            item = make[kind]()
            spans.append((kind, len(text), len(text) + len(item)))
            text += item + pick("", "", ".", ",", ")", "***", "!!")
        else:
            text += decoy() if roll < 0.3 else word()
        text += pick(" ", " ", " ", "\n", " - ")
    return text, spans


def labelled(random: np.random.Generator, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags [length, n] of n samples, each cut at a random place so that spans meet edges too."""
    x, y = np.zeros((length, n), np.int64), np.zeros((length, n), np.int64)
    for k in range(n):
        text, spans = sample(random)
        at = int(random.integers(0, max(1, len(text) - length + 1)))
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 * kind + 2
            tags[a] = 2 * kind + 1
        part = classes(text)[at : at + length]
        x[: len(part), k], y[: len(part), k] = part, tags[at : at + length]
    return x, y


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [T, B, H] over classes x [T, B]; table holds each class's share of the gates (input, forget, output, new)."""
    width = u.shape[0]
    h = c = np.zeros((x.shape[1], width), np.float32)
    out = np.empty((*x.shape, width), np.float32)
    for t in range(len(x)):
        gates = table[x[t]] + h @ u
        gates[:, : 3 * width] = sigmoid(gates[:, : 3 * width])
        gates[:, 3 * width :] = np.tanh(gates[:, 3 * width :])
        before, past = c, h
        c = gates[:, width : 2 * width] * c + gates[:, :width] * gates[:, 3 * width :]
        squashed = np.tanh(c)
        h = out[t] = gates[:, 2 * width : 3 * width] * squashed
        if keep is not None:
            keep.append((gates, before, past, squashed))
    return out


def lstm_gradient(x: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u."""
    width = u.shape[0]
    dtable, du = np.zeros((CLASSES, 4 * width), np.float32), np.zeros_like(u)
    dh = dc = np.zeros(dout.shape[1:], np.float32)
    for t in range(len(x) - 1, -1, -1):
        gates, before, past, squashed = kept[t]
        i, f, o, n = (gates[:, k * width : (k + 1) * width] for k in range(4))
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - squashed**2)
        dg = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - n**2)], 1)
        np.add.at(dtable, x[t], dg)
        du += past.T @ dg
        dc, dh = dc * f, dg @ u.T
    return dtable, du


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the tags y [T, B] under emissions e [T, B, K], and its gradients."""
    length, n, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, length):
        alpha[t] = e[t] + log_sum(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(length - 2, -1, -1):
        beta[t] = log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = log_sum(alpha[-1], 1)
    rows = np.arange(n)
    gold = sum(e[t, rows, y[t]] for t in range(length)) + sum(trans[y[t - 1], y[t]] for t in range(1, length))
    de = np.exp(alpha + beta - z[None, :, None])
    dtrans = np.zeros_like(trans)
    for t in range(1, length):
        dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(dtrans, (y[t - 1], y[t]), -1)
    for t in range(length):
        de[t, rows, y[t]] -= 1
    return float((z - gold).mean()), de / n, dtrans / n


def barred() -> np.ndarray:
    """Added to transitions: an inside tag follows only its kind's begin or inside."""
    bar = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        bar[:, 2 * kind + 2] = -1e4
        bar[[2 * kind + 1, 2 * kind + 2], 2 * kind + 2] = 0
    return bar


@functools.lru_cache(1)
def train(seed: int = 5, width: int = 16, steps: int = 350, batch: int = 48, length: int = 64, rate: float = 0.02) -> dict[str, np.ndarray]:
    """The model's arrays, by Adam over generated samples."""
    random = np.random.default_rng(seed)
    init = lambda *shape: (random.standard_normal(shape) * 0.25).astype(np.float32)
    model = {"table_f": init(CLASSES, 4 * width), "u_f": init(width, 4 * width), "table_b": init(CLASSES, 4 * width), "u_b": init(width, 4 * width), "out": init(2 * width, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    m, v = ({k: np.zeros_like(w) for k, w in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = labelled(random, batch, length)
        kept_f, kept_b = [], []
        h = np.concatenate([lstm(x, model["table_f"], model["u_f"], kept_f), lstm(x[::-1], model["table_b"], model["u_b"], kept_b)[::-1]], 2)
        _, de, dtrans = crf_gradient(h @ model["out"] + model["bias"], y, model["trans"] + barred())
        dh = de @ model["out"].T
        gradient = {"out": np.einsum("tbh,tbk->hk", h, de), "bias": de.sum((0, 1)), "trans": dtrans}
        gradient["table_f"], gradient["u_f"] = lstm_gradient(x, model["u_f"], kept_f, dh[:, :, :width])
        gradient["table_b"], gradient["u_b"] = lstm_gradient(x[::-1], model["u_b"], kept_b, dh[::-1, :, width:])
        scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((g**2).sum() for g in gradient.values())))))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in gradient.items():
            g = g * scale
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model[k] = (model[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def decode(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The best tags [T, B] of windows x [T, B], by Viterbi's algorithm."""
    h = np.concatenate([lstm(x, model["table_f"], model["u_f"]), lstm(x[::-1], model["table_b"], model["u_b"])[::-1]], 2)
    e, trans = h @ model["out"] + model["bias"], (model["trans"] + barred()).T[None]
    best, back = e[0], np.empty(e.shape, np.int8)
    for t in range(1, len(e)):
        paths = best[:, None, :] + trans
        back[t] = paths.argmax(2)
        best = e[t] + paths.max(2)
    tags = np.empty(x.shape, np.int8)
    tags[-1] = best.argmax(1)
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = np.take_along_axis(back[t], tags[t][:, None].astype(np.int64), 1)[:, 0]
    return tags
