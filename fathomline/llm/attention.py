"""A small causal self-attention model in numpy over classes of subword symbols.

Symbols fall into classes by how often the training texts use them: the most frequent ones are classes of their own,
the rest share classes of about equal use. The model reads finer kinds (``KINDS``) and predicts the coarser class
(``CLASSES``) of what comes next; what it is within its class, counts tell. One attention layer with a residual,
weights by Adam.
"""

from __future__ import annotations

import functools

import numpy as np

CLASSES, OWN = 64, 48
KINDS, OWN_KINDS = 1024, 960
WIDTH, CONTEXT, STRIDE = 16, 24, 16
#: Scores up to this size, either way, have exponentials whose sums 32 bits hold.
SAFE = 40


def classes_of(counts: np.ndarray, classes: int = CLASSES, own: int = OWN) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id, and the natural log of its probability within the class (counts plus one)."""
    order = np.argsort(-counts, kind="stable")
    own = min(own, len(counts), classes - 1)
    kind = np.empty(len(counts), np.int64)
    kind[order[:own]] = np.arange(own)
    rest = order[own:]
    mass = np.cumsum(counts[rest] + 1.0)
    kind[rest] = own + np.minimum((mass - (counts[rest] + 1.0)) / max(mass[-1], 1.0) * (classes - own), classes - own - 1).astype(np.int64) if len(rest) else 0
    total = np.bincount(kind, counts + 1.0, classes)
    return kind, np.log((counts + 1.0) / total[kind])


def initial(classes: int = CLASSES, width: int = WIDTH, context: int = CONTEXT, seed: int = 1, kinds: int = KINDS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    return {"embed": draw(kinds + 1, width), "place": draw(context, width, k=0.1), "q": draw(width, width), "k": draw(width, width), "v": draw(width, width), "out": draw(width, classes), "bias": np.zeros(classes, np.float32)}


def softened(scores: np.ndarray) -> np.ndarray:
    """Exponentials of the scores, in their place. Only where these are large is a row's largest taken from it first."""
    if scores.size and max(scores.max(), -scores.min()) > SAFE:
        scores -= scores.max(axis=-1, keepdims=True)
    return np.exp(scores, out=scores)


def row_sums(rows: np.ndarray) -> np.ndarray:
    """Sums along the last axis; as a product they take a fraction of what ``sum`` takes for short rows."""
    return (rows.reshape(-1, rows.shape[-1]) @ np.ones(rows.shape[-1], rows.dtype)).reshape(rows.shape[:-1])


@functools.cache
def sight(scored: int, size: int, kind) -> np.ndarray:
    """One where a place sees another: itself and what comes before it."""
    return (np.arange(size)[None, :] <= np.arange(size - scored, size)[:, None]).astype(kind)


def attended(q: np.ndarray, k: np.ndarray, v: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention of the last places (those of ``q`` and ``tail``), and ``tail`` with the weighed mean of ``v``."""
    scored, size = q.shape[1], k.shape[1]
    a = np.matmul(q, k.transpose(0, 2, 1))
    seen = sight(scored, size, a.dtype)
    if a.size and max(a.max(), -a.min()) > SAFE:
        a[:, seen == 0] = -np.inf
    a = softened(a)
    a *= seen
    a *= (1 / row_sums(a))[..., None]
    h = np.matmul(a, v)
    h += tail
    return a, h


def projections(w: dict) -> np.ndarray:
    """Weights of q, with the scale of the scores in it, k and v side by side."""
    return np.concatenate([w["q"] * w["q"].dtype.type(w["q"].shape[0] ** -0.5), w["k"], w["v"]], axis=1)


def read(w: dict, windows: np.ndarray) -> np.ndarray:
    n, size = windows.shape
    x = w["embed"].take(windows, axis=0)
    # long rows are added in less time
    y = x.reshape(n, -1)
    y += w["place"][:size].ravel()
    return x


def logits_of(w: dict, h: np.ndarray) -> np.ndarray:
    """Logits in rows, for ``h`` by window and place."""
    n, scored, width = h.shape
    logits = h.reshape(-1, width) @ w["out"]
    long = logits.reshape(n, -1)
    long += np.tile(w["bias"], scored)
    return logits


def forward(w: dict, windows: np.ndarray, scored: int) -> tuple:
    """Logits at the last ``scored`` places of each window of input classes."""
    n, size = windows.shape
    width = w["embed"].shape[1]
    x = read(w, windows)
    z = (x.reshape(-1, width) @ projections(w)).reshape(n, size, -1)
    q, k, v = z[:, size - scored :, :width], z[..., width : 2 * width], z[..., 2 * width :]
    a, h = attended(q, k, v, x[:, size - scored :])
    return logits_of(w, h).reshape(n, scored, -1), x, q, k, v, a, h


def log_chosen(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the softmax at each target; the logits are used up."""
    if logits.size and max(logits.max(), -logits.min()) > SAFE:
        logits -= logits.max(axis=-1, keepdims=True)
    chosen = logits.reshape(-1)[np.arange(target.size) * logits.shape[-1] + target.ravel()].reshape(target.shape)
    return chosen - np.log(row_sums(np.exp(logits, out=logits)))


def step(w: dict, windows: np.ndarray, target: np.ndarray, loss: bool = True) -> tuple[float, dict]:
    """Mean loss of the places of the windows that have a target (0 or more), if it is asked for, and its gradients."""
    n, size = windows.shape
    known = target >= 0
    target, places = np.maximum(target, 0).ravel(), max(1, int(known.sum()))
    logits, x, q, k, v, a, h = forward(w, windows, size)
    known, width = known.ravel(), x.shape[2]
    p = softened(logits.reshape(len(target), -1))
    spot = np.arange(len(target)) * p.shape[1] + target
    total, flat = row_sums(p), p.reshape(-1)
    mean = -float((np.log(np.maximum(flat[spot] / total, 1e-12)) * known).sum() / places) if loss else 0.0
    weigh = (known / np.float32(places)).astype(p.dtype)
    p *= (weigh / total)[:, None]
    flat[spot] -= weigh
    two = lambda m: m.reshape(-1, m.shape[-1])
    grad = {"out": (p.T @ two(h)).T, "bias": np.ones(len(p), p.dtype) @ p}
    dh = (p @ np.ascontiguousarray(w["out"].T)).reshape(h.shape)
    ds = np.matmul(dh, v.transpose(0, 2, 1))
    ds -= row_sums(ds * a)[..., None]
    ds *= a
    every = np.empty((n, size, 3 * width), x.dtype)
    np.matmul(ds, k, out=every[..., :width])
    np.matmul(ds.transpose(0, 2, 1), q, out=every[..., width : 2 * width])
    np.matmul(a.transpose(0, 2, 1), dh, out=every[..., 2 * width :])
    both = (two(every).T @ two(x)).T
    both[:, :width] *= x.dtype.type(width**-0.5)  # q has the scale of the scores in it
    for i, name in enumerate(("q", "k", "v")):
        grad[name] = both[:, i * width : (i + 1) * width]
    dx = (two(every) @ np.ascontiguousarray(projections(w).T)).reshape(x.shape)
    dx += dh
    grad["place"] = np.zeros_like(w["place"])
    grad["place"][:size] = (np.ones(n, x.dtype) @ dx.reshape(n, -1)).reshape(size, width)
    cells = np.arange(w["embed"].size).reshape(w["embed"].shape).take(windows, axis=0)
    grad["embed"] = np.bincount(cells.ravel(), dx.ravel(), w["embed"].size).astype(x.dtype).reshape(w["embed"].shape)
    return mean, grad


def train(w: dict, batches, rate: float, steps: int = 0, batch: int = 96, keep: int = 20_000, seed: int = 2) -> tuple[dict, int]:
    """Weights after Adam over batches of (windows, targets), each window once, and the number of windows.

    If that makes fewer than ``steps`` steps, the first ``keep`` windows go round until it is so many.
    """
    rng = np.random.default_rng(seed)
    # all weights lie in one array
    names = sorted(w)
    flat = np.concatenate([w[k].astype(np.float32).ravel() for k in names])
    into = np.cumsum([0, *(w[k].size for k in names)])
    w = {k: flat[a:b].reshape(w[k].shape) for k, a, b in zip(names, into[:-1], into[1:], strict=True)}
    # means of gradients and of their squares, ten and fifty times over; and room for sums
    m, v, g, far = (np.zeros_like(flat) for _ in range(4))
    t, held, n = 0, [], 0

    def run(windows: np.ndarray, target: np.ndarray, most: int | None = None) -> None:
        nonlocal t
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            if most is not None and t >= most:
                return
            rows = order[i : i + batch]
            _, grad = step(w, windows[rows], target[rows], loss=False)
            t += 1
            np.concatenate([grad[k].ravel() for k in names], out=g)
            np.multiply(m, np.float32(0.9), out=m)
            np.add(m, g, out=m)
            np.multiply(v, np.float32(0.98), out=v)
            np.multiply(g, g, out=g)
            np.add(v, g, out=v)
            np.multiply(v, np.float32(0.02 / (1 - 0.98**t)), out=far)
            np.sqrt(far, out=far)
            np.add(far, np.float32(1e-8), out=far)
            np.multiply(m, np.float32(0.1 * rate * min(1.0, t / 20) / (1 - 0.9**t)), out=g)
            np.divide(g, far, out=g)
            np.subtract(flat, g, out=flat)

    for windows, target in batches:
        if n < keep:
            held.append((windows[: keep - n], target[: keep - n]))
        n += len(windows)
        run(windows, target)
    if n and t < steps:
        windows, target = (np.concatenate(x) for x in zip(*held, strict=True))
        while t < steps:
            run(windows, target, steps)
    return w, n


def packed(w: dict) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def unpacked(raw: bytes, like: dict) -> dict:
    at, out = 0, {}
    for k in sorted(like):
        out[k] = np.frombuffer(raw, "<f4", like[k].size, at).reshape(like[k].shape)
        at += 4 * like[k].size
    return out


def laid(flat: np.ndarray, size: np.ndarray, context: int, stride: int, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Windows of texts laid end to end, the place of each symbol among what the windows' last places predict, and how
    many such places there are. The input at a place is what came just before it, ``start`` outside of a text."""
    n = -(-size // stride)
    lead = context - stride
    rows = np.concatenate([[0], np.cumsum(n)])
    base = rows[:-1] * stride + np.arange(len(size)) * lead
    within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inputs = np.full(rows[-1] * stride + len(size) * lead + context + 1, start, flat.dtype)
    inputs[np.repeat(base + lead + 1, size) + within] = flat
    # the last symbol of a text that fills its windows comes after them
    inputs[(base + lead + size)[size == n * stride]] = start
    first = np.arange(rows[-1]) * stride + np.repeat(np.arange(len(size)) * lead, n)
    return np.lib.stride_tricks.sliding_window_view(inputs, context)[first], np.repeat(rows[:-1] * stride, size) + within, int(rows[-1]) * stride


def windows_of(flat: np.ndarray, size: np.ndarray, context: int, stride: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    windows, place, places = laid(flat, size, context, stride, start)
    target = np.full(places, -1, np.int64)
    target[place] = flat
    return windows, target.reshape(-1, stride)


def runs_of(flat: np.ndarray, size: np.ndarray, run: int, start: int) -> np.ndarray:
    """Windows of ``run`` places that share none, each with what follows its last place, or ``start`` after a text."""
    windows, place, places = laid(flat, size, run, run, start)
    goal = np.full(places, start, flat.dtype)
    goal[place] = flat
    return np.concatenate([windows, goal[run - 1 :: run, None]], axis=1)


def log_probabilities(w: dict, flat: np.ndarray, size: np.ndarray, class_of: np.ndarray, context: int = CONTEXT, stride: int = STRIDE, batch: int = 128) -> np.ndarray:
    """For texts of kinds laid end to end, the natural log of the probability of each place's class; each place is
    scored once, in the window in whose last ``stride`` places it lies."""
    windows, place, places = laid(flat, size, context, stride, len(class_of))
    target = np.zeros(places, np.int64)
    target[place] = class_of[flat]
    target = target.reshape(-1, stride)
    # what a symbol and what a place give to q, k and v is added, so it is worked out once of each
    width, lead = w["embed"].shape[1], context - stride
    into = projections(w)
    every, own = (np.concatenate([x @ into[:, width:], x @ into[:, :width], x], axis=1) for x in (w["embed"], w["place"]))
    asking, given = np.ascontiguousarray(every[:, 2 * width :]), np.ascontiguousarray(every[:, : 2 * width])
    found = np.empty(target.shape, np.float32)
    for i in range(0, len(windows), batch):
        part = windows[i : i + batch].astype(np.int64)
        kv, qx = given.take(part, axis=0), asking.take(part[:, lead:], axis=0)
        for x, y in ((kv, own[:context, : 2 * width]), (qx, own[lead:context, 2 * width :])):
            long = x.reshape(len(part), -1)
            long += y.ravel()
        h = attended(qx[..., :width], kv[..., :width], kv[..., width:], qx[..., width:])[1]
        found[i : i + batch] = log_chosen(logits_of(w, h), target[i : i + batch].ravel()).reshape(-1, stride)
    return found.reshape(-1)[place].astype(float)
