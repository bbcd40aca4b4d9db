"""A character-level bidirectional LSTM with CRF transitions, in numpy.

The activations are softsigns, x / (1 + |x|), and gates run from 0 to 1 along the same curve: a fraction of the cost of
exponentials, which decides what whole texts cost to tag.
"""

from __future__ import annotations

import numpy as np

OTHER = 128
SYMBOLS = 131


def symbols(text: str) -> np.ndarray:
    """Character classes: ASCII as itself; other letters, digits and the rest by kind."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    for i in np.flatnonzero(codes >= OTHER):
        c = text[i]
        codes[i] = OTHER + (0 if c.isalpha() else 1 if c.isdigit() else 2)
    return codes


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """Emission scores of `tags` tags for each character of equally long windows, and transitions between tags."""

    def __init__(self, tags: int, embed: int = 12, hidden: int = 14, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        self.p = {"E": r.normal(0, 0.3, (SYMBOLS, embed)), "O": r.normal(0, 0.2, (2 * hidden, tags)), "o": np.zeros(tags), "T": np.zeros((tags, tags))}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.25, (embed + hidden, 4 * hidden))
            self.p["c" + d] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, ids: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states by time, unit and row. Gates are input, forget, output, then the candidate."""
        n, steps = ids.shape
        H, E = self.hidden, self.p["E"]
        e = E.shape[1]
        W = np.ascontiguousarray(np.concatenate((self.p["W" + d], self.p["c" + d][None])).T)
        seen = np.zeros((e + H + 1, n), E.dtype)  # the symbol, the state before it and one for the bias
        seen[-1] = 1
        E, ids = np.ascontiguousarray(E.T), np.ascontiguousarray(ids.T)
        h, c = np.zeros((H, n), E.dtype), np.zeros((H, n), E.dtype)
        out = np.zeros((steps, H, n), E.dtype)
        z, size = np.empty((4 * H, n), E.dtype), np.empty((4 * H, n), E.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            seen[:e] = E.take(ids[t], axis=1)
            seen[e : e + H] = h
            z = W @ seen if keep is not None else np.matmul(W, seen, out=z)
            np.abs(z, out=size)
            size += 1
            z /= size
            g, u = z[: 3 * H], z[3 * H :]
            g *= 0.5
            g += 0.5
            before, c0 = h, c
            c = g[H : 2 * H] * c
            c += g[:H] * u
            tc = _soft(c)
            h = np.multiply(g[2 * H :], tc, out=out[t])
            if keep is not None:
                keep.append((t, g.T, u.T, c0.T, tc.T, before.T))
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores by time, tag and row."""
        em = self.p["O"][: self.hidden].T @ self._lstm(ids, "f", None)
        em += self.p["O"][self.hidden :].T @ self._lstm(ids, "b", None)
        em += self.p["o"][:, None]
        return em

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tag sequences, and its gradients."""
        n, steps = ids.shape
        H, g = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.p["E"][ids]
        kept: dict[str, list] = {"f": [], "b": []}
        hs = np.ascontiguousarray(np.concatenate((self._lstm(ids, "f", kept["f"]), self._lstm(ids, "b", kept["b"])), axis=1).transpose(2, 0, 1))
        em = (hs @ self.p["O"] + self.p["o"]).astype(np.float64)
        T = self.p["T"].astype(np.float64)
        a, b = np.zeros_like(em), np.zeros_like(em)
        a[:, 0] = em[:, 0]
        for t in range(1, steps):
            m = a[:, t - 1, :, None] + T
            top = m.max(axis=1, keepdims=True)
            a[:, t] = em[:, t] + top[:, 0] + np.log(np.exp(m - top).sum(axis=1))
        for t in range(steps - 2, -1, -1):
            m = T + (em[:, t + 1] + b[:, t + 1])[:, None, :]
            top = m.max(axis=2, keepdims=True)
            b[:, t] = top[:, :, 0] + np.log(np.exp(m - top).sum(axis=2))
        top = a[:, -1].max(axis=1, keepdims=True)
        z = top[:, 0] + np.log(np.exp(a[:, -1] - top).sum(axis=1))
        at = np.arange(n)[:, None], np.arange(steps)[None], gold
        score = em[at].sum(axis=1) + T[gold[:, :-1], gold[:, 1:]].sum(axis=1)
        d_em = np.exp(a + b - z[:, None, None])
        d_em[at] -= 1
        d_em /= n
        pair = np.zeros_like(T)
        for t in range(1, steps):
            pair += np.exp(a[:, t - 1, :, None] + T + (em[:, t] + b[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.subtract.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g["T"] = (pair / n).astype(np.float32)
        d_em = d_em.astype(np.float32)
        g["O"] = hs.reshape(n * steps, -1).T @ d_em.reshape(n * steps, -1)
        g["o"] = d_em.sum(axis=(0, 1))
        d_hs = d_em @ self.p["O"].T
        e = x.shape[2]
        slope = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
        d_x = np.zeros_like(x)
        for d, dh_all in (("f", d_hs[:, :, :H]), ("b", d_hs[:, :, H:])):
            W = self.p["W" + d]
            dh, dc = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
            d_inner = np.zeros((n, steps, 4 * H), np.float32)
            dU = np.zeros((H, 4 * H), np.float32)
            for t, gate, u, c0, tc, before in reversed(kept[d]):
                i, f, o = gate[:, :H], gate[:, H : 2 * H], gate[:, 2 * H :]
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - np.abs(tc)) ** 2
                dz = np.concatenate((dc * u * slope(i), dc * c0 * slope(f), dh * tc * slope(o), dc * i * (1 - np.abs(u)) ** 2), axis=1)
                d_inner[:, t] = dz
                dU += before.T @ dz
                dh, dc = dz @ W[e:].T, dc * f
            flat = d_inner.reshape(n * steps, -1)
            g["W" + d] = np.concatenate((x.reshape(n * steps, e).T @ flat, dU))
            g["c" + d] = flat.sum(axis=0)
            d_x += (flat @ W[:e].T).reshape(x.shape)
        np.add.at(g["E"], ids.ravel(), d_x.reshape(n * steps, e))
        return float((z - score).mean()), g

    def fit(self, ids: np.ndarray, gold: np.ndarray, most_epochs: int = 40, batch: int = 64, rate: float = 0.02, enough: float = 0.4, seed: int = 6) -> float:
        """Adam over shuffled batches until the loss of a window settles: until three epochs in a row bring less than a
        twentieth, or it is at most `enough`; returns the last epoch's mean loss. The rate falls with each epoch that brings little."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, best, idle = 0, np.inf, 0
        for _ in range(most_epochs):
            order, losses = r.permutation(len(ids)), []
            for i in range(0, len(ids), batch):
                step += 1
                loss, g = self.gradients(ids[order[i : i + batch]], gold[order[i : i + batch]])
                losses.append(loss)
                for k in self.p:
                    grad = np.clip(g[k], -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
            idle, rate = (0, rate) if loss < 0.95 * best else (idle + 1, rate / 2)
            best = min(best, loss)
            if idle == 3 or loss <= enough:
                break
        return loss

    def hot(self, em: np.ndarray) -> np.ndarray:
        """By time and row: characters that may lie off tag 0 on a best path.

        A stretch off tag 0 pays for its way in and out, and gains at most what its characters' other tags score above tag 0
        and its transitions inside bring. A character is hot if some stretch with it could gain more than it pays: the best
        sum of a stretch that ends here and that of one that begins here tell, in one scan each way.
        """
        T = self.p["T"]
        inner = float(T[1:, 1:].max() - T[0, 0])
        pays = float(2 * T[0, 0] - T[0, 1:].max() - T[1:, 0].max()) + inner
        gain = em[:, 1:].max(axis=1) - em[:, 0] + inner
        if len(gain):  # a text may begin or end within a stretch
            gain[0] += max(0.0, float(T[0, 0] - T[0, 1:].max()))
            gain[-1] += max(0.0, float(T[0, 0] - T[1:, 0].max()))
        upto, on = gain.copy(), gain.copy()
        for t in range(1, len(gain)):
            upto[t] += np.maximum(upto[t - 1], 0)
        for t in range(len(gain) - 2, -1, -1):
            on[t] += np.maximum(on[t + 1], 0)
        return upto + on - gain > pays

    def decode(self, rows: list[np.ndarray], together: int = 256) -> list[np.ndarray]:
        """The best tag sequence of each row of emissions; rows of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        T = self.p["T"]
        for s in range(0, len(order), together):
            some = order[s : s + together]
            steps = len(rows[some[-1]])
            em = np.full((len(some), steps, self.tags), -1e4, np.float32)
            em[:, :, 0] = 0  # beyond its end a row stays at tag 0
            for k, i in enumerate(some):
                em[k, : len(rows[i])] = rows[i]
            score, back = em[:, 0], np.zeros((steps, len(some), self.tags), np.int8)
            for t in range(1, steps):
                m = score[:, :, None] + T
                back[t] = m.argmax(axis=1)
                score = m.max(axis=1) + em[:, t]
            at, path = score.argmax(axis=1), np.zeros((steps, len(some)), np.int64)
            each = np.arange(len(some))
            path[-1] = at
            for t in range(steps - 1, 0, -1):
                at = back[t, each, at]
                path[t - 1] = at
            for k, i in enumerate(some):
                out[i] = path[: len(rows[i]), k]
        return out
