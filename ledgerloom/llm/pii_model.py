"""Character BiLSTM with CRF transitions in numpy: training and inference.

Figures are folded to one class before the lookup, so the tags of a text are a
function of its shape; that is what lets the operator decode each distinct
shape of a batch once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .pii_grammar import KINDS, Lines

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Characters with an entry of their own; any other is looked up by its base letter, else as 1.
ALPHABET = "\0\1" + " !\"#$%&'()*+,-./9:;<=>?@[]_|{}~ªº°" + "abcdefghijklmnopqrstuvwxyzáâãàçéêíóôõúü" + "ABCDEFGHIJKLMNOPQRSTUVWXYZÁÂÃÀÇÉÊÍÓÔÕÚÜ"
FLAT = -1e4
#: Texts that are read together, and rows of a step's arrays.
BLOCK, STEP = 4096, 384
DIGITS = bytes.maketrans(b"012345678", b"9" * 9)

_CODE = np.ones(0x110000, dtype=np.uint8)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k
for _c in "012345678":
    _CODE[ord(_c)] = _CODE[ord("9")]
for _c in range(0xA0, 0x250):
    if _CODE[_c] == 1 and (_b := unicodedata.normalize("NFKD", chr(_c))[0]) in ALPHABET:
        _CODE[_c] = _CODE[ord(_b)]
for _c in "\t\r\n ":
    _CODE[ord(_c)] = _CODE[ord(" ")]


def codes(text: str) -> np.ndarray:
    """Vocabulary numbers of a text's code points; lone surrogates count as unknown."""
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def folded(text: str) -> str:
    """The text with each figure as 9; UTF-8 has no byte of a figure within other characters."""
    return text.encode("utf-8", "surrogatepass").translate(DIGITS).decode("utf-8", "surrogatepass")


def legal() -> np.ndarray:
    """FLAT where a tag may not follow another: I-x only after B-x or I-x."""
    m = np.zeros((len(TAGS), len(TAGS)), dtype=np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, u in enumerate(TAGS):
                if u[2:] != t[2:] or u == "O":
                    m[i, j] = FLAT
    return m


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def tanh(x: np.ndarray, out: np.ndarray) -> None:
    np.tanh(x, out=out)


class Tagger:
    """Parameters: E embeddings, Wf/Uf/bf and Wb/Ub/bb the two directions, V/c the tag scores, A transitions, s/e ends."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.h = p["Uf"].shape[0]

    @classmethod
    def new(cls, seed: int = 7, emb: int = 24, h: int = 40) -> "Tagger":
        g = np.random.default_rng(seed)
        f = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"E": g.standard_normal((len(ALPHABET), emb)).astype(np.float32) * 0.3}
        for d in "fb":
            p |= {f"W{d}": f(emb, 4 * h), f"U{d}": f(h, 4 * h), f"b{d}": np.zeros(4 * h, np.float32)}
            p[f"b{d}"][h : 2 * h] = 1
        n = len(TAGS)
        p |= {"V": f(2 * h, n), "c": np.zeros(n, np.float32), "A": np.zeros((n, n), np.float32), "s": np.zeros(n, np.float32), "e": np.zeros(n, np.float32)}
        return cls(p)

    @classmethod
    def load(cls, path) -> "Tagger":
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    # inference ------------------------------------------------------------
    def _scores(self, coded: list[np.ndarray], d: str) -> tuple[np.ndarray, np.ndarray]:
        """Tag scores of one direction for each state, and the state of each character, text after text.

        A state depends on what was read so far alone, so texts are sorted and a
        beginning (for b an end) that several share is read once.  sigmoid(z) =
        (1 + tanh(z / 2)) / 2, so the gates' weights are halved and one tanh serves
        all; the last halves are taken from the cell at each step and from the
        weights that read the state.  Every array of a step is written in place, and
        each gate's rows lie together.
        """
        p, h = self.p, self.h
        half = np.r_[np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)]
        table = (p["E"] @ p[f"W{d}"] + p[f"b{d}"]) * half
        U, V = p[f"U{d}"] * half * np.float32(0.5), (p["V"][:h] if d == "f" else p["V"][h:]) * np.float32(0.5)
        table, U = (np.ascontiguousarray(x.reshape(-1, 4, h).swapaxes(0, 1)) for x in (table, U))
        size = np.array([len(c) for c in coded])
        begin = np.cumsum(size) - size
        keys = [c.tobytes() for c in coded] if d == "f" else [c[::-1].tobytes() for c in coded]
        order = np.array(sorted(range(len(coded)), key=keys.__getitem__))
        where, scores, base = np.empty(size.sum(), np.intp), [], 0
        Z, G, Q = np.empty((STEP, 4 * h), np.float32), np.empty((STEP, 4 * h), np.float32), np.empty((STEP, h), np.float32)
        for k in range(0, len(order), BLOCK):
            part = order[k : k + BLOCK]
            n = size[part]
            x = np.full((len(part), n.max() + 1), 255, np.uint8)  # 0 is a character too
            x[np.arange(n.max() + 1) < n[:, None]] = np.frombuffer(b"".join([keys[i] for i in part]), np.uint8)
            same = np.r_[0, (x[1:] != x[:-1]).argmax(1)]  # characters that a text shares with the one before it
            same[1:][(x[1:] == x[:-1]).all(1)] = n.max()
            xt, at = np.ascontiguousarray(x.T[:-1]), np.arange(n.max())[:, None]
            new = (at >= same) & (at < n)
            state = np.cumsum(new, axis=1) - 1
            H, C = np.zeros((1, h), np.float32), np.zeros((1, h), np.float32)
            for t in range(len(xt)):
                rows = new[t].nonzero()[0]
                H0, H = H, np.empty((len(rows), h), np.float32)
                C0, C = C, np.empty((len(rows), h), np.float32)
                before, codes = state[t - 1].take(rows) if t else np.zeros(len(rows), np.intp), xt[t].take(rows)
                for i in range(0, len(rows), STEP):
                    j = min(i + STEP, len(rows))
                    z, g, q, c, y = Z[: j - i], G[: j - i], Q[: j - i], C[i:j], H[i:j]
                    gates = z.reshape(4, j - i, h)
                    H0.take(before[i:j], axis=0, out=q, mode="clip")
                    np.matmul(q, U, out=gates)
                    table.take(codes[i:j], axis=1, out=g.reshape(4, j - i, h), mode="clip")
                    z += g
                    tanh(z, z)
                    C0.take(before[i:j], axis=0, out=c, mode="clip")
                    np.multiply(gates[1], c, out=q)
                    c += q
                    np.multiply(gates[0], gates[3], out=q)
                    c += q
                    c += gates[3]
                    c *= 0.5
                    tanh(c, q)
                    np.multiply(gates[2], q, out=y)
                    y += q
                scores.append(H @ V)
            state += base + np.cumsum([0, *map(len, scores[-len(xt) : -1])])[:, None]
            base += sum(map(len, scores[-len(xt) :]))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where[np.repeat(begin[part], n) + at if d == "f" else np.repeat(begin[part] + n - 1, n) - at] = state[at, np.repeat(np.arange(len(part)), n)]
        return np.concatenate(scores), where

    def emissions(self, coded: list[np.ndarray]) -> list[np.ndarray]:
        """Tag scores (characters, tags) of each text's codes; no text is empty."""
        if not coded:
            return []
        (f, i), (b, j) = self._scores(coded, "f"), self._scores(coded, "b")
        f += self.p["c"]
        y = f.take(i, axis=0)
        y += b.take(j, axis=0)
        end = np.cumsum([len(c) for c in coded]).tolist()
        return [y[s:e] for s, e in zip([0, *end], end)]

    def viterbi(self, em: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Best tags (T, B) of scores em (T, B, tags) over the first n[b] positions; n ascends.

        Texts are on the last axis, so that sums and maxima run over long rows.  The
        forward pass keeps scores only; the way back looks up one predecessor a text
        and step.
        """
        T, B, K = em.shape
        A = self.p["A"] + legal()  # [from, to]
        v = em.transpose(0, 2, 1).copy()
        v[0] += (self.p["s"] + np.where([t[0] == "I" for t in TAGS], FLAT, 0).astype(np.float32))[:, None]
        w = np.empty((K, K, B), np.float32)
        first = np.searchsorted(n, np.arange(T), side="right")  # texts from here on are longer than t
        for t in range(1, T):
            k = first[t]
            np.add(v[t - 1, :, None, k:], A[:, :, None], out=w[:, :, k:])
            v[t, :, k:] += np.max(w[:, :, k:], axis=0)
        out = np.zeros((T, B), np.uint8)
        tag = np.zeros(B, np.intp)
        for t in range(T - 1, -1, -1):
            k = first[t]
            last = np.searchsorted(n, t + 1, side="right")  # texts k to last - 1 end here
            if last > k:
                tag[k:last] = (v[t, :, k:last] + self.p["e"][:, None]).argmax(0)
            if last < B:
                tag[last:] = (v[t, :, last:] + A.take(tag[last:], axis=1)).argmax(0)
            out[t, k:] = tag[k:]
        return out

    # training -------------------------------------------------------------
    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean CRF loss per text and its gradients; x, y (B, T), 0 pads x at the right."""
        p, h = self.p, self.h
        B, T = x.shape
        K = len(TAGS)
        n = (x > 0).sum(1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        xt, live = x.T, (x.T > 0).astype(np.float32)
        tape, hs = {}, {}
        for d in "fb":
            table = p["E"] @ p[f"W{d}"] + p[f"b{d}"]
            U = p[f"U{d}"]
            H, C = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
            hs[d] = np.empty((T, B, h), np.float32)
            tape[d] = []
            for t in range(T) if d == "f" else range(T - 1, -1, -1):
                z = H @ U + table[xt[t]]
                s = sigmoid(z[:, : 3 * h].copy())
                q = np.tanh(z[:, 3 * h :])
                C0, H0 = C, H
                C = C0 * s[:, h : 2 * h] + s[:, :h] * q
                tc = np.tanh(C)
                H = s[:, 2 * h :] * tc
                if d == "b":
                    C = C * live[t][:, None]
                    H = H * live[t][:, None]
                tape[d].append((t, s, q, C0, H0, tc))
                hs[d][t] = H
        em = (hs["f"] @ p["V"][:h] + hs["b"] @ p["V"][h:] + p["c"]).transpose(1, 0, 2).astype(np.float64)
        A = (p["A"] + legal()).astype(np.float64)
        start = p["s"] + np.where([t[0] == "I" for t in TAGS], FLAT, 0)
        lse = lambda a, ax: (m := a.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(a - m).sum(ax))
        al = np.empty((T, B, K))
        al[0] = em[:, 0] + start
        eA = np.exp(A)
        for t in range(1, T):
            m = al[t - 1].max(1, keepdims=True)
            step = m + np.log(np.exp(al[t - 1] - m) @ eA + 1e-300) + em[:, t]
            al[t] = np.where((t < n)[:, None], step, al[t - 1])
        Z = lse(al[-1] + p["e"], 1)
        be = np.empty((T, B, K))
        be[-1] = p["e"]
        for t in range(T - 2, -1, -1):
            w = be[t + 1] + em[:, t + 1]
            m = w.max(1, keepdims=True)
            step = m + np.log(np.exp(w - m) @ eA.T + 1e-300)
            be[t] = np.where((t + 1 < n)[:, None], step, np.broadcast_to(p["e"], (B, K)))
        on = (np.arange(T)[:, None] < n[None]).astype(np.float64)
        post = np.exp(np.minimum(al + be - Z[None, :, None], 0)) * on[..., None]
        rows = np.arange(B)
        gold = (em[rows[:, None], np.arange(T)[None], y] * on.T).sum(1) + start[y[:, 0]] + p["e"][y[rows, n - 1]]
        gA = np.zeros((K, K))
        for t in range(1, T):
            k = on[t]
            a, b = al[t - 1] - Z[:, None], be[t] + em[:, t]
            ma, mb = a.max(1, keepdims=True), b.max(1, keepdims=True)
            gA += (np.exp(a - ma) * (np.exp(np.minimum(ma + mb, 60)) * k[:, None])).T @ np.exp(b - mb) * eA
            gold += A[y[:, t - 1], y[:, t]] * k
            np.add.at(gA, (y[:, t - 1], y[:, t]), -k)
        demit = post.transpose(1, 0, 2).copy()
        demit[rows[:, None], np.arange(T)[None], y] -= on.T
        demit /= B
        g["A"] = (gA / B).astype(np.float32)
        g["s"] = demit[:, 0].sum(0).astype(np.float32)
        last = np.exp(al[-1] + p["e"] - Z[:, None])
        last[rows, y[rows, n - 1]] -= 1
        g["e"] = (last.sum(0) / B).astype(np.float32)
        de = demit.transpose(1, 0, 2).astype(np.float32)
        g["c"] = de.sum((0, 1))
        g["V"][:h] = hs["f"].reshape(-1, h).T @ de.reshape(-1, K)
        g["V"][h:] = hs["b"].reshape(-1, h).T @ de.reshape(-1, K)
        for d in "fb":
            V = p["V"][:h] if d == "f" else p["V"][h:]
            U = p[f"U{d}"]
            dH, dC = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
            dz_all = np.empty((T, B, 4 * h), np.float32)
            for t, s, q, C0, H0, tc in reversed(tape[d]):
                dh = de[t] @ V.T + dH
                if d == "b":
                    dh *= live[t][:, None]
                    dC *= live[t][:, None]
                i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
                dc = dC + dh * o * (1 - tc * tc)
                dz = dz_all[t]
                dz[:, :h] = dc * q * i * (1 - i)
                dz[:, h : 2 * h] = dc * C0 * f * (1 - f)
                dz[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
                dz[:, 3 * h :] = dc * i * (1 - q * q)
                g[f"U{d}"] += H0.T @ dz
                dH = dz @ U.T
                dC = dc * f
            flat = dz_all.reshape(-1, 4 * h)
            dtab = np.zeros((len(ALPHABET), 4 * h), np.float32)
            order = np.argsort(xt.ravel(), kind="stable")
            ids = xt.ravel()[order]
            cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            dtab[ids[cut]] = np.add.reduceat(flat[order], cut, axis=0)
            g[f"W{d}"] = p["E"].T @ dtab
            g[f"b{d}"] = dtab.sum(0)
            g["E"] += dtab @ p[f"W{d}"].T
        return float((Z - gold).mean()), g


def encode(lines: list[tuple[str, list]], width: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(lines), width), np.uint8), np.zeros((len(lines), width), np.int64)
    for b, (text, spans) in enumerate(lines):
        c = codes(text)[:width]
        x[b, : len(c)] = c
        for s, e, k in spans:
            if s < width:
                y[b, s] = TAGS.index(f"B-{k}")
                y[b, s + 1 : min(e, width)] = TAGS.index(f"I-{k}")
    return x, y


def train(path, steps: int = 4000, batch: int = 96, width: int = 128, seed: int = 11, rate: float = 4e-3, minutes: float = 1e9, start: str | None = None, say=print) -> "Tagger":
    """Fit on lines of the grammar with Adam and save to ``path``; the learning rate falls to 0 over ``steps``; ``start`` names weights to go on from."""
    import time

    m = Tagger.load(start) if start else Tagger.new()
    source, began = Lines(seed), time.time()
    mo = {k: np.zeros_like(v) for k, v in m.p.items()}
    ve = {k: np.zeros_like(v) for k, v in m.p.items()}
    for it in range(1, steps + 1):
        lines = []
        while len(lines) < batch:
            text, spans = source.line()
            if not text:
                continue
            if len(text) > width:  # a window from anywhere in a long text; spans it cuts go on as far as the window
                a = source.r.randrange(len(text) - width + 1)
                inside = [(max(s - a, 0), e - a, k) for s, e, k in spans if e > a and s < a + width]
                text, spans = text[a : a + width], inside
            lines.append((text, spans))
        lines.sort(key=lambda x: len(x[0]))
        w = max(len(t) for t, _ in lines)
        x, y = encode(lines, w)
        loss, g = m.loss(x, y)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        frac = max(it / steps, (time.time() - began) / (minutes * 60))
        lr = rate * min(1, it / 100) * max(0.02, 1 - frac)
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            mo[k] = 0.9 * mo[k] + 0.1 * v
            ve[k] = 0.999 * ve[k] + 0.001 * v * v
            m.p[k] -= lr * (mo[k] / (1 - 0.9**it)) / (np.sqrt(ve[k] / (1 - 0.999**it)) + 1e-8)
        if it % 100 == 0:
            say(it, round(loss, 4), round(norm, 3), round(time.time() - began), flush=True)
        if frac >= 1:
            break
    np.savez_compressed(path, **{k: v.astype(np.float16 if v.ndim > 1 and k != "A" else np.float32) for k, v in m.p.items()})
    return m


if __name__ == "__main__":
    import sys

    train(sys.argv[1], steps=int(sys.argv[2]), minutes=float(sys.argv[3]), **({"start": sys.argv[4], "seed": 12, "rate": 2e-3} if len(sys.argv) > 4 else {}))
