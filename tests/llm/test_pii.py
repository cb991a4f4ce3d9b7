from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import pii, pii_model
from ledgerloom.llm.pii import OVERLAP, WINDOW, Finder, find_personal, replace_personal
from ledgerloom.llm.pii_grammar import KINDS, Lines
from ledgerloom.llm.pii_model import TAGS, Tagger, codes, encode, legal, train


@pytest.fixture(scope="module")
def finder():
    return Finder()


def test_gradients():
    m = Tagger.new(h=4, emb=3)
    lines = [x for x in (Lines(i).line() for i in range(5)) if x[0]]
    x, y = encode(lines, 40)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.loss(x, y)
    for k, v in m.p.items():
        f = v.reshape(-1)
        i = int(np.abs(g[k]).reshape(-1).argmax())
        o = f[i]
        f[i] = o + 1e-3
        a = m.loss(x, y)[0]
        f[i] = o - 1e-3
        b = m.loss(x, y)[0]
        f[i] = o
        assert abs((a - b) / 2e-3 - g[k].reshape(-1)[i]) < 2e-3 * max(1, abs(g[k].reshape(-1)[i]))


def test_viterbi_is_best_path(finder):
    r = np.random.default_rng(3)
    m, n = finder.model, np.array([1, 3, 4])
    em = r.normal(size=(4, 3, len(TAGS))).astype(np.float32) * 3
    y = m.viterbi(em, n)
    import itertools

    A, start = m.p["A"] + legal(), m.p["s"] + np.array([-1e4 if t[0] == "I" else 0 for t in TAGS])
    for b in range(2):
        score = lambda p: start[p[0]] + sum(em[t, b, k] for t, k in enumerate(p)) + sum(A[i, j] for i, j in zip(p, p[1:])) + m.p["e"][p[-1]]  # noqa: B023, E731
        best = max(itertools.product(range(len(TAGS)), repeat=int(n[b])), key=score)
        assert abs(score(best) - score(tuple(y[: n[b], b]))) < 1e-3


def test_training_lowers_the_loss(tmp_path):
    seen = []
    train(tmp_path / "w.npz", steps=200, batch=16, say=lambda it, loss, *a, **k: seen.append(loss))
    assert seen[-1] < seen[0] and Tagger.load(tmp_path / "w.npz").p["E"].shape[0] > 90


def test_held_out_accuracy(finder):
    source, n = Lines(4242), Counter()
    lines = [source.line() for _ in range(1500)]
    for (text, spans), got in zip(lines, finder.spans([t for t, _ in lines])):
        want, have = {(k, a) for a, _, k in spans}, {(k, a) for k, a, _ in got}
        n.update({("tp", k): sum(x[0] == k for x in want & have) for k in KINDS})
        n.update({("fn", k): sum(x[0] == k for x in want - have) for k in KINDS})
        n.update({("fp", k): sum(x[0] == k for x in have - want) for k in KINDS})
    for k in KINDS:
        assert n["tp", k] / (n["tp", k] + n["fn", k]) > 0.93 and n["tp", k] / (n["tp", k] + n["fp", k]) > 0.95, k


def test_windows_do_not_matter(finder):
    text = "Cliente desde 2019 - Rua das Mangabeiras nº 3512 Qd. 72 Lt. 19 - Cansuto - XG, CEP 00688-141 - Isabel Pontes Frelgal " * 4
    assert len(text) > 2 * WINDOW - OVERLAP
    kinds = Counter(k for k, _, _ in finder.spans([text])[0])
    assert kinds["NAME"] == kinds["ADDRESS"] == 4


def test_broken_lines(finder):
    text = "Motorista: José\nVronral placa XYZ2031\nPagador: Raimundo Frabres\nUlisses Zordel pediu segunda via"
    assert [(k, text[a:b]) for k, a, b in finder.spans([text])[0]] == [("NAME", "José\nVronral"), ("NAME", "Raimundo Frabres"), ("NAME", "Ulisses Zordel")]


def test_find_and_replace(spark):
    rows = [(1, "Att. Sra. Wanda Brelfim\nPedido nº 6756-8831\nFone: (29) 4801-9667", "k"), (2, None, "k"), (3, "", "k"), (4, "   ", "k"), (5, "E-mail: nf.tonpa@campo.example", "k"), (5, "E-mail: nf.tonpa@campo.example", "k"), (6, "x " * 60_000, "k")]
    df = spark.createDataFrame(rows, "id long, raw_text string, kind string")
    got = sorted((r["doc_id"], r["kind"], r["start_pos"]) for r in find_personal(df).collect() if r["doc_id"] < 6)
    assert got == [(1, "NAME", 10), (1, "PHONE", 50), (5, "EMAIL", 8), (5, "EMAIL", 8)]
    safe = {r["id"]: r["safe_text"] for r in replace_personal(df).collect()}
    assert safe[1] == "Att. Sra. [NAME]\nPedido nº 6756-8831\nFone: [PHONE]" and safe[2] is None and safe[3] == "" and safe[5] == "E-mail: [EMAIL]"
    assert find_personal(df.limit(0)).count() == 0


def test_unknown_characters():
    assert list(codes("aé9\ud800日")) == [codes("a")[0], codes("é")[0], codes("0")[0], 1, 1]


def test_shared_beginnings_are_read_once(finder, monkeypatch):
    """Scores are those of a plain loop over each text, and texts that begin or end alike cost less than each for itself."""
    m, steps = finder.model, [0]
    texts = [codes(f"Fone do pagador: (99) {k}") for k in ("9999-9999", "9999-9998 x", "1", "a", "a", "ab Ltda")] + [codes(k) for k in ("x", "x\0", "x\0\0y", "\0x")]
    look = pii_model.tanh
    monkeypatch.setattr(pii_model, "tanh", lambda x, at: (steps.__setitem__(0, steps[0] + len(x)), look(x, at))[1])
    monkeypatch.setattr(pii_model, "STEP", 2)
    got = m.emissions(texts)
    assert steps[0] < 2 * 2 * sum(map(len, texts)) * 0.7
    p, h = m.p, m.h
    for c, em in zip(texts, got):
        y = np.tile(p["c"], (len(c), 1))
        for d, part in (("f", slice(None, h)), ("b", slice(h, None))):
            H, C = np.zeros(h), np.zeros(h)
            for t in range(len(c)) if d == "f" else range(len(c) - 1, -1, -1):
                z = H @ p[f"U{d}"] + p["E"][c[t]] @ p[f"W{d}"] + p[f"b{d}"]
                i, f, o = (1 / (1 + np.exp(-z[k * h : (k + 1) * h])) for k in range(3))
                C = f * C + i * np.tanh(z[3 * h :])
                H = o * np.tanh(C)
                y[t] += H @ p["V"][part]
        assert np.abs(y - em).max() < 0.01


def test_scores_are_not_rounded(finder):
    """The scores are those of the weights in double precision, and the best paths those of a plain loop over them."""
    m = finder.model
    p, h, A = m.p, m.h, m.p["A"] + legal()
    texts = [codes(t) for t in ("Att. Sra. Wanda Brelfim", "Fone: (99) 9999-9999", "x", "Pagador: José Vronral, CPF 999.999.999-99")]
    ems = m.emissions(texts)
    for c, em in zip(texts, ems):
        y = np.tile(p["c"].astype(float), (len(c), 1))
        for d, part in (("f", slice(None, h)), ("b", slice(h, None))):
            H, C = np.zeros(h), np.zeros(h)
            for t in range(len(c)) if d == "f" else range(len(c) - 1, -1, -1):
                z = H @ p[f"U{d}"] + p["E"][c[t]] @ p[f"W{d}"] + p[f"b{d}"]
                i, f, o = (1 / (1 + np.exp(-z[k * h : (k + 1) * h])) for k in range(3))
                C = f * C + i * np.tanh(z[3 * h :])
                H = o * np.tanh(C)
                y[t] += H @ p["V"][part]
        assert np.abs(y - em).max() < 1e-4
        v, back = y[0] + p["s"] + [-1e4 if t[0] == "I" else 0 for t in TAGS], []
        for t in range(1, len(y)):
            back.append((v[:, None] + A).argmax(0))
            v = (v[:, None] + A).max(0) + y[t]
        path = [int((v + p["e"]).argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert m.viterbi(em[:, None], np.array([len(c)]))[:, 0].tolist() == path[::-1]


def test_long_text_among_short_ones(monkeypatch):
    """A long line does not stretch the arrays of the others, and each span that stays in its cell is checked once."""
    f, areas, calls = Finder(), [], []
    best, check = f.model.viterbi, pii.checked
    monkeypatch.setattr(f.model, "viterbi", lambda em, n: (areas.append(em.shape[0] * em.shape[1]), best(em, n))[1])
    monkeypatch.setattr(pii, "checked", lambda *a: (calls.append(a), check(*a))[1])
    short = [f"Romaneio {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    long = "Wanda Brelfim, Fone: (29) 4801-9667; " * 500
    spans = f.spans([*short, long, "Att. Sra. Wanda Brelfim  Fone: (29) 4801-9667  Pagador: José Vronral"])
    assert max(areas) < 2_000_000
    assert Counter(k for k, _, _ in spans[400]) == {"NAME": 500, "PHONE": 500}
    assert [k for k, _, _ in spans[401]] == ["NAME", "PHONE", "NAME"] and len(calls) == 1003 + sum(map(len, spans[:400]))


@pytest.mark.parametrize("text", ["a  b", "a \tb  c ", " é d\u00a0 ", "x\ud83d 1", "7" * 9, "\t ok", "1  2   3 "])
def test_cells_and_figures(text):
    """Cells part at two blanks; folding keeps every other character and each place."""
    import re

    flat = pii_model.folded(text)
    assert flat == re.sub("[0-9]", "9", text)
    assert pii.CELL.findall(flat) == re.findall(r"\S(?:[^\r\n ]| (?! ))*", flat)
