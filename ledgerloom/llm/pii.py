"""Personal information in free text: spans and typed placeholders."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import WORD_BUSINESS, word_kind
from .pii_grammar import GIVEN, NICK
from .pii_model import TAGS, Tagger, codes, folded

WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))
#: Characters of a window and of the overlap of two.
WINDOW, OVERLAP = 128, 48
#: Shapes of a batch of paths, its characters with those that fill it up, and line shapes whose spans a task remembers.
BATCH, AREA, KEPT = 512, 1_000_000, 150_000
#: A line ends at a line break; texts without any part their lines by two blanks.
ROW = re.compile(r"[^\r\n]+")
CELL = re.compile(r"\S[^\r\n ]*+(?: (?! )[^\r\n ]*+)*+")
FIGURE = re.compile(r"[0-9OolIiSsBZ]")
WORD = re.compile(r"[^\W\d_]+\.?", re.UNICODE)
#: What may follow a company's name but not a person's.
COMPANY = re.compile(r"[ .,-]{1,3}(?:&|LTDA|LTD|EIRELI|EPP|S/A|S\.A|CIA\b|FILIAL|FIL\.|UN\. |\(MATRIZ|CD\b)", re.IGNORECASE)
#: A label of a person's number right before its value.
LABEL = re.compile(r"(?:habilita\S+|cnh|cpf|cpf/mf|c\.p\.f\.|pis|nis|pis/pasep|identidade|rg|r\.g\.)(?: nº| do pagador)?:? $", re.IGNORECASE)
#: Lines that name a supplier.
SUPPLIER = re.compile(r"(?:\S{1,3}mitente|\S{0,3}enefici\S+|\S{0,2}avorecido|\S{0,2}restador):? ", re.IGNORECASE)
PARTICLES = {"de", "da", "do", "dos", "das", "e"}
EDGE = " \t.,;:|/-–<>()[]\"'"
TAIL = " \t,;:|/-–<>\"'("


class Finder:
    """Decodes texts with one model; loaded once a worker."""

    def __init__(self, path: str = WEIGHTS):
        self.model = Tagger.load(path)
        self.seen: dict[str, list] = {}

    def decode(self, shapes: list[str]) -> list:
        """Spans of each shape: windows are scored, their scores reconciled, and each shape decoded as a whole.

        Windows of a long shape overlap; where two cover a character, the one in
        which it lies further from the edge scores it.  Viterbi then runs over the
        whole shape, so a span that crosses windows is found in one piece.
        """
        if not shapes:
            return []
        whole = codes("".join(shapes))
        size = np.array([len(s) for s in shapes])
        start = np.cumsum(size) - size
        windows, kept = [], []
        for s, e in zip(start.tolist(), (start + size).tolist()):
            a = lo = s
            while e - a > WINDOW:
                b = a + WINDOW
                windows.append(whole[a:b])
                kept.append((lo - a, WINDOW - OVERLAP // 2))
                a, lo = b - OVERLAP, b - OVERLAP // 2
            windows.append(whole[a:e])
            kept.append((lo - a, e - a))
        scores = np.concatenate([em[a:b] for em, (a, b) in zip(self.model.emissions(windows), kept)])
        out: list = [()] * len(shapes)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            n = size[order[i : i + BATCH]]
            n = n[: max(1, np.searchsorted(np.arange(1, len(n) + 1) * n, AREA, side="right"))]
            part = order[i : i + len(n)]
            i += len(n)
            y = self.model.viterbi(scores.take(start[part] + np.arange(n[-1])[:, None], axis=0, mode="clip"), n)
            part = part.tolist()
            for r, span in raw_spans(y):
                if not out[part[r]]:
                    out[part[r]] = []
                out[part[r]].append(span)
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of every personal value of each text; equal line shapes are decoded once."""
        keys: list[str] = []
        starts: list[int] = []
        owner: list[int] = []
        for t, text in enumerate(texts):
            if not text:
                continue
            flat, e = folded(text), 0
            cells = (ROW if "\n" in text or "\r" in text else CELL).findall(flat)
            for k in cells:  # none begins with what parts cells, so the next place of its text is its own
                starts.append(s := flat.index(k, e))
                e = s + len(k)
            keys += cells
            owner += [t] * len(cells)
        self.learn(shapes := set(keys))
        marked = [i for i, k in enumerate(keys) if self.seen[k]]
        # a value may go on in the next cell, as two blanks can be a reading error and lines are
        # broken anywhere: where a span ends a cell and is no value yet, or after blanks one of its
        # kind opens the next, the two cells are decoded as one and kept so if a span crosses
        joined, last = {}, {}  # last: the check of a span that ends its cell
        for i in marked:
            k, x = keys[i], self.seen[keys[i]]
            if x[-1][2] == len(k) and i + 1 < len(keys) and owner[i] == owner[i + 1]:
                text, s, e, y = texts[owner[i]], starts[i], starts[i] + len(k), self.seen[keys[i + 1]]
                between = text[e : starts[i + 1]]
                opens = y and y[0][1] == 0 and x[-1][0] == y[0][0] and not set("\r\n") & set(between)
                last[i] = checked(text[s:e], *x[-1])
                if opens or last[i][0] is None:
                    joined[i] = f"{k}{between}{keys[i + 1]}"
        self.learn(shapes.union(joined.values()))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        taken = -1
        for i in marked:
            if i == taken:
                continue
            t, k, s = owner[i], keys[i], starts[i]
            if i in joined and any(a < len(k) < b for _, a, b in self.seen[joined[i]]):
                k, taken = joined[i], i + 1
                del last[i]
            line = texts[t][s : s + len(k)]
            for p in self.seen[k]:
                kind, a, b = last[i] if p[2] == len(k) and i in last else checked(line, *p)
                if kind:
                    out[t].append((kind, s + a, s + b))
        return out

    def learn(self, shapes: set[str]) -> None:
        """Decode the shapes not seen in this task yet."""
        fresh = sorted(shapes - self.seen.keys())
        if len(self.seen) > KEPT:  # what this batch needs stays
            self.seen = {k: v for k, v in self.seen.items() if k in shapes}
        self.seen.update(zip(fresh, self.decode(fresh)))


def raw_spans(y: np.ndarray) -> Iterator[tuple[int, tuple[str, int, int]]]:
    """(text, (kind, start, end)) of the spans of tags (T, texts), in order; a tag I goes on after B or I of its kind."""
    y = np.pad(y.T, ((0, 0), (1, 1)))
    before, y = y[:, :-1], y[:, 1:]
    goes_on = (y > 0) & (y % 2 == 0) & ((before == y) | (before == y - 1))
    row, start = ((y > 0) & ~goes_on).nonzero()
    end = ((before > 0) & ~goes_on).nonzero()[1]
    return ((r, (TAGS[k][2:], a, b)) for r, k, a, b in zip(row.tolist(), y[row, start].tolist(), start.tolist(), end.tolist()))


def checked(line: str, kind: str, a: int, b: int) -> tuple[str | None, int, int]:
    """Exact check of a decoded span: edges are trimmed to the value, and a span too poor for its kind is dropped."""
    edge = EDGE.replace("(", "").replace("<", "") if kind == "PHONE" else EDGE
    while a < b and line[a] in edge:
        a += 1
    tail = TAIL if kind in ("NAME", "ADDRESS") else TAIL + "."
    while b > a and line[b - 1] in tail:
        b -= 1
    v = line[a:b]
    if kind in ("NAME", "EMAIL", "ID_NUMBER"):  # a value begins with its word
        while a > 0 and (line[a - 1].isalnum() or kind == "EMAIL" and line[a - 1] in "._+-"):
            a -= 1
        v = line[a:b]
    if kind == "PHONE":
        while a > 0 and line[a - 1] in "(+0123456789":
            a -= 1
        v = line[a:b]
        if LABEL.search(line, 0, a) and "(" not in v and "+" not in v:
            kind = "ID_NUMBER"  # eleven figures after the label of a person's number
        return (kind, a, b) if len(FIGURE.findall(v)) >= 8 else (None, a, b)
    if kind == "ID_NUMBER":
        return (kind, a, b) if len(FIGURE.findall(v)) >= 6 else (None, a, b)
    if kind == "NAME":
        parts = [w for w in WORD.findall(v) if w.lower() not in PARTICLES]
        if len(parts) < 2 or COMPANY.match(line, b) or any(_trade(w) for w in parts):
            return None, a, b
        # a supplier of two words, neither of them a given name or an initial, is a company's name cut short
        if len(parts) == 2 and SUPPLIER.match(line) and not any(len(w.rstrip(".ªº")) == 1 or _bare(w) in KNOWN or word_kind(_bare(w))[0] == "given" for w in parts):
            return None, a, b
        return kind, a, b
    if kind == "EMAIL":
        return (kind, a, b) if len(v) >= 6 else (None, a, b)
    return (kind, a, b) if len(v) >= 5 else (None, a, b)


def _bare(word: str, cut: str = ".") -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.upper()) if not unicodedata.combining(c)).rstrip(cut)


@lru_cache(100_000)
def _trade(word: str) -> bool:
    """True for a line of business, written out or abbreviated with a dot."""
    w = _bare(word, "")
    return len(w) > 4 and w in WORD_BUSINESS or len(w) > 2 and w[-1] == "." and w[:-1] in WORD_BUSINESS


KNOWN = {_bare(w) for w in GIVEN + NICK}
_FINDERS: dict[str, Finder] = {}


def finder(path: str) -> Finder:
    if path not in _FINDERS:
        _FINDERS[path] = Finder(path)
    return _FINDERS[path]


def find_personal(df: DataFrame, id_col: str = "id", text: str = "raw_text", weights: str = WEIGHTS) -> DataFrame:
    """doc_id, kind, start_pos, end_pos: one row for each personal value of each text.

    A character BiLSTM scores overlapping windows and CRF transitions decode each
    line as a whole.  Null, empty and blank texts have no rows; texts of any length
    are read whole; a repeated row gives its values again; columns other than the
    two named are ignored.  No shuffle: one pass over the texts.
    """

    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("kind", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(weights)
        f.seen = {}  # shapes are remembered within a task, not beyond it
        for b in batches:
            spans = f.spans(b.column(1).to_pylist())
            n = [len(s) for s in spans]
            flat = [s for x in spans for s in x]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([k for k, _, _ in flat], pa.string()), pa.array([s for _, s, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())], names=schema.names)

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def replace_personal(df: DataFrame, text: str = "raw_text", out: str = "safe_text", weights: str = WEIGHTS) -> DataFrame:
    """``df`` with personal values replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]; the rest of a text stays as it is.

    Null gives null, an empty text an empty text.
    """

    @F.pandas_udf(T.StringType())
    def mask(s: pd.Series) -> pd.Series:
        texts = [x if isinstance(x, str) else None for x in s]
        f, res = finder(weights), []
        f.seen = {}
        for t, spans in zip(texts, f.spans(texts)):
            for kind, a, b in reversed(spans):
                t = f"{t[:a]}[{kind}]{t[b:]}"
            res.append(t)
        return pd.Series(res, dtype=object)

    return df.withColumn(out, mask(F.col(text)))
