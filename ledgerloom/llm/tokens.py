"""Token ids of a corpus by a public byte-level BPE, contracted in DuckDB."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter, the files are never copied.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A round takes every word's smallest-rank pair, leftmost first; in a run of the same
#: pair (a a a) every other one is free.  A merge only makes pairs of a higher rank, so
#: taking all free places of one rank equals taking them one by one.  Rows are keyed by
#: (word, position): a contracted position becomes -1 and drops out of the next round.
CONTRACT = """
WITH RECURSIVE state(wid, pos, tok) USING KEY (wid, pos) AS (
  SELECT wid, pos, tok FROM start
  UNION
  SELECT wid, pos, tok FROM (
    WITH line AS (
      SELECT wid, pos, tok,
             lead(tok) OVER w AS right_tok, lead(pos) OVER w AS right_pos,
             row_number() OVER w AS k
      FROM recurring.state WHERE tok >= 0 AND wid IN (SELECT DISTINCT wid FROM state)
      WINDOW w AS (PARTITION BY wid ORDER BY pos)
    ), pair AS (
      SELECT l.wid, l.pos, l.right_pos, l.k, m.rank, m.made
      FROM line l JOIN merges m ON m.a = l.tok AND m.b = l.right_tok
    ), least AS (
      SELECT *, k - row_number() OVER (PARTITION BY wid ORDER BY k) AS run
      FROM (SELECT * FROM pair QUALIFY rank = min(rank) OVER (PARTITION BY wid))
    ), free AS (
      SELECT * FROM least QUALIFY (k - min(k) OVER (PARTITION BY wid, run)) % 2 = 0
    )
    SELECT wid, pos, made AS tok FROM free
    UNION ALL
    SELECT wid, right_pos AS pos, -1 AS tok FROM free
  )
)
SELECT wid, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY wid
"""


#: Letters of contracted words that a task remembers for its next batches.
REMEMBERED = 4_000_000


class WordEncoder:
    """Ids of distinct words; one DuckDB connection with the merge table per task.

    Words contracted for one batch are remembered for the next ones of the task, up
    to :data:`REMEMBERED` letters; then it begins anew.
    """

    def __init__(self, path: str):
        self.forget()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.byte_id = np.array([vocab[name[b]] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table({"a": pa.array([vocab[x] for x, _ in pairs], pa.int32()), "b": pa.array([vocab[y] for _, y in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "made": pa.array([vocab[x + y] for x, y in pairs], pa.int32())})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.cut = regex.compile(PATTERN)

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.off, self.ids, self.letters = np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of word k are ids[offsets[k]:offsets[k + 1]]."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        wid = np.repeat(np.arange(len(raw), dtype=np.int32), n)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self.db.register("start_in", pa.table({"wid": wid, "pos": pos, "tok": flat}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT * FROM start_in")
        t = self.db.sql(CONTRACT + " ORDER BY wid").to_arrow_table()
        self.db.unregister("start_in")
        ids = t["ids"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return np.r_[0, np.cumsum(np.diff(ids.offsets.to_numpy()))], ids.flatten().to_numpy()

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text; the distinct words of all texts that are not remembered are contracted together, once."""
        if self.letters > REMEMBERED:
            self.forget()
        number, start = self.number, len(self.number)
        seq, count = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                ws = self.cut.findall(t)
                count[i] = len(ws)
                seq.extend([number.setdefault(w, len(number)) for w in ws])
        if not number:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1), pa.int32()), pa.array([], pa.int32()))
        fresh = list(itertools.islice(number, start, None))
        if fresh:
            off, ids = self.encode_words(fresh)
            self.off, self.ids = np.r_[self.off, self.off[-1] + off[1:]], np.r_[self.ids, ids]
            self.letters += sum(map(len, fresh))
        off, ids = self.off, self.ids
        k = np.array(seq, np.int64)
        size = (off[1:] - off[:-1])[k]
        where = np.repeat(off[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(count)]]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[where], pa.int32()))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, at_once: int = 4_000_000) -> DataFrame:
    """Ids of every row's whole text, without special tokens; their strings are ordinary text.

    Null and empty texts both get an empty list, so every row has ids.  Rows are
    never shuffled: each Arrow batch cuts its texts into words and DuckDB contracts
    the distinct words of about ``at_once`` characters by a recursive query over (word, position, token)
    rows joined with the merge table.  Output has the id column and ``out``;
    repeated rows come out as often as they come in.
    """
    path = f"{tokenizer_dir}/{tokenizer}.json"
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or WordEncoder(path)
            size = pa.compute.fill_null(pa.compute.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            part = np.flatnonzero(np.diff(size // at_once, prepend=0)) if len(size) else []
            for lo, hi in zip([0, *part], [*part, len(b)]):
                if lo < hi:
                    ids = enc.encode(b.column(1)[lo:hi].to_pylist())
                    want = pa.list_(pa.field("element", pa.int32(), False))
                    yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.ListArray.from_arrays(ids.offsets, ids.values, type=want)], names=[id_col, out])

    return df.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``df`` with the number of tokens of a text column; null and empty texts have 0."""
    path = f"{tokenizer_dir}/{tokenizer}.json"
    kept: dict = {}

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        if "t" not in kept:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            kept["t"] = Tokenizer.from_file(path)
            kept["t"].encode_special_tokens = True
        return pd.Series([len(e.ids) for e in kept["t"].encode_batch_fast(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
