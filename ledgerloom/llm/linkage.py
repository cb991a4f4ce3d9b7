"""Duplicates of new batches against everything accepted before: incremental record linkage."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, drop_cut, read_text, remove, work_dir, write_text
from .components import _jump, connected_groups
from .paper import kind_of_number, read_number, read_paper

FIELDS = ["number", "part", "due", "made", "amount", "auth", "chave", "issuer"]
NO_FIGURE = re.compile("[^0-9]+")
READ = "kind string, " + ", ".join(f"{f} string" for f in FIELDS)
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
#: Shares of agree, nearly, differ among copies of a paper that count as this many observed pairs.
PRIOR, PRIOR_PAIRS = (0.96, 0.025, 0.015), 40
#: Fields whose value names one paper by definition, with the weights of agree, nearly, differ in bits; these are not learned.
UNIQUE = {"auth": (26.0, 9.0, -9.0), "chave": (34.0, 8.0, -9.0)}


def row_of(text: str | None, doc_type: str | None, number: str | None, key: str | None) -> tuple:
    """(kind, *FIELDS) of one row: what its text says, and where that is silent, its columns."""
    r = read_paper(text)
    kind = r["kind"] or (doc_type if doc_type in ("NFE", "NFSE", "BOLETO", "COMPROVANTE") else kind_of_number(number))
    no, part = read_number(number) if number and (kind in ("COMPROVANTE", "BOLETO") or not r["number"]) else (None, None)
    chave = r["chave"]
    if kind == "NFE" and key:
        a = NO_FIGURE.sub("", key)
        chave = a if len(a) == 44 else chave
    if kind == "COMPROVANTE":
        return kind, None, None, r["due"], r["made"], r["amount"], r["auth"] or no, chave, r["issuer"]
    part = (r["part"] or part) if kind == "BOLETO" else None
    return kind, r["number"] or no, None if part == "0" else part, r["due"], r["made"], r["amount"], r["auth"], chave, r["issuer"]


def read_rows(df: DataFrame) -> DataFrame:
    """id, batch, hash and what each row's paper says; see :func:`read_paper`."""

    @F.pandas_udf(T._parse_datatype_string(READ))
    def read(text: pd.Series, doc_type: pd.Series, number: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = [row_of(*r) for r in zip(text.tolist(), doc_type.tolist(), number.tolist(), key.tolist())]
        return pd.DataFrame(dict(zip(("kind", *FIELDS), map(list, zip(*rows)))), columns=["kind", *FIELDS], dtype=object)

    h = F.regexp_extract(F.lower(F.trim("file_hash")), r"^(?:md5:)?\s*([0-9a-f]{32})$", 1)
    d = df.select("id", "lote_id", F.when((h != "") & (h != EMPTY_MD5), h).alias("hash"), read("raw_text", "doc_type", "doc_number", "access_key").alias("r"))
    d = d.filter("id is not null").select("id", "lote_id", "hash", "r.*")
    # rows that print the same values are one signature, so copies are folded before any pair is made;
    # the issuer, in which reading errors vary freely, counts only where no number tells papers apart
    named = F.coalesce("number", "auth", "chave").isNotNull()
    values = F.sha2(F.to_json(F.struct("kind", *[f for f in FIELDS if f != "issuer"], F.when(~named, F.col("issuer")).alias("issuer"))), 256)
    return d.withColumn("sig", F.when(F.size(key_texts()) > 0, values).otherwise(F.concat(F.lit("row:"), F.col("id"))))


def key_texts() -> F.Column:
    """Blocking keys of a row: each pins a kind and two or three values, or one unique value.

    A paper misses another copy only if reading errors hit values in all its keys.
    Signatures under one key differ only in lost figures of the values it leaves
    open, so a block does not grow with the number of copies of a paper.
    """
    return F.expr(KEY_TEXTS)


def _key(name: str, *cols: str, when: str = "true", end: str = "") -> str:
    """SQL of one key: null unless ``when`` holds and the kind and all ``cols`` are known."""
    known = " and ".join(f"{c} is not null" for c in ("kind", *cols))
    return f"case when {when} and {known} then concat_ws('|', '{name}', kind, {', '.join(cols)}{end}) end"


_KEYS = [
    _key("nd", "number", "due"), _key("nma", "number", "made", "amount"), _key("dma", "due", "made", "amount"),
    _key("nm", "number", "made", when="kind <> 'BOLETO'"), _key("na", "number", "amount", when="kind <> 'BOLETO'"),
    _key("mai", "made", "amount", "issuer", when="kind in ('NFE', 'NFSE')"),
    _key("auth", "auth"), _key("ma", "made", "amount", "issuer", when="kind = 'COMPROVANTE'"), _key("key", "chave"),
    _key("np", "number", "part", when="try_cast(part as int) > 1"),
    # slips whose dates are lost on either side; no part counts as part 0
    _key("npa", "number", "amount", when="kind = 'BOLETO'", end=", coalesce(part, '0')"),
]
KEY_TEXTS = f"array_distinct(array_compact(array({', '.join(_KEYS)})))"


def blocking_keys(sigs: DataFrame) -> DataFrame:
    """(key, sid, kind, fields) of every signature; see :func:`key_texts`.

    The index carries the fields, so that a probe compares a pair where it meets it
    and history is neither shuffled by key nor joined with a second table.
    """
    return sigs.select("sid", "kind", *FIELDS, F.explode(key_texts()).alias("key")).withColumn("key", F.xxhash64("key"))


def _level(f: str) -> str:
    """SQL of how a pair's values of a field compare: agree 2, nearly 1, differ 0, null if one is unknown."""
    a, b = f"a.{f}", f"b.{f}"
    if f == "issuer":
        near = f"levenshtein({a}, {b}) <= greatest(2, greatest(length({a}), length({b})) * 0.3)"
    else:
        # one figure lost counts as nearly; one figure changed into another does not
        near = f"length({a}) <> length({b}) and levenshtein({a}, {b}, 1) = 1 and greatest(length({a}), length({b})) > 2"
    return f"case when {a} is null or {b} is null then null when {a} = {b} then 2 when {near} then 1 else 0 end as c_{f}"


def comparison(p: DataFrame) -> DataFrame:
    """Pattern of a pair (a, b): per field agree 2, nearly 1, differ 0, or unknown (null)."""
    return p.selectExpr("a.sid as x", "b.sid as y", *map(_level, FIELDS))


CHANCE = [f for f in FIELDS if f not in UNIQUE]


def chance_agreement(sigs: DataFrame) -> dict[str, float]:
    """Probability that two papers taken at random agree in a field: the sum of squared shares of its values."""
    long = sigs.select(F.inline(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).alias("v")) for k, f in enumerate(CHANCE)]))).filter("v is not null")
    n = long.groupBy("f", "v").agg(F.count("*").cast("double").alias("n"))
    rows = n.groupBy("f").agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("u")).collect()  # one row a field
    return {CHANCE[r["f"]]: r["u"] for r in rows}


def learn_weights(patterns: list[dict], chance: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """Weights in bits, log2(m / u), of agree, nearly and differ for each field.

    m comes from labelled pairs, copies of one paper known by its access key or
    authentication; ``patterns`` are their comparison patterns (at most 4 ** 8) with
    counts ``n``.  u is the chance agreement of random papers.  The due date, which
    labelled kinds lack, takes the rates of the other date.
    """
    m = {f: [x * PRIOR_PAIRS for x in PRIOR] for f in FIELDS}
    for p in patterns:
        for f in FIELDS:
            if p[f"c_{f}"] is not None:
                m[f][2 - p[f"c_{f}"]] += p["n"]
    m["due"] = m["made"]
    out = dict(UNIQUE)
    for f in FIELDS:
        if f not in UNIQUE:
            u = min(0.9, max(chance.get(f, 0.01), 2.0**-16))
            near = min(0.9, 20 * u)
            total = sum(m[f])
            rate = [x / total for x in m[f]]
            out[f] = (math.log2(rate[0] / u), math.log2(max(rate[1], 1e-4) / near), math.log2(max(rate[2], 1e-4)))
    return out


#: Tables of a history: columns and the column that buckets them.
TABLES = {
    "sigs": ("sig string, sid bigint", "sig"),
    "keys": ("key bigint, sid bigint, " + READ, "key"),
    "hashes": ("hash string, first bigint", "hash"),
    "forest": ("v bigint, p bigint", "v"),
    "members": ("id bigint, sid bigint, hash string", "id"),
}
#: So many parts of one level are merged into one of the next, so a row is rewritten once a level and a probe opens few files.
MERGE = 8


class History:
    """What was accepted, in a folder that any later job can open.

    The tables of :data:`TABLES` are bucketed by the column they are probed by, so a
    batch is shuffled to their buckets and they are not shuffled at all.  Each batch
    adds a part (a folder ``gen=n`` of each table) that counts once ``meta.json``
    names it: a batch that fails halfway leaves history as it was and is simply
    accepted again.  ``meta.json`` also holds the number of buckets, the learned
    weights and the threshold.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the history in ``path``; a new one gets ``buckets``, by default as many as the session's shuffle partitions."""
        self.spark, self.path = spark, path.rstrip("/")
        meta = read_text(spark, f"{self.path}/meta.json")
        self.meta = json.loads(meta) if meta else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "parts": [], "next": 0, "weights": None, "threshold": None}
        tag = hashlib.md5(self.path.encode()).hexdigest()[:12]
        self.names = {t: f"history_{tag}_{t}" for t in TABLES}
        for t, (cols, key) in TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.names[t]} ({cols}, gen int) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (gen) CLUSTERED BY ({key}) INTO {self.meta['buckets']} BUCKETS LOCATION '{self.path}/{t}'")
            if self.meta["parts"]:
                spark.catalog.refreshTable(self.names[t])

    @property
    def weights(self) -> dict | None:
        return self.meta["weights"]

    def save(self) -> None:
        write_text(self.spark, f"{self.path}/meta.json", json.dumps(self.meta))

    def parts(self) -> list[int]:
        return [n for _, n in self.meta["parts"]]

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """The accepted rows of a table, or those of ``parts``."""
        return self.spark.table(self.names[table]).filter(F.col("gen").isin(self.parts() if parts is None else parts))

    def exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def write(self, table: str, rows: DataFrame, part: int) -> DataFrame:
        """Put the rows of a part, one file a bucket, in place of what a failed attempt may have left."""
        cols, key = TABLES[table]
        names = [c.split()[0] for c in cols.split(", ")]
        out = rows.select(names).repartition(self.meta["buckets"], key)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.names[table]} PARTITION (gen = {part}) SELECT * FROM {{rows}}", rows=out)
        return self.read(table, [part])

    def commit(self, part: int) -> None:
        """Let a written part count."""
        self.meta["parts"].append([0, part])
        self.meta["next"] = part + 1
        self.save()

    def merge(self) -> None:
        """Merge parts of one level where there are :data:`MERGE` of them."""
        level = 0
        while len(old := [n for lv, n in self.meta["parts"] if lv == level]) >= MERGE:
            new = self.meta["next"]
            for t, (cols, _) in TABLES.items():  # read as files: a table cannot be read while a part of it is written
                has = [x for n in old if self.exists(x := f"{self.path}/{t}/gen={n}")]
                if has:
                    self.write(t, self.spark.read.schema(cols).parquet(*has), new)
            self.meta["parts"] = [x for x in self.meta["parts"] if x[1] not in old] + [[level + 1, new]]
            self.meta["next"] = new + 1
            self.save()
            for t in TABLES:
                for n in old:
                    remove(self.spark, f"{self.path}/{t}/gen={n}")
                self.spark.catalog.refreshTable(self.names[t])
            level += 1

    def learn(self, rows: DataFrame, sample: int = 20_000) -> None:
        """Learn weights and threshold from ``rows`` (see :func:`read_rows`) and keep them for all batches to come.

        Chance agreement counts all rows.  Copies of one paper, known by equal access
        key or authentication, are each compared with the smallest id of theirs, so
        a value held by many rows gives as many comparisons as rows; about ``sample``
        labelled papers are taken at most, whole labels chosen by hash.
        """
        label = F.coalesce("chave", "auth")
        # one row a signature, values as hashes: fixed width, so it is aggregated without sorting
        hashed = [F.when(F.col(f).isNotNull(), F.xxhash64(f)).alias(f) for f in CHANCE]
        sigs = cut(rows.select(F.xxhash64("sig").alias("sig"), label.isNotNull().alias("label"), *hashed).groupBy("sig").agg(*[F.first(c).alias(c) for c in ("label", *CHANCE)]), count="label")
        share = int(min(1.0, sample / max(1, sigs.counted)) * 1_000_000)
        known = rows.withColumn("label", label).filter(F.col("label").isNotNull() & (F.pmod(F.xxhash64(F.lit(7), "label"), F.lit(1_000_000)) < share))
        known = known.groupBy("label", "sig").agg(F.min(F.struct("id", "kind", *FIELDS)).alias("f")).select("label", F.col("f.id").alias("sid"), *[F.col(f"f.{c}").alias(c) for c in ("kind", *FIELDS)])
        first = known.groupBy("label").agg(F.min(F.struct("sid", "kind", *FIELDS)).alias("f"), F.count("*").alias("n")).filter("n > 1").select("label", "f.*")
        pairs = known.alias("a").join(first.alias("b"), "label").filter("a.sid <> b.sid and a.kind = b.kind")
        counted = comparison(pairs).groupBy(*[f"c_{f}" for f in FIELDS]).count().withColumnRenamed("count", "n").collect()  # at most 4 ** 8 rows
        self.meta["weights"] = learn_weights([r.asDict() for r in counted], chance_agreement(sigs))
        # a random pair is one paper with odds of about a sixth to the number of papers
        self.meta["threshold"] = math.log2(max(sigs.count(), 64) / 0.16)
        drop_cut(sigs)
        self.save()


def _roots(h: History, ids: DataFrame, col: str) -> DataFrame:
    """Follow the forest from ``ids`` until no pointer moves; only these ids are looked up."""
    cur = ids.select(col, F.col(col).alias("root"))
    while h.parts():
        up = h.read("forest").select(F.col("v").alias("root"), "p")
        step = cut(cur.hint("shuffle_hash").join(up, "root", "left").select(col, F.coalesce("p", "root").alias("root"), F.col("p").isNotNull().alias("moved")), count="moved")
        drop_cut(cur)
        cur = step.drop("moved")
        cur._cut_path = step._cut_path
        if not step.counted:
            break
    return cur


def accept(h: History, rows: DataFrame, margin: float = 0.0) -> None:
    """Compare a batch of rows (see :func:`read_rows`) with history and with itself, and take it into history.

    Only the batch is keyed and shuffled: history's signature, key and hash tables are
    probed bucket by bucket, pairs are scored with the learned weights where they
    meet, and the representatives of the clusters they touch are updated in the
    forest.  The smallest id of a paper is its representative.  A pair is one paper
    if its weights exceed the threshold by ``margin`` bits.
    """
    if h.weights is None:
        h.learn(rows)
    h.merge()
    n, past = h.meta["next"], bool(h.parts())
    fresh = rows.groupBy("sig").agg(F.min("id").alias("sid0"), *[F.first(c, True).alias(c) for c in ("kind", *FIELDS)])
    known = h.read("sigs").select("sig", F.col("sid").alias("old"))
    fresh = fresh.hint("shuffle_hash").join(known, "sig", "left") if past else fresh.withColumn("old", F.lit(None).cast("long"))
    fresh = cut(fresh.withColumn("sid", F.coalesce("old", "sid0")))
    h.write("sigs", fresh.filter("old is null"), n)
    h.write("keys", blocking_keys(fresh.filter("old is null")), n)
    members = h.write("members", rows.select("id", "hash", "sig").join(fresh.select("sig", "sid"), "sig"), n)
    # equal usable hashes are equal files
    first = members.filter("hash is not null").groupBy("hash").agg(F.min("sid").alias("here"))
    seen = h.read("hashes").select("hash", "first")
    first = cut((first.hint("shuffle_hash").join(seen, "hash", "left") if past else first.withColumn("first", F.lit(None).cast("long"))))
    h.write("hashes", first.filter("first is null").select("hash", F.col("here").alias("first")), n)
    same = members.filter("hash is not null").select("hash", "sid").join(first.select("hash", F.coalesce("first", "here").alias("first")), "hash").filter("sid <> first").select(F.col("sid").alias("x"), F.col("first").alias("y"))
    back = first.filter("here <> first").select(F.col("here").alias("x"), F.col("first").alias("y"))
    # a row whose signature is known may have a smaller id than its signature's first
    below = fresh.filter("old is not null and sid0 < old").select(F.col("old").alias("x"), F.col("sid0").alias("y"))
    # the batch's part of the index against every part, its own included
    hit = h.read("keys", [n]).drop("gen").hint("shuffle_hash").alias("a").join(h.read("keys", [*h.parts(), n]).alias("b"), "key").filter(F.col("a.sid") != F.col("b.sid"))
    score = " + ".join(f"case c_{f} when 2 then {w[0]!r}D when 1 then {w[1]!r}D when 0 then {w[2]!r}D else 0D end" for f, w in h.weights.items())
    # exact check: two readable values of one field that differ by more than a lost figure are two papers
    clash = " or ".join(f"c_{f} <=> 0" for f in FIELDS if f != "issuer")
    edges = comparison(hit).filter(f"{score} >= {h.meta['threshold'] + margin!r}D and (not ({clash}) or c_chave <=> 2)").select("x", "y")
    links = cut(edges.union(same).union(back).union(below).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), count=F.lit(True))
    moved = None
    if links.counted:
        root = _roots(h, links.select(F.col("x").alias("v")).union(links.select("y")).distinct(), "v")
        tops = links.join(root.select(F.col("v").alias("x"), F.col("root").alias("rx")), "x").join(root.select(F.col("v").alias("y"), F.col("root").alias("ry")), "y").select("rx", "ry").filter("rx <> ry")
        moved = connected_groups(tops, "rx", "ry", "v", "p").filter("v <> p")
        h.write("forest", moved, n)
        drop_cut(root)
    h.commit(n)
    drop_cut(fresh, first, links)


def repeated_documents(df: DataFrame, waves: int | None = 4, margin: float = 0.0, path: str | None = None) -> DataFrame:
    """Each repeated document with the accepted one it repeats: id_a, the paper's smallest id, and id_b.

    Texts are read once, each for itself, into a table parted by ``lote_id``; weights
    and threshold are learned from it and frozen; then batches are accepted one
    after the other, in ``waves`` groups of neighbouring batches or each for itself
    (None).  As weights are frozen and links and smallest ids do not depend on order,
    the result does not depend on the number of waves.  ``path`` is the folder of the :class:`History`,
    which later jobs may open and go on with; without one it is a folder that ends
    with the application.

    Rows with a null ``lote_id`` are accepted last, null ids are ignored.  A row
    with neither readable text, number, access key nor usable hash repeats nothing.
    Repeated rows (same id) give no pair with themselves.  An empty table gives no
    rows.  Columns other than id, lote_id, file_hash, raw_text, doc_type,
    doc_number and access_key are ignored.
    """
    spark = df.sparkSession
    landed = cut(read_rows(df), ["lote_id"])
    lotes = [r["lote_id"] for r in landed.groupBy("lote_id").count().orderBy(F.col("lote_id").asc_nulls_last()).collect()]  # one row a batch
    none = df.select(F.col("id").cast("long").alias("id_a"), F.col("id").cast("long").alias("id_b")).limit(0)
    if not lotes:
        return none
    h = History(spark, path or f"{work_dir(spark)}/history-{uuid.uuid4().hex}")
    if h.weights is None:
        h.learn(landed)
    size = max(1, -(-len(lotes) // (waves or len(lotes))))
    for k in range(0, len(lotes), size):
        part = lotes[k : k + size]
        cond = F.col("lote_id").isin([x for x in part if x is not None])
        if None in part:
            cond = F.coalesce(cond, F.lit(True)) if len(part) > 1 else F.col("lote_id").isNull()
        accept(h, landed.filter(cond), margin)
    drop_cut(landed)
    return pairs_of(h)


def pairs_of(h: History) -> DataFrame:
    """(id_a, id_b) of every accepted document that repeats another one."""
    flat = _jump(cut(h.read("forest").select("v", "p"))).select(F.col("v").alias("sid"), F.col("p"))
    m = h.read("members").join(flat, "sid", "left").select("id", F.coalesce("p", "sid").alias("rep"))
    return m.filter("id <> rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b")).distinct()
