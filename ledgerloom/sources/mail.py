"""Mails and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import link_confidence

ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
# Ways a button's script opens an address.
ONCLICK = [r"window\.open\(['\"]([^'\"]+)['\"]", r"location\.href\s*=\s*['\"]([^'\"]+)['\"]", r"window\.location\s*=\s*['\"]([^'\"]+)['\"]"]


def html_links(mails: DataFrame, key: str, html: str, least: float = 0.2) -> DataFrame:
    """key, url, label, confidence: links of HTML bodies, each address once with its best label."""
    pair = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("u"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("t"))
    scripted = F.filter(F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in ONCLICK])), lambda x: x != "")
    d = mails.filter(F.col(html).isNotNull()).select(key, F.concat(F.transform(pair, lambda x: F.struct(x["u"].alias("url"), F.trim(F.regexp_replace(x["t"], r"<[^>]+>", "")).alias("label"))), F.transform(scripted, lambda u: F.struct(u.alias("url"), F.lit("Button").alias("label")))).alias("l"))
    e = d.select(key, F.inline("l")).withColumn("confidence", link_confidence(F.col("url"), F.col("label"))).filter(F.col("confidence") >= least)
    w = Window.partitionBy(key, "url").orderBy(F.desc("confidence"), "label")
    return e.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_links(links: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` best links of each mail."""
    return links.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "url"))).filter(F.col("place") <= n)


def pending_mails(mails: DataFrame, today, days: int) -> DataFrame:
    """Mails with an attachment or a PDF or XML name, not processed, of the last ``days`` days."""
    named = F.exists("attachments", lambda a: F.lower(a["filename"]).rlike(r"\.(pdf|xml)$"))
    return mails.filter(((F.size("attachments") > 0) | named) & ~F.array_contains("labels", "processed") & (F.col("date") >= F.date_sub(today, days)))


def route(mails: DataFrame) -> DataFrame:
    """Mails with ``route``: XML, then PDF attachment, then links of a body, then text, else skip."""
    has = lambda end: F.coalesce(F.exists("attachments", lambda a: F.endswith(F.lower(a["filename"]), F.lit(end))), F.lit(False))
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return mails.withColumn("route", F.when(has(".xml"), "xml").when(has(".pdf"), "pdf").when(filled("html_body"), "link").when(filled("text_body"), "text").otherwise("skip"))


def new_attachments(mails: DataFrame, known: DataFrame) -> DataFrame:
    """Attachments, one row each, whose content hash is not known; the first by mail of equal ones."""
    a = mails.select("id", F.posexplode("attachments").alias("pos", "a")).select("id", "pos", "a.*")
    w = Window.partitionBy("md5_hash").orderBy("id", "pos")
    return a.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(known.select(F.col("file_hash").alias("md5_hash")).distinct(), "md5_hash", "left_anti")


def mime_parts(mails: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, html, text, attachments) of mails given as JSON trees of parts, however deep.

    A part with a PDF or XML name and an attachment id is an attachment (filename,
    mime_type, attachment_id); a part without a name gives its decoded body, the last
    HTML and the last plain text winning.  Trees that are no JSON give nothing.  Mails
    are walked one by one within Arrow batches; no mail is shuffled.
    """
    import base64
    import json

    import pandas as pd

    kind = dict(mails.dtypes)[key]

    def walk(node: dict, out: dict) -> None:
        stack = [node]
        while stack:
            part = stack.pop()
            if not isinstance(part, dict):
                continue
            name, body = part.get("filename") or "", part.get("body") or {}
            if name:
                if name.lower().endswith((".pdf", ".xml")) and body.get("attachmentId"):
                    out["attachments"].append({"filename": name, "mime_type": part.get("mimeType"), "attachment_id": body["attachmentId"]})
            elif body.get("data"):
                try:
                    data = base64.urlsafe_b64decode(body["data"]).decode("utf-8", "ignore")
                except (ValueError, TypeError):
                    data = None
                field = {"text/html": "html", "text/plain": "text"}.get(part.get("mimeType"))
                if field and data is not None:
                    out[field] = data
            stack += reversed(part.get("parts") or [])

    def run(batches):
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[payload]):
                out = {"html": None, "text": None, "attachments": []}
                try:
                    walk(json.loads(text) if text else {}, out)
                except ValueError:
                    pass
                rows.append((k, out["html"], out["text"], out["attachments"]))
            yield pd.DataFrame(rows, columns=[key, "html", "text", "attachments"])

    return mails.select(key, payload).mapInPandas(run, f"{key} {kind}, html string, text string, attachments array<struct<filename: string, mime_type: string, attachment_id: string>>")
