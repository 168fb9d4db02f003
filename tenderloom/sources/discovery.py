"""Links in pages, and which of them are documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from . import markup as mk


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, href, text): links but for mail, scripts and jumps."""
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"([^"#][^"]*)"'), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"[^"#][^"]*"[^>]*>(.*?)</a'), F.lit(1)).alias("text"),
    )
    rows = pages.select(key, F.posexplode(found).alias("position", "a")).select(key, "position", "a.href", F.trim(F.regexp_replace("a.text", "<[^>]*>", "")).alias("text"))
    return rows.where(~F.rlike("href", F.lit("(?i)^(mailto|javascript):")))


def documents(pages: DataFrame, key: str, html: str, base: Column | None = None, most: int = 30) -> DataFrame:
    """(key, position, url, filename): the first ``most`` document links of each page, once an address.

    Links by their address or text, embedded files by their address alone.
    ``base`` is the page's own address; without it only whole addresses count.
    """
    rows = mk.parsed(pages.select(key, (F.lit(None).cast("string") if base is None else base).alias("base"), html), column=html)
    href = lambda e: F.coalesce(e["href"], F.lit(""))
    linked = F.filter(mk.tagged(F.col("nodes"), "a"), lambda e: (href(e) != "") & ~F.rlike(href(e), F.lit("^(mailto:|javascript:|#)")) & fn.looks_like_document(href(e), mk.text(e)))
    embedded = F.filter(mk.tagged(F.col("nodes"), "iframe", "embed", "object"), lambda e: fn.document_address(e["src"]))
    found = F.concat(F.transform(linked, lambda e: F.struct(mk.text(e).alias("text"), e["href"].alias("href"))), F.transform(embedded, lambda e: F.struct(F.lit("").alias("text"), e["src"].alias("href"))))
    rows = rows.select(key, "base", F.posexplode(found).alias("position", "r")).select(key, "position", fn.absolute(F.col("base"), F.col("r.href")).alias("url"), F.coalesce(F.nullif("r.text", F.lit("")), fn.file_name(F.col("r.href"))).alias("name"))
    once = rows.where("url is not null").groupBy(key, "url").agg(F.min(F.struct("position", F.substring("name", 1, 200).alias("filename"))).alias("x"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("x.position"))).where(F.col("n") <= most)
    return ranked.select(key, F.col("n").alias("position"), "url", "x.filename")


def handler_downloads(pages: DataFrame, key: str, html: str, url: Column) -> DataFrame:
    """(key, position, filename, url): links that call downloadFile('n'), as addresses of the portal's download page.

    The page's own address names the document (docId); pages without one have none.  Of equal addresses the first counts.
    """
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    doc = F.regexp_extract(url, r"[?&]docId=([^&#]+)", 1)
    links = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*"[^"]*downloadFile\(\s*'?(\d+)"""), F.lit(1)).alias("n"),
        F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*"[^"]*downloadFile\(\s*'?\d+[^>]*>(.*?)</a"""), F.lit(1)).alias("text"),
    )
    rows = pages.select(key, origin.alias("o"), doc.alias("doc"), F.posexplode(links).alias("position", "a")).where("o <> '' and doc <> ''")
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_replace("a.text", "<[^>]*>", ""), r"(?U)\s+", " ")), F.lit(""))
    address = F.concat("o", F.lit("/bso/external/bidDetail.sda?docId="), "doc", F.lit("&downloadFileNbr="), "a.n", F.lit("&mode=download&parentUrl=close&external=true"))
    found = rows.select(key, "position", F.substring(F.coalesce(name, F.concat(F.lit("document-"), "a.n")), 1, 200).alias("filename"), address.alias("url"))
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy(key, "url").orderBy("position"))).where("_n = 1")
    return first.select(key, "position", "filename", "url")
