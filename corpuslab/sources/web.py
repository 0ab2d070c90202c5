"""Stored web data: JSON post lists and HTML pages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import take_per_group
from ..schemas import POSTS


def parse_posts(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per post of a JSON array; anything that is not an array gives no rows.

    Posts without an id or a file URL are dropped.
    """
    keep = keep or []
    text = F.when(F.ltrim(json_col).startswith("["), F.col(json_col))
    posts = df.select(*keep, F.explode(F.from_json(text, POSTS)).alias("post"))
    out = posts.select(*keep, F.col("post.id").alias("id"), F.col("post.file_url").alias("file_url"))
    return out.where(F.col("id").isNotNull() & (F.col("id") != 0) & (F.length("file_url") > 0))


def extract_links(
    df: DataFrame,
    html_col: str,
    page_col: str,
    attr: str = "src",
    tag: str | None = None,
    suffixes: Iterable[str] | None = None,
    limit: int | None = None,
    group: str | None = None,
) -> DataFrame:
    """Attribute values of stored HTML in document order, first seen wins, at most ``limit`` per group.

    Attribute extraction by pattern, not an HTML parser: quoted values inside a tag only. Repeats
    inside one page vanish within the row; repeats across the pages of a ``group`` keep the earliest
    page.
    """
    name = f"{tag}\\b" if tag else "[a-zA-Z]"
    pattern = f"(?is)<{name}[^>]*?\\s{attr}\\s*=\\s*[\"']([^\"'>]+)[\"']"
    found = F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(pattern), F.lit(1)))
    if suffixes is not None:
        wanted = [s.lower() for s in suffixes]
        found = F.filter(
            found, lambda u: F.exists(F.lit(wanted), lambda s: F.endswith(F.lower(u), s))
        )
    if group is None:
        if limit is not None:
            found = F.slice(found, 1, limit)
        return df.select(F.col(page_col), F.posexplode(found).alias("pos", "link"))
    links = (
        df.select(F.col(group), F.col(page_col), F.posexplode(found).alias("pos", "link"))
        .groupBy(group, "link")
        .agg(F.min(F.struct(page_col, "pos")).alias("first"))
        .select(group, "link", f"first.{page_col}", "first.pos")
    )
    return links if limit is None else take_per_group(links, [group], limit, [page_col, "pos"])
