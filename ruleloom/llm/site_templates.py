"""The main text of web pages: what recurs across a host's pages, and what is marked as an aside, is taken away."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fine_sieve, passes_fine, session, stored
from .html_tree import page_blocks

# A subtree is a site's template if it is on so many pages of the host that tell different stories, and on this share of them;
# within articles, where pages may quote the same passage, on a larger share.
TEMPLATE_PAGES = 5
OUTSIDE_SHARE, INSIDE_SHARE = 0.01, 0.1

PARSED = "page_key long, {columns}, story long, seen array<struct<key: long, inside: boolean>>, around array<long>, blocks array<struct<text: string, around: array<long>>>"
SEEN = pa.list_(pa.struct([("key", pa.int64()), ("inside", pa.bool_())]))
BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 33
    for batch in batches:
        stories, seen, around, blocks = [], [], [], []
        for source in batch.column("html"):
            story, subtrees, texts = page_blocks(source.as_py() or "")
            stories.append(story)
            seen.append([{"key": k, "inside": i} for k, i in subtrees])
            around.append(sorted({key for _, keys in texts for key in keys}))
            blocks.append([{"text": t, "around": a} for t, a in texts])
        keys = pa.array(range(key, key + len(batch)), pa.int64())
        key += len(batch)
        yield pa.RecordBatch.from_arrays(
            [keys, *(batch.column(c) for c in ("page_id", "url", "host")), pa.array(stories, pa.int64()), pa.array(seen, SEEN),
             pa.array(around, pa.list_(pa.int64())), pa.array(blocks, BLOCKS)],
            names=["page_key", "page_id", "url", "host", "story", "seen", "around", "blocks"],
        )


def templates(pages: DataFrame) -> DataFrame:
    """``host, key``: subtrees that recur across the host's pages.  Each page tells the number of stories by a key of its own."""
    every = F.array(F.struct(F.lit(None).cast("long").alias("key"), F.lit(False).alias("inside")))
    each = pages.filter("host IS NOT NULL").select("host", "story", F.explode(F.concat("seen", every)).alias("of"))
    counts = stored(
        each.select("host", "story", "of.key", "of.inside").distinct().groupBy("host", "key", "inside").agg(F.count(F.lit(1)).alias("pages")),
        "site-counts")
    totals = counts.filter("key IS NULL").select("host", F.col("pages").alias("all_pages"))
    share = F.when(F.col("inside"), INSIDE_SHARE).otherwise(OUTSIDE_SHARE)
    often = counts.filter(f"key IS NOT NULL AND pages >= {TEMPLATE_PAGES}")
    return often.join(totals, "host").filter(F.col("pages") >= share * F.col("all_pages")).select("host", "key")


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.

    Pages are parsed once into elements and blocks of text.  Subtrees of elements are hashed (name, attributes, text, and the
    hashes of what they hold) and counted per host; where pages of at least five different stories hold the same one, and so
    large a share of the host's stories, it is the site's template and its blocks go.  Elements that are marked as asides by
    their name, role, class or id (menus, forms, notices, adverts, comments, ...), and headers outside articles, go however often they
    occur, since a host of few pages shows no recurrence; but not if the page's only article is in them.  Within an article or ``main``,
    paragraphs, headings, list items and cells stay however often they recur: pages may share passages or be copies of each other.

    What moves is one row of hashes for each subtree, host and story, combined in the tasks first.  Blocks' subtrees that a
    fixed-size sieve lets through are joined with the templates exactly; a second sieve tells the pages that lose blocks.  All others,
    usually most, are finished where they are, and no text of theirs is shuffled.

    Elements are ended as browsers do where end tags are missing; a tag that the end of the page cuts off is
    dropped.  Character references are decoded, white space within a block becomes one space, blocks are joined by line ends in the order
    of the page; ``br`` is white space.  Null and empty pages give an empty text; pages without a host (no URL) are not compared
    with others.  Repeated rows each count and are all returned, but pages of one story count once.  Elements
    nested deeper than 256 count as part of the one at that depth.  An empty table gives none.  Other columns are not read.
    """
    session(pages.sparkSession)
    host = F.nullif(F.lower(F.regexp_extract(F.col(url_column), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    given = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), host.alias("host"), F.col(html_column).cast("string").alias("html"))
    kinds = ", ".join(f"{c} {given.schema[c].dataType.simpleString()}" for c in ("page_id", "url", "host"))
    kept = stored(given.mapInArrow(parsed, PARSED.format(columns=kinds)), "site-pages")
    recurring = stored(templates(kept), "site-templates")
    bits = stored(fine_sieve(recurring.select(F.xxhash64("host", "key").alias("hash")), "hash"), "site-sieve").scalar()

    each = kept.select("page_key", "host", F.explode("around").alias("key")).filter(passes_fine(bits, F.xxhash64("host", "key")))
    lost = stored(each.join(recurring, ["host", "key"]).groupBy("page_key").agg(F.collect_list("key").alias("lost")), "site-lost")
    touched = stored(fine_sieve(lost.select(F.xxhash64("page_key").alias("hash")), "hash"), "site-sieve").scalar()

    may_lose = passes_fine(touched, F.xxhash64("page_key"))
    clear = kept.filter(~may_lose).select("page_id", "url", "blocks")
    stays = F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.coalesce("lost", F.array().cast("array<bigint>"))))
    cleaned = kept.filter(may_lose).join(lost, "page_key", "left").select("page_id", "url", stays.alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return clear.unionByName(cleaned).select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
