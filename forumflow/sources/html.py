"""HTML page scans as Spark jobs over a ``(id, html)`` table (S12-S14,
C10, C14, C15, W5, W7, F10).

Anchors and sections are ``regexp_extract_all`` / ``split`` / ``posexplode``
over a page. Table rows come from a tag tokenizer: a page becomes one row per
tag with the text behind it, and window sums over the tags keep the stack of
open tables, rows and paragraphs. All of it stays in the JVM; a page with very
many tags is sorted and spilled, never held as one list. Pages are dealt before
they become tags, into partitions by the bytes that their tags will take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumflow.functions.entities import decode_entities, decode_entity_arrays
from forumflow.functions.text import strip_all, strip_newlines
from forumflow.operators.dedup import keep_last
from forumflow.operators.joins import PART_BYTES, parts_for

# bytes that the row of a tag takes beside its text
TAG_BYTES = 128

ANCHOR_RE = r'<a href="([^"]*)">([^<]*)</a>'
# A tag, a comment or an element whose content is no markup; '>' in quoted
# attribute values does not end a tag.
TAG_RE = (r"(?is)<!--.*?(?:-->|\z)|<(?:script\b.*?</script|style\b.*?</style|template\b.*?</template)[^>]*+>"
          r"""|</?[a-z](?:=\s*+"[^"]*+"|=\s*+'[^']*+'|=|[^>=]++)*+>""")
# The first src attribute of a tag: other attributes are passed over whole.
SRC_RE = (r"""(?is)^<[a-z][^\s/>]*+(?:[\s/]++(?!src[\s=/>])[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+)*+"""
          r"""[\s/]++src\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""")
# Tags that end a row of the innermost table, besides <tr>, </tr> and the table's own; those that end a paragraph.
SECTION_TAGS = ["tbody", "thead", "tfoot"]
BLOCK_TAGS = ["table", "tr", "td", "th", "caption", *SECTION_TAGS, "address", "article", "aside", "blockquote", "center", "details", "dialog",
              "dir", "div", "dl", "dd", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
              "header", "hr", "li", "main", "menu", "nav", "ol", "pre", "section", "summary", "ul"]


def extract_pairs(df: DataFrame, id_col: str, html_col: str, pattern: str = ANCHOR_RE,
                  names: tuple[str, str] = ("href", "text")) -> DataFrame:
    """Every match of a two-group pattern, in page order:
    (id, ord, <names[0]>, <names[1]>)."""
    a = F.regexp_extract_all(F.col(html_col), F.lit(pattern), 1)
    b = F.regexp_extract_all(F.col(html_col), F.lit(pattern), 2)
    return (df.select(F.col(id_col), F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("ord", "__m"))
            .select(F.col(id_col), F.col("ord").cast("bigint").alias("ord"),
                    F.col("__m.a").alias(names[0]), F.col("__m.b").alias(names[1])))


def tag_bytes(df: DataFrame, html_col: str) -> int:
    """About the bytes of all tags' rows: the pages' text, and a fixed part per '<'."""
    html = F.col(html_col)
    size = F.octet_length(html) + TAG_BYTES * F.regexp_count(html, F.lit("<"))
    return df.agg(F.sum(size.cast("bigint")).alias("size")).first()["size"] or 0


def page_tags(df: DataFrame, id_col: str, html_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, __page, pos, name, closes, src, text): a page's tags in order from 1, and the decoded text behind each.

    Names are lower case; comments and script-like elements have none."""
    pages = df.select(F.col(id_col), F.col(html_col).alias("__html"), F.monotonically_increasing_id().alias("__page"))
    n = parts_for(tag_bytes(pages, "__html"), part_bytes)
    if n > 1:
        pages = pages.repartition(n, "__page")
    tags = F.regexp_extract_all("__html", F.lit(TAG_RE), 0)
    texts = F.split("__html", TAG_RE, -1)
    rows = pages.select(id_col, "__page", F.posexplode(F.arrays_zip(
        tags.alias("tag"), F.slice(texts, F.lit(2), F.size(tags)).alias("text"))).alias("pos", "__t"))
    name = F.lower(F.regexp_extract("__t.tag", r"^</?([a-zA-Z][^\s/>]*)", 1))
    src = F.concat(*[F.regexp_extract("__t.tag", SRC_RE, g) for g in (1, 2, 3)])
    out = rows.select(id_col, "__page", (F.col("pos") + 1).alias("pos"),
                      F.when(name.isin("script", "style", "template"), F.lit("")).otherwise(name).alias("name"),
                      F.startswith("__t.tag", F.lit("</")).alias("closes"),
                      F.when(name == "img", src).alias("src"), F.col("__t.text").alias("text"))
    return out.withColumn("src", decode_entities("src")).withColumn("text", decode_entities("text"))


def table_rows(df: DataFrame, id_col: str, html_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, ord, level, src, text, first_p): every row of every table, ``ord`` from 0 by its place in the page.

    ``level`` is the number of tables around the row, ``src`` the address of the
    first image below it (empty if it has none), ``text`` all text below it,
    ``first_p`` that of its first paragraph (null without one). What is below a
    row includes tables inside it, whose rows are listed too. A row ends at its
    end tag, at the next row, section or end of its table, or with the page; an
    end tag without a table is none.
    """
    tags = page_tags(df, id_col, html_col, part_bytes)
    up = Window.partitionBy("__page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("name") == "table", F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    tags = tags.withColumn("__sum", F.sum(step).over(up))
    tags = tags.withColumn("depth", F.col("__sum") - F.least(F.min("__sum").over(up), F.lit(0)))
    before = F.coalesce(F.lag("depth").over(Window.partitionBy("__page").orderBy("pos")), F.lit(0))
    # the table that a tag speaks of: an end tag still belongs to the table that it closes
    tags = tags.withColumn("own", F.greatest("depth", before))
    is_tr, is_end = F.col("name") == "tr", F.col("name").isin("table", *SECTION_TAGS)
    row_event = F.when(is_tr & ~F.col("closes") & (F.col("own") > 0), F.col("pos")).when(is_tr | is_end, F.lit(-1))
    # an end tag other than </p> only ends a paragraph if it is a block's
    p_event = F.when((F.col("name") == "p") & ~F.col("closes"), F.col("pos")).when(F.col("name").isin("p", *BLOCK_TAGS), F.lit(-1))
    tags = (tags.withColumn("__row_event", row_event).withColumn("p", F.last(p_event, ignorenulls=True).over(up))
            .withColumn("__tr", F.sum(F.when(F.col("__row_event") > 0, 1).otherwise(0)).over(up) - 1))
    # a tag lies in a row of each table around it
    per_table = (tags.where("own > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))))
                 .withColumn("__row_event", F.when(F.col("level") == F.col("own"), F.col("__row_event"))))
    here = Window.partitionBy("__page", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = per_table.withColumn("row", F.last("__row_event", ignorenulls=True).over(here)).where("row > 0 and level <= depth")
    image = F.when(F.col("name") == "img", F.struct("pos", F.coalesce("src", F.lit("")).alias("src")))
    first_p = F.min(F.when((F.col("name") == "p") & ~F.col("closes"), F.col("pos")))
    rows = inside.groupBy(id_col, "__page", "level", "row").agg(
        F.min("__tr").cast("bigint").alias("ord"), F.min(image).alias("__img"), first_p.alias("__p"),
        F.sort_array(F.collect_list(F.struct("pos", "p", "text"))).alias("__texts"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), "")
    return rows.select(
        id_col, "ord", "level", F.coalesce("__img.src", F.lit("")).alias("src"), joined(F.col("__texts")).alias("text"),
        F.when(F.col("__p").isNotNull(), joined(F.filter("__texts", lambda x: x["p"] == F.col("__p")))).alias("first_p"))


def extract_table_rows(df: DataFrame, id_col: str, html_col: str, scheme: str | None = None,
                       two_line: bool = False) -> DataFrame:
    """Table rows whose first image has an address.

    * awards (``two_line=False``): title = text of the first ``<p>`` as is; a row without one is no award;
    * trophies (``two_line=True``): the row text with leading and trailing
      newlines stripped (C13), split on newlines; title = line 0,
      description = line 1 if there is one (even if empty), else line 0
      (C14); ``scheme`` is prefixed to the image link (C15, 'https:').
    A row of an inner table is also found from each table around that, and is
    listed as often. Output: (id, ord, title, description, image_link).
    """
    rows = table_rows(df, id_col, html_col).where("src <> ''").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("level"))))
    link = F.concat(F.lit(scheme), F.col("src")) if scheme else F.col("src")
    if two_line:
        lines = F.split(strip_newlines("text"), r"\n")
        title = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        desc = F.coalesce(F.get(lines, F.lit(1)), title)
    else:
        rows = rows.where(F.col("first_p").isNotNull())
        title = F.col("first_p")
        desc = F.lit(None).cast("string")
    return (rows.select(id_col, "ord", title.alias("title"), desc.alias("description"), link.alias("image_link"))
            .sortWithinPartitions(id_col, "ord"))


def extract_sections(df: DataFrame, id_col: str, html_col: str, heading_re: str, item_re: str,
                     heading_group: int = 1, item_group: int = 0, strip_token: str | None = None,
                     decode: bool = True) -> DataFrame:
    """Each heading owns the items found before the next
    heading; items before the first heading belong to none; a heading that
    repeats within a page *replaces* its earlier list (last wins).

    ``heading_re`` must not consume text after the heading marker; the page
    is split on a lookahead of it. Output: (id, section, items ARRAY<STRING>).
    """
    chunks = (df.select(F.col(id_col), F.posexplode(F.split(F.col(html_col), f"(?={heading_re})"))
                        .alias("__pos", "__chunk"))
              .withColumn("__head", F.regexp_extract(F.col("__chunk"), f"^(?:{heading_re})", heading_group))
              .where(F.regexp_extract(F.col("__chunk"), f"^({heading_re})", 0) != ""))
    section = F.col("__head")
    if decode:
        section = decode_entities(section)
    if strip_token:
        section = strip_all(section, strip_token)
    items = F.regexp_extract_all(F.col("__chunk"), F.lit(item_re), item_group)
    out = chunks.select(F.col(id_col), section.alias("section"), F.col("__pos"), items.alias("items"))
    if decode:
        out = out.withColumn("items", decode_entity_arrays("items"))
    return keep_last(out, [id_col, "section"], "__pos").drop("__pos")
