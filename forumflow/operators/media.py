"""Media classification (M0-M7), resolution helpers (A1-A4), surrogate ids
(X5) and the flat ``media_assets`` table.

One ``CASE WHEN`` waterfall decides ``_type``; the branch order *is* the
semantics (first match wins). Every branch builder is a native higher-order
expression (``transform`` / ``filter`` / ``array_sort``) evaluated per row in
the JVM next to the scan: no Python, no shuffle, no explode/re-group of the
nested arrays.

The expressions are generated as SQL text and handed to the JVM in one
``F.expr`` call each: the same plan as building them node by node through
the Column API, without thousands of Python-to-JVM round trips per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, MapType, StringType,
                               StructField, StructType)

from forumflow.functions.urls import clean_url_sql

# Host prefixes the classification depends on.
PERMALINK_HOST = "https://www.reddit.com"
DIRECT_IMAGE_HOST = "https://i.redd.it"

RES = StructType([StructField("height", IntegerType()), StructField("width", IntegerType()),
                  StructField("url", StringType())])
P_ITEM = StructType([StructField("x", IntegerType()), StructField("y", IntegerType()),
                     StructField("u", StringType())])
S_ITEM = StructType([StructField("x", IntegerType()), StructField("y", IntegerType()),
                     StructField("u", StringType()), StructField("gif", StringType())])
META = StructType([
    StructField("e", StringType()), StructField("p", ArrayType(P_ITEM)), StructField("s", S_ITEM),
    StructField("x", IntegerType()), StructField("y", IntegerType()),
    StructField("hlsUrl", StringType()), StructField("dashUrl", StringType()),
])
VIDEO = StructType([
    StructField("hls_url", StringType()), StructField("dash_url", StringType()),
    StructField("fallback_url", StringType()), StructField("scrubber_media_url", StringType()),
    StructField("height", IntegerType()), StructField("width", IntegerType()),
])
PREVIEW_IMAGE = StructType([
    StructField("resolutions", ArrayType(RES)), StructField("source", RES),
    StructField("variants", StructType([
        StructField("gif", StructType([StructField("resolutions", ArrayType(RES))]))])),
])
POST_DETAIL = StructType([
    StructField("id", StringType()),
    StructField("permalink", StringType()), StructField("url", StringType()),
    StructField("url_overridden_by_dest", StringType()), StructField("is_gallery", BooleanType()),
    # kept as raw text per key: emptiness of the object is what the waterfall tests
    StructField("secure_media", MapType(StringType(), StringType())),
    StructField("preview", StructType([StructField("images", ArrayType(PREVIEW_IMAGE))])),
    StructField("media_metadata", MapType(StringType(), META)),
])



RES_DDL = "ARRAY<STRUCT<width:INT,height:INT,url:STRING>>"
VIDEO_DDL = ("STRUCT<hls_url:STRING,dash_url:STRING,fallback_url:STRING,scrubber_media_url:STRING,"
             "height:INT,width:INT>")


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class _Names:
    """Fresh lambda variable names, so nested lambdas never shadow."""

    def __init__(self):
        self.n = 0

    def __call__(self, base: str) -> str:
        self.n += 1
        return f"{base}{self.n}"


def _ne(x: str) -> str:
    """C17: present and non-empty (array or map)."""
    return f"coalesce(size({x}) > 0, false)"


def _sid(*parts: str) -> str:
    """Deterministic surrogate id (was a random uuid); parts are SQL."""
    return f"md5(concat_ws('|', {', '.join(f'CAST({p} AS STRING)' for p in parts)}))"


#: Columns that ``classify_media`` works with: every url of the payload with its
#: cleaned form, so that each is cleaned once by one expression, and the video.
_CLEAN, _VIDEO = "__clean_urls", "__video"


def _clean(u: str) -> str:
    """C5 of a url of the payload."""
    return f"coalesce(try_element_at({_CLEAN}, {u}), '')"


def cleaned_urls_sql(d: str) -> str:
    """Map from every url in the detail struct ``d`` to its cleaned form."""
    nm = _Names()
    fi, meta = f"get({d}.preview.images, 0)", f"map_values({d}.media_metadata)"
    x, y, p, u, k = (nm(n) for n in "xypuk")
    none = "array()"
    lists = [f"coalesce({fi}.resolutions.url, {none})", f"coalesce({fi}.variants.gif.resolutions.url, {none})",
             f"array({fi}.source.url, {_VIDEO}.hls_url, {_VIDEO}.dash_url, {_VIDEO}.fallback_url, {_VIDEO}.scrubber_media_url)",
             f"flatten(coalesce(transform({meta}, {x} -> concat(coalesce({x}.p.u, {none}), "
             f"array({x}.s.u, {x}.s.gif, {x}.hlsUrl, {x}.dashUrl))), {none}))"]
    urls = f"array_distinct(filter(concat({', '.join(lists)}), {u} -> {u} IS NOT NULL))"
    return f"get(transform(array({urls}), {k} -> map_from_arrays({k}, transform({k}, {y} -> {clean_url_sql(y)}))), 0)"


def _res(h: str, w: str, u: str) -> str:
    """A4: one resolution, url cleaned."""
    return f"named_struct('width', coalesce({w}, 0), 'height', coalesce({h}, 0), 'url', {_clean(u)})"


def _sorted_res(arr: str, nm: _Names, key: str = "height") -> str:
    """A1 + A2 + A4: stable sort by ``key`` (ties keep input order), drop
    blank urls, build each resolution."""
    x, i, s, v, r = nm("x"), nm("i"), nm("s"), nm("v"), nm("r")
    keyed = f"transform(coalesce({arr}, array()), ({x}, {i}) -> named_struct('k', {x}.{key}, 'i', {i}, 'v', {x}))"
    ordered = f"transform(array_sort({keyed}), {s} -> {s}.v)"
    kept = f"filter({ordered}, {v} -> coalesce({v}.url, '') <> '')"
    return f"transform({kept}, {r} -> {_res(f'{r}.height', f'{r}.width', f'{r}.url')})"


def _with_source(res: str, h: str, w: str, u: str) -> str:
    """A3: append the source last when it has a url."""
    return f"CASE WHEN coalesce({u}, '') <> '' THEN concat({res}, array({_res(h, w, u)})) ELSE {res} END"


def _gallery_item(v: str, nm: _Names) -> str:
    """M6 per id: p sorted by y (stable), blank u dropped, source appended."""
    x = nm("p")
    p = f"transform(coalesce({v}.p, array()), {x} -> named_struct('height', {x}.y, 'width', {x}.x, 'url', {x}.u))"
    return _with_source(_sorted_res(p, nm), f"{v}.s.y", f"{v}.s.x", f"{v}.s.u")


def _multi_item(v: str, nm: _Names) -> str:
    """M2 per entry: Image (p + s.u), AnimatedImage (p + s.gif), RedditVideo;
    other tags give NULL and are dropped by the caller."""
    x = nm("p")
    e = f"coalesce({v}.e, '')"
    p_res = f"transform(coalesce({v}.p, array()), {x} -> {_res(f'{x}.y', f'{x}.x', f'{x}.u')})"
    # an empty source object counts as none
    has = " OR ".join(f"{v}.s.{f} IS NOT NULL" for f in ("y", "x", "u", "gif"))
    img = f"CASE WHEN {has} THEN concat({p_res}, array({_res(f'{v}.s.y', f'{v}.s.x', f'{v}.s.u')})) ELSE {p_res} END"
    gif = f"CASE WHEN {has} THEN concat({p_res}, array({_res(f'{v}.s.y', f'{v}.s.x', f'{v}.s.gif')})) ELSE {p_res} END"
    is_vid = f"{e} = 'RedditVideo'"
    return (f"named_struct("
            f"'_type', CASE {e} WHEN 'Image' THEN 'image' WHEN 'AnimatedImage' THEN 'gif' WHEN 'RedditVideo' THEN 'video' END, "
            f"'resolutions', CASE {e} WHEN 'Image' THEN {img} WHEN 'AnimatedImage' THEN {gif} END, "
            f"'hlsUrl', CASE WHEN {is_vid} THEN {_clean(f'{v}.hlsUrl')} END, "
            f"'dashUrl', CASE WHEN {is_vid} THEN {_clean(f'{v}.dashUrl')} END, "
            f"'x', CASE WHEN {is_vid} THEN coalesce({v}.x, 0) END, "
            f"'y', CASE WHEN {is_vid} THEN coalesce({v}.y, 0) END)")


def media_type_sql(d: str) -> str:
    """The waterfall (M0-M7) over a parsed post-detail struct (SQL text)."""
    nm = _Names()
    permalink = f"concat({_q(PERMALINK_HOST)}, TRIM(TRAILING '/' FROM coalesce({d}.permalink, '')))"
    url_raw = f"coalesce({d}.url, '')"
    url = f"TRIM(TRAILING '/' FROM {url_raw})"
    override = f"TRIM(TRAILING '/' FROM coalesce({d}.url_overridden_by_dest, ''))"
    gallery_flag = f"coalesce({d}.is_gallery, false)"
    meta = f"{d}.media_metadata"
    has_meta, has_secure = _ne(meta), _ne(f"{d}.secure_media")
    first_img = f"get({d}.preview.images, 0)"
    has_preview = f"({d}.preview IS NOT NULL)"
    v = nm("v")
    n_tags = f"size(array_distinct(transform(map_values({meta}), {v} -> coalesce({v}.e, ''))))"
    has_video = f"coalesce(size(from_json({d}.secure_media['reddit_video'], 'MAP<STRING,STRING>')) > 0, false)"
    is_link = (f"({permalink} <> {url} AND {override} = {url} AND instr({url_raw}, {_q(DIRECT_IMAGE_HOST)}) = 0 "
               f"AND NOT {has_secure} AND NOT {has_meta} AND NOT {gallery_flag})")
    return (f"CASE WHEN {is_link} THEN 'link' "
            f"WHEN {has_meta} AND NOT {gallery_flag} AND {n_tags} >= 2 THEN 'multi' "
            f"WHEN {has_preview} AND {_ne(f'{first_img}.variants.gif.resolutions')} THEN 'gif' "
            f"WHEN {has_secure} AND {has_video} THEN 'video' "
            f"WHEN {has_preview} AND {_ne(f'{first_img}.resolutions')} THEN 'image' "
            f"WHEN {has_meta} THEN 'gallery' END")


def media_type_expr(d: Column | str) -> Column:
    """The waterfall as a Column; ``d`` names the parsed detail column."""
    if isinstance(d, Column):
        raise TypeError("pass the detail column by name")
    return F.expr(media_type_sql(_ident(d)))


def media_struct_sql(d: str, pid: str, t: str) -> str:
    """The tagged media struct for type ``t`` (SQL text over the columns that ``classify_media`` adds)."""
    nm = _Names()
    fi = f"get({d}.preview.images, 0)"
    img_res = _with_source(_sorted_res(f"{fi}.resolutions", nm), f"{fi}.source.height", f"{fi}.source.width",
                           f"{fi}.source.url")
    link = (f"named_struct('id', {_sid(pid, _q('link'))}, 'link', coalesce({d}.url, ''), "
            f"'image', named_struct('id', {_sid(pid, _q('link'), _q('image'))}, 'resolutions', "
            f"CASE WHEN {fi} IS NOT NULL THEN {img_res} ELSE CAST(array() AS {RES_DDL}) END))")
    image = f"named_struct('id', {_sid(pid, _q('image'))}, 'resolutions', {img_res})"
    gif = (f"named_struct('id', {_sid(pid, _q('gif'))}, 'resolutions', "
           f"{_sorted_res(f'{fi}.variants.gif.resolutions', nm)})")
    vid = _VIDEO
    video = (f"named_struct('id', {_sid(pid, _q('video'))}, "
             + ", ".join(f"'{f}', {_clean(f'{vid}.{f}')}"
                         for f in ("hls_url", "dash_url", "fallback_url", "scrubber_media_url"))
             + f", 'height', coalesce({vid}.height, 0), 'width', coalesce({vid}.width, 0))")
    entries = f"map_entries({d}.media_metadata)"
    en1, en2, en3, m, i = nm("en"), nm("en"), nm("en"), nm("m"), nm("i")
    gal_items = f"filter({entries}, {en1} -> {_ne(f'{en1}.value.p')})"
    # every resolution has the id that it has in ``media_assets``
    gj, gr, gi = nm("j"), nm("r"), nm("i")
    with_ids = (f"transform({_gallery_item(f'{en2}.value', nm)}, ({gr}, {gi}) -> named_struct('id', {_sid(pid, gj, gi)}, "
                f"'width', {gr}.width, 'height', {gr}.height, 'url', {gr}.url))")
    gallery = (f"named_struct('id', {_sid(pid, _q('gallery'))}, 'images', "
               f"transform({gal_items}, ({en2}, {gj}) -> {with_ids}))")
    multi_items = f"filter(transform({entries}, {en3} -> {_multi_item(f'{en3}.value', nm)}), {m} -> {m}._type IS NOT NULL)"
    mm = nm("m")
    multi = (f"transform({multi_items}, ({mm}, {i}) -> named_struct('id', {_sid(pid, _q('multi'), i)}, "
             f"'_type', {mm}._type, 'resolutions', {mm}.resolutions, 'hlsUrl', {mm}.hlsUrl, "
             f"'dashUrl', {mm}.dashUrl, 'x', {mm}.x, 'y', {mm}.y))")
    branch = lambda name, body: f"CASE WHEN {t} = '{name}' THEN {body} END"
    return (f"CASE WHEN {t} IS NOT NULL THEN named_struct('_type', {t}, "
            f"'link', {branch('link', link)}, 'image', {branch('image', image)}, 'gif', {branch('gif', gif)}, "
            f"'video', {branch('video', video)}, 'gallery', {branch('gallery', gallery)}, "
            f"'multi', {branch('multi', multi)}) END")


def classify_media(df: DataFrame, detail_col: str, post_id_col: str, out_col: str = "media",
                   type_col: str = "media_type") -> DataFrame:
    """Adds ``type_col`` (the waterfall result, cheap to filter on) and
    ``out_col``: the tagged media struct (SURVEY §1.3); both NULL for M7."""
    d, pid, t = _ident(detail_col), _ident(post_id_col), _ident(type_col)
    video = f"from_json({d}.secure_media['reddit_video'], {_q(VIDEO_DDL)})"
    return (df.withColumn(type_col, F.expr(media_type_sql(d)))
            .withColumn(_VIDEO, F.expr(f"CASE WHEN {t} IS NOT NULL THEN {video} END"))
            .withColumn(_CLEAN, F.expr(f"CASE WHEN {t} IS NOT NULL THEN {cleaned_urls_sql(d)} END"))
            .withColumn(out_col, F.expr(media_struct_sql(d, pid, t))).drop(_VIDEO, _CLEAN))


def media_assets(df: DataFrame, post_id_col: str, media_col: str = "media") -> DataFrame:
    """Flat (post_id, media_type, item_ord, res_ord, is_source, width, height,
    url, asset_id). The source is the appended last element where the branch
    appends one (link image, image, gallery items); ``source_flags`` supplies
    whether it was appended."""
    nm = _Names()
    m = _ident(media_col)
    t = f"{m}._type"

    def row(item_ord: str, r: str, i: str, is_src: str) -> str:
        return (f"named_struct('item_ord', {item_ord}, 'res_ord', {i}, 'is_source', {is_src}, "
                f"'width', {r}.width, 'height', {r}.height, 'url', {r}.url)")

    def single(res: str, has_source: str) -> str:
        r, i = nm("r"), nm("i")
        return f"transform({res}, ({r}, {i}) -> {row('0', r, i, f'({has_source} AND {i} = size({res}) - 1)')})"

    a, j, r, i = nm("a"), nm("j"), nm("r"), nm("i")
    gallery = (f"flatten(transform({m}.gallery.images, ({a}, {j}) -> transform({a}, ({r}, {i}) -> "
               f"{row(j, r, i, f'(coalesce(get(`__gal_src`, {j}), false) AND {i} = size({a}) - 1)')})))")
    x, j2, r2, i2, f = nm("x"), nm("j"), nm("r"), nm("i"), nm("f")
    # positions are those in ``multi``: numbered before entries without resolutions go
    multi = (f"flatten(filter(transform({m}.multi, ({x}, {j2}) -> "
             f"transform({x}.resolutions, ({r2}, {i2}) -> {row(j2, r2, i2, 'false')})), {f} -> {f} IS NOT NULL))")
    items = (f"CASE {t} WHEN 'link' THEN {single(f'{m}.link.image.resolutions', '`__src_flag`')} "
             f"WHEN 'image' THEN {single(f'{m}.image.resolutions', '`__src_flag`')} "
             f"WHEN 'gif' THEN {single(f'{m}.gif.resolutions', 'false')} "
             f"WHEN 'gallery' THEN {gallery} WHEN 'multi' THEN {multi} END")
    out = (df.select(F.col(post_id_col).alias("post_id"), F.expr(t).alias("media_type"),
                     F.explode(F.expr(items)).alias("__a"))
           .select("post_id", "media_type", "__a.*"))
    return out.withColumn("asset_id", F.expr(_sid("post_id", "item_ord", "res_ord")))


def source_flags(df: DataFrame, detail_col: str) -> DataFrame:
    """Adds ``__src_flag`` (single-list branches: preview source has a url)
    and ``__gal_src`` (per kept gallery item: its ``s`` has a url), the
    facts ``media_assets`` needs to mark the appended source."""
    nm = _Names()
    d = _ident(detail_col)
    en, en2 = nm("en"), nm("en")
    kept = f"filter(map_entries({d}.media_metadata), {en} -> {_ne(f'{en}.value.p')})"
    return (df.withColumn("__src_flag", F.expr(f"coalesce(get({d}.preview.images, 0).source.url, '') <> ''"))
              .withColumn("__gal_src", F.expr(f"transform({kept}, {en2} -> coalesce({en2}.value.s.u, '') <> '')")))
