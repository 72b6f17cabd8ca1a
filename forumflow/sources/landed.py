"""Landed-response scans.

Every fetch of the original tool wraps its payload in an envelope
``{key, payload | null, result_state{status_code, success, error}}``. Here
envelopes are JSON *lines* landed by any client (one record per line, so
the scan splits across tasks); payloads stay text until a typed
``from_json`` with an explicit schema parses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType,
                               StringType, StructField, StructType)

from forumflow.operators.joins import broadcast_if_small
from forumflow.operators.media import POST_DETAIL
from forumflow.session import cut_lineage

RESULT_STATE = StructType([
    StructField("status_code", IntegerType()), StructField("success", BooleanType()),
    StructField("error", StringType()),
])
ENVELOPE = StructType([
    StructField("endpoint", StringType()), StructField("key", StringType()),
    StructField("payload", StringType()), StructField("result_state", RESULT_STATE),
])
TOPIC_MAP = MapType(StringType(), ArrayType(StringType()))
REQUEST = StructType([StructField("title", StringType()), StructField("topic", StringType()),
                      StructField("posts_count", IntegerType())])
COMMUNITY_DATA = StructType([
    StructField(n, StringType()) for n in (
        "name", "display_name_prefixed", "subreddit_type", "public_description", "community_icon",
        "banner_img", "banner_background_image", "key_color", "primary_color", "banner_background_color")
] + [StructField("created_utc", DoubleType()), StructField("subscribers", LongType()),
     StructField("over18", BooleanType()), StructField("spoilers_enabled", BooleanType())])
COMMUNITY_ABOUT = StructType([StructField("data", COMMUNITY_DATA)])
COMMUNITY_SEARCH = StructType([StructField("data", StructType([StructField("children", ArrayType(StructType([
    StructField("data", StructType([StructField("subreddit_name_prefixed", StringType()),
                                    StructField("sr_detail", COMMUNITY_DATA)]))])))]))])
RULES = StructType([StructField("rules", ArrayType(StructType([
    StructField("short_name", StringType()), StructField("description", StringType())])))])
RICHTEXT = StructType([StructField(n, StringType()) for n in ("e", "t", "a", "u")])
FLAIRS = ArrayType(StructType([StructField("background_color", StringType()), StructField("text", StringType()),
                               StructField("richtext", ArrayType(RICHTEXT))]))
MODERATORS = StructType([StructField("data", StructType([StructField("children", ArrayType(StructType([
    StructField("id", StringType()), StructField("name", StringType())])))]))])
CROSSPOST = StructType([StructField("selftext", StringType()), StructField("selftext_html", StringType())])
POST_DATA = StructType([
    StructField(n, StringType()) for n in (
        "id", "title", "author", "author_fullname", "subreddit_name_prefixed", "subreddit_id",
        "link_flair_text", "author_flair_text", "selftext", "selftext_html")
] + [StructField("ups", LongType()), StructField("num_comments", LongType()),
     StructField("created_utc", DoubleType()), StructField("over_18", BooleanType()),
     StructField("spoiler", BooleanType()), StructField("crosspost_parent_list", ArrayType(CROSSPOST))])
POST_LISTING = StructType([StructField("data", StructType([StructField("children", ArrayType(StructType([
    StructField("data", POST_DATA)])))]))])
ARTICLE_POST = StructType([StructField("data", StructType([StructField("children", ArrayType(StructType([
    StructField("data", POST_DETAIL)])))]))])


def parse_once(df: DataFrame, payload, schema, out_col: str) -> DataFrame:
    """Add ``out_col`` = ``from_json(payload, schema)``, parsed exactly once.

    The struct leaves through a one-row generator (``inline``). A later
    filter on anything derived from it (media type, eligibility, ...) cannot
    be pushed below a generator's output, so the optimizer cannot inline the
    parse into the filter and parse every payload twice.
    """
    pc = F.col(payload) if isinstance(payload, str) else payload
    return df.select("*", F.inline(F.array(F.struct(F.from_json(pc, schema).alias(out_col)))))


# --------------------------------------------------------------------------
# envelopes
# --------------------------------------------------------------------------

def read_landed(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    """Envelope JSON lines; PERMISSIVE with a corrupt-record column."""
    schema = StructType(ENVELOPE.fields + [StructField("_corrupt_record", StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    if endpoint is not None:
        df = df.where(F.col("endpoint") == endpoint)
    return df


def envelope_ok(df: DataFrame) -> Column:
    """the response has a payload."""
    return F.col("payload").isNotNull()


def split_envelopes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok rows, rejects). A reject keeps key, status code and error text; a
    line that is no envelope keeps its text as the error."""
    error = F.col("result_state.error")
    if "_corrupt_record" in df.columns:
        error = F.coalesce(error, F.col("_corrupt_record"))
    ok = df.where(envelope_ok(df))
    rejects = df.where(~envelope_ok(df)).select(
        "endpoint", "key",
        F.coalesce(F.col("result_state.status_code"), F.lit(-1)).alias("status_code"),
        error.alias("error"))
    return ok, rejects


def envelope_state(df: DataFrame, payload: str = "payload") -> Column:
    """Per response: ``none`` without a payload, ``bad`` where the payload is no
    JSON of its endpoint's form, so that it would give no rows, else ``ok``.
    Other endpoints' payloads (pages) are always ``ok``."""
    p, e = F.col(payload), F.col("endpoint")
    form = lambda *paths: F.coalesce(*[F.get_json_object(p, x) for x in paths])
    need = {"community_about": form("$.data"), "community_search": form("$.data.children"), "rules": form("$.rules"),
            "moderators": form("$.data.children"), "post_listing": form("$.data.children"),
            "link_flairs": F.json_array_length(p), "user_flairs": F.json_array_length(p), "article": F.json_array_length(p)}
    bad = F.lit(False)
    for endpoint, found in need.items():
        bad = F.when(e == endpoint, found.isNull()).otherwise(bad)
    return F.when(~envelope_ok(df), "none").when(bad, "bad").otherwise("ok")


def rejects(df: DataFrame, state: str = "state") -> DataFrame:
    """The responses of ``df`` that are not ``ok``: key, status code and error text; a line that is no envelope and a
    payload that does not parse keep their text as the error."""
    error = F.col("result_state.error")
    if "_corrupt_record" in df.columns:
        error = F.coalesce(error, F.col("_corrupt_record"))
    error = F.when(F.col(state) == "bad", F.concat(F.lit("payload does not parse: "), F.col("payload"))).otherwise(error)
    return df.where(F.col(state) != "ok").select(
        "endpoint", "key", F.coalesce("result_state.status_code", F.lit(-1)).alias("status_code"), error.alias("error"))


def last_per_key(ok: DataFrame, place: str = "place") -> DataFrame:
    """Of several rows for one (endpoint, key), NULL keys included, the one with the greatest ``place``.

    Only keys and places are grouped; the payloads stay where they are and
    meet the (few) repeated keys, broadcast behind a check of their size."""
    last = ok.groupBy("endpoint", "key").agg(F.max(place).alias("__last"), F.count(F.lit(1)).alias("__n"))
    repeated = cut_lineage(last.where("__n > 1").select(F.col("endpoint").alias("__endpoint"), F.col("key").alias("__key"), "__last"))
    same = F.col("endpoint").eqNullSafe(F.col("__endpoint")) & F.col("key").eqNullSafe(F.col("__key"))
    return (ok.join(broadcast_if_small(repeated), same, "left")
            .where(F.col("__last").isNull() | (F.col("__last") == F.col(place))).drop("__endpoint", "__key", "__last"))


def payload_text(payload: str = "payload") -> Column:
    """A payload that is a JSON *string* (an HTML page) -> its text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), F.col(payload), F.lit("}")), "$.v")


def status_counts(df: DataFrame) -> DataFrame:
    """(endpoint, ok, n) - landing health per endpoint."""
    return (df.groupBy("endpoint", envelope_ok(df).alias("ok"))
            .agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------
# Topic maps and request lists
# --------------------------------------------------------------------------

def explode_topic_map(df: DataFrame, json_col: str) -> DataFrame:
    """JSON text ``{category: [topic, ...]}`` per row ->
    (category, ord, topic). Category is kept as an extra column."""
    m = F.from_json(F.col(json_col), TOPIC_MAP)
    return (df.select(F.explode(m).alias("category", "__topics"))
            .select("category", F.posexplode("__topics").alias("ord", "topic"))
            .withColumn("ord", F.col("ord").cast("bigint")))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic-map files. One whole file is one JSON object, so each file
    is one record (``wholetext``); topic maps are seed-sized."""
    return explode_topic_map(spark.read.text(path, wholetext=True), "value")


def read_topic_lines(spark: SparkSession, path: str) -> DataFrame:
    """S1 on what ``sinks.writers.write_topic_map`` wrote: one object ``{heading: [topic, ...]}`` per line."""
    return explode_topic_map(spark.read.text(path), "value")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """On-demand request list (a top-level JSON array becomes rows).
    ``ord`` is the list order: a multi-line JSON file is one partition, read
    in order, and files follow in listing order."""
    return (spark.read.schema(REQUEST).option("multiLine", "true").json(path)
            .withColumn("ord", F.monotonically_increasing_id()))


# --------------------------------------------------------------------------
# Payload parsers (column -> rows)
# --------------------------------------------------------------------------

def parse_community_about(df: DataFrame, payload: str = "payload") -> DataFrame:
    """About payload -> ``data`` struct (parsed once)."""
    return (parse_once(df, payload, COMMUNITY_ABOUT, "__about_env")
            .withColumn("__about", F.col("__about_env.data")).drop("__about_env"))


def explode_community_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    """S3: search payload -> one row per child with its position ``pos``."""
    ch = F.from_json(F.col(payload), COMMUNITY_SEARCH).getField("data").getField("children")
    return (df.select("*", F.posexplode(ch).alias("pos", "__child"))
            .withColumn("__title", F.col("__child.data.subreddit_name_prefixed"))
            .withColumn("__detail", F.col("__child.data.sr_detail")).drop("__child"))


def explode_rules(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(…, ord, short_name, description)."""
    r = F.from_json(F.col(payload), RULES).getField("rules")
    return (df.select("*", F.posexplode(r).alias("ord", "__r"))
            .select("*", F.col("__r.short_name").alias("short_name"),
                    F.col("__r.description").alias("description")).drop("__r"))


def parse_flairs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Flair payload -> ARRAY of flair structs in ``__flairs`` (parsed once)."""
    return parse_once(df, payload, FLAIRS, "__flairs")


def explode_moderators(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Moderator payload -> (…, ord, id, name)."""
    ch = F.from_json(F.col(payload), MODERATORS).getField("data").getField("children")
    return (df.select("*", F.posexplode(ch).alias("ord", "__m"))
            .select("*", F.col("__m.id").alias("mod_id"), F.col("__m.name").alias("mod_name")).drop("__m"))


def explode_post_listing(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Listing payload -> one row per post with its position ``pos``."""
    ch = F.from_json(F.col(payload), POST_LISTING).getField("data").getField("children")
    return df.select("*", F.posexplode(ch).alias("pos", "__child")).withColumn(
        "__post", F.col("__child.data")).drop("__child")


def split_article(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Article payload = two-element array. Element 0 holds the post
    detail (media), element 1 the comment roots. Only a non-empty list
    counts as found (``article_found``)."""
    parts = parse_once(df, payload, ArrayType(StringType()), "__parts")
    detail = F.get(F.from_json(F.get("__parts", 0), ARTICLE_POST).getField("data").getField("children"), 0)\
        .getField("data")
    roots = F.get_json_object(F.get("__parts", 1), "$.data.children")
    both = F.struct(F.coalesce(F.size("__parts") > 0, F.lit(False)).alias("article_found"),
                    detail.alias("__detail"), roots.alias("__roots"))
    return parts.select("*", F.inline(F.array(both))).drop("__parts")

