"""Seeded enrichment (X1-X6, J8), re-aimed from unseeded random fabrication.

Every value is a function of (key, salt) through md5, so reruns and other
engines give the same answer. The first 8 hex digits of md5 read as an
unsigned 32-bit integer are the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from forumflow.functions.text import age_years, shifted_date
from forumflow.operators.joins import BROADCAST_MAX_BYTES, measure


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seed32(key, salt: str, offset: int = 1) -> Column:
    """Unsigned 32-bit seed from hex digits [offset, offset+8) of md5(key||salt)."""
    h = F.md5(F.concat(_c(key).cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, offset, 8), 16, 10).cast("bigint")


def seeded_int(key, salt: str, lo: int, hi: int) -> Column:
    """Integer in [lo, hi]."""
    return F.lit(lo).cast("bigint") + F.pmod(seed32(key, salt), F.lit(hi - lo + 1).cast("bigint"))


def seeded_pick(key, salt: str, items: Column) -> Column:
    """One element of ``items`` (0-based pick by X1)."""
    return F.get(items, F.pmod(seed32(key, salt), F.size(items)).cast("int"))


def seeded_color(key, salt: str) -> Column:
    """X3: '#rrggbb' from md5 hex digits 1-6."""
    return F.concat(F.lit("#"), F.substring(F.md5(F.concat(_c(key).cast("string"), F.lit(salt))), 1, 6))


def seeded_color_pair(key, salt1: str, salt2: str) -> tuple[Column, Column]:
    """Two colors that must differ; on equality the second uses digits 7-12."""
    c1 = seeded_color(key, salt1)
    h2 = F.md5(F.concat(_c(key).cast("string"), F.lit(salt2)))
    c2a = F.concat(F.lit("#"), F.substring(h2, 1, 6))
    c2b = F.concat(F.lit("#"), F.substring(h2, 7, 6))
    return c1, F.when(c2a == c1, c2b).otherwise(c2a)


def seeded_sample(df: DataFrame, key: str, catalog: DataFrame, item_index: str, k: Column,
                  salt: str, out_col: str = "picks", max_k: int | None = None,
                  broadcast_max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """X4 + J8: ``k`` distinct catalog items per row, no cross join.

    The catalog carries a dense 0-based ``item_index``. Slot j (j < k) of a
    row takes index ``(start + j) mod n`` with a start seeded by the key, so
    the picks are distinct whenever k <= n; k is capped at n (the reference
    raises there).

    One join per slot, for as many slots as the largest k asks for (``max_k``
    states that bound and saves the aggregate; a row beyond it is an error).
    Rows are never regrouped, so repeated keys keep their own rows. A catalog
    within the size bound is broadcast; a larger one is joined by index, with
    the same rows.
    """
    n, size = measure(catalog)
    item_cols = [c for c in catalog.columns if c != item_index]
    item_type = ArrayType(StructType([catalog.schema[c] for c in item_cols]))
    if n == 0:
        return df.withColumn(out_col, F.array().cast(item_type))
    kk = F.least(k, F.lit(n))
    n_slots = max_k
    if max_k is None:
        n_slots = df.agg(F.max(kk).alias("m")).first()["m"] or 0
    else:
        kk = F.when(k > max_k, F.raise_error(F.lit(f"k is over max_k = {max_k}")).cast("int")).otherwise(kk)
    if n_slots <= 0:
        return df.withColumn(out_col, F.array().cast(item_type))
    cat = catalog.select(F.col(item_index).alias("__ci"), F.struct(*item_cols).alias("__item"))
    if size <= broadcast_max_bytes:
        cat = F.broadcast(cat)
    out = df.withColumn("__k", kk).withColumn("__start", seed32(F.col(key), salt))
    slots = []
    for j in range(n_slots):
        idx = F.when(F.lit(j) < F.col("__k"), F.pmod(F.col("__start") + F.lit(j), F.lit(n)))
        out = (out.withColumn(f"__i{j}", idx.cast("bigint"))
               .join(cat.withColumnRenamed("__ci", f"__c{j}").withColumnRenamed("__item", f"__p{j}"),
                     F.col(f"__i{j}") == F.col(f"__c{j}"), "left")
               .drop(f"__i{j}", f"__c{j}"))
        slots.append(F.col(f"__p{j}"))
    return (out.withColumn(out_col, F.filter(F.array(*slots), lambda x: x.isNotNull()))
            .drop("__k", "__start", *[f"__p{j}" for j in range(n_slots)]))


# Defaults of the fabricated profile columns; callers may pass their own.
AVATAR_BASE = "https://avatars.invalid/"
DESCRIPTIONS = ("Reads more than they post.", "Here for the long threads.", "Collects small facts.", "Asks before answering.")


def user_row(id_col: str, name_col: str, enrich: bool = False, as_of: int = 1_800_000_000,
             avatar_base: str = AVATAR_BASE, descriptions: Sequence[str] = DESCRIPTIONS) -> list[Column]:
    """User row from id + name. Fabricated columns only when ``enrich``;
    otherwise NULL. ``is_synthetic`` marks enriched rows. The banner is always
    empty; trophies are attached by the build (X4)."""
    k = F.col(id_col)
    cake = seeded_int(k, "cake", 1_136_073_600, 1_704_067_199)
    key_c, primary_c = seeded_color_pair(k, "key", "primary")
    fab = {"cake_day_utc": cake, "cake_day_human": shifted_date(cake), "age": age_years(cake, as_of),
           "avatar_img": F.concat(F.lit(avatar_base), F.md5(F.concat(k.cast("string"), F.lit("avatar"))), F.lit(".png")),
           "public_description": seeded_pick(k, "description", F.array(*[F.lit(d) for d in descriptions])),
           "keycolor": key_c, "primarycolor": primary_c, "iconcolor": seeded_color(k, "icon")}
    cols = [c.alias(n) if enrich else F.lit(None).cast("bigint" if n == "cake_day_utc" else "string").alias(n)
            for n, c in fab.items()]
    return [k.alias("id"), F.col(name_col).alias("name"), *cols, F.lit("").alias("banner_img"),
            F.lit(False).alias("over18"), F.lit(False).alias("suspended"), F.lit(enrich).alias("is_synthetic")]
