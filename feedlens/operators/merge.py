"""Sinks as plans: each operator returns the new table (or the planned changes); writing it is a separate step.

Plain Parquet has no MERGE, so an upsert is two left joins and field-wise when(), and a delete is an anti join; the
caller writes the result (copy on write, or by partition with dynamic overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added and nulls replaced by the table's defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return table.unionByName(with_defaults(rows, defaults).select(*table.columns))


def sparse_update(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Only what an update carries (not null) replaces; rows without an update stay."""
    fields = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return table.join(u, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def latest(rows: DataFrame, key: list[str], order: Column, tie: str) -> DataFrame:
    """The last row of each key by order, ties by the largest tie column."""
    w = Window.partitionBy(*key).orderBy(order.desc(), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert_latest(table: DataFrame, rows: DataFrame, key: list[str], order: str, tie: str) -> DataFrame:
    """Incoming rows win over stored ones of the same key; among incoming rows the newest wins."""
    new = latest(rows, key, F.col(order), tie)
    return table.join(new.select(*key), key, "left_anti").unionByName(new.select(*table.columns))


REFRESHED = ("title", "link", "contentSnippet", "pubDate", "source", "feedId")
BACKFILLED = ("thumbnail", "contentSnippet")
SHORT_SNIPPET = 40


def keyed_merge(stored: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Articles merged by id, else by canonical link, with an `action` column.

    The last arrival of an id counts. A match by id refreshes metadata; a match by canonical link keeps the stored
    identity, topic, source and date and only fills a missing thumbnail or a snippet shorter than 40 characters;
    both replace the classification array where the new one is there. Of several incoming rows that meet one stored
    row by link the first arrival counts. Incoming rows that match nothing are inserted, one for each canonical link.
    """
    fields = stored.columns
    new = latest(incoming, ["id"], F.col(arrival), "id")
    by_id = new.join(stored.select("id"), "id", "left_semi")
    rest = new.join(stored.select("id"), "id", "left_anti")
    linked = F.col("canonicalLink").isNotNull() & (F.col("canonicalLink") != "")
    first = Window.partitionBy("canonicalLink").orderBy(arrival, "id")
    one = rest.where(linked).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").unionByName(rest.where(~F.coalesce(linked, F.lit(False))))
    owner = Window.partitionBy("canonicalLink").orderBy("createdAt", "id")
    owners = stored.where(linked).withColumn("_r", F.row_number().over(owner)).where("_r = 1").select("canonicalLink", F.col("id").alias("ownerId"))
    met = one.join(owners, "canonicalLink", "left")
    prefixed = lambda df, key, p: df.select(key, *[F.col(c).alias(f"{p}{c}") for c in fields if c != "id"])
    a = prefixed(by_id, "id", "i_").withColumn("_id", F.lit(True))
    b = prefixed(met.where("ownerId is not null").drop("id").withColumnRenamed("ownerId", "id"), "id", "c_").withColumn("_link", F.lit(True))
    old = stored.join(a, "id", "left").join(b, "id", "left")
    usable = lambda c: F.col(c).isNotNull() & (F.col(c) != "")

    def field(c: str) -> Column:
        kept = F.col(c)
        if c == "thumbnail":
            kept = F.when(~F.coalesce(usable(c), F.lit(False)) & usable("c_thumbnail"), F.col("c_thumbnail")).otherwise(kept)
        if c == "contentSnippet":
            kept = F.when((F.length(F.coalesce(c, F.lit(""))) < SHORT_SNIPPET) & usable("c_contentSnippet"), F.col("c_contentSnippet")).otherwise(kept)
        if c == "classifications":
            return F.coalesce("i_classifications", "c_classifications", "classifications")
        return F.when(F.col("_id"), F.coalesce(f"i_{c}", c)).otherwise(kept) if c in REFRESHED or c == "thumbnail" else kept

    action = F.when(F.col("_id"), "updated").when(F.col("_link"), "backfilled").otherwise("kept")
    merged = old.select("id", *[field(c).alias(c) for c in fields if c != "id"], action.alias("action"))
    fresh = met.where("ownerId is null").select("id", *[c for c in fields if c != "id"], F.lit("inserted").alias("action"))
    return merged.unionByName(fresh)


def array_merge(old: Column, new: Column) -> Column:
    """struct<value, changed>: a null update keeps; changed compares in order."""
    value = F.coalesce(new, old)
    return F.struct(value.alias("value"), (~value.eqNullSafe(old)).alias("changed"))


def replace_on_sync(table: DataFrame, batch: DataFrame, feed: str = "feedId", dated: str = "hasDate") -> DataFrame:
    """A feed's rows are replaced only if its batch holds at least one explicit date; else the batch is added."""
    certain = batch.groupBy(feed).agg(F.bool_or(dated).alias("_c")).where("_c").select(feed)
    return table.join(certain, feed, "left_anti").unionByName(batch.select(*table.columns))


def sync_matches(bridge: DataFrame, touched: DataFrame, strong: DataFrame) -> DataFrame:
    """For the touched articles the strong set becomes the whole set; other articles keep theirs."""
    return bridge.join(touched.select("articleId").distinct(), "articleId", "left_anti").unionByName(strong.join(touched.select("articleId").distinct(), "articleId", "left_semi").select(*bridge.columns))


def loggable(logs: DataFrame) -> DataFrame:
    """Poll logs worth keeping: errors, or polls that found something."""
    return logs.where("status = 'error' or newArticles > 0")


def cascade_delete(keys: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each child table without the rows of the deleted keys."""
    return {name: child.join(keys.select(F.col("id").alias(column)), column, "left_anti") for name, (child, column) in children.items()}


def seed_actions(current: DataFrame, desired: DataFrame, key: str, retired: DataFrame) -> DataFrame:
    """(key, action) of an idempotent seed: retire, create, update if anything differs, or skip; others are left alone."""
    fields = [c for c in desired.columns if c != key]
    c = current.select(key, F.struct(*fields).alias("c"))
    d = desired.select(key, F.struct(*fields).alias("d"))
    r = retired.select(key, F.lit(True).alias("r"))
    out = c.join(d, key, "full_outer").join(r, key, "left")
    action = F.when(F.col("r") & F.col("c").isNotNull(), "retire").when(F.col("d").isNull(), "keep").when(F.col("c").isNull(), "create").when(~F.col("c").eqNullSafe(F.col("d")), "update").otherwise("skip")
    return out.select(key, action.alias("action"))


def import_outcomes(rows: DataFrame, existing: DataFrame, key: str, order: str, valid: Column, most: int) -> DataFrame:
    """Each row with its outcome: invalid, a duplicate of a stored or earlier row, over the cap, or added; order is unique."""
    stored = existing.select(key, F.lit(True).alias("_s")).distinct()
    checked = rows.withColumn("_v", valid).join(stored, key, "left")
    same = Window.partitionBy("_v", key).orderBy(order)
    ranked = checked.withColumn("_n", F.row_number().over(same))
    fresh = F.col("_v") & F.col("_s").isNull() & (F.col("_n") == 1)
    # The cap is a top-k: its last row's place tells which rows come after it, without a running sum over all rows.
    last = ranked.where(fresh).orderBy(order).limit(most).agg(F.max(order).alias("_last"), (F.count("*") >= most).alias("_full"))
    counted = ranked.crossJoin(F.broadcast(last))
    beyond = F.col("_full") & F.coalesce(F.col(order) > F.col("_last"), F.lit(True))
    outcome = F.when(~F.col("_v"), "invalid").when(F.col("_s").isNotNull(), "duplicate_of_stored").when(F.col("_n") > 1, "duplicate_in_batch").when(beyond, "over_cap").otherwise("added")
    return counted.select(order, key, outcome.alias("outcome"))


def delete_plan(rows: DataFrame, reason: Column) -> DataFrame:
    """Candidates with a reason; nothing is removed."""
    return rows.withColumn("deleteReason", reason).where("deleteReason is not null")


def apply_delete(table: DataFrame, plan: DataFrame, expected: int | None = None, key: str = "id") -> DataFrame:
    """The table without the plan's rows; refuses a plan of another size than expected."""
    if expected is not None and (n := plan.count()) != expected:
        raise ValueError(f"the plan holds {n} rows, not {expected}")
    return table.join(plan.select(key), key, "left_anti")


def apply_consolidation(articles: DataFrame, plan: DataFrame, expected: int) -> DataFrame:
    """Marks the duplicates of a plan; refuses one whose count of duplicates isn't `expected`, the count that was shown to whoever
    approved it. Store the plan once and pass the stored rows: the count and the update then see the same."""
    duplicates = plan.where("isDuplicate")
    if (n := duplicates.count()) != expected:
        raise ValueError(f"the plan marks {n} duplicates, not {expected}")
    p = duplicates.select("id", F.col("primaryId").alias("_p"))
    return articles.join(p, "id", "left").withColumns({"isDuplicate": F.col("_p").isNotNull() | F.col("isDuplicate"), "duplicateOf": F.col("_p")}).drop("_p")


def catalog_import(catalog: DataFrame, feeds: DataFrame) -> DataFrame:
    """catalog (name, mode, url, and its order n) with outcome: imported, or why an entry is skipped: not_rss, no_url, existing.

    Only entries of mode rss with an address are feeds; of several with one address the first by n is imported, if no feed has it.
    """
    url = F.nullif(F.trim(F.coalesce("url", F.lit(""))), F.lit(""))
    rss = F.coalesce(F.lower(F.trim("mode")) == "rss", F.lit(False))
    there = feeds.select(F.trim("rssUrl").alias("_url")).where("_url is not null").distinct().withColumn("_there", F.lit(True))
    rows = catalog.withColumns({"_u": url, "_rss": rss}).join(there, F.col("_u") == F.col("_url"), "left")
    first = F.row_number().over(Window.partitionBy("_u", "_rss").orderBy("n"))
    outcome = F.when(~F.col("_rss"), "not_rss").when(F.col("_u").isNull(), "no_url").when(F.coalesce("_there", F.lit(False)) | (first > 1), "existing").otherwise("imported")
    return rows.withColumn("outcome", outcome).select(*[F.col(c) for c in catalog.columns], "outcome")


def legacy_feeds(feeds: DataFrame, catalog: DataFrame, prefix: str, region: str, names: tuple[str, ...]) -> DataFrame:
    """Feeds behind a proxy's prefix that are of a region: by their catalog entry (url, or path at the proxy), or where they have
    none by a token in their name."""
    path = F.lower(F.regexp_extract(F.coalesce("rssUrl", F.lit("")), "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))
    proxied = feeds.where(F.contains(F.coalesce("rssUrl", F.lit("")), F.lit(prefix))).withColumn("_keys", F.array(F.col("rssUrl"), path))
    entries = catalog.select("region", F.explode(F.array("url", F.lower("path"))).alias("_key")).where("coalesce(_key, '') != ''")
    held = proxied.select("id", F.explode("_keys").alias("_key")).join(entries, "_key").groupBy("id").agg(F.bool_or(F.lower("region") == region).alias("_here"))
    named = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower(F.coalesce("name", F.lit(""))), n))
    return proxied.join(held, "id", "left").where(F.coalesce("_here", named)).drop("_keys", "_here")


def mirror_plan(feeds: DataFrame, configured: DataFrame, apply: bool = False, prefix: str = "Mirror ") -> DataFrame:
    """(id, query, mirrorName, mirrorUrl, status): what to do about the mirror of each feed, and of each configured query (id, query).

    A feed's query is its name. A mirror that is there, by address before name, stays, or is to be made active again; a
    configured query that a feed has already plans nothing. Feeds named with the prefix are mirrors themselves.
    """
    comparable = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    own = feeds.where(~F.col("name").startswith(prefix)).select("id", comparable("name").alias("query"), F.lit(False).alias("repeated"))
    held = own.select("query", F.lit(True).alias("_held")).distinct()
    asked = configured.select("id", comparable("query").alias("query")).join(held, "query", "left").select("id", "query", F.coalesce("_held", F.lit(False)).alias("repeated"))
    wanted = own.unionByName(asked).withColumns({"mirrorName": F.concat(F.lit(prefix), "query"), "mirrorUrl": F.concat(F.lit("https://mirror.example.com/search?q="), F.url_encode("query"))})
    there = lambda c, k, v: feeds.groupBy(comparable(c).alias(k)).agg(F.bool_or("isActive").alias(v))
    met = wanted.withColumns({"_u": comparable("mirrorUrl"), "_n": comparable("mirrorName")}).join(there("rssUrl", "_u", "_url"), "_u", "left").join(there("name", "_n", "_name"), "_n", "left")
    again, fresh = ("pending_reactivate", "pending_create") if apply else ("would_reactivate_inactive", "would_create")
    status = F.when(F.coalesce("query", F.lit("")) == "", "skipped").when(F.col("repeated"), "already_planned_by_database_feed")
    for found, name in (("_url", "already_exists_by_url"), ("_name", "already_exists_by_name")):
        status = status.when(~F.col(found), again).when(F.col(found), name)
    return met.select("id", "query", "mirrorName", "mirrorUrl", status.otherwise(fresh).alias("status"))
