"""Key-based merges: overwrite, partial overwrite, insert-if-absent, coalesce.

The stored side may be huge. It is read once and never grouped: incoming rows are folded
to one per key and meet it in one join (a full outer one where new keys are added).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.operators.skew import latest_per_key

# fixed value: the source of transcripts stored before sources were recorded
FIRST_SOURCE = "supadata"


def one_per_key(new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest_per_key(new, keys, [F.col(c) for c in order])


def overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: the latest incoming row of a key replaces the stored row whole."""
    rest = [c for c in old.columns if c not in keys]
    both = _met(old, one_per_key(new, keys, order), keys, rest)
    row = F.coalesce("_new", "_old")
    return both.select(*[F.col(c) if c in keys else row[c].alias(c) for c in old.columns])


def _met(old: DataFrame, rows: DataFrame, keys: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """Stored and incoming rows of a key side by side; each side is read once."""
    packed = rows.select(*keys, F.struct(*rest).alias("_new"))
    return old.select(*keys, F.struct(*rest).alias("_old")).join(packed, list(keys), "full_outer")


def overwrite_columns(
    old: DataFrame, new: DataFrame, keys: Sequence[str], replaced: Sequence[str], order: Sequence[str],
    touched: dict[str, Column] | None = None,
) -> DataFrame:
    """Upsert that replaces some columns only; the others keep the first insert.

    ``touched``: columns set on rows that existed and were replaced.
    """
    rest, touched = [c for c in old.columns if c not in keys], touched or {}
    both = _met(old, one_per_key(new, keys, order), keys, rest)
    stored, hit = F.col("_old"), F.col("_new").isNotNull()

    def value(c: str) -> Column:
        before = F.when(hit, touched[c]).otherwise(stored[c]) if c in touched else (
            F.when(hit, F.col("_new")[c]).otherwise(stored[c]) if c in replaced else stored[c])
        return F.when(stored.isNull(), F.col("_new")[c]).otherwise(before).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored; the first of a key wins."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    first = first.select(key, *[F.col("_r")[c].alias(c) for c in rest]).select(*new.columns)
    return first.join(old.select(key), key, "left_anti")


def coalesce_merge(
    old: DataFrame, new: DataFrame, key: str, filled: Sequence[str], always: Sequence[str],
    stamped: dict[str, Column] | None = None, now: Column | None = None,
) -> DataFrame:
    """Update stored rows: ``filled`` columns keep the old value where the new one is
    null, ``always`` columns are taken as they come, ``stamped`` columns become ``now``
    where their condition (over the struct ``_new``) holds. ``new``: one row per key."""
    packed = new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("_new"))
    hit = F.col("_new").isNotNull()
    stamped = stamped or {}

    def value(c: str) -> Column:
        if c in always:
            return F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        if c in filled:
            return F.coalesce(F.col("_new")[c], F.col(c)).alias(c)
        if c in stamped:
            return F.when(hit & F.coalesce(stamped[c], F.lit(False)), now).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return old.join(packed, key, "left").select(*[value(c) for c in old.columns])


def first_source_wins(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in order of priority; the first source that has a key keeps it."""
    ranked = None
    for i, df in enumerate(sources):
        part = df.withColumn("_p", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in ranked.columns if c not in (key, "_p")]
    won = ranked.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("_r"))
    return won.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def evolve(df: DataFrame, added: dict[str, Column] | None = None, casts: dict[str, str] | None = None,
           dropped: Sequence[str] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """Schema steps in the order of a migration: add with default, widen, drop, rename."""
    new = {c: v for c, v in (added or {}).items() if c not in df.columns}
    df = df.withColumns(new) if new else df
    df = df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()}) if casts else df
    return df.drop(*dropped).withColumnsRenamed(renamed or {})


def union_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def backfill_transcripts(items: DataFrame) -> DataFrame:
    """Source and word count of transcripts stored before those columns existed."""
    has_text = F.length("transcript") > 0
    unmarked = has_text & F.col("transcript_source").isNull()
    count = F.size(F.split(F.trim("transcript"), r"\s+"))
    return items.withColumns({
        "transcript_is_generated": F.when(unmarked, True).otherwise(F.col("transcript_is_generated")),
        "transcript_source": F.when(unmarked, FIRST_SOURCE).otherwise(F.col("transcript_source")),
        "transcript_word_count": F.when(has_text & F.col("transcript_word_count").isNull(), count)
        .otherwise(F.col("transcript_word_count")),
    })


def split_legacy(videos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The former wide table as items, scores and raw events.

    ``videos``: youtube_id, url, title, channel, duration, tags (JSON text), score_letter,
    score_numeric, watched_at, created_at. Item ids are the natural key.
    """
    rest = [c for c in videos.columns if c != "youtube_id"]
    one = videos.groupBy("youtube_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", "title")).alias("r"))
    one = one.select("youtube_id", "r.*")
    tags = F.from_json(F.nullif("tags", F.lit("")), "array<string>")
    items = one.select(
        F.lit("youtube").alias("source"), F.col("youtube_id").alias("external_id"), "url", "title", "channel",
        F.col("duration").alias("duration_seconds"), tags.alias("tags"), "watched_at", "created_at")
    scores = videos.where("score_letter is not null").select(
        F.col("youtube_id").alias("external_id"), F.lit("1.0").alias("scorer_version"), "score_letter",
        "score_numeric", F.col("created_at").alias("scored_at"))
    scores = scores.join(items.select("external_id"), "external_id", "left_semi")
    at = F.coalesce("watched_at", "created_at")
    events = videos.select(
        at.alias("received_at"), F.lit("chrome_extension").alias("source"),
        F.to_json(F.struct(
            F.col("youtube_id").alias("video_id"), "title", "url", "channel",
            F.col("duration").alias("duration_seconds"))).alias("payload"))
    return items, scores, events


def latest_score(items: DataFrame, scores: DataFrame, key: str = "content_item_id") -> DataFrame:
    """Items with their latest score, null where never scored."""
    last = latest_per_key(scores, [key], [F.col("scored_at"), F.col("score_numeric")])
    return items.join(last, key, "left").withColumn("scoring_done", F.col("scored_at").isNotNull())
