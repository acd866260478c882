"""The enrichment queue: who is due, what an outcome means, when to try again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from contentgauge.functions.numbers import flag
from contentgauge.functions.text import contains_any, sql_list, strip

# fixed values
PERMANENT = ["ok", "no_subs", "geo_blocked", "unavailable", "exhausted"]
BACKOFF_MINUTES = [15, 60, 240, 1440]
RETRY_SECONDS, GIVE_UP_SECONDS = 90, 240
GEO_HINTS = ["not made this video available in your country", "not available in your country",
             "blocked it in your country", "geo restricted", "geo-restricted"]
GONE_HINTS = ["video unavailable", "private video", "has been removed",
              "account associated with this video has been terminated", "members-only",
              "this live event will begin"]
NO_SUBS_HINTS = ["transcriptsdisabled", "notranscriptfound", "subtitles are disabled", "no tiene subtítulos",
                 "sin subtítulos disponibles"]
SERVICE_STATUS = {"ok": "ok", "whisper_evitado": "no_subs", "vacio": "no_subs", "sin_creditos": "exhausted",
                  "rate_limit": "error", "sin_api_key": "error"}
NO_TEXT_MOTIVES = {"no_subs": "sin_subtitulos", "exhausted": "sin_creditos", "error": "error_de_transcripcion"}
TRACK_LANGUAGES = ["es", "es-419", "es-ES", "en", "en-US", "en-GB"]


def no_text(transcript: Column) -> Column:
    return transcript.isNull() | (F.length(transcript) == 0)


def due(items: DataFrame, now: Column, worker: bool = True, force: bool = False, ids: list[str] | None = None,
        limit: int | None = None) -> DataFrame:
    """Items to enrich; with a ``limit`` those never scheduled first, then by turn and age.

    The worker takes items without a transcript whose turn has come; the long run
    also takes items without description or status.
    """
    status = F.col("enrichment_status")
    open_ = status.isNull() | ~status.isin(PERMANENT)
    wanted = no_text(F.col("transcript"))
    if not worker:
        wanted = wanted | F.col("description").isNull() | status.isNull()
    condition = wanted & open_
    if worker:
        condition = condition & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    out = items if force else items.where(condition)
    if ids:
        out = out.where(F.col("external_id").isin(ids))
    out = out.withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    if not limit:  # a whole queue is left in any order: sorting it moves every row
        return out
    return out.orderBy(F.asc_nulls_first("next_attempt_at"), "created_at", "external_id").limit(limit)


def should_retry(transcript: Column, status: Column, last: Column, now: Column) -> Column:
    """No text, no lasting status, 90 seconds or more since the last try."""
    waited = (F.unix_micros(now) - F.unix_micros(last)) >= F.lit(RETRY_SECONDS * 1_000_000)
    blank = strip(F.coalesce(transcript, F.lit(""))) == ""
    return blank & (status.isNull() | (status == "error")) & F.coalesce(waited, F.lit(True))


def pending_panels(items: DataFrame, gold: DataFrame, corpus: str | None = None, limit: int | None = None) -> DataFrame:
    """Items with text and no gold row; with a ``limit`` the oldest."""
    rows = items.where(F.trim(F.coalesce("transcript", F.lit(""))) != "")
    if corpus:
        rows = rows.where(F.col("corpus") == corpus)
    rows = rows.join(gold.select(F.col("content_item_id").alias("id")), "id", "left_anti")
    return rows.orderBy("created_at", "id").limit(limit) if limit else rows


def permanent_failure(
    errors: Column, geo: Sequence[str] = GEO_HINTS, gone: Sequence[str] = GONE_HINTS, no_subs: Sequence[str] = NO_SUBS_HINTS,
) -> Column:
    """Why trying again is pointless: blocked region, gone, or no captions; else null. Hints in lower case."""
    text = F.lower(errors)
    return (
        F.when(contains_any(text, geo), "geo_blocked").when(contains_any(text, gone), "unavailable")
        .when(contains_any(text, no_subs), "no_subs")
    )


def outcome(has_meta: Column, has_text: Column, errors: Column, **hints: Sequence[str]) -> Column:
    lasting = F.when(~has_text, permanent_failure(errors, **hints))
    return (
        F.when(has_meta & has_text, "ok").when(lasting.isNotNull(), lasting)
        .when(has_meta | has_text, "partial").otherwise("failed")
    )


def schedule(status: Column, attempts: Column, now: Column) -> Column:
    """struct(status, attempts, next_attempt_at) after one more outcome."""
    tried = F.coalesce(attempts, F.lit(0)) + flag(status != "ok")
    waits = F.expr(f"array({', '.join(map(str, BACKOFF_MINUTES))})")
    minutes = F.get(waits, tried - 1)
    spent = ~status.isin(PERMANENT) & (tried > len(BACKOFF_MINUTES))
    final = F.when(spent, "exhausted").otherwise(status)
    then = now + F.make_dt_interval(mins=minutes)
    return F.struct(final.alias("status"), tried.alias("attempts"),
                    F.when(~final.isin(PERMANENT), then).alias("next_attempt_at"))


def postpone(next_at: Column, now: Column, hours: int) -> Column:
    return F.greatest(F.coalesce(next_at, now), now + F.make_dt_interval(hours=F.lit(hours)))


def stored_status(service_state: Column) -> Column:
    pairs = sql_list(x for item in SERVICE_STATUS.items() for x in item)
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), service_state), F.lit("error"))


def no_text_answer(status: Column, error: Column, created: Column, now: Column) -> Column:
    """struct(apto, motivo, estado): what to say about an item without text."""
    s = F.lower(F.coalesce(status, F.lit("")))
    limited = (s == "error") & F.startswith(F.coalesce(error, F.lit("")), F.lit("rate_limit"))
    pairs = sql_list(x for item in NO_TEXT_MOTIVES.items() for x in item)
    known = F.try_element_at(F.expr(f"map({pairs})"), s)
    old = F.coalesce((F.unix_micros(now) - F.unix_micros(created)) > F.lit(GIVE_UP_SECONDS * 1_000_000), F.lit(False))
    motive = F.when(limited, "limite_de_ritmo").when(known.isNotNull(), known).when(old, "enriquecimiento_incompleto")
    return F.struct(F.when(motive.isNotNull(), False).alias("apto"), motive.alias("motivo"),
                    F.when(motive.isNull(), "procesando").alias("estado"))


def duration_choice(stored: Column, api: Column) -> Column:
    """struct(segundos, discrepa): the API wins; flagged when off by over max(5, 5 %)."""
    given = F.nullif(api, F.lit(0))
    off = F.abs(given - F.nullif(stored, F.lit(0))) > F.greatest(F.lit(5.0), F.lit(0.05) * given)
    return F.struct(F.coalesce(given, stored).alias("segundos"), F.coalesce(off, F.lit(False)).alias("discrepa"))


def pick_track(tracks: DataFrame, item: str = "item", own: str = "own_language") -> DataFrame:
    """One caption track per item: manual before automatic; then the preference order;
    then a language with a preferred base; then any. ``tracks``: item, lang,
    is_generated, pos, own_language."""
    base = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    preferred = F.expr(f"array({sql_list(TRACK_LANGUAGES)})")
    own_base = base(F.coalesce(F.col(own), F.lit("")))
    at = F.nullif(F.array_position(preferred, F.col("lang")), F.lit(0))
    rank = F.coalesce(at, F.when((own_base != "") & (F.col("lang") == own_base), F.lit(len(TRACK_LANGUAGES) + 1)))
    same_base = base(F.col("lang")).isin("es", "en") | ((own_base != "") & (base(F.col("lang")) == own_base))
    tier = F.when(rank.isNotNull(), 0).when(same_base, 1).otherwise(2)
    order = F.struct("is_generated", tier, F.coalesce(rank, F.lit(0)), "pos")
    best = tracks.groupBy(item).agg(F.min_by(F.struct("lang", "is_generated", "pos"), order).alias("t"))
    return best.select(item, "t.lang", "t.is_generated", "t.pos")


def status_report(items: DataFrame, label: str = "(sin intentar)") -> DataFrame:
    return items.groupBy(F.coalesce("enrichment_status", F.lit(label)).alias("estado")).agg(
        F.count(F.lit(1)).alias("n"), F.max("attempts").alias("max_intentos"), F.min("next_attempt_at").alias("proximo_turno"))
