"""Model calls as a partitioned job, and the incremental parse around it."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import chain as chain_of

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stallbook.functions import text
from stallbook.operators.pages import first_wins
from stallbook.operators.responses import attach_metadata, split_events, validate_events
from stallbook.sources.scratch import discard, materialise, packed_parquet, step_settings
from stallbook.sources.tables import committed_parts

Extractor = tuple[str, Callable[[str], str]]
_OUT = "raw STRING, model STRING, parse_ms BIGINT, fallback_used BOOLEAN, error STRING"


#: prompts that one call gets when a model takes lists, and calls that a task has under way at once
BATCH, THREADS = 16, 4
#: calls that a thread takes at once, at most
SHARE = 64
#: prompts that are asked before their answers are committed, and waves of a call at most
WAVE, WAVES = 100_000, 32


def run_extractors(
    prompts: DataFrame, chain: Sequence[Extractor], batch: int = BATCH, threads: int = THREADS
) -> DataFrame:
    """Calls the models of ``chain`` in order until one answers.

    ``prompts`` has (listing_id, prompt). Each task sends its own rows, ``threads``
    calls at a time. A model with a method ``many`` gets lists of ``batch`` prompts and
    returns as many answers, None where it has none; any other gets one prompt at a time. A row
    whose models all fail keeps an empty answer and the last model's name.
    ``error`` names the models that failed and why; NULL when the first one answered.
    """
    models = list(chain)

    def asked(call: Callable[[str], str], part: list[str]) -> list[tuple[str | None, str, int]]:
        """(answer, error, milliseconds) of each prompt; a list that fails is asked one by one."""
        started = time.monotonic()
        if hasattr(call, "many") and len(part) > 1:
            try:
                answers = list(call.many(part))
                spent = max(1, int((time.monotonic() - started) * 1000 / len(part)))
                if len(answers) == len(part):
                    return [(a, "" if a is not None else "no answer", spent) for a in answers]
            except Exception:  # noqa: BLE001, S110 - each prompt has its own try below
                pass
            return [one for p in part for one in asked(call, [p])]
        try:
            raw = call.many(part)[0] if hasattr(call, "many") else call(part[0])
            return [(raw, "" if raw is not None else "no answer", max(1, int((time.monotonic() - started) * 1000)))]
        except Exception as e:  # noqa: BLE001 - any model error moves on to the next model
            return [(None, f"{type(e).__name__}: {e}", 0)]

    def answers(texts: list[str], pool: ThreadPoolExecutor) -> list[tuple[str, str, int, bool, str | None]]:
        out: list = [None] * len(texts)
        failed: list[list[str]] = [[] for _ in texts]
        for position, (name, call) in enumerate(models):
            open_ = [i for i, o in enumerate(out) if o is None]
            step = batch if hasattr(call, "many") else 1
            parts = [open_[i: i + step] for i in range(0, len(open_), step)]
            # a thread takes several calls at once, few enough that all threads end together
            share = max(1, min(SHARE, len(parts) // (4 * threads)))
            shares = [parts[i: i + share] for i in range(0, len(parts), share)]
            done = pool.map(lambda own: [asked(call, [texts[i] for i in part]) for part in own], shares)
            for part, found in zip(parts, chain_of.from_iterable(done)):
                for i, (raw, error, spent) in zip(part, found):
                    if raw is None:
                        failed[i].append(f"{name}: {error}")
                    else:
                        out[i] = (raw, name, spent, position > 0, "; ".join(failed[i]) or None)
        return [o or ("", models[-1][0], 0, True, "; ".join(f)) for o, f in zip(out, failed)]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                found = pd.DataFrame(
                    answers(frame["prompt"].tolist(), pool),
                    columns=["raw", "model", "parse_ms", "fallback_used", "error"], index=frame.index,
                )
                yield pd.concat([frame[["listing_id"]], found], axis=1)

    return prompts.select("listing_id", "prompt").mapInPandas(
        batches, "listing_id STRING, " + _OUT
    )


def ask(
    prompts: DataFrame, chain: Sequence[Extractor], log: str, wave: int = WAVE, **options
) -> DataFrame:
    """``run_extractors`` with a log under ``log`` (a shared folder), from which a run goes on after any failure.

    Prompts are asked in waves of about ``wave``, or of a WAVES-th of all if that is more: every wave
    is a job over the files of all prompts, so that their number must not grow with the prompts.
    The answers of a wave are committed before the next one begins. What the log holds for a listing and its
    prompt is not asked again: neither by a later call with the same log, nor after
    a run that died. A lost task repeats its share of one wave.
    """
    spark = prompts.sparkSession
    wanted = prompts.select("listing_id", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))
    schema = f"listing_id STRING, {_OUT}, prompt_hash STRING"

    def logged() -> DataFrame:
        paths = committed_parts(spark, log)
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    todo = wanted.join(logged(), ["listing_id", "prompt_hash"], "left_anti")
    attempt = f"{log}/attempt-{uuid.uuid4().hex}"
    waves = min(max(1, -(-todo.count() // wave)), WAVES)
    todo = todo.withColumn("wave", F.pmod(F.xxhash64("listing_id"), F.lit(waves)).cast("int"))
    with step_settings(spark):
        packed_parquet(todo).partitionBy("wave").save(attempt + "/todo")
    for number in range(waves):
        rows = spark.read.schema("listing_id STRING, prompt_hash STRING, prompt STRING, wave INT").parquet(attempt + "/todo").where(F.col("wave") == number)
        # a listing with two prompts has two answers
        keyed = rows.withColumn("listing_id", F.concat("prompt_hash", F.coalesce("listing_id", F.lit(""))))
        found = run_extractors(keyed, chain, **options)
        found = found.withColumns({"prompt_hash": F.substring("listing_id", 1, 64), "listing_id": F.expr("substring(listing_id, 65)")})
        with step_settings(spark):
            packed_parquet(found).save(f"{attempt}/answers={number}")
    discard(spark, attempt + "/todo")
    mine = wanted.select("listing_id", "prompt_hash").distinct()
    return logged().join(mine, ["listing_id", "prompt_hash"]).drop("prompt_hash")


def wanted_ads(ads: DataFrame) -> DataFrame:
    """Adverts worth a model call. Filters go before the Python stage: Spark
    does not push them through it."""
    title, body = F.col("title"), F.col("body")
    return ads.where(~text.is_category_page(title, body) & ~text.is_non_ticket(title, body))


def parse_new(
    ads: DataFrame,
    chain: Sequence[Extractor],
    venues: DataFrame,
    as_of: dt.date,
    folder: str,
    template: str = "{text}",
    log: str | None = None,
) -> DataFrame:
    """Newest copy of every advert → filter → context → models → split → validate → metadata.

    The answers are committed to ``log`` (``folder``/answers unless it is given) wave by
    wave and everything after reads them, so a model is asked once per advert, also
    over several runs with one log; the parsed events follow in
    ``folder``/events, so an answer is parsed once.
    """
    keep = wanted_ads(latest_ads(ads))
    context = text.build_context(F.col("title"), F.col("price_raw"), F.col("body"))
    # read by the count, the waves, the answers' join and the metadata: filtered and put together once
    kept = materialise(keep.withColumn("prompt", text.build_prompt(context, template)).drop("title", "body"), folder + "/prompts")
    answers = ask(kept, chain, log or folder + "/answers")
    events = materialise(answered_events(answers, chain, as_of), folder + "/events")
    return finish_events(events, kept, venues)


def answered_events(answers: DataFrame, chain: Sequence[Extractor], as_of: dt.date) -> DataFrame:
    """Stored answers → validated events."""
    structured = (F.col("model") == chain[0][0]) & ~F.col("fallback_used")
    return validate_events(split_events(answers.drop("error"), structured), as_of)


def finish_events(events: DataFrame, ads: DataFrame, venues: DataFrame) -> DataFrame:
    """Adds the advert's columns and the version. ``events`` should be stored: it is read twice."""
    return attach_metadata(events, ads, venues).withColumn(
        "pipeline_version", F.lit("v2.0")
    ).drop("raw")


def parse_incremental(
    ads: DataFrame,
    store: DataFrame,
    chain: Sequence[Extractor],
    venues: DataFrame,
    as_of: dt.date,
    folder: str,
    template: str = "{text}",
    full_refresh: bool = False,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events of all adverts, store entries to add).

    ``store(listing_id, events ARRAY<STRUCT>)`` keeps one entry per parsed
    advert, empty ones included, so a filtered advert is not looked at twice.
    Copies of an advert count once, its newest version. Answers are stored under ``folder``.
    ``ads`` and ``store`` are read three times: hand in stored tables where they are dear.
    """
    todo = ads if full_refresh else ads.join(store.select("listing_id"), "listing_id", "left_anti")
    fresh = parse_new(todo, chain, venues, as_of, folder, template, log)
    columns = [c for c in fresh.columns if c != "listing_id"]
    # an advert yields a handful of events; its own answer bounds the list
    lists = fresh.groupBy("listing_id").agg(
        F.array_sort(F.collect_list(F.struct("event_no", *[c for c in columns if c != "event_no"])))
        .alias("events")
    )
    entries = todo.select("listing_id").distinct().join(lists, "listing_id", "left").withColumn(
        "events", F.coalesce("events", F.array().cast(lists.schema["events"].dataType))
    )
    if full_refresh:
        return explode_entries(entries), entries
    cached = store.join(ads.select("listing_id"), "listing_id", "left_semi")
    return explode_entries(cached.unionByName(entries)), entries


def explode_entries(entries: DataFrame) -> DataFrame:
    return entries.select("listing_id", F.explode("events").alias("e")).select("listing_id", "e.*")


def latest_ads(ads: DataFrame) -> DataFrame:
    """Last stored version of every advert."""
    return first_wins(ads, ["listing_id"], F.col("scraped_at").desc())
