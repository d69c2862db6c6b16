"""Fuzzy event matching and multi-source verification."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stallbook import config
from stallbook.functions import jsons, scores
from stallbook.functions.casting import date_prefix, strict_date
from stallbook.functions.keys import name_tokens, strip, verification_key
from stallbook.operators.pages import first_wins

MATCH_COLUMNS = ("cand_name", "cand_seq", "name_score", "date_score", "city_score", "total")


def _city(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit(""))


# --- blocked similarity join over distinct names ---------------------------------


def _prefixes(names: DataFrame, frequency: DataFrame, min_score: float) -> DataFrame:
    """(key, tokens, prefix): the rarest tokens, enough to meet every partner.

    Two names with Jaccard >= t share at least s = ceil(t * n) tokens of either
    side, so at least one within the first n - s + 1 tokens of any order both
    sides agree on. Rarest first leaves the frequent words out.
    """
    ranked = (
        names.select("key", "tokens", F.explode("tokens").alias("token"))
        .join(frequency, "token", "left")
        .groupBy("key")
        .agg(
            F.first("tokens").alias("tokens"),
            # as many entries as the name has words
            F.array_sort(
                F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
            ).alias("ranked"),
        )
    )
    n = F.size("tokens")
    length = n - F.ceil(n * min_score - 1e-9).cast("int") + 1
    return ranked.select(
        "key", "tokens", F.slice(F.col("ranked.token"), F.lit(1), length).alias("prefix")
    )


def similar_names(
    left: DataFrame,
    right: DataFrame,
    min_score: float = config.MIN_NAME_SCORE,
) -> DataFrame:
    """(left_key, right_key, name_score) for all name pairs with Jaccard >= min_score.

    Inputs have one row per distinct name: ``key`` and its ``tokens``. Pairs
    meet on a shared prefix token of compatible size; a pair that meets on
    several is kept on the first only, so no ``distinct`` is needed.
    """
    if min_score <= 0:
        raise ValueError("blocking needs a positive minimum name score")
    frequency = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n")
    )

    def side(df: DataFrame, name: str) -> DataFrame:
        return _prefixes(df, frequency, min_score).select(
            F.col("key").alias(name + "_key"), F.col("tokens").alias(name + "_tokens"),
            F.col("prefix").alias(name + "_prefix"), F.explode("prefix").alias("token"),
        )

    nl, nr = F.size("left_tokens"), F.size("right_tokens")
    first_shared = F.get(F.array_intersect("left_prefix", "right_prefix"), F.lit(0))
    slack = 1e-9
    return (
        side(left, "left")
        .join(side(right, "right"), "token")
        .where((nr >= nl * min_score - slack) & (nl >= nr * min_score - slack))
        .where(first_shared == F.col("token"))
        .select(
            "left_key", "right_key",
            scores.token_jaccard(F.col("left_tokens"), F.col("right_tokens")).alias("name_score"),
        )
        .where(F.col("name_score") >= min_score)
    )


#: names of candidates that may have a word before it counts as frequent
RARE_NAMES = 64
#: frequent words of a name whose combinations are classes; its other words are looked up one by one
CLASS_WORDS = 6


def _class_key(words: Column, size: Column) -> Column:
    """Key of all names of ``size`` words that have these frequent words."""
    return F.concat(F.lit("\u0001"), F.array_join(F.array_sort(words), " "), F.lit("\u0001"), size.cast("string"))


def _subsets(words: Column) -> Column:
    """All combinations of the words, the empty one first."""
    none = F.array(F.array().cast("array<string>"))
    return F.aggregate(words, none, lambda sets, w: F.concat(sets, F.transform(sets, lambda x: F.concat(x, F.array(w)))))


def split_words(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """(key, tokens, common, single): a name's most frequent words, CLASS_WORDS at most, and all its others.

    ``single`` holds (token, rare); a word that is not rare is there only if the name has more
    frequent words than that. Words that no candidate has are left out.
    """
    ranked = names.select("key", "tokens", F.explode("tokens").alias("token")).join(frequency, "token").groupBy("key").agg(
        F.first("tokens").alias("tokens"),
        # as many entries as the name has words
        F.sort_array(F.collect_list(F.struct("n", "token")), asc=False).alias("ranked"),
    )
    frequent = F.filter("ranked", lambda r: r["n"] > RARE_NAMES)
    top = F.slice(frequent, 1, CLASS_WORDS)
    rest = F.filter("ranked", lambda r: ~F.array_contains(F.col("common"), r["token"]))
    return ranked.withColumn("common", F.transform(top, lambda r: r["token"])).select(
        "key", "tokens", "common",
        F.transform(rest, lambda r: F.struct(r["token"].alias("token"), (r["n"] <= RARE_NAMES).alias("rare"))).alias("single"),
    )


def bounded_pairs(left: DataFrame, right: DataFrame, min_score: float) -> DataFrame:
    """(left_key, right_key, name_score): pairs of names that share a rare word, and of names with classes.

    ``left`` and ``right`` come from ``split_words``. Two names either share a word that is looked up
    for one of them, and a rare word leads to RARE_NAMES names at most; or they share some of their
    frequent words only. Then the class of the candidates that have these words and are of that
    size stands for all of them, since they score alike. So rows stay in proportion to the names,
    however many of them follow one pattern. A class understates a pair that shares more words than it says;
    that pair is in a class of more words or in a looked-up one as well.
    """
    def side(names: DataFrame, name: str, which: Callable[[Column], Column]) -> DataFrame:
        words = F.concat(F.transform("common", lambda w: F.struct(w.alias("token"), F.lit(False).alias("rare"))), "single")
        return names.select(F.col("key").alias(f"{name}_key"), F.col("tokens").alias(f"{name}_tokens"), F.explode(which(words)).alias("w")).select(
            f"{name}_key", f"{name}_tokens", F.col("w.token").alias("token"))

    single, every = (lambda words: F.col("single")), (lambda words: words)
    over = lambda words: F.filter("single", lambda w: ~w["rare"])
    score = scores.token_jaccard(F.col("left_tokens"), F.col("right_tokens"))
    looked_up = side(left, "left", single).join(side(right, "right", every), "token").unionByName(
        side(left, "left", every).join(side(right, "right", over), "token"))
    named = looked_up.withColumn("name_score", score).where(F.col("name_score") >= min_score).select(
        "left_key", "right_key", "name_score").distinct()
    a, s = F.size("tokens"), F.size("words")
    largest = F.floor(s / min_score - a + s + 1e-9).cast("int")
    classes = (
        left.select("key", "tokens", F.explode(_subsets(F.col("common"))).alias("words")).where(s > 0)
        .withColumn("largest", largest).where(F.col("largest") >= s)
        .select("key", "words", a.alias("a"), F.explode(F.sequence(s, F.col("largest"))).alias("b"))
        .select(F.col("key").alias("left_key"), _class_key(F.col("words"), F.col("b")).alias("right_key"),
                (F.size("words") / (F.col("a") + F.col("b") - F.size("words"))).alias("name_score"))
    )
    return named.unionByName(classes)


def class_keys(right: DataFrame, min_score: float) -> DataFrame:
    """(right_key, group): a candidate name itself and the classes it is in."""
    b = F.size("tokens")
    sets = F.filter(_subsets(F.col("common")), lambda words: (F.size(words) > 0) & (F.size(words) >= b * min_score - 1e-9))
    groups = F.concat(F.array("key"), F.transform(sets, lambda words: _class_key(words, b)))
    return right.select(F.col("key").alias("right_key"), F.explode(groups).alias("group"))


def _contained(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) where the label occurs inside the text, by equality of substrings."""
    lengths = labels.agg(F.array_sort(F.collect_set(F.length("label"))).alias("lens")).scalar()
    size = F.length("text")
    pieces = F.flatten(
        F.transform(
            F.filter("_lens", lambda n: n <= size),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(F.col("text"), at, n)
            ),
        )
    )
    return (
        texts.withColumn("_lens", lengths)
        .select("text", F.explode(F.array_distinct(pieces)).alias("label"))
        .join(labels, "label")
        .select("text", "label")
    )


def city_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q_city, c_city, city_score) of equal or contained city names."""
    q = queries.select(_city(F.col("city")).alias("text")).where("text <> ''").distinct()
    c = candidates.select(_city(F.col("city")).alias("label")).where("label <> ''").distinct()
    inside = _contained(q, c).select(F.col("text").alias("q_city"), F.col("label").alias("c_city"))
    around = _contained(
        c.withColumnRenamed("label", "text"), q.withColumnRenamed("text", "label")
    ).select(F.col("label").alias("q_city"), F.col("text").alias("c_city"))
    score = F.when(F.col("q_city") == F.col("c_city"), 1.0).otherwise(0.5)
    return inside.union(around).distinct().withColumn("city_score", score)


def best_matches(
    queries: DataFrame,
    candidates: DataFrame,
    by: Sequence[str] = (),
    min_score: float = config.MIN_NAME_SCORE,
) -> DataFrame:
    """Best candidate per query (and per ``by`` value), out of one shared candidate table.

    queries(query_id, event_name, event_date, city), distinct;
    candidates(*by, event_name, event_date, city, cand_seq).

    The total depends on the name pair, on the date band and on the city only.
    So candidates collapse to the first one per name (or class of names, see
    ``bounded_pairs``), period of days and city, with and without date and city,
    and a query probes the periods and cities that score. A name with very many
    dates or copies, or very many names of one pattern, are never paired row by
    row. A class read without its date, its city or a further shared word
    understates a total; the class that states it is probed as well, so the
    maximum is exact.
    """
    if min_score <= 0:
        raise ValueError("blocking needs a positive minimum name score")
    by = list(by)
    q = queries.select(
        "query_id", "event_date", _city(F.col("city")).alias("q_city"),
        name_tokens(F.col("event_name")).alias("tokens"),
    ).withColumn("left_key", F.concat_ws(" ", "tokens")).where("left_key <> ''")
    c = candidates.select(
        *by, "event_name", "event_date", _city(F.col("city")).alias("c_city"), "cand_seq",
        name_tokens(F.col("event_name")).alias("tokens"),
    ).withColumn("right_key", F.concat_ws(" ", "tokens")).where("right_key <> ''")

    def names(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("key"), "tokens").distinct()

    offered = names(c, "right_key")
    frequency = offered.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    right = split_words(offered, frequency)
    pairs = bounded_pairs(split_words(names(q, "left_key"), frequency), right, min_score)

    band = config.DATE_BAND_DAYS
    any_period, any_city = F.lit(-(1 << 30)), F.lit("")

    def period(day: Column) -> Column:
        # the days within the band of a day lie in two periods at most
        return F.floor(F.unix_date(day) / (2 * band + 1)).cast("int")

    first = F.min_by("cand", F.col("cand.cand_seq")).alias("cand")
    once = c.groupBy(*by, "right_key", "event_date", "c_city").agg(
        F.min_by(F.struct("event_name", "cand_seq"), F.col("cand_seq")).alias("cand"))
    no_day = F.lit(None).cast("date")
    days = F.array_distinct(F.array(
        F.struct(any_period.alias("period"), no_day.alias("day")),
        F.struct(F.coalesce(period(F.col("event_date")), any_period).alias("period"), F.col("event_date").alias("day"))))
    classes = (
        once.join(class_keys(right, min_score), "right_key")
        .select(*by, "group", "cand", "c_city", F.explode(days).alias("d"))
        .select(*by, "group", "cand", "d.*", F.explode(F.array_distinct(F.array(any_city, F.col("c_city")))).alias("c_city"))
        .groupBy(*by, "group", "period", "c_city", "day").agg(first)
        # one entry a day of the period
        .groupBy(*by, "group", "period", "c_city").agg(F.collect_list(F.struct("day", "cand")).alias("days"))
        .withColumnRenamed("group", "right_key")
    )
    towns = city_pairs(queries, candidates).unionByName(
        q.select("q_city").distinct().select("q_city", any_city.alias("c_city"), F.lit(0.0).alias("city_score")))
    near = F.array(*[period(F.date_add("event_date", k)) for k in (-band, band)])
    periods = F.when(F.col("event_date").isNull(), F.array(any_period)).otherwise(
        F.array_distinct(F.concat(F.array(any_period), near)))
    probes = q.join(towns, "q_city").select(
        "query_id", "left_key", "event_date", "c_city", "city_score", F.explode(periods).alias("period"))

    def best_within(score: float, fits: Callable[[Column], Column]) -> Column:
        found = F.array_min(F.transform(F.filter("days", fits), lambda d: F.struct(d["cand"]["cand_seq"].alias("cand_seq"), d["cand"]["event_name"].alias("cand_name"))))
        return F.when(found.isNotNull(), F.struct(F.lit(score).alias("date_score"), found.alias("cand")))

    away = lambda d: F.abs(F.datediff(d["day"], F.col("event_date")))
    options = F.when(F.col("period") == any_period, F.array(best_within(0.0, lambda d: F.lit(True)))).otherwise(F.array_compact(F.array(
        best_within(1.0, lambda d: away(d) == 0), best_within(0.5, lambda d: (away(d) > 0) & (away(d) <= band)))))
    total = scores.weighted_total(F.col("name_score"), F.col("date_score"), F.col("city_score"))
    scored = (
        pairs.join(probes, "left_key")
        .join(classes, ["right_key", "period", "c_city"])
        .select("query_id", *by, "name_score", "city_score", F.explode(options).alias("o"))
        .select("query_id", *by, "o.cand.cand_name", "o.cand.cand_seq", "name_score", "o.date_score", "city_score")
        .withColumn("total", total)
    )
    return first_wins(
        scored.select("query_id", *by, *MATCH_COLUMNS), ["query_id", *by], F.col("total").desc(), F.col("cand_seq"),
        F.col("name_score").desc(), F.col("date_score").desc(), F.col("city_score").desc(),
    )


def match_own_candidates(
    queries: DataFrame,
    candidates: DataFrame,
    by: Sequence[str] = ("source",),
    min_score: float = config.MIN_NAME_SCORE,
) -> DataFrame:
    """Best candidate per query and source when every query has its own short list."""
    q = queries.select(
        "query_id", name_tokens(F.col("event_name")).alias("q_tokens"),
        F.col("event_date").alias("q_date"), F.col("city").alias("q_city"),
    )
    name = scores.token_jaccard(F.col("q_tokens"), name_tokens(F.col("event_name")))
    scored = (
        candidates.join(q, "query_id")
        .withColumn("name_score", name)
        .where(F.col("name_score") >= min_score)
        .withColumn("date_score", scores.date_score(F.col("q_date"), F.col("event_date")))
        .withColumn("city_score", scores.city_score(F.col("q_city"), F.col("city")))
        .withColumn(
            "total",
            scores.weighted_total(F.col("name_score"), F.col("date_score"), F.col("city_score")),
        )
        .select("query_id", *by, F.col("event_name").alias("cand_name"), *MATCH_COLUMNS[1:])
    )
    return first_wins(scored, ["query_id", *by], F.col("total").desc(), F.col("cand_seq"))


# --- stored source responses → candidates -------------------------------------------

Normaliser = Callable[[DataFrame], DataFrame]


def _candidates(
    responses: DataFrame, items: Column, limit: int | None, **columns: Column
) -> DataFrame:
    """Explodes a response's item list; ``pos`` is the position in it."""
    rows = responses.select("query_id", "query_name", "source", F.posexplode(items).alias("pos", "e"))
    if limit is not None:
        rows = rows.where(F.col("pos") < limit)
    return rows.select("query_id", "source", "pos", *[c.alias(k) for k, c in columns.items()])


def _e(path: str, type_name: str = "string") -> Column:
    return jsons.field(F.col("e"), path, type_name)


def _text(path: str) -> Column:
    return F.coalesce(_e(path), F.lit(""))


def _body_list(path: str) -> Column:
    return F.coalesce(
        F.try_variant_get(jsons.whole_json(F.col("body")), path, jsons.VARIANTS),
        F.array().cast(jsons.VARIANTS),
    )


def normalise_musicbrainz(r: DataFrame, limit: int | None = None) -> DataFrame:
    """Artists: a name and a score in percent, neither date nor city."""
    return _candidates(
        r, _body_list("$.artists"), limit,
        event_name=_text("name"), event_date=F.lit(None).cast("date"),
        venue=F.lit(None).cast("string"), city=F.lit(None).cast("string"),
        source_score=F.coalesce(_e("score", "double"), F.lit(0.0)) / 100,
    )


def normalise_wikidata(r: DataFrame, limit: int | None = None) -> DataFrame:
    return _candidates(
        r, _body_list("$.results.bindings"), limit,
        event_name=_text("itemLabel.value"), event_date=date_prefix(_e("dateLabel.value")),
        venue=F.lit(None).cast("string"), city=F.lit(None).cast("string"),
        source_score=F.lit(0.6),
    )


def normalise_songkick(r: DataFrame, limit: int | None = None) -> DataFrame:
    return _candidates(
        r, _body_list("$.resultsPage.results.event"), limit,
        event_name=_text("displayName"), event_date=strict_date(_e("start.date")),
        venue=_text("venue.displayName"), city=_text("venue.metroArea.displayName"),
        source_score=F.lit(0.7),
    )


def normalise_bandsintown(r: DataFrame, limit: int | None = None) -> DataFrame:
    """Dates of one artist: candidates carry the name that was asked for."""
    return _candidates(
        r, _body_list("$"), limit,
        event_name=F.col("query_name"), event_date=date_prefix(_e("datetime")),
        venue=_text("venue.name"), city=_text("venue.city"),
        source_score=F.lit(0.75),
    )


NORMALISERS: dict[str, Normaliser] = {
    "musicbrainz": normalise_musicbrainz,
    "wikidata": normalise_wikidata,
    "songkick": normalise_songkick,
    "bandsintown": normalise_bandsintown,
}


def normalise_responses(
    responses: DataFrame, normalisers: dict[str, Normaliser] | None = None, limit: int | None = None
) -> DataFrame:
    """responses(query_id, query_name, source, ok, body) → candidates.

    ``cand_seq`` is the position in the response, which is the tie order;
    ``limit`` keeps the first ones only (``config.CANDIDATES_PER_QUERY``).
    """
    parts = [
        fn(responses.where(F.col("ok") & (F.col("source") == source)))
        for source, fn in (normalisers or NORMALISERS).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if limit is not None:
        out = out.where(F.col("pos") < limit)
    return out.withColumnRenamed("pos", "cand_seq")


# --- status ------------------------------------------------------------------------


def verification_status(
    queries: DataFrame,
    answered: DataFrame,
    matches: DataFrame,
    as_of: dt.date,
    layers: Sequence[str] = config.VERIFICATION_SOURCES,
) -> DataFrame:
    """Status per query from the best match of every source.

    queries(query_id, event_name); answered(query_id, source) of the sources
    that responded; matches as from the matchers, with ``source``. Lists follow
    the layer order; the earlier layer wins a tie for the best match.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in layers]), F.col("source"))

    def in_order(c: Column) -> Column:
        return F.transform(F.array_sort(F.collect_set(c)), lambda s: s["source"])

    layer = F.struct(order.alias("at"), F.col("source"))
    confirmed = F.col("total") >= config.CONFIRM_SCORE
    checks = answered.groupBy("query_id").agg(in_order(layer).alias("sources_checked"))
    hits = matches.groupBy("query_id").agg(
        in_order(F.when(confirmed, layer)).alias("sources_confirmed"),
        F.min_by(
            F.when(
                confirmed,
                F.struct(
                    F.col("cand_name").alias("name"), "name_score", "date_score", "city_score",
                    "total", "source",
                ),
            ),
            F.when(confirmed, F.struct((-F.col("total")).alias("t"), order.alias("at"))),
        ).alias("best"),
    )
    none = F.array().cast("array<string>")
    sources = F.coalesce("sources_confirmed", none)
    local = F.array_contains(sources, "bandsintown")
    known = F.array_contains(sources, "musicbrainz") | F.array_contains(sources, "wikidata")
    status = (
        F.when(strip(F.coalesce("event_name", F.lit(""))) == "", config.SKIPPED)
        .when(F.size(F.coalesce("sources_checked", none)) == 0, config.FAILED)
        .when(local & known & (F.col("best.total") >= config.VERIFIED_SCORE), config.VERIFIED)
        .when((F.size(sources) >= 1) & (F.col("best.total") >= config.CONFIRM_SCORE), config.LIKELY)
        .otherwise(config.UNVERIFIED)
    )
    joined = queries.join(checks, "query_id", "left").join(hits, "query_id", "left")
    return (
        joined.withColumn("status", status)
        .withColumn("sources_checked", F.when(F.col("status") == config.SKIPPED, none)
                    .otherwise(F.coalesce("sources_checked", none)))
        .withColumn("sources_confirmed", F.when(F.col("status") == config.SKIPPED, none)
                    .otherwise(sources))
        .withColumn("best", F.when(F.col("status") != config.SKIPPED, F.col("best")))
        .withColumn("verif_on", F.lit(as_of))
    )


# --- result store with a lifetime ------------------------------------------------------
# verif_results(name_key, event_date, status, best, sources_checked, sources_confirmed, cached_on)


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return (a["name_key"] == b["name_key"]) & a["event_date"].eqNullSafe(b["event_date"])


def store_fresh(store: DataFrame, as_of: dt.date, ttl_days: int = config.VERIFICATION_TTL_DAYS) -> DataFrame:
    """Entries that still count: not older than the lifetime, the limit day included."""
    return store.where(F.col("cached_on") >= F.lit(as_of - dt.timedelta(days=ttl_days)))


def store_get(
    queries: DataFrame, store: DataFrame, as_of: dt.date, ttl_days: int = config.VERIFICATION_TTL_DAYS
) -> DataFrame:
    """queries(event_name, event_date, …) with the fresh entry as ``hit`` or NULL."""
    fresh = store_fresh(store, as_of, ttl_days)
    entry = F.struct("status", "best", "sources_checked", "sources_confirmed", "cached_on")
    q = queries.withColumn("name_key", verification_key(F.col("event_name")))
    e = fresh.select("name_key", "event_date", entry.alias("hit"))
    return q.join(e, _same_key(q, e), "left").select(*[q[c] for c in q.columns], e["hit"])


def store_put(store: DataFrame, results: DataFrame, as_of: dt.date) -> DataFrame:
    """Results replace the entries of their keys; the last of equal keys stays."""
    new = results.withColumn("cached_on", F.lit(as_of))
    last = first_wins(new, ["name_key", "event_date"], F.col("seq").desc()).drop("seq")
    old = store.join(last.select("name_key", "event_date"), _same_key(store, last), "left_anti")
    return old.unionByName(last)


def store_invalidate(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the entries of keys(event_name, event_date)."""
    k = keys.select(verification_key(F.col("event_name")).alias("name_key"), "event_date")
    return store.join(k, _same_key(store, k), "left_anti")


def store_purge(
    store: DataFrame, as_of: dt.date, ttl_days: int = config.VERIFICATION_TTL_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(what stays, a one-row count of what went)."""
    limit = F.lit(as_of - dt.timedelta(days=ttl_days))
    gone = store.agg(F.count_if(F.col("cached_on") < limit).alias("purged"))
    return store.where(F.col("cached_on") >= limit), gone


# --- write-back ---------------------------------------------------------------------------


def verification_columns(results: DataFrame) -> DataFrame:
    """The five listing columns of a result, keyed by listing id."""
    return results.select(
        "listing_id",
        F.col("status").alias("verif_status"),
        F.col("sources_confirmed").alias("verif_sources"),
        "verif_on",
        F.coalesce("best.name", F.lit("")).alias("verif_name"),
        F.round("best.total", 3).alias("verif_score"),
    )


def write_back(listings: DataFrame, results: DataFrame) -> DataFrame:
    """Listings with new verification columns where a result exists; one left join."""
    new = verification_columns(results).withColumnsRenamed(
        {c: "_n_" + c for c in config.VERIFICATION_COLUMNS}
    ).withColumn("_has", F.lit(True))
    joined = listings.join(new, "listing_id", "left")
    chosen = {
        c: F.when(F.col("_has"), F.col("_n_" + c)).otherwise(F.col(c))
        for c in config.VERIFICATION_COLUMNS
    }
    return joined.withColumns(chosen).select(*listings.columns)


def unknown_ids(listings: DataFrame, results: DataFrame) -> DataFrame:
    return results.select("listing_id").join(listings, "listing_id", "left_anti")


def unverified(listings: DataFrame) -> DataFrame:
    status = F.coalesce("verif_status", F.lit(""))
    return listings.where(
        F.col("listing_id").isNotNull() & ((strip(status) == "") | (status == config.UNVERIFIED))
    )
