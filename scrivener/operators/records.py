"""Record operators: ordered distinct, canonical merge, keyed writes, phrase matching, resolution.

Survivors are always chosen by an explicit order, never by arrival. "First" and "last" use min_by and max_by, which
pre-aggregate per task, so a key with very many rows is small before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as X


def _row(df: DataFrame) -> Column:
    return F.struct(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest order of each key."""
    return df.groupBy(*keys).agg(F.min_by(_row(df), order).alias("__r")).select("__r.*")


def last_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest order of each key."""
    return df.groupBy(*keys).agg(F.max_by(_row(df), order).alias("__r")).select("__r.*")


def in_order(ids: Sequence, df: DataFrame, key: str) -> DataFrame:
    """Rows of df for the ids, each once and in their order; unknown ids drop out."""
    wanted = list(dict.fromkeys(i.strip() if isinstance(i, str) else i for i in ids))
    places = df.sparkSession.createDataFrame([(i, p) for p, i in enumerate(wanted)], f"{key} {df.schema[key].dataType.simpleString()}, place int")
    return df.join(F.broadcast(places), key).orderBy("place")  # the list was given on the driver


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where a key is in both, the new row."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both; where a key is in both, the old row."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Delete what belongs to the scopes that new has rows of, then insert new."""
    return upsert(old, new, scope)


def delete_rows(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def keep_newest(df: DataFrame, group: Sequence[str], newest: Column, most: int) -> DataFrame:
    """The newest rows of each group; Spark limits each group per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(newest.desc()))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def snapshot_states(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Per key of either snapshot: active if in the new one, else missing."""
    both = old.select(key, F.lit(True).alias("was")).join(new.select(key, F.lit(True).alias("now")), key, "full")
    return both.select(key, F.when(F.col("now"), "active").otherwise("missing").alias("status"), F.col("was").isNull().alias("added"))


def completeness(fields: Sequence[str], lists: Sequence[str] = (), extra: Mapping[str, Column] | None = None) -> Column:
    """One per field that isn't blank and per list that isn't empty, and two per further condition."""
    score = F.lit(0)
    for f in fields:
        score = score + F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1).otherwise(0)
    for f in lists:
        score = score + F.when(F.exists(F.coalesce(F.col(f), F.array()), lambda x: F.trim(x) != ""), 1).otherwise(0)
    for condition in (extra or {}).values():
        score = score + F.when(condition, 2).otherwise(0)
    return score


def merge_groups(df: DataFrame, group: str, order: Column, scalars: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """One row per group: of each scalar the first that isn't blank, of each list the ordered union."""
    aggregates = [F.min_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", order)).alias(c) for c in scalars]
    # A group's lists are gathered: groups are copies of a record, and each element is kept once.
    for c in lists:
        ordered = F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col(c).alias("v"))))
        aggregates.append(F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["v"]))).alias(c))
    return df.groupBy(group).agg(*aggregates, F.count("*").alias("members"))


def quota(df: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= most)


def candidate_filter(df: DataFrame, tokens: Sequence[str], years: tuple[int, int] | None, least_metric: float | None, levels: Sequence[str], exempt: Column, text: Column, year: Column, metric: Column, level: Column) -> DataFrame:
    """Rows within the years, with a token of the query, and with metric and level unless exempt; adds relevance."""
    hits = F.lit(0)
    for t in tokens:
        hits = hits + F.when(F.contains(F.lower(text), F.lit(t)), 1).otherwise(0)
    keep = hits > 0
    if years:
        keep = keep & F.coalesce(year.between(*years), F.lit(False))
    if least_metric is not None:
        keep = keep & (exempt | F.coalesce(metric >= least_metric, F.lit(False)))
    if levels:
        known = level.isin([x for x in levels if x != "NONE"])
        keep = keep & (exempt | F.coalesce(known, F.lit(False)) | (F.coalesce(level, F.lit("")) == "" if "NONE" in levels else F.lit(False)))
    return df.filter(keep).withColumn("relevance", F.round(hits / len(tokens), 3))


def _grams(text: str, n: int) -> Column:
    """All runs of n characters; none in a shorter text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))


def longest_phrase(df: DataFrame, key: str, text: Column, phrases: DataFrame, phrase: str, order: str, words: bool = True, gram: int = 4) -> DataFrame:
    """Per row the longest phrase that the text contains, the first by order among equals; null without one.

    Texts and phrases are compared as words of letters and digits, and meet by an equi-join, whatever the number of
    phrases: with whole words on a phrase's first word, else on its first `gram` characters, or all of a shorter one.
    """
    pad = (lambda c: F.concat(F.lit(" "), X.catalog_key(c), F.lit(" "))) if words else X.catalog_key
    sought = phrases.select(pad(F.col(phrase)).alias("__p"), F.col(phrase).alias("__as"), F.col(order).alias("__o")).filter(F.trim("__p") != "")
    texts = df.select(key, pad(text).alias("__t"))
    if words:
        at = texts.select(key, F.explode(F.array_distinct(F.split(F.trim("__t"), " "))).alias("__w"))
        keyed = sought.withColumn("__w", F.split(F.trim("__p"), " ")[0])
    else:
        at = texts.select(key, F.explode(F.array_distinct(F.concat(*(_grams("__t", n) for n in range(1, gram + 1))))).alias("__w"))
        keyed = sought.withColumn("__w", F.substring("__p", 1, gram))
    # The texts meet their candidates once, on the key; they aren't carried with each word.
    maybe = at.join(keyed, "__w").select(key, "__p", "__as", "__o")
    best = maybe.join(texts, key).filter(F.contains("__t", "__p")).groupBy(key).agg(F.max_by("__as", F.struct(F.length("__p"), -F.col("__o"))).alias("matched"))
    return df.select(key).join(best, key, "left")


def resolve(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates (cand, self_id, id_key, doi_key, title_key) against known (id, doi_key, title_key): status, target, confidence.

    One match by id or DOI: resolved, 1.0; one by title: 0.9; the record itself: rejected; several: ambiguous, 0.4;
    none: candidate, 0.6. A key's smallest and largest id say whether it names one record or several, so a key that many
    share is one row on the side of the known, and pairs are never listed.
    """
    ways = []
    for i, (left, right) in enumerate((("id_key", "id"), ("doi_key", "doi_key"), ("title_key", "title_key"))):
        a = candidates.filter(F.col(left).isNotNull() & (F.col(left) != "")).select("cand", F.col(left).alias("k"))
        ids = F.struct("id")  # a known record without an id is one, too
        ends = known.groupBy(F.col(right).alias("k")).agg(F.min(ids).alias("low"), F.max(ids).alias("high"))
        ways.append(a.join(ends, "k").select("cand", "low", "high", F.lit(i).alias("way")))
    found = ways[0].unionByName(ways[1]).unionByName(ways[2])
    per = found.groupBy("cand").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("way").alias("way"))
    per = per.select("cand", F.when(F.col("low").eqNullSafe(F.col("high")), 1).otherwise(2).alias("n"), F.col("low.id").alias("target"), "way")
    out = candidates.select("cand", "self_id").join(per, "cand", "left")
    one = F.col("n") == 1
    status = F.when(F.col("n").isNull(), "candidate").when(one & (F.col("target") == F.col("self_id")), "rejected").when(one, "resolved").otherwise("ambiguous")
    confidence = F.when(status == "candidate", 0.6).when(status == "rejected", 0.0).when(status == "ambiguous", 0.4).when(F.col("way") < 2, 1.0).otherwise(0.9)
    return out.select("cand", status.alias("status"), F.when(one, F.col("target")).alias("target"), confidence.alias("confidence"))


def metadata_warnings(title: Column, year: Column, venue: Column, doi: Column, low: int = 1900, high: int = 2100, longest_venue: int = 200) -> Column:
    """What looks wrong with a record's texts, as an array of names."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    y, v, d = text(year), text(venue), text(doi)
    is_body = (F.length(v) > longest_venue) | F.contains(v, F.lit("\n"))
    checks = [
        F.when((y != "") & ~(y.rlike(r"^\d{4}$") & F.coalesce(y.try_cast("int").between(low, high), F.lit(False))), "year_out_of_range"),
        F.when(is_body, "venue_looks_like_body_text").when(v.rlike(r"^\p{Ll}"), "venue_may_be_truncated"),
        F.when((d != "") & ~d.rlike(r"^10\.\d{4,9}/\S+$"), "doi_format_invalid"),
        F.when(text(title) == "", "title_missing"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def overwrite(current: Column, new: Column, field: str, manual: Column) -> Column:
    """The new value unless a person set the field or the new value is blank."""
    may = ~F.coalesce(F.array_contains(manual, F.lit(field)), F.lit(False)) & (F.trim(F.coalesce(new, F.lit(""))) != "")
    return F.when(may | (F.trim(F.coalesce(current, F.lit(""))) == ""), F.coalesce(new, current)).otherwise(current)


def manifest_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Per key of either manifest: added, removed, changed or same."""
    both = old.select(key, F.col(version).alias("a"), F.lit(True).alias("was")).join(new.select(key, F.col(version).alias("b"), F.lit(True).alias("now")), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return both.select(key, change.alias("change"))


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids that aren't known: what a write must be refused for."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")
