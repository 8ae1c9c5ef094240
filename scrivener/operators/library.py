"""Record, scope, tree and map operators: filters by capability, sync decisions, harvest rounds, facets, curation ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as X
from scrivener.session import Scratch

#: Titles that are sent to the texts; more of them are merged with what the texts have.
MOST_SENT = 50_000


def with_capabilities(df: DataFrame, wanted: Mapping[str, bool | None], **has: Column) -> DataFrame:
    """Rows whose capabilities are as wanted; one that isn't asked for may be either way."""
    keep = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            keep = keep & (F.coalesce(has[name], F.lit(False)) == value)
    return df.filter(keep)


def cleanup(df: DataFrame, key: str, has_file: Column, confirmed: DataFrame | None) -> DataFrame:
    """Rows without a file that may go: all of them, or of a confirmed list those in it."""
    without = df.filter(~F.coalesce(has_file, F.lit(False)))
    return without if confirmed is None else without.join(confirmed.select(key).distinct(), key, "left_semi")


def clamped(c: Column, low: float, high: float, default: float) -> Column:
    """A number between bounds; what isn't a number is the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(default))))


def one_of(c: Column, allowed: Sequence[str], default: str) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*allowed), low).otherwise(default)


def aliased(values: Column, aliases: Mapping[str, str]) -> Column:
    """An array's values by their alias, each once, in order; without the unknown ones."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.try_element_at(table, F.lower(F.trim(v)))), lambda v: v.isNotNull()))


def bound(facets: DataFrame, facet: str, ids: str, known: DataFrame, key: str) -> DataFrame:
    """Per facet its known ids, its unknown ones, and its role: required with a known one, else exploratory."""
    each = facets.select(facet, F.explode_outer(F.array_distinct(ids)).alias(key)).join(known.select(key, F.lit(True).alias("__ok")).distinct(), key, "left")
    per = each.groupBy(facet).agg(F.array_sort(F.collect_list(F.when(F.col("__ok"), F.col(key)))).alias("valid"), F.array_sort(F.collect_list(F.when(F.col("__ok").isNull(), F.col(key)))).alias("invalid"))
    return per.withColumn("role", F.when(F.size("valid") > 0, "required").otherwise("exploratory"))


def locators(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """relations (id, claim, score, evidence_ids), evidence (evidence_id, document): per evidence its document, relations,
    claims and best score."""
    each = relations.select("id", "claim", "score", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")).join(evidence, "evidence_id")
    return each.groupBy("evidence_id", "document").agg(F.array_sort(F.collect_set("id")).alias("relations"), F.array_sort(F.collect_set("claim")).alias("claims"), F.max("score").alias("score"))


def local_document(citations: DataFrame, documents: DataFrame, least: int = 12) -> DataFrame:
    """citations (citation, text, doi), documents (document, title, doi): the first document whose title, of `least` signs or
    more, stands in a citation's text as whole words, else one with its DOI.

    Distinct titles meet distinct texts by equality: a title's first words, as many as the largest power of two among its
    words, are looked for at every place of a text; where they stand, the words of each length that such titles have.

    Written texts and titles are much smaller on disk than in memory, so what grows with the tables is merged, where Spark would
    go by the files and send it through the driver. Few titles are sent to the texts.
    """
    scratch = Scratch(citations.sparkSession)
    titles = documents.select("document", X.catalog_key(F.col("title")).alias("__p")).filter(F.length("__p") >= least).groupBy("__p").agg(F.min("document").alias("document"))
    titles = titles.withColumn("__w", F.split("__p", " ")).withColumn("__n", F.size("__w")).withColumn("__half", F.expr("shiftleft(1, length(bin(__n)) - 1)"))
    titles = scratch.save(titles.select("document", "__p", "__n", "__half", F.xxhash64(F.slice("__w", F.lit(1), F.col("__half"))).alias("__h")))
    sent = F.broadcast if titles.count() <= MOST_SENT else lambda df: df.hint("merge")
    heads = titles.groupBy("__half", "__h").agg(F.collect_set("__n").alias("__lengths"))  # of a beginning, no more than it has words
    halves = sorted(r["__half"] for r in titles.select("__half").distinct().collect())
    texts = citations.select(X.catalog_key(F.col("text")).alias("__t")).filter("__t <> ''").distinct()
    texts = scratch.save(texts.withColumn("__id", F.monotonically_increasing_id()))

    def starts(p: int) -> Column:
        w = F.col("__w")
        run = lambda i: F.struct(F.lit(p).alias("half"), i.alias("at"), F.xxhash64(F.slice(w, i, F.lit(p))).alias("h"))
        return F.when(F.size(w) >= p, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - p + 1, F.lit(1))), run)).otherwise(F.array().cast("array<struct<half:int,at:int,h:bigint>>"))

    cut = texts.select("__id", F.split("__t", " ").alias("__w"))
    places = cut.select("__id", F.explode(F.flatten(F.array(*map(starts, halves or [1])))).alias("s")).select("__id", F.col("s.half").alias("__half"), F.col("s.at").alias("__at"), F.col("s.h").alias("__h"))
    runs = places.join(sent(heads), ["__half", "__h"]).select("__id", "__at", F.explode("__lengths").alias("__n"))
    of = runs.groupBy("__id").agg(F.collect_list(F.struct("__at", "__n")).alias("__r"))  # of one text
    words = of.join(cut.hint("merge"), "__id").select("__id", F.explode(F.array_distinct(F.transform("__r", lambda r: F.array_join(F.slice("__w", r["__at"], r["__n"]), " ")))).alias("__p"))
    first = words.join(sent(titles.select("__p", "document")), "__p").groupBy("__id").agg(F.min("document").alias("__by_title"))
    named = scratch.save(first.join(texts.hint("merge"), "__id").select("__t", "__by_title"))
    by_title = citations.select("citation", X.catalog_key(F.col("text")).alias("__t")).join(named.hint("merge"), "__t").groupBy("citation").agg(F.min("__by_title").alias("__by_title"))
    doi = lambda df, key: df.select(key, X.normalize_doi(F.col("doi")).alias("__d")).filter("__d <> ''")
    by_doi = doi(citations, "citation").join(doi(documents, "document").groupBy("__d").agg(F.min("document").alias("document")).hint("merge"), "__d").groupBy("citation").agg(F.min("document").alias("__by_doi"))
    out = citations.select("citation").join(by_title, "citation", "left").join(by_doi, "citation", "left")
    return out.select("citation", F.coalesce("__by_title", "__by_doi").alias("document"))


def sharing_token(topics: DataFrame, documents: DataFrame, topic: str, document: str, tokens: str) -> DataFrame:
    """Pairs of a topic and a document that share a token."""
    a = topics.select(topic, F.explode(F.array_distinct(tokens)).alias("__t"))
    b = documents.select(document, F.explode(F.array_distinct(tokens)).alias("__t"))
    return a.join(b, "__t").select(topic, document).distinct()


def matched_or_named(results: DataFrame, inputs: DataFrame, key: str, name: str) -> DataFrame:
    """Per input the result with its key, else the first with its name."""
    by_key = results.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("result").alias("__a"))
    by_name = results.groupBy(name).agg(F.min("result").alias("__b"))
    return inputs.join(by_key, key, "left").join(by_name, name, "left").withColumn("result", F.coalesce("__a", "__b")).drop("__a", "__b")


def sync_decision(items: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """items (key, has_file, hash, version), before (key, hash, version): what to do with each."""
    old = before.select(key, F.col("hash").alias("__hash"), F.col("version").alias("__version"))
    same = F.col("hash").eqNullSafe(F.col("__hash")) & F.col("__hash").isNotNull()
    what = F.when(~F.col("has_file"), "unavailable").when(same & F.col("version").eqNullSafe(F.col("__version")), "unchanged").when(same, "metadata_updated").otherwise("parse")
    return items.join(old, key, "left").select(key, what.alias("decision"))


def scoped(items: DataFrame, memberships: DataFrame, item: str, collection: str) -> DataFrame:
    """Per item once its collections, sorted; without any it is unfiled."""
    per = memberships.groupBy(item).agg(F.array_sort(F.collect_set(collection)).alias("collections"))
    return items.select(item).distinct().join(per, item, "left").withColumn("collections", F.coalesce("collections", F.array(F.lit("unfiled"))))


def harvest(found: DataFrame, known: DataFrame, quotas: Mapping[str, int], rounds: int = 5, most_per_source: int = 200) -> DataFrame:
    """found (source, key, rank, has_file): what a harvest in rounds saves. In round r a source shows its first
    min(most_per_source, quota * r) hits; those with a file are taken until the quota is met, others only in the last
    round; a key is taken once, in the order of rounds, sources and ranks; known keys are not.

    As a source's hits are ranked, a hit's first round follows from its rank, and no round needs the one before it but for
    what is taken: one window per source over hits that can be shown, a number bounded by most_per_source.
    """
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    rows = found.withColumn("quota", F.element_at(quota, F.col("source"))).filter(F.col("quota").isNotNull())
    rows = rows.filter(F.col("rank") <= F.least(F.lit(most_per_source), F.col("quota") * rounds)).join(known.select("key").distinct(), "key", "left_anti")
    rows = rows.withColumn("round", F.when(F.col("has_file"), F.ceil(F.col("rank") / F.col("quota")).cast("int")).otherwise(rounds))
    once = rows.groupBy("key").agg(F.min_by(F.struct("source", "rank", "has_file", "round", "quota"), F.struct("round", "source", "rank")).alias("r")).select("key", "r.*")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("round", F.desc("has_file"), "rank"))
    return once.withColumn("nth", nth).filter(F.col("nth") <= F.col("quota")).select("source", "key", "round", "nth")


def canonical_facets(rows: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """rows (record, facet, value, ord): facets under their canonical names, values in first order, each once but for case."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    named = rows.withColumn("facet", F.coalesce(F.try_element_at(table, F.lower(F.trim("facet"))), F.lit("other"))).withColumn("__k", F.lower(F.trim("value"))).filter("__k <> ''")
    first = named.groupBy("record", "facet", "__k").agg(F.min_by(F.trim("value"), "ord").alias("value"), F.min("ord").alias("ord"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"])
    return first.groupBy("record", "facet").agg(ordered.alias("values"))


def vocabulary(labels: DataFrame, aliases: DataFrame, label: str) -> DataFrame:
    """Labels with canonical and confidence: an alias 1.0, else their lexical key 0.8, empty ones 0."""
    key = X.lexical_key(F.col(label))
    known = aliases.select(X.lexical_key(F.col("alias")).alias("__k"), F.col("canonical").alias("__c")).dropDuplicates(["__k"])
    out = labels.withColumn("__k", key).join(known, "__k", "left")
    canonical = F.when(F.col("__k") == "", "").otherwise(F.coalesce("__c", "__k"))
    confidence = F.when(F.col("__k") == "", 0.0).when(F.col("__c").isNotNull(), 1.0).otherwise(0.8)
    return out.withColumn("canonical", canonical).withColumn("confidence", confidence).drop("__k", "__c")


def accepted_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims (claim, record, subject, predicate, object, quotes: array of (chunk, quote)), chunks (record, chunk, text): with
    quotes, how many stand in their chunk, and accepted: all three parts and a quote that does."""
    each = claims.select("claim", "record", F.explode_outer("quotes").alias("q")).select("claim", "record", F.col("q.chunk").alias("chunk"), X.normalize_quote(F.col("q.quote")).alias("quote"))
    held = each.join(chunks.select("record", "chunk", X.normalize_quote(F.col("text")).alias("__t")), ["record", "chunk"]).filter((F.col("quote") != "") & F.contains("__t", "quote"))
    n = held.groupBy("claim").agg(F.count("*").alias("verified"))
    full = F.lit(True)
    for part in ("subject", "predicate", "object"):
        full = full & (F.trim(F.coalesce(part, F.lit(""))) != "")
    out = claims.select("claim", full.alias("__full"), F.size("quotes").alias("quotes")).join(n, "claim", "left").withColumn("verified", F.coalesce("verified", F.lit(0)))
    return out.select("claim", "quotes", "verified", (F.col("__full") & (F.col("verified") > 0)).alias("accepted"))


def tree_ids(nodes: DataFrame, node: str, parent: str, label: str, ord_: str, project: str) -> DataFrame:
    """Adds stable_id: a hash of project, parent, label, and which of its siblings of that name it is."""
    w = Window.partitionBy(parent, F.lower(label)).orderBy(ord_)
    occurrence = nodes.withColumn("occurrence", F.row_number().over(w) - 1)
    parts = F.concat_ws("\0", F.lit(project), F.coalesce(F.col(parent).cast("string"), F.lit("")), F.lower(label), F.col("occurrence").cast("string"))
    return occurrence.withColumn("stable_id", F.substring(F.sha2(parts, 256), 1, 20))


def limited_headings(nodes: DataFrame, parent: str, label: str, ord_: str, primaries: int, children: int) -> DataFrame:
    """Two levels of headings: the first primaries, the first distinct children of each, numbered anew. nodes: node, parent
    (null for primaries), label, ord."""
    top = nodes.filter(F.col(parent).isNull()).orderBy(ord_, "node").limit(primaries).withColumn("i", F.row_number().over(Window.orderBy(ord_, "node")))  # a few rows
    first = nodes.filter(F.col(parent).isNotNull()).groupBy(parent, F.lower(label).alias("__l")).agg(F.min_by(F.struct("node", F.col(label).alias("label"), F.col(ord_).alias("ord")), F.struct(ord_, "node")).alias("r")).select(F.col(parent).alias("up"), "r.*")
    kids = first.join(F.broadcast(top.select(F.col("node").alias("up"), "i")), "up").withColumn("j", F.row_number().over(Window.partitionBy("up").orderBy("ord", "node"))).filter(F.col("j") <= children)
    number = lambda *c: F.concat_ws(".", *(F.col(x).cast("string") for x in c))
    return top.select("node", number("i").alias("number"), F.col(label).alias("label")).unionByName(kids.select("node", number("i", "j").alias("number"), "label"))


def mapped_types(types: DataFrame, mapping: DataFrame) -> DataFrame:
    """types (type), mapping (type, canonical): whether the mapping is a partition of the types: those it leaves out, those it
    invents, and those that it maps twice."""
    have, want = types.select("type").distinct(), mapping.select("type").distinct()
    missing = have.join(want, "type", "left_anti").withColumn("problem", F.lit("missing"))
    invented = want.join(have, "type", "left_anti").withColumn("problem", F.lit("invented"))
    twice = mapping.groupBy("type").agg(F.countDistinct("canonical").alias("n")).filter("n > 1").select("type").withColumn("problem", F.lit("twice"))
    return missing.unionByName(invented).unionByName(twice)


def candidate_phrases(text: Column, stop: Sequence[str]) -> Column:
    """Phrases of one to eight words between commas, semicolons, colons, brackets, bars and slashes, not of stop words
    alone, and acronyms."""
    parts = F.transform(F.split(text, r"[,;:()\[\]|/\n]+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    stops = F.array(*map(F.lit, stop))
    fits = lambda p: (p != "") & F.size(F.split(p, " ")).between(1, 8) & (F.size(F.array_except(F.split(F.lower(p), " "), stops)) > 0)
    return F.array_distinct(F.concat(F.filter(parts, fits), F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z0-9]{1,9}\b"), F.lit(0))))


#: Words of strong claims.
STRONG = r"(?i)\b(?:prove[sn]?|always|never|guarantee[sd]?|significantly|best|all|must|only|\d+(?:\.\d+)?\s*%)(?:\b|$)"


def grounding(answers: DataFrame, key: str, answer: str, sources: str) -> DataFrame:
    """key, cited (valid numbers), invalid (numbers beyond the sources), uncited (strong sentences without a citation) and
    the reasons against the answer."""
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([\d,;\s–-]+)\]"), F.lit(1)), lambda m: X.expand_numbers(m, 20)))))
    sentences = F.filter(F.split(answer, r"(?<=[.!?。！？])\s+|\n+"), lambda s: F.trim(s) != "")
    out = answers.withColumn("__n", numbers)
    out = out.withColumn("cited", F.filter("__n", lambda n: n.between(1, F.col(sources)))).withColumn("invalid", F.filter("__n", lambda n: ~n.between(1, F.col(sources))))
    out = out.withColumn("uncited", F.size(F.filter(sentences, lambda s: s.rlike(STRONG) & ~s.rlike(r"\[\d"))))
    reasons = [F.when((F.col(sources) > 0) & (F.size("cited") == 0), "no_citation"), F.when(F.size("invalid") > 0, "invalid_citation"), F.when(F.col("uncited") > 0, "uncited_claim"), F.when(F.col(sources) == 0, "no_source")]
    return out.select(key, "cited", "invalid", "uncited", F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def adjacent_blocks(blocks: DataFrame, key: str, ordinal: str, same: Sequence[str], content: str, summary: str) -> DataFrame:
    """Neighbours that agree in `same`, as one block: contents joined by empty lines, distinct summaries in order."""
    w = Window.partitionBy(key).orderBy(ordinal)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    rows = blocks.withColumn("__new", F.when(F.row_number().over(w) == 1, 0).otherwise(differs.cast("int"))).withColumn("block", F.sum("__new").over(w))
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(content).alias("c"), F.col(summary).alias("s"))))  # one document's neighbours
    out = rows.groupBy(key, "block", *same).agg(listed.alias("l"))
    return out.select(key, "block", *same, F.array_join(F.transform("l", lambda x: x["c"]), "\n\n").alias(content), F.array_join(F.array_distinct(F.filter(F.transform("l", lambda x: x["s"]), lambda s: s != "")), " | ").alias(summary), F.size("l").alias("blocks"))


def without_repeated_heading(content: Column, path: Column) -> Column:
    """The content without its first line, where that is the last heading of its path."""
    first = F.regexp_extract(content, r"^\s*#*\s*([^\n]*)", 1)
    same = (X.heading_key(first) == X.heading_key(F.element_at(F.split(path, " > "), -1))) & (X.heading_key(first) != "")
    return F.when(same, F.regexp_replace(content, r"^\s*[^\n]*\n?\s*", "")).otherwise(content)


def part_summary(summary: Column, part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.concat(summary, F.lit(" - Part "), part.cast("string"), F.lit("/"), parts.cast("string"))).otherwise(summary)


def document_version(documents: DataFrame, chunks: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per document a hash of its fields in the order of their names and of its chunks in theirs."""
    # Contents are hashed before a document's chunks meet.
    hashed = chunks.select(key, *order, F.sha2("content", 256).alias("__h"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__h"))), lambda c: F.concat_ws("\x1f", *(c[o].cast("string") for o in order), c["__h"])), "\x1e")
    per = hashed.groupBy(key).agg(parts.alias("__chunks"))
    head = F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in sorted(fields)))
    return documents.join(per, key, "left").select(key, F.sha2(F.concat_ws("\x1e", head, F.coalesce("__chunks", F.lit(""))), 256).alias("version"))
