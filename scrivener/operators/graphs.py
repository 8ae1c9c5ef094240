"""Graph, tree and evidence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as X
from scrivener.session import Scratch


def merge_entities(mentions: DataFrame) -> DataFrame:
    """mentions (key, name, type, alias, evidence, document, ord) to one row per key.

    Sets are sorted; the type is that of most mentions, of ties the smallest; the name is the first.
    """
    votes = mentions.groupBy("key", "type").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    merged = mentions.groupBy("key").agg(
        F.min_by("name", "ord").alias("name"),
        *(F.sort_array(F.collect_set(c)).alias(t) for c, t in (("alias", "aliases"), ("evidence", "evidence_ids"), ("document", "document_ids"))),
        F.count("*").alias("mentions"),
    )
    return merged.join(votes, "key")


def merge_relations(rows: DataFrame) -> DataFrame:
    """rows (source, predicate, target, kind, confidence, evidence, ord) to one per source, predicate and target: the
    highest confidence, the first kind, all evidence."""
    keyed = rows.withColumn("predicate", F.lower(F.trim("predicate")))
    merged = keyed.groupBy("source", "predicate", "target").agg(F.max("confidence").alias("confidence"), F.min_by("kind", "ord").alias("kind"), F.sort_array(F.collect_set("evidence")).alias("evidence_ids"))
    return merged.withColumn("id", X.stable_id("relation", F.col("source").cast("string"), F.col("predicate"), F.col("target").cast("string")))


def with_endpoints(relations: DataFrame, entities: DataFrame, entity: str = "id") -> DataFrame:
    """Relations both of whose ends exist."""
    ids = entities.select(F.col(entity).alias("__id")).distinct()
    out = relations.join(ids, F.col("source") == F.col("__id"), "left_semi")
    return out.join(ids, F.col("target") == F.col("__id"), "left_semi")


def verify_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quotes (quote_id, record, quote, section), chunks (record, chunk, section, text): per quote the chunk that holds it.

    A chunk of the named section is better, then the first. Quotes and chunks meet on the record.
    """
    q = quotes.select("quote_id", "record", X.normalize_quote(F.col("quote")).alias("q"), F.col("section").alias("want")).filter("q <> ''")
    c = chunks.select("record", "chunk", "section", X.normalize_quote(F.col("text")).alias("t"))
    hits = q.join(c, "record").filter(F.contains("t", "q"))
    score = 1 + F.when(F.col("want").eqNullSafe(F.col("section")), 0.15).otherwise(0.0)
    best = hits.groupBy("quote_id").agg(F.max_by(F.struct("record", "chunk", score.alias("score")), F.struct(score, -F.col("chunk"))).alias("b"))
    return best.select("quote_id", "b.record", "b.chunk", "b.score")


def contained_passages(texts: DataFrame, passages: DataFrame, text_key: str, passage_key: str, words: int = 5) -> DataFrame:
    """Pairs of texts and passages that they hold verbatim. Both meet on the hash of the passage's first whole words.

    Passages too short for that meet on their inner words, one to four, or, with one or two words, on their first
    characters, eight at the most. Texts are only cut into grams of the sizes that occur among the passages.
    """
    # The first word of a passage may stand behind other signs in a text: the gram starts at the second word.
    words_of = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    gram = lambda w, at: F.xxhash64(*(F.get(w, at + j) for j in range(words)))
    sized = passages.select(passage_key, F.col("text").alias("passage")).withColumn("n", F.size(words_of(F.col("passage")))).filter("passage is not null")
    long_, short = sized.filter(F.col("n") >= words + 2).withColumn("h", gram(words_of(F.col("passage")), F.lit(1))), sized.filter(F.col("n") < words + 2)
    split = texts.select(text_key, words_of(F.col("text")).alias("w")).filter(F.size("w") >= words)
    at = split.select(text_key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - words)).alias("i"))
    grams = at.select(text_key, gram(F.col("w"), F.col("i")).alias("h"))
    pairs = grams.join(long_.select(passage_key, "h"), "h").select(text_key, passage_key).distinct()
    rows = texts.select(text_key, "text").join(pairs, text_key).join(long_.select(passage_key, "passage"), passage_key).filter(F.contains("text", "passage")).select(text_key, passage_key)
    out = rows.unionByName(texts.filter("text is not null").select(text_key).crossJoin(short.filter("passage = ''").select(passage_key)))  # in every text
    # Grams of few words or characters; the kinds of grams that occur are a dozen at most.
    inner = F.array_join(F.slice(words_of(F.col("passage")), F.lit(2), F.greatest(F.col("n") - 2, F.lit(0))), " ")
    keyed = short.filter("passage <> ''").withColumn("by_word", F.col("n") > 2)
    keyed = keyed.withColumn("size", F.when(F.col("by_word"), F.col("n") - 2).otherwise(F.least(F.length("passage"), F.lit(8))))
    keyed = keyed.withColumn("gram", F.when(F.col("by_word"), inner).otherwise(F.substring("passage", 1, 8)))
    cut = texts.filter("text <> ''").select(text_key, "text", words_of(F.col("text")).alias("w"))
    seen = None
    for kind in keyed.select("by_word", "size").distinct().collect():
        n = kind["size"]
        length = F.size("w") if kind["by_word"] else F.length("text")
        at = cut.filter(length >= n).select(text_key, "text", "w", F.explode(F.sequence(F.lit(1), length - n + 1)).alias("i"))
        gram_at = F.array_join(F.slice("w", F.col("i"), F.lit(n)), " ") if kind["by_word"] else F.substring(F.col("text"), F.col("i"), F.lit(n))
        found = at.select(text_key, F.lit(kind["by_word"]).alias("by_word"), F.lit(n).alias("size"), gram_at.alias("gram"))
        seen = found if seen is None else seen.unionByName(found)
    if seen is None:
        return out
    on = ["by_word", "size", "gram"]
    seen = seen.join(keyed.select(*on).distinct(), on, "left_semi").distinct()
    maybe = seen.join(keyed.select(*on, passage_key, "passage"), on).select(text_key, passage_key, "passage")
    return out.unionByName(texts.select(text_key, "text").join(maybe, text_key).filter(F.contains("text", "passage")).select(text_key, passage_key))


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, width: int) -> DataFrame:
    """Rows with equal keys and |a - b| <= width, by buckets: an equi-join that also splits one key's rows."""
    size = 2 * width + 1
    left = left.withColumn("__bucket", F.explode(F.array_distinct(F.array(*(F.floor((F.col(a) + d) / size) for d in (-width, width))))))
    right = right.withColumn("__bucket", F.floor(F.col(b) / size))
    return left.join(right, [*keys, "__bucket"]).filter(F.abs(F.col(a) - F.col(b)) <= width).drop("__bucket")


def closure(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """ancestor, node and depth (0 for itself) of a forest of any depth; a node that is its own ancestor, in a cycle, has
    each node of the cycle once.

    Pairs are doubled: those up to depth d join the pairs of depth d or less of their ancestors, so that a tree of depth d
    takes log2 d rounds, each a written table.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.col(node).alias("node"), F.col(parent).alias("up")).distinct()
    nodes = pairs.select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth")).distinct()
    known = pairs.select("node").distinct()
    first = pairs.filter("up is not null and up <> node").join(known.withColumnRenamed("node", "up"), "up", "left_semi").select(F.col("up").alias("ancestor"), "node", F.lit(1).alias("depth"))
    found, n = scratch.save(nodes.unionByName(first)), -1
    reach = 1
    while True:
        size = found.count()
        if size == n:
            return found
        n = size
        # Only pairs of the full reach can lead further.
        far = found.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("__mid"))
        on = found.filter("depth > 0").select(F.col("node").alias("__mid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        longer = far.join(on, "__mid").filter("ancestor <> node").select("ancestor", "node", "depth")
        found = scratch.save(found.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))
        reach *= 2


def subtree_counts(edges: DataFrame, members: DataFrame, node: str, parent: str, member: str) -> DataFrame:
    """Per node the distinct members of itself and of its whole subtree."""
    up = closure(edges, node, parent)
    own = members.groupBy(node).agg(F.countDistinct(member).alias("direct"))
    below = up.join(members.select(F.col(node).alias("node"), member), "node").groupBy("ancestor").agg(F.countDistinct(member).alias("total"))
    nodes = edges.select(node).distinct()
    out = nodes.join(own, node, "left").join(below.withColumnRenamed("ancestor", node), node, "left")
    return out.select(node, F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("total", F.lit(0)).alias("total"))


def tree_paths(edges: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """Per node its depth and the names from the root down."""
    up = closure(edges, node, parent)
    named = up.join(edges.select(F.col(node).alias("ancestor"), F.col(name).alias("__name")), "ancestor")
    paths = named.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("o"), "__name"))).alias("p"))
    return paths.select(F.col("node").alias(node), (F.size("p") - 1).alias("depth"), F.array_join(F.transform("p", lambda s: s["__name"]), "/").alias("path"))


def curate(entities: DataFrame, relations: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (id, name) and relations (id, source, target) after patches (kind, target_id, op, name): renames and
    deletions; relations lose deleted ends. Third: patches that found nothing."""
    of = lambda kind, op: patches.filter((F.col("kind") == kind) & (F.col("op") == op)).select(F.col("target_id").alias("id"), F.col("name").alias("__new"))
    kept = entities.join(of("entity", "delete").select("id"), "id", "left_anti").join(of("entity", "patch"), "id", "left")
    kept = kept.withColumn("name", F.coalesce("__new", "name")).drop("__new")
    edges = relations.join(of("relation", "delete").select("id"), "id", "left_anti")
    orphans = patches.join(
        entities.select(F.lit("entity").alias("kind"), F.col("id").alias("target_id")).unionByName(relations.select(F.lit("relation").alias("kind"), F.col("id").alias("target_id"))), ["kind", "target_id"], "left_anti"
    )
    return kept, with_endpoints(edges, kept), orphans


def bind_citations(claims: DataFrame, contexts: DataFrame, citations: DataFrame, band: int = 4) -> DataFrame:
    """claim_id and sorted citation_ids.

    claims (claim_id, document, line, quote), contexts (document, number, line), citations (id, document, number, year,
    surnames). A citation is bound by its number in the quote, by a context within the band of lines, or by its year
    in the quote next to a surname.
    """
    numbers = claims.select("claim_id", "document", F.explode(F.flatten(F.transform(F.regexp_extract_all("quote", F.lit(r"\[([\d,\s–-]+)\]"), F.lit(1)), lambda m: X.expand_numbers(m)))).alias("number"))
    by_number = numbers.join(citations, ["document", "number"]).select("claim_id", "id")
    near = band_join(claims.select("claim_id", "document", F.col("line").alias("at")), contexts.select("document", "number", F.col("line").alias("ctx")), ["document"], "at", "ctx", band)
    by_line = near.join(citations, ["document", "number"]).select("claim_id", "id")
    years = claims.select("claim_id", "document", "quote", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("quote", F.lit(r"(?:19|20)\d{2}"), F.lit(0)), lambda y: y.cast("int")))).alias("year"))
    named = F.exists("surnames", lambda s: F.contains(F.lower("quote"), F.lower(s)))
    by_year = years.join(citations, ["document", "year"]).filter(named).select("claim_id", "id")
    found = by_number.unionByName(by_line).unionByName(by_year)
    return found.groupBy("claim_id").agg(F.array_sort(F.collect_set("id")).alias("citation_ids"))


def coverage(matrix: DataFrame, refs: DataFrame, slots: DataFrame) -> DataFrame:
    """Every reference with every slot: what the matrix says, else unsupported. Slots are a plan's few rows."""
    every = refs.select("ref").distinct().crossJoin(F.broadcast(slots.select("slot").distinct()))
    known = matrix.groupBy("ref", "slot").agg(F.max_by(F.struct("status", "confidence"), F.struct(status_rank(F.col("status")), F.col("confidence"))).alias("b"))
    out = every.join(known, ["ref", "slot"], "left")
    return out.select("ref", "slot", F.coalesce("b.status", F.lit("unsupported")).alias("status"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def status_rank(status: Column) -> Column:
    return F.when(status == "direct", 2).when(status == "partial", 1).otherwise(0)


def roll_up(covered: DataFrame, slots: DataFrame, refs: DataFrame) -> DataFrame:
    """Per requirement: supported if each slot has enough direct references, from enough sources and periods; partial
    if anything speaks for it; else unsupported. slots (slot, requirement, need, sources, periods), refs (ref, source, period)."""
    rows = slots.join(covered, "slot", "left").join(refs, "ref", "left")
    direct = F.col("status") == "direct"
    per_slot = rows.groupBy("requirement", "slot").agg(F.count_if(direct).alias("n"), F.max("need").alias("need"), F.bool_or(F.col("status") != "unsupported").alias("any"))
    per_slot = per_slot.groupBy("requirement").agg(F.bool_and(F.col("n") >= F.col("need")).alias("full"), F.bool_or("any").alias("any"), F.count_if(F.col("n") < F.col("need")).alias("missing"))
    spread = rows.groupBy("requirement").agg(
        F.countDistinct(F.when(direct, F.col("source"))).alias("n_sources"), F.countDistinct(F.when(direct, F.col("period"))).alias("n_periods"), F.max("sources").alias("sources"), F.max("periods").alias("periods")
    )
    out = per_slot.join(spread, "requirement")
    enough = F.col("full") & (F.col("n_sources") >= F.col("sources")) & (F.col("n_periods") >= F.col("periods"))
    return out.select("requirement", F.when(enough, "supported").when(F.col("any"), "partial").otherwise("unsupported").alias("status"), "missing", "n_sources", "n_periods")


def rebuild_decision(current: DataFrame, built: DataFrame, key: str, versions: Sequence[str]) -> DataFrame:
    """Per record: reuse if all versions are as built and it is ready, replay if they are but it isn't, else extract."""
    prior = built.select(key, *(F.col(v).alias(f"__{v}") for v in versions), F.col("status").alias("__status"))
    out = current.join(prior, key, "left")
    same = F.lit(True)
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    return out.select(key, F.when(F.col("__status").isNull(), "extract").when(same & (F.col("__status") == "ready"), "reuse").when(same, "replay").otherwise("extract").alias("decision"))


def merge_candidates(rows: DataFrame) -> DataFrame:
    """Relation candidates (type, target, target_type, confidence, target_confidence, record, chunk, quote, ord) merged
    by type and target: the highest of the smaller confidences, evidence once per place and quote, the last wins."""
    key = ["type", "target_key", "target_type"]
    keyed = rows.withColumn("target_key", X.lexical_key(F.col("target")))
    best = keyed.groupBy(*key).agg(F.max(F.least("confidence", "target_confidence")).alias("confidence"), F.min_by("target", "ord").alias("target"), F.count("*").alias("candidates"))
    evidence = keyed.groupBy(*key, "record", "chunk", "quote").agg(F.max("ord").alias("ord")).groupBy(*key).agg(F.count("*").alias("evidence"))
    return best.join(evidence, key)


def score_text(queries: Sequence[str], text: Column) -> Column:
    """Per query 3 if the text holds it, the share of its tokens, and 0.35 per Latin token that the text holds."""
    low, out = F.lower(text), F.lit(0.0)
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[a-z0-9][a-z0-9+._/-]{1,}"), F.lit(0)))
    for q in dict.fromkeys(x.lower() for x in queries):
        words = list(dict.fromkeys(w for w in q.split() if len(w) > 1))
        if len(q) >= 3:
            out = out + F.when(F.contains(low, F.lit(q)), 3.0).otherwise(0.0)
        if words:
            hits = F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))
            out = out + hits / len(words) + 0.35 * hits
    return out


def navigate(relations: DataFrame, entities: DataFrame, queries: Sequence[str], most: int) -> DataFrame:
    """The best relations for some queries: their own score, 0.75 of their ends' and 0.1 of their confidence."""
    ends = entities.select("id", score_text(queries, F.col("name")).alias("s"))
    scored = relations.withColumn("direct", score_text(queries, F.col("claim")))
    for end in ("source", "target"):
        scored = scored.join(ends.select(F.col("id").alias(end), F.col("s").alias(f"__{end}")), end, "left")
    around = F.greatest(F.coalesce("__source", F.lit(0.0)), F.coalesce("__target", F.lit(0.0)))
    kept = scored.withColumn("around", around).filter((F.col("direct") > 0) | (F.col("around") > 0))
    score = F.col("direct") + 0.75 * F.col("around") + 0.1 * F.col("confidence")
    return kept.withColumn("score", score).orderBy(F.desc("score"), "id").limit(most).select("id", "source", "target", "direct", "around", "score")


def reading_order(df: DataFrame, group: Sequence[str], order: str, most_groups: int) -> DataFrame:
    """The first groups by their first row, kept whole. Ranks are taken over one row per group."""
    firsts = df.groupBy(*group).agg(F.min(order).alias("__first")).orderBy("__first").limit(most_groups)
    ranks = firsts.withColumn("place", F.row_number().over(Window.orderBy("__first"))).drop("__first")
    return df.join(F.broadcast(ranks), list(group))  # most_groups rows
