"""Retrieval of evidence as one plan: shortlist, search by facets, seeds, graph, locked references, coverage, selection, report.

Chunks are rows of `key` (unique), record, chunk, section, text, structure (null or empty: none) and seq (the place in it). Each
stage is a written table, so a stage is computed once and survives lost executors. What comes to the driver is the facets and
one row of diagnostics; candidates, matrices and members stay distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as X
from scrivener.operators import search as S
from scrivener.operators import selection as L
from scrivener.session import Scratch

#: What a further facet adds, the offset of ranks, what a seed is worth beyond its score.
NEXT_FACET, RANK_OFFSET, SEED_BONUS = 0.08, 20, 0.05
ONE = "evidence"


@dataclass(frozen=True)
class Retrieved:
    evidence: DataFrame
    diagnostics: DataFrame


def shortlisted(papers: DataFrame, specs: Mapping[str, str], limit: int, key: str = "record", title: str = "title", text: str = "text") -> tuple[DataFrame, str]:
    """The papers to search, and why: all where they are within the limit, where there is nothing to look for, or where no paper
    has a word of it; else the shortlist by quota."""
    if papers.select(key).limit(limit + 1).count() <= limit:
        return papers, "within_limit"
    wanted = {k: v for k, v in specs.items() if v and v.strip()}
    if not wanted:
        return papers, "no_query_specs"
    ids = papers.sparkSession.createDataFrame(list(wanted.items()), "spec_id string, query string")
    scores = Scratch(papers.sparkSession).save(S.shortlist_scores(papers, ids, key, title, text))
    if scores.filter("score > 0").isEmpty():
        return papers, "no_metadata_overlap"
    chosen = S.quota_fill(scores, list(wanted), limit, key).select(key)
    return papers.join(F.broadcast(chosen), key, "left_semi"), "shortlisted"  # `limit` rows


def grouped(chunks: DataFrame) -> DataFrame:
    """chunks with grp, structured, tokens and chars, as assembly wants them."""
    structured = F.coalesce(F.col("structure"), F.lit("")) != ""
    name = F.concat_ws("|", F.col("record").cast("string"), F.when(structured, F.concat(F.lit("s:"), "structure")).otherwise(F.concat(F.lit("c:"), F.col("chunk").cast("string"))))
    return chunks.withColumns({"grp": name, "structured": structured, "tokens": F.array_distinct(X.retrieval_tokens(F.coalesce("text", F.lit("")))), "chars": F.length(F.coalesce("text", F.lit("")))})


def terms_of(session, query: str) -> list[str]:
    """The tokens of a query, as the ranking sees them."""
    return session.createDataFrame([(query,)], "q string").select(X.retrieval_tokens(F.col("q"))).first()[0]


def searched(chunks: DataFrame, queries: Mapping[str, str], adjust: Mapping[str, Column] | None = None, title: str | None = None) -> DataFrame:
    """question, key, score and ord (the rank from 1) of the chunks that each query finds: the hybrid ranking, plus what its
    adjustment, a column of chunks, says."""
    out = None
    for name, query in queries.items():
        found = S.hybrid(chunks, query, terms_of(chunks.sparkSession, query), "key", "text", title, "section").select("key", "score")
        if adjust and name in adjust:
            found = found.join(chunks.select("key", adjust[name].alias("__a")), "key").select("key", (F.col("score") + F.col("__a")).alias("score")).filter("score > 0")
        part = found.select(F.lit(name).alias("question"), "key", "score")
        out = part if out is None else out.unionByName(part)
    return out


def ranked_members(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The members of all groups that a question finds, with the score and the place of those that it finds itself.

    A place is only compared within a question, so it is a number that grows as scores fall: no window ranks all of them."""
    scored = chunks.join(found, "key")
    groups = scored.select("question", "grp").distinct()
    members = chunks.join(groups, "grp").join(found, ["question", "key"], "left")
    # Scores as whole numbers, the best first, ties by key.
    place = F.when(F.col("score").isNotNull(), (-F.round(F.col("score") * 1e9)).cast("long"))
    return members.withColumn("ord", place)


def assembled(chunks: DataFrame, found: DataFrame, least: int, per_paper: int, alike: float, most_chunks: int, most_chars: int) -> DataFrame:
    """The evidence that is put together for each question: question, key, grp, place and score."""
    members = ranked_members(chunks, found)
    cap = L.per_paper(members.filter("ord is not null"), per_paper, least)
    taken = L.assemble(members.select("question", "grp", "record", "chunk", F.coalesce("seq", F.lit(0)).alias("seq"), "ord", "structured", "tokens", "chars"), cap, alike, most_chunks, most_chars)
    return taken.join(members.select("question", "grp", "chunk", "key", "score"), ["question", "grp", "chunk"]).select("question", "key", "grp", "place", "score")


def retrieve(chunks: DataFrame, query: str, least: int = 0, per_paper: int = 2, alike: float = 0.82, most_chunks: int = 6, most_chars: int = 18_000, adjust: Column | None = None, title: str | None = None) -> Retrieved:
    """The evidence for one query, and what there is to say about it: counts, the share of the query's words that the evidence
    has, the best score, the cap of papers."""
    scratch = Scratch(chunks.sparkSession)
    rows = scratch.save(grouped(chunks))
    found = scratch.save(searched(rows, {ONE: query}, {ONE: adjust} if adjust is not None else None, title))
    evidence = scratch.save(assembled(rows, found, least, per_paper, alike, most_chunks, most_chars).join(rows.select("key", "record", "chunk", "section", "text", "structure", "seq", "chars"), "key"))
    words = F.array_distinct(F.array(*map(F.lit, terms_of(chunks.sparkSession, query))).cast("array<string>"))
    text = F.lower(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(" ", "section", "text")))))  # most_chunks texts
    of = evidence.agg(F.count("*").alias("evidence"), F.countDistinct("record").alias("papers"), F.countDistinct("grp").alias("groups"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.round(F.coalesce(F.max("score"), F.lit(0.0)), 4).alias("top_score"), text.alias("t"))
    hit = F.size(F.filter(words, lambda w: F.contains(F.col("t"), w)))
    cap = L.per_paper(rows.join(found, "key").select("question", "record"), per_paper, least).select("cap")
    counts = found.agg(F.count("*").alias("candidates"))
    out = of.withColumn("query_coverage", F.round(hit / F.greatest(F.size(words), F.lit(1)), 4)).drop("t").crossJoin(counts).join(cap, F.lit(True), "left")  # one row each
    return Retrieved(evidence.drop("question"), out.withColumn("cap", F.coalesce("cap", F.lit(per_paper))))


def fused_facets(runs: DataFrame, facets: Sequence[str]) -> DataFrame:
    """key, fusion, score and facets of evidence (question: a facet, key, place, score), facets in their order.

    A facet contributes the score and 1 / (20 + rank) of the group. The first counts; each further one adds 0.08 or, if that is
    more, counts itself.
    """
    order = F.create_map(*(x for i, f in enumerate(facets) for x in (F.lit(f), F.lit(i))))
    worth = F.coalesce("score", F.lit(0.0)) + 1.0 / (RANK_OFFSET + 1 + F.col("place"))
    listed = F.array_sort(F.collect_list(F.struct(order[F.col("question")].alias("o"), worth.alias("w"), "question")))
    rows = runs.groupBy("key").agg(listed.alias("l"), F.max("score").alias("score"))
    fold = F.aggregate(F.slice("l", 2, 10_000), F.element_at("l", 1)["w"], lambda acc, x: F.greatest(acc + NEXT_FACET, x["w"]))
    return rows.select("key", fold.alias("fusion"), F.coalesce("score", F.lit(0.0)).alias("score"), F.transform("l", lambda x: x["question"]).alias("facets"))


def evidence_for(
    papers: DataFrame, chunks: DataFrame, question: str, facets: Mapping[str, str], requirements: DataFrame | None = None, matrix: DataFrame | None = None,
    seeds: DataFrame | None = None, graph: DataFrame | None = None, targets: DataFrame | None = None, requested: int = 0, limit: int = 100, most_groups: int = 12, most_chars: int = 18_000,
    least: int = 4, per_paper: int = 2, alike: float = 0.82, most_chunks: int = 6,
) -> Retrieved:
    """The evidence for a question, from the shortlist to the selection.

    papers: record, title, text. facets: id and query; none: the question is the only one. requirements: slot, parent, need,
    sources, periods. matrix: record, chunk, slot, status, confidence, period, what an evaluation says of each chunk; with
    requirements but without a matrix all candidates are kept. seeds: record, chunk, score, evidence from before. graph: record,
    chunk, score, evidence by way of a graph. targets: record, chunk, place, references that are asked for: they come first and
    are locked. Evidence: key, grp, record, chunk, section, text, fusion, score, facets, locked, existing, place.
    """
    session = chunks.sparkSession
    scratch = Scratch(session)
    wanted = {k: v for k, v in (facets or {ONE: question}).items() if v and v.strip()} or {ONE: question}
    # 1. Which papers are searched.
    specs = {"question": question} | dict(facets or {})
    chosen, reason = shortlisted(papers, specs, limit)
    rows = scratch.save(grouped(chunks))
    near = scratch.save(rows.join(chosen.select("record").distinct(), "record", "left_semi"))
    # 2. What each facet finds, put together and fused.
    found = scratch.save(searched(near, wanted))
    asked = max(least, requested)
    per_facet = max(2, min(4, asked // max(1, len(wanted)) + 1))
    runs = assembled(near, found, per_facet, per_paper, alike, most_chunks, most_chars)
    if requirements is None:
        runs = runs.filter(F.col("place") < per_facet)  # places count groups
    merged = fused_facets(runs, list(wanted)).withColumn("existing", F.lit(False))
    keyed = rows.select("key", "record", "chunk")
    # 3. Evidence from before, as far as it isn't found again.
    if seeds is not None:
        old = seeds.join(keyed, ["record", "chunk"]).groupBy("key").agg(F.max("score").alias("s"))
        merged = merged.join(old, "key", "full").select("key", F.coalesce("fusion", F.col("s") + SEED_BONUS).alias("fusion"), F.coalesce("score", "s").alias("score"), F.coalesce("facets", F.array().cast("array<string>")).alias("facets"), F.col("s").isNotNull().alias("existing"))
    merged = scratch.save(merged)
    n_text = merged.count()
    # 4. Evidence by way of the graph, fused by ranks.
    if graph is not None:
        by_graph = graph.join(keyed, ["record", "chunk"]).groupBy("key").agg(F.max("score").alias("g"))
        merged = scratch.save(merged.withColumnRenamed("fusion", "t").join(by_graph, "key", "full").select("key", "t", "g", F.coalesce("score", "g").alias("score"), F.coalesce("facets", F.array().cast("array<string>")).alias("facets"), F.coalesce("existing", F.lit(False)).alias("existing")))
        channels = [S.ranked(merged.filter(F.col(c).isNotNull()).select("key", F.col(c).alias("fusion")), "fusion", "key", 10 * limit) for c in ("t", "g")]
        fused = S.rrf(channels, "key", "fusion").select("key", F.col("fusion").alias("rrf"))
        merged = merged.join(fused, "key", "left").select("key", F.coalesce("rrf", F.lit(0.0)).alias("fusion"), "score", "facets", "existing")
    # 5. References that are asked for.
    if targets is not None:
        asked_for = targets.join(keyed, ["record", "chunk"]).groupBy("key").agg(F.min("place").alias("target"))
        merged = merged.join(asked_for, "key", "full").select("key", F.coalesce("fusion", F.lit(0.0)).alias("fusion"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("facets", F.array().cast("array<string>")).alias("facets"), F.coalesce("existing", F.lit(False)).alias("existing"), "target")
    else:
        merged = merged.withColumn("target", F.lit(None).cast("int"))
    items = scratch.save(merged.join(rows, "key"))
    # 6. What the evaluation says of each group, and 7. the selection.
    one = session.createDataFrame([(ONE, requested)], "question string, requested int")
    needs = requirements if requirements is not None else session.createDataFrame([], "slot string, parent string, need int, sources int, periods int")
    budget = L.budgets(needs.withColumn("question", F.lit(ONE)), one, least, most_groups, most_chars)
    said = matrix if matrix is not None else session.createDataFrame([], "record long, chunk int, slot string, status string, confidence double, period string")
    support = L.merged_support(said.join(items.select("record", "chunk", "grp"), ["record", "chunk"]), ["grp"])
    of = items.groupBy("grp").agg(
        F.first("record").cast("string").alias("record"), F.min("target").alias("target"), F.max("fusion").alias("relevance"), F.sum("chars").alias("chars"), F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"),
        F.bool_or(F.col("target").isNotNull()).alias("asked"), F.bool_or("existing").alias("existing"),
    )
    groups = of.join(support, "grp", "left").withColumn("support", F.coalesce("support", F.array().cast(L.SUPPORT)))
    verified = F.col("existing") & F.exists("support", lambda s: s["status"] == "direct")
    # Asked-for groups by their place, then by fusion; the order is one number.
    ord_ = F.coalesce(F.col("target").cast("long") - 2**61, (-F.round(F.col("relevance") * 1e9)).cast("long"))
    groups = scratch.save(groups.select(F.lit(ONE).alias("question"), "grp", "record", ord_.alias("ord"), "tokens", "chars", "relevance", (F.col("asked") | verified).alias("locked"), "support"))
    if requirements is not None and matrix is not None:
        strategy, taken = "coverage_aware", L.select_covering(groups, budget)
    elif requirements is not None:
        strategy, taken = "preserve_all", groups.select("question", "grp", F.lit(None).cast("int").alias("place"))
    else:
        strategy, most = "limited", max(asked, 1)
        taken = groups.orderBy("ord", "grp").limit(most).withColumn("place", F.row_number().over(Window.orderBy("ord", "grp")) - 1).select("question", "grp", "place")  # `most` rows
    taken = scratch.save(taken)
    locked = groups.select("grp", "locked")
    evidence = scratch.save(items.join(taken.select("grp", "place"), "grp").join(locked, "grp").select("key", "grp", "record", "chunk", "section", "text", "fusion", "score", "facets", "locked", "existing", "place"))
    # 8. The report.
    report = L.coverage_report(groups, taken, budget).drop("question")
    names = F.array(*(F.lit(k) for k in wanted)).cast("array<string>")
    covered = evidence.agg(F.count("*").alias("evidence"), F.countDistinct("record").alias("papers"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("facets")))).alias("covered_facets"))
    searched_papers = chosen.select("record").distinct().agg(F.count("*").alias("searched_papers"))
    diagnostics = report.crossJoin(covered).crossJoin(searched_papers)  # one row each
    diagnostics = diagnostics.withColumns({"missing_facets": F.array_sort(F.array_except(names, F.col("covered_facets"))), "text_evidence": F.lit(n_text), "shortlist": F.lit(reason), "strategy": F.lit(strategy)})
    return Retrieved(evidence, diagnostics.withColumn("facet_coverage", F.round(1 - F.size("missing_facets") / F.lit(len(wanted)), 4)))
