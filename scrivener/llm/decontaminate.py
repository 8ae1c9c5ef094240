"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items and documents are sets of five-word shingles (words are runs of letters and digits, lower-cased; a shorter item
is one shingle of all its words). A document contains an item if it holds at least `containment` of its shingles.

The MinHash sketch of an item is its k smallest shingle hashes, k one more than the shingles that may be missing, so
a document that contains the item has at least one of them: the search loses nothing. Documents are partitioned by
size, in powers of two of their shingle count. A partition is searched only for items that fit its documents, and its
sketch limit - the largest hash in those items' sketches - says which of a document's hashes can be in any of them;
only these leave the scan. Candidates are then verified: of the item's shingles those whose words are found in the
document are counted.

All of it is DataFrame operations. Null and empty texts contain nothing and no item without a word is searched for.
Rows that share both doc_id (or have none) and text are one document; those that share an id alone are documents of their
own, told apart by a hash of the text. Repeated items are one item; an empty table on either side gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import Scratch, fresh
from scrivener.session import prepare

#: Bytes of sketch hashes (24 a row), and of item shingles with their words, up to which the search side is broadcast; beyond,
#: it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
MOST_WORDS = 1 << 30


def words_of(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(texts: DataFrame, key: str, shingle: int, short: bool, spelled: bool = False) -> DataFrame:
    """key, n (shingles with repeats), h and, if spelled, the words joined by blanks, one row per shingle. Texts of fewer
    words: one shingle if short, else none."""
    words = texts.select(key, words_of().alias("w")).withColumn("words", F.size("w"))
    most = F.greatest(F.col("words") - (shingle - 1), F.lit(1)) if short else F.col("words") - (shingle - 1)
    words = words.filter(F.col("words") >= (1 if short else shingle)).select(key, "w", most.alias("n"))
    at = words.select(key, "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    words_at = [F.array_join(F.slice("w", F.col("i") + 1, F.lit(shingle)), " ").alias("words")] if spelled else []
    return at.select(key, "n", F.xxhash64(*(F.get("w", F.col("i") + j) for j in range(shingle))).alias("h"), *words_at)


def item_sketches(items: DataFrame, containment: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Distinct shingles (item_id, h, words) and the sketch rows (item_id, h, size class, shingles of the item)."""
    shingles = shingle_hashes(items.select(F.col("item_id").cast("long"), "text"), "item_id", shingle, True, True).select("item_id", "h", "words").distinct()
    listed = shingles.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs")).withColumn("size", F.size("hs"))
    # A hundredth of a shingle of slack, so that rounding can't drop one that is needed.
    sketch = listed.withColumn("k", F.least("size", F.floor(F.col("size") * F.lit(1 - containment) + 0.01).cast("int") + 1))
    return shingles, sketch.select("item_id", "size", F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, item_id, shared (the item's shingles in the document), item_shingles, containment: one row per hit."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    shingles, sketch = item_sketches(items, containment, shingle)
    shingles, sketch = scratch.save(shingles), scratch.save(sketch)
    sized = sketch.withColumn("least", F.ceil(F.col("size") * F.lit(containment) - 0.01))
    # The sketch limit of each partition of documents: class c holds documents of 2^c to 2^(c+1) - 1 shingles.
    limits = {r["c"]: r["top"] for r in sized.select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("c"), "h", "least").filter("least < shiftleft(1L, c + 1)").groupBy("c").agg(F.max("h").alias("top")).collect()}
    spelled = shingles.agg(F.coalesce(F.sum(24 + F.octet_length("words")), F.lit(0)).alias("bytes")).first()["bytes"]
    small = 24 * sketch.count() <= BROADCAST_BYTES and spelled <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    one = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text"))
    texts = docs.select(one.alias("doc"), "text").filter("text is not null")
    hashed = shingle_hashes(texts, "doc", shingle, False)
    size_class = F.floor(F.log2("n")).cast("int")
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in sorted(limits.items()) for x in kv)), size_class) if limits else F.lit(None).cast("long")
    sketched = hashed.filter(F.col("h") <= limit)
    found = sketched.join(hint(sized.select("item_id", "h", "least")), "h").filter(F.col("n") >= F.col("least"))
    candidates = found.select("doc", "item_id").distinct()
    # Items that are one short shingle can't meet a five-word shingle: they are looked for as word sequences.
    candidates = scratch.save(candidates.union(_short_items(texts, items, shingle, hint)).distinct())

    again = texts.join(candidates.select("doc").distinct(), "doc", "left_semi")
    # The words themselves are compared, so that no two shingles with one hash are taken for each other.
    present = shingle_hashes(again, "doc", shingle, False, True).select("doc", "h", "words")
    wanted = present.join(hint(shingles), ["h", "words"]).select("doc", "item_id", "h", "words").distinct()
    counts = wanted.join(candidates, ["doc", "item_id"]).groupBy("doc", "item_id").agg(F.count("*").alias("shared"))
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("size"))
    checked = candidates.join(counts, ["doc", "item_id"], "left").join(sizes, "item_id").join(_short_ids(items, shingle), "item_id", "left")
    shared = F.when(F.col("short"), F.lit(1)).otherwise(F.coalesce("shared", F.lit(0))).cast("long")
    out = checked.select(F.col("doc.doc_id").alias("doc_id"), "item_id", shared.alias("shared"), F.col("size").cast("long").alias("item_shingles"))
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles")).filter(F.col("containment") >= containment)


def _short(items: DataFrame, shingle: int) -> DataFrame:
    worded = items.select(F.col("item_id").cast("long"), words_of().alias("w"))
    return worded.filter((F.size("w") > 0) & (F.size("w") < shingle)).select("item_id", F.size("w").alias("m"), F.concat_ws(" ", "w").alias("phrase"))


def _short_ids(items: DataFrame, shingle: int) -> DataFrame:
    return _short(items, shingle).select("item_id", F.lit(True).alias("short")).distinct()


def _short_items(texts: DataFrame, items: DataFrame, shingle: int, hint) -> DataFrame:
    """Pairs for items of one to four words: the phrase stands in the document as consecutive words. The items are
    broadcast where their number allows, so that a common word isn't a hot key."""
    pairs = None
    short = _short(items, shingle)
    for m in [r["m"] for r in short.select("m").distinct().collect()]:
        grams = shingle_hashes(texts, "doc", m, False, True).select("doc", "words")
        sought = short.filter(F.col("m") == m).select("item_id", F.col("phrase").alias("words"))
        hit = grams.join(hint(sought), "words").select("doc", "item_id").distinct()
        pairs = hit if pairs is None else pairs.union(hit)
    return pairs if pairs is not None else texts.sparkSession.createDataFrame([], "doc struct<doc_id:long,text:long>, item_id long")


def decontaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, shingle: int = 5, row: str = "doc_id") -> DataFrame:
    """The rows of docs that contain no item. Another column can be given instead of doc_id to tell rows apart by; a row
    without it stays."""
    hit = fresh(docs, "hit")
    texts = docs.select(F.col(row).cast("long").alias("doc_id"), "text")
    hits = contaminated(texts, items, containment, shingle).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(hits, F.col(row) == F.col(hit), "left_anti")
