"""Token counts by overlap resynchronisation.

Texts of ordinary size are encoded whole. A huge text is encoded in overlapping chunks with offsets, and two
neighbouring encodings are spliced at a boundary inside their overlap that both have and that is proven stable: the
character before it is not the word mark, the character after it is, and no piece of the vocabulary holds a word mark
behind another character. No merge can cross such a place, so what each side yields does not depend on the other side.
Where an overlap has no such place, it is widened.

A vocabulary with a mark inside a piece has no such places; then texts are encoded whole.

Nulls and empty texts have 0 tokens; an empty table gives no rows. Repeated rows are counted each by itself; other columns are kept, but for those
named like a result column, which the result replaces. A long text costs memory for one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.shared import arrow_batches, fresh

MARK = "▁"
_models: dict[str, tuple[sentencepiece.SentencePieceProcessor, bool]] = {}


def model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, once per worker, and whether a word mark only ever starts a piece or follows another mark."""
    if path not in _models:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
        _models[path] = sp, all(MARK not in p for p in pieces)
    return _models[path]


def _stable(text: str, low: int, high: int) -> int:
    """The last place in (low, high) where a blank follows a character that is no blank; -1 without one."""
    while (at := text.rfind(" ", low + 1, high)) > 0:
        if text[at - 1] not in (" ", MARK):
            return at
        high = at
    return -1


def count_long(sp: sentencepiece.SentencePieceProcessor, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text from chunks of at least `chunk` characters that overlap by `overlap` or more.

    A chunk counts from one splice to the next if its encoding has a boundary at both. Where it hasn't, the chunk is
    widened on the side that fails and encoded again, up to the whole text, whose count needs no splice.
    """
    total, start, splice, n = 0, 0, 0, len(text)
    while True:
        end, wide, cut = min(n, start + chunk), overlap, n
        while True:
            while end < n and (cut := _stable(text, max(splice, end - wide), end)) < 0:
                if end - wide <= splice:  # the overlap spans the chunk: read on until a stable place comes
                    end, wide = min(n, end + chunk), wide + chunk
                wide *= 2
            begins = [p.begin for p in sp.encode(text[start:end], return_type="proto", num_threads=1).pieces]
            if start == 0 and end == n:
                return len(begins)
            low, high = len(text[start:splice].encode()), len(text[start:cut].encode()) if end < n else None
            if splice > start and low not in begins:
                start = max(0, _stable(text, max(0, start - wide), start))
                wide *= 2
            elif high is not None and high not in begins:
                end, wide = min(n, end + chunk), wide * 2
            else:
                break
        total += sum(low <= b and (high is None or b < high) for b in begins)
        if end == n:
            return total
        # The next chunk starts one word earlier, so that both encodings have the splice as an inner boundary.
        before = _stable(text, start, cut)
        start, splice = (before if before > 0 else start), cut


def _counts(path: str, chunk: int, overlap: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, splits = model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            out = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk or not splits]
            for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1), strict=True):
                out[i] = len(ids)
            for i in set(range(len(texts))) - set(short):
                out[i] = count_long(sp, texts[i], chunk, overlap)
            rest = [batch.column(n) for n in batch.schema.names if n != text]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.int64())], [*names, "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """Per row: its columns without the text, n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    arrow_batches(docs.sparkSession)
    made, given = {"n_bytes", "n_tokens", "over_limit"}, fresh(docs, "given")
    kept = [c for c in docs.columns if c != text and c not in made]
    rows = docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias(given))
    fields = [f for f in rows.schema.fields if f.name != given]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"
    return rows.mapInArrow(_counts(model_path, chunk, overlap, given), schema).withColumn("over_limit", F.col("n_tokens") > limit)
