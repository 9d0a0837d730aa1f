"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded at a time; no batch holds more, but for a single chunk that can't be split.
BATCH_BYTES = 1 << 20
#: Bytes of chunks whose counts a task remembers, beyond which it starts anew; longer chunks than REMEMBERED aren't kept.
KEPT_BYTES, REMEMBERED = 1 << 26, 64
#: Characters from which on a chunk is split further.
LONG = 1 << 16

#: A space between two characters that are neither spaces nor the mark that stands for one. No piece of the vocabulary
#: spans it (pieces hold the mark in front only, or nothing else), and the encoder puts a mark before each text.
_PIECE_SPLIT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def n_bytes(t: str) -> int:
    return len(t) if t.isascii() else len(t.encode())


def _piece_counter(path: str):
    """Counts of texts by a sentencepiece model. Texts are split at safe spaces, and what is still long between two
    characters that no piece holds side by side; each distinct chunk of a bounded memory of chunks is encoded once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if p.strip("▁")]
    splits = not any("▁" in p[1:] for p in pieces) and model.encode("a b") == model.encode("a") + model.encode("b")  # the model allows it
    side_by_side = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    known: dict[str, int] = {}
    held = 0

    def length(text: str) -> int:
        return len(model.encode(text))

    def safe(a: str, b: str) -> bool:
        """Whether a text may be split between a and b: no merge spans them, nor b and the mark that would come before
        it, which is one token more."""
        if a in " ▁" or b in " ▁" or a + b in side_by_side or "▁" + b in side_by_side:
            return False
        return length(a + b) == length(a) + length(b) - 1 and length(b + b) == 2 * length(b) - 1

    def long_parts(chunk: str) -> list[str]:
        out, at = [], 0
        while len(chunk) - at > LONG:
            end = next((i for i in range(at + LONG, len(chunk)) if safe(chunk[i - 1], chunk[i])), None)
            if end is None:
                break
            out.append(chunk[at:end])
            at = end
        return [*out, chunk[at:]]

    def long_count(chunk: str) -> int:
        parts = long_parts(chunk) if splits else [chunk]
        return sum(map(length, parts)) - len(parts) + 1

    def count(texts: list[str]) -> list[int]:
        nonlocal held
        parts = [_PIECE_SPLIT.split(t) if splits else [t] for t in texts]
        if held > KEPT_BYTES:
            known.clear()
            held = 0
        new = {c for c in set().union(*parts) if c not in known}
        passing = {c: long_count(c) for c in new if len(c) > LONG}
        for batch in by_bytes([c for c in new if c not in passing]):
            for c, n in zip(batch, map(len, model.encode(batch, num_threads=1)), strict=True):
                if len(c) > REMEMBERED:
                    passing[c] = n
                else:
                    known[c] = n
                    held += n_bytes(c) + 100  # about what an entry takes besides
        return [sum(known[c] if c in known else passing[c] for c in p) for p in parts]

    return count


def _json_counter(path: str):
    """Counts of texts by a tokenizers file, without added special tokens, truncation or padding. Its
    pre-tokenizer is not known here, so texts are encoded whole."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def count(texts: list[str]) -> list[int]:
        return [len(e.ids) for batch in by_bytes(texts) for e in model.encode_batch(batch, add_special_tokens=False)]

    return count


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts, in order, of at most limit bytes (UTF-8) each; a longer text is a run by itself."""
    batch, n = [], 0
    for t in texts:
        size = n_bytes(t)
        if batch and n + size > limit:
            yield batch
            batch, n = [], 0
        batch.append(t)
        n += size
    if batch:
        yield batch


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than limit tokens) of every row.

    model: path of a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file that every executor has. Counts
    are the library's for the whole text, without begin, end or added special tokens. Null counts as empty;
    repeated rows stay; an empty table gives an empty result; other columns are not looked at.
    """
    make = _piece_counter if model.endswith(".model") else _json_counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            counts = [n for part in by_bytes(texts) for n in count(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
