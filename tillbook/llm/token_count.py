"""Token counts of a sentencepiece BPE model with the whole-token shortcut.

The model puts a mark in the place of each space, and no vocabulary piece has
a mark after another character.  So no merge crosses the gap before a run of
spaces, and a text's pieces are those of its pre-tokens (a run of spaces and the
characters up to the next space).  The proof runs offline, over the vocabulary
alone: which pieces, given as a text, encode as exactly themselves.
A pre-token among those counts as one token without any merging; the
others are merged by the library, once per distinct pre-token held by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_batches

MARK = "▁"
HELD = 400_000  # distinct pre-tokens whose counts a task keeps


class WholeTokens:
    """What is proved about a model: ``alone``, the pre-tokens that are one token; ``splits``, that spaces part merges."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)
        # spaces must reach the model unchanged: neither dropped at the ends nor squeezed, with one put in front
        self.splits &= sp.encode(" ") == sp.encode(MARK) != [] and [sp.id_to_piece(i) for i in sp.encode("a")] == [MARK + "a"] \
            and "".join(sp.id_to_piece(i) for i in sp.encode("  a  ")) == MARK * 3 + "a" + MARK * 2
        names = [p[1:] for p in pieces if p.startswith(MARK)]
        self.alone = frozenset(n for n, ids in zip(names, sp.encode(names, num_threads=1), strict=True)
                               if n and MARK not in n and " " not in n and len(ids) == 1)


def pre_tokens(text: str) -> list[str]:
    """The text cut before each run of spaces; the mark in front and the one space that stands for it are left out."""
    text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    out, gap = [], 0
    for i, word in enumerate(text.split(" ")):
        if word:
            out.append(" " * gap + word)
            gap = 0
        elif i or text:
            gap += 1
    if gap and text:
        out.append(" " * gap)
    return out


def _count_batches(path: str, alone: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        known = dict.fromkeys(alone, 1)
        for batch in batches:
            for part in blocks(batch):
                lists = [pre_tokens(t or "") for t in part.column("text").to_pylist()]
                fresh = list({w for words in lists for w in words if w not in known})
                if len(known) + len(fresh) > HELD + len(alone):
                    known = dict.fromkeys(alone, 1)
                    fresh = list({w for words in lists for w in words if w not in known})
                known.update(zip(fresh, map(len, sp.encode(fresh, num_threads=1)), strict=True))
                n = [sum(map(known.__getitem__, words)) for words in lists]
                one = [sum(map(alone.__contains__, words)) for words in lists]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64()), pa.array(one, pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens", "n_whole"])
    return run


def _plain_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            n = [len(sp.encode(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([0] * len(n), pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens", "n_whole"])
    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_whole (pre-tokens counted without merging) for every row of ``docs``.

    ``path`` is a sentencepiece model.  A null or empty text has 0 bytes and 0 tokens; repeated rows get equal counts; other
    columns are not read.  A model for which spaces are not proved to part merges is run on whole texts.
    """
    proof = WholeTokens(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = text_batches(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    run = _count_batches(path, proof.alone) if proof.splits else _plain_batches(path)
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, n_whole long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
