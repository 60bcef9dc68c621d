"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over 16 bytes cuts texts into chunks, so equal stretches of
different documents are cut alike.  Chunks that several texts hold are encoded once and shared.  At the joins the stored ids
may differ from those of the whole text, so the stretch around each join is
encoded again, out to the nearest safe cut on either side.  A safe cut lies
before a space with an ASCII letter or digit after it: whatever surrounds it, the
pre-token pattern starts a new pre-token there, no merge crosses a pre-token, and hence the ids beyond
it agree exactly with the stored ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, U, blocks, mix, powers, signed, small, stored, text_batches, text_buffer, text_key, unsigned

#: A cut follows a byte whose rolling hash has these bits zero: chunks of 512 bytes on average.
CUT_MASK = 511
_WINDOW = 16
# Fixed value: the pre-token pattern that byte-level vocabularies of this kind are defined with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GEAR = (mix(np.arange(1, 257, dtype=U)) >> U(32)).astype(np.uint32)
_TABLES = [mix(np.arange(1, 257, dtype=U) * U(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and its byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary (JSON form) as encoder and decoder of plain stretches and of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and spec["normalizer"] is None \
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        symbols = byte_symbols()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in pairs]
        if not (plain and simple and ids == sorted(ids) and all(len(t) > 1 or i < ids[0] for t, i in ranks.items())):
            raise ValueError("the vocabulary's ids do not follow its merges; this codec does not encode it exactly")
        import tiktoken

        self.special = special
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.engine = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        pieces = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.length = np.array([len(t) for t in table], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def plain(self, raw: bytes) -> np.ndarray:
        """Ids of a stretch without special strings."""
        return np.asarray(self.engine.encode_to_numpy(raw.decode(), disallowed_special=()), np.uint32) if raw else np.zeros(0, np.uint32)

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens inside it are those tokens."""
        if not self.has_special(text):
            return self.plain(text.encode())
        out = [np.array([self.special[p]], np.uint32) if p in self.special else self.plain(p.encode()) for p in self.parts.split(text)]
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        place = np.cumsum(size) - size
        return self.flat[np.repeat(self.begin[ids] - place, size) + np.arange(size.sum())].tobytes()


def chunk_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of chunks in a block's bytes: where the rolling hash says so, on characters' edges, and at each text's end."""
    n = len(buf)
    h = _GEAR[buf]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h >> np.uint32(7)) & np.uint32(CUT_MASK) == 0) + 1
    at = at[at < n]
    start = offsets[np.searchsorted(offsets, at, "right") - 1]
    at = at[(at - start >= _WINDOW) & ((buf[at] & 0xC0) != 0x80)]
    return np.unique(np.concatenate([at, offsets[1:]]))


class Chunks:
    """Chunks of a block: byte ranges, 128-bit names and their texts' rows."""

    def __init__(self, part: pa.RecordBatch):
        self.buf, self.offsets = text_buffer(part.column("text"))
        self.ends = chunk_cuts(self.buf, self.offsets)
        self.ends = self.ends[self.ends > 0]
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        p, inv = powers(len(self.buf) + 1)
        self.names = []
        for t in _TABLES:
            total = np.zeros(len(self.buf) + 1, U)
            np.cumsum(t[self.buf] * p[:-1], out=total[1:])
            self.names.append(mix((total[self.ends] - total[self.starts]) * inv[self.starts] + (self.ends - self.starts).astype(U)))
        self.raw = self.buf.tobytes()


def safe_cuts(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    return np.flatnonzero((b[:-1] == 0x20) & _ALNUM[b[1:]])


def encode_chunk(codec: Codec, raw: bytes) -> tuple[int, int, bytes]:
    """(first safe cut, last safe cut, ids between them as little-endian 32-bit); empty without two cuts."""
    cuts = safe_cuts(raw)
    if len(cuts) < 2:
        return 0, 0, b""
    ids = codec.plain(raw)
    ends = np.cumsum(codec.length[ids])
    a, b = np.searchsorted(ends, cuts[[0, -1]], "right")
    assert (a == 0 or ends[a - 1] == cuts[0]) and ends[b - 1] == cuts[-1], "a safe cut fell inside a token"
    return int(cuts[0]), int(cuts[-1]), ids[a:b].astype("<u4").tobytes()


def join_chunks(codec: Codec, raw: bytes, ranges, stored_ids) -> np.ndarray:
    """Ids of a text from its chunks (start, end); ``stored_ids(k)`` gives chunk k's shared encoding or None."""
    out, done = [], 0
    for k, (a, _) in enumerate(ranges):
        entry = stored_ids(k)
        if not entry or not entry[2]:
            continue
        head, tail, ids = entry
        out.append(codec.plain(raw[done:a + head]))  # the join, from the last safe cut to the first one here
        out.append(np.frombuffer(ids, "<u4"))
        done = a + tail
    out.append(codec.plain(raw[done:]))
    return np.concatenate(out).astype(np.uint32)


def _name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            c = Chunks(part)
            if len(c.starts):
                yield pa.RecordBatch.from_arrays([part.column("text_key").take(pa.array(c.row)), *map(signed, c.names)], ["text_key", "c1", "c2"])


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            c = Chunks(part)
            if len(c.starts):
                raw = pa.array([c.raw[a:b] for a, b in zip(c.starts, c.ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(signed, c.names), raw], ["c1", "c2", "raw"])


def _encode_chunk_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            rows = [encode_chunk(codec, r) for r in batch["raw"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["c1"], batch["c2"], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                ["c1", "c2", "head", "tail", "ids"])
    return run


def _text_batches(path: str, carried: list[str], table):
    """table: the broadcast encodings by name; None when the column ``got`` brings each text's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for part in blocks(batch):
                c = Chunks(part)
                names = list(zip(c.names[0].tolist(), c.names[1].tolist(), strict=True))
                out, back = [], []
                for i in range(part.num_rows):
                    raw = c.raw[c.offsets[i]:c.offsets[i + 1]]
                    a, b = c.first[i], c.first[i + 1]
                    if table is None:
                        known = {(int(U(x["c1"] & (2**64 - 1))), int(U(x["c2"] & (2**64 - 1)))): (x["head"], x["tail"], x["ids"]) for x in part["got"][i].as_py() or []}
                    else:
                        known = table.value
                    hits = [known.get(n) for n in names[a:b]]
                    if any(h and h[2] for h in hits) and not codec.has_special(raw.decode()):
                        spans = [(int(s - c.offsets[i]), int(e - c.offsets[i])) for s, e in zip(c.starts[a:b], c.ends[a:b], strict=True)]
                        ids = join_chunks(codec, raw, spans, hits.__getitem__)
                    else:
                        ids = codec.encode(raw.decode())
                    out.append(ids)
                    back.append(codec.decode(ids))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in carried], pa.array([len(x) for x in out], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in out], pa.binary()),
                     pa.array([x.decode("utf-8", "replace") for x in back], pa.string())], [*carried, "n_tokens", "ids", "decoded"])
    return run


def encode(docs: DataFrame, path: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded for every row of ``docs``.

    ``path`` is a byte-level BPE vocabulary in JSON form.  A null or empty text has no ids and decodes to the empty text.  Equal
    texts are encoded once; repeated rows get equal results; other columns are not read.
    Shared chunk encodings are broadcast while they fit ``limit`` bytes and joined to their texts beyond it.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = text_batches(docs).select("doc_id", text_key().alias("text_key"), "text")
    repeats = stored(rows.groupBy("text_key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("text_key", "low"), "bpe-repeats")
    n_repeats = repeats.count()
    marked = rows.join(small(repeats.withColumn("again", F.lit(True)), n_repeats, 64), "text_key", "left")
    lead = marked.where("again is null or doc_id = low or low is null").select("doc_id", "text_key", "text")

    counts = lead.select("text_key", "text").mapInArrow(_name_batches, "text_key binary, c1 long, c2 long")
    twice = stored(counts.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"), "shared-chunks")
    chunks = lead.select("text").mapInArrow(_chunk_batches, "c1 long, c2 long, raw binary") \
        .join(small(twice, twice.count(), 64), ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.first("raw").alias("raw"))
    encoded = stored(chunks.mapInArrow(_encode_chunk_batches(path), "c1 long, c2 long, head int, tail int, ids binary").where("octet_length(ids) > 0"), "chunk-ids")
    size = encoded.agg(F.coalesce(F.sum(F.octet_length("ids") + 160), F.lit(0)).alias("b")).first().b

    carried = ["doc_id", "text_key"]
    schema = f"doc_id {kind}, text_key binary, n_tokens long, ids binary, decoded string"
    if size <= limit:
        table = {}
        for batch in encoded.toArrow().to_batches():
            names = zip(unsigned(batch["c1"]).tolist(), unsigned(batch["c2"]).tolist(), strict=True)
            values = zip(batch["head"].to_pylist(), batch["tail"].to_pylist(), batch["ids"].to_pylist(), strict=True)
            table.update(zip(names, values, strict=True))
        shared = spark.sparkContext.broadcast(table)
    else:
        got = counts.dropDuplicates(["text_key", "c1", "c2"]).join(encoded, ["c1", "c2"]).groupBy("text_key") \
            .agg(F.collect_list(F.struct("c1", "c2", "head", "tail", "ids")).alias("got"))

    def whole(texts: DataFrame) -> DataFrame:
        if size <= limit:
            return texts.mapInArrow(_text_batches(path, carried, shared), schema)
        return texts.join(got, "text_key", "left").mapInArrow(_text_batches(path, carried, None), schema)

    columns = ["doc_id", "n_tokens", "ids", "decoded"]
    single = whole(marked.where("again is null").select("doc_id", "text_key", "text")).select(*columns)
    if not n_repeats:
        return single
    # a repeated text is encoded for its first document and the others take its ids
    again = marked.where("again").select("doc_id", "text_key", "low", "text")
    first = again.where("doc_id = low or low is null").select("doc_id", "text_key", "text").groupBy("text_key") \
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    first = stored(whole(first).drop("doc_id"), "bpe-repeated")
    return single.unionByName(again.select("doc_id", "text_key").join(first, "text_key").select(*columns))
