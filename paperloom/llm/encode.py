"""Encoding a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's public pattern. Every distinct word of a partition is encoded
once, by DuckDB inside the partition: token-position rows join the merge table, and a recursive
query contracts each word's leftmost pair of minimum rank (with the further non-overlapping
places of that same pair, which would be next in any case: a merge of a new token always ranks
behind the one that made it) until no pair is left. Ordered aggregation gives the ids.

Null and empty texts have the empty list. Special-token strings inside a text are ordinary text.
Lone surrogates cannot occur in Spark strings. A text of any length is encoded whole. The
vocabulary file is read on each executor from a path given as a parameter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import prepare

#: Words kept per Python worker; when full the memory starts anew (a limit of memory, not of work).
WORDS_KEPT = 200_000
#: Bytes of words given to one recursive query.
QUERY_BYTES = 1_000_000

_STEP = """
WITH RECURSIVE t(w, pos, tok) USING KEY (w, pos) AS (
    SELECT w, pos, tok FROM starts
  UNION
    (WITH live AS (
        SELECT r.w, r.pos, r.tok FROM recurring.t r
        WHERE r.tok >= 0 AND r.w IN (SELECT w FROM t)),
    pairs AS (
        SELECT w, pos, tok, lead(pos) OVER s AS npos, lead(tok) OVER s AS ntok, row_number() OVER s AS k
        FROM live WINDOW s AS (PARTITION BY w ORDER BY pos)),
    ranked AS (
        SELECT p.w, p.pos, p.npos, p.k, m.merged, m.merge_rank, min(m.merge_rank) OVER (PARTITION BY p.w) AS best
        FROM pairs p JOIN merges m ON m.lft = p.tok AND m.rgt = p.ntok),
    chosen AS (
        SELECT w, pos, npos, merged, k, k - row_number() OVER (PARTITION BY w ORDER BY k) AS run FROM ranked WHERE merge_rank = best),
    apart AS (
        SELECT w, pos, npos, merged FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY k) AS nth FROM chosen) WHERE nth % 2 = 1)
    SELECT w, pos, merged FROM apart UNION ALL SELECT w, npos, -1 FROM apart)
)
SELECT w, list(tok ORDER BY pos) AS ids FROM t WHERE tok >= 0 GROUP BY w ORDER BY w
"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies: $PUBLIC_TOKENIZERS, else the installed package."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _byte_names() -> dict[str, int]:
    """The public byte-to-character rule of byte-level BPE files, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    names.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return names


class Encoder:
    """One vocabulary with its merge table in an in-process DuckDB."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        names = _byte_names()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for char, byte in names.items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = pa.table({
            "lft": pa.array([vocab[a] for a, _ in pairs], pa.int32()),
            "rgt": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "merge_rank": pa.array(range(len(pairs)), pa.int32()),
            "merged": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})  # nothing is spilled
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.unregister("merges_in")
        # Fixed value: the public split pattern of this vocabulary.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        """Encode words not seen so far."""
        block: list[str] = []
        size = 0
        for w in words:
            block.append(w)
            size += len(w)
            if size >= QUERY_BYTES:
                self._encode(block)
                block, size = [], 0
        if block:
            self._encode(block)

    def _encode(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
        starts = np.cumsum(lengths) - lengths
        w = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        rows = pa.table({
            "w": w,
            "pos": (np.arange(int(lengths.sum())) - np.repeat(starts, lengths)).astype(np.int32),
            "tok": self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)],
        })
        self.db.register("starts", rows)
        out = self.db.sql(_STEP).to_arrow_table()
        self.db.unregister("starts")
        for i, ids in zip(out["w"].to_pylist(), out["ids"].to_pylist()):
            self.known[words[i]] = ids

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, split = self.known, self.split
        cut = [split(t) if t else [] for t in texts]
        new = {w for words in cut for w in words} - known.keys()
        if new:
            self.learn(sorted(new))
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _mapper(path: str, counts_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            # Texts are taken in blocks of bounded size, so a batch of long ones needs no more memory.
            for part in _blocks(batch):
                ids = enc.encode_batch(part["text"].to_pylist())
                last = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["id"], last], ["id", "tokens" if counts_only else "ids"])

    return run


def _blocks(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"]], dtype=np.int64)
    block = np.cumsum(sizes) // limit
    start = 0
    for i in range(1, len(block) + 1):
        if i == len(block) or block[i] != block[start]:
            yield batch.slice(start, i - start)
            start = i


def _encoded(docs: DataFrame, key: str, text: str, path: str | None, counts_only: bool, last: str) -> DataFrame:
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(docs[key].alias("id"), docs[text].cast("string").alias("text"))
    return own.mapInArrow(_mapper(path or vocabulary_path(), counts_only), f"id {kind}, {last}")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) for each row."""
    return _encoded(docs, key, text, path, False, "ids array<int>").withColumnRenamed("id", key)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, tokens bigint) for each row."""
    return _encoded(docs, key, text, path, True, "tokens bigint").withColumnRenamed("id", key)


_TEXTS = """
SELECT w, string_agg(hex, '' ORDER BY pos) AS hex FROM ids_in JOIN tokens USING (tok) GROUP BY w
"""


class Decoder:
    """The bytes of each token in an in-process DuckDB; ordered aggregation puts texts together."""

    def __init__(self, path: str):
        import duckdb

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        names = _byte_names()
        known = [(i, bytes(names[c] for c in t).hex()) for t, i in vocab.items() if all(c in names for c in t)]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.register("tokens_in", pa.table({"tok": pa.array([i for i, _ in known], pa.int32()), "hex": pa.array([h for _, h in known], pa.string())}))
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM tokens_in")
        self.db.unregister("tokens_in")

    def texts(self, ids: pa.Array) -> list[str]:
        lengths = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
        rows = pa.table({
            "w": np.repeat(np.arange(len(lengths)), lengths),
            "pos": np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths),
            "tok": ids.flatten().cast(pa.int32()),
        })
        self.db.register("ids_in", rows)
        out = self.db.sql(_TEXTS).to_arrow_table()
        self.db.unregister("ids_in")
        texts = [""] * len(lengths)
        for w, h in zip(out["w"].to_pylist(), out["hex"].to_pylist()):
            texts[w] = bytes.fromhex(h).decode("utf-8", "replace")
        return texts


_decoders: dict[str, Decoder] = {}
#: Tokens given to one query of the decoder.
QUERY_TOKENS = 500_000


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the texts back from their ids; null and empty lists have the empty text."""
    prepare(encoded.sparkSession)
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if where not in _decoders:
            _decoders[where] = Decoder(where)
        for batch in batches:
            lengths = np.asarray(batch["ids"].value_lengths().fill_null(0)).astype(np.int64)
            block = np.cumsum(lengths) // QUERY_TOKENS
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    b = batch.slice(int(part[0]), len(part))
                    yield pa.RecordBatch.from_arrays([b["id"], pa.array(_decoders[where].texts(b["ids"]), pa.string())], ["id", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", key)
