"""Packing token sequences into fixed windows by best-fit decreasing.

Each input partition is packed on its own, in blocks of at most BLOCK_IDS ids, so packing needs no shuffle and memory
is bounded. Overlong documents are first cut into full windows; the rests are placed from the longest to the shortest
into the tightest open window, found by a segment tree over remaining capacities. At a block's end the emptiest
windows are dissolved into the gaps of the fullest (documents may be cut), so at most one window a block is padded.

Edge cases: a null or empty text is the end id alone; a document longer than a block is cut and flows through several
blocks; null ids and repeated rows are packed like any other rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, tidy

WINDOW = 1024
END_ID = 0
BLOCK_IDS = 8 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts under a tokenizers file, as little-endian unsigned 32-bit bytes.

    Where the file holds a byte-level BPE with the usual pattern whose ids follow its merges, a text is encoded by
    tiktoken with the same vocabulary, which gives the same ids several times faster. Texts with special tokens, with
    characters that count as white space for some libraries only, or with long runs of white space (on which
    tiktoken's pattern runs out of stack), and all texts under other kinds of files, are left to tokenizers.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ODD = r"\s{500}|[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xA0\u1680\u180E\u2000-\u206F\u3000\uFEFF]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.odd = re.compile("|".join([*map(re.escape, special), self.ODD])).search
        self.fast = None
        if ranks := self._ranks(spec, special):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _ranks(spec: dict, special: list[str]) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(set(merged)) or len(vocab) != 256 + len(merged) or set("".join(vocab)) - set(byte):
            return None
        return {bytes(byte[c] for c in k): v for k, v in vocab.items()}

    def encode(self, text: str) -> bytes:
        if self.fast and not self.odd(text):
            ids = self.fast(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class OpenWindows:
    """A segment tree over the remaining capacities 0..size; its nodes count the open windows below them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        self.at[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (window, room) for the least room that is at least `need`."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.at[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) holding items of the given lengths (0 < length <= size).

    Whole items are placed first; then the emptiest windows give up theirs, cut where needed, to fill the fullest.
    """
    tree, windows, rooms = OpenWindows(size), [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        found = tree.take(n)
        if found:
            w, room = found
        else:
            w, room = len(windows), size
            windows.append([])
            rooms.append(size)
        windows[w].append((item, 0, n))
        rooms[w] = room - n
        if rooms[w]:
            tree.add(w, rooms[w])
    gaps = sorted((w for w in range(len(windows)) if rooms[w]), key=lambda w: (rooms[w], w))
    i, j = 0, len(gaps) - 1
    while i < j:
        to, source = gaps[i], gaps[j]
        item, start, n = windows[source].pop()
        part = min(n, rooms[to])
        windows[to].append((item, start, part))
        rooms[to] -= part
        if part < n:
            windows[source].append((item, start + part, n - part))
        rooms[source] += part
        i += not rooms[to]
        j -= not windows[source]
    return [w for w in windows if w]


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
    enc, end = encoder(path), end_id.to_bytes(4, "little")
    sequence = TaskContext.get().partitionId() << 33
    full: list[tuple] = []
    rests: list[tuple] = []
    held = 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(schema), schema=schema)

    def packed() -> pa.RecordBatch:
        nonlocal sequence
        rows = []
        for window in best_fit_decreasing([len(raw) // 4 for _, _, raw, _ in rests], size):
            offset = 0
            for item, start, n in window:
                doc, at, raw, total = rests[item]
                rows.append((doc, at + start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total, sequence, offset))
                offset += n
            sequence += 1
        rests.clear()
        return batch(rows)

    for b in tidy(batches):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = enc.encode(text.as_py() or "") + end
            total = len(ids) // 4
            cut = total - total % size
            for at in range(0, cut, size):
                full.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), total, sequence, 0))
                sequence += 1
            if cut < total:
                rests.append((doc, cut, ids[4 * cut :], total))
                held += total - cut
            if held >= block_ids:
                yield packed()
                held = 0
        if full:
            yield batch(full)
            full.clear()
    if rests:
        yield packed()


def pack(docs: DataFrame, tokenizer_path: str, size: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row for each piece of a document: where its ids start and how many they are, and where they stand."""
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lambda it: _pack(it, tokenizer_path, size, end_id, block_ids), SCHEMA)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
