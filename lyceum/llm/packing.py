"""Packing documents into sequences by bounded-space online best fit, with a merge of what is left over."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.common import saved

#: Tokens of a sequence, open windows of a partition, id that ends a document, partitions whose leftovers one task merges.
LENGTH, OPEN, END, MERGE = 2048, 16, 1, 64

_FAR = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long, ids binary"
_FIELDS = [x.split()[0] for x in _SCHEMA.split(", ")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a byte-level vocabulary file.

    Texts within the blocks where both libraries' character classes are the same are encoded by
    tiktoken with the ranks of the same file (seven times as fast, the same ids); others, texts that
    hold the string of a special token, which becomes that token's id, and files that are not
    byte-level, by the tokenizers library itself.
    """

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or tokenizer_path()
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.marked = re.compile("|".join(re.escape(x) for x in sorted(special)) or "(?!)")
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text and the id that ends it."""
        ids = self.slow.encode(text, add_special_tokens=False).ids if _FAR.search(text) or self.marked.search(text) else self.fast.encode_ordinary(text)
        out = np.empty(len(ids) + 1, "<u4")
        out[:-1] = ids
        out[-1] = END
        return out


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Best-fit packing with a fixed number of open windows.

    A piece goes to the open window with the least room that holds it. If none does and all
    windows are open, the fullest one is topped up with the head of the piece and emitted full.
    """

    def __init__(self, first: int, windows: int = OPEN) -> None:
        self.next, self.windows = first, windows
        self.open: list[tuple[int, list[tuple]]] = []  # (room, pieces)
        self.done: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        """Pieces (doc_id, start, ids, doc_tokens) as one sequence."""
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, None, None))
            at += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray, start: int, total: int) -> None:
        while len(ids) >= LENGTH:
            self.emit([(doc_id, start, ids[:LENGTH], total)])
            ids, start = ids[LENGTH:], start + LENGTH
        while len(ids):
            fits = [k for k, w in enumerate(self.open) if w[0] >= len(ids)]
            if not fits and len(self.open) < self.windows:
                self.open.append((LENGTH, []))
                fits = [len(self.open) - 1]
            room, pieces = self.open.pop(min(fits or range(len(self.open)), key=lambda k: self.open[k][0]))
            head, ids = ids[:room], ids[room:]
            pieces.append((doc_id, start, head, total))
            start += len(head)
            if room == len(head):
                self.emit(pieces)
            else:
                self.open.append((room - len(head), pieces))

    def close(self) -> list[tuple]:
        """Emit full sequences of the open windows' pieces one after the other; what remains is less than a sequence."""
        rest: list[tuple] = []
        room = LENGTH
        for doc_id, start, ids, total in [p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces]:
            while len(ids):
                head, ids = ids[:room], ids[room:]
                rest.append((doc_id, start, head, total))
                start, room = start + len(head), room - len(head)
                if not room:
                    self.emit(rest)
                    rest, room = [], LENGTH
        self.open = []
        return rest


def _rows(done: list[tuple], rest: list[tuple]) -> list[tuple]:
    """Finished pieces, and those left over with their place and ids."""
    return done + [(d, s, len(i), zlib.crc32(i.tobytes()), t, None, None, k, i.tobytes()) for k, (d, s, i, t) in enumerate(rest)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 8 else pa.binary()) for k, c in enumerate(columns)], _FIELDS)


def _at(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
    return batch.append_column("at", pa.array(np.full(batch.num_rows, place, np.int64)))


def _left_over(table: pa.Table) -> Iterator[tuple[int | None, int, np.ndarray, int]]:
    """(doc_id, start, ids, doc_tokens) of pieces left over, in order."""
    for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
        yield r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]


def _merge_group(table: pa.Table) -> pa.Table:
    table = table.sort_by([("source", "ascending"), ("place", "ascending")])
    level, group = table.column("level")[0].as_py(), table.column("to")[0].as_py()
    packer = Packer((level << 56) | (group << 24), 1)
    packer.open = [(0, [piece]) for piece in _left_over(table)]
    rest = packer.close()
    return pa.Table.from_batches([_at(_batch(_rows(packer.done, rest)), group)])


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    A document is the ids of its text (null: empty) and an end id, so every row has a piece.
    Partitions pack on their own and leave less than one sequence each; leftovers are merged by
    groups of partitions, level by level, until one remains, which is cut at powers of two and so
    needs no padding either. A piece is cut only at a full sequence's end. Rows without an id are
    packed too; repeated rows are packed each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        packer = Packer(part << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.ids(text.as_py() or "")
                packer.add(doc_id, ids, 0, len(ids))
            rows, packer.done = packer.done, []
            yield _at(_batch(_rows(rows, [])), part)
        rest = packer.close()
        yield _at(_batch(_rows(packer.done, rest)), part)

    state = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA + ", at long"))
    out, level = state.where("sequence_id is not null"), 0
    left = state.where("sequence_id is null")
    while True:
        groups = left.agg(F.countDistinct("at")).first()[0]
        if groups <= 1 and level:
            break
        if not groups:
            break
        level += 1
        numbered = left.withColumn("source", F.col("at")).withColumn("to", F.floor(F.col("at") / MERGE)).withColumn("level", F.lit(level))
        state = saved(numbered.drop("at", "sequence_id", "offset", "ids_crc32", "length").groupBy("to").applyInArrow(_merge_group, _SCHEMA + ", at long"))
        out = out.unionByName(state.where("sequence_id is not null"))
        left = state.where("sequence_id is null")
    out = out.unionByName(left.mapInArrow(_final, _SCHEMA + ", at long")) if level else out
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one leftover, less than a sequence, as sequences whose lengths are powers of two."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("place")
    packer, room = Packer(1 << 62), 0
    total = sum(table.column("length").to_pylist())
    pieces: list[tuple] = []
    for doc_id, start, ids, tokens in _left_over(table):
        while len(ids):
            room = room or 1 << (total.bit_length() - 1)
            head, ids = ids[:room], ids[room:]
            pieces.append((doc_id, start, head, tokens))
            start, room, total = start + len(head), room - len(head), total - len(head)
            if not room:
                packer.emit(pieces)
                pieces = []
    yield _at(_batch(_rows(packer.done, pieces)), 0)
