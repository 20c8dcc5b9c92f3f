"""Packing: bounded-space online packing of tokenised documents into sequences of ``SIZE`` ids.

Every partition of the input is packed by itself, in its own order, with a fixed number of open windows.
A document's ids are cut into full sequences and a rest; the rest goes to the open window that it fills
best (best fit); when none has room, the fullest window is emitted and a new one opened. At the end of a
partition its open windows are merged: their pieces fill sequences one after another and are cut where
one is full, so that less than one sequence is left. These last rests are merged in the same way over
groups of ``GROUP`` partitions, so that no task gathers more than GROUP * SIZE ids.

The pieces, not the ids, travel: a piece carries its ids only while it is a last rest. The first pass is
written to the shared folder, so that a lost executor can't change what is emitted and what is merged.

Defined results: null text is empty text; an empty document is one piece with its end id alone; repeated
rows are packed each; an empty table gives no rows; extra columns are ignored; long texts are tokenised
in pieces cut at single spaces, which gives the same ids.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

SIZE = 1024
OPEN_WINDOWS = 128
GROUP = 64
END_ID = 0
SPECIAL = "<|endoftext|>"
PIECE = 1 << 20
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "part int, ids binary"
)
_SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def vocabulary() -> str:
    """Path of the byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Ids:
    """Ids of texts as bytes of little-endian uint32, exactly as the tokenizer file gives them.

    Encoding uses the same vocabulary as ranks (tiktoken), which is several times faster; texts with a
    special token's string go through ``tokenizers``. Texts longer than ``PIECE`` are cut at single spaces
    between other characters, where this vocabulary's pattern always starts a new word.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        ranks = {
            base64.b64decode(token): int(rank)
            for token, rank in map(bytes.split, Path(path).with_suffix(".tiktoken").read_bytes().splitlines())
        }
        self.path, self.whole = path, None
        self.plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._whole(text)
        out, start = [], 0
        while len(text) - start > PIECE and (found := _SPACE_BETWEEN.search(text, start + PIECE)) is not None:
            out.append(self._plain(text[start : found.start()]))
            start = found.start()
        return b"".join([*out, self._plain(text[start:])])

    def _whole(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


class _Windows:
    """The open windows of one partition, ordered by free space; pieces are lists of rows."""

    def __init__(self, limit: int) -> None:
        self.limit, self.free, self.pieces, self.next = limit, [], {}, 0

    def place(self, row: tuple, length: int) -> tuple[list[tuple], bool] | None:
        """Put a piece where it leaves least room; gives the window that had to be emitted, if any."""
        at = bisect_left(self.free, (length, -1))
        out = None
        if at == len(self.free):
            if len(self.free) >= self.limit:
                out = self.pieces.pop(self.free.pop(0)[1])
            self.next += 1
            free, key = SIZE, self.next
            self.pieces[key] = []
        else:
            free, key = self.free.pop(at)
        self.pieces[key].append(row)
        if free == length:
            return self.pieces.pop(key) if out is None else (out, self.pieces.pop(key))
        insort(self.free, (free - length, key))
        return out

    def rest(self) -> list[tuple]:
        """All pieces of the windows still open, fullest window first."""
        return [row for _, key in self.free for row in self.pieces[key]]


def _filled(pieces: list[tuple]) -> Iterator[tuple[list[tuple], int]]:
    """Cut pieces (doc_id, start, ids, doc_tokens) so that they fill sequences one after another.

    Gives each sequence's pieces and its length; only the last may be shorter than SIZE.
    """
    now, used = [], 0
    for doc_id, start, ids, total in pieces:
        while ids:
            take = ids[: 4 * (SIZE - used)]
            now.append((doc_id, start, take, total))
            used += len(take) // 4
            start, ids = start + len(take) // 4, ids[len(take) :]
            if used == SIZE:
                yield now, used
                now, used = [], 0
    if now:
        yield now, used


def _rows(pieces: list[tuple], sequence_id: int, part: int, keep_ids: bool = False) -> list[tuple]:
    out, offset = [], 0
    for doc_id, start, ids, total in pieces:
        n = len(ids) // 4
        out.append((doc_id, start, n, crc32(ids), total, sequence_id, offset, part, ids if keep_ids else None))
        offset += n
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


_IDS: dict[str, Ids] = {}


def _packer(path: str, windows: int):
    def pack_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        part = TaskContext.get().partitionId()
        end, number, rows = np.array([END_ID], "<u4").tobytes(), part << 32, []
        open_windows = _Windows(windows)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.of(text if isinstance(text, str) else "") + end
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                total = len(ids) // 4
                full = total // SIZE * SIZE
                for start in range(0, full, SIZE):
                    rows += _rows([(doc_id, start, ids[4 * start : 4 * (start + SIZE)], total)], number, part)
                    number += 1
                if total > full:
                    done = open_windows.place((doc_id, full, ids[4 * full :], total), total - full)
                    for pieces in (done if isinstance(done, tuple) else (done,)) if done else ():
                        rows += _rows(pieces, number, part)
                        number += 1
                if len(rows) >= 20_000:
                    yield _frame(rows)
                    rows = []
        for pieces, used in _filled(open_windows.rest()):
            rows += _rows(pieces, number, part, keep_ids=used < SIZE)
            number += 1
        if rows:
            yield _frame(rows)

    return pack_partition


def _merge(key: tuple, rests: pd.DataFrame) -> pd.DataFrame:
    rests = rests.sort_values(["part", "sequence_id", "offset"])
    pieces = [
        (None if pd.isna(d) else int(d), int(s), bytes(ids), int(t))
        for d, s, ids, t in zip(rests["doc_id"], rests["start"], rests["ids"], rests["doc_tokens"], strict=True)
    ]
    out: list[tuple] = []
    for i, (filled, _) in enumerate(_filled(pieces)):
        out += _rows(filled, (1 << 62) + (int(key[0]) << 20) + i, 0)
    return _frame(out)


def pack(documents: DataFrame, path: str | None = None, windows: int = OPEN_WINDOWS, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(documents.sparkSession)
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = cut(slim.mapInPandas(_packer(path or vocabulary(), windows), PIECES))
    rests = (
        first.where(F.col("ids").isNotNull())
        .withColumn("bundle", F.floor(F.col("part") / group))
        .groupBy("bundle")
        .applyInPandas(lambda key, rows: _merge(key, rows), PIECES)
    )
    return first.where(F.col("ids").isNull()).unionByName(rests).drop("part", "ids")
