"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

A scan tokenises each text once and keeps what packing needs: checksums of its full sequences and
the ids of its tail, the part shorter than a sequence. Tails are dealt to packing groups of a few
thousand rows by their place in the table (so copies, or one source, can't fill one group). In a
group, the histogram of tail lengths is packed, longest first, each length into the pack with the
most room, as counts of packing patterns; a last pass cuts the pieces of the emptiest packs to fill
what gaps are left in others. Patterns are then joined back to tails by their rank in their length.

Defined results: a null or empty text has the one id 1. Very long texts are cut into full sequences as
they are read. Of equal lengths the earlier row goes first. Repeated rows are packed each. An empty
table gives an empty table. Only ``doc_id`` and ``text`` are read. Sequence ids are unique, not
dense: the group number is in the upper 32 bits.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import parts_for, written

SEQUENCE = 2048
END_ID = 1
#: Rows that are packed together.
GROUP_ROWS = 4096
#: Groups that one task packs.
TASK_GROUPS = 16
#: A gap smaller than this isn't worth a cut.
LEAST_PIECE = 16
#: Distinct words whose ids a worker remembers at once.
REMEMBERED, LONG_WORD = 800_000, 100


#: Bytes as the tokenizer's vocabulary writes them: printable ones as themselves, others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_END = pack_ids("<I", END_ID)
#: Latin letters, then ASCII marks other than the apostrophe: two pieces, whatever stands around.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class _Words(dict):
    """Ids (as little-endian 32-bit bytes) by word, made when first asked for, forgotten when too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(self) >= self.most:
            self.clear()
        if len(word) < LONG_WORD:
            self[word] = ids
        return ids


def splits_words(tokenizer) -> bool:
    """Whether the tokenizer parts words at white space and lower-cases, so that words can be encoded alone."""
    probes = ("Ab cD", " a\tb\nc ", "x,—y naïve?!", "it's DON'T", "1,234.5€ a1b2", "日本 語")
    whole = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    return all(whole(t) == [i for w in t.replace("\n", " ").replace("\t", " ").split(" ") for i in whole(w)] and whole(t) == whole(t.lower()) for t in probes)


class Tokens:
    """Ids of texts. White space parts this tokenizer's words, so each distinct one is encoded once.

    Words of Latin letters with marks behind them, which nearly all are, go to the BPE model without
    the tokenizer's normalising steps, which leave them as they are once in lower case; all other
    words take the whole way.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_words(tokenizer)
        self.encode, self.model, self.size = tokenizer.encode, tokenizer.model, tokenizer.get_vocab_size()
        self.known = _Words(self._encoded, remembered // 4)
        self.letters = _Words(self._spelled, remembered)
        self.other = _Words(self._whole, remembered // 4)

    def _whole(self, word: str) -> bytes:
        ids = self.encode(word, add_special_tokens=False).ids
        return pack_ids(f"<{len(ids)}I", *ids)

    def _spelled(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTES)
        ids = [x.id for x in self.model.tokenize(letters)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _encoded(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word.lower())
        if not plain:
            return self.other[word]
        letters, marks = plain.groups()
        return self.letters[letters] + self.other[marks] if marks else self.letters[letters]

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word:
            return np.frombuffer(self._whole(text) + _END, "<u4")
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)) + _END, "<u4")


@cache
def tokens_of(path: str, remembered: int = REMEMBERED) -> Tokens:
    """One per worker process, so that a worker's next task knows its words."""
    return Tokens(path, remembered)


def stored_as(path: str) -> str:
    """The least type that holds the tokenizer's ids: tails are stored and shuffled as that."""
    return "<u2" if tokens_of(path).size <= 1 << 16 else "<u4"


def _tokenised(path: str, sequence: int, kind: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path, remembered)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            full, tails, lengths = [], [], []
            for text in batch.column(1):
                ids = tokens(text.as_py() or "")
                cut = len(ids) // sequence * sequence
                full.append([zlib.crc32(ids[k : k + sequence].tobytes()) for k in range(0, cut, sequence)])
                tails.append(ids[cut:].astype(kind).tobytes())
                lengths.append(len(ids))
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows), pa.array(lengths, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                names=["doc_id", "row", "doc_tokens", "full_crc", "tail"],
            )

    return run


class Pattern:
    """``count`` packs alike: slots of (origin length, start in it, length, first rank) and the room left."""

    __slots__ = ("slots", "count", "room")

    def __init__(self, slots: list[tuple[int, int, int, int]], count: int, room: int):
        self.slots, self.count, self.room = slots, count, room

    def part(self, count: int) -> Pattern:
        """Takes the first ``count`` packs off this pattern."""
        taken = Pattern(list(self.slots), count, self.room)
        self.slots = [(o, a, n, rank + count) for o, a, n, rank in self.slots]
        self.count -= count
        return taken


def pack_histogram(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[Pattern]:
    """Shortest-pack-first: longest lengths first, each into the packs with the most room."""
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # a heap of rooms, negated

    def put(pattern: Pattern) -> None:
        if pattern.room not in by_room:
            by_room[pattern.room] = []
            heapq.heappush(rooms, -pattern.room)
        by_room[pattern.room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while rooms and not by_room[-rooms[0]]:
                del by_room[-heapq.heappop(rooms)]
            if rooms and -rooms[0] >= length:
                pattern = by_room[-rooms[0]].pop()
                if pattern.count > left:
                    rest, pattern = pattern, pattern.part(left)
                    put(rest)
            else:
                pattern = Pattern([], left, sequence)
            pattern.slots.append((length, 0, length, rank))
            pattern.room -= length
            left -= pattern.count
            rank += pattern.count
            put(pattern)
    return [p for found in by_room.values() for p in found]


def fill_gaps(patterns: list[Pattern], least: int = LEAST_PIECE) -> list[Pattern]:
    """Empties the packs with the most room into the gaps of the others, cutting pieces to fit."""
    queue = sorted(patterns, key=lambda p: p.room)
    done: list[Pattern] = []
    while queue and queue[0].room < least:
        done.append(queue.pop(0))
    # queue: least room first; the last gives, the one before it in size takes.
    while len(queue) > 1 or (queue and queue[0].count > 1):
        giver = queue.pop()
        if giver.count > 1:  # one pack of the pattern gives to the others
            rest, giver = giver, giver.part(1)
            queue.append(rest)
        while giver.slots and queue:
            taker = queue[0]
            if taker.count > 1:
                queue[0] = rest = taker
                taker = rest.part(1)
            else:
                queue.pop(0)
            origin, start, length, rank = giver.slots[-1]
            take = min(length, taker.room)
            if take == length:
                giver.slots.pop()
                taker.slots.append((origin, start, length, rank))
            else:  # the end of the piece goes
                giver.slots[-1] = (origin, start, length - take, rank)
                taker.slots.append((origin, start + length - take, take, rank))
            taker.room -= take
            giver.room += take
            if taker.room < least:
                done.append(taker)
            else:
                queue.insert(0, taker)
        if giver.slots:
            done.append(giver)
    return done + queue


def _packed(sequence: int, kind: str):
    import pandas as pd

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        base = int(key[0]) << 32
        tails = [np.frombuffer(t, kind) for t in rows["tail"]]
        sizes = np.array([len(t) for t in tails], np.int64)
        out: list[tuple] = []
        sequences = 0
        docs, tokens = rows["doc_id"].to_list(), rows["doc_tokens"].to_list()
        for doc, total, crcs in zip(docs, tokens, rows["full_crc"], strict=True):
            for k, crc in enumerate(crcs):
                out.append((doc, k * sequence, sequence, int(crc), total, base + sequences, 0))
                sequences += 1
        ranked = np.argsort(sizes, kind="stable")  # by length, then by row: a rank in a length is a place here
        lengths, firsts, counts = np.unique(sizes[ranked], return_index=True, return_counts=True)
        first = dict(zip(lengths.tolist(), firsts.tolist(), strict=True))
        histogram = {n: c for n, c in zip(lengths.tolist(), counts.tolist(), strict=True) if n}
        for pattern in fill_gaps(pack_histogram(histogram, sequence)):
            for instance in range(pattern.count):
                offset = 0
                for origin, start, length, rank in pattern.slots:
                    at = int(ranked[first[origin] + rank + instance])
                    ids = tails[at][start : start + length].astype("<u4").tobytes()
                    whole = tokens[at]
                    out.append((docs[at], whole - origin + start, length, zlib.crc32(ids), whole, base + sequences, offset))
                    offset += length
                sequences += 1
        frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return frame.astype({"doc_id": "Int64"})

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, group_rows: int = GROUP_ROWS, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece of a document: which ids it holds and where they lie in which sequence.

    A worker remembers the ids of so many words (some 200 bytes each) as long as it lives.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, row long, doc_tokens long, full_crc array<long>, tail binary"
    kind = stored_as(tokenizer_path)
    tokens = written(narrow.mapInArrow(_tokenised(tokenizer_path, sequence, kind, remembered), schema), "tokens")
    groups = max(1, round(tokens.count() / group_rows))
    grouped = tokens.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    grouped = grouped.repartition(parts_for(docs.sparkSession, groups, TASK_GROUPS), "group")
    return grouped.groupBy("group").applyInPandas(_packed(sequence, kind), _PIECES)
