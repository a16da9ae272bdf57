"""LM scoring: masked pseudo-likelihood of a bidirectional window network.

The network predicts each token from the two before and the two after it: position-wise weighted
embeddings are summed, squashed, and give the token's class and, by the class's own output vectors, its
member (a factored softmax over 16,384 tokens). The logits begin at the corpus' own log frequencies, so
the network learns what the context adds to them. The most frequent words, some 15,000, are tokens;
the others share hashed tokens, and each has its own probability in its token, its count over the
token's, from counts of all words of the corpus. A document's score is the sum over its words of
log p(token | both sides) + log p(word | token).

Texts are read once. Scan tasks cut them into chunks: rows of one chunk hold places in the chunk's
distinct words (64-bit hashes) and their counts. Those words are dealt out by hash and summed over
chunks, and their counts go back to the chunks, so what is shuffled are distinct words of chunks, not
occurrences, and no word is a hot key. The parts they are dealt to grow with the corpus, as does the
table of counts; the network's size is fixed.

Training reads all chunks: each round, every scan task starts from the same weights, passes once over
its chunks in numpy, and emits its weights in blocks; their means by tokens, added up in the order of
the tasks, start the next round. No text leaves its task.

Defined results: a null, empty or wordless text has no tokens and scores 0. Very long texts are one
chunk's. Tokens at a text's ends have border tokens on their empty side. Words of equal counts are named
together or not at all. Repeated rows get equal scores up to rounding, an empty table gives an empty
table. Only ``doc_id`` and ``text`` are read. The order of training follows how the table is split into
tasks; reruns of one split agree.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import SPACE, WORD, parts_for, written

WINDOW, WIDTH, CLASSES, MEMBERS = 2, 32, 128, 128
TOKENS = CLASSES * MEMBERS
#: Tokens that words without a name share; the others are words of their own.
HASHED = 1_024
NAMED = TOKENS - HASHED
BORDER = TOKENS
ROUNDS, RATE, BATCH = 1, 0.25, 12_288
#: Rows of a class whose logits are made, read and left at once, and rows of a line that are summed at once.
TILE, STRETCH = 256, 256
#: So many runs of rows are summed one by one.
RUNS = 48
#: Weights of a block, and tasks whose blocks one group adds up.
BLOCK, ADDED = 16_384, 256
#: Logits are kept within this, so that no exponential overflows.
LOGIT = 40
#: Tokens of a chunk of texts, bytes read at once, and distinct words of chunks that one task counts.
CHUNK, PIECE, COUNTED = 1 << 19, 1 << 20, 1 << 20
#: Bytes of short texts that are split together.
RUN = 1 << 22
#: Tokens of a line that are scored at once.
SCORED = 1 << 16
#: Chunks that one task scores.
TASK_CHUNKS = 8
LEAST_PARTS = 16
#: Counts fall into so many bins to a doubling; the names end at a bin's edge.
BINS = 32
_WORDS, _SPACE = re.compile(WORD), re.compile(SPACE.encode())


class Vocabulary(NamedTuple):
    """Hashes of the named words in order, their token numbers, and all tokens' log frequencies."""

    hashes: np.ndarray
    numbers: np.ndarray
    class_bias: np.ndarray
    member_bias: np.ndarray
    token_logs: np.ndarray

    def tokens(self, words: np.ndarray) -> np.ndarray:
        """The token of each word hash."""
        out = hashed_token(words)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            hit = self.hashes[at] == words
            out[hit] = self.numbers[at[hit]]
        return out


def hashed_token(words: np.ndarray) -> np.ndarray:
    """The shared token of words without a name: each class has as many."""
    j = (words % np.uint64(HASHED)).astype(np.int64)
    return (j % CLASSES) * MEMBERS + NAMED // CLASSES + j // CLASSES


def named_token(rank: np.ndarray) -> np.ndarray:
    """The token of a name by its rank: ranks go around the classes, so classes are about equally frequent."""
    return (rank % CLASSES) * MEMBERS + rank // CLASSES


def _lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in lists of a bounded part of it; what splits bytes is ASCII white space."""
    at = 0
    while len(text) - at > PIECE:
        gap = _SPACE.search(text, at + PIECE)
        cut = gap.start() if gap else len(text)
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def _numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's place among the distinct ones, and those' hashes."""
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)  # a list of its values takes far longer
    return coded.indices.to_numpy(), np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))


def _worded(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words of each row, all words' places, hashes at the places) for some rows after the other; a long text is a row alone."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < len(text):
        # Rows of a few pieces' bytes together, or one row.
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + RUN, "right")) - 1)
        if end == at + 1 and sizes[at] > PIECE:
            parts = [_numbered(pa.array(words, pa.binary())) for words in _lists(text[at].as_buffer().to_pybytes()) if words]
            bases = np.cumsum([0, *[len(h) for _, h in parts]])
            places = np.concatenate([np.empty(0, np.int64), *[x + b for (x, _), b in zip(parts, bases, strict=False)]])
            yield np.array([len(places)]), places, np.concatenate([np.empty(0, np.uint64), *[h for _, h in parts]])
        else:
            split = pc.ascii_split_whitespace(text.slice(at, end - at))
            some = pc.binary_length(split.values).to_numpy() > 0  # white space at an end leaves an empty word there
            places, hashes = _numbered(split.values)
            yield np.diff(np.r_[0, np.cumsum(some)][split.offsets.to_numpy()]), places[some], hashes
        at = end


def _stored(values: np.ndarray, n: int) -> bytes:
    """Numbers below n, in two bytes each if they fit."""
    return values.astype("<u2" if n <= 1 << 16 else "<u4").tobytes()


def _read(raw: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<u2" if n <= 1 << 16 else "<u4")


_CHUNKS = "chunk long, docs array<long>, lengths binary, places binary, words binary, counts binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33

    def closed(docs: list, parts: list[tuple[np.ndarray, np.ndarray]], lengths: list[np.ndarray]) -> pa.RecordBatch:
        hashes, place = np.unique(np.concatenate([h for _, h in parts]), return_inverse=True)
        each = np.split(place, np.cumsum([len(h) for _, h in parts])[:-1])
        all_ = np.concatenate([p[x] for p, (x, _) in zip(each, parts, strict=True)])
        counts = np.bincount(all_, minlength=len(hashes))
        kept = counts > 0  # the others are words of the next chunk
        all_, hashes, counts = (np.cumsum(kept) - 1)[all_], hashes[kept], counts[kept]
        values = [number, docs, np.concatenate(lengths).astype("<u4").tobytes(), _stored(all_, len(hashes)), hashes.astype("<u8").tobytes(), counts.astype("<u4").tobytes()]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split(" ")[0] for x in _CHUNKS.split(", ")])

    docs, parts, lengths, held = [], [], [], 0
    for batch in batches:
        ids, row = batch.column(0).to_pylist(), 0
        for n, places, hashes in _worded(batch.column(1)):
            ends, word = np.cumsum(n + 1), 0
            done = 0
            while done < len(n):
                before = int(ends[done - 1]) if done else 0
                upto = min(int(np.searchsorted(ends, before + CHUNK - held)) + 1, len(n))
                words = int(n[done:upto].sum())
                docs += ids[row : row + upto - done]
                lengths.append(n[done:upto])
                parts.append((places[word : word + words], hashes))
                held += int(ends[upto - 1]) - before
                row, word, done = row + upto - done, word + words, upto
                if held >= CHUNK:
                    yield closed(docs, parts, lengths)
                    number += 1
                    docs, parts, lengths, held = [], [], [], 0
    if docs:
        yield closed(docs, parts, lengths)


def chunks(docs: DataFrame) -> DataFrame:
    """All rows in chunks, a written table: texts are read once."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(_chunked, _CHUNKS), "lm-chunks")


def _parted(parts: int):
    """Each chunk's words and counts, by the part that counts them; words are sorted, so parts are runs."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                hashes, n = np.frombuffer(words.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u4")
                cuts = np.r_[0, np.searchsorted(hashes, edges), len(hashes)]
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some.astype(np.int32)), pa.array([chunk] * len(some), pa.int64()),
                        pa.array([hashes[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()), pa.array([n[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()),
                    ],
                    names=["part", "chunk", "words", "counts"],
                )

    return run


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts) * BINS + 1e-9).astype(np.int64)


def _summed(rows: pa.Table) -> pa.Table:
    """The log count of each word over all chunks, for each chunk that has it; and the part's most frequent words."""
    hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in rows["words"]]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in rows["counts"]])
    words, places = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(places, counts, len(words))
    each = np.split(np.log(total)[places].astype("<f4"), np.cumsum([len(h) for h in hashes])[:-1])
    top = np.argsort(-total, kind="stable")[: 2 * NAMED]
    first = rows["part"][0].as_py()
    return pa.table(
        {
            "chunk": pa.array([*rows["chunk"].to_pylist(), None], pa.int64()), "part": pa.array([first] * (len(each) + 1), pa.int32()),
            "logs": pa.array([*[x.tobytes() for x in each], None], pa.binary()),
            "top": pa.array([*[None] * len(each), words[top].astype("<u8").tobytes() + total[top].astype("<f8").tobytes()], pa.binary()),
        }
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(chunk, part, logs, top): log counts for all chunks' words by part, and each part's most frequent words."""
    held = rows.select("chunk", "words", "counts")
    total = held.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // (8 * COUNTED)))
    dealt = held.mapInArrow(_parted(parts), "part int, chunk long, words binary, counts binary")
    return written(dealt.repartition(parts, "part").groupBy("part").applyInArrow(_summed, "chunk long, part int, logs binary, top binary"), "lm-counts")


def _pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw[: 8 * n], "<u8"), np.frombuffer(raw[8 * n :], "<f8")


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            bins, n = np.unique(_bin(_pairs(raw)[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n, pa.int64())], names=["bin", "n"])


def _above(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                words, counts = _pairs(raw)
                kept = _bin(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array(words[kept].view(np.int64)), pa.array(counts[kept])], names=["word", "n"])

    return run


def named_words(counts: DataFrame, most: int = NAMED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, the most frequent first: as many whole bins as fit."""
    tops = counts.filter("top is not null").select("top")
    bins = tops.mapInArrow(_binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()  # some bins a doubling
    held, least = 0, None
    for r in bins:
        held += r["n"]
        if held > most:
            break
        least = r["bin"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    found = tops.mapInArrow(_above(least), "word long, n double").toArrow()  # at most ``most`` rows
    words, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.lexsort((words, -n))
    return words[order], n[order]


def _token_counts(hashes: np.ndarray, numbers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Vocabulary(hashes, numbers, *[np.empty(0)] * 3)
        seen = np.zeros(TOKENS)
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                n = np.frombuffer(counts.as_buffer(), "<u4")
                seen += np.bincount(code.tokens(np.frombuffer(words.as_buffer(), "<u8")), n, TOKENS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at].astype(np.int64))], names=["token", "n"])

    return run


def vocabulary(rows: DataFrame, counts: DataFrame) -> Vocabulary:
    """The names, and the log frequencies of all tokens: a number a token, from all chunks."""
    words, _ = named_words(counts)
    order = np.argsort(words, kind="stable")
    hashes, numbers = words[order], named_token(order)
    got = rows.select("words", "counts").mapInArrow(_token_counts(hashes, numbers), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TOKENS)
    for r in got:
        n[r["token"]] = r["n"]
    square = (n + 0.5).reshape(CLASSES, MEMBERS)  # a token that the corpus lacks isn't impossible
    classes = square.sum(1)
    unnamed = np.zeros(TOKENS, bool)
    unnamed.reshape(CLASSES, MEMBERS)[:, NAMED // CLASSES :] = True
    logs = np.where(unnamed & (n > 0), np.log(np.maximum(n, 1)), 0.0)
    return Vocabulary(hashes, numbers, np.log(classes / classes.sum()).astype(np.float32), np.log(square / classes[:, None]).astype(np.float32), logs)


class Network:
    """Weights in one flat array; ``parts`` are views of it. The biases are the corpus' and aren't trained."""

    SHAPES = (
        ("embed", (TOKENS + 1, WIDTH)),
        ("to_member", (CLASSES, MEMBERS, WIDTH)),
        ("to_class", (CLASSES, WIDTH)),
        ("mix", (2 * WINDOW, WIDTH)),
        ("shift", (WIDTH,)),
    )
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, flat: np.ndarray | None = None, class_bias: np.ndarray | None = None, member_bias: np.ndarray | None = None):
        if flat is None:
            flat = np.zeros(self.SIZE, np.float32)
            rng = np.random.default_rng(11)
            flat[: (TOKENS + 1) * WIDTH] = rng.normal(0, 0.3, (TOKENS + 1) * WIDTH)
            flat[-(2 * WINDOW + 1) * WIDTH : -WIDTH] = rng.normal(0.5, 0.3, 2 * WINDOW * WIDTH)
        self.flat = np.array(flat, np.float32)
        self.class_bias = np.zeros(CLASSES, np.float32) if class_bias is None else class_bias
        self.member_bias = np.zeros((CLASSES, MEMBERS), np.float32) if member_bias is None else member_bias
        self.bias_reach = max(np.abs(self.class_bias).max(), np.abs(self.member_bias).max())
        self.parts, at = {}, 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            self.parts[name] = self.flat[at : at + n].reshape(shape)
            at += n
        self.spaces: dict[str, np.ndarray] = {}

    def space(self, name: str, *shape: int) -> np.ndarray:
        """An array to write to, kept for the next line: the system's pages for a fresh one cost more than the sums."""
        n = math.prod(shape)
        if name not in self.spaces or self.spaces[name].size < n:
            self.spaces[name] = np.empty(n, np.float32)
        return self.spaces[name][:n].reshape(shape)

    def _wide(self) -> np.ndarray:
        """Each place's weights, again and again for as many rows as are summed at once."""
        wide = self.space("wide", 2 * WINDOW, STRETCH, WIDTH)
        wide[:] = self.parts["mix"][:, None]
        return wide

    def _hidden(self, line: np.ndarray):
        """A line's embeddings; the hidden rows of its inner tokens that aren't borders, brought together by class.

        A one stands behind each hidden row, for the biases.
        """
        p, n = self.parts, len(line) - 2 * WINDOW
        around = np.take(p["embed"], line, axis=0, out=self.space("around", len(line), WIDTH), mode="clip")
        hidden, pre, some = self.space("hidden", n, WIDTH + 1), self.space("pre", STRETCH, WIDTH), self.space("some", STRETCH, WIDTH)
        hidden[:, WIDTH] = 1
        mix = self._wide()
        for lo in range(0, n, STRETCH):
            k = min(STRETCH, n - lo)
            x, y = pre[:k], some[:k]
            x[:] = p["shift"]
            for d, weight in zip(_OFFSETS, mix, strict=True):
                x += np.multiply(around[WINDOW + d + lo : WINDOW + d + lo + k], weight[:k], out=y)
            np.tanh(x, out=hidden[lo : lo + k, :WIDTH])
        middle = line[WINDOW : WINDOW + n]
        real = np.flatnonzero(middle != BORDER)
        kind = middle[real] // MEMBERS
        order = np.argsort(kind.astype(np.uint8), kind="stable")  # a radix sort
        real, kind = real[order], kind[order]
        held = np.take(hidden, real, axis=0, out=self.space("held", len(real), WIDTH + 1), mode="clip")
        return around, held, real, middle[real] % MEMBERS, np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()

    def _tiles(self, held: np.ndarray, member: np.ndarray, cuts: list[int]):
        """(class, from, to, places of own members' logits, vectors, logits) for some rows of one class at a time, few
        enough for a core's cache.

        The first half of vectors and logits is the classes', the other the members'; a column is a row's.
        """
        p = self.parts
        vectors, z = self.space("vectors", 2, CLASSES, WIDTH + 1), self.space("z", 2 * CLASSES * TILE)
        vectors[0, :, :WIDTH], vectors[0, :, WIDTH] = p["to_class"], self.class_bias
        weights = self.flat[_OUT]
        # Hidden values are within 1, so no logit is above the sum of a vector's absolute weights and its bias.
        reach = (np.abs(weights, out=self.space("weights", len(weights))).reshape(-1, WIDTH) @ _ONES[:WIDTH]).max() + self.bias_reach
        for c in range(CLASSES):
            if cuts[c + 1] > cuts[c]:
                vectors[1, :, :WIDTH], vectors[1, :, WIDTH] = p["to_member"][c], self.member_bias[c]
                for lo in range(cuts[c], cuts[c + 1], TILE):
                    hi = min(lo + TILE, cuts[c + 1])
                    tile = z[: 2 * CLASSES * (hi - lo)].reshape(2 * CLASSES, hi - lo)
                    np.matmul(vectors.reshape(-1, WIDTH + 1), held[lo:hi].T, out=tile)
                    if not reach < LOGIT:
                        np.clip(tile, -LOGIT, LOGIT, out=tile)
                    yield c, lo, hi, (CLASSES + member[lo:hi]) * (hi - lo) + _ROWS[: hi - lo], vectors, tile

    def forward(self, line: np.ndarray):
        """log p of each token of a line but its ``WINDOW`` first and last, 0 for borders; and its embeddings.

        The embeddings are good until the next line.
        """
        around, held, real, member, cuts = self._hidden(line)
        own, sums = self.space("own", len(real)), self.space("sums", 2, len(real))
        for c, lo, hi, at, _, z in self._tiles(held, member, cuts):
            np.add(z[c], z.reshape(-1)[at], out=own[lo:hi])
            np.exp(z, out=z)
            np.matmul(_ONES, z.reshape(2, CLASSES, -1), out=sums[:, lo:hi])
        np.log(sums, out=sums)
        logs = np.zeros(len(line) - 2 * WINDOW, np.float32)
        logs[real] = own - sums[0] - sums[1]
        return logs, (around,)

    def step(self, line: np.ndarray, squares: dict[str, np.ndarray], rate: float = RATE) -> None:
        """One Adagrad step on the mean negative log-likelihood of a line's inner tokens."""
        p = self.parts
        around, held, real, member, cuts = self._hidden(line)
        n = len(real)
        if not n:
            return
        inner, slope = self.space("inner", n, WIDTH), self.space("slope", 2 * CLASSES, WIDTH)
        classes, members = self.space("classes", CLASSES, WIDTH), self.space("members", CLASSES, MEMBERS, WIDTH)
        classes[:] = members[:] = 0
        for c, lo, hi, at, vectors, z in self._tiles(held, member, cuts):
            np.exp(z, out=z)
            both = z.reshape(2, CLASSES, -1)
            total = _ONES @ both
            z[c] -= total[0]
            z.reshape(-1)[at] -= total[1]
            total *= n
            both *= np.divide(1, total, out=total)[:, None]
            np.matmul(z.T, vectors.reshape(-1, WIDTH + 1)[:, :WIDTH], out=inner[lo:hi])
            np.matmul(z, held[lo:hi, :WIDTH], out=slope)
            classes += slope[:CLASSES]
            members[c] += slope[CLASSES:]
        slopes = {"to_class": classes, "to_member": members}
        curve = np.multiply(held[:, :WIDTH], held[:, :WIDTH], out=self.space("curve", n, WIDTH))
        inner *= np.subtract(1, curve, out=curve)
        slopes["shift"] = inner.sum(0)
        full, back, some = self.space("full", len(line) - 2 * WINDOW, WIDTH), self.space("back", len(line), WIDTH), self.space("some", STRETCH, WIDTH)
        full[:] = back[:] = 0
        full[real] = inner
        mix = self._wide()
        for lo in range(0, len(full), STRETCH):
            x = full[lo : lo + STRETCH]
            for d, weight in zip(_OFFSETS, mix, strict=True):
                back[WINDOW + d + lo : WINDOW + d + lo + len(x)] += np.multiply(x, weight[: len(x)], out=some[: len(x)])
        slopes["mix"] = np.stack([np.einsum("ij,ij->j", full, around[WINDOW + d : WINDOW + d + len(full)]) for d in _OFFSETS])
        order = np.argsort(line.astype(np.uint16), kind="stable")
        ids, starts, many = np.unique(line[order], return_index=True, return_counts=True)
        most = np.argsort(-many, kind="stable")
        ids, embed = ids[most], _summed_runs(np.take(back, order, axis=0, out=around, mode="clip"), starts[most], many[most])
        square = squares["embed"][ids]
        square += embed * embed
        squares["embed"][ids] = square
        p["embed"][ids] -= rate * embed / (np.sqrt(square) + 1e-6)
        for name, g in slopes.items():
            some = self.space(f"some {name}", *g.shape)
            squares[name] += np.multiply(g, g, out=some)
            np.sqrt(squares[name], out=some)
            some += 1e-6
            p[name] -= np.divide(np.multiply(g, rate, out=g), some, out=some)


def _summed_runs(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sums of runs of rows, the longest run first: the next row of all that have one, then what is left of a few."""
    out, at = rows[starts], 1
    while (longer := np.searchsorted(-lengths, -at)) > RUNS:
        out[:longer] += rows[starts[:longer] + at]
        at += 1
    for k in range(longer):
        out[k] += rows[starts[k] + at : starts[k] + lengths[k]].sum(0)
    return out


_OFFSETS = [d for d in range(-WINDOW, WINDOW + 1) if d]
_ROWS, _ONES = np.arange(TILE), np.ones(CLASSES, np.float32)
#: Where the output vectors are among the weights.
_OUT = slice((TOKENS + 1) * WIDTH, (TOKENS + 1 + TOKENS + CLASSES) * WIDTH)


def lined(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Texts one after the other with border tokens before, between and behind them."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.empty(0, np.int64)
    out = np.full(len(tokens) + WINDOW * (len(lengths) + 1), BORDER, np.int32)
    out[np.arange(len(tokens)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))] = tokens
    assert len(starts) == len(lengths)
    return out


def _batches(line: np.ndarray, most: int = BATCH) -> Iterator[np.ndarray]:
    """Even parts of a line of up to a batch, each with the tokens around it."""
    n = len(line) - 2 * WINDOW
    if n <= 0:
        return
    cuts = np.linspace(0, n, -(-n // most) + 1).astype(int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield line[lo : hi + 2 * WINDOW]


def _line_of(words: Vocabulary, lengths: pa.Scalar, places: pa.Scalar, hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's line of tokens, its texts' lengths and the places of its words."""
    n, at = np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64), _read(places, len(hashes))
    return lined(tokens[at] if len(at) else np.empty(0, np.int64), n), n, at


def _trained(flat: np.ndarray, words: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(flat, words.class_bias, words.member_bias), 0
        squares = {name: np.full_like(net.parts[name], 1e-6) for name, _ in Network.SHAPES}
        for batch in batches:
            for lengths, places, raw in zip(*[batch.column(i) for i in range(3)], strict=True):
                hashes = np.frombuffer(raw.as_buffer(), "<u8")
                line, n, _ = _line_of(words, lengths, places, hashes, words.tokens(hashes))
                for part in _batches(line):
                    net.step(part, squares)
                seen += int(n.sum())
        if seen:
            task = TaskContext.get().partitionId()
            blocks = [net.flat[k : k + BLOCK].astype("<f8") * seen for k in range(0, len(net.flat), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([task] * len(blocks), pa.int64()), pa.array([float(seen)] * len(blocks)), pa.array([x.tobytes() for x in blocks], pa.binary())],
                names=["block", "task", "tokens", "sums"],
            )

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One block's sum over tasks, in the order of the tasks."""
    rows = rows.sort_by("task")
    total = np.zeros(len(rows["sums"][0].as_buffer()) // 8)
    for x in rows["sums"]:
        total += np.frombuffer(x.as_buffer(), "<f8")
    return pa.table({"block": rows["block"][:1], "task": rows["task"][:1], "tokens": pa.array([float(np.sum(rows["tokens"].to_numpy()))]), "sums": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The network's weights after so many rounds over the table of chunks."""
    schema = "block int, task long, tokens double, sums binary"
    flat = Network().flat
    for _ in range(rounds):
        blocks = rows.select("lengths", "places", "words").mapInArrow(_trained(flat, words), schema)
        # Added up by some hundred tasks, then over those: no group holds a block of every task.
        some = blocks.groupBy("block", F.floor(F.col("task") / ADDED).alias("g")).applyInArrow(_added, schema)
        got = {r["block"]: np.frombuffer(r["sums"], "<f8") / r["tokens"] for r in some.groupBy("block").applyInArrow(_added, schema).collect()}  # one model, whose size is fixed
        if got:
            flat = np.concatenate([got[b] for b in sorted(got)]).astype(np.float32)
    return flat


def _by_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values, dtype=float)]
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def line_logs(net: Network, line: np.ndarray) -> np.ndarray:
    """log p of each token of a line that isn't a border."""
    logs = [net.forward(part)[0] for part in _batches(line, SCORED)]
    inner = line[WINDOW : len(line) - WINDOW]
    return np.concatenate(logs)[inner != BORDER] if logs else np.empty(0)


def _scored(flat: np.ndarray, words: Vocabulary):
    """Scores of chunks: of their tokens, and of each word in its token."""

    def run(rows: pa.Table, logs: pa.Table) -> pa.Table:
        net = Network(flat, words.class_bias, words.member_bias)
        docs, counts, sums = [], [], []
        for ids, lengths, places, raw in zip(rows["docs"], rows["lengths"], rows["places"], rows["words"], strict=True):
            hashes = np.frombuffer(raw.as_buffer(), "<u8")
            tokens = words.tokens(hashes)
            line, n, at = _line_of(words, lengths, places, hashes, tokens)
            order = np.argsort(logs["part"].to_numpy(), kind="stable")
            own = np.concatenate([np.frombuffer(logs["logs"][int(k)].as_buffer(), "<f4") for k in order]) if len(hashes) else np.empty(0)
            shared = tokens % MEMBERS >= NAMED // CLASSES
            inside = np.where(shared, own - words.token_logs[tokens], 0.0) if len(hashes) else own
            docs += ids.as_py()
            counts.append(n)
            sums.append(_by_text(line_logs(net, line), n) + _by_text(inside[at] if len(at) else np.empty(0), n))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(np.concatenate(counts)), "log_likelihood": pa.array(np.concatenate(sums).astype(float))})

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood (summed), per_token."""
    rows = chunks(docs)
    counts = word_counts(rows)
    words = vocabulary(rows, counts)
    run = _scored(train(rows, words, rounds), words)
    tasks = parts_for(docs.sparkSession, rows.count(), TASK_CHUNKS)
    held = rows.select("chunk", "docs", "lengths", "places", "words").repartition(tasks, "chunk").groupBy("chunk")
    logs = counts.filter("logs is not null").select("chunk", "part", "logs").repartition(tasks, "chunk").groupBy("chunk")
    out = held.cogroup(logs).applyInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
