"""Lexical retrieval packing: documents that share rare tokens are packed into the same sequences."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.common import hash_share, written
from tabloom.llm.vectors import blocks, chained, kmeans

GROUP_BYTES = 8 << 20  # texts that are tokenised together
WORDS_KEPT = 250_000  # words whose ids a task keeps from group to group
BATCH_ROWS = 2_048  # remainders whose terms are counted together
SKETCH, CODE_BITS, LISTS = 256, 8, 1_024  # numbers of a sketched weight vector, planes that cut a list, most lists
TOLERANCE, CHOICES = 0.4, 64  # lists within so many typical centre lengths of the nearest one are as good; random choices kept per term
COMMON = 16  # terms in a sixteenth of a shard's rows or more are kept dense
RANKED, PARTNER = 128, 0.5  # best neighbours of a seed that fill windows; share of rare terms that makes a close partner
MOST_PARTITIONS = 20_000
K1, B = 1.2, 0.75
LETTERS = "abcdefghijklmnopqrstuvwxyzß" + "".join(map(chr, range(0xE0, 0x100))).replace("÷", "")
ENDING = ".,!?;:|#$%&*\"()[]{}+=/~^@`-_\\"  # no apostrophe, which starts some pre-tokens, no < or >, which stand in special tokens
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]{1,64}[.,!?;:|#$%&*\"()\[\]{}+=/~^@`\-_\\]*$"
SAMPLES = ("Word", "straße.", "ÉTÉ!!", "niño,***", "a\")", "oneandanother###")
# byte-level vocabularies write bytes outside printable Latin-1 as the characters from 256 on
BYTE_CHARACTERS = np.arange(256, dtype="<u4")
_unprinted = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_CHARACTERS[_unprinted] = 256 + np.arange(len(_unprinted))


class TextIds:
    """Token ids of texts, by the distinct parts between ASCII white space, which no token crosses.

    A word of Latin letters is one pre-token, and so is a run of punctuation behind it, so their ids come from the tokenizer's own model and
    from the tokenizer; each distinct word is asked for once. All other parts go through the whole tokenizer. Words are only taken apart
    this way where the tokenizer is found to treat some samples so.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.parted = Tokenizer.from_file(path), True
        self.known, self.known_sizes, self.known_ids = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32)
        found = self._parts(pa.array(SAMPLES))
        self.parted = [x.tolist() for x in np.split(found[0], np.cumsum(found[1])[:-1])] == self._whole(SAMPLES)

    def _whole(self, parts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(parts), add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the kept words and of ``words`` that are not among them, one after another, how many each has, and the place of ``words`` there.

        The first words that come are kept.
        """
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(place.is_null())
        sizes, ids = array("i"), array("i")
        tokenize = self.tokenizer.model.tokenize
        for word in _byte_characters(new):
            found = [t.id for t in tokenize(word)]
            ids.fromlist(found)
            sizes.append(len(found))
        index = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        index[index < 0] = len(self.known) + np.arange(len(new))
        sizes = np.append(self.known_sizes, np.frombuffer(sizes, np.int32))
        ids = np.append(self.known_ids, np.frombuffer(ids, np.int32))
        if room := min(len(new), WORDS_KEPT - len(self.known)):
            self.known = pa.concat_arrays([self.known, new[:room]])
            self.known_sizes = sizes[:len(self.known)].copy()
            self.known_ids = ids[:self.known_sizes.sum()].copy()
        return ids, sizes, index

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts one after another, and how many each has."""
        plain = pc.match_substring_regex(parts, PLAIN) if self.parted else pa.array(np.zeros(len(parts), bool))
        low = pc.utf8_lower(parts.filter(plain))
        words, ends = pc.utf8_rtrim(low, ENDING).dictionary_encode(), pc.utf8_ltrim(low, LETTERS).dictionary_encode()
        values, sizes, place = self._words(words.dictionary)
        asked = len(sizes)
        others = self._whole(ends.dictionary.to_pylist()) + self._whole(parts.filter(pc.invert(plain)).to_pylist())
        values = np.append(values, np.fromiter(chain.from_iterable(others), np.int32))
        sizes = np.append(sizes, np.fromiter(map(len, others), np.int64, len(others)))
        first, second = np.full(len(parts), -1), np.full(len(parts), -1)
        plain = plain.to_numpy(zero_copy_only=False)
        first[plain], second[plain] = place[words.indices.to_numpy()], ends.indices.to_numpy() + asked
        first[~plain] = np.arange((~plain).sum()) + asked + len(ends.dictionary)
        both = np.stack([first, second], axis=1).ravel()
        return _gathered(values, sizes, both[both >= 0]), sizes[first] + np.where(second >= 0, sizes[second], 0)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text; NULL texts have none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        parts = lists.flatten().dictionary_encode()
        values, sizes = self._parts(parts.dictionary)
        index = parts.indices.to_numpy()
        stops = np.append(0, np.cumsum(sizes[index]))
        offsets = lists.offsets.to_numpy()
        return _gathered(values, sizes, index), stops[offsets - offsets[0]]


def _byte_characters(words: pa.Array) -> list[str]:
    """Words without spaces as the characters that stand for their bytes, all of them turned at once."""
    if not len(words):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
    if not joined.isascii():
        joined = BYTE_CHARACTERS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
        return joined.split(chr(BYTE_CHARACTERS[ord(" ")]))
    return joined.split(" ")


def _gathered(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Runs of ``values`` (of ``sizes``, one after another) in the order of ``index``."""
    total = int(sizes[index].sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    begins, lengths = (np.cumsum(sizes) - sizes).astype(kind)[index], sizes.astype(kind)[index]
    begins -= np.cumsum(lengths, dtype=kind) - lengths
    at = np.repeat(begins, lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def _tokenised(path: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TextIds(path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // GROUP_BYTES, prepend=-1)).tolist() + [batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                ids, bounds = tokens.ids(part.column(1))
                rows = [np.append(ids[a:b], end_id).astype(dtype).tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["id", "ids"])
        pa.default_memory_pool().release_unused()  # the process goes on with other tasks
    return run


def _rest(ids: np.ndarray, window: int) -> np.ndarray:
    """What is left of a document after its full windows."""
    return ids[len(ids) // window * window:]


def _rests(column, dtype: str, window: int) -> Iterator[list[np.ndarray]]:
    """The remainders of a column of ids, some rows at a time."""
    raw = column.to_pylist()
    for start in range(0, len(raw), BATCH_ROWS):
        yield [_rest(np.frombuffer(r, dtype), window) for r in raw[start:start + BATCH_ROWS]]


def _distinct(rests: Sequence[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, term, count)`` of every distinct term of every remainder, in the order of rows and terms, and the remainders' lengths."""
    lengths = np.fromiter(map(len, rests), np.int64, len(rests))
    if not lengths.sum():
        return *(np.zeros(0, np.int64) for _ in range(3)), lengths
    kind = np.uint32 if len(rests) * vocabulary < 1 << 32 else np.int64  # sorted faster, in half the room
    keys = np.repeat(np.arange(len(rests), dtype=kind) * kind(vocabulary), lengths)
    keys += np.concatenate(rests)
    keys, often = np.unique(keys, return_counts=True)
    rows = keys // kind(vocabulary)
    return rows, keys - rows * kind(vocabulary), often, lengths


def _term_counts(window: int, dtype: str, vocabulary: int):
    """Per task: in how many remainders each token occurs; token -1 carries the lengths, -2 the number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(vocabulary, np.int64)
        rests = tokens = 0
        for batch in batches:
            for some in _rests(batch.column(0), dtype, window):
                _, terms, _, lengths = _distinct(some, vocabulary)
                held += np.bincount(terms, minlength=vocabulary)
                rests, tokens = rests + int((lengths > 0).sum()), tokens + int(lengths.sum())
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2])), pa.array(np.append(held[found], [tokens, rests]))], ["term", "n"])
    return run


class Weights:
    """BM25 weights from the counts of all remainders."""

    def __init__(self, rows, dtype: str, vocabulary: int):
        counts = dict(rows)
        self.dtype, self.vocabulary, self.rests = dtype, vocabulary, max(1, counts.pop(-2, 0))
        self.mean = max(1.0, counts.pop(-1, 0) / self.rests)
        self.idf = np.zeros(vocabulary)
        for term, n in counts.items():
            self.idf[term] = np.log1p((self.rests - n + 0.5) / (n + 0.5))

    def of(self, rests: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, weight)`` of every distinct term of every remainder."""
        rows, terms, often, lengths = _distinct(rests, self.vocabulary)
        return rows, terms, self.idf[terms] * often * (K1 + 1) / (often + K1 * (1 - B + B * lengths[rows] / self.mean))


class Lists:
    """Shards of near remainders: k-means lists of sketched weight vectors, merged or cut to about ``rows`` rows by what a sample holds."""

    def __init__(self, weights: Weights, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.weights = weights
        self.place, self.sign = rng.integers(0, SKETCH, weights.vocabulary), rng.choice([-1.0, 1.0], weights.vocabulary)
        self.planes = rng.normal(size=(SKETCH, CODE_BITS))
        self.luck, self.choice = rng.exponential(size=weights.vocabulary), rng.random((weights.vocabulary, CHOICES))

    def sketched(self, rests: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors whose products estimate those of the weight vectors, zero without terms; and an anchor term of each remainder.

        The anchor is a term drawn by weight with draws that all remainders share, so two of them have the same one as often as they are alike.
        """
        rows, terms, weight = self.weights.of(rests)
        x = np.bincount(rows * SKETCH + self.place[terms], weight * self.sign[terms], len(rests) * SKETCH).reshape(-1, SKETCH)
        anchor = np.zeros(len(rests), np.int64)
        if len(rows):
            draw = self.luck[terms] / np.maximum(weight, 1e-12)
            begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))  # a row's terms stand side by side
            least = np.flatnonzero(draw == np.repeat(np.minimum.reduceat(draw, begins), np.diff(np.append(begins, len(rows)))))[::-1]
            anchor[rows[least]] = terms[least]  # of equal draws the smallest term is written last
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), anchor

    def learn(self, sample: np.ndarray, anchor: np.ndarray, rows: int, seed: int = 0) -> None:
        share = self.weights.rests / max(1, len(sample))
        self.middle = sample.mean(axis=0) if len(sample) else np.zeros(SKETCH)
        near = self._centred(sample)
        self.centres = kmeans(near, int(np.clip(2 * self.weights.rests // rows, 1, LISTS)), seed)
        home, code = self._cells(near, anchor)
        counts = np.bincount(home, minlength=len(self.centres)) * share
        self.first, self.number = blocks(np.ceil(counts).astype(np.int64), chained(self.centres), rows)
        # a list of several shards is cut along its codes
        self.cuts = [np.zeros(0)] * len(self.centres)
        for k in np.flatnonzero(self.number > 1):
            inside = np.sort(code[home == k])
            self.cuts[k] = inside[(np.arange(1, self.number[k]) * len(inside) // self.number[k])]

    def _centred(self, x: np.ndarray) -> np.ndarray:
        x = x - self.middle
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _cells(self, x: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of centred vectors: the sides of some planes through the list's centre.

        Of lists that are nearly as near as the nearest one the anchor decides, so that like remainders between lists go the same way.
        """
        norms = (self.centres ** 2).sum(axis=1)
        score = x @ self.centres.T - 0.5 * norms
        close = score >= score.max(axis=1, keepdims=True) - TOLERANCE * np.sqrt(norms.mean())
        home = np.where(close, self.choice[anchor][:, np.arange(len(norms)) % CHOICES], -1.0).argmax(axis=1)
        return home, (((x - self.centres[home]) @ self.planes) > 0) @ (1 << np.arange(CODE_BITS))

    def placed(self, rests: Sequence[np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and place in it of every remainder; rows on a cut that several shards share are dealt by their hash."""
        x, anchor = self.sketched(rests)
        home, code = self._cells(self._centred(x), anchor)
        shard = self.first[home].copy()
        for k in np.unique(home[self.number[home] > 1]):
            mine = np.flatnonzero(home == k)
            low, high = (np.searchsorted(self.cuts[k], code[mine], side) for side in ("left", "right"))
            shard[mine] += low + nodes[mine] % (high - low + 1)
        return shard, home * (1 << CODE_BITS) + code


def _sampled(lists: Lists, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _rests(batch.column(0), lists.weights.dtype, window):
                x, anchor = lists.sketched([r for r in some if len(r)])
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x.astype("<f4")], pa.binary()), pa.array(anchor)], ["x", "anchor"])
    return run


def _placed(lists: Lists, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(2).to_numpy()
            found = [lists.placed(some, nodes[k * BATCH_ROWS:(k + 1) * BATCH_ROWS]) for k, some in enumerate(_rests(batch.column(1), lists.weights.dtype, window))]
            shard, place = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shard, pa.int64()), pa.array(place, pa.int64())],
                                             ["id", "ids", "node", "shard", "place"])
    return run


class Index:
    """Inverted index with BM25 weights over the remainders of one shard.

    Terms of many rows are kept as rows of a dense table, the others as lists of rows and weights.
    """

    def __init__(self, rests: Sequence[np.ndarray], weights: Weights):
        self.count = len(rests)
        rows, terms, weight = [np.zeros(0, np.int32)], [np.zeros(0, weights.dtype)], [np.zeros(0)]
        for start in range(0, self.count, BATCH_ROWS):  # some at a time, for what is made on the way is several times as long
            r, t, w = weights.of(rests[start:start + BATCH_ROWS])
            rows.append((r + start).astype(np.int32))
            terms.append(t.astype(weights.dtype))
            weight.append(w)
        rows, terms = np.concatenate(rows), np.concatenate(terms)
        self.queries = np.split(terms, np.searchsorted(rows, np.arange(1, self.count, dtype=np.int32))) if self.count else []
        order = np.argsort(terms, kind="stable").astype(np.int32)
        self.rows, rows = rows[order], None
        weight = np.concatenate(weight)
        self.weights = weight[order]
        del weight, order
        self.sizes = np.bincount(terms, minlength=weights.vocabulary)
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.asked: tuple[int, np.ndarray] | None = None  # the last row asked for its rare terms, with its scores
        common = np.flatnonzero(self.sizes * COMMON >= max(1, self.count))
        self.dense = np.zeros((len(common), self.count), np.float32)
        self.slot = np.full(weights.vocabulary, -1)
        self.slot[common] = np.arange(len(common))
        for k, term in enumerate(common):
            span = slice(self.starts[term], self.starts[term + 1])
            self.dense[k, self.rows[span]] = self.weights[span]

    def _rare(self, row: int) -> np.ndarray:
        """BM25 scores of all rows for the terms of ``row`` that few rows have."""
        if self.asked is None or self.asked[0] != row:
            terms = self.queries[row]
            terms = terms[self.slot[terms] < 0]
            begins, sizes = self.starts[terms], self.sizes[terms]
            at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            self.asked = row, np.bincount(self.rows[at], self.weights[at], self.count)
        return self.asked[1]

    def scores(self, row: int) -> np.ndarray:
        """BM25 scores of all rows for all terms of ``row``."""
        slots = self.slot[self.queries[row]]
        total = np.zeros(self.count, np.float32)
        for slot in slots[slots >= 0].tolist():
            total += self.dense[slot]
        return self._rare(row) + total

    def partner(self, row: int, unused: np.ndarray) -> int | None:
        """The unused row that shares most of the rare terms of ``row`` by weight, if any shares at least half."""
        score = self._rare(row)
        least, score = PARTNER * score[row], np.where(unused, score, 0.0)
        best = int(score.argmax())
        return best if score[best] > 0 and score[best] >= least else None

    def neighbours(self, row: int, unused: np.ndarray) -> np.ndarray:
        """The ``RANKED`` best unused rows that share a term with ``row``, best first, ties by row."""
        score = np.where(unused, self.scores(row), 0.0)
        found = np.flatnonzero(score > 0)
        if len(found) > RANKED:
            found = found[score[found] >= np.partition(score[found], len(found) - RANKED)[len(found) - RANKED]]
        return found[np.lexsort((found, -score[found]))][:RANKED]


class _Packer:
    """Fills the windows of one shard."""

    def __init__(self, window: int, weights: Weights, first_sequence: int):
        self.window, self.weights, self.sequence = window, weights, first_sequence
        self.open: list[tuple] = []  # (id, start, ids, tokens of the document)
        self.filled = 0
        self.ids: list = []
        self.rests: list[np.ndarray] = []
        self.tokens: list[int] = []

    def add(self, id_, whole: np.ndarray) -> Iterator[tuple]:
        """Keeps the remainder of a document; its full windows are sequences of their own."""
        for start in range(0, len(whole) - self.window + 1, self.window):
            yield from self._closed([(id_, start, whole[start:start + self.window], len(whole))])
        rest = _rest(whole, self.window)
        if len(rest):
            self.ids.append(id_)
            self.rests.append(rest.copy())  # the document itself may be long
            self.tokens.append(len(whole))

    def _closed(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for id_, start, ids, tokens in pieces:
            yield id_, start, len(ids), np.asarray(ids, "<u4").tobytes(), tokens, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def _put(self, id_, start, ids, tokens) -> tuple[list[tuple], np.ndarray]:
        """Places what fits; returns the finished pieces if the window is full, and what is left of the ids."""
        fits = ids[:self.window - self.filled]
        self.open.append((id_, start, fits, tokens))
        self.filled += len(fits)
        done = []
        if self.filled == self.window:
            done, self.open, self.filled = list(self._closed(self.open)), [], 0
        return done, ids[len(fits):]

    def _place(self, row: int) -> Iterator[tuple]:
        """Puts a remainder into the open window; what does not fit opens the next one."""
        id_, rest, tokens = self.ids[row], self.rests[row], self.tokens[row]
        done, left = self._put(id_, tokens - len(rest), rest, tokens)
        yield from done
        if len(left):
            self._put(id_, tokens - len(left), left, tokens)

    def packed(self) -> Iterator[tuple]:
        """Windows of the shard. A document's close partner follows it; then come the neighbours of the seed that fit whole, best first; when
        none does, the last document is the next seed, and its best neighbour is cut and opens the next window. Without a neighbour the next
        unused document is taken."""
        index, unused = Index(self.rests, self.weights), np.ones(len(self.rests), bool)
        sizes = np.array([len(r) for r in self.rests], np.int64)
        ranked, last, first = np.zeros(0, np.int64), None, 0
        while True:
            row = index.partner(last, unused) if last is not None else None
            if row is None:
                fits = ranked[unused[ranked] & (sizes[ranked] <= self.window - self.filled)]
                if not len(fits) and last is not None:
                    ranked = fits = index.neighbours(last, unused)
                if len(fits):
                    row = int(fits[0])
                else:
                    while first < len(sizes) and not unused[first]:
                        first += 1
                    if first == len(sizes):
                        yield from self._last()
                        return
                    row = first
            unused[row], last = False, row
            yield from self._place(row)

    def _last(self) -> Iterator[tuple]:
        """The open window cut into sequences whose lengths are powers of two, so that none needs padding."""
        left = self.open
        for power in range(self.window.bit_length() - 1, -1, -1):
            size, pieces = 1 << power, []
            if not (self.filled >> power) & 1:
                continue
            while size:
                id_, start, ids, tokens = left[0]
                take = min(size, len(ids))
                pieces.append((id_, start, ids[:take], tokens))
                size -= take
                left = ([(id_, start + take, ids[take:], tokens)] if take < len(ids) else []) + left[1:]
            yield from self._closed(pieces)
        self.open, self.filled = [], 0


PIECES = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _packed(window: int, weights: Weights, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, []
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def full(pieces: Iterator[tuple], least: int = 1024) -> Iterator[pa.RecordBatch]:
            for piece in pieces:
                held.append(piece)
                if len(held) >= least:
                    yield flushed()

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *types))], ["id", *PIECES])

        packer = shard = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for id_, raw, now in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                if packer is not None and (now != shard or len(packer.rests) >= shard_rows):
                    yield from full(packer.packed())
                    packer = _Packer(window, weights, packer.sequence) if now == shard else None
                if packer is None:
                    packer, shard = _Packer(window, weights, now << 40), now
                yield from full(packer.add(id_.as_py(), np.frombuffer(raw.as_py(), weights.dtype)))
        if packer is not None:
            yield from full(packer.packed())
        if held:
            yield flushed()
    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = 2048, end_id: int = 1,
         rows_per_task: int = 8_192, training_rows: int = 12_000) -> DataFrame:
    """Packs documents into sequences of ``window`` tokens; near documents, by BM25 over token ids, share sequences.

    Returns ``(id_col, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece: ``ids`` are little-endian unsigned
    32-bit, ``start`` counts the document's ids before the piece, ``offset`` the sequence's. Every id lies in exactly one piece.

    1. Texts are tokenised (``end_id`` after each) and written once; the number of remainders that hold each token is summed over all of
       them, a table no longer than the vocabulary. Full windows of long documents are sequences of their own; the remainders are packed.
    2. Shards of near remainders: weight vectors are sketched to 256 numbers, k-means on about ``training_rows`` of them gives lists, and lists
       are merged or cut to about ``rows_per_task`` remainders. A remainder is dealt to one shard by its own vector alone, so shards depend
       neither on partitions nor on the cluster; documents are shuffled once.
    3. A task makes an inverted index with BM25 weights of one shard after another, of ``rows_per_task`` remainders at most. All terms of a
       seed are asked; its unused neighbours fill the window, best first: those that fit are taken whole, each followed by its close partner,
       and the last of them is the next seed, whose best neighbour is cut and opens the next window. The last window of a shard is cut into
       powers of two, which need no padding.

    Neighbours in other shards are not found: on few documents there is one shard, on many a share of the nearest stands in others (README).
    A NULL or empty text is the end id alone. Ties go to the order of codes and hashes. Repeated rows are packed each by itself, NULL ids stay
    NULL. A very long text is tokenised whole in one task, but only its remainder is held for packing. An empty table gives no piece. Extra
    columns are ignored.
    """
    from tokenizers import Tokenizer

    kind = dict(df.dtypes)[id_col]
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tokens = written(texts.mapInArrow(_tokenised(tokenizer, end_id, dtype), f"id {kind}, ids binary"), "tokens")
    counts = tokens.select("ids").mapInArrow(_term_counts(window, dtype, vocabulary), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    weights = Weights([(r["term"], r["n"]) for r in counts.collect()], dtype, vocabulary)  # no longer than the vocabulary
    tokens = tokens.withColumn("node", F.xxhash64("id", "ids"))
    lists = Lists(weights)
    picked = tokens.where(hash_share(F.col("node"), min(1.0, training_rows / weights.rests))).select("ids").mapInArrow(_sampled(lists, window), "x binary, anchor bigint")
    rows = sorted((bytes(r["x"]), r["anchor"]) for r in picked.collect())
    lists.learn(np.frombuffer(b"".join(x for x, _ in rows), "<f4").reshape(-1, SKETCH).astype(np.float64), np.array([a for _, a in rows], np.int64), rows_per_task)
    placed = tokens.select("id", "ids", "node").mapInArrow(_placed(lists, window), f"id {kind}, ids binary, node bigint, shard bigint, place bigint")
    shards = int((lists.first + lists.number).max())
    near = placed.repartition(min(2 * shards, MOST_PARTITIONS), "shard").sortWithinPartitions("shard", "place", "node").select("id", "ids", "shard")
    pieces = near.mapInArrow(_packed(window, weights, rows_per_task), f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return pieces.withColumnRenamed("id", id_col)
