"""SentencePiece encoding and decoding: distinct marked words in trie order, forward states shared between words with a common prefix."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabloom.llm.chunks import ChunkTable

MARK = "▁"
GROUP_CHARS = 1_500_000  # characters of texts that are encoded together
PAIRS_KEPT, TAILS_KEPT = 400_000, 100_000


class Pieces:
    """Vocabulary of a model: normal pieces with scores, byte pieces, and whether pieces come from ranked merges."""

    def __init__(self, names: Sequence[str], scores: Sequence[float], normal: Sequence[bool], byte_ids: Sequence[int | None], unknown: int):
        self.names, self.scores, self.byte_ids, self.unknown = list(names), list(scores), list(byte_ids), unknown
        self.ids = {name: k for k, (name, use) in enumerate(zip(names, normal)) if use}
        used = [scores[k] for k in self.ids.values()]
        self.ranked = bool(used) and all(float(s).is_integer() and s <= 0 for s in used)
        self.lowest = min(used, default=0.0) - 10  # of an unknown character, where pieces have probabilities
        self.tails: dict[str, set[int]] = {}  # lengths of pieces by their last characters, three at most
        for name in self.ids:
            self.tails.setdefault(name[-3:], set()).add(len(name))
        self.tried: dict[str, tuple[int, ...]] = {}
        self.parting = "\n" if not any("\n" in n for n in self.ids) else ""  # a character in no piece parts words

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(len(model))
        bytes_ = [None] * 256
        for k in every:
            if model.is_byte(k):
                bytes_[int(model.id_to_piece(k)[3:5], 16)] = k
        normal = [not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in every]
        pieces = cls([model.id_to_piece(k) for k in every], [model.get_score(k) for k in every], normal, bytes_, model.unk_id())
        pieces.normalise = model.normalize
        return pieces

    def lengths(self, tail: str) -> tuple[int, ...]:
        """Lengths of the pieces that can end in ``tail`` (three characters, fewer at the start of a word), longest first."""
        found = self.tried.get(tail)
        if found is None:
            found = set().union(*(self.tails.get(tail[k:], set()) for k in range(len(tail))))
            found = tuple(sorted((n for n in found if n <= len(tail) or len(tail) == 3), reverse=True))
            if len(self.tried) < TAILS_KEPT:
                self.tried[tail] = found
        return found

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def words(self, text: str | None) -> list[str]:
        """Marked words: no piece reaches from one into the next."""
        marked = self.normalise(text) if text else ""
        if not marked:
            return []
        if MARK * 2 in marked or " " in marked:
            return re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.parting else f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        marked = marked.replace(MARK, " " + MARK)
        if self.parting:
            marked = marked.replace("\n", " \n ")
        return [w for w in marked.split(" ") if w]

    def unknown_ids(self, character: str) -> list[int]:
        ids = [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in ids else ids


class PrefixViterbi:
    """Segments words in sorted order, which is the depth-first order of their trie: the forward states of the common prefix are kept.

    With probabilities a state is the best sum of scores. With ranked merges it is the last piece of the prefix's segmentation: there is
    exactly one piece that can follow the segmentation of what is before it so that no merge crosses the boundary, which only depends on the
    two pieces side by side. Both look at the pieces that end at a position, and both states depend on the prefix alone.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.pairs = pieces, {}

    def merged(self, text: str) -> list[str]:
        """Segmentation by merging the best-ranked neighbours, leftmost first, over and over."""
        parts, ids, scores = list(text), self.pieces.ids, self.pieces.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: int, right: int) -> bool:
        """Whether the merges of both pieces side by side leave the boundary between them. -1: nothing, or an unknown character."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            b = self.pieces.names[right]
            if left < 0:
                known = len(b) == 1 or len(self.merged(b)) == 1
            else:
                a = self.pieces.names[left]
                known = a + b not in self.pieces.ids and self.merged(a + b) == [a, b]
            if len(self.pairs) < PAIRS_KEPT:
                self.pairs[key] = known
        return known

    def segment(self, words: Sequence[str]) -> tuple[list[int], list[int]]:
        """Ids of sorted words one after another, and how many each has."""
        values, sizes, before = [], [], ""
        last, begin, best = [-1], [0], [0.0]  # by position: last piece (-1: unknown character), its start, the score so far
        extend = self._extend_ranked if self.pieces.ranked else self._extend_scored
        for word in words:
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del last[same + 1:], begin[same + 1:], best[same + 1:]
            extend(word, same, last, begin, best)
            found, end = [], len(word)
            while end:
                if last[end] >= 0:
                    found.append(last[end])
                else:
                    found += self.pieces.unknown_ids(word[end - 1])[::-1]
                end = begin[end]
            found.reverse()
            values += found
            sizes.append(len(found))
            before = word
        return values, sizes

    def _extend_ranked(self, word: str, same: int, last: list, begin: list, best: list) -> None:
        ids, tried, lengths, pairs, follows = self.pieces.ids, self.pieces.tried, self.pieces.lengths, self.pairs, self._follows
        for end in range(same + 1, len(word) + 1):
            tail = word[end - 3:end] if end > 2 else word[:end]
            piece, start = -1, end - 1
            for length in tried.get(tail) or lengths(tail):
                at = end - length
                if at < 0:
                    continue
                found = ids.get(word[at:end])
                if found is None:
                    continue
                known = pairs.get(last[at] << 32 | found) if at else None
                if known is None:
                    known = follows(last[at] if at else -1, found)
                if known:
                    piece, start = found, at
                    break
            last.append(piece)
            begin.append(start)
            best.append(0.0)

    def _extend_scored(self, word: str, same: int, last: list, begin: list, best: list) -> None:
        ids, scores, lowest = self.pieces.ids, self.pieces.scores, self.pieces.lowest
        for end in range(same + 1, len(word) + 1):
            piece, start, top = -1, end - 1, best[end - 1] + lowest
            for length in self.pieces.lengths(word[max(0, end - 3):end]):
                at = end - length
                found = ids.get(word[at:end]) if at >= 0 else None
                if found is not None and best[at] + scores[found] > top:
                    piece, start, top = found, at, best[at] + scores[found]
            last.append(piece)
            begin.append(start)
            best.append(top)


class MarkedWords(ChunkTable):
    """Ids of distinct marked words."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.viterbi = PrefixViterbi(pieces)

    def encoded(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        values, sizes = (np.array(x, np.int64) for x in self.viterbi.segment([chunks[k] for k in order]))
        place = np.argsort(order)
        ends, lengths = np.cumsum(sizes), sizes[place]
        stops = np.cumsum(lengths)
        return values[np.repeat((ends - sizes)[place] - (stops - lengths), lengths) + np.arange(len(values))], lengths


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        table = MarkedWords(pieces)
        for batch in batches:
            texts, start, size = batch.column(1).to_pylist(), 0, 0
            for k, text in enumerate(texts):
                size += len(text or "") + 1
                if size >= GROUP_CHARS or k == len(texts) - 1:
                    ids = [x.astype("<u4").tobytes() for x in table.ids([pieces.words(t) for t in texts[start:k + 1]])]
                    part = batch.slice(start, len(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["id", "text", "ids"])
                    start, size = k + 1, 0
    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        table = [name.replace(MARK, " ").encode() if name in pieces.ids else b"" for name in pieces.names]
        table[pieces.unknown] = " ⁇ ".encode()
        for byte, k in enumerate(pieces.byte_ids):
            if k is not None:
                table[k] = bytes([byte])
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [b"".join(map(table.__getitem__, np.frombuffer(raw.as_buffer(), "<u4").tolist())).decode("utf-8", "replace") if raw.is_valid else None
                         for raw in part.column(2)]
                texts = [t[1:] if t and t[0] == " " else t for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "text", "ids", "decoded"])
    return run


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_col, ids)``: ids of whole texts as little-endian unsigned 32-bit numbers, those the model's own library gives.

    A task cuts texts into marked words (white space becomes a mark before the word), collects the distinct ones of some hundred texts and
    segments them in trie order; the ids of a bounded number of words are kept. Characters in no piece become byte pieces, or the unknown
    piece. NULL and empty texts have no ids. A very long text is one group, read whole. Rows are independent: ties and repeated rows need no
    rule, and extra columns are ignored. The model's path is read by every task.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encoded(model), f"id {kind}, text string, ids binary")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "ids")


def round_trip(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_col, ids, decoded)``: ``encode`` and ``decode`` in one pass, for checking that texts come back."""
    kind = dict(df.dtypes)[id_col]
    encoded, decoded = _encoded(model), _decoded(model)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda batches: decoded(encoded(batches)), f"id {kind}, text string, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "ids", "decoded")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids: marks become blanks, the first one goes. NULL ids decode to NULL, unknown ones to a sign."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(_decoded(model), f"id {kind}, text string, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("ids").alias(ids_col), "decoded")
