from itertools import combinations

import numpy as np
import public_tokenizers
import sentencepiece

from tabloom.llm.sentencepieces import MARK, MarkedWords, Pieces, PrefixViterbi, decode, encode, round_trip
from tests.llm.awkward import documents, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["Hello  world\n<s> 中\U0001F600 x", "", " ", "  a  ", "▁a\ta\x00b ﬁ", "a▁▁b ▁ c", "<0x0A> <unk>", "x" * 300, "\n\n a \n", "é́a ÀÉÎ 漢字かな", "the " * 50,
        "    indent        more", "a　b c d\r\n", None, "aaaa aaaaaaaaa bbbbbb", "12345678 3.14159!!??"]


def split(values, sizes):
    ends = np.cumsum(sizes)
    return [values[end - size:end] for end, size in zip(ends, sizes)]


def test_ids_are_the_librarys():
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces.load(PATH)
    assert pieces.ranked
    found = MarkedWords(pieces).ids([pieces.words(t) for t in HARD])
    assert [x.tolist() for x in found] == [library.encode(t or "") for t in HARD]


def test_documents_round_trip(spark):
    library, df = sentencepiece.SentencePieceProcessor(model_file=PATH), documents(spark)
    rows = decode(encode(df, PATH), PATH).collect()
    assert len(rows) == df.count() and sorted(map(str, rows)) == sorted(map(str, round_trip(df, PATH).collect()))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode(r.text or "")
        assert r.decoded == library.decode(ids) == (r.text or "").replace(MARK, " ")
    assert encode(empty(df), PATH).collect() == []


def test_no_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, "t", None), (2, "t", b"")], "doc_id long, text string, ids binary")
    assert [r.decoded for r in decode(df, PATH).orderBy("doc_id").collect()] == [None, ""]


def test_probabilities_match_every_segmentation():
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", MARK, MARK + "a", MARK + "ab"]
    scores = [-2.1, -2.3, -2.2, -3.3, -3.1, -5.9, -3.05, -4.7, -1.5, -3.0, -4.05]
    pieces = Pieces(names, scores, [True] * len(names), [None] * 256, 99)
    assert not pieces.ranked
    words = [MARK + w for w in ("abc", "abcab", "cabca", "a", "abx", "xab", "ccc", "abcabcab")]
    for word, found in zip(sorted(words), split(*PrefixViterbi(pieces).segment(sorted(words)))):
        best = None
        for k in range(len(word)):
            for cuts in combinations(range(1, len(word)), k):
                parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
                if all(p in pieces.ids or len(p) == 1 for p in parts):
                    score = sum(pieces.scores[pieces.ids[p]] if p in pieces.ids else pieces.lowest for p in parts)
                    best = max(best or (score, parts), (score, parts))
        assert sum(pieces.scores[i] if i != 99 else pieces.lowest for i in found) == best[0], word


def test_common_prefixes_change_nothing():
    pieces = Pieces.load(PATH)
    words = [MARK + w for w in ("token", "tokens", "tokenise", "tokeniser", "to", "too", "xtoken")]
    together = split(*PrefixViterbi(pieces).segment(sorted(words)))
    assert all(PrefixViterbi(pieces).segment([w])[0] == ids for w, ids in zip(sorted(words), together))
