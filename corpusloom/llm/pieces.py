"""SentencePiece encoding and decoding by streaming Viterbi.

The best path over a vocabulary's piece scores is found left to right.  Only the last positions, as many as the longest
piece has characters, can begin a further piece; once the backpointer paths of all of them meet in one boundary,
the ids before it are committed and forgotten.  So memory is bounded by the window, not by the text.
Where no piece reaches across a word's start, the paths always meet there, and a word's ids can be kept for its next time; new words are
searched side by side, a position of all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, own_name, tidy

SPACE = "▁"
#: Score of a character without a piece, below the lowest score; words that a worker keeps; positions between tries to commit.
UNKNOWN, MEMO, EVERY = 10.0, 250_000, 32
#: Characters of a word that is searched beside others, words that are, and characters of texts that are cut into words at once.
SHORT, BESIDE, SLICE = 48, 16_384, 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file with their scores, and the two directions."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id = [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"")
            else:
                self.score[piece] = (model.get_score(i), i)
                self.text.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN
        self.splits_at_words = all(SPACE not in p.lstrip(SPACE) for p in self.score)
        # every prefix of a piece, with the piece's score and id if it is one itself: a search ends where no piece goes on
        self.reach: dict[str, tuple] = {p[:k]: () for p in self.score for k in range(1, len(p))}
        self.reach.update(self.score)
        self._memo: dict[str, bytes] = {}
        self._lay_out()

    def _lay_out(self) -> None:
        """The prefixes as a table of steps: (prefix, character) in sorted keys, with the prefix that follows, its score and id."""
        number = {prefix: k for k, prefix in enumerate(self.reach, 1)}
        number[""] = 0
        letters = sorted({p[-1] for p in self.reach})
        self.letter = np.full(0x110001, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        width = len(letters)
        keys = np.array([number[p[:-1]] * width + self.letter[ord(p[-1])] for p in self.reach], np.int64)
        order = np.argsort(keys)
        self.keys, self.step = keys[order], np.arange(1, len(keys) + 1, dtype=np.int32)[order]
        self.piece_score = np.array([-np.inf, *((x[0] if x else -np.inf) for x in self.reach.values())])
        self.piece_id = np.array([-1, *((x[1] if x else -1) for x in self.reach.values())], np.int32)
        self.width = width

    def search(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word with a space in front, as :meth:`stream` finds them."""
        found = {w: self._word(w) for w in words if len(w) > SHORT}
        short = sorted((w for w in words if len(w) <= SHORT), key=len, reverse=True)
        for at in range(0, len(short), BESIDE):
            self._search_beside(short[at : at + BESIDE], found)
        return found

    def _search_beside(self, words: list[str], found: dict[str, bytes]) -> None:
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words)) + 1  # longest first
        longest = int(size[0])
        codes = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
        rows = np.repeat(np.arange(n), size)
        letter = np.full((longest, n), -1, np.int32)
        letter[np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size), rows] = self.letter[codes]
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        start, piece = np.zeros((longest + 1, n), np.int16), np.full((longest + 1, n), -1, np.int32)
        for begin in range(longest):
            live = np.arange(np.searchsorted(-size, -begin, "left"))  # words that are longer
            single = np.zeros(len(live), bool)
            node = np.zeros(len(live), np.int64)
            for end in range(begin + 1, min(longest, begin + self.longest) + 1):
                c = letter[end - 1, live]
                key = node * self.width + c
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                some = (c >= 0) & (self.keys[k] == key)
                live, node = live[some], self.step[k[some]].astype(np.int64)
                if not len(live):
                    break
                total = best[begin, live] + self.piece_score[node]
                if end == begin + 1:
                    single[live] = self.piece_id[node] >= 0
                better = total > best[end, live]
                who = live[better]
                best[end, who], start[end, who], piece[end, who] = total[better], begin, self.piece_id[node[better]]
            none = np.flatnonzero(~single)  # no piece for this character alone
            total = best[begin, none] + self.unknown
            better = total > best[begin + 1, none]
            who = none[better]
            best[begin + 1, who], start[begin + 1, who], piece[begin + 1, who] = total[better], begin, -1
        # all words go back from their ends together
        who, at, steps = np.arange(n), size.copy(), []
        odd = np.zeros(n, bool)
        while len(who):
            ids = piece[at, who]
            steps.append((who, ids))
            odd[who[ids < 0]] = True
            at = start[at, who].astype(np.int64)
            who, at = who[at > 0], at[at > 0]
        of, ids = (np.concatenate(x) for x in zip(*steps[::-1]))
        order = np.argsort(of, kind="stable")
        ids, ends = ids[order].astype("<i4").tobytes(), np.cumsum(np.bincount(of, minlength=n)) * 4
        a = 0
        for w, b, bytewise in zip(words, ends.tolist(), odd.tolist()):
            found[w] = self._word(w) if bytewise else ids[a:b]
            a = b

    def stream(self, text: str) -> Iterator[int]:
        """Ids of one normalised text, committed as soon as all surviving paths agree."""
        reach, longest, n = self.reach, self.longest, len(text)
        base = 0  # the boundary up to which ids are committed; lists begin there
        best: list = [0.0] + [None] * longest
        back: list = [None] * (longest + 1)
        for begin in range(n):
            at = begin - base
            own = best[at]
            if own is not None:
                single = False
                for end in range(begin + 1, min(n, begin + longest) + 1):
                    found = reach.get(text[begin:end])
                    if found is None:
                        break
                    if found:
                        single |= end == begin + 1
                        k, total = end - base, own + found[0]
                        if best[k] is None or total > best[k]:
                            best[k], back[k] = total, (begin, found[1])
                if not single:  # no piece for this character alone
                    k, total = at + 1, own + self.unknown
                    if best[k] is None or total > best[k]:
                        best[k], back[k] = total, (begin, -1)
            best.append(None)
            back.append(None)
            if at > longest and begin % EVERY == 0:
                alive = {p for p in range(begin + 1, min(n, begin + longest) + 1) if best[p - base] is not None}
                while len(alive) > 1:
                    last = max(alive)
                    alive.discard(last)
                    alive.add(back[last - base][0])
                meet = alive.pop()
                if meet > base:
                    yield from self._path(text, back, base, meet)
                    zero = best[meet - base]
                    best, back, base = [None if x is None else x - zero for x in best[meet - base :]], back[meet - base :], meet
        yield from self._path(text, back, base, n)

    def _path(self, text: str, back: list, base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            begin, piece = back[end - base]
            out += [piece] if piece >= 0 else [self.byte_id[b] for b in reversed(text[begin:end].encode())]
            end = begin
        return out[::-1]

    def _word(self, word: str) -> bytes:
        return np.fromiter(self.stream(SPACE + word), "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers.  A space is put in front of a text that is not empty."""
        out: list[bytes] = []
        at, end, room = 0, 0, SLICE
        while at < len(texts):
            while end < len(texts) and (end == at or room > 0):
                room -= len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at, room = end, SLICE
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for text in texts:
            if text and (not self.splits_at_words or SPACE in text):
                cut.append(None)
                continue
            words = text.split(" ") if text else []
            if "" in words:  # spaces before a word belong to it
                joined, run = [], 0
                for w in words[:-1]:
                    if w:
                        joined.append(SPACE * run + w)
                        run = 0
                    else:
                        run += 1
                words = [*joined, SPACE * run + words[-1]]
            cut.append(words)
        memo = self._memo
        new = self.search(list(set().union(*(x for x in cut if x)).difference(memo)))
        out = [np.fromiter(self.stream(SPACE + text.replace(" ", SPACE)), "<i4").tobytes() if words is None else b"".join([memo[w] if w in memo else new[w] for w in words]) for text, words in zip(texts, cut)]
        if len(memo) < MEMO:
            memo.update((w, x) for w, x in new.items() if len(w) <= SHORT)
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        raw = b"".join(map(text.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, text_col: str = "text", path: str | None = None, col: str = "pieces") -> DataFrame:
    """``docs`` with a struct ``ids array<int>, n_ids int, exact boolean``: the best segmentation of the whole text, and whether decoding gives the text back.

    Null and empty texts have no ids.  A text that itself holds the piece alphabet's space sign is the one kind that does not come back.
    """
    path = path or vocabulary_path()

    @F.arrow_udf("struct<ids: array<int>, n_ids: int, exact: boolean>")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(path)
        for texts in batches:
            plain = [x.as_py() or "" for x in texts]
            parts = vocabulary.encode(plain)
            exact = [vocabulary.decode(np.frombuffer(ids, "<i4")) == text for ids, text in zip(parts, plain)]
            sizes = np.array([len(x) // 4 for x in parts], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.StructArray.from_arrays([ids, pa.array(sizes), pa.array(exact, pa.bool_())], ["ids", "n_ids", "exact"])

    return docs.withColumn(col, run(F.col(text_col)))


def decode_pieces(docs: DataFrame, ids_col: str = "ids", path: str | None = None, col: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids (null: none)."""
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(path)
        for lists in batches:
            yield pa.array([None if x.as_py() is None else vocabulary.decode(np.array(x.as_py(), np.int32)) for x in lists], pa.string())

    return docs.withColumn(col, run(F.col(ids_col)))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    col = own_name(docs, "pieces")
    return encode_pieces(docs, col=col).select("doc_id", f"{col}.*")
