"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over the characters keeps the automaton's state; at each position the output links name every piece that ends there, and
each relaxes the position's best score, a sum of piece scores. For unigram models ("sum") that is all. For merge models ("merge")
sums of scores alone do not give the model's segmentation, so a candidate relaxes only if it may follow the piece that ends where it
starts: merging the two pieces' text by the model's ranks must give just these two. What results is the model's own encoding.
Characters without a piece become byte pieces.

No piece holds a space mark after another character, so texts are encoded by chunk (space marks and what follows), through a bounded memo.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import MEMOS, map_rows

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks and piece pairs that a worker's memos hold, about; they are emptied then.
MEMO = 500_000
#: The score of a position that no piece reaches yet, and what a character without a piece costs.
NEVER, UNKNOWN = float("-inf"), 1e6


class Automaton:
    """Goto, failure and output links over the characters of the pieces."""

    def __init__(self, pieces: dict[str, int]):
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[int] = [-1]
        for text, number in pieces.items():
            at = 0
            for ch in text:
                to = self.child[at].get(ch)
                if to is None:
                    to = self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.piece.append(-1)
                at = to
            self.piece[at] = number
        self.fail = [0] * len(self.child)
        self.link = [0] * len(self.child)  # nearest proper suffix that is a piece; 0: none
        queue = list(self.child[0].values())
        for at in queue:
            for ch, to in self.child[at].items():
                back = self.fail[at]
                while back and ch not in self.child[back]:
                    back = self.fail[back]
                self.fail[to] = self.child[back].get(ch, 0)
                queue.append(to)
            suffix = self.fail[at]
            self.link[at] = suffix if self.piece[suffix] >= 0 else self.link[suffix]
        self.depth = {number: len(text) for text, number in pieces.items()}
        self.outputs: list[tuple | None] = [None] * len(self.child)

    def link_outputs(self, state: int) -> tuple:
        """(piece, length) of all pieces that end in a state, longest first, by its output links."""
        found, at = [], state if self.piece[state] >= 0 else self.link[state]
        while at:
            found.append((self.piece[at], self.depth[self.piece[at]]))
            at = self.link[at]
        self.outputs[state] = tuple(found)
        return self.outputs[state]


class PieceCodec:
    def __init__(self, path: str, scores: str = "merge"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        self.unknown = model.unk_id()
        self.number = {t: i for i, t in enumerate(self.text) if i not in control}
        self.automaton, self.sum = Automaton(self.number), scores == "sum"
        self.raw = [bytes([int(self.text[i][3:5], 16)]) if model.is_byte(i) else b"" if i in control else self.text[i].replace(MARK, " ").encode() for i in range(n)]
        self.follows: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges carried out one by one: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.number.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.score[number] > best):
                    best, at = self.score[number], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, before: int, piece: int) -> bool:
        key = before * len(self.text) + piece
        found = self.follows.get(key)
        if found is None:
            if len(self.follows) > 2 * MEMO:
                self.follows.clear()
            pair = [self.text[i] for i in (before, piece) if i >= 0]
            found = self.follows[key] = self.merged("".join(pair)) == pair
        return found

    def chunk(self, text: str) -> list[int]:
        """Ids of one run of text by the single pass: at every position all pieces that end there relax its best score."""
        a, state, score, many = self.automaton, 0, self.score, len(self.text)
        child, fail, outputs, follows = a.child, a.fail, a.outputs, self.follows
        last, best, start = [-1], [0.0], [0]
        for i, ch in enumerate(text, 1):
            while state and ch not in child[state]:
                state = fail[state]
            state = child[state].get(ch, 0)
            found, value, begin = -1, NEVER, i - 1
            for number, size in outputs[state] or a.link_outputs(state):
                j = i - size
                if best[j] + score[number] > value:
                    if not self.sum:
                        may = follows.get(last[j] * many + number)
                        if not (self._may_follow(last[j], number) if may is None else may):
                            continue
                    found, value, begin = number, best[j] + score[number], j
            last.append(found)
            start.append(begin)
            best.append(value if found >= 0 else best[i - 1] - UNKNOWN)
        out, i = [], len(text)
        while i:
            if last[i] >= 0:
                out.append(last[i])
            else:
                out += [self.byte.get(b, self.unknown) for b in reversed(text[i - 1].encode("utf-8", "replace"))]
            i = start[i]
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; none for null or empty texts."""
        if not text:
            return b""
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.memo.get, chunks))
        if None in found:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for i, x in enumerate(found):
                if x is None:
                    c = chunks[i]
                    x = self.memo.get(c)
                    if x is None:
                        x = np.array(self.chunk(c), "<u4").tobytes()
                        if len(c) < 64:
                            self.memo[c] = x
                    found[i] = x
        return b"".join(found)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, scores: str = "merge") -> PieceCodec:
    return PieceCodec(path, scores)


def shared_codec(path: str, scores: str = "merge") -> PieceCodec:
    """The worker's codec; its memos go when another operator takes over the worker."""
    made = codec(path, scores)
    MEMOS["pieces"] = lambda: (made.memo.clear(), made.follows.clear())
    return made


def encode_texts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", scores: str = "merge", with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte pieces), ids_crc32 (of unsigned little-endian 32-bit ids), round_trip and, if asked for, ids of
    every row. Null and empty texts have no ids. round_trip: the ids decode to the text (space marks in it count as spaces). A null doc_id
    stays null; repeated rows are encoded alike; other columns are ignored; an empty table gives no rows."""

    def rows(texts: list) -> list[list]:
        c = shared_codec(model, scores)
        byte_ids = np.array(sorted(c.byte.values()), np.uint32)
        out: list[list] = [[] for _ in range(5 if with_ids else 4)]
        for t in texts:
            raw = c.encode(t)
            ids = np.frombuffer(raw, "<u4")
            listed = ids.tolist()
            out[0].append(len(ids))
            out[1].append(int(((ids >= byte_ids[0]) & (ids <= byte_ids[-1])).sum()) if len(byte_ids) else 0)
            out[2].append(zlib.crc32(raw))
            out[3].append(c.decode(listed) == (t or "").replace(MARK, " ").encode("utf-8", "replace").decode())
            if with_ids:
                out[4].append(listed)
        return out

    made = [("n_ids", T.LongType()), ("n_bytes", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType())] + [("ids", T.ArrayType(T.LongType()))] * with_ids
    plain = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"))
    return map_rows(plain, "__t", made, rows, ["__id"], memo="pieces").withColumnRenamed("__id", doc_id)


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of an array of ids to every row; a null array gives a null text, an empty one the empty text. ids of no piece are left out."""

    def rows(lists: list) -> list[list]:
        c = codec(model)
        n = len(c.raw)
        return [[None if x is None else c.decode([i for i in x if i is not None and 0 <= i < n]) for x in lists]]

    return map_rows(encoded.withColumn("__ids", F.col(f"`{ids}`")), "__ids", [(text, T.StringType())], rows, encoded.columns)
