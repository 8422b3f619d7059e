"""Token ids of whole texts by a public tokenizer, memoised by white-space-free chunk.

The tokenizer drops white space and never lets a token cross it, and its normaliser neither joins nor reorders characters
across ASCII white space, so the ids of a text are those of its chunks in order. A chunk is cut once more before a tail of
ASCII punctuation that follows an ASCII letter or digit: such a place is always a token boundary, too. Texts
whose composition does not depend on the case of their ASCII letters are keyed in lower case, as the normaliser lowers them.
"""

from __future__ import annotations

from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

from quarry.llm.shared import MEMOS

#: Kinds of bytes: 1 ASCII letter or digit, 2 ASCII punctuation, 3 white space, 0 any other.
KINDS = bytes(3 if b in b" \t\n\r\x0b\x0c" else 1 if b < 128 and chr(b).isalnum() else 2 if 32 < b < 127 else 0 for b in range(256))
#: Chunks that the memo of a worker holds, about (it is emptied then), and the bytes of a chunk that is worth a place there.
MEMO, SHORT = 800_000, 48
#: Chunks of the small memo that is asked first: those seen first are mostly the common ones, and it fits a processor's cache.
COMMON = 8192


def part_tails(raw: bytes) -> bytes:
    """The text with a space before each tail of punctuation."""
    kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
    turns = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1  # where runs of one kind start, but for the first
    kind = kinds[turns]
    cuts = turns[(kind == 2) & (kinds[turns - 1] == 1) & (np.append(kind[1:], 3) == 3)]
    if not len(cuts):
        return raw
    out, kept = np.full(len(raw) + len(cuts), 32, np.uint8), np.ones(len(raw) + len(cuts), bool)
    kept[cuts + np.arange(len(cuts))] = False
    out[kept] = np.frombuffer(raw, np.uint8)
    return out.tobytes()


class ChunkTokenizer:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.common: dict[bytes, bytes] = {}
        self.ends = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())], bool)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Many chunks at once: words of letters only are one token run each, which the word-end marks of the ids part again."""
        if all(map(str.isalpha, chunks)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(chunks):
                raw, stops = ids.tobytes(), (4 * ends).tolist()
                return [raw[a:b] for a, b in zip([0, *stops], stops)]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _fresh(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the memo does not hold; the short ones go there."""
        texts = {c: c.decode("utf-8", "replace") for c in new}
        made: dict[bytes, bytes] = {}
        for group in ([c for c, t in texts.items() if t.isalpha()], [c for c, t in texts.items() if not t.isalpha()]):
            for at in range(0, len(group), 512):
                part = group[at : at + 512]
                made.update(zip(part, self._encode([texts[c] for c in part]), strict=True))
        if len(self.memo) + len(made) > MEMO:
            self.memo.clear()
        short = [(c, ids) for c, ids in made.items() if len(c) <= SHORT]
        self.memo.update(short)
        if len(self.common) < COMMON:
            self.common.update(short[: COMMON - len(self.common)])
        return made

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; none for null."""
        if not text:
            return b""
        if "<|" in text:  # the tokenizer's own markers may stand in the text: leave every place to it
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        raw = text.encode("utf-8", "replace")
        low = raw.lower()
        if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low.decode()):
            raw = low
        chunks = part_tails(raw).split()
        found = list(map(self.common.get, chunks))
        if not all(found):
            memo = self.memo.get
            found = [ids or memo(c) for c, ids in zip(chunks, found)]
            if not all(found):
                made = self._fresh(list({c for c, ids in zip(chunks, found) if ids is None}))
                found = [made[c] if ids is None else ids for c, ids in zip(chunks, found)]
        return b"".join(found)

    def release(self) -> None:
        self.memo.clear()
        self.common.clear()


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def shared_tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer; its memo goes when another operator takes over the worker."""
    made = chunk_tokenizer(path)
    MEMOS["chunks"] = made.release
    return made
