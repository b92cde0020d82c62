"""Encoding and decoding with a SentencePiece vocabulary of the merge (BPE) kind.

The encoder never merges a whole text pair by pair. It walks through a word with an Aho-Corasick automaton over the pieces, takes the
longest piece that ends the walk, accepts it if the pair (previous piece, this piece) is one that merging would leave side by side,
falls back to shorter pieces otherwise, and steps back over the previous piece when nothing fits. A bitfield of positions from which
no way on exists keeps the search linear. Whether a pair may stand side by side is decided by re-merging its characters, and
remembered.

Pieces never hold a space mark after another character, so merging cannot cross the start of a word: words are encoded one by one and
frequent ones are remembered. Characters outside the vocabulary take part in no merge either; they become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.common import remembered

MARK = "▁"            # how a space is written inside pieces
REMEMBERED = 250_000       # words and pairs kept per Python worker (some 110 MB)
ROWS = 128                 # texts encoded before their tokens are handed on


def vocabulary(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, read from the model file; kind is normal, byte or other."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Automaton:
    """Aho-Corasick automaton over the pieces; for each start of a word the longest piece that begins there."""

    def __init__(self, pieces: list[str]):
        import ahocorasick
        # The automaton reports matches by their end. Reversed pieces over the reversed word report them by their start, and of all
        # pieces that end at one place iter() lists the longest first.
        self.auto = ahocorasick.Automaton()
        for p in pieces:
            self.auto.add_word(p[::-1], len(p))
        self.auto.make_automaton()

    def longest(self, word: str) -> dict[int, int]:
        """Length of the longest piece by the number of characters behind its first one."""
        return dict(reversed(list(self.auto.iter(word[::-1]))))


class Codec:
    """Exact encoder and decoder of one vocabulary; lives in a Python worker."""

    def __init__(self, vocab: list[tuple[str, float, str]]):
        self.vocab = vocab
        self.score = {p: s for p, s, kind in vocab if kind == "normal"}
        self.id = {p: i for i, (p, _, kind) in enumerate(vocab) if kind == "normal"}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocab) if kind == "byte"}
        self.unknown = next(i for i, (p, _, kind) in enumerate(vocab) if kind == "other")
        self.pieces = [p for p in self.id if not set(p) == {MARK} or len(p) == 1]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a space inside; words cannot be encoded one by one")
        inner = [self.score[p] for p in self.pieces if len(p) > 1]
        if len(inner) != len(set(inner)):
            raise ValueError("two pieces have one score; the order of merges would depend on places")
        self.automaton = Automaton(self.pieces)
        self.id_text = {p: str(i) for p, i in self.id.items()}
        self.foreign = re.compile("[^" + "".join(re.escape(p) for p in self.id if len(p) == 1) + "]")   # characters that are no piece
        self.widest = max((len(p) for p in self.id if set(p) == {MARK}), default=1)
        self.shorter: dict[str, str | None] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[str, int, str]] = {}

    # -- merging, used for pairs of pieces and for runs of spaces -------------------------------------------------------------
    def merge(self, parts: list[str]) -> list[str]:
        """Joins neighbours by the best score until none is in the vocabulary; ties go to the left."""
        parts = list(parts)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        got = self.beside.get((left, right))
        if got is None:
            if len(self.beside) >= REMEMBERED:
                self.beside.clear()
            got = self.beside[(left, right)] = self.merge(list(left + right)) == ([left, right] if left else [right])
        return got

    def prefix(self, piece: str) -> str | None:
        """The longest shorter piece that begins `piece`."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id), None)
        return self.shorter[piece]

    # -- backtracking ---------------------------------------------------------------------------------------------------------
    def segment(self, word: str) -> list[str]:
        """Pieces of a word whose characters all are in the vocabulary and which has a space mark at most in front."""
        n, last = len(word), len(word) - 1
        longest, beside = self.automaton.longest(word), self.beside
        dead = 0                      # bit i: no way on from position i
        out: list[str] = []
        left, pos, piece = "", 0, word[:longest[last]]
        while True:
            while piece is not None:
                if not (dead and dead >> (pos + len(piece)) & 1):
                    fits = beside.get((left, piece))
                    if fits is None:
                        fits = self.compatible(left, piece)
                    if fits:
                        break
                piece = self.prefix(piece)
            if piece is not None:
                out.append(piece)
                pos += len(piece)
                if pos == n:
                    return out
                left, piece = piece, word[pos:pos + longest[last - pos]]
            elif out:
                dead |= 1 << pos
                piece = out.pop()     # is dropped at once for a shorter one: its end is dead now
                pos -= len(piece)
                left = out[-1] if out else ""
            else:
                raise AssertionError("a single character is always a piece of its own")

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if len(self.byte) == 256 else [self.unknown]

    def pieces_of(self, spaces: int, word: str) -> list[str]:
        """Pieces of `spaces` space marks followed by a word without any."""
        known: list[str] = []
        out: list[str] = []
        text = (MARK if spaces else "") + word
        start = 0
        for i, c in enumerate(text + "\0"):
            if i == len(text) or c not in self.id:
                if i > start:
                    known = self.segment(text[start:i])
                    out += known
                if i < len(text):
                    out.append(c)
                start = i + 1
        run = spaces - 1
        if run > 0:                   # pure runs of spaces have the lowest score of all, so they are joined last
            alone = out[0] == MARK
            out = self.runs(run + alone) + out[alone:]
        return out

    def runs(self, n: int) -> list[str]:
        """Pieces of n space marks, merged from the left; a heap of left ends keeps long runs cheap."""
        width = self.widest
        head: list[str] = []
        while n > 4 * width:          # a full-width piece can grow no further, so the run behind it merges as if alone
            head.append(MARK * width)
            n -= width
        return head + self.merge([MARK] * n)

    # -- texts ----------------------------------------------------------------------------------------------------------------
    def remembered(self, spaces: int, word: str) -> tuple[str, int, str]:
        """(ids as text, number of ids, decoded text) of one word."""
        key = word if spaces == 1 else f"{spaces}{MARK}{word}"
        got = self.words.get(key)
        if got is None:
            if spaces == 1 and not self.foreign.search(word):
                out = self.segment(MARK + word)
                got = (",".join([self.id_text[p] for p in out]), len(out), "".join(out).replace(MARK, " "))
            else:
                ids = [i for p in self.pieces_of(spaces, word) for i in self.ids_of(p)]
                got = (",".join(map(str, ids)), len(ids), self.decoded(ids))
            if len(key) <= 64:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[key] = got
        return got

    def chunks(self, text: str) -> list[tuple[str, int, str]]:
        """Encoded words of a text; the words are independent of one another."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            known = self.words.get
            return [known(p) or self.remembered(1, p) for p in parts]
        out, spaces = [], 0
        for p in parts:
            spaces += 1
            if p:
                out.append(self.remembered(spaces, p))
                spaces = 0
        if spaces:
            out.append(self.remembered(spaces, ""))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.chunks(text) for i in c[0].split(",")]

    def decoded(self, ids: list[int]) -> str:
        """Text of ids with the front space kept; byte pieces in a row are one UTF-8 sequence, broken bytes become U+FFFD."""
        out, pending = [], bytearray()
        for i in ids:
            piece, _, kind = self.vocab[i]
            if kind == "byte":
                pending.append(int(piece[3:5], 16))
                continue
            if pending:
                out.append(valid_utf8(bytes(pending)))
                pending.clear()
            out.append(piece.replace(MARK, " ") if kind == "normal" else " ⁇ " if i == self.unknown else "")
        if pending:
            out.append(valid_utf8(bytes(pending)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids).removeprefix(" ")


def valid_utf8(raw: bytes) -> str:
    """Each byte that is not part of a whole character becomes one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


def codec(broadcast) -> Codec:
    """One codec per Python worker and vocabulary; its remembered words serve all tasks of the worker."""
    key = hash((len(broadcast.value), broadcast.value[-1], broadcast.value[len(broadcast.value) // 2]))
    return remembered("spiece", key, lambda: Codec(broadcast.value))


def tokenized(df: DataFrame, id_col: str, text_col: str, model_file: str, keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """(id, n_tokens[, ids, decoded][, ids_sha256, decoded_sha256]) of every whole text.

    The vocabulary (32,000 entries or so, fixed by the model) is read once on the driver and broadcast. A null text is an empty one and
    has no ids; a null id and repeated rows give a row each; other columns are not read. Texts of any length are taken word by word;
    an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(model_file))
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_tokens long" + ", ids array<int>, decoded string" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def part(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        count, flat, decoded, ids_sha, decoded_sha = [], [], [], [], []
        for text in batch.column(1):
            got = c.chunks(text.as_py() or "")
            ids, back = ",".join([x[0] for x in got]), "".join([x[2] for x in got]).removeprefix(" ")
            count.append(sum([x[1] for x in got]))
            if keep_ids:
                flat.append(np.fromstring(ids, dtype=np.int32, sep=","))
                decoded.append(back)
            if digests:
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(back.encode()).hexdigest())
        cols = [batch.column(0), pa.array(count, pa.int64())]
        if keep_ids:
            cols += [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat]))), pa.array(decoded, pa.string())]
        if digests:
            cols += [pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens"] + ["ids", "decoded"] * keep_ids + ["ids_sha256", "decoded_sha256"] * digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):     # few texts at a time: their tokens take more memory than the texts
                yield part(c, batch.slice(k, ROWS))

    return df.select(id_col, text_col).mapInArrow(run, schema)
