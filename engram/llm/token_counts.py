"""Token counts of whole texts with the tokenizer library itself, lengths only.

Texts stay where the scan put them (no shuffle). Inside an Arrow function they are regrouped into batches of nearly equal bytes, because
a batch of a fixed number of texts may hold a thousand times the bytes of the next one, and every batch goes to the library in one call.
A text longer than a piece is cut first, at places where the library's own word pattern starts a new word in any case, so that the
counts of the pieces add up to the count of the text. Neither ids nor token strings leave the batch.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from engram.llm.common import remembered

BATCH_BYTES = 1 << 18      # characters handed to the library in one call: its tokens take some 100 times the memory of the texts
PIECE_CHARS = 1 << 15      # longer texts are cut
# A single space between two letters or digits. The byte-level word pattern takes a space only in front of a word or within a run of white
# space, so a word always ends before this space and a new one begins with it; what stands behind cannot change what stands before.
BOUNDARY = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def divisible(config: dict) -> bool:
    """Whether texts may be cut at BOUNDARY: byte-level word pattern, no normaliser that sees more than a character, and no added token
    that holds or swallows white space."""
    pre = config.get("pre_tokenizer") or {}
    plain = config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
    return bool(plain) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])
                                   for t in config.get("added_tokens") or [])


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at the first safe boundary behind every ``chars`` characters; a text without one stays whole."""
    start, n = 0, len(text)
    while n - start > chars:
        cut = BOUNDARY.search(text, start + chars)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


class Counter:
    """One vocabulary in a Python worker: ``lengths`` of a list of texts, and whether texts may be cut."""

    def __init__(self, kind: str, raw: bytes):
        if kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"    # tasks are the unit of parallel work
            from tokenizers import Tokenizer
            library = Tokenizer.from_str(raw.decode())
            library.no_truncation()
            library.no_padding()
            self.lengths: Callable[[list[str]], list[int]] = lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            self.cut = divisible(json.loads(raw))
        else:
            import sentencepiece
            library = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.lengths = lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]
            self.cut = False

    def count(self, texts: pa.Array, batch_bytes: int, piece_chars: int) -> np.ndarray:
        """Tokens of every text (null: 0)."""
        total = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        rows: list[int] = []
        size = 0

        def flush():
            np.add.at(total, rows, self.lengths(waiting))
            waiting.clear()
            rows.clear()

        for row, value in enumerate(texts):
            text = value.as_py()
            if not text:
                continue
            for piece in pieces(text, piece_chars) if self.cut else (text,):
                if waiting and size + len(piece) > batch_bytes:
                    flush()
                    size = 0
                waiting.append(piece)
                rows.append(row)
                size += len(piece)
        if waiting:
            flush()
        return total


def counter(kind: str, raw: bytes) -> Counter:
    """One counter per Python worker and vocabulary."""
    return remembered("token_counts", hashlib.sha256(raw).digest(), lambda: Counter(kind, raw))


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer_file: str, limit: int = 512, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the library of the file counts it: `tokenizers` for .json, `sentencepiece`
    for .model; no begin, end or added tokens, no truncation, no padding, special strings in a text as the library takes them by default.

    The vocabulary file (some MB, whatever the corpus) is read on the driver and broadcast. A null text is an empty one with no tokens;
    null and repeated ids give a row each; other columns are not read; an empty table gives an empty one. Only .json vocabularies with
    the byte-level word pattern are cut (see ``divisible``); other texts go to the library whole. `limit` only sets over_limit.
    """
    with open(tokenizer_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast((tokenizer_file.rsplit(".", 1)[-1], f.read()))
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(*shared.value)
        for batch in batches:
            n = c.count(batch.column(1), batch_bytes, piece_chars)
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
