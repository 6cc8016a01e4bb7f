"""Sentences of a text in chunks under a token budget.

What a sentence adds to a chunk depends only on whether it opens it, as a
tokenizer that cuts at blanks makes no token over the blank between two
sentences. So a text's sizes are two arrays, tokens at the start and tokens
after a blank, and the size of any run of sentences is a difference of prefix
sums: a chunk's end is found by bisection and no joined text is counted again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from noticeflow.runtime import held, map_arrow

CHUNKS = "array<struct<text:string,n_tokens:int>>"
_ANCHOR = "x."


class Words:
    """Words between blanks as tokens."""

    special = 0

    def sizes(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(p.split()) for p in parts], np.int64)
        return n, n


class Vocabulary:
    """Tokens of a vocabulary file: a tokenizer in JSON, or a piece model (any other ending), whose start and end marks count as one each."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._count: Callable[[list[str]], list[int]] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
            self.special = t.num_special_tokens_to_add(False)
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.special = (model.bos_id() >= 0) + (model.eos_id() >= 0)
        self._anchor = self._count([_ANCHOR])[0]

    def sizes(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.array(self._count(parts), np.int64), np.array(self._count([f"{_ANCHOR} {p}" for p in parts]), np.int64) - self._anchor


def counter(tokenizer: str | None):
    """Of a vocabulary file, loaded once in a worker process; without one, of words."""
    return held(("tokens", tokenizer), lambda: Vocabulary(tokenizer)) if tokenizer else Words()


def cut(first: np.ndarray, more: np.ndarray, budget: int, special: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ends, tokens) of the chunks of parts: as many parts as fit the budget with the special tokens, one at least."""
    upto = np.concatenate([[0], np.cumsum(more)])
    ends, tokens, at = [], [], 0
    while at < len(first):
        base = special + first[at] - upto[at + 1]
        end = max(at + 1, int(np.searchsorted(upto, budget - base, "right")) - 1)
        ends.append(end)
        tokens.append(base + upto[end])
        at = end
    return np.array(ends, np.int64), np.array(tokens, np.int64)


def token_chunks(df: DataFrame, parts: str, budget: int, tokenizer: str | None = None, output: str = "chunks") -> DataFrame:
    """``df`` with ``output``: the chunks (text, n_tokens) of the array column ``parts``, joined by blanks.

    n_tokens has the tokenizer's special tokens. A part over the budget stands alone. Null and empty arrays have no
    chunks, null parts are left out. ``tokenizer`` names a vocabulary file that workers can read; without it words are counted.
    """
    keep = df.drop(output)
    kind = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32())]))

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            column, start = b.column(b.schema.names.index(parts)), 0
            while start < b.num_rows:
                rows, size = [], 0
                while start + len(rows) < b.num_rows and size < 20_000:
                    rows.append([p for p in column[start + len(rows)].as_py() or [] if p is not None])
                    size += len(rows[-1]) + 1
                first, more = count.sizes([p for r in rows for p in r])
                out, at = [], 0
                for r in rows:
                    ends, tokens = cut(first[at : at + len(r)], more[at : at + len(r)], budget, count.special)
                    out.append([{"text": " ".join(r[a:e]), "n_tokens": int(n)} for a, e, n in zip([0, *ends[:-1]], ends, tokens, strict=True)] if r else [])
                    at += len(r)
                piece = b.slice(start, len(rows))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(out, kind)], names=[*b.schema.names, output])
                start += len(rows)

    schema = T.StructType([*keep.schema.fields, T.StructField(output, T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType())])))])
    return map_arrow(keep, run, schema)
