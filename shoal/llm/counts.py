"""Token counts that are exactly a tokenizer library's, without encoding each text from end to end.

Long texts are encoded as overlapping chunks with offsets. Two neighbours are spliced at a
boundary inside their overlap that is proven stable: white space follows a character that is
none, so the pre-tokenizer starts anew there whatever stands around it, and both encodings
have a token that begins there. Where an overlap holds no such boundary it is widened, at last
to the end of the text. Shorter texts are cut at all such boundaries and each distinct segment
is encoded once. Texts with white space beyond ASCII are short of those proofs and are encoded whole
or, where long, by chunks.

null and empty texts: 0 tokens. Repeated rows: each gives its own row. Other columns aren't read, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import BLANK, encode_parts, flat, slices, span_hash

#: Characters: texts of more are long; what a chunk of them holds; what it shares with the next.
LONG = 16_384
CHUNK = 8192
OVERLAP = 256
#: White space that isn't ASCII.
WIDE = "[\u0085   -     　]"


class Counter:
    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.known: dict[int, int] = {}
        self.most = most

    def encode(self, texts: list[str]) -> list:
        """With offsets."""
        return self.tok.encode_batch(texts, add_special_tokens=False)

    def whole(self, text: str) -> int:
        return len(self.encode([text])[0].ids)

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The count of a long text from overlapping chunks."""
        n = len(text)
        starts = list(range(0, n, chunk))
        ends = [min(n, a + chunk + overlap) for a in starts]
        begins = [self.begins(text, a, b) for a, b in zip(starts, ends, strict=True)]
        total, k, low = 0, 0, 0  # low: where chunk k counts from
        while k < len(starts):
            if ends[k] == n:
                return total + int((begins[k] >= low).sum())
            wide, nxt = overlap, k + 1
            while (at := self.common(text, starts[nxt], ends[k], begins[k], begins[nxt], low)) is None:
                wide *= 2
                ends[k] = min(n, max(ends[k], starts[nxt]) + wide)
                begins[k] = self.begins(text, starts[k], ends[k])
                if ends[k] == n:
                    return total + int((begins[k] >= low).sum())
                while nxt + 1 < len(starts) and ends[nxt] <= ends[k]:
                    nxt += 1
            own = begins[k]
            total += int(((own >= low) & (own < at)).sum())
            k, low = nxt, at
        return total

    def begins(self, text: str, a: int, b: int) -> np.ndarray:
        """Where in ``text`` the tokens of text[a:b] begin."""
        return np.fromiter((x[0] for x in self.encode([text[a:b]])[0].offsets), np.int64) + a

    @staticmethod
    def common(text: str, a: int, b: int, left: np.ndarray, right: np.ndarray, low: int) -> int | None:
        """A stable boundary in text[a:b] at which tokens of both encodings begin; b itself may stand inside a word."""
        both = np.intersect1d(left[left > max(a, low)], right)
        for p in both[both < b - 1].tolist():
            if text[p].isspace() and not text[p - 1].isspace() and text[p] not in "\x1c\x1d\x1e\x1f":
                return p
        return None

    def count(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each row of a string array."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("")
        size = pc.utf8_length(column).to_numpy(zero_copy_only=False)
        wide = pc.match_substring_regex(column, WIDE).to_numpy(zero_copy_only=False)
        out = np.zeros(len(column), np.int64)
        for i in np.flatnonzero((size > LONG) | wide).tolist():
            text = column[i].as_py()
            out[i] = self.spliced(text) if size[i] > LONG else self.whole(text)
        plain = np.flatnonzero((size > 0) & (size <= LONG) & ~wide)
        if len(plain):
            data, offs = flat(column.take(pa.array(plain)))
            blank = BLANK[data]
            first = blank.copy()
            first[1:] &= ~blank[:-1]
            first[offs[:-1]] = True
            starts = np.flatnonzero(first)
            ends = np.r_[starts[1:], len(data)]
            code, keys = pd.factorize(span_hash(data, starts, ends))
            seen = np.zeros(len(keys), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]
            if len(self.known) > self.most:
                self.known.clear()
            ks, get = keys.tolist(), self.known.get
            n = np.fromiter((get(k, -1) for k in ks), np.int64, len(ks))
            new = np.flatnonzero(n < 0)
            if len(new):
                raw = data.tobytes()
                parts = [raw[a:b].decode() for a, b in zip(starts[seen[new]].tolist(), ends[seen[new]].tolist(), strict=True)]
                n[new] = encode_parts(self.tok, parts)[1]
                self.known.update(zip(keys[new].tolist(), n[new].tolist(), strict=True))
            total = np.r_[0, np.cumsum(n[code])]
            out[plain] = np.diff(total[np.searchsorted(starts, offs)])
        return out


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; only doc_id and text are read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches):
            n = c.count(b.column(1))
            size = np.diff(flat(b.column(1))[1])
            yield pa.record_batch({"doc_id": b.column(0), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
