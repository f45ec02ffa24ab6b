"""Token ids of texts under a public byte-level BPE vocabulary.

The vocabulary's byte strings are mapped to Latin-1 so that one Aho-Corasick automaton finds every token that occurs
in a piece.  A list of tokens is the BPE of a piece exactly if every adjacent pair is the BPE of its own bytes, so the
encoder walks from the longest match at each position, goes back to shorter ones where a pair is not compatible, and
never enters a position twice that led nowhere: linear in the piece.  Compatibility of a pair is worked out by merging
its bytes once and then remembered; so are whole pieces, up to ``CACHE`` of them.

Defined cases: null and empty texts give an empty list; white space is encoded as it is; strings that look like
special tokens are ordinary text; any length of text and of piece is encoded whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie and the pattern that cuts a text into pieces.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker, and tokens in the longest piece worth remembering.
CACHE, LONGEST = 300_000, 64


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.rank = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(PATTERN)
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pair: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, list[int]] = {}

    @classmethod
    def load(cls, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
        with open(f"{folder}/{vocabulary}", "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes) -> list[int]:
        """BPE by definition: merge the adjacent parts of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pair.get((a, b))
        if known is None:
            known = self.pair[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        one = self.rank.get(data)
        if one is not None:
            return [one]
        n = len(data)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            at[end + 1 - length].append((length, token))
        for x in at:
            x.sort(reverse=True)
        tokens: list[int] = []
        starts: list[int] = []
        tried = [0] * n  # matches of a position that are used up
        pos = 0
        while pos < n:
            here, k = at[pos], tried[pos]
            while k < len(here):
                length, token = here[k]
                if (pos + length == n or tried[pos + length] == 0 or tried[pos + length] < len(at[pos + length])) and (not tokens or self.compatible(tokens[-1], token)):
                    break
                k += 1
            if k < len(here):
                tried[pos] = k
                tokens.append(token)
                starts.append(pos)
                pos += length
            else:
                tried[pos] = len(here)
                tokens.pop()
                pos = starts.pop()
                tried[pos] += 1
        return tokens

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        seen = self.seen
        for p in self.pieces.findall(text):
            ids = seen.get(p)
            if ids is None:
                ids = self.piece(p.encode())
                if len(ids) <= LONGEST:
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen[p] = ids
            out += ids
        return out


@functools.lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str) -> Encoder:
    return Encoder.load(folder, vocabulary)


def encoded(df: DataFrame, key: str, text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids: one pass over the texts without a shuffle; the vocabulary file is read on each worker."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            lists = [e.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, folder: str = FOLDER, vocabulary: str = VOCABULARY, into: str = "tokens") -> DataFrame:
    """``df`` without ``text``, with the number of its tokens."""
    rest = [c for c in df.columns if c != text]
    schema = df.select(*rest, F.lit(0).cast("long").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            n = [len(e.encode(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*rest, into])

    return df.select(text, *rest).mapInArrow(run, schema)
