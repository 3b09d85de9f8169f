"""Encoding of text by a public byte-level BPE vocabulary.

BPE merges by rank have a property that makes shared prefixes worth sharing: a sequence of tokens
is the encoding of its bytes exactly if every two neighbours encode to themselves, and so the
encoding of a prefix is fully described by its *last token*. For a word w the state at depth i is
the last token of w[:i]; it is the one token t that ends w[:i] and may follow the state at depth
i - len(t). Distinct words are inserted into a trie and the states are propagated depth-first, so
a prefix that many words share is encoded once; a word's ids are read back along its states.

Texts are cut into chunks at the blanks where the pre-tokenizer always cuts. A worker keeps the
ids of the chunks it has seen, so a text costs a split, a look-up per chunk and one gather.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
#: Chunks a worker remembers before it starts afresh; results do not depend on it.
CACHE_CHUNKS = 400_000
CACHE_PAIRS = 1_000_000
CACHE_NODES = 1_000_000
#: Size of a vocabulary file at most.
MOST_BYTES = 64 << 20
#: Texts handled at a time within an Arrow batch.
SLICE = 256

#: Fixed value: Unicode white space, as the pre-tokenizer's \\s has it.
_WS = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(f" (?=[^{_WS}])")
_NO_CUT = re.compile(f" (?=[{_WS}]|\\Z)")
_PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token to id, of a file with one base64 token and its id per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Encodes texts; keeps what it learned of chunks and of the words' trie."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words = regex.compile(_PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        # a token that its own bytes do not encode to never occurs in any encoding
        self.whole: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.chunks = _Numbered()
        self.heads = _Numbered(self.chunks)
        self.flat = np.empty(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids_of: dict[str, list[int]] = {}
        # the trie: a node's children by byte, and the last token of the prefix it stands for
        self.children: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]

    def _merged(self, data: bytes, least: int) -> list[bytes]:
        """Plain BPE of a few bytes down to ``least`` parts: joins the leftmost pair of least rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > least:
            rank, at = min((get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_whole(self, data: bytes) -> bool:
        known = self.whole.get(data)
        if known is None:
            known = self.whole[data] = len(self._merged(data, 1)) == 1
        return known

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; none for a single byte."""
        if token not in self.halves:
            data = self.bytes_of[token]
            self.halves[token] = None if len(data) == 1 else tuple(self.ranks[p] for p in self._merged(data, 2))
        return self.halves[token]

    def _may_follow(self, before: int, token: int) -> bool:
        """Whether ``before`` and ``token`` side by side are their own encoding.

        Undoes the merges of both, latest first. Whenever the tokens that then meet at the border
        could merge sooner than the one undone last, BPE would have merged across the border.
        """
        known = self.pairs.get((before, token))
        if known is not None:
            return known
        left, right, bytes_of, get = before, token, self.bytes_of, self.ranks.get
        undone = 1 << 30
        undone_left = False
        while True:
            across = get(bytes_of[left] + bytes_of[right])
            # of equal ranks the leftmost goes first: a merge inside the left token precedes
            if across is not None and (across < undone or across == undone and not undone_left):
                known = False
                break
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                known = True
                break
            undone_left = b is None or a is not None and left > right
            if undone_left:
                undone, left = left, a[1]
            else:
                undone, right = right, b[0]
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[before, token] = known
        return known

    def _last_token(self, word: bytes, depth: int, states: list[int]) -> int:
        """Last token of the first ``depth`` bytes of ``word``, given those of its shorter prefixes."""
        get = self.ranks.get
        for size in range(min(depth, self.longest), 0, -1):
            tail = word[depth - size : depth]
            token = get(tail)
            if token is not None and self._is_whole(tail) and (size == depth or self._may_follow(states[depth - size], token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words. Each is inserted into the trie; only the nodes it adds need a new state.

        Sorted words visit the trie depth-first, so the path kept is that of the word before.
        """
        out: dict[bytes, list[int]] = {}
        children, last = self.children, self.last
        path, nodes, states = b"", [0], [-1]
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del nodes[shared + 1 :], states[shared + 1 :]
            path = word
            for depth in range(shared, len(word)):
                below = children[nodes[-1]].get(word[depth])
                if below is None:
                    below = children[nodes[-1]][word[depth]] = len(children)
                    children.append({})
                    last.append(self._last_token(word, depth + 1, states))
                nodes.append(below)
                states.append(last[below])
            at, ids = len(word), []
            while at:
                ids.append(states[at])
                at -= len(self.bytes_of[states[at]])
            ids.reverse()
            out[word] = ids
        return [out[w] for w in words]

    def _learn(self) -> None:
        """Encodes the chunks numbered since the last call."""
        new = self.chunks.take_new()
        if not new:
            return
        pieces = [self.words(c) for c in new]
        known = self.ids_of
        words = list({w for p in pieces for w in p if w not in known})
        known.update(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        rows = [known[p[0]] if len(p) == 1 else [t for w in p for t in known[w]] for p in pieces]
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((t for r in rows for t in r), np.int32, int(count.sum()))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.flat = np.r_[self.flat, flat]

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts one after the other, and how many each text has."""
        if len(self.chunks.order) > CACHE_CHUNKS or len(self.last) > CACHE_NODES:
            self.reset()
        chunk, head = self.chunks.__getitem__, self.heads.__getitem__
        parts: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                p = _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")
                before = len(parts)
                if p[0]:
                    parts.append(head(p[0]))
                del p[0]
                parts.extend(map(chunk, p))
                sizes[i] = len(parts) - before
        self._learn()
        return np.array(parts, np.int64), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i has ids[offsets[i]:offsets[i + 1]]; null and empty have none."""
        codes, sizes = self.codes(texts)
        n = self.count[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[codes] - (ends - n), n) + np.arange(total)
        return self._offsets(ends, sizes), self.flat[at]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        codes, sizes = self.codes(texts)
        return np.diff(self._offsets(np.cumsum(self.count[codes]), sizes))

    @staticmethod
    def _offsets(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]


class _Numbered(dict):
    """Numbers keys in the order they are first asked for.

    With ``of``, keys are text heads: chunks that no blank precedes, numbered along with ``of``'s.
    """

    def __init__(self, of: _Numbered | None = None) -> None:
        super().__init__()
        self.of = of
        self.order: list[str] = []
        self.done = 0

    def __missing__(self, key: str) -> int:
        order = self.order if self.of is None else self.of.order
        number = self[key] = len(order)
        order.append(key if self.of is not None else " " + key)
        return number

    def take_new(self) -> list[str]:
        new = self.order[self.done :]
        self.done = len(self.order)
        return new


_ENCODERS: dict[int, Encoder] = {}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Broadcast:
    """The vocabulary file, sent once to each executor. A file beyond MOST_BYTES is no vocabulary and an error."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encoder(vocab: Broadcast) -> Encoder:
    """This worker's encoder for a vocabulary; it lives as long as the worker."""
    data = vocab.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(data))
    return _ENCODERS[key]


def _map(df: DataFrame, id_col: str, text_col: str, out: T.StructField, vocab: Broadcast, make) -> DataFrame:  # noqa: ANN001
    schema = T.StructType([df.schema[id_col], out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), make(enc, part.column(1).to_pylist())], names=schema.fieldNames())

    return df.select(id_col, text_col).mapInArrow(run, schema)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocab: Broadcast) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens; no shuffle.

    Null and empty texts have an empty list, a blank text the ids of its blanks. The strings of
    special tokens are ordinary text. Repeated rows and null ids stay as they are; other columns
    are not carried.
    """
    out = T.StructField("ids", T.ArrayType(T.IntegerType(), False))

    def make(enc: Encoder, texts: list) -> pa.Array:
        offsets, ids = enc.encode(texts)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return _map(df, id_col, text_col, out, vocab, make)


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocab: Broadcast) -> DataFrame:
    """(id, n_tokens): how many ids :func:`encode_texts` gives; 0 for null and empty texts."""
    return _map(df, id_col, text_col, T.StructField("n_tokens", T.LongType()), vocab, lambda enc, texts: pa.array(enc.lengths(texts)))
