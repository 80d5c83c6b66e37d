"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece (a match of the pre-tokenizer's pattern) the byte-pair encoding has one last token. A token t
that ends the prefix is that token if and only if it encodes to itself and either starts the piece or is compatible with
the last token p of the prefix before it: merging byte pairs of p followed by t never joins across their border. The
suffix automaton of the vocabulary (goto and failure links) gives the tokens that end each prefix; back-pointers from the
whole piece give the ids. Time is linear in the piece for a bounded token length, also for pieces of megabytes.

Results: null and empty texts have no tokens and decode to the empty text; equal rows give equal results; a column of the
input whose name clashes with an added one is replaced.
"""

from __future__ import annotations

import hashlib
import json
import sys
import weakref
from array import array
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewell.llm import _shared

#: Pieces (of at most 64 characters) and pairs in each of the two generations that a worker remembers: some 50 MB in all, and
#: only speed depends on them.
MEMO_PIECES = 110_000
MEMO_PAIRS = 100_000
#: Ids are below this, so that a pair of them is one number.
MOST_IDS = 1 << 20
NEVER = 1 << 60
#: Stands for a token at the beginning of a piece.
START = MOST_IDS
#: The pre-tokenizer pattern of byte-level BPE files that have use_regex set (a fixed value of that format).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files -> the byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The bytes of a tokenizer file's ids: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that take space or word borders are not supported")
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.bytes_of |= {i: c.encode() for c, i in self.added.items()}
        self._prepare(spec, path)

    def _prepare(self, spec: dict, path: str) -> None:
        """For what more a codec takes from the file."""

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD. An id outside the vocabulary adds nothing."""
        return b"".join(map(self.bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")


class Memo(dict):
    """The ids of pieces; of those that it lacks, what its codec finds."""

    def __init__(self, codec: Codec):
        self.codec = weakref.proxy(codec)  # no cycle: a codec that is dropped is freed at once

    def __missing__(self, piece: str) -> bytes:
        return self.codec.piece(piece)


class Codec(Vocabulary):
    """Encoder and decoder for one tokenizer file of the byte-level kind."""

    def _prepare(self, spec: dict, path: str) -> None:
        import ahocorasick
        import regex

        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        vocab: dict[str, int] = model["vocab"]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(BYTE_LEVEL_PATTERN).findall

        most = 1 + max([*vocab.values(), *self.added.values()])
        if most > MOST_IDS:
            raise ValueError(f"{path} has ids of {MOST_IDS} and more")
        none = -2
        self.born = array("i", [none]) * most  # token -> rank of the merge that makes it; bytes: -1
        self.left = array("i", [none]) * most
        self.right = array("i", [none]) * most
        self.right_edge: list[tuple[int, ...] | None] = [None] * most  # bounded by the vocabulary
        self.left_edge: list[tuple[int, ...] | None] = [None] * most
        self.joins: dict[int, int] = {}
        own = [i for t, i in vocab.items() if len(t) == 1]
        for i in own:
            self.born[i] = -1
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if none in (self.born[x], self.born[y]) or self.born[t] != none:
                raise ValueError("merges must build each token once, from tokens made before it")
            self.born[t], self.left[t], self.right[t] = rank, x, y
            self.joins[x << 20 | y] = rank
            own.append(t)
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        fits = bytearray(most)
        self.size = bytearray(most) if max(map(len, self.bytes_of.values())) < 256 else array("i", [0]) * most
        for t in own:  # a token can be the result only if it encodes to itself
            x, y = self.left[t], self.right[t]
            if x == none or (fits[x] and fits[y] and self.compatible(x, y, self.born[t])):
                fits[t] = 1
                b = self.bytes_of[t]
                self.size[t] = len(b)
                automaton.add_word(b.decode("latin-1"), t)
        automaton.make_automaton()
        self.ends = automaton.iter
        self.memo = Memo(self)
        self.old_memo: dict[str, bytes] = {}

    def compatible(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge of a rank under before joins across the border of a followed by b.

        Merges happen in the order of ranks. Walk up the right edge of a and the left edge of b as their merges happen; the
        two tokens at the border join if their merge comes before either grows. Of equal ranks the leftmost goes first.
        """
        key = a << 20 | b
        if before == NEVER:
            if (known := self.pairs.get(key)) is not None:
                return known
            if (known := self.old_pairs.get(key)) is not None:
                self._remember_pair(key, known)
                return known
        if (up_a := self.right_edge[a]) is None:
            up_a = self.right_edge[a] = self._edge(a, self.right)
        if (up_b := self.left_edge[b]) is None:
            up_b = self.left_edge[b] = self._edge(b, self.left)
        born, joins, never = self.born, self.joins.get, NEVER
        i, j = len(up_a) - 1, len(up_b) - 1
        fits = True
        grow_a = born[up_a[i - 1]] if i else never
        grow_b = born[up_b[j - 1]] if j else never
        while True:
            if (rank := joins(up_a[i] << 20 | up_b[j], never)) < before and rank < grow_a and rank <= grow_b:
                fits = False
                break
            if grow_a <= grow_b:
                if not i:  # neither grows
                    break
                i -= 1
                grow_a = born[up_a[i - 1]] if i else never
            else:
                j -= 1
                grow_b = born[up_b[j - 1]] if j else never
        if before == NEVER:
            self._remember_pair(key, fits)
        return fits

    @staticmethod
    def _edge(token: int, toward: array) -> tuple[int, ...]:
        """A token and the tokens at one of its edges as it was merged, the byte last."""
        chain = [token]
        while (x := toward[chain[-1]]) >= 0:
            chain.append(x)
        return tuple(chain)

    def _remember_pair(self, key: int, fits: bool) -> None:
        if len(self.pairs) >= MEMO_PAIRS:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = fits

    def _remember_piece(self, text: str, ids: bytes) -> None:
        if len(self.memo) >= MEMO_PIECES:
            self.old_memo = dict(self.memo)
            self.memo.clear()
        self.memo[text] = ids

    def piece(self, text: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        if known := self.old_memo.get(text):
            self._remember_piece(text, known)
            return known
        s = text.encode().decode("latin-1")
        n, size = len(s), self.size
        # a long piece's prefixes take four bytes each; the prefix before the first byte is the last place
        last = [-1] * (n + 1) if n <= 64 else array("i", [-1]) * (n + 1)
        last[n] = START
        known, compatible = self.pairs.get, self.compatible
        for end, t in self.ends(s):
            if last[end] < 0 and (before := last[end - size[t]]) >= 0:
                if before == START:
                    last[end] = t
                else:
                    if (fits := known(before << 20 | t)) is None:
                        fits = compatible(before, t)
                        known = self.pairs.get  # a new generation may have begun
                    if fits:
                        last[end] = t
        ids, at = array("I"), n - 1
        while at >= 0:  # the last token tells where the prefix before it ends
            ids.append(t := last[at])
            at -= size[t]
        ids.reverse()
        if sys.byteorder != "little":
            ids.byteswap()
        out = ids.tobytes()
        if len(text) <= 64:
            self._remember_piece(text, out)
        return out

    def encode(self, text: str) -> bytes:
        known = self.memo.__getitem__
        out: list[bytes] = []
        for k, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                out.append(np.uint32(self.added[part]).astype("<u4").tobytes())
            else:
                out += map(known, self.pieces(part))
        return b"".join(out)


_opened: dict[tuple[type, str], Vocabulary] = {}
_shared.resident("bpe", _opened.clear)


def _of(kind: type, path: str):
    """One for each Python worker, kind and file, as long as the worker works for this operator."""
    if (kind, path) not in _opened:
        _opened[kind, path] = kind(path)
        _shared.trim()
    return _opened[kind, path]


def codec(path: str) -> Codec:
    return _of(Codec, path)


def vocabulary(path: str) -> Vocabulary:
    return _of(Vocabulary, path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ENCODED = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]


def encode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df with n_tokens long and token_ids binary (little-endian unsigned 32-bit ids); tokenizer names a public file."""

    def make():
        c = codec(tokenizer_path(tokenizer))

        def f(texts):
            packed = [c.encode(t) if t else b"" for t in texts.to_pylist()]
            return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]

        return f

    return _shared.map_columns(df, [text], ENCODED, make, owner="bpe")


def decode(df: DataFrame, tokenizer: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded_text string, from packed ids; null ids decode to the empty text."""

    def make():
        c = vocabulary(tokenizer_path(tokenizer))
        return lambda packed: [pa.array([c.decode(np.frombuffer(p or b"", dtype="<u4").tolist()) for p in packed.to_pylist()], pa.string())]

    return _shared.map_columns(df, [ids], [T.StructField("decoded_text", T.StringType())], make, owner="bpe")


def encode_and_prove(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """encode(df) with ids_sha256 and decoded_sha256 in place of the text: of the packed ids, and of the text decoded from them.

    Encoding and decoding share one worker and one vocabulary, and the decoded text doesn't leave it.
    """

    def make():
        c = codec(tokenizer_path(tokenizer))

        def f(texts):
            packed = [c.encode(t) if t else b"" for t in texts.to_pylist()]
            decoded = (c.decode(np.frombuffer(p, dtype="<u4").tolist()).encode() for p in packed)
            return [
                pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]

        return f

    return _shared.map_columns(df, [text], [*ENCODED, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make, drop=(text,), owner="bpe")


def digests(df: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    return encode_and_prove(df.select("doc_id", "text"), tokenizer).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_shared.table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": op1_bpe}
