"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

A token sequence is the encoding of its bytes exactly if each two neighbours are:
if merging the bytes of both alone gives both back. So the last token of each
prefix's encoding follows from those of at most the longest token's length before
it: the transducer reads a byte at a time and keeps just these. The final encoding
passes through one of the last prefixes; a token that all of their encodings
share is stable, and is emitted. Decoding turns token bytes into text with at most
three pending bytes of state.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: The byte-level pre-token pattern and the white space it means (fixed values).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Frequent words whose ids a Python worker remembers, and the longest one in characters; neighbours whose test it remembers.
CACHE_WORDS, CACHE_LENGTH, CACHE_PAIRS = 1 << 18, 48, 1 << 20
#: Characters of a text that are split at once.
BLOCK = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        letters, model = byte_letters(), said["model"]
        ids: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        self.text = [b""] * (1 + max([*ids.values(), *self.specials.values()]))
        for t, i in ids.items():
            self.text[i] = bytes(letters[c] for c in t)
        for t, i in self.specials.items():
            self.text[i] = t.encode()
        self.byte = [0] * 256
        for c, b in letters.items():
            self.byte[b] = ids[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.longest = max(map(len, self.text))
        self.lookahead = sufficient_lookahead(self.pairs, {i: len(t) for i, t in enumerate(self.text)})
        self._automaton()

    def _automaton(self) -> None:
        """States are the tokens' beginnings; ending[s]: (id, length) of the tokens that end there, longest first."""
        special = set(self.specials.values())
        goto: list[dict[int, int]] = [{}]
        own: list[int | None] = [None]
        for i, t in enumerate(self.text):
            if not t or i in special:
                continue
            at = 0
            for b in t:
                nxt = goto[at].get(b)
                if nxt is None:
                    nxt = goto[at][b] = len(goto)
                    goto.append({})
                    own.append(None)
                at = nxt
            own[at] = i
        fail, self.ending = [0] * len(goto), [()] * len(goto)
        order = list(goto[0].values())
        for s in order:  # by length, so that shorter beginnings are done
            i = own[s]
            self.ending[s] = (*(((i, len(self.text[i])),) if i is not None else ()), *self.ending[fail[s]])
            for b, nxt in goto[s].items():
                at = fail[s]
                while at and b not in goto[at]:
                    at = fail[at]
                fail[nxt] = goto[at].get(b, 0)
                order.append(nxt)
        self.goto, self.fail, self.added = goto, fail, 0

    def step(self, state: int, byte: int) -> int:
        """Where a byte leads that no beginning goes on with; remembered in goto, up to a bound."""
        at = state
        while at and byte not in self.goto[at]:
            at = self.fail[at]
        to = self.goto[at].get(byte, 0)
        if self.added < CACHE_PAIRS:
            self.added += 1
            self.goto[state][byte] = to
        return to


def sufficient_lookahead(pairs: dict[tuple[int, int], tuple[int, int]], length: dict[int, int]) -> int:
    """Bytes after a token that can still change it; how often the transducer looks for stable tokens follows from it.

    Further text can take a merge's left part away from an earlier merge only if
    it joins it in a merge of lower rank, and that earlier merge's own left part is
    then free for one of higher rank, and so on: the effect runs back over a chain
    of merges of rising rank, each ending in the token where the one before it
    began. The longest such chain in bytes, and one token, is the lookahead.
    """
    chain: dict[int, int] = {}  # token -> bytes of the longest chain of later merges that end in it
    for (a, b), (_, _made) in sorted(pairs.items(), key=lambda x: -x[1][0]):
        chain[b] = max(chain.get(b, 0), length[a] + chain.get(a, 0))
    return max(chain.values(), default=0) + max(length.values(), default=1)


def merge(out: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Applies the merges to a few ids: always the lowest rank, leftmost first."""
    while len(out) > 1:
        best = min(((*hit, i) for i in range(len(out) - 1) if (hit := pairs.get((out[i], out[i + 1])))), key=lambda x: (x[0], x[2]), default=None)
        if best is None:
            break
        out[best[2] : best[2] + 2] = [best[1]]
    return out


class Transducer:
    """Token ids of pre-tokens that arrive in parts, byte by byte.

    State: that of an automaton that knows which tokens end at a byte; and for each
    undecided prefix its last token and how long that is. What two neighbours give
    and the automaton's steps are remembered up to a bound.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known: dict[int, bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes; a is -1 at a pre-token's start."""
        byte, text = self.v.byte, self.v.text
        data = text[b] if a < 0 else text[a] + text[b]
        said = merge([byte[x] for x in data], self.v.pairs) == ([b] if a < 0 else [a, b])
        if len(self.known) >= CACHE_PAIRS:
            self.known.clear()
        self.known[a << 32 | b] = said
        return said

    def run(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Stable tokens as soon as twice `lookahead` bytes are undecided, and the rest at the end, in lists."""
        known, neighbours, goto, ending, enough = self.known, self.neighbours, self.v.goto, self.v.ending, 2 * self.v.lookahead
        last, size = [-1], [0]  # by undecided prefix: the last token of its encoding, and its length in bytes
        state = at = 0
        for part in parts:
            for byte in part:
                to = goto[state].get(byte)
                state = self.v.step(state, byte) if to is None else to
                at += 1
                for token, n in ending[state]:
                    if n <= at:
                        before = last[at - n]
                        said = known.get(before << 32 | token)
                        if said or (said is None and neighbours(before, token)):
                            last.append(token)
                            size.append(n)
                            break
                else:
                    raise ValueError(f"the vocabulary has no token for byte {byte}")
            if at > enough:
                keep, out = self._stable(last, size, at)
                if out:
                    yield out
                # The token that ends at the cut stays known as the last one there.
                last, size, at = last[keep:], [0, *size[keep + 1 :]], at - keep
        yield self._tokens(last, size, at)

    @staticmethod
    def _tokens(last: list[int], size: list[int], end: int) -> list[int]:
        out = []
        while size[end]:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _stable(self, last: list[int], size: list[int], at: int) -> tuple[int, list[int]]:
        """How far all prefixes that the final encoding may pass through agree, and the tokens up to there."""
        ends = set(range(max(0, at - self.v.longest + 1), at + 1))
        while len(ends) > 1:  # step back from the furthest end until all are one
            far = max(ends)
            ends.discard(far)
            ends.add(far - size[far])
        keep = ends.pop()
        return keep, self._tokens(last, size, keep)


class Encoder(dict):
    """Text to ids. As a dict: frequent words (a run of white space and what follows it) -> ids as packed bytes.

    Pre-tokens never run on from other characters into white space, so such words
    are encoded alone. The dict only saves time: each word's ids come from the
    transducer, and once it is full the others are encoded whenever they occur.
    """

    def __init__(self, v: Vocabulary) -> None:
        super().__init__()
        self.v = v
        self.transducer = Transducer(v)
        self.words = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.cut = regex.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
        self.pretokens = regex.compile(PRETOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True))) + ")") if v.specials else None

    def __missing__(self, word: str) -> bytes:
        pieces = self.pretokens.findall(word)
        packed = b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else b"".join(self.encode(word))
        if len(self) < CACHE_WORDS and len(word) <= CACHE_LENGTH:
            self[word] = packed
        return packed

    def encode(self, piece: str) -> Iterator[bytes]:
        """One pre-token, through the transducer."""
        for ids in self.transducer.run(piece[i : i + 4096].encode("utf-8") for i in range(0, len(piece), 4096)):
            yield struct.pack(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> list[str]:
        """Words as above. Where white space is single, cutting before each space and line end gives such words too."""
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\0")):
            return self.words.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def blocks(self, text: str) -> Iterator[str]:
        """The text in parts that end where a word does."""
        at = 0
        while len(text) - at > BLOCK:
            m = self.cut.search(text, at + BLOCK)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def packed(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in blocks; special tokens' strings are tokens."""
        for part in self.special.split(text) if self.special and any(s in text for s in self.v.specials) else (text,):
            if part in self.v.specials:
                yield np.array([self.v.specials[part]], dtype="<u4").tobytes()
                continue
            for block in self.blocks(part):
                yield b"".join(map(self.__getitem__, filter(None, self.split(block))))


class Decoder:
    """Byte-to-text state machine: push token bytes, get text; the state is an unfinished character's first bytes."""

    def __init__(self) -> None:
        self.pending = b""

    def push(self, data: bytes) -> str:
        data = self.pending + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a first byte: how many does its character take?
                keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1) else 0
                break
            if b < 0x80:
                break
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


def decode(block: bytes, v: Vocabulary, state: Decoder) -> Iterator[str]:
    for at in range(0, len(block), 1 << 18):
        ids = np.frombuffer(block[at : at + (1 << 18)], dtype="<u4").tolist()
        yield state.push(b"".join(map(v.text.__getitem__, ids)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> n_tokens, digests of the ids and of the text decoded from them; a null text counts as empty.

    path: the tokenizer's file, readable on every machine.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                n, ids, text = [], [], []
                for doc in part.column(1).to_pylist():
                    h, t, length, state = hashlib.sha256(), hashlib.sha256(), 0, Decoder()
                    for block in enc.packed(doc or ""):  # a block is encoded, digested and decoded before the next one is read
                        h.update(block)
                        length += len(block) // 4
                        for x in decode(block, enc.v, state):
                            t.update(x.encode("utf-8"))
                    t.update(state.end().encode("utf-8"))
                    n.append(length)
                    ids.append(h.hexdigest())
                    text.append(t.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, ids array<int>; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [np.frombuffer(b"".join(enc.packed(t or "")), dtype="<u4").astype(np.int32) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), tokenizer_path())
