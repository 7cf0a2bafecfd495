"""Encoding of a corpus by a byte-level BPE vocabulary, through a tokenization automaton.

The merges are compiled in order.  A merge ``(u, v) -> w`` is a gadget on the
automaton over tokens: every state that reads ``u`` and then ``v`` gets an arc
``w``, the state behind ``w`` copies the arcs of the state behind ``v``, and the
state behind ``u`` loses its arc ``v``.  Because a state is known by the token
just read, the finished automaton is the table "may ``t`` follow ``p``"; its
entries are derived from the gadgets when they are first needed (all of them
would be 2.5 billion for 50,000 tokens) and kept.

A word is encoded by one left-to-right pass: arc labels are spelled along a byte
trie, and for each position exactly one arc is allowed to end there.  Decoding
emits arc labels.  The cost is linear in the length of the word, so runs of any
length are safe.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm._common import fresh

#: Where the public vocabularies lie; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pre-split pattern of this family of vocabularies, with white space as Unicode defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Words kept per Python worker before the table starts afresh.
WORD_CACHE = 200_000


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the printable spelling in the vocabulary file: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> bytes:
    """The vocabulary and its merges in compact form, read once on the driver and sent to the workers."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    letters = _byte_letters()
    spell = lambda s: bytes(letters[c] for c in s)
    vocab = [[spell(t).hex(), i] for t, i in model["vocab"].items()]
    merges = []
    for m in model["merges"]:
        u, v = m.split(" ") if isinstance(m, str) else m
        merges.append([spell(u).hex(), spell(v).hex()])
    return zlib.compress(json.dumps([vocab, merges]).encode())


class TokenAutomaton:
    """Compiled merges: ``encode_word``, ``encode`` and ``decode``."""

    def __init__(self, packed: bytes):
        vocab, merges = json.loads(zlib.decompress(packed))
        self.ids = {bytes.fromhex(t): i for t, i in vocab}
        self.label: list[bytes] = [bytes([b]) for b in range(256)]
        self.birth = [-1] * 256
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        self.rank: dict[tuple[int, int], int] = {}
        #: trie: node * 256 + byte -> node; the token spelled at a node or -1
        self.step: dict[int, int] = {}
        self.ends: list[int] = [-1]
        known = {}
        for b in range(256):
            known[bytes([b])] = b
            self._spell(b)
        for k, (u, v) in enumerate(merges):
            a, b = known[bytes.fromhex(u)], known[bytes.fromhex(v)]
            w = self.label[a] + self.label[b]
            self.rank.setdefault((a, b), k)
            if w not in known:
                known[w] = len(self.label)
                self.label.append(w)
                self.birth.append(k)
                self.parts.append((a, b))
                self._spell(known[w])
        self.out = [self.ids.get(w, -1) for w in self.label]
        self.by_id = {i: t for t, i in self.ids.items()}
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN)

    def _spell(self, token: int) -> None:
        node = 0
        for b in self.label[token]:
            nxt = self.step.get(node << 8 | b)
            if nxt is None:
                nxt = len(self.ends)
                self.ends.append(-1)
                self.step[node << 8 | b] = nxt
            node = nxt
        self.ends[node] = token

    def arc(self, p: int, t: int) -> bool:
        """May ``t`` follow ``p``?  Read off the gadgets, latest first."""
        code = p << 32 | t
        got = self.arcs.get(code)
        if got is None:
            got = self.arcs[code] = self._arc(p, t)
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
        return got

    def _arc(self, p: int, t: int) -> bool:
        before = 1 << 60
        while True:
            k = self.rank.get((p, t))
            if k is not None and k < before:
                return False  # this gadget took the arc away
            bp, bt = self.birth[p], self.birth[t]
            if bp < 0 and bt < 0:
                return True
            if bt >= bp:
                u, v = self.parts[t]
                if p == u == v:
                    return False  # of three equal tokens the left two merge
                before, t = bt, u  # arc t was added where u, v could be read
            else:
                before, p = bp, self.parts[p][1]  # the state behind p is a copy of the one behind its right part

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        step, ends, arc = self.step, self.ends, self.arc
        last = [-1] * (n + 1)
        for i in range(n):
            p = last[i]
            if i and p < 0:
                continue
            node, j = 0, i
            while j < n:
                node = step.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                j += 1
                t = ends[node]
                if t >= 0 and last[j] < 0 and (i == 0 or arc(p, t)):
                    last[j] = t
        out, j = [], n
        while j:
            t = last[j]
            out.append(self.out[t])
            j -= len(self.label[t])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for NULL and for empty text."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        for w in self.split.findall(text):
            got = words.get(w)
            if got is None:
                got = self.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(words) >= WORD_CACHE:
                        words.clear()
                    words[w] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.by_id[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[bytes, TokenAutomaton] = {}


def automaton(packed: bytes) -> TokenAutomaton:
    """The automaton of a vocabulary, built once per Python worker."""
    key = hashlib.sha256(packed).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TokenAutomaton(packed)
    return _LOADED[key]


def _codec(df: DataFrame, file: str, tokenizers: str):
    return df.sparkSession.sparkContext.broadcast(load_vocabulary(f"{tokenizers}/{file}"))


def _source(df: DataFrame, keep: tuple[str, ...], value: Column, result: str) -> DataFrame:
    """The kept columns and the value under a name that none of them has."""
    if result in keep:
        raise ValueError(f"the kept columns may not hold {result!r}, the name of the result")
    return df.select(*keep, value.alias(fresh(df, "_value")))


def encode_corpus(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), file: str = "byte_bpe_50k.json", tokenizers: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """Ids of every text: ``keep`` columns and ``ids`` ARRAY<INT> (or ``n_tokens`` BIGINT).

    NULL and empty texts give an empty list (or 0).  Strings that look like
    special tokens are ordinary text.  Whole texts are encoded, whatever their
    length; rows stay where they are (no shuffle).  Columns of ``df`` beyond
    ``keep`` are dropped at the scan.
    """
    packed = _codec(df, file, tokenizers)
    out_field = "n_tokens bigint" if counts_only else "ids array<int>"
    src = _source(df, keep, F.col(text).cast("string"), out_field.split()[0])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + (", " if keep else "") + out_field
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = automaton(packed.value)
        for batch in batches:
            lists = map(m.encode, batch.column(k).to_pylist())
            if counts_only:
                col = pa.array([len(x) for x in lists], pa.int64())
            else:
                col = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], col], [*keep, out_field.split()[0]])

    return src.mapInArrow(run, schema)


def decode_corpus(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), file: str = "byte_bpe_50k.json", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``text``: the arc labels of the ids in a row; NULL or empty ids give empty text."""
    packed = _codec(df, file, tokenizers)
    src = _source(df, keep, F.col(ids).cast("array<int>"), "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + (", " if keep else "") + "text string"
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = automaton(packed.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array([m.decode(x or []) for x in batch.column(k).to_pylist()], pa.string())], [*keep, "text"])

    return src.mapInArrow(run, schema)
