"""BPE encoding and decoding with a deterministic automaton over tokens.

The automaton reads tokens and accepts exactly the tokenisations that the merges produce. It starts as one state with
a loop for every byte. Each merge (u, v) -> w adds one gadget: the state that u leads to is copied without its arc v,
u is redirected to the copy, and wherever u could be read, w is added, leading to where v led. Any string labels one
accepting path and any place of it has one state that can be reached, so encoding searches for the word's end through
places not entered before, along a tree of the labels and longer arcs first. States share arcs with the state they were
copied from; arcs are looked up through that chain once and then tabled.

Defined results: null counts as empty and has no tokens; special tokens in a text are encoded as such; undecodable
bytes decode to U+FFFD; repeated rows are encoded alike; an empty table gives no rows; a very long word takes memory in
proportion to its length and isn't remembered; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terralex.llm.arrow import mapped

PRE_SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Distinct words whose tokens a worker remembers at a time, and their largest size: together a bound in bytes.
REMEMBERED = 400_000
LONGEST = 64
#: Arcs that it keeps tabled at a time.
TABLED = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """Built from a vocabulary (token bytes by id) and merges as (left id, right id, merged id) in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.rule = {w: (u, v) for u, v, w in merges}
        if len(self.rule) < len(merges):
            raise ValueError("two merges make the same token")
        #: State 0 is the start; others have the state they copy, the arc they lack and the merge that made them.
        self.copied, self.lacks, self.made = [0], [-1], [-1]
        self.target = {t: 0 for t in labels}
        self.born = {t: -1 for t in labels if t not in self.rule}
        self.known: dict[int, bool] = {}
        for k, (u, v, w) in enumerate(merges):
            if self.born.get(u, k) >= k or self.born.get(v, k) >= k:
                raise ValueError("a merge uses a token that a later merge makes")
            self._gadget(k, u, v, w)
        self.known.clear()
        #: Labels as a tree of bytes; -1 holds the token that ends at a node.
        self.trie: dict = {}
        for token, label in labels.items():
            if token not in self.born:
                continue
            node = self.trie
            for byte in label:
                node = node.setdefault(byte, {})
            node[-1] = token

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        q, after = self.target[u], self.target[v]
        if not self.has(q, v):
            return
        self.copied.append(q)
        self.lacks.append(v)
        self.made.append(k)
        self.target[u] = len(self.copied) - 1
        self.target[w] = after
        self.born[w] = k

    def has(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``."""
        key = state << 32 | token
        known = self.known.get(key)
        if known is None:
            made, lacks, born = self.made, self.lacks, self.born
            while True:
                if made[state] > born[token]:  # copied when the arc was there or not
                    if lacks[state] == token:
                        known = False
                        break
                    state = self.copied[state]
                elif token in self.rule:  # the arc came with the merge, where its left part could be read
                    token = self.rule[token][0]
                else:
                    known = True
                    break
            if len(self.known) >= TABLED:
                self.known.clear()
            self.known[key] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """The labels of the accepting path. Of the arcs that leave a place of the word, longer ones are tried first; each
        place has one state that can be reached, so none is entered twice."""
        n, target, has = len(word), self.target, self.has
        view = word if n <= LONGEST else memoryview(word)  # slices of it are not copied
        states, came = [-1] * (n + 1), [-1] * (n + 1)
        states[0], at = 0, 0
        todo: list[tuple[int, int, int]] = []  # (place, arc into it, state before the arc)
        while at < n:
            node, state, end = self.trie, states[at], at
            for byte in view[at:]:
                node = node.get(byte)
                if node is None:
                    break
                end += 1
                token = node.get(-1)
                if token is not None and states[end] < 0:
                    todo.append((end, token, state))
            while True:
                at, token, state = todo.pop()
                if states[at] < 0 and has(state, token):
                    break
            states[at], came[at] = target[token], token
        out = []
        while n:
            out.append(came[n])
            n -= len(self.labels[came[n]])
        return out[::-1]


class Encoder(dict):
    """Word -> its ids as little-endian 32-bit integers; words are encoded when first seen."""

    def __init__(self, spec: bytes):
        super().__init__()
        data = json.loads(spec)
        model, symbols = data["model"], byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        labels = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.automaton = TokenAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = [labels.get(i, b"") for i in range(max([*labels, *self.special.values()]) + 1)]
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def forget(self) -> None:
        """Drop the remembered words and arcs."""
        self.clear()
        self.automaton.known.clear()

    def __missing__(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        out = array("I", self.automaton.encode(data)).tobytes()  # little-endian hosts
        if len(data) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.cut or "<" not in text and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, PRE_SPLIT.findall(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(self.__getitem__, PRE_SPLIT.findall(text[at : m.start()]))
            out.append(self.special[m.group()].to_bytes(4, "little"))
            at = m.end()
        return b"".join(out + list(map(self.__getitem__, PRE_SPLIT.findall(text[at:]))))

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 of the labels along the path."""
        out = b"".join(map(self.labels.__getitem__, ids))
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace").encode()


@lru_cache(2)
def encoder(spec: bytes) -> Encoder:
    return Encoder(spec)


def _ids(code: bytes) -> list[int]:
    return memoryview(code).cast("I").tolist()  # little-endian hosts


def _coded(docs: DataFrame, source: str, tokenizer: str, columns: str, row) -> DataFrame:
    """doc_id and what ``row(encoder, value)`` gives for each value of ``source``."""
    with open(tokenizer, "rb") as f:
        spec = f.read()

    def fn(batch: pa.RecordBatch) -> list:
        coder = encoder(spec)
        rows = [row(coder, v) for v in batch.column(source).to_pylist()]
        return list(zip(*rows, strict=True)) if rows else [[] for _ in columns.split(",")]

    return mapped(docs.select("doc_id", source), ["doc_id"], columns, fn, lambda: encoder(spec).forget())


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    return _coded(docs, "text", tokenizer, "ids array<int>", lambda coder, text: (_ids(coder.encode(text or "")),))


def decoded(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return _coded(tokens, "ids", tokenizer, "text string", lambda coder, ids: (coder.decode(ids or []).decode(),))


def _digest(coder: Encoder, text: str | None) -> tuple[int, str, str]:
    code = coder.encode(text or "")
    return len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(coder.decode(_ids(code))).hexdigest()


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document: number of tokens, and checksums of its ids and of the text they decode to."""
    return _coded(docs, "text", tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
