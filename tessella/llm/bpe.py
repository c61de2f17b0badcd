"""Byte-pair encoding as a deterministic automaton, after the merge-gadget construction of Berglund, Martens and
van der Merwe ("Constructing a BPE Tokenization DFA", 2024) and Cognetta and Okazaki.

The automaton reads tokens. It starts as one state that allows any byte after any byte. Each merge (u, v) -> w, in
order of rank, inserts a gadget: the state q that u leads to is copied without its v-arc, u-arcs lead to the copy, and
every state that allows u, then v, gets a w-arc to where v leads. In the end a sequence of tokens is accepted if and
only if it is what applying the merges in order of rank gives for its bytes.

All arcs of one token lead to one state, so the state after a token is a property of the token, and what it forbids is
a set of tokens. Let a token hang below its left part in a forest, later merges first. Removing the arc of v at a merge
of rank r forbids v and what is built from v by merges of rank r or more: one interval of the forest's preorder. So the
transition table is a sorted list of intervals for each state, about 19 for each token of a 50k vocabulary.

A word's bytes are encoded from the left: from each position whose prefix has been read, a trie of tokens gives the
arcs, and the table says which the state allows. Each prefix has exactly one accepted path, so there is no search.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import carried, fields, pieces, small_batches

#: Fixed: the byte-level alphabet's printable bytes stand for themselves, the others for the code points from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ODD = [b for b in range(256) if b not in _PRINTABLE]
BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(_ODD)}
#: Fixed: the byte-level pre-tokenizer's pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of code points below this are split by a pattern that names its characters; it is nearly three times as fast.
LATIN = 0x250


def latin_split() -> str:
    """SPLIT for code points below LATIN. Letters come first: no other alternative starts as they do."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)
    letter, number, space = of("L"), of("N"), re.escape("\t\n\x0b\x0c\r \x85\xa0")
    return rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


class TokenAutomaton:
    """The compiled automaton: trie of tokens, states' forbidden intervals, arc labels."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        size = max(vocab.values()) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = token
        parent = np.full(size, -1, np.int64)
        rank = np.full(size, -1, np.int64)
        children: list[list[int]] = [[] for _ in range(size)]
        built: list[tuple[int, int, int]] = []
        for r, (u, v) in enumerate(merges):
            w = vocab[u + v]
            if rank[w] < 0:  # a token made by a second merge keeps its first
                a, b = vocab[u], vocab[v]
                rank[w], parent[w] = r, a
                children[a].append(w)
                built.append((a, b, w))
        bytes_only = [vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab]
        self.pre, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self._number(bytes_only, children)
        self._gadgets(size, bytes_only, children, rank, built)
        self._trie({t: i for t, i in vocab.items() if rank[i] >= 0 or len(t) == 1})

    def _number(self, roots: list[int], children: list[list[int]]) -> None:
        """Preorder of the forest; below a token later merges come first."""
        clock = 0
        stack = [(t, False) for t in reversed(roots)]
        while stack:
            t, done = stack.pop()
            if done:
                self.end[t] = clock
                continue
            self.pre[t] = clock
            clock += 1
            stack.append((t, True))
            stack.extend((c, False) for c in children[t])  # the last, of the highest rank, is taken first

    def _gadgets(self, size, roots, children, rank, built) -> None:
        # a state is a list of forbidden (start, stop); target[t] is the state that t leads to
        target: list[tuple | None] = [None] * size
        for t in roots:
            target[t] = ()
        later: dict[int, list[int]] = {t: list(c) for t, c in enumerate(children) if c}  # of v: what it begins, by rank
        at = dict.fromkeys(later, 0)
        for a, b, w in built:
            # children of b of lower rank than this merge stay allowed; those of this rank or more go with b
            kids = later.get(b, [])
            k = at.get(b, 0)
            while k < len(kids) and rank[kids[k]] < rank[w]:
                k += 1
            if kids:
                at[b] = k
            stop = self.end[b] if k == 0 else self.pre[kids[k - 1]]
            after = target[b]
            target[a] = (target[a], (int(self.pre[b]), int(stop)))  # a linked list: copies share what they had
            target[w] = after
        starts, stops, owner, seen = [], [], [], {}
        self.state = np.zeros(size, np.int32)  # of a token; state 0 forbids nothing
        for t in range(size):
            s = target[t]
            if not s:
                continue
            if id(s) not in seen:
                seen[id(s)] = len(seen) + 1
                spans, x = [], s
                while x:
                    x, span = x
                    spans.append(span)
                merged: list[list[int]] = []
                for lo, hi in sorted(spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                starts += [m[0] for m in merged]
                stops += [m[1] for m in merged]
                owner += [seen[id(s)]] * len(merged)
            self.state[t] = seen[id(s)]
        self.stride = size + 1
        key = np.array(owner, np.int64) * self.stride
        self.starts, self.stops = key + np.array(starts, np.int64), key + np.array(stops, np.int64)

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """A double array: the child of node x by byte b is slot base[x] + b, if that slot's owner is x."""
        children: dict[bytes, list[int]] = {b"": []}
        for token in tokens:
            for k in range(len(token), 0, -1):
                known = token[: k - 1] in children
                children.setdefault(token[:k], [])
                children.setdefault(token[: k - 1], []).append(token[k - 1])
                if known:
                    break
        children = {prefix: sorted(set(kids)) for prefix, kids in children.items()}
        room = 2 * len(children) + 1024
        owner, base, token_at = np.full(room, -1, np.int32), np.zeros(room, np.int32), np.full(room, -1, np.int32)
        free = np.ones(room, bool)
        free[0] = False
        slots = {b"": 0}
        first = 1
        for prefix in sorted(children, key=lambda p: (len(p), -len(children[p]))):
            kids = children[prefix]
            if not kids:
                continue
            while not free[first]:
                first += 1
            if len(kids) == 1:
                start = max(first - kids[0], 0)
                start += int(np.flatnonzero(free[start + kids[0] : start + kids[0] + 4096])[0])
            else:
                start = max(first - kids[0], 0)
                while True:
                    fits = free[start + kids[0] : start + kids[0] + 4096].copy()
                    for b in kids[1:]:
                        fits &= free[start + b : start + b + 4096]
                    if fits.any():
                        start += int(fits.argmax())
                        break
                    start += 4096
            base[slots[prefix]] = start
            for b in kids:
                free[start + b], owner[start + b] = False, slots[prefix]
                slots[prefix + bytes([b])] = start + b
                token_at[start + b] = tokens.get(prefix + bytes([b]), -1)
        used = int(np.flatnonzero(~free)[-1]) + 257
        self.owner, self.base, self.token_at = owner[:used].copy(), base[:used].copy(), token_at[:used].copy()

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for each token."""
        if not len(self.starts):
            return np.ones(len(state), bool)
        at = state * np.int64(self.stride) + self.pre[token]
        i = np.searchsorted(self.starts, at, "right") - 1
        return (i < 0) | (at >= self.stops[i])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word as little-endian 32-bit numbers; words of one length go through the tables together."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, which in by_length.items():
            block = max(1, (1 << 18) // max(1, n))
            for k in range(0, len(which), block):
                part = which[k : k + block]
                ids, ends = self._encode(np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n))
                start = 0
                for i, stop in zip(part, ends):
                    out[i] = ids[start:stop]
                    start = stop
        return out

    def _encode(self, data: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids of all words, one after another, and the byte at which each word's ids end."""
        m, n = data.shape
        if not n:
            return b"", [0] * m
        # of each word and prefix: the last token and its start
        last, back = np.full((m, n + 1), -1, np.int32), np.zeros((m, n + 1), np.int32)
        word, start = np.zeros(0, np.int64), np.zeros(0, np.int64)  # open walks through the trie
        node, state = np.zeros(0, np.int32), np.zeros(0, np.int32)
        every = np.arange(m)
        for i in range(n):
            fresh = self.state[last[:, i]] if i else np.zeros(m, np.int32)
            word, start = np.concatenate([word, every]), np.concatenate([start, np.full(m, i)])
            node, state = np.concatenate([node, np.zeros(m, np.int32)]), np.concatenate([state, fresh])
            child = self.base[node] + data[word, i]
            alive = self.owner[child] == node
            node = child
            word, start, node, state = word[alive], start[alive], node[alive], state[alive]
            token = self.token_at[node]
            ends = np.flatnonzero(token >= 0)
            ends = ends[self.allows(state[ends].astype(np.int64), token[ends])]
            last[word[ends], i + 1], back[word[ends], i + 1] = token[ends], start[ends]
        at, live, found = np.full(m, n), every, []
        while len(live):
            found.append((live, last[live, at[live]]))
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        owner = np.concatenate([x for x, _ in reversed(found)])
        ids = np.concatenate([x for _, x in reversed(found)]).astype("<u4")
        order = np.argsort(owner, kind="stable")
        return ids[order].tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=m))).tolist()

    def decode(self, ids) -> bytes:
        """The arc labels of ids, one after another."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])


class Tokenizer:
    """Splits texts into special tokens and words and encodes words by the automaton, each distinct word once while it
    is in the cache. Compiled on the driver; pickled without the cache and the patterns."""

    def __init__(self, spec: str, cache_bytes: int = 40 << 20):
        given = json.loads(spec)
        turn = lambda t: bytes(BYTE_OF[c] for c in t)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in given["model"]["merges"]]
        self.machine = TokenAutomaton({turn(t): i for t, i in given["model"]["vocab"].items()}, [(turn(a), turn(b)) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        for text, i in self.special.items():
            self.machine.labels += [b""] * (i + 1 - len(self.machine.labels))
            self.machine.labels[i] = text.encode()
        self.cache_bytes = cache_bytes
        self._start()

    def _start(self) -> None:
        import regex

        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.all_words, self.latin_words = regex.compile(SPLIT).findall, re.compile(latin_split()).findall
        self.beyond = re.compile(f"[^\x00-{chr(LATIN - 1)}]").search
        self.cache: dict[str, bytes] = {}
        self.room = self.cache_bytes

    def __getstate__(self) -> dict:
        return {"machine": self.machine, "special": self.special, "cache_bytes": self.cache_bytes}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def words(self, text: str) -> list[str]:
        return self.all_words(text) if self.beyond(text) else self.latin_words(text)

    def split(self, text: str) -> list[str]:
        if self.parts is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.parts.split(text) for w in ([part] if part in self.special else self.words(part))]

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text as little-endian 32-bit numbers. The cache of words is emptied when it is full."""
        split: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            split.append(self.split(text))
            size += len(text)
            if size > 1 << 20 or k + 1 == len(texts):
                yield from self._encode(split)
                split, size = [], 0

    def _encode(self, split: list[list[str]]) -> Iterator[np.ndarray]:
        if self.room < 0:
            self.cache, self.room = {}, self.cache_bytes
        cache = self.cache
        new = list(set().union(*split) - cache.keys())
        plain = [w for w in new if w not in self.special]
        for w, ids in zip(plain, self.machine.encode_words([w.encode() for w in plain])):
            cache[w] = ids
            self.room -= 120 + 5 * len(w)
        for w in set(new) & self.special.keys():
            cache[w] = np.array([self.special[w]], "<u4").tobytes()
        for words in split:
            yield np.frombuffer(b"".join([cache[w] for w in words]), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.machine.decode(ids.tolist()).decode("utf-8", "replace")


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """The compiled tokenizer of a specification; this process keeps one."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(spec)
    return _tokenizers[key]


def load_spec(path: str) -> str:
    """A byte-level BPE file of the tokenizers library, read on the driver. Its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, keep: list[str] | None = None, digest: bool = False, decoded: bool = True) -> DataFrame:
    """Per row of docs: the columns in keep (doc_id), ids, the text's token ids, and with decoded their decoded text;
    digest gives n_tokens, ids_sha256 and decoded_sha256 in their place. Every text's ids are decoded by the automaton's arc
    labels; where neither gives that back, it is compared with the text, and ids that do not decode to it are an error.

    Null and empty texts have no tokens; repeated rows are encoded each; other columns play no part unless kept. The
    automaton (a few MB, of the vocabulary's size) is compiled on the driver and broadcast; workers hold about 2 MB of
    text at once and a bounded cache of words.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer(spec))
    df, kept, text = carried(docs, keep)
    hashed = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            ids = list(own.encode_batch(texts))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            said = [own.decode(x).encode() for x in ids]
            if not (digest or decoded) and said != [x.encode() for x in texts]:
                raise ValueError("token ids do not decode to their text")
            if digest:
                out = {"n_tokens": pa.array(sizes), "ids_sha256": pa.array([hashed(x.tobytes()) for x in ids], pa.string()), "decoded_sha256": pa.array(map(hashed, said), pa.string())}
            else:
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))}
                out |= {"decoded": pa.array(said, pa.binary()).cast(pa.string())} if decoded else {}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out.values()], names=[*kept, *out])

    names = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digest else ["ids array<int>", *["decoded string"] * decoded]
    out = df.mapInArrow(run, fields(df, kept, ", ".join(names)))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *[n.split()[0] for n in names])


def decode(tokens: DataFrame, spec: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids are no ids. An id outside the vocabulary is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(tokenizer(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [own.machine.decode(x or []).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, fields(rows, ["doc_id"], "text string"))
