"""BPE encoding and decoding by a tokenization automaton compiled from the merges.

States stand for the last token read; an arc labelled with a token t leads to the state of t. The
automaton starts with one state that has an arc for every base symbol. A merge (u, v) -> uv is one
gadget: wherever u may be followed by v, that v-arc is cut from the state behind u, and an arc uv
is added beside u. The state behind uv is the one behind v as it was at that time, so it shares the
cuts made until then and none made later; an arc uv exists behind exactly the states that had u.
After the last merge every word has one path, which spells its canonical tokenization.

The gadgets leave two tables. ``Automaton.cuts`` holds the cut arcs by (u, v) with their time; an
arc b behind token a is missing iff some ancestor of a on its right edge and some ancestor of b on
its left edge were cut before either was merged onward. ``Automaton.suffixes`` holds, for every
token, the longest shorter token that ends it. Encoding runs once over the symbols of a word: the
longest token ending at a position whose arc is present behind the state at its start is the last
token of the prefix, so each position takes a few table lookups. Decoding emits the arcs' labels.

Words are pre-split as the vocabulary file says (compose, lower-case, letters | one digit | other
marks, English clitics); the file's special strings are single tokens. Each distinct word is encoded
once per process while the memory lasts (``MEMORY`` words and runs of words; then it starts anew).

Defined cases: a null or empty text has no tokens and decodes to the empty string; white space is
dropped; repeated rows are all returned; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the vocabulary's pre-splitting rule and of its end-of-word mark.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{new}]]+|[\p{{N}}--[{new}]]|[[^\s\p{{L}}\p{{N}}][{new}]]+"
END = "</w>"
#: Code points that the vocabulary's rule takes for other marks, as they came into Unicode after it.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals whose small letters this Python doesn't know yet.
NEW_CAPITALS = dict(zip(
    [0x1C89, 0xA7CB, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA, 0xA7DC, *range(0x10D50, 0x10D66), *range(0x16EA0, 0x16EB9)],
    [0x1C8A, 0x0264, 0xA7CD, 0xA7CF, 0xA7D3, 0xA7D5, 0xA7DB, 0x019B, *range(0x10D70, 0x10D86), *range(0x16EBB, 0x16ED4)], strict=True,
))
#: Words, runs of words, transitions and half as many arcs that a process remembers.
MEMORY = 100_000


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: visible Latin-1 as it is, the rest from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Automaton:
    """The compiled merges of a vocabulary file, with encoder and decoder."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.labels = {i: t for t, i in self.ids.items()} | {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.symbols = byte_symbols()
        self.inner = [self.ids[s] for s in self.symbols]
        self.final = [self.ids[s + END] for s in self.symbols]
        base = {*self.inner, *self.final}
        self.cuts: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for time, merge in enumerate(model["merges"]):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            self._gadget(self.ids[u], self.ids[v], self.ids[u + v], time)
        spelling: dict[int, tuple[int, ...]] = {b: (b,) for b in base}
        for t, (u, v, _) in self.made.items():
            spelling[t] = spelling[u] + spelling[v]
        by_spelling = {s: t for t, s in spelling.items()}
        self.suffixes: dict[int, int] = {}
        for t, s in spelling.items():
            self.suffixes[t] = next((by_spelling[s[k:]] for k in range(1, len(s)) if s[k:] in by_spelling), -1)
        self.length = {t: len(s) for t, s in spelling.items()}
        self._trie(by_spelling)
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.pattern = regex.compile(SPLIT.format(new=NEWER), regex.V1)
        self.capitals = regex.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]")
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        """Cut v behind u at this time and add uv; a merge whose path is cut already changes nothing."""
        self.cuts.setdefault((u, v), time)
        self.made.setdefault(uv, (u, v, time))

    def _edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """t and its ancestors on one edge, each with the time at which it was merged onward; kept for tokens that texts hold."""
        known = self.right if side else self.left
        if t not in known:
            out, at = [(t, float("inf"))], t
            while at in self.made:
                until = self.made[at][2]
                at = self.made[at][side]
                out.append((at, until))
            known[t] = out
        return known[t]

    def _trie(self, by_spelling: dict) -> None:
        """Next state by (state, symbol), a state being the longest run of symbols that starts a token."""
        nodes = {(): 0}
        for s in by_spelling:
            for k in range(1, len(s) + 1):
                nodes.setdefault(s[:k], len(nodes))
        order = sorted(nodes, key=len)
        fail, longest, step = [0] * len(nodes), [-1] * len(nodes), {}
        for s in order[1:]:
            own = nodes[s]
            step[(nodes[s[:-1]], s[-1])] = own
            back = fail[nodes[s[:-1]]] if len(s) > 1 else -1
            while back > 0 and (back, s[-1]) not in step:
                back = fail[back]
            fail[own] = step.get((back, s[-1]), 0) if back >= 0 else 0
            longest[own] = by_spelling.get(s, longest[fail[own]])
        symbols = {t: n for n, t in enumerate(self.inner)} | {t: n + 256 for n, t in enumerate(self.final)}
        self.goto = {state << 9 | symbols[t]: to for (state, t), to in step.items()}
        self.fail, self.longest, self.compiled = fail, longest, len(self.goto)

    def _goto(self, state: int, symbol: int) -> int:
        """The transition where the state's own run can't go on; entered into the table."""
        if len(self.goto) >= self.compiled + MEMORY:  # the compiled transitions came first
            self.goto = dict(islice(self.goto.items(), self.compiled))
        back = state
        while back << 9 | symbol not in self.goto:
            back = self.fail[back]
        found = self.goto[state << 9 | symbol] = self.goto[back << 9 | symbol]
        return found

    def has_arc(self, a: int, b: int) -> bool:
        """Whether the state behind token a has an arc b."""
        key = a << 32 | b
        found = self.arcs.get(key)
        if found is None:
            cuts, found = self.cuts, True
            before, after = self._edge(a, 1), self._edge(b, 0)
            for x, until in before:
                for y, since in after:
                    time = cuts.get((x, y))
                    if time is not None and time < until and time <= since:
                        found = False
                        break
                if not found:
                    break
            if len(self.arcs) >= 2 * MEMORY:
                self.arcs.clear()
            self.arcs[key] = found
        return found

    def path(self, word: str) -> list[int]:
        """The labels of a pre-split word's path."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        symbols[-1] += 256
        goto, longest, suffixes, length, arcs = self.goto, self.longest, self.suffixes, self.length, self.arcs
        last, state, at = [], 0, 0
        for symbol in symbols:
            key = state << 9 | symbol
            state = goto[key] if key in goto else self._goto(state, symbol)
            at += 1
            token = longest[state]
            before = at - length[token]
            while before:
                key = last[before - 1] << 32 | token
                if arcs[key] if key in arcs else self.has_arc(last[before - 1], token):
                    break
                token = suffixes[token]
                before = at - length[token]
            last.append(token)
        out, at = [], len(symbols)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= length[token]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """A word's ids as little-endian 32-bit integers."""
        if len(self.words) >= MEMORY:
            self.words.clear()
        out = self.words[word] = b"".join(t.to_bytes(4, "little") for t in self.path(word))
        return out

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.marks is None or "<|" not in text and not self.marks.search(text):
            return self._plain(text)
        parts = self.marks.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in parts if p)

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-cased by itself, whatever follows
            text = text.replace("Σ", "σ")
        if not text.isascii() and self.capitals.search(text):
            text = text.translate(NEW_CAPITALS)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
            return self._chunk(text.lower())
        known, add = self.chunks, self._new_chunk
        return b"".join([known[c] if c in known else add(c) for c in text.lower().split()])

    def _chunk(self, chunk: str) -> bytes:
        known, add = self.words, self.word
        return b"".join([known[w] if w in known else add(w) for w in self.pattern.findall(chunk)])

    def _new_chunk(self, chunk: str) -> bytes:
        """Remember a run between white space: no word reaches across it."""
        if len(self.chunks) >= MEMORY:
            self.chunks.clear()
        if chunk.isalpha():  # letters alone are one word
            out = self.words[chunk] if chunk in self.words else self.word(chunk)
        else:
            out = self._chunk(chunk)
        self.chunks[chunk] = out
        return out

    def decode(self, ids: bytes) -> str:
        """The labels of the ids, joined by single spaces (the file names no decoder)."""
        labels = self.labels
        return " ".join([labels[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """The automaton of a vocabulary file, compiled once in each process."""
    with open(path, encoding="utf-8") as f:
        out = Automaton(json.load(f))
    gc.freeze()  # the tables stay; collections needn't walk them
    return out


def _run(path: str, keep: bool):
    def run(batches):
        automaton = load(path)
        for batch in batches:
            counts, ids, digests, shown = [], [], [], []
            for text in batch.column(1):
                found = automaton.encode(text.as_py())
                counts.append(len(found) // 4)
                digests.append(hashlib.sha256(found).hexdigest())
                shown.append(automaton.decode(found))
                if keep:
                    ids.append(found)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
            columns += [pa.array(ids, pa.binary()), pa.array(shown, pa.string())] if keep else [pa.array([hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for s in shown], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", *(["ids", "decoded"] if keep else ["decoded_sha256"])])

    return run


def encode_documents(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, ids, decoded) of whole texts; without ``keep`` only digests of the last two."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids binary, decoded string" if keep else "decoded_sha256 string"
    return docs.mapInArrow(_run(path, keep), f"doc_id {kind}, n_tokens long, ids_sha256 string, {rest}")
