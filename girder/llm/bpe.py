"""BPE encoding and decoding by prefix-sharing trie traversal.

Words of a batch that are new to the worker are put in order, which walks their
trie depth first: a state, the last token of the encoding of a prefix, is kept
for each depth, and a word goes on from the prefix it shares with the one before.
The last token of a prefix is the one that is compatible with the last token of
what stands before it: two tokens are compatible if the merges leave them apart.
Encodings are read off by walking back from a word's last state.

Edge cases: null text is empty and has no tokens; the strings of special tokens
in a text give those tokens, as in the library; very long words take linear
time; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import lean, table

END = "</w>"
#: White space of the vocabulary's pattern, and the pattern with it written out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Words, and pairs of tokens, that a worker remembers (about 60 MB); beyond, it keeps what the batch at hand uses.
REMEMBER = 250_000
NEVER = 1 << 30


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TrieBPE:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in (self.ids | self.special).items():
            self.tokens[i] = t
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.letters = byte_letters()
        self.table = {chr(b): c for b, c in self.letters.items()}
        self.words = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.births: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def birth(self, token: str) -> tuple[int, str, str]:
        """Rank of the merge that makes a token, and the two it joins; rank -1 for a single symbol.

        Merging the token's own symbols, lowest rank first, tells; a vocabulary
        entry that merging never makes has the rank -2.
        """
        known = self.births.get(token)
        if known is None:
            parts, known = self.symbols(token), (-1, "", "")
            while len(parts) > 1:
                rank, at = min((self.ranks.get((a, b), NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))  # noqa: B905
                if rank == NEVER:
                    known = (-2, "", "")
                    break
                known = (rank, parts[at], parts[at + 1])
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.births[token] = known
        return known

    def compatible(self, a: str, b: str) -> bool:
        """Do the merges leave a and b as they are?  An empty a stands for the word's start.

        Ranks only rise while a word is merged, so a merge across the border of a
        and b had its chance before the later of the two was made: undo that one,
        look again at what meets at the border, and so on.  Of equal ranks the
        left one comes first.
        """
        known = self.fits.get((a, b))
        if known is None:
            (rank_a, _, right), (rank_b, left, _) = self.birth(a) if a else (-1, "", ""), self.birth(b)
            known, limit, x, y = rank_a > -2 and rank_b > -2, NEVER, a, b
            while known and a:
                if self.ranks.get((x, y), NEVER) < limit:
                    known = False
                elif rank_a > rank_b:
                    limit, x = rank_a, right
                    rank_a, _, right = self.birth(x)
                elif rank_b >= 0:
                    limit, y = rank_b + 1, left
                    rank_b, left, _ = self.birth(y)
                else:
                    break
            self.fits[a, b] = known
        return known

    def last_token(self, path: str, depth: int, states: list[str], suffix: str) -> str:
        """The last token of the encoding of path[:depth] + suffix, from the states of shorter prefixes."""
        ids, fits = self.ids, self.fits
        for start in range(max(0, depth - self.longest), depth):
            t = path[start:depth] + suffix
            if t in ids:
                pair = (states[start], t)
                fit = fits.get(pair)
                if fit or fit is None and self.compatible(*pair):
                    return t
        raise ValueError(f"no token ends {path[:depth]!r}")

    def path(self, word: str) -> str:
        """A word's bytes as letters; ASCII words (without blanks) are their own."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))

    def learn(self, words: set[str]) -> None:
        """Encode new words in the order of their trie."""
        if len(self.fits) > REMEMBER:
            self.fits.clear()
        packed, known, last_token = self.packed, self.known, self.last_token
        before, states = "", [""]
        for path, word in sorted((self.path(w), w) for w in words):
            n = len(path)
            shared, most = 0, min(len(states) - 1, n - 1)
            if before[:most] == path[:most]:
                shared = most
            else:
                while before[shared] == path[shared]:
                    shared += 1
            del states[shared + 1:]
            for depth in range(shared + 1, n):
                states.append(last_token(path, depth, states, ""))
            token = last_token(path, n, states, END)
            out, depth = [packed[token]], n - len(token) + len(END)
            while depth:
                token = states[depth]
                out.append(packed[token])
                depth -= len(token)
            known[word] = b"".join(out[::-1])
            before = path

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # lower() would look at a sigma's place
        return self.words.findall(text.lower())

    def pieces(self, text: str) -> list[list[str] | bytes]:
        """Words of the stretches between special tokens, and the ids of those."""
        if self.split_special is None or "<|" not in text:
            return [self.split(text)]
        parts = self.split_special.split(text)
        return [np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self.split(p) for i, p in enumerate(parts)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; the batch's new words share one traversal."""
        known = self.known
        split = [self.pieces(t) for t in texts]
        words = set()
        for parts in split:
            for p in parts:
                if isinstance(p, list):
                    words.update(p)
        new = words.difference(known)
        if len(known) + len(new) > REMEMBER:
            known = self.known = {w: known[w] for w in words if w in known}
        self.learn(new)
        return [b"".join([b"".join(map(known.__getitem__, p)) if isinstance(p, list) else p for p in parts]) for parts in split]

    def forget(self) -> None:
        """Keep the vocabulary only: a worker's next task may be of another operator."""
        self.known.clear()
        self.fits.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[str, TrieBPE] = {}


def encoder(path: str) -> TrieBPE:
    if path not in _LOADED:
        _LOADED[path] = TrieBPE(path)
    return _LOADED[path]


def encode_docs(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, keep: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids and decoded, a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = [[] for _ in range(5)]
                for ids in enc.encode_batch([t or "" for t in b.column(1).to_pylist()]):
                    decoded = enc.decode(ids)
                    for col, v in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), np.frombuffer(ids, dtype="<u4").astype(np.int32) if keep else None, decoded if keep else None), strict=True):
                        col.append(v)
                cols = [b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
        enc.forget()

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document encoded and decoded."""
    return encode_docs(table(spark, sf_dir, "documents"), vocabulary(), keep=False)
