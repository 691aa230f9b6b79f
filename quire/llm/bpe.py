"""BPE encoding and decoding with a pair occurrence index (operator 1).

The distinct words of a block are laid out as one array of symbols. An index maps the rank of each adjacent pair to all
positions where it stands; active ranks are applied in ascending order, each at all its positions at once, and only the
lists of the pairs beside a merge change. That equals word-by-word merging, for a merge can only use what an earlier
merge has made; ``Codec`` checks that when it reads a vocabulary.

Null texts count as empty; an empty text has no tokens. Special tokens in a text become their own ids, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.blocks import strings, text_blocks

#: Word pattern of the vocabulary's own file, a fixed value.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that the Unicode tables of the libraries at hand class differently (new in one of them), and all beyond the
#: basic plane: texts with such a letter are parted by the tokenizers library itself.
UNSETTLED = "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c89\u208f\u209d-\u209f\ua7cb-\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]"
#: Control letters at which ``str.split`` parts a text and the vocabulary's pattern does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
KNOWN_WORDS = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file with word ends, lower case and byte letters."""

    def __init__(self, spec: str, known_words: int = KNOWN_WORDS):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        suffix = model["model"]["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.base = len(self.tokens)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        first_made = np.full(self.base, -1, np.int64)
        first_made[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if (np.maximum(first_made[self.left], first_made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that only a later merge makes")
        keys = self.left * self.base + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.word = regex.compile(WORD)
        self.unsettled = regex.compile(UNSETTLED)
        self.spec, self.library = spec, None
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.known: dict[str, bytes] = {}
        self.known_words = known_words

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merged(self, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge symbols; ``last`` marks each word's last one. Returns the symbols that stay and their positions."""
        n = len(ids)
        after = np.arange(1, n + 1)
        after[last] = -1
        before = np.arange(-1, n - 1)
        before[1:][last[:-1]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(ranks: np.ndarray, at: np.ndarray) -> None:
            hit = ranks >= 0
            ranks, at = ranks[hit], at[hit]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist(), len(ranks)]
            for rank, lo, hi in zip(ranks[begins[:-1]].tolist(), begins[:-1], begins[1:], strict=True):
                if rank in index:
                    index[rank].append(at[lo:hi])
                else:
                    index[rank] = [at[lo:hi]]
                    heapq.heappush(active, rank)

        at = np.flatnonzero(~last)
        note(self.rank_of(ids[at], ids[at + 1]), at)
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[alive[at] & (ids[at] == a)]
            at = at[after[at] >= 0]
            at = at[ids[after[at]] == b]
            if a == b and len(at) > 1:  # overlapping pairs: every second one of a run, from its left end
                runs = np.concatenate([[True], after[at[:-1]] != at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(runs, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = new
            alive[gone] = False
            then = after[gone]
            after[at] = then
            inside = then >= 0
            before[then[inside]] = at[inside]
            ahead = before[at]
            behind = ahead >= 0
            starts = np.concatenate([ahead[behind], at[inside]])
            if len(starts):
                starts = distinct(starts)
                note(self.rank_of(ids[starts], ids[after[starts]]), starts)
        stay = np.flatnonzero(alive)
        return ids[stay], stay

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not known yet: their distinct words all together."""
        whole, mixed = [], []
        for c in chunks:
            # the library has parted what holds an unsettled letter
            (whole if c.isalpha() or not c.isascii() and self.unsettled.search(c) else mixed).append(c)
        parts = list(map(self.word.findall, mixed))
        words = list({*whole, *(w for ws in parts for w in ws)})
        if not words:
            return
        coded = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        flat = np.frombuffer(b"".join(coded), np.uint8)
        last = np.zeros(len(flat), bool)
        last[ends - 1] = True
        ids, stay = self.merged(np.where(last, self.final[flat], self.inner[flat]), last)
        cuts = (4 * np.searchsorted(stay, ends)).tolist()
        raw = ids.astype("<u4").tobytes()
        ids_of = {w: raw[lo:hi] for w, lo, hi in zip(words, [0, *cuts], cuts, strict=False)}
        for c in whole:
            self.known[c] = ids_of[c]
        for c, ws in zip(mixed, parts, strict=True):
            self.known[c] = b"".join([ids_of[w] for w in ws])

    def chunks(self, text: str) -> list[str]:
        """Parts between white space, composed and in lower case; a special token is given as itself."""
        if self.special is None or not self.special.search(text):
            return self.parted(text)
        out: list[str] = []
        begin = 0
        for hit in self.special.finditer(text):
            out += [*self.parted(text[begin : hit.start()]), hit.group()]
            begin = hit.end()
        return out + self.parted(text[begin:])

    def parted(self, text: str) -> list[str]:
        if text.isascii() or not self.unsettled.search(text):
            text = plain(text)
            return self.word.findall(text) if SEPARATORS.search(text) else text.split()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        split = [self.chunks(t) for t in texts]
        if len(self.known) > self.known_words:
            self.known.clear()
        for token, i in self.specials.items():
            self.known[token] = np.array([i], "<u4").tobytes()
        fresh: set[str] = set()
        for chunks in split:
            fresh.update(chunks)
        fresh.difference_update(self.known)
        self.learn(list(fresh))
        found = self.known.__getitem__
        return [np.frombuffer(b"".join(map(found, chunks)), "<u4") for chunks in split]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, for the vocabulary names no decoder; ids beyond it say nothing."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist() if i < len(tokens) and tokens[i]])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def plain(text: str) -> str:
    """Composed and in lower case, letter by letter: a final sigma is no exception. White space only parts words."""
    if not text.isascii():
        import unicodedata

        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(c.lower() for c in text)
    return text.lower()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def shared_spec(df: DataFrame, path: str | None):
    """The vocabulary file, read once on the driver and sent to the executors: its size does not depend on the data."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with its token ids as ``ids`` (array<int>); a column of that name is replaced."""
    spec, kept = shared_spec(df, path), [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for block in text_blocks(batches, text):
            found = codec.encode(strings(block.column(text)))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in kept), pa.ListArray.from_arrays(offsets, flat)], names=[*kept, ids])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    schema = StructType([df.schema[c] for c in kept]).add(ids, ArrayType(IntegerType()))
    return df.select(kept).mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids`` as ``text``; null ids give an empty text, an unknown id gives nothing."""
    spec, kept = shared_spec(df, path), [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for batch in batches:
            told = [codec.decode(np.array([i for i in x or [] if i is not None and i >= 0], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(told, pa.string())], names=[*kept, text])

    from pyspark.sql.types import StringType, StructType

    schema = StructType([df.schema[c] for c in kept]).add(text, StringType())
    return df.select(kept).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``key, n_tokens, ids_sha256, decoded_sha256``."""
    spec = shared_spec(df, path)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(spec.value)
        for block in text_blocks(batches, text):
            found = codec.encode(strings(block.column(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(key),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found], pa.string()),
                ],
                names=["key", "n", "ids", "decoded"],
            )

    out = df.select(key, text).mapInArrow(run, f"key {key_type}, n long, ids string, decoded string")
    return out.toDF(key, "n_tokens", "ids_sha256", "decoded_sha256")
