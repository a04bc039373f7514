"""BPE encoding and decoding with word-end vocabularies, in batched numpy merge rounds.

The words of a batch that were not met before lie end to end in one flat array of
symbols.  In each round every word merges its leftmost pair of lowest rank: pairs are
single integers, looked up by binary search in the sorted array of all mergeable
pairs, and only the pairs beside a merge are looked up again.  Words longer than
``LONG`` symbols have arrays of their own, and in each round merge all places of their
pair of lowest rank, from left to right; no pair that this makes comes before it in rank.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LONG = 128
#: Words kept with their ids by a task before it starts over: bounds its memory.
KEEP_WORDS = 300_000
#: Words of one run of merge rounds; with LONG it keeps a run under 2^22 symbols.
BATCH_WORDS = 30_000
NO_RANK = np.int64(1) << 40


@dataclass
class BpeModel:
    """A word-end BPE vocabulary as arrays."""

    keys: np.ndarray  # left id * 2^32 + right id, sorted
    ranks: np.ndarray
    merged: np.ndarray
    first: np.ndarray  # id of each byte within a word
    last: np.ndarray  # id of each byte at the end of a word
    tokens: list[str]
    special: dict[str, int]
    pattern: str

    @classmethod
    def from_file(cls, path: str) -> BpeModel:
        """Read a tokenizer file (JSON) whose model is BPE with an end-of-word suffix.

        Supported: NFC, white space collapsed, lower case; a removed-unless-matched
        split pattern; byte-level symbols; no post-processor and no decoder.
        """
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a lower-case word-end BPE file")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = []
        for rank, (a, b) in enumerate(model["merges"]):
            pairs.append(((vocab[a] << 32) | vocab[b], rank, vocab[a + b]))
        keys, ranks, merged = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        symbols = byte_symbols()
        tokens = [""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for t, i in vocab.items():
            tokens[i] = t
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for t, i in special.items():
            tokens[i] = t
        return cls(
            keys, ranks, merged,
            np.array([vocab[c] for c in symbols], np.int64), np.array([vocab[c + suffix] for c in symbols], np.int64),
            tokens, special, split["pattern"]["Regex"],
        )

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.merged[at]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (none of them empty)."""
        out: list[list[int]] = [[]] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._encode_long(w)
            else:
                short.append(i)
        if short:
            flat, ends = self._rounds([words[i] for i in short])
            listed, at = flat.tolist(), 0
            for i, to in zip(short, ends.tolist(), strict=True):
                out[i] = listed[at:to]
                at = to
        return out

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and where each word ends (under 2^22 symbols in all)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        n_out = lengths.copy()
        done_ids, done_word = [], []
        # rank[i]: of the pair (i, i + 1); a word's last symbol has none.
        rank, into = self._pairs(ids, word)
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat((rank << 22) | np.arange(len(ids)), starts)
            live = (best >> 22) < NO_RANK
            at = best[live] & ((1 << 22) - 1)
            if not live.all():
                sizes = np.diff(np.r_[starts, len(ids)])
                still = np.repeat(live, sizes)
                done_ids.append(ids[~still])
                done_word.append(word[~still])
                move = np.cumsum(still) - 1
                ids, word, rank, into = ids[still], word[still], rank[still], into[still]
                at = move[at]
            if not len(at):
                break
            n_out[word[at]] -= 1
            ids[at] = into[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            ids, word, rank, into = ids[keep], word[keep], rank[keep], into[keep]
            near = np.concatenate([place, place[place > 0] - 1])
            rank[near], into[near] = self._pairs(ids, word, near)
        flat = np.concatenate(done_ids) if done_ids else ids
        order = np.argsort(np.concatenate(done_word), kind="stable") if done_word else np.zeros(0, np.int64)
        return flat[order], np.cumsum(n_out)

    def _pairs(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if at is None:
            at = np.arange(len(ids))
        rank, into = np.full(len(at), NO_RANK), np.zeros(len(at), np.int64)
        if len(ids) > 1:
            right = np.minimum(at + 1, len(ids) - 1)
            pair = (at + 1 < len(ids)) & (word[at] == word[right])
            rank[pair], into[pair] = self.rank_of(ids[at[pair]], ids[right[pair]])
        return rank, into

    @functools.cached_property
    def in_order(self) -> bool:
        """Whether every merge that takes a token ranks behind all that make it, as in any trained vocabulary."""
        made = np.full(len(self.tokens), -1)
        np.maximum.at(made, self.merged, self.ranks)
        return bool((self.ranks > np.maximum(made[self.keys >> 32], made[self.keys & 0xFFFFFFFF])).all())

    def _encode_long(self, word: bytes) -> list[int]:
        data = np.frombuffer(word, np.uint8)
        ids = self.first[data]
        ids[-1] = self.last[data[-1]]
        one = np.zeros(len(ids), np.int64)  # all of one word
        rank, into = self._pairs(ids, one)
        while len(ids) > 1 and (least := rank.min()) < NO_RANK:
            at = np.flatnonzero(rank == least)
            if self.in_order:
                # Places of one pair overlap only in runs of one symbol, where every other one merges.
                n = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], n, 0))
                at = at[(n - run) % 2 == 0]
            else:
                at = at[:1]
            ids[at] = into[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            ids, rank, into = ids[keep], rank[keep], into[keep]
            near = np.unique(np.concatenate([place, place[place > 0] - 1]))
            rank[near], into[near] = self._pairs(ids, one[: len(ids)], near)
        return ids.tolist()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, other = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], other = chr(other), other + 1
    return [out[b] for b in range(256)]


class BpeCodec:
    """Whole texts to ids and back, remembering the chunks between white space."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.pieces = regex.compile(model.pattern)
        self.white = regex.compile(r"\s+")
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(model.special, key=len, reverse=True))) if model.special else None
        self.id_text = [str(i) for i in range(len(model.tokens))]
        self.words: dict[str, tuple[str, str]] = {}
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space and around special tokens; no token spans a cut."""
        if self.special is None or not any(x in text for x in self.model.special):
            return self._white(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self._white(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._white(text[at:])

    def _white(self, text: str) -> list[str]:
        # str.split also cuts at \x1c-\x1f, which the pattern's \s does not match.
        if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.white.split(text) if x]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not remembered."""
        special, known, found = self.model.special, self.words, {}
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                found[chunk] = chunk.lower()
            elif chunk not in special:
                # Each character is lowered by itself: a final sigma stays a plain one.
                plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
                found[chunk] = self.pieces.findall(plain)
        new = {w for x in found.values() for w in ([x] if isinstance(x, str) else x)} - known.keys()
        listed, id_text, tokens = list(new), self.id_text, self.model.tokens
        for at in range(0, len(listed), BATCH_WORDS):
            some = listed[at : at + BATCH_WORDS]
            for w, ids in zip(some, self.model.encode_words([x.encode() for x in some]), strict=True):
                known[w] = " ".join([id_text[i] for i in ids]), " ".join([tokens[i] for i in ids])
        for chunk, x in found.items():
            if isinstance(x, str):
                self.ids[chunk], self.text[chunk] = known[x]
            else:
                pairs = [known[w] for w in x]
                self.ids[chunk] = " ".join([p[0] for p in pairs])
                self.text[chunk] = " ".join([p[1] for p in pairs])
        for chunk in chunks & special.keys():
            self.ids[chunk], self.text[chunk] = id_text[special[chunk]], chunk

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, decimal ids joined by a space, decoded text."""
        cut = [self.chunks(t) for t in texts]
        new = set().union(*cut) - self.ids.keys()
        if len(self.ids) + len(new) > KEEP_WORDS and self.ids:
            for kept in (self.ids, self.text, self.words):
                kept.clear()
            new = set().union(*cut)
        self.learn(new)
        for chunks in cut:
            # A chunk can hold no token at all (none does under the usual pattern).
            ids = " ".join(filter(None, map(self.ids.__getitem__, chunks)))
            yield ids.count(" ") + bool(ids), ids, " ".join(filter(None, map(self.text.__getitem__, chunks)))


def decode(ids: list[int], model: BpeModel) -> str:
    """The token strings of ``ids`` joined by a space, as a file without a decoder has it."""
    return " ".join(model.tokens[i] for i in ids if 0 <= i < len(model.tokens))


def words_of(decoded: str, suffix: str = "</w>") -> str:
    """The words behind a decoded text: token strings joined within words, bytes restored."""
    value = {c: b for b, c in enumerate(byte_symbols())}
    out = []
    for word in "".join(decoded.split(" ")).split(suffix):
        if word:
            out.append(bytes(value[c] for c in word).decode("utf-8", "replace"))
    return " ".join(out)


def encode_documents(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """Encode and decode every whole text with the tokenizer file at ``path`` (read on the driver).

    Returns doc_id, n_tokens and either ids (array of int) and decoded (string), or
    with ``digests`` their SHA-256: ids_sha256 (of the decimal ids joined by one space)
    and decoded_sha256 (of the decoded text), both lowercase hex.  Columns named in
    ``carried`` come along.

    Defined cases: a null text is the empty text (no ids, decoded ''); null or repeated
    doc_ids give a row each; special token strings in a text become their ids; other
    columns are ignored; an empty table gives an empty result.
    """
    # The vocabulary is a few MB whatever the input is.
    shared = docs.sparkSession.sparkContext.broadcast(BpeModel.from_file(path))
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and size < 1 << 21:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                counts, left, right = [], [], []
                for n, a, b in codec.encode(some):
                    counts.append(n)
                    if digests:
                        left.append(hashlib.sha256(a.encode()).hexdigest())
                        right.append(hashlib.sha256(b.encode()).hexdigest())
                    else:
                        left.append([int(x) for x in a.split(" ")] if a else [])
                        right.append(b)
                kinds = [pa.string()] * 2 if digests else [pa.list_(pa.int32()), pa.string()]
                rest = [c.slice(at, len(some)) for c in batch.columns[2:]]
                columns = [ids.slice(at, len(some)), pa.array(counts, pa.int64()), pa.array(left, kinds[0]), pa.array(right, kinds[1]), *rest]
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(some)

    carried = carried or []
    names = ["doc_id", "n_tokens", *(x.split()[0] for x in tail.split(", ")), *carried]
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text", *[f"`{c}`" for c in carried])
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {tail}{kinds}")
