"""Operator 8: byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is just one last token that its encoding can
have. The tokens that end a prefix are found by an automaton over the
vocabulary; a token t is the last one of prefix p if the prefix before t is
encoded, and its own last token can stand before t. Following the stored tokens
back from the end gives the ids, without merging anything.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ready, spans

# Fixed values of the byte-level pre-tokenizer: its pattern, and the bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Entries of a worker's table of fragments; beyond, those of the generation before are dropped.
KEEP = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    others = [b for b in range(256) if b not in set(PRINTED)]
    letters = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


def _check(read: dict) -> None:
    """Raises ValueError where a tokenizer file asks for what PrefixEncoder doesn't do, rather than encode otherwise than the library."""
    model, before, after = read["model"], read.get("pre_tokenizer") or {}, read.get("decoder") or {}
    asked = {name: model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    asked["model"] = model.get("type") != "BPE"
    asked["normalizer"] = read.get("normalizer")
    asked["pre_tokenizer"] = before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
    asked["decoder"] = after.get("type") != "ByteLevel"
    asked["added_tokens"] = any(x.get(k) for x in read["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    asked["vocab without all bytes"] = any(x not in model["vocab"] for x in _byte_letters())
    if wrong := [name for name, x in asked.items() if x]:
        raise ValueError(f"unsupported in a byte-level BPE file: {', '.join(wrong)}")


class PrefixEncoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library; files that ask for more than that are refused."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            read = json.load(f)
        _check(read)
        vocabulary = read["model"]["vocab"]
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        spell = {token: bytes(byte_of[c] for c in token) for token in vocabulary}
        #: The bytes of each id.
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *(x["id"] for x in read["added_tokens"])]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = spell[token]
        self.special = {x["content"]: x["id"] for x in read["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self._specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._pieces = regex.compile(PATTERN)
        #: Of a pair of ids: the place of its merge in the list, and what it makes.
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(read["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, made = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self._rank[pair] = rank
            self._parts.setdefault(made, (rank, *pair))
        self._match = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            # A token that no merges make can't come out of an encoding.
            if len(spell[token]) == 1 or i in self._parts:
                self._match.add_word(spell[token].decode("latin-1"), (i, len(spell[token])))
        self._match.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._whole: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(token, rank of the merge that takes it in) along one edge of the token's tree of merges, from the top."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self._parts:
                return out
            until = self._parts[token][0]
            token = self._parts[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a and b can stand side by side: no merge across their border comes before those that make them.

        Going back in time, the right edge of a's tree and the left edge of b's
        are taken apart, the later merge first. A merge of what meets at the
        border wins if it precedes the merges which take both sides in; on equal
        rank the leftmost place wins, which is a's own merge or else the border's.
        """
        if (known := self._fits.get((a, b))) is not None:
            return known
        left, right, i, j, good = self._spine(a, 2), self._spine(b, 1), 0, 0, True
        while i < len(left) and j < len(right):
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self._rank.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until:
                good = False
                break
            x_from = left[i + 1][1] if i + 1 < len(left) else -1
            y_from = right[j + 1][1] if j + 1 < len(right) else -1
            # of the two, the later made is taken apart; of equal merges the right one was made later
            if x_from > y_from:
                i += 1
            else:
                j += 1
        if len(self._fits) > 4 * KEEP:
            self._fits.clear()
        self._fits[a, b] = good
        return good

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one piece, by the last token of each prefix."""
        n = len(raw)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        known, fits = self._fits, self.fits
        for end, (token, length) in self._match.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                good = known.get((before, token))
                if not (fits(before, token) if good is None else good):
                    continue
            last[end], back[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _plain(self, text: str) -> bytes:
        """The ids, 4 bytes each, of a text without special tokens."""
        out, whole = [], self._whole
        for piece in self._pieces.findall(text):
            got = whole.get(piece)
            if got is None:
                got = array("I", self.piece(piece.encode())).tobytes()
                if len(piece) <= 64:
                    if len(whole) > KEEP:
                        whole.clear()
                    whole[piece] = got
            out.append(got)
        return b"".join(out)

    def _fragment(self, fragment: str) -> bytes:
        """The ids of a space and what follows it up to the next space."""
        got = self._older.get(fragment)
        if got is None:
            got = self._plain(" " + fragment)
        if len(fragment) <= 64:
            if len(self._known) > KEEP:
                self._older, self._known = self._known, {}
            self._known[fragment] = got
        return got

    def _ordinary(self, text: str) -> bytes:
        # A space before anything but white space always starts a piece, so a text is cut there.
        fragments = text.split(" ")
        if any(not x or x[0].isspace() or x[0] in "\x1c\x1d\x1e\x1f" for x in fragments[1:]):
            return self._plain(text)
        out = [self._plain(fragments[0])] if fragments[0] else []
        known = self._known
        for x in fragments[1:]:
            got = known.get(x)
            if got is None:
                got = self._fragment(x)
                known = self._known
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self._specials is None or not any(x in text for x in self.special):
            return np.frombuffer(self._ordinary(text), dtype=np.uint32)
        out = []
        for part in self._specials.split(text):
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
            elif part:
                out.append(self._ordinary(part))
        return np.frombuffer(b"".join(out), dtype=np.uint32)

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", errors="replace")


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(file: str) -> PrefixEncoder:
    """One encoder a worker process; it reads the file once."""
    if file not in _ENCODERS:
        _ENCODERS[file] = PrefixEncoder(file)
    return _ENCODERS[file]


def encode(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids array<int> of each text (null: empty, no ids)."""

    def run(batches):
        coder = encoder(file)
        for batch in batches:
            ids = [coder.encode(x or "").astype(np.int32) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id, text of each list of ids (null: empty)."""

    def run(batches):
        coder = encoder(file)
        for batch in batches:
            out = [coder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """A row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each whole text and decodes its ids in one pass over narrow tasks.
    A null text is empty: no tokens. Other columns are ignored.
    """

    def run(batches):
        coder = encoder(file)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            raw, offsets = spans(batch.column("text"))
            whole = raw.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                ids = coder.encode(whole[a:b].decode())
                listed = ids.tolist()
                counts.append(len(listed))
                ids_sha.append(hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(listed).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ready(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_file())
