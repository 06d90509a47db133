"""Byte-level BPE by backtracking, and decoding through an offset table.

A sequence of tokens is what merging would give exactly if each token alone and each two neighbours together are.  So the
encoder takes the longest token that an Aho-Corasick automaton finds at a place, asks a table whether it fits the token
before, else tries the next shorter one, and steps back when none is left.  Places that led nowhere are remembered, so
every place is left at most once.  Decoding gathers bytes from one blob of all tokens by their offsets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words

#: Pieces (of each of two generations) and pairs that one worker remembers, longest remembered piece, and characters after which a long text is cut.
PIECES, PAIRS, LONGEST, SEGMENT = 250_000, 500_000, 64, 1 << 18

# Fixed value: how byte-level vocabularies cut text into pieces, of letters, numbers, others and white space.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{others}+|\s+(?!\S)|\s+"


def newer_characters() -> list[tuple[str, str]]:
    """Ranges of letters and numbers that the tokenizers library is too old to know as such; it takes them as others."""
    from tokenizers.pre_tokenizers import ByteLevel

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    cut, ranges = ByteLevel(add_prefix_space=False).pre_tokenize_str, []
    for c in regex.findall(r"[\p{L}\p{N}]", every):
        if unicodedata.category(c) == "Cn" and len(cut("a" + c)) == len(cut(c + "1")) == 2:
            if ranges and ord(c) == ord(ranges[-1][1]) + 1:
                ranges[-1] = (ranges[-1][0], c)
            else:
                ranges.append((c, c))
    return ranges


def piece_pattern(new: str) -> regex.Pattern:
    """``PIECE`` with the characters ``new`` (ranges of a set) taken as others."""
    letters, numbers, others = (f"[\\p{{L}}--[{new}]]", f"[\\p{{N}}--[{new}]]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{new}]]") if new else (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")
    return regex.compile(("(?V1)" if new else "") + PIECE.replace("{letters}", letters).replace("{numbers}", numbers).replace("{others}", others))


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_spec(path: str) -> dict:
    """What encoding needs of a tokenizer file; refuses a file that asks for more than plain byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut, added = whole["model"], whole.get("pre_tokenizer") or {}, whole.get("added_tokens") or []
    asked = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    asked += [whole.get("normalizer"), cut.get("add_prefix_space")]
    asked += [a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")]
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or any(asked):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "added": {a["content"]: a["id"] for a in added}, "newer": newer_characters()}


class Codec:
    """Tables of one vocabulary; see the module for the method."""

    def __init__(self, spec: dict):
        alphabet, vocab = byte_alphabet(), spec["vocab"]
        spelled = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.merge = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(spec["merges"])}
        self.made = {vocab[a + b]: (rank, vocab[a], vocab[b]) for rank, (a, b) in enumerate(spec["merges"])}
        self.length = {i: len(b) for i, b in spelled.items()}
        by_bytes = {b: i for i, b in spelled.items()}
        #: The longest token that begins a token and is shorter.
        self.shorter = {i: next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), None) for i, b in spelled.items()}
        self.automaton = ahocorasick.Automaton()
        for i, b in spelled.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.fitting: dict[tuple[int | None, int], bool] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.four = {i: i.to_bytes(4, "little") for i in spelled}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        new = "".join(f"{a}-{b}" for a, b in spec["newer"])
        self.newer = re.compile(f"[{new}]").search if new else lambda _: None
        self.exact_cut, self.plain_cut = piece_pattern(new).findall, piece_pattern("").findall
        self.added = spec["added"]
        marks = sorted(self.added, key=lambda t: (-len(t), t))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        everything = spelled | {i: t.encode() for t, i in self.added.items()}
        size = max(everything, default=-1) + 1
        parts = [everything.get(i, b"") for i in range(size)]
        self.begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that takes it up) along one edge of a token, from its byte to the whole."""
        known = self.spines[side].get(token)
        if known is None:
            out, above, part = [], len(self.merge), token
            while part is not None:
                out.append((part, above))
                above, part = (self.made[part][0], self.made[part][1 + side]) if part in self.made else (0, None)
            known = self.spines[side][token] = out[::-1]
        return known

    def whole(self, left: int, right: int) -> bool:
        """Whether both are complete before a merge joins what stands at their border.

        Of equal ranks the left place merges first: inside the left token before the border, the border before the right one.
        """
        lefts, rights, i, j, never = self.spine(left, 1), self.spine(right, 0), 0, 0, len(self.merge)
        while True:
            (x, up), (y, down) = lefts[i], rights[j]
            if up == never and down == never:
                return True
            rank = self.merge.get((x, y), never)
            if rank < up and rank <= down:
                return False
            if up <= down:
                i += 1
            else:
                j += 1

    def fits(self, before: int | None, token: int) -> bool:
        """Whether merging keeps these two neighbours (or a first token) as they are; an entry of the pair table."""
        key = (before, token)
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) >= PAIRS:
                self.fitting.clear()
            if before is None:
                made = self.made.get(token)
                known = self.fits(None, made[1]) and self.fits(None, made[2]) and self.whole(made[1], made[2]) if made else self.length[token] == 1
            else:
                known = key not in self.merge and self.fits(None, token) and self.whole(before, token)
            self.fitting[key] = known
        return known

    def backtrack(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        size, length, shorter, fitting = len(piece), self.length, self.shorter, self.fitting
        longest: list[int | None] = [None] * (size + 1)
        for end, (n, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - n] = token  # later ends are longer
        ids: list[int] = []
        dead: set[int] = set()
        at, before, token = 0, None, longest[0]
        while at < size:
            while token is not None:
                if at + length[token] not in dead:
                    known = fitting.get((before, token))
                    if known or (known is None and self.fits(before, token)):
                        break
                token = shorter[token]
            if token is not None:
                ids.append(token)
                at += length[token]
                before, token = token, longest[at]
            else:
                dead.add(at)
                last = ids.pop()
                at -= length[last]
                before, token = ids[-1] if ids else None, shorter[last]
        return ids

    def piece_ids(self, piece: str) -> bytes:
        """A piece's ids as little-endian 32-bit numbers; short pieces are remembered, those not asked for lately go."""
        ids = self.pieces.get(piece) or self.older.get(piece)
        if ids is None:
            four = self.four
            ids = b"".join([four[i] for i in self.backtrack(piece.encode())])
        if len(piece) <= LONGEST:
            if len(self.pieces) >= PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def cut(self, text: str) -> list[str]:
        """A text's pieces; the pattern with the newer characters is slower and only asked if there are any."""
        return (self.plain_cut if text.isascii() or not self.newer(text) else self.exact_cut)(text)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit numbers."""
        new, out = self.piece_ids, []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            for segment in segments(part):
                known = self.pieces
                out.append(b"".join([known.get(p) or new(p) for p in self.cut(segment)]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a sequence of ids."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        begin = self.begin[numbers]
        size = self.begin[numbers + 1] - begin
        stop = np.cumsum(size)
        at = np.repeat(begin - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        return self.blob[at].tobytes()


_BREAK = regex.compile(r"\S(?=\s)")


def segments(text: str) -> Iterator[str]:
    """A text in runs of about ``SEGMENT`` characters, cut where a piece ends anyway: before white space after something else."""
    first = 0
    while len(text) - first > SEGMENT:
        found = _BREAK.search(text, first + SEGMENT)
        if not found:
            break
        yield text[first : found.end()]
        first = found.end()
    yield text[first:] if first else text


_codecs: dict[str, Codec] = {}


def _codec(sent) -> Codec:
    """The worker's tables for a broadcast vocabulary, made once."""
    key, spec = sent.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _send(spark: SparkSession, path: str):
    """Broadcast a vocabulary; its size is that of the tokenizer file, whatever the corpus."""
    spec = read_spec(path)
    return spark.sparkContext.broadcast((f"{path}:{hash(json.dumps(spec))}", spec))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every row: the tokens of the whole text as little-endian unsigned 32-bit numbers.

    ``path`` names a byte-level tokenizer file on the driver.  Null and empty texts have no ids; strings of added tokens
    become those tokens; repeated rows stay; rows without id are encoded; other columns are ignored.
    """
    sent, picked = _send(docs.sparkSession, path), docs.select("doc_id", "text")

    def run(batches):
        codec = _codec(sent)
        for rows, _, _ in words.blocks(batches):
            ids = [codec.encode(t or "") for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, text)``: the text of every row of ``tokens(doc_id, ids)``, added tokens spelled out.

    Ids that cut a character leave replacement characters; null ids give an empty text.  An id that the vocabulary does
    not have is an error.
    """
    sent, picked = _send(tokens.sparkSession, path), tokens.select("doc_id", "ids")

    def run(batches):
        codec = _codec(sent)
        for rows, _, _ in words.blocks(batches, "ids"):
            texts = [codec.decode(ids or b"").decode("utf-8", "replace") for ids in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of what ``encode`` and then ``decode`` give."""
    done = decode(encode(docs, path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
