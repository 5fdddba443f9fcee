"""Byte-level BPE through tables of distinct words.

Spark splits texts into words. The most frequent words, a table of fixed size,
are encoded once and broadcast; where a text is read they become numbers. All
other words are shuffled by word, so that each distinct one is encoded once, and
their ids return by document and position to the numbered texts. Decoding looks
ids up in the id-to-piece table, which has one row an id of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import most_frequent
from skyledger.llm.text import released
from skyledger.session import stored

#: The published split pattern of the byte-level vocabulary, with Unicode classes; fixed value.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COMMON = 1 << 19
LONGEST = 64
#: Words that a task counts before it forgets those seen once.
COUNTED = 500_000
ROWS = 2048
SHARES = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_words(text: Column, specials: list[str]) -> Column:
    """The words of a text in order, as an array; special tokens are words of their own. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = lambda part: F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))
    if not specials:
        return words(text)
    (special,) = specials
    parts = F.split(text, "\\Q" + special + "\\E", -1)
    joined = F.transform(parts, lambda p, k: F.when(k == 0, words(p)).otherwise(F.concat(F.array(F.lit(special)), words(p))))
    return F.when(F.contains(text, F.lit(special)), F.flatten(joined)).otherwise(words(text))


def _encoder(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def _specials(model: str) -> list[str]:
    return [x["content"] for x in json.loads(model)["added_tokens"]]


def common_words(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` frequent words of ``words`` (an array column of that name), none longer than ``LONGEST``.

    Lossy counting: a task forgets words that it has seen once when it holds too
    many, and at its end. What is forgotten is only handled as a rare word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in released(batches):
            for lo in range(0, batch.num_rows, ROWS):
                found = pc.value_counts(batch.column("words").slice(lo, ROWS).flatten())
                for word, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                    seen[word] += n
                if len(seen) > COUNTED:
                    seen = Counter({w: n for w, n in seen.items() if n > 1})
        kept = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counted = words.select("words").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return most_frequent(stored(counted, "words"), most)


def _encoded(model: str, rest: str):
    """Adds ``ids`` (unsigned 32-bit little-endian numbers, one after the other) to rows with a ``word``; a word that
    follows itself isn't encoded again."""
    names = [x.split()[0] for x in rest.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _encoder(model)
        last = ids = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                words = part.column("word").to_pylist()
                fresh = [w for k, w in enumerate(words) if w != (words[k - 1] if k else last)]
                made = iter(tokenizer.encode_batch(fresh, add_special_tokens=False))
                out = []
                for word in words:
                    if word != last:
                        last, ids = word, np.array(next(made).ids, "<u4").tobytes()
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.binary())], [*names, "ids"])

    return encode


def piece_bytes(model: str) -> list[bytes]:
    """The bytes of every id: the published byte-level alphabet, undone."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    rows = json.loads(model)
    pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in rows["model"]["vocab"].items()}
    pieces |= {x["id"]: x["content"].encode() for x in rows["added_tokens"]}
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class _Lists:
    """Byte strings end to end, to be gathered by number."""

    def __init__(self, items: list[bytes], kind: str):
        self.flat = np.frombuffer(b"".join(items), kind)
        size = np.fromiter(map(len, items), np.int64, len(items)) // np.dtype(kind).itemsize
        self.end = np.cumsum(size)
        self.begin = self.end - size

    @classmethod
    def of(cls, column: pa.BinaryArray, kind: str) -> _Lists:
        """The items of an Arrow column of byte strings."""
        lists = cls([], kind)
        if len(column):
            at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
            raw = np.frombuffer(column.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
            lists.flat = np.frombuffer(raw[at[0] : at[-1]].tobytes(), kind)
            at = (at - at[0]) // np.dtype(kind).itemsize
            lists.begin, lists.end = at[:-1], at[1:]
        return lists

    def gather(self, which: np.ndarray) -> np.ndarray:
        """The numbered items end to end."""
        begin = self.begin[which]
        size = self.end[which] - begin
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.flat[np.arange(total) + np.repeat(begin - (stop - size), size)]

    def extended(self, more: _Lists) -> _Lists:
        """These items, then ``more``."""
        both = _Lists([], self.flat.dtype)
        both.flat = np.concatenate([self.flat, more.flat])
        both.begin = np.concatenate([self.begin, more.begin + len(self.flat)])
        both.end = np.concatenate([self.end, more.end + len(self.flat)])
        return both


def _digests(ids: np.ndarray, pieces: _Lists) -> tuple[int, str, str]:
    raw = pieces.gather(ids).tobytes()
    shown = raw.decode("utf-8", "replace").encode()
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(shown).hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str | None = None, common: int = COMMON, ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids (array) and text.

    Ids are those of the tokenizers library without added special tokens,
    truncation or padding; strings of special tokens in a text become their ids.
    The decoded text keeps special tokens. Null texts are empty: no ids, the
    digests of nothing. Repeated rows repeat; an empty table gives an empty
    result; other columns are ignored. ``tokenizer`` is a file the driver can read.

    ``common`` bounds the broadcast: so many words, none longer than 64
    characters. A text is shuffled once, as the numbers of its common words, and
    its rare words twice.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        model = file.read()
    context = docs.sparkSession.sparkContext
    keyed = docs.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("k"),
        F.hash("text", "doc_id").alias("k2"),
        split_words(F.col("text"), _specials(model)).alias("words"),
    )
    table = common_words(keyed, common).mapInArrow(_encoded(model, "word string, n long"), "word string, n long, ids binary")
    rows = table.toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # at most ``common``
    columns = [pa.concat_arrays([pa.array([], k), *rows.column(c).cast(k).chunks]) for c, k in (("word", pa.string()), ("ids", pa.binary()))]
    # as arrays, not as lists of objects: every worker holds them
    known = context.broadcast((columns[0], _Lists.of(columns[1], "<u4")))
    pieces = context.broadcast(_Lists(piece_bytes(model), "u1"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
        """Batches, their words end to end, the words' numbers (rare ones: ``len(known)``), and each text's part."""
        words = known.value[0]
        for batch in released(batches):
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                flat = part.column("words").flatten()
                size = pc.list_value_length(part.column("words")).to_numpy(zero_copy_only=False)
                number = pc.fill_null(pc.index_in(flat, value_set=words), len(words)).to_numpy(zero_copy_only=False)
                yield part, flat, number, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, number, splits in numbered(batches):
            packed = [zlib.compress(number[a:b].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), 5) for a, b in zip(splits[:-1], splits[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k", "k2")), pa.array(packed, pa.binary())], ["doc_id", "k", "k2", "codes"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, number, splits in numbered(batches):
            place = np.flatnonzero(number == len(known.value[0]))
            text = np.searchsorted(splits, place, "right") - 1
            own = [part.column(c).take(pa.array(text)) for c in ("k", "k2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array((place - splits[text]).astype(np.int32)), flat.take(pa.array(place))], ["k", "k2", "at", "word"])

    wanted = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, byte_lists = known.value[1], pieces.value
        for batch in released(batches):
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                own, numbers, used = [], [], len(base.end)
                for codes, k2, found in zip(*(part.column(c).to_pylist() for c in ("codes", "k2", "found"))):
                    planes = np.frombuffer(zlib.decompress(codes), np.uint8).reshape(3, -1).astype(np.int64)
                    number = planes[0] | planes[1] << 8 | planes[2] << 16
                    holes = np.flatnonzero(number == len(base.end))
                    at = {x["at"]: x["ids"] for x in found or [] if x["k2"] == k2}
                    own += [at[h] for h in holes.tolist()]
                    number[holes] = used + np.arange(len(holes))
                    used += len(holes)
                    numbers.append(number)
                both = base.extended(_Lists(own, "<u4"))
                lists = [both.gather(x) for x in numbers]
                out = [_digests(x, byte_lists) for x in lists]
                columns = [part.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.string()) for k in (1, 2))]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32())))
                    columns.append(pa.array([byte_lists.gather(x).tobytes().decode("utf-8", "replace") for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in wanted.split(", ")])

    numbers = keyed.mapInArrow(coded, "doc_id long, k long, k2 int, codes binary")
    words = keyed.select("k", "k2", "words").mapInArrow(rare, "k long, k2 int, at int, word string")
    # a word too long for the table may still be frequent: its rows are dealt out, and it is encoded for each share
    share = F.when(F.length("word") > LONGEST, F.pmod("k", F.lit(SHARES))).otherwise(F.lit(0))
    back = words.repartition("word", share).sortWithinPartitions("word").mapInArrow(_encoded(model, "k long, k2 int, at int"), "k long, k2 int, at int, ids binary")
    found = back.groupBy("k").agg(F.collect_list(F.struct("k2", "at", "ids")).alias("found"))
    return numbers.join(found, "k", "left").select("doc_id", "k2", "codes", "found").mapInArrow(filled, wanted)
