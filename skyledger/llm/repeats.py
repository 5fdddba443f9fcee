"""Substring dedup by hashing lines and the sentences in them.

Units are normalised (A-Z as a-z, white-space runs as one space), their digests
are grouped over all documents, the earliest ranked occurrence stays, and runs
of later occurrences go, with their offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.bloom import key_filter, passing
from skyledger.llm.text import find_words, hash_spans, mix, signed, slices, utf8
from skyledger.session import stored

#: Words of a run, and of a whole line that goes alone.
LEAST_RUN, LEAST_LINE = 25, 5
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STOP = np.frombuffer(b".!?", np.uint8)


def units(texts: pa.Array) -> dict[str, np.ndarray]:
    """Every unit of every text: its text's place, number in the text, first and last word's bytes, words, 128-bit digest,
    and whether it opens a line.

    A unit ends at a line's end or after a word that ends in ``.``, ``!`` or ``?``.
    """
    data, at = utf8(texts)
    starts, ends, splits = find_words(data, at)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "number", "begin", "end", "words", "d1", "d2", "opens")}
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(n, bool)
    opens[1:] = lines[starts[1:]] > lines[ends[:-1]]
    opens[splits[:-1][np.diff(splits) > 0]] = True
    fresh = opens.copy()
    fresh[1:] |= np.isin(data[ends[:-1] - 1], _STOP)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n) - 1
    text = np.searchsorted(splits, first, "right") - 1
    words = hash_spans(data, starts, ends)
    place = (np.arange(n) - np.repeat(first, last - first + 1)).astype(np.uint64)
    digest = [signed(mix(np.add.reduceat(mix(words + (place + np.uint64(1)) * step), first))) for step in _STEP]
    own = np.arange(len(first)) - np.searchsorted(text, text)
    return {"text": text, "number": own, "begin": starts[first] - at[text], "end": ends[last] - at[text], "words": last - first + 1, "d1": digest[0], "d2": digest[1], "opens": opens[first]}


def _with_lines(found: dict[str, np.ndarray], least_run: int, least_line: int | None) -> dict[str, np.ndarray]:
    """The units, and after them the lines of ``least_line`` words or more that are too short for a run: text, number (of
    the first unit), last (unit's number), line, words, digest. Digests of lines differ from those of units."""
    columns = {c: found[c] for c in ("text", "number", "words", "d1", "d2")} | {"last": found["number"], "line": np.zeros(len(found["number"]), bool)}
    if least_line is None or not len(found["number"]):
        return columns
    first = np.flatnonzero(found["opens"])
    size = np.diff(np.append(first, len(found["opens"])))
    words = np.add.reduceat(found["words"], first)
    keep = np.flatnonzero((words >= least_line) & (words < least_run))
    place = (np.arange(len(found["opens"])) - np.repeat(first, size)).astype(np.uint64)
    digest = [signed(mix(np.add.reduceat(mix(found[d].view(np.uint64) + (place + np.uint64(1)) * step), first))) for d, step in zip(("d1", "d2"), _STEP)]
    number = found["number"][first]
    lines = {"text": found["text"][first], "number": number, "last": number + size - 1, "line": np.ones(len(first), bool), "words": words, "d1": digest[0], "d2": digest[1]}
    return {c: np.concatenate([x, lines[c][keep]]) for c, x in columns.items()}


_UNITS = "doc_id long, _row long, number int, last int, line boolean, words int, d1 long, d2 long"


def _repeated_units(docs: DataFrame, least_run: int, least_line: int | None) -> DataFrame:
    """All units and short lines whose digest repeats, and perhaps a few that pass the filter for nothing."""

    def digest_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digest, n = np.unique(_with_lines(units(part.column("text")), least_run, least_line)["d1"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), pa.array(n, pa.int64())], ["d1", "n"])

    counts = docs.select("text").mapInArrow(digest_counts, "d1 long, n long").groupBy("d1").agg(F.sum("n").alias("n"))
    repeated = key_filter(counts.where("n > 1"), "d1")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = _with_lines(units(part.column("text")), least_run, least_line)
            keep = np.flatnonzero(passing(repeated.value, found["d1"]))
            at = pa.array(found["text"][keep])
            own = [part.column(c).take(at) for c in ("doc_id", "_row")]
            kinds = {"number": pa.int32(), "last": pa.int32(), "line": pa.bool_(), "words": pa.int32(), "d1": pa.int64(), "d2": pa.int64()}
            rest = [pa.array(found[c][keep], kind) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*own, *rest], ["doc_id", "_row", *kinds])

    return stored(_keyed(docs).mapInArrow(rows, _UNITS), "units")


def repeated_runs(docs: DataFrame, least_run: int = LEAST_RUN, least_line: int | None = None) -> DataFrame:
    """Runs of neighbouring units that occurred before: doc_id, begin, end, words, n_units, first_doc_id, one row a run.

    Occurrences rank by doc_id (null last), then by place in the text. Rows equal
    in id and text count as one and have the same runs. ``begin`` and ``end`` count code points of the
    original text, ``first_doc_id`` holds the earliest occurrence of the run's
    first unit. A run has ``least_run`` words or more: single stock phrases stay.
    With ``least_line`` a whole line of that many words that occurred before as a
    whole line goes too, wherever it stands; neighbouring ones are one row.
    A repeat inside one document counts like any other. Documents without a run
    have no row; null and empty texts have no units; an empty table gives an
    empty result; other columns are ignored.

    Digests are counted before they are shuffled, so a unit that a third of all
    documents hold sends one row a task. Only units that repeat are read out in
    full; they meet their group on a side that adaptive execution may split.
    """
    return _placed(docs, least_run, least_line).select("doc_id", "begin", "end", "words", "n_units", "first_doc_id")


def _runs(docs: DataFrame, least_run: int, least_line: int | None) -> DataFrame:
    """Runs by first and last unit number: _key (of the row), number, last, words, n_units, first_doc_id."""
    rows = _repeated_units(docs, least_run, least_line)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "number")).alias("first")
    groups = rows.groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", "first")
    # written, so that the join deals out both sides itself and adaptive execution may split a frequent unit
    groups = stored(groups, "groups")
    later = (
        rows.join(groups, ["d1", "d2"])
        .where((F.col("_row") != F.col("first._row")) | (F.col("number") != F.col("first.number")))
        .select("_row", "number", "last", "line", "words", F.col("first.doc_id").alias("first_doc_id"))
    )
    # the units of a later line are later units: its row only marks them
    of_line = [F.when(~F.col("line"), F.col(c)).alias(c) for c in ("words", "first_doc_id")]
    marked = later.select("_row", F.explode(F.sequence("number", "last")).alias("number"), *of_line, "line")
    marked = marked.groupBy("_row", "number").agg(F.max("words").alias("words"), F.max("first_doc_id").alias("first_doc_id"), F.max("line").alias("line"))
    own, island = Window.partitionBy("_row").orderBy("number"), Window.partitionBy("_row", "island")
    place = F.col("number") - F.row_number().over(own)
    kept = marked.withColumn("island", place).withColumn("all", F.sum("words").over(island)).where((F.col("all") >= least_run) | F.col("line"))
    runs = kept.withColumn("island", place).groupBy("_row", "island").agg(
        F.min("number").alias("number"),
        F.max("number").alias("last"),
        F.sum("words").alias("words"),
        F.count(F.lit(1)).cast("int").alias("n_units"),
        F.min_by("first_doc_id", "number").alias("first_doc_id"),
    )
    return runs.drop("island")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal id and text share ``_row``: they have the same runs."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))


def _placed(docs: DataFrame, least_run: int, least_line: int | None) -> DataFrame:
    """Runs with their offsets, found again in the texts that have any."""
    runs = _runs(docs, least_run, least_line)
    holders = key_filter(runs, "_row")
    listed = runs.groupBy("_row").agg(F.collect_list(F.struct("number", "last", "words", "n_units", "first_doc_id")).alias("runs"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = units(part.column("text"))
            where = np.searchsorted(found["text"], np.arange(part.num_rows))
            out = []
            for k, (doc_id, key, text, own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "_row", "text", "runs")))):
                raw = (text or "").encode()
                for run in sorted(own, key=lambda r: r["number"]):
                    begin, end = found["begin"][where[k] + run["number"]], found["end"][where[k] + run["last"]]
                    head = len(raw[:begin].decode())
                    out.append((doc_id, key, head, head + len(raw[begin:end].decode()), run["words"], run["n_units"], run["first_doc_id"]))
            columns = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "_row", "begin", "end", "words", "n_units", "first_doc_id"])

    @F.pandas_udf("boolean")
    def holds(row: pd.Series) -> pd.Series:
        return pd.Series(passing(holders.value, row.to_numpy()))

    joined = _keyed(docs).where(holds("_row")).join(listed, "_row")
    return joined.select("doc_id", "_row", "text", "runs").mapInArrow(place, "doc_id long, _row long, begin long, end long, words long, n_units int, first_doc_id long")


def without_repeats(docs: DataFrame, least_run: int = LEAST_RUN, least_line: int | None = None) -> DataFrame:
    """``docs`` as doc_id, text with the repeated runs cut out, removed: the cut spans in the original text.

    Rows as in ``docs``; cases as in ``repeated_runs``. A null text stays null.
    """
    runs = _placed(docs, least_run, least_line).select("_row", "begin", "end").distinct().groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("removed"))
    joined = _keyed(docs).join(runs, "_row", "left")
    spans = F.coalesce("removed", F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["begin"] - a["at"]).cast("int"))).alias("text"), s["end"].alias("at")
        ),
        lambda a: F.concat(a["text"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))),
    )
    return joined.select("doc_id", cut.alias("text"), spans.alias("removed"))
