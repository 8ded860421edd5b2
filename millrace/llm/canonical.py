"""Duplicates hidden by formatting differences: canonical form, 128-bit key, counted groups."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import CHUNK, salted_join
from millrace.session import cut, spread

#: All that is not part of a word or number: anything but letters, digits and marks, save a point between two digits and
#: a minus sign directly before a digit and not after a letter, digit or underscore.
_WORD = r"\p{L}\p{N}\p{M}"
NOT_CONTENT = (
    # each branch tests the character itself first, so most characters cost no look-around
    rf"(?:[^{_WORD}.\-−]|\.(?:(?<!\p{{Nd}}\.)|(?!\p{{Nd}}))"
    rf"|[\-−](?:(?<=[{_WORD}_][\-−])|(?!\p{{Nd}})))+"
)


def canonical_text(text: Column) -> Column:
    """The sequence of words and numbers of a text, in one spelling: lower case, single spaces.

    Case folds over upper case, so letters that become two (as in German) fold alike. Null stays null; a text without
    any word or number gives the empty string.
    """
    # lower(upper(x)) directly would be simplified to lower(x)
    kept = F.regexp_replace(F.upper(text), NOT_CONTENT, " ")
    return F.translate(F.lower(F.trim(kept)), "−", "-")


def canonical_source(source: Column) -> Column:
    """As `canonical_text`; null and blank sources are equal to each other only."""
    blank = source.isNull() | (F.regexp_replace(source, r"(?U)\s+", "") == "")
    return F.when(blank, F.lit("")).otherwise(F.concat(F.lit("="), canonical_text(source)))


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """Bring the string columns to Unicode's composed form, so letters with marks are spelled one way."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [pc.utf8_normalize(b.column(i), form="NFC") if n in columns else b.column(i) for i, n in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    return df.mapInArrow(run, schema)


def _clean(text: object) -> str | None:
    if not isinstance(text, str):
        return None
    try:
        text.encode()
        return text
    except UnicodeEncodeError:  # a lone half of a surrogate pair, written as an escape
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def parse_records(lines: DataFrame, id_col: str = "line_id", line: str = "line") -> DataFrame:
    """(id, text, source) of raw JSON lines, in any field order, spacing and escaping.

    Lines that are null, blank, cut off or hold no JSON object are left out. A text or source that is no string counts
    as null, and so does the source of a record without a metadata object.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    record = json.loads(s.lstrip("﻿"))
                except (ValueError, AttributeError, RecursionError):
                    continue
                if isinstance(record, dict):
                    meta = record.get("metadata")
                    rows[0].append(i), rows[1].append(_clean(record.get("text")))
                    rows[2].append(_clean(meta.get("source")) if isinstance(meta, dict) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=["id", "text", "source"]
            )

    return lines.select(F.col(id_col).cast("long").alias("id"), F.col(line).alias("line")).mapInArrow(run, "id bigint, text string, source string")


def record_keys(records: DataFrame) -> DataFrame:
    """(id, k1, k2, check): 128-bit key and a further 64 bits of the canonical form of each (id, text, source) that has a word."""
    canon = composed(spread(records.select("id", "text", "source"), "id", least=1.0), "text", "source").select(
        "id", canonical_text(F.col("text")).alias("t"), canonical_source(F.col("source")).alias("s")
    )
    return canon.filter("t != '' and id is not null").select(
        "id", F.xxhash64("t", "s").alias("k1"), F.xxhash64(F.lit("second"), "t", "s").alias("k2"),
        F.xxhash64(F.lit("check"), "s", F.reverse("t")).alias("check"),
    )


def duplicate_groups(keyed: DataFrame) -> DataFrame:
    """(k1, k2, check, keep_id, n_copies): one row for each distinct record.

    Groups are counted with map-side combining. `check` is a hash of other bits: two forms that collide on all of the
    128 bits are still told apart by it.
    """
    return keyed.groupBy("k1", "k2", "check").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))


def collapsed_records(records: DataFrame) -> DataFrame:
    """(keep_id, n_copies, collided): one row for each distinct (id, text, source) record, `n_copies` with itself.

    `collided` tells that another canonical form has the same 128-bit key (it has a row of its own). Rows with a null
    id, or without any word or number in their text, are left out; an empty table gives an empty result.
    """
    groups = duplicate_groups(record_keys(records))
    clash = groups.groupBy("k1", "k2").agg(F.count("*").alias("forms"), F.collect_list(F.struct("keep_id", "n_copies")).alias("each"))
    return clash.select(F.explode("each").alias("e"), (F.col("forms") > 1).alias("collided")).select("e.keep_id", "e.n_copies", "collided")


def formatting_duplicates(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(keep_id, dup_id): one row for each (id, text, source) record that collapses into one with a smaller id.

    Texts are equal if they are the same sequence of words and numbers, sources alike; null and blank sources are equal
    to each other only. Rows with a null id, or without any word or number, are no cases. Repeated rows with the same id
    count as copies but are reported once. A group of any size is spread over tasks by salts.
    """
    keyed = cut(record_keys(records), "keys")
    groups = duplicate_groups(keyed).filter("n_copies > 1")
    keys = ["k1", "k2", "check"]
    joined = salted_join(keyed, groups.select(*keys, "keep_id"), keys, groups, F.col("id"), n="n_copies", chunk=chunk)
    return joined.filter("id != keep_id").select("keep_id", F.col("id").alias("dup_id"))
