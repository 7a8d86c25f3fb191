"""Tokens of fields and sections: each document is encoded once as a whole, its tokens are dealt by their spans."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

RULES = ("majority", "start", "end")
#: A section ends with the white space after a sentence's mark, or with a newline.
SENTENCE = r"[.!?]+[\x20\x09-\x0D]+|\n"


class RankEncoder:
    """A byte-level BPE rank file; each id stands for a fixed run of bytes, so spans follow from lengths."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)


@functools.cache
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """One encoder for each rank file and Python worker; executors read the file at the same path."""
    return RankEncoder(path, pattern)


def deal_tokens(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary): an interval join of two sorted tilings of the same bytes.

    majority: the section with most of the token's bytes, the earlier one on a tie. start, end: the
    section of its first or last byte. Empty sections hold no byte and get no token.
    """
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crosses = last > first
    if rule == "end":
        return last, crosses
    out = first.copy()
    if rule == "majority":
        for k in np.flatnonzero(crosses):
            edges = np.concatenate([[starts[k]], section_ends[first[k] : last[k]], [token_ends[k]]])
            out[k] = first[k] + int(np.argmax(np.diff(edges)))
    return out, crosses


def token_counts(
    documents: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    fields: tuple[str, ...] = ("text",),
    rule: str = "majority",
    separator: str = "\n",
    section_end: str = SENTENCE,
    piece_rows: int = 512,
) -> DataFrame:
    """(id_col, field, section, start_char, end_char, n_tokens, n_crossing): a row for each section of each field of each row.

    The fields of a row are joined by the separator, which belongs to the field before it, and
    encoded as one text. A section ends with each match of section_end (ASCII) inside a field, and
    with the field; characters are counted in the joined text. A token may reach over sections and
    fields (the blank before a word belongs to the sentence before it) or split a character; each
    is allotted to one section by `rule`, so a row's sections add up to its tokens. n_crossing
    counts those of a section that touch another one too.

    Null fields are empty; an empty field is one empty section. A null id is kept. Repeated rows
    give repeated sections, an empty table none. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = "id long, field string, section int, start_char long, end_char long, n_tokens long, n_crossing long"

    def count(part):
        enc = rank_encoder(path, pattern)
        for batch in part:
            for at in range(0, batch.num_rows, piece_rows):
                yield _count_piece(batch.slice(at, piece_rows), enc)

    ends_of, between = re.compile(section_end.encode()), separator.encode()

    def _count_piece(piece, enc):
        ids, names, sections, lows, highs, tokens, crossing = [], [], [], [], [], [], []
        columns = [[x or "" for x in piece[f"f{i}"].to_pylist()] for i in range(len(fields))]
        for own, parts in zip(piece["id"].to_pylist(), zip(*columns), strict=True):
            text = separator.join(parts)
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.cumsum(enc.lengths[np.array(enc.encoding.encode_ordinary(text), np.int64)])
            closes, field, number = [], [], []
            done = 0
            for i, part in enumerate(parts):
                body = part.encode()
                size = len(body) + len(between) * (i + 1 < len(parts))
                cuts = np.array([m.end() + done for m in ends_of.finditer(body)], np.int64)
                if not len(cuts) or cuts[-1] < done + size or not size or body.endswith(b"\n"):
                    cuts = np.append(cuts, done + size)
                closes.append(cuts)
                field += [i] * len(cuts)
                number += range(len(cuts))
                done += size
            closes = np.concatenate(closes).astype(np.int64)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            to, crosses = deal_tokens(ends, closes, rule) if len(ends) else (np.zeros(0, np.int64), np.zeros(0, bool))
            n = len(closes)
            ids += [own] * n
            names += field
            sections += number
            high = chars[closes]
            highs.append(high)
            lows.append(np.concatenate([[0], high[:-1]]))
            tokens.append(np.bincount(to, minlength=n))
            crossing.append(np.bincount(to[crosses], minlength=n))
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array(ids, pa.int64()),
                "field": pa.array(list(fields), pa.string()).take(pa.array(names, pa.int32())),
                "section": pa.array(sections, pa.int32()),
                "start_char": pa.array(flat(lows)),
                "end_char": pa.array(flat(highs)),
                "n_tokens": pa.array(flat(tokens)),
                "n_crossing": pa.array(flat(crossing)),
            }
        )

    rows = bounded_batches(documents).select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)
