"""Sequence functions as Columns; positions are 0-based and -1 means not found."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    ALIGN_FLANK,
    ALIGN_GAP,
    ALIGN_MATCH,
    ALIGN_MISMATCH,
    AMBIGUOUS_AMINO_ACIDS,
    AMINO_ACIDS,
    ANCHORS,
    COMPLEMENT,
    IUPAC,
    LANDMARKS,
    REPEAT_MAX_PERIOD,
)


def places(start: Column, stop: Column) -> Column:
    """start, start + 1, ... stop - 1; empty where stop <= start."""
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))


def find(text: Column, motif: Column | str, start: Column | int = 0) -> Column:
    """Where motif first occurs at or after start."""
    motif = F.lit(motif) if isinstance(motif, str) else motif
    start = F.lit(start) if isinstance(start, int) else start
    return F.call_function("locate", motif, text, (start + 1).cast("int")) - 1


def find_last(text: Column, motif: str) -> Column:
    """Where motif last occurs."""
    back = F.call_function("locate", F.lit(motif[::-1]), F.reverse(text)) - 1
    return F.when(back >= 0, F.length(text) - back - len(motif)).otherwise(-1)


def count_motif(text: Column, motif: str) -> Column:
    """Occurrences that don't overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(motif), F.lit("")))) / len(motif)).cast("int")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def base_masks(seq: Column) -> Column:
    """A bit set of A 1, C 2, G 4, T 8 for each letter; 0 for letters that stand for no base."""
    table = F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, sum(1 << "ACGT".index(b) for b in bases))])
    return F.transform(F.split(seq, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0)))


def _codon_table() -> dict[str, str]:
    plain = {"".join(c): a for c, a in zip(itertools.product("TCAG", repeat=3), AMINO_ACIDS, strict=True)}
    out = {}
    for codon in itertools.product(IUPAC, repeat=3):
        read = {plain["".join(c)] for c in itertools.product(*(IUPAC[x] for x in codon))}
        out["".join(codon)] = read.pop() if len(read) == 1 else AMBIGUOUS_AMINO_ACIDS.get("".join(sorted(read)), "X")
    return out


CODONS = _codon_table()


def _letters(seqs: pa.Array) -> tuple[bytes, np.ndarray]:
    """The letters of all texts in turn and the bounds of each; nulls are empty, a letter beyond ASCII counts as one `?`."""
    seqs = seqs.cast(pa.string()).fill_null("")
    if not pc.all(pc.string_is_ascii(seqs)).as_py():
        seqs = pc.replace_substring_regex(seqs, "[^\x00-\x7f]", "?")
    _, ends, data = seqs.buffers()
    bounds = np.frombuffer(ends, np.int32)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64) if len(seqs) else np.zeros(1, np.int64)
    return (data.to_pybytes() if data else b"")[: bounds[-1]], bounds


def _residues() -> np.ndarray:
    """The amino acid's letter by the codes of three bases, X for all other letters."""
    out = np.full((16, 16, 16), ord("X"), np.uint8)
    for codon, acid in CODONS.items():
        out[tuple("".join(IUPAC).index(c) for c in codon)] = ord(acid)
    return out


_RESIDUES, _BASE_CODE = _residues(), np.full(256, 15, np.uint8)
_BASE_CODE[np.frombuffer("".join(IUPAC).encode(), np.uint8)] = np.arange(len(IUPAC))


def translate(seq: Column) -> Column:
    """Amino acids of whole codons; X where a codon has a letter that stands for no base or several readings. Null stays null."""

    @F.arrow_udf("string")
    def acids(seqs: pa.Array) -> pa.Array:
        raw, bounds = _letters(seqs)
        code = _BASE_CODE[np.frombuffer(raw, np.uint8)]
        n = np.diff(bounds) // 3
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(bounds[:-1] - 3 * ends[:-1], n) + 3 * np.arange(ends[-1])
        out = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_RESIDUES[code[at], code[at + 1], code[at + 2]].tobytes()))
        return pc.if_else(seqs.is_valid(), out, None)

    return acids.asNondeterministic()(seq)


def is_reversed(seq: Column) -> Column:
    """Whether more anchors stand in the reverse complement than in the read.

    The complement swaps letters one for one, so the anchors are turned here and no read has to be.
    """
    score = lambda anchors: sum((seq.contains(a.decode()).cast("int") for a in anchors), F.lit(0))
    return score(_TURNED_ANCHORS) > score(_ANCHORS)


_ANCHORS = [a.encode() for a in ANCHORS]
_TURNED_ANCHORS = [a.translate(bytes.maketrans(*(x.encode() for x in COMPLEMENT)))[::-1] for a in _ANCHORS]


def _pieces(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the bounds of each row."""
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def oriented_window(seq: Column, qual: Column, least: float, win: int) -> Column:
    """struct(back, lo, hi): is_reversed, and of the turned read from the first to the last window of `win` bases whose mean quality reaches least.

    The whole read where qualities are missing, of another number than bases, or nowhere good enough.
    """

    @F.arrow_udf("back boolean, lo int, hi int")
    def look(seqs: pa.Array, quals: pa.Array) -> pa.Array:
        raw, bounds = _letters(seqs)
        n = np.diff(bounds)
        back = np.zeros(len(n), bool)
        for r, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            read = raw[a:b]
            back[r] = sum(x in read for x in _TURNED_ANCHORS) > sum(x in read for x in _ANCHORS)
        lo, hi = np.zeros(len(n), np.int32), n.astype(np.int32)
        values, ends = _pieces(quals)
        given = quals.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) == n) & (n >= win)
        if given.any():
            sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            good = np.flatnonzero(sums[win:] - sums[:-win] >= least * win)  # windows over all values in turn, of which each row has a stretch
            first, last = np.searchsorted(good, ends[:-1]), np.searchsorted(good, ends[1:] - win, "right")
            rows = np.flatnonzero(given & (last > first))
            lo[rows], hi[rows] = good[first[rows]] - ends[rows], good[last[rows] - 1] - ends[rows] + win
        lo, hi = np.where(back, n - hi, lo).astype(np.int32), np.where(back, n - lo, hi).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(back), pa.array(lo), pa.array(hi)], ["back", "lo", "hi"])

    # not deterministic for the optimiser: it then runs once and is not copied into what is built on it
    return look.asNondeterministic()(seq, qual)


#: Pieces of a motif from this length on are sought before all its placements are compared.
SURE_PIECE = 6
HIT = "struct<pos:int,mm:int,q:array<int>>"
_HIT = pa.struct([("pos", pa.int32()), ("mm", pa.int32()), ("q", pa.list_(pa.int32()))])


def _search(raw: bytes, bounds: np.ndarray, quals: pa.Array, motif: str, start: np.ndarray, most: int, miscall_q: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(pos, mm, qualities of mismatches by row) of one motif in each text, sought from start on, in a batch of texts."""
    pattern, m, n = motif.encode(), len(motif), len(bounds) - 1
    low = bounds[:-1] + start
    pos = np.array([raw.find(pattern, a, b) for a, b in zip(low.tolist(), bounds[1:].tolist(), strict=True)], np.int64)
    pos = np.where(pos >= 0, pos - bounds[:-1], -1)
    mm, shown = np.zeros(n, np.int32), {}
    lacks = np.flatnonzero((pos < 0) & (bounds[1:] - low >= m))
    if not len(lacks):
        return pos, mm, shown
    if m // (most + 1) >= SURE_PIECE:  # a placement with so few mismatches holds one of the pieces unchanged
        cuts = [m * k // (most + 1) for k in range(most + 2)]
        pieces = [pattern[a:b] for a, b in itertools.pairwise(cuts)]
        spans = zip(lacks.tolist(), low[lacks].tolist(), bounds[lacks + 1].tolist(), strict=True)
        lacks = np.array([r for r, a, b in spans if any([raw.find(x, a, b) >= 0 for x in pieces])], np.int64)
        if not len(lacks):
            return pos, mm, shown
    letters = np.frombuffer(raw, np.uint8)
    size = (bounds[1:] - low)[lacks]
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(lacks)), size)
    flat = letters[np.arange(ends[-1]) - (ends - size)[row] + low[lacks][row]]
    wrong = np.zeros(len(flat) - m + 1, np.uint8)
    for j, c in enumerate(pattern):
        wrong += flat[j : j + len(wrong)] != c
    near = np.flatnonzero(wrong <= most)
    near = near[near + m <= ends[row[near]]]
    values, q_bounds = _pieces(quals)
    for k in near[np.lexsort((near, wrong[near], row[near]))]:
        r = int(lacks[row[k]])
        if pos[r] >= 0:
            continue
        at = int(k - (ends - size)[row[k]] + start[r])
        places = at + np.flatnonzero(flat[k : k + m] != np.frombuffer(pattern, np.uint8))
        mine = values[q_bounds[r] : q_bounds[r + 1]]
        q = [int(mine[p]) if p < len(mine) else 0 for p in places]
        if all(x < miscall_q for x in q):
            pos[r], mm[r], shown[r] = at, len(q), q
    return pos, mm, shown


def _hits(pos: np.ndarray, mm: np.ndarray, shown: dict[int, list[int]]) -> pa.Array:
    sizes = np.zeros(len(pos), np.int32)
    for r, q in shown.items():
        sizes[r] = len(q)
    flat = [x for r in sorted(shown) for x in shown[r]]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
    return pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array(mm), lists], fields=list(_HIT))


def find_motif(seq: Column, qual: Column, motif: str, start: Column, most: int, miscall_q: int) -> Column:
    """struct(pos, mm, q): the first exact hit at or after start, else the best hit of misread bases.

    Such a hit has at most `most` mismatches, each with a quality below miscall_q (a missing quality
    counts as 0); fewer mismatches win, then the leftmost. q has the qualities of the mismatches.
    Letters of a whole Arrow batch are compared at once.
    """

    @F.arrow_udf(HIT)
    def look(seqs: pa.Array, quals: pa.Array, starts: pa.Array) -> pa.Array:
        raw, bounds = _letters(seqs)
        first = np.minimum(np.maximum(starts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0), np.diff(bounds))
        return _hits(*_search(raw, bounds, quals, motif, first, most, miscall_q))

    return look.asNondeterministic()(seq, F.coalesce(qual, F.array().cast("array<int>")), start.cast("int"))


def find_sites(seq: Column, qual: Column, motifs: dict[str, tuple[str, str | None]], most: int, miscall_q: int) -> Column:
    """struct of a hit for each motif, as find_motif has it, in one pass over the read.

    motifs: name -> (motif, name of the motif that it follows, or None). One that follows another is
    sought after the end of its hit; where that has none, from where that was sought.
    """

    @F.arrow_udf("struct<" + ",".join(f"{k}:{HIT}" for k in motifs) + ">")
    def look(seqs: pa.Array, quals: pa.Array) -> pa.Array:
        raw, bounds = _letters(seqs)
        out, after = [], {}
        for k, (motif, before) in motifs.items():
            start = after[before] if before else np.zeros(len(seqs), np.int64)
            pos, mm, shown = _search(raw, bounds, quals, motif, start, most, miscall_q)
            after[k] = np.where(pos >= 0, pos + len(motif), start)
            out.append(_hits(pos, mm, shown))
        return pa.StructArray.from_arrays(out, fields=[pa.field(k, _HIT) for k in motifs])

    return look.asNondeterministic()(seq, F.coalesce(qual, F.array().cast("array<int>")))


TANDEM = pa.struct([("pos", pa.int32()), ("period", pa.int32()), ("unit", pa.string())])


def _runs(letters: np.ndarray, words: np.ndarray, period: int) -> np.ndarray:
    """Where a whole period of letters equals the next one; words has the 8 letters from each place on."""
    if period >= 15:
        later = words[period::8]
        near = 8 * np.flatnonzero(words[::8][: len(later)] == later)
        if not len(near):
            return near
        if len(near) * (2 * period + 8) < len(letters):
            # all that a run of one period with this word inside can cover
            start = np.maximum(near - period + 8, 0)
            at = start[:, None] + np.arange(2 * period - 8)
            same = (at + period < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] == letters[np.minimum(at + period, len(letters) - 1)])
            runs = np.concatenate([np.zeros((len(near), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)], 1)
            k, j = np.nonzero(runs[:, period:] - runs[:, :-period] == period)
            return np.unique(start[k] + j)
    runs = np.concatenate([[0], np.cumsum(letters[period:] == letters[:-period], dtype=np.int32)])
    return np.flatnonzero(runs[period:] - runs[:-period] == period)


def find_tandem(seq: Column, shortest: int) -> Column:
    """struct(pos, period, unit) of the tandem repeat of the smallest period, then the leftmost; null if none.

    For each period the letters of a batch are compared with those a period on; runs of a whole
    period are repeats. Such a run holds a word of 8 letters that starts at a multiple of 8 if the
    period is 15 or more, so only these words are compared first.
    """

    @F.arrow_udf("pos int, period int, unit string")
    def repeats(seqs: pa.Array) -> pa.Array:
        raw, bounds = _letters(seqs)
        found: dict[int, tuple[int, int]] = {}
        for first in range(0, len(seqs), 1000):
            own = bounds[first : first + 1001]
            letters = np.frombuffer(raw, np.uint8)[own[0] : own[-1]]
            ends = own[1:] - own[0]
            row = np.repeat(np.arange(len(ends)), np.diff(own))
            words = np.lib.stride_tricks.sliding_window_view(letters, 8).copy().view(np.uint64)[:, 0] if len(letters) >= 8 else np.zeros(0, np.uint64)
            for period in range(shortest, REPEAT_MAX_PERIOD + 1):
                if len(letters) < 2 * period:
                    break
                hits = _runs(letters, words, period)
                hits = hits[hits + 2 * period <= ends[row[hits]]]
                rows, leftmost = np.unique(row[hits], return_index=True)
                for r, at in zip(rows.tolist(), hits[leftmost].tolist(), strict=True):
                    found.setdefault(first + r, (at + int(own[0]), period))
        rows = [None] * len(seqs)
        for r, (at, period) in found.items():
            rows[r] = {"pos": at - int(bounds[r]), "period": period, "unit": raw[at : at + period].decode()}
        return pa.array(rows, TANDEM)

    return repeats.asNondeterministic()(seq)


def trace_purity(channels: list[Column], ploc: Column, lo: Column, hi: Column, ratio: float) -> Column:
    """struct(pct, n): the share of called positions whose second peak exceeds ratio times the first; nulls if none can be judged."""
    depth = F.least(*[F.size(c) for c in channels])
    spots = F.filter(F.slice(ploc, lo + 1, F.greatest(F.least(hi, F.size(ploc)) - lo, F.lit(0))), lambda p: (p >= 0) & (p < depth))
    peaks = F.transform(spots, lambda p: F.sort_array(F.array(*[F.get(c, p).cast("double") for c in channels]), False))
    rates = F.transform(F.filter(peaks, lambda v: v[0] > 0), lambda v: v[1] / v[0])
    n = F.size(rates)
    given = F.coalesce((F.size(ploc) > 0) & (depth >= 0), F.lit(False))
    return F.when(given & (n > 0), F.struct((F.lit(100.0) * F.size(F.filter(rates, lambda r: r > ratio)) / n).alias("pct"), n.alias("n")))


def cdr3(prot: Column, linker_protein: str) -> Column:
    """From after the last C to the last Trp-Gly-x-Gly before the linker; null without either."""
    cut = F.instr(prot, linker_protein)
    seg = F.when(cut > 0, F.substring(prot, F.lit(1), cut - 1)).otherwise(prot)
    # matches don't overlap, so the last one starts at the end of all that precedes it
    head = F.regexp_extract(seg, r"^((?:(?!WG.G).)*(?:WG.G(?:(?!WG.G).)*)*)WG.G(?:(?!WG.G).)*$", 1)
    matched = seg.rlike("WG.G")
    last_c = find_last(head, "C")
    return F.when(matched & (last_c >= 0), F.substring(head, last_c + 2, F.length(head)))


def _masks(text: str) -> np.ndarray:
    return _MASK_OF[np.frombuffer(text.encode("latin1", "replace"), np.uint8)]


_MASK_OF = np.zeros(256, np.uint8)
_SEEN_OF = np.zeros(256, np.uint8)
for _code, _bases in IUPAC.items():
    _MASK_OF[ord(_code)] = sum(1 << "ACGT".index(b) for b in _bases)
    if len(_bases) == 1:
        _SEEN_OF[ord(_code)] = _MASK_OF[ord(_code)]


def align_windows(landmark: str, windows: list[str]) -> np.ndarray:
    """(sub, gap, start) of the whole landmark in each window of fewer than 1,000 letters, whose ends are free.

    A cell keeps the counts and the start of its best path, so nothing is traced back: a diagonal
    step is preferred to a skipped landmark base, that to a skipped window base; the leftmost of
    equal ends wins. Cells are numbers: score, column, sub, gap and start from high to low bits. A
    row of cells of 256 windows is made at once; the way from the left is a running maximum of
    score - gap * column, in which the latest column wins a tie.
    """
    out = [_aligned(landmark, windows[i : i + 256]) for i in range(0, len(windows), 256)]
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _aligned(landmark: str, windows: list[str]) -> np.ndarray:
    width, n, field = max(len(w) for w in windows), len(windows), (1 << 10) - 1
    score, column, sub, gap = 1 << 40, 1 << 30, 1 << 20, 1 << 10
    seen = np.zeros((n, width), np.uint8)
    for r, w in enumerate(windows):
        seen[r, : len(w)] = _SEEN_OF[np.frombuffer(w.encode("latin1", "replace"), np.uint8)]
    seen = np.ascontiguousarray(seen.T)
    j = np.arange(width + 1)[:, None]
    cells = np.repeat(2000 * score + j, n, 1)
    onward, back = j * (column - ALIGN_GAP * score), j * (ALIGN_GAP * score + gap)
    for mask in _masks(landmark):
        made = cells + (ALIGN_GAP * score + gap)
        diagonal = cells[:-1] + np.where((seen & mask) > 0, ALIGN_MATCH * score, ALIGN_MISMATCH * score + sub)
        made[1:] = np.where((diagonal | (score - 1)) >= made[1:], diagonal, made[1:])
        best = np.maximum.accumulate(made + onward, 0)
        cells = best + back - ((best >> 30) & field) * (column + gap)
    reached = np.where(j <= np.array([len(w) for w in windows]), cells >> 40, -1)
    last = cells[reached.argmax(0), np.arange(n)]
    return np.stack([(last >> 20) & field, (last >> 10) & field, last & field], 1)


def scan_landmarks(landmark: str, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mismatches, position) of the leftmost best placement without gaps in each text; position -1 where the text is shorter."""
    m, n = len(landmark), np.diff(bounds)
    sub, at = np.full(len(n), m, np.int32), np.full(len(n), -1, np.int32)
    seen = _SEEN_OF[np.frombuffer(raw, np.uint8)[bounds[0] :]]
    if len(seen) < m:
        return sub, at
    wrong = np.zeros(len(seen) - m + 1, np.uint16)
    for j, mask in enumerate(_masks(landmark)):
        wrong += seen[j : j + len(wrong)] & mask == 0
    low = bounds - bounds[0]
    for r in np.flatnonzero(n >= m):
        own = wrong[low[r] : low[r + 1] - m + 1]
        at[r] = own.argmin()
        sub[r] = own[at[r]]
    return sub, at


def scan_landmark(landmark: str, seq: str) -> tuple[int, int]:
    """scan_landmarks of one text."""
    sub, at = scan_landmarks(landmark, seq.encode("latin1", "replace"), np.array([0, len(seq)]))
    return int(sub[0]), int(at[0])


NEAR = "sub int, gap int, pos int, aligned boolean"


def near_landmarks(name: str, max_sub: int):
    """An Arrow UDF: where a read lacks the exact landmark, its best placement, aligned if more than max_sub bases differ.

    It gets null for reads that need no search and skips them.
    """
    landmark = LANDMARKS[name]

    @F.arrow_udf(NEAR)
    def near(seqs: pa.Array) -> pa.Array:
        n = len(seqs)
        sub, gap, place, aligned = (np.zeros(n, np.int32) for _ in range(4))
        later, windows, lows = [], [], []
        asked = np.flatnonzero(seqs.is_valid().to_numpy(zero_copy_only=False))
        for first in range(0, len(asked), 500):
            rows = asked[first : first + 500]
            raw, bounds = _letters(seqs.take(pa.array(rows)))
            sub[rows], place[rows] = scan_landmarks(landmark, raw, bounds)
            for r, a, b in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if place[r] >= 0 and sub[r] > max_sub:
                    low = max(0, int(place[r]) - ALIGN_FLANK)
                    later.append(r)
                    lows.append(low)
                    windows.append(raw[a + low : min(b, a + int(place[r]) + len(landmark) + ALIGN_FLANK)].decode())
        if later:
            got = align_windows(landmark, windows)
            sub[later], gap[later], place[later], aligned[later] = got[:, 0], got[:, 1], got[:, 2] + lows, 1
        none = ~seqs.is_valid().to_numpy(zero_copy_only=False)
        columns = [pa.array(x, mask=none) for x in (sub, gap, place, aligned.astype(bool))]
        return pa.StructArray.from_arrays(columns, ["sub", "gap", "pos", "aligned"])

    return near.asNondeterministic()


NEAREST = "struct<mm:int,next_mm:int,top:array<int>,next:array<int>,mmpos:array<int>,start:int>"
_NEAREST = pa.struct([("mm", pa.int32()), ("next_mm", pa.int32()), ("top", pa.list_(pa.int32())), ("next", pa.list_(pa.int32())), ("mmpos", pa.list_(pa.int32())), ("start", pa.int32())])
_NOWHERE = 1 << 20


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _nearest(laid: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, margin: int) -> pa.Array:
    """NEAREST of n reads from where each pattern lies: its reads, starts and wrong places."""
    counts = np.full((n, len(laid)), _NOWHERE, np.int32)
    for c, (some, _, wrong) in enumerate(laid):
        counts[some, c] = wrong.sum(1)
    best = counts.min(1)
    later = np.where(counts > best[:, None], counts, _NOWHERE)
    next_mm = later.min(1)
    order = np.argsort(counts, 1, kind="stable")
    placed, has_next = best < _NOWHERE, next_mm < _NOWHERE
    n_top = (counts <= np.minimum(best + margin, _NOWHERE - 1)[:, None]).sum(1)
    n_best = (counts == best[:, None]).sum(1)
    n_next = np.where(has_next, (counts == next_mm[:, None]).sum(1), 0)
    at = np.arange(len(laid))
    top, after = order[at < n_top[:, None]], order[(at >= n_best[:, None]) & (at < (n_best + n_next)[:, None])]
    start, wrong_rows, wrong_at = np.zeros(n, np.int32), [], []
    for c, (some, begin, wrong) in enumerate(laid):
        first = np.flatnonzero(order[some, 0] == c)
        start[some[first]] = begin[first]
        r, k = np.nonzero(wrong[first])
        wrong_rows.append(some[first][r])
        wrong_at.append(k)
    rows, places = np.concatenate(wrong_rows), np.concatenate(wrong_at)
    mmpos = _lists(np.bincount(rows, minlength=n), places[np.argsort(rows, kind="stable")])
    parts = [pa.array(best), pa.array(next_mm, mask=~has_next), _lists(n_top, top), _lists(n_next, after), mmpos, pa.array(start)]
    return pa.StructArray.from_arrays(parts, fields=list(_NEAREST), mask=pa.array(~placed))


def lay_panel(seq: Column, sites: dict[str, Column], patterns: list[tuple[str, int, str]], units: dict[str, list[int]], singles: list[int], scanned: list[int], margin: int, most: int) -> Column:
    """struct of a NEAREST for each unit, `single` and `scanned`: how the patterns lie on the read.

    patterns: (site, offset, IUPAC letters), laid at the site's position plus offset; one whose site
    is missing (-1 or null) or that runs off the read lies nowhere. A unit lists places of patterns in
    the order that ties have; `top` are those within `margin` of the least mismatches, `next` those of
    the next number, both as places in the unit, mmpos the wrong places of the first; null if none
    lies on the read. `single` has the mismatches of each of singles, `scanned` the place of the first
    of scanned with at most `most` mismatches.
    """
    names = list(sites)
    kind = "struct<" + "".join(f"{k}:{NEAREST}," for k in units) + "single:array<int>,scanned:int>"

    @F.arrow_udf(kind)
    def lay(seqs: pa.Array, at: pa.Array) -> pa.Array:
        raw, bounds = _letters(seqs)
        n, seen, size = len(seqs), _SEEN_OF[np.frombuffer(raw, np.uint8)], np.diff(bounds)
        where = [at.field(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(names))]

        def laid(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            site, offset, pattern = patterns[i]
            pos = where[names.index(site)]
            start = pos + offset
            some = np.flatnonzero((pos >= 0) & (start >= 0) & (start + len(pattern) <= size))
            return some, start[some], (seen[(bounds[some] + start[some])[:, None] + np.arange(len(pattern))] & _masks(pattern)) == 0

        out = [_nearest([laid(i) for i in own], n, margin) if own else pa.nulls(n, _NEAREST) for own in units.values()]
        single = np.full((n, len(singles)), -1, np.int32)
        for c, i in enumerate(singles):
            some, _, wrong = laid(i)
            single[some, c] = wrong.sum(1)
        flat = single.ravel()
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(singles)), pa.array(flat, mask=flat < 0)))
        first = np.full(n, -1, np.int32)
        for c, i in reversed(list(enumerate(scanned))):
            some, _, wrong = laid(i)
            first[some[wrong.sum(1) <= most]] = c
        out.append(pa.array(first, mask=first < 0))
        return pa.StructArray.from_arrays(out, fields=[pa.field(k, _NEAREST) for k in units] + [pa.field("single", pa.list_(pa.int32())), pa.field("scanned", pa.int32())])

    return lay.asNondeterministic()(seq, F.struct(*[c.cast("int").alias(k) for k, c in sites.items()]))


def mismatch_counts(windows: Column, patterns: Column) -> Column:
    """How many places of a window hold a base that the pattern of the same length does not allow."""

    @F.arrow_udf("int")
    def count(seen: pa.Array, wanted: pa.Array) -> pa.Array:
        (raw, bounds), (pattern, places) = _letters(seen), _letters(wanted)
        wrong = (_SEEN_OF[np.frombuffer(raw, np.uint8)[bounds[0] :]] & _MASK_OF[np.frombuffer(pattern, np.uint8)[places[0] :]]) == 0
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(wrong)])[bounds - bounds[0]]).astype(np.int32))

    return count.asNondeterministic()(windows, patterns)
