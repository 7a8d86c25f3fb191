"""Synthetic reads and primers from the driver's tables, the same in Spark SQL and in DuckDB's SQL."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import ASCI, NOTI, PELB_ATG, QC1, QC2, QC3, QC4, STUFFER, TAG_F1_FOR, TAG_F3_FOR, TAG_F3_REV
from .operators.primers import complement


@dataclass(frozen=True)
class Dialect:
    """How one engine writes what the two write differently."""

    spark: bool

    def each(self, name: str, items: str, body: str) -> str:
        return f"transform({items}, {name} -> {body})" if self.spark else f"list_transform({items}, lambda {name}: {body})"

    def keep(self, name: str, items: str, body: str) -> str:
        return f"filter({items}, {name} -> {body})" if self.spark else f"list_filter({items}, lambda {name}: {body})"

    def numbers(self, stop: str, start: str = "0") -> str:
        """start .. stop - 1, empty where stop <= start."""
        if self.spark:
            return f"(case when {stop} > {start} then sequence(cast({start} as int), cast({stop} as int) - 1) else cast(array() as array<int>) end)"
        return f"range(cast({start} as bigint), cast(greatest({stop}, {start}) as bigint))"

    def join(self, items: str, by: str = "") -> str:
        return f"array_join({items}, '{by}')" if self.spark else f"array_to_string({items}, '{by}')"

    def back(self, items: str) -> str:
        return f"reverse({items})" if self.spark else f"list_reverse({items})"

    def at(self, items: str, i: str) -> str:
        """The element at a 0-based place, null beyond the end."""
        return f"get({items}, cast({i} as int))" if self.spark else f"{items}[cast({i} as bigint) + 1]"

    def part(self, items: str, start: str, n: str) -> str:
        return f"slice({items}, cast({start} as int) + 1, cast({n} as int))" if self.spark else f"list_slice({items}, cast({start} as bigint) + 1, cast({start} as bigint) + ({n}))"

    def size(self, items: str) -> str:
        return f"size({items})" if self.spark else f"len({items})"

    def total(self, items: str) -> str:
        return f"aggregate({items}, 0, (a, x) -> a + x)" if self.spark else f"coalesce(list_sum({items}), 0)"

    def least(self, items: str) -> str:
        return f"array_min({items})" if self.spark else f"list_min({items})"

    def greatest(self, items: str) -> str:
        return f"array_max({items})" if self.spark else f"list_max({items})"

    def text_array(self, items: list[str]) -> str:
        body = ", ".join(f"'{x}'" for x in items)
        return f"array({body})" if self.spark else f"[{body}]"

    @property
    def whole(self) -> str:
        return "int" if self.spark else "integer"

    @property
    def text(self) -> str:
        return "string" if self.spark else "varchar"


SPARK, DUCK = Dialect(True), Dialect(False)
BASES = "ACGACGACGACGACGA"  # no T: a stretch of it holds no stop codon


def invented(tag: str, n: int) -> str:
    """A made-up sequence without T."""
    return "".join(BASES[int(c, 16)] for i in range(-(-n // 32)) for c in hashlib.md5(f"{tag}{i}".encode()).hexdigest())[:n]


def changed(seq: str, places: tuple[int, ...]) -> str:
    return "".join("CGAA"["ACGT".index(c)] if i in places else c for i, c in enumerate(seq))


VH1, VH3, VH4 = invented("vh1", 24), invented("vh3", 24), invented("vh4", 24)
#: VH6 is one base off VH4 (surely ambiguous), VH2 three off VH1 (ambiguous at best), VH5 five off VH3 (told apart).
VH = [VH1, changed(VH1, (3, 9, 15)), VH3, VH4, changed(VH3, (2, 6, 10, 14, 18)), changed(VH4, (11,))]
JH = [invented(f"jh{i}", 21) for i in range(4)]
VL = [invented(f"vl{i}", 24) for i in range(5)]
VJ = [invented(f"vj{i}", 21) for i in range(5)]
BEFORE_CDR3, AFTER_C, FR4 = "GCCGTG" + "TATTACTGT", "GCG", "TGGGGCCAGGGC"


def primer_rows() -> list[tuple[str, str, str, str, str]]:
    """(name, group, chain, family, sequence) of an invented panel."""
    out = []
    for i, core in enumerate(VH):
        shown = "R" + core[1:] if core[0] in "AG" and i == 2 else core  # a degenerate first base
        out.append((f"VH{i + 1}-F1-{i}", "F1_For", "heavy", f"VH{i + 1}", TAG_F1_FOR + "A" + shown))
    for i in range(3):
        boundary = ("GCCGTG" if i < 2 else "AATCAA") + "TATTACTGT" + "GCG"
        out.append((f"VH{i + 1}-F2-{i}", "F2_For", "heavy", f"VH{i + 1}", boundary))
        out.append((f"VH{i + 1}-R1-{i}", "F1_Rev", "heavy", f"VH{i + 1}", complement(boundary)))
    for i, core in enumerate(JH):
        out.append((f"JH-{i + 1}", "F2_Rev", "heavy", "JH1|JH2" if i == 0 else f"JH{i + 2}", complement(core + QC2)))
    for i, core in enumerate(VL):
        chain = "kappa" if i < 3 else "lambda"
        out.append((f"V{chain[0].upper()}-{chain[0]}-{i}", "F3_For", chain, f"V{chain[0].upper()}{i + 1}", TAG_F3_FOR + core))
    for i, core in enumerate(VJ):
        chain = "kappa" if i < 3 else "lambda"
        out.append((f"J{chain[0].upper()}-{chain[0]}-{i}", "F3_Rev", chain, f"J{chain[0].upper()}{i + 1}", TAG_F3_REV + complement(core)))
    return out


def primer_fasta() -> str:
    """The panel as a FASTA text."""
    return "# invented panel\n" + "".join(f">{n} | group={g} | chain={c} | family={f}\n{s}\n" for n, g, c, f, s in primer_rows())


def bases_of(digits: Column) -> Column:
    """Hex digits as BASES; the letters of a whole Arrow batch are exchanged at once."""

    @F.arrow_udf("string")
    def exchanged(texts: pa.Array) -> pa.Array:
        valid, ends, data = texts.buffers()
        letters = (data.to_pybytes() if data else b"").translate(bytes.maketrans(b"0123456789abcdef", BASES.encode()))
        return pa.Array.from_buffers(texts.type, len(texts), [valid, ends, pa.py_buffer(letters)], offset=texts.offset)

    return exchanged.asNondeterministic()(digits)


def reads_sql(d: Dialect, orders: str) -> str:
    """fx_reads (ord, id, filename, raw_seq, raw_qual, batch) from the orders table."""
    return _finished(d, _keyed(d, orders))


def _keyed(d: Dialect, orders: str) -> str:
    """A key with the parts of its read; fh and fl are hex digits still for Spark."""
    digits = lambda tag: f"md5(concat(cast(k as {d.text}), '{tag}', cast(i as {d.text})))"
    fill = lambda tag: d.join(d.each("i", d.numbers("15"), digits(tag) if d.spark else f"translate({digits(tag)}, '0123456789abcdef', '{BASES}')"))
    pick = lambda items, by: "case " + " ".join(f"when {by} = {i} then '{x}'" for i, x in enumerate(items)) + " end"
    base = f"""
    select o_orderkey as k,
      {pick(VH, "o_orderkey % 6")} as vh, {pick(JH, "o_orderkey % 4")} as jh, {pick(VL, "o_orderkey % 5")} as vl, {pick(VJ, "o_orderkey % 5")} as vj,
      case when o_orderkey % 23 = 0 then '' when o_orderkey % 13 = 0 then 'GCTGCCGC' else '{NOTI}' end as noti,
      case when o_orderkey % 11 = 0 then '' when o_orderkey % 31 = 0 then '{QC2[:12] + QC2[14:]}' when o_orderkey % 37 = 0 then '{changed(QC2, (6, 22, 38))}' else '{QC2}' end as link,
      case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then 'GGCGCGAC' else '{ASCI}' end as asci,
      case when o_orderkey % 41 = 0 then '{STUFFER}' else '' end as stuffer,
      case when o_orderkey % 53 = 0 then 'TAATAATAA' else '' end as stop,
      case when o_orderkey % 29 = 0 then 'C' else '' end as slip,
      case when o_orderkey % 43 = 0 then '{NOTI}' else '' end as again,
      case when o_orderkey % 27 = 0 then '' else '{QC4}' end as tail
    from {orders}"""
    return f"select *, {fill('h')} as fh, {fill('l')} as fl from ({base}) b"


def _finished(d: Dialect, filled: str) -> str:
    size_h, size_l = "240 + 3 * (k % 30) - 3 * (k % 8)", "243 + 3 * (k % 15)"
    heavy = f"vh || stuffer || stop || case when k % 47 = 0 then substring(fh, 1, 20) || substring(fh, 1, 20) else '' end || substring(fh, 1, cast({size_h} as {d.whole})) || slip"
    heavy += f" || '{BEFORE_CDR3}{AFTER_C}' || substring(fh, 401, cast(18 + 3 * (k % 8) as {d.whole})) || '{FR4}' || jh"
    whole = f"'{PELB_ATG}GGG{QC1[: QC1.find(NOTI)]}' || noti || 'A' || {heavy} || link || vl || substring(fl, 1, cast({size_l} as {d.whole})) || vj || asci || '{QC3[len(ASCI) :]}' || tail || again || 'ACGACGGACCAGGACAACGA'"
    forward = f"select k, {whole} as seq from ({filled}) f"
    if d.spark:  # the same from whole arrays: a stretch of the ten qualities in turn, with low ends and one misread base
        turn = "slice(flatten(array_repeat(array(30, 37, 34, 31, 38, 35, 32, 39, 36, 33), 200)), cast(3 * k % 10 as int) + 1 + {0}, {1})"
        head = "case when k % 5 = 0 then 12 else 6 end"
        odd = f"case when k % 13 = 0 and k % 2 = 0 then array(5) else {turn.format('41', '1')} end"
        quals = f"concat(array_repeat(8, {head}), {turn.format(head, f'41 - {head}')}, {odd}, {turn.format('42', 'length(seq) - 57')}, array_repeat(8, 15))"
        return _reads(d, f"select k, seq, {quals} as q from ({forward}) s")
    low = "case when i < case when k % 5 = 0 then 12 else 6 end or i >= length(seq) - 15 then 8 when i = 41 and k % 13 = 0 and k % 2 = 0 then 5 else 30 + (31 * k + 17 * i) % 10 end"
    with_q = f"select k, seq, {d.each('i', d.numbers('length(seq)'), f'cast({low} as {d.whole})')} as q from ({forward}) s"
    return _reads(d, with_q)


def _reads(d: Dialect, with_q: str) -> str:
    """Reads as a sequencer gives them from (k, seq, q): every seventh is turned."""
    return f"""
    select k as ord, concat('VH', cast(k % 6 + 1 as {d.text}), '-VK_', cast(k as {d.text})) as id,
      concat('run', cast(k % 3 as {d.text}), '/', 'VH', cast(k % 6 + 1 as {d.text}), '-VK_', cast(k as {d.text}), '.ab1') as filename,
      case when k % 7 = 0 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as raw_seq,
      case when k % 7 = 0 then {d.back('q')} else q end as raw_qual,
      concat('batch', cast(k % 3 as {d.text})) as batch
    from ({with_q}) w"""


def fx_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key becomes a read of some 4 KB, so keys are dealt to all cores first: their file may be one split."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    keyed = spark.sql(_keyed(SPARK, "{orders}"), orders=keys.repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey"))
    keyed = keyed.withColumns({c: bases_of(F.col(c)) for c in ("fh", "fl")})
    return spark.sql(_finished(SPARK, "select * from {keyed}"), keyed=keyed)


def primers_sql(groups: tuple[str, ...] = ()) -> str:
    """The panel as a DuckDB values list: ord, name, grp, chain, family, seq."""
    rows = [(i, *r) for i, r in enumerate(primer_rows()) if not groups or r[1] in groups]
    return "(values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows) + ") as panel(ord, name, grp, chain, family, seq)"


def fx_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, trace, ploc): 16 positions of 4 channels out of each embedding."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id as id",
        "map_from_entries(transform(sequence(0, 3), j -> struct(concat('DATA', cast(9 + j as string)), transform(sequence(0, 15), p -> cast(round(1000 * abs(embedding[4 * p + j])) as int))))) as trace",
        "sequence(0, 15) as ploc",
    )
