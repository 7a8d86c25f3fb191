"""Named queries of the read analysis over the driver's tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import os.path
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import QcConfig, build_config
from .constants import ANCHORS, ASCI, AMINO_ACIDS, COMPLEMENT, FRAME_MOD, IUPAC, LIBRARY, NEGCTRL, NOTI, PELB_ATG, QC2, REPEAT_MAX_PERIOD, SCORED_GROUPS, STUFFER, STUFFER_INSERT_BP, ANALYSIS_GROUPS
from .fixtures import DUCK, fx_reads, fx_traces, primer_fasta, primer_rows, reads_sql
from .functions import sequences as S
from .functions.order import natural_key
from .operators import composition as C
from .operators import control, reports
from .operators.calling import LINKER_PROTEIN, primer_calls
from .operators.primers import ambiguity_order, place_primer, primer_ambiguity, primer_panel
from .operators.structure import insert_md5, located, measured, oriented, structural_qc, with_landmarks
from .plans.analysis import Analysis, analyze, with_identity
from .plans.growing import call_items, merged_tallies, partial_tallies, update_batches
from .sinks.scratch import materialize, scratch_dir
from .sinks.text import csv_lines
from .sources.ab1 import basename, clone_id
from .sources.fasta import core_trims, fasta_entries, primer_table, read_primers

CFG = build_config({"analysis_mode": LIBRARY})


def _located(spark: SparkSession, sf_dir: str, cfg: QcConfig = CFG) -> DataFrame:
    return located(oriented(fx_reads(spark, sf_dir), cfg), cfg)


def _calls(spark: SparkSession, sf_dir: str, cfg: QcConfig = CFG) -> DataFrame:
    """Calls that need sites alone: structure is not computed. A written table, so that plans above it stay small."""
    primers = read_primers(spark, primer_fasta())
    pairs = primer_ambiguity(primers, cfg).orderBy(*ambiguity_order()).collect()
    sites = _located(spark, sf_dir, cfg).withColumns({"verdict": F.lit("PASS"), "prot": F.lit("")})
    return materialize(primer_calls(sites, primer_panel(primers), pairs, cfg))


def _analysis(spark: SparkSession, sf_dir: str, **overrides) -> Analysis:
    return analyze(fx_reads(spark, sf_dir), read_primers(spark, primer_fasta()), {"analysis_mode": LIBRARY, **overrides}, "batch")


def synthetic_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx_reads(spark, sf_dir)
    return x.select("ord", "id", "batch", "raw_seq", F.aggregate("raw_qual", F.lit(0), lambda a, q: a + q).cast("bigint").alias("q_sum"))


def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and URLs as paths: base name and the name without its last extension."""
    paths = fx_reads(spark, sf_dir).select(F.col("filename").alias("path")).union(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"))
    return paths.select("path", basename(F.col("path")).alias("base"), clone_id(F.col("path")).alias("stem"))


def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx_reads(spark, sf_dir).withColumn("back", S.is_reversed(F.col("raw_seq")))
    return x.select("ord", F.when(F.col("back"), "R").otherwise("F").alias("direction"), F.md5(F.when(F.col("back"), S.reverse_complement(F.col("raw_seq"))).otherwise(F.col("raw_seq"))).alias("turned"))


def quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oriented(fx_reads(spark, sf_dir), CFG).select("ord", "trim_lo", "trim_hi", "used_bp")


def motif_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda k: F.try_element_at("pos_approx", F.lit(k))["mm"]
    return _located(spark, sf_dir).select("ord", *[f"{p}_{k}" for k in ("notI", "link", "ascI") for p in ("n", "pos")], *[near(k).alias(f"mm_{k}") for k in ("notI", "link", "ascI")])


def insert_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = measured(_located(spark, sf_dir), CFG)
    return x.select("ord", "insert_bp", (F.col("insert_bp") % 3).alias("frame"), "d1", "d2")


def translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = measured(_located(spark, sf_dir), CFG)
    return x.select("ord", "orf_start", "prot", "aa_len", "stop_ok")


def cdr3_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = measured(_located(spark, sf_dir), CFG).select(S.cdr3(F.col("prot"), LINKER_PROTEIN).alias("cdr3"))
    return x.where("cdr3 is not null").groupBy(F.length("cdr3").alias("cdr3_len")).agg(F.count("*").alias("n"), F.count_distinct("cdr3").alias("n_distinct"))


def tandem_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(_located(spark, sf_dir), CFG).where("repeat is not null").select("ord", "repeat.pos", "repeat.period", "repeat.unit", "repeat.region")


def trace_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx_traces(spark, sf_dir)
    channels = [F.try_element_at("trace", F.lit(f"DATA{i}")) for i in range(9, 13)]
    mix = S.trace_purity(channels, F.col("ploc"), F.lit(0), F.lit(16), CFG["mix_ratio"])
    return x.select("id", mix.alias("mix")).select("id", F.col("mix.pct").alias("mix_pct"), F.col("mix.n").alias("mix_n"))


def landmark_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.landmark_states(with_landmarks(_located(spark, sf_dir), CFG))


def structural_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = structural_qc(fx_reads(spark, sf_dir), CFG)
    return qc.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("insert_bp").alias("insert_sum"))


def structural_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flag_frequency(materialize(structural_qc(fx_reads(spark, sf_dir), CFG).select("flags")))


def primer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = primer_table(fasta_entries(spark.createDataFrame([(primer_fasta(),)], "text string")))
    return p.groupBy("grp", "chain").agg(F.count("*").alias("n"), F.min(F.length("core")).alias("core_min"), F.max(F.length("core")).alias("core_max"), F.first("core_trim").alias("core_trim"))


def primer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = primer_ambiguity(read_primers(spark, primer_fasta()), CFG)
    return pairs.select("grp", "chain", "a", "b", "cmp_len", "incompatible", "tie", "same_family", "truncated", F.array_join("families", "|").alias("families"))


def call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = C.unpivoted(_calls(spark, sf_dir)).select("ord", "key", "call.*")
    return x.select("ord", "key", "mm", "delta", F.array_join("names", ",").alias("names"), F.array_join("families", "|").alias("families"), "chain", "start", "ok")


def family_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.called_tally(_calls(spark, sf_dir))


def family_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compose_called(_calls(spark, sf_dir)).select("key", "n", "n_ties", "species_certain", "species_possible", F.array_join("species_only_possible", "|").alias("only_ties"))


def panel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = C.primer_coverage(_calls(spark, sf_dir), read_primers(spark, primer_fasta()))
    return cov.select("grp", "chain", "n", "total_n", "observed", F.array_join(F.transform("unobserved", lambda u: u["name"]), ",").alias("unobserved"), F.round("power_p", 9).alias("power_p"), "underpowered")


def batch_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called VH families by batch, and over all batches where batch is null."""
    rows = _calls(spark, sf_dir).where("vh.ok").select("batch", C.call_label("vh").alias("label"))
    return rows.groupingSets([["batch", "label"], ["label"]], "batch", "label").agg(F.count("*").alias("n"))


def growing_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by batch from a table of partial tallies, after all batches were added and one came again."""
    partial, path = materialize(partial_tallies(call_items(_calls(spark, sf_dir)))), scratch_dir(spark)
    update_batches(partial, path)
    update_batches(partial.join(F.broadcast(partial.agg(F.min("batch").alias("batch"))), "batch").select(partial.columns), path)
    return merged_tallies(spark, path, by_batch=True)


def control_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = build_config({"analysis_mode": NEGCTRL})
    facts = measured(_located(spark, sf_dir, cfg), cfg).select("ord", "id", "n_notI", "n_ascI", "n_link", "pos_notI", "pos_link", "pos_ascI", "stuffer", "insert_bp", "mix_pct", "seq")
    clones = control.control_clones(materialize(facts), cfg)
    return control.control_counts(clones).select("verdict", "n", "level")


def insert_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = measured(_located(spark, sf_dir), CFG).select("ord", insert_md5().alias("insert_md5")).where("insert_md5 != ''")
    return x.groupBy("insert_md5").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each read in the order of names, from counts of names by their first two parts."""
    from pyspark.sql import Window

    x = fx_reads(spark, sf_dir).select("id", "ord").withColumn("k", natural_key(F.col("id")))
    group = F.struct(F.get("k", 0).alias("a"), F.get("k", 1).alias("b"))
    x = x.withColumn("g", group)
    sizes = x.groupBy("g").agg(F.count("*").alias("n"))  # one row for each VH number
    before = sizes.select("g", (F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    x = x.join(F.broadcast(before), "g").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("g").orderBy("k", "ord")))
    return x.select("id", "place")


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).summary


def structure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.structure_table(structural_qc(with_identity(fx_reads(spark, sf_dir)), CFG))


def call_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.call_table(_calls(spark, sf_dir), CFG)


def batch_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _analysis(spark, sf_dir)
    return reports.composition_table(run.qc, run.calls, run.primers, run.config)


def assigned_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primer flags of a batch that was assigned VH4 and kappa."""
    cfg = build_config({"batch_vh_family": "VH4", "batch_chain": "kappa"})
    return C.flag_frequency(_calls(spark, sf_dir, cfg))


def fasta_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).fasta


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _located(spark, sf_dir).select("ord", "id", "direction", "used_bp", "pos_notI", "pos_link", "pos_ascI")
    return csv_lines(x, "ord", ["clone", "dir", "used", "NotI", "linker", "AscI"]).withColumnRenamed("line", "csv_line")


QUERIES = {
    f.__name__: f
    for f in (
        synthetic_reads, read_names, orientation, quality_trim, motif_positions, insert_distances, translation, cdr3_lengths, tandem_repeats, trace_mixing, landmark_states,
        structural_verdicts, structural_flags, primer_groups, primer_pairs, call_rows, family_tally, family_species, panel_coverage, batch_families, growing_tally, control_verdicts,
        insert_fingerprints, natural_order, summary_table, structure_table, call_table, batch_composition, assigned_flags, fasta_export, csv_export,
    )
}


# --- the same in DuckDB's SQL -----------------------------------------------------------------------


def _turned() -> str:
    back = f"reverse(translate(raw_seq, '{COMPLEMENT[0]}', '{COMPLEMENT[1]}'))"
    score = lambda s: " + ".join(f"cast(contains({s}, '{a}') as integer)" for a in ANCHORS)
    return f"""reads as ({reads_sql(DUCK, "orders")}),
    scored as (select *, {back} as back, ({score(back)}) > ({score("raw_seq")}) as rev from reads),
    turned as (select ord, id, filename, batch, case when rev then 'R' else 'F' end as direction, case when rev then back else raw_seq end as whole, case when rev then list_reverse(raw_qual) else raw_qual end as whole_q from scored)"""


def _trimmed() -> str:
    t = CFG.thresholds
    frame = f"over (partition by ord order by i rows between current row and {t['trim_win'] - 1} following)"
    return f"""{_turned()},
    each as (select ord, unnest(whole_q) as q, generate_subscripts(whole_q, 1) - 1 as i from turned),
    wins as (select ord, i, sum(q) {frame} as s, count(*) {frame} as c from each),
    cuts as (select ord, min(i) as lo, max(i) + {t['trim_win']} as hi from wins where c = {t['trim_win']} and s >= {t['trim_q'] * t['trim_win']} group by ord),
    used as (select t.*, coalesce(lo, 0) as lo, coalesce(hi, length(whole)) as hi, substr(whole, coalesce(lo, 0) + 1, coalesce(hi, length(whole)) - coalesce(lo, 0)) as seq,
      list_slice(whole_q, coalesce(lo, 0) + 1, coalesce(hi, length(whole))) as qual from turned t left join cuts using (ord))"""


def _site(source: str, name: str, motif: str, start: str, out: str) -> str:
    m, t = len(motif), CFG.thresholds
    gap = lambda i: f"hamming(substr(seq, {i} + 1, {m}), '{motif}')"
    sure = f"list_filter(range({m}), lambda j: substr(seq, i + j + 1, 1) <> substr('{motif}', j + 1, 1) and coalesce(qual[i + j + 1], 0) >= {t['pos_miscall_q']})"
    near = f"list_filter(list_filter(range(cast({start} as bigint), cast(greatest(length(seq) - {m - 1}, {start}) as bigint)), lambda i: {gap('i')} <= {t['pos_max_mismatch']}), lambda i: len({sure}) = 0)"
    return f"""{out}_e as (select *, case when strpos(substr(seq, {start} + 1), '{motif}') > 0 then strpos(substr(seq, {start} + 1), '{motif}') - 1 + {start} else -1 end as exact from {source}),
    {out} as (select * exclude (exact, best), case when exact >= 0 then exact when best is null then -1 else best % 1000000 end as pos_{name}, case when exact >= 0 or best is null then 0 else best // 1000000 end as mm_{name}
      from (select *, case when exact < 0 then list_min(list_transform({near}, lambda i: 1000000 * {gap('i')} + i)) end as best from {out}_e))"""


def _sites() -> str:
    count = lambda m: f"(length(seq) - length(replace(seq, '{m}', ''))) // {len(m)}"
    link = f"case when pos_notI >= 0 then pos_notI + {len(NOTI)} else 0 end"
    return f"""{_trimmed()},
    {_site("used", "notI", NOTI, "0", "s1")},
    {_site("s1", "link", QC2, f"({link})", "s2")},
    {_site("s2", "ascI", ASCI, f"(case when pos_link >= 0 then pos_link + {len(QC2)} else {link} end)", "s3")},
    sites as (select *, {count(NOTI)} as n_notI, {count(QC2)} as n_link, {count(ASCI)} as n_ascI, strpos(seq, '{PELB_ATG}') - 1 as orf_start, contains(seq, '{STUFFER}') as stuffer,
      case when pos_notI >= 0 and pos_ascI > pos_notI then pos_ascI + {len(ASCI)} - pos_notI end as insert_bp,
      case when pos_notI >= 0 and pos_link > pos_notI then pos_link - pos_notI end as d1,
      case when pos_link >= 0 and pos_ascI > pos_link then pos_ascI - pos_link - {len(QC2)} end as d2 from s3)"""


def _proteins() -> str:
    at = lambda k: f"strpos('TCAG', substr(seq, cast(orf_start + 3 * i + {k} as bigint), 1)) - 1"
    return f"""{_sites()},
    full_ as (select *, case when orf_start >= 0 then array_to_string(list_transform(range((length(seq) - orf_start) // 3), lambda i: substr('{AMINO_ACIDS}', 1 + 16 * ({at(1)}) + 4 * ({at(2)}) + {at(3)}, 1)), '') end as aa from sites),
    prots as (select *, coalesce(case when strpos(aa, '*') > 0 then substr(aa, 1, strpos(aa, '*') - 1) else aa end, '') as prot,
      case when aa is not null and strpos(aa, '*') = 0 then true when strpos(aa, '*') > 0 and pos_ascI >= 0 then orf_start + 3 * (strpos(aa, '*') - 1) >= pos_ascI end as stop_ok from full_)"""


def _repeats() -> str:
    """The tandem repeat of each read of `sites`: VH before VL, then the shortest period, then the leftmost."""
    t = CFG.thresholds
    return f"""regions as (select ord, 'VH' as region, substr(seq, pos_notI + 1, d1) as s from sites where d1 is not null
            union all select ord, 'VL', substr(seq, pos_link + {len(QC2)} + 1, d2) from sites where d2 > 0),
          words as (select ord, region, s, i, substr(s, i + 1, {t['repeat_min_len']}) as w from (select *, unnest(range(length(s) - {t['repeat_min_len'] - 1})) as i from regions where length(s) >= {2 * t['repeat_min_len']})),
          twice as (select a.ord, a.region, a.i as pos, b.i - a.i as period, substr(a.s, a.i + 1, b.i - a.i) as unit from words a join words b on a.ord = b.ord and a.region = b.region and a.w = b.w
            where b.i - a.i between {t['repeat_min_len']} and {REPEAT_MAX_PERIOD} and substr(a.s, a.i + 1, b.i - a.i) = substr(a.s, b.i + 1, b.i - a.i)),
          repeats as (select * from (select *, row_number() over (partition by ord order by region, period, pos) as r from twice) where r = 1)"""


def _panel() -> list[dict]:
    """The panel with trims and placements, from its rows alone."""
    buckets = defaultdict(list)
    for r in primer_rows():
        buckets[r[1], r[2]].append(r[4])
    trim = {k: len(os.path.commonprefix(v)) if len(v) > 1 and k[0] in ANALYSIS_GROUPS else 0 for k, v in buckets.items()}
    out = []
    for i, (name, grp, chain, family, seq) in enumerate(primer_rows()):
        n = trim[grp, chain]
        out.append({"ord": i, "name": name, "grp": grp, "chain": chain, "families": sorted(family.split("|")), "seq": seq, "core_trim": n, "core": seq[n:]})
    return out


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items) + "]"


def _called() -> str:
    rows = []
    for r in _panel():
        p = place_primer(r)
        if p.site and r["grp"] in SCORED_GROUPS:
            rows.append(f"({r['ord']}, '{r['name']}', '{r['grp']}', '{r['chain']}', {_list(r['families'])}, '{p.site}', {p.offset}, {len(p.pattern)}, {_list(p.allowed)})")
    limit = CFG["primer_max_mismatch"]
    pick = lambda grp: f"""list_sort(list_distinct(flatten(list({grp}.families) filter ({grp}.mm = {grp}.best))))"""
    return f"""{_sites()},
    panel(p_ord, name, grp, chain, families, site, off, n, allowed) as (values {", ".join(rows)}),
    laid as (select s.ord, s.seq, s.batch, p.*, case site when 'notI' then pos_notI when 'link' then pos_link else pos_ascI end as anchor from sites s, panel p),
    cands as (select ord, batch, p_ord, name, grp, chain, families, n, anchor + off as start, len(list_filter(range(n), lambda j: not contains(allowed[j + 1], substr(seq, anchor + off + j + 1, 1)))) as mm
      from laid where anchor >= 0 and anchor + off >= 0 and anchor + off + n <= length(seq)),
    ranked as (select *, min(mm) over (partition by ord, grp, case when grp like 'F3%' then chain end) as best from cands),
    one as (select ord, any_value(batch) as batch, grp, case when grp like 'F3%' then chain end as part, min(mm) as mm, min(mm) filter (mm > best) - min(mm) as delta,
      array_to_string(list(name order by mm, n desc, p_ord) filter (mm = best), ',') as names, {pick("ranked")} as fams, count(*) filter (mm = best) as n_names,
      arg_min(chain, mm * 1000000 - n * 1000 + p_ord) as chain, arg_min(start, mm * 1000000 - n * 1000 + p_ord) as start, min(mm) <= {limit} as ok from ranked group by ord, grp, part),
    vls as (select *, row_number() over (partition by ord order by mm, chain) as r, count(*) over (partition by ord, mm) as same from one where grp = 'F3_For'),
    vl as (select *, case when ok and same = 1 then chain end as sure from vls where r = 1),
    calls as (select ord, batch, case grp when 'F1_For' then 'vh' else 'jh' end as key, mm, delta, names, fams, n_names, chain, start, ok, grp from one where grp in ('F1_For', 'F2_Rev')
      union all select ord, batch, 'vl', mm, delta, names, fams, n_names, chain, start, ok, grp from vl
      union all select o.ord, o.batch, 'vj', o.mm, o.delta, o.names, o.fams, o.n_names, o.chain, o.start, o.ok, o.grp from one o join vl on o.ord = vl.ord and o.part = vl.sure where o.grp = 'F3_Rev')"""


def _oracle() -> dict[str, str]:
    t = CFG.thresholds
    masks = {c: sum(1 << "ACGT".index(b) for b in bases) for c, bases in IUPAC.items()}
    panel = _panel()
    table = "panel(ord, name, grp, chain, families, core, core_trim, masks) as (values " + ", ".join(
        f"({r['ord']}, '{r['name']}', '{r['grp']}', '{r['chain']}', {_list(r['families'])}, '{r['core']}', {r['core_trim']}, {_list(masks[c] for c in r['core'])})" for r in panel if r["grp"] in ANALYSIS_GROUPS
    ) + ")"
    scored = ", ".join(f"({r['ord']}, '{r['name']}', '{r['grp']}', '{r['chain']}')" for r in panel if r["grp"] in SCORED_GROUPS)
    label = "case when len(fams) = 0 then '?' else array_to_string(fams, '|') end"
    tied = t["primer_max_mismatch"]
    keys = "(values ('vh'), ('jh'), ('vl'), ('vj')) as k(key)"
    verdict = f"""case when greatest(n_notI, n_ascI, n_link) > 1 then 'CONCATEMER' when pos_notI < 0 or pos_ascI < 0 then 'EMPTY_VECTOR' when stuffer then 'PARENTAL' when insert_bp = {STUFFER_INSERT_BP} then 'PARENTAL?'
      when pos_link >= 0 and insert_bp between {t['insert_min']} and {t['insert_max']} then case when insert_bp % 3 = {FRAME_MOD} then 'CONTAMINATED' else 'CONTAMINATED?' end
      when pos_link >= 0 and insert_bp < {t['insert_min']} then 'PARTIAL_INSERT' when insert_bp is not null and pos_link < 0 then 'CARRYOVER' else 'CHECK' end"""
    levels = ", ".join(f"('{k}', '{v}')" for k, v in control.CONTROL_LEVELS.items())
    base = "regexp_extract(path, '[^/\\\\]*$')"
    channels = ", ".join(f"round(1000 * abs(embedding[4 * p + {j}]))" for j in range(1, 5))
    return {
        "synthetic_reads": f"with reads as ({reads_sql(DUCK, 'orders')}) select ord, id, batch, raw_seq, cast(list_sum(raw_qual) as bigint) as q_sum from reads",
        "read_names": f"with reads as ({reads_sql(DUCK, 'orders')}), paths as (select filename as path from reads union all select url from pages) select path, {base} as base, regexp_replace({base}, '\\.[^.]*$', '') as stem from paths",
        "orientation": f"with {_turned()} select ord, direction, md5(whole) as turned from turned",
        "quality_trim": f"with {_trimmed()} select ord, cast(lo as integer) as trim_lo, cast(hi as integer) as trim_hi, cast(length(seq) as integer) as used_bp from used",
        "motif_positions": f"with {_sites()} select ord, " + ", ".join(f"cast({p}_{k} as integer) as {p}_{k}" for k in ("notI", "link", "ascI") for p in ("n", "pos", "mm")) + " from sites",
        "insert_distances": f"with {_sites()} select ord, cast(insert_bp as integer) as insert_bp, cast(insert_bp % 3 as integer) as frame, cast(d1 as integer) as d1, cast(d2 as integer) as d2 from sites",
        "translation": f"with {_proteins()} select ord, cast(orf_start as integer) as orf_start, prot, cast(length(prot) as integer) as aa_len, stop_ok from prots",
        "cdr3_lengths": f"""with {_proteins()}, heads as (select regexp_extract(case when strpos(prot, '{LINKER_PROTEIN}') > 0 then substr(prot, 1, strpos(prot, '{LINKER_PROTEIN}') - 1) else prot end, '^(.*)WG.G', 1) as head from prots),
          found as (select regexp_extract(head, '[^C]*$') as cdr3 from heads where contains(head, 'C'))
          select cast(length(cdr3) as integer) as cdr3_len, count(*) as n, count(distinct cdr3) as n_distinct from found group by 1""",
        "tandem_repeats": f"with {_sites()}, {_repeats()} select ord, cast(pos as integer) as pos, cast(period as integer) as period, unit, region from repeats",
        "trace_mixing": f"""with peaks as (select vec_id as id, list_transform(range(16), lambda p: list_reverse_sort([{channels}])) as v from embeddings),
          rates as (select id, list_transform(list_filter(v, lambda x: x[1] > 0), lambda x: x[2] / x[1]) as r from peaks)
          select id, case when len(r) > 0 then 100.0 * len(list_filter(r, lambda x: x > {t['mix_ratio']})) / len(r) end as mix_pct, case when len(r) > 0 then cast(len(r) as integer) end as mix_n from rates""",
        "primer_groups": f"with {table} select grp, chain, count(*) as n, min(cast(length(core) as integer)) as core_min, max(cast(length(core) as integer)) as core_max, cast(any_value(core_trim) as integer) as core_trim from panel group by grp, chain",
        "primer_pairs": f"""with {table}, pairs as (select a.grp, a.chain, a.name as a, b.name as b, least(len(a.masks), len(b.masks)) as n, list_sort(list_distinct(a.families || b.families)) as fams, length(a.core) <> length(b.core) as truncated,
            len(list_filter(range(least(len(a.masks), len(b.masks))), lambda j: (a.masks[j + 1] & b.masks[j + 1]) = 0)) as k from panel a join panel b on a.grp = b.grp and a.chain = b.chain and a.ord < b.ord)
          select grp, chain, a, b, cast(n as integer) as cmp_len, cast(k as integer) as incompatible, case when k <= {tied} then 'certain' else 'split' end as tie, len(fams) = 1 as same_family, truncated, array_to_string(fams, '|') as families from pairs where k <= {2 * tied}""",
        "call_rows": f"with {_called()} select ord, key, cast(mm as integer) as mm, cast(delta as integer) as delta, names, array_to_string(fams, '|') as families, chain, cast(start as integer) as start, ok from calls",
        "family_tally": f"""with {_called()}, rows_ as (select ord, key, {label} as label from calls where ok union all select ord, 'chain', sure from vl where sure is not null),
          counted as (select key, label, count(*) as n, min(ord) as first from rows_ group by key, label)
          select key, label, n, cast(row_number() over (partition by key order by n desc, first) as integer) as rank from counted""",
        "growing_tally": f"""with {_called()}, rows_ as (select ord, batch, key, {label} as label from calls where ok union all select ord, batch, 'chain', sure from vl where sure is not null),
          counted as (select batch, key, label, count(*) as n, min(ord) as first from rows_ group by batch, key, label)
          select cast(batch as varchar) as batch, key, label, n, cast(row_number() over (partition by batch, key order by n desc, first, label) as integer) as rank from counted""",
        "family_species": f"""with {_called()}, fam as (select key, n_names, unnest(fams) as family from calls where ok), sets as (select key, count(distinct family) filter (n_names = 1) as certain, count(distinct family) as possible from fam group by key),
          only_ as (select key, string_agg(family, '|' order by family) as only_ties from (select key, family from fam group by key, family having count(*) filter (n_names = 1) = 0) group by key),
          ns as (select key, count(*) as n, count(*) filter (n_names > 1) as n_ties from calls where ok group by key)
          select k.key, coalesce(n, 0) as n, coalesce(n_ties, 0) as n_ties, cast(coalesce(certain, 0) as integer) as species_certain, cast(coalesce(possible, 0) as integer) as species_possible, coalesce(only_ties, '') as only_ties
          from {keys} left join ns on k.key = ns.key left join sets on k.key = sets.key left join only_ on k.key = only_.key""",
        "panel_coverage": f"""with {_called()}, seen as (select distinct grp, chain, unnest(string_split(names, ',')) as name from calls where ok), ns as (select grp, chain, count(*) as n from calls where ok group by grp, chain),
          every(ord, name, grp, chain) as (values {scored}), sums as (select e.grp, e.chain, count(*) as total_n, count(s.name) as observed, coalesce(string_agg(e.name, ',' order by e.ord) filter (s.name is null), '') as unobserved
            from every e left join seen s on e.grp = s.grp and e.chain = s.chain and e.name = s.name group by e.grp, e.chain)
          select s.grp, s.chain, coalesce(n, 0) as n, total_n, observed, unobserved, round(pow(1 - 1.0 / total_n, coalesce(n, 0)), 9) as power_p, pow(1 - 1.0 / total_n, coalesce(n, 0)) >= 0.05 as underpowered from sums s left join ns on s.grp = ns.grp and s.chain = ns.chain""",
        "batch_families": f"with {_called()} select batch, {label} as label, count(*) as n from calls where key = 'vh' and ok group by grouping sets ((batch, {label}), ({label}))",
        "control_verdicts": f"with {_sites()}, facts as materialized (select n_notI, n_link, n_ascI, pos_notI, pos_link, pos_ascI, stuffer, insert_bp from sites), judged as (select {verdict} as verdict, count(*) as n from facts group by 1), every(verdict, level) as (values {levels}) select e.verdict, coalesce(n, 0) as n, level from every e left join judged j on e.verdict = j.verdict",
        "insert_fingerprints": f"with {_sites()} select md5(substr(seq, pos_notI + 1, insert_bp)) as insert_md5, count(*) as n, min(ord) as first_ord from sites where insert_bp is not null group by 1",
        "natural_order": f"with reads as ({reads_sql(DUCK, 'orders')}) select id, row_number() over (order by cast(regexp_extract(id, '^VH([0-9]+)', 1) as bigint), cast(regexp_extract(id, '_([0-9]+)$', 1) as bigint), ord) as place from reads",
        "csv_export": f"with {_sites()} select ord, concat_ws(',', id, direction, length(seq), pos_notI, pos_link, pos_ascI) as csv_line from sites union all select -1, 'clone,dir,used,NotI,linker,AscI'",
    }


ORACLE_SQL = _oracle()
