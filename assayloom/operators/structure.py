"""Structural quality control of clones: one narrow stage of expressions over reads, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QcConfig
from ..constants import ASCI, FLAG_SEVERITY, FRAME_MOD, LANDMARKS, NOTI, PELB_ATG, QC1, QC2, QC3, QC4, STUFFER, STUFFER_INSERT_BP
from ..functions import sequences as S

#: Names of the sites that are located, in the order of reports, with the label that reports use.
SITES = {"pelB": "pelB", "notI": "NotI", "link": "링커", "ascI": "AscI", "stuffer": "스터퍼"}
LANDMARK = "struct<sub:int,gap:int,pos:int,minq:int,status:string,level:string>"

# --- fixed values: the texts of notes ---------------------------------------------------------
NOTES = {
    "concatemer": "NotI %d / AscI %d / 링커 %d 회 검출 (각 1 회여야 함)",
    "parental": "모클론 스터퍼 서열 검출 (미절단/단일절단 벡터)",
    "landmark": "%s %s (치환 %d, 갭 %d%s)",
    "landmark_warn": " - 크로마토그램 확인 권장",
    "landmark_q": ", 최저 Q %d",
    "landmark_na": " 는 read 범위 밖이라 판단 불가",
    "no_noti": "NotI 미검출",
    "no_asci": "AscI 미검출 (VL 구간이 충분히 읽혔는데도 없음)",
    "long_insert": "AscI 미검출 + 3' 커버리지 부족. 인서트가 길거나 read 가 짧음 -> 역방향 시퀀싱 권고",
    "no_linker": "링커 미검출",
    "too_short": "인서트 %d bp (하한 %d 미만)",
    "too_long": "인서트 %d bp (상한 %d 초과)",
    "frameshift": "인서트 %d bp, %%3 = %d (유지 조건 %d)",
    "parental_length": (
        "인서트 길이가 스터퍼 보유 클론과 같음 (%d bp). 스터퍼 서열은 검출되지 않았으므로 확정이 아님 - read 앞쪽 품질 저하로 놓쳤을 "
        "수 있고, 우연히 같은 길이인 다른 산물일 수도 있음. 크로마토그램 확인 권장"
    ),
    "d1": "d1 %d bp (범위 %d~%d 밖) - VH 구간 이상",
    "d2": "d2 %d bp (범위 %d~%d 밖) - VL 구간 이상",
    "stop": "AscI 이전에 종결코돈 (번역 %d aa 에서 중단)",
    "tandem": "%s 구간에 %d nt 탠덤 반복 (%s) - PCR slipped-strand 산물 의심",
    "mixed": "2순위 피크 비율 %.2f 초과 위치가 %.1f%% (임계 %.1f%%) - 혼합 콜로니 의심",
}


def oriented(reads: DataFrame, cfg: QcConfig) -> DataFrame:
    """reads with direction, trim_lo, trim_hi and the read turned and trimmed: seq, qual, used_bp."""
    has_q = F.coalesce(F.size("raw_qual") > 0, F.lit(False))
    empty = F.array().cast("array<int>")
    x = reads.withColumn("window", S.oriented_window(F.col("raw_seq"), F.when(has_q, F.col("raw_qual")).otherwise(empty), cfg["trim_q"], cfg["trim_win"]))
    back = F.col("window.back")
    x = x.withColumns(
        {
            "direction": F.when(back, "R").otherwise("F"),
            "whole": F.when(back, S.reverse_complement(F.col("raw_seq"))).otherwise(F.col("raw_seq")),
            "whole_q": F.when(~has_q, empty).when(back, F.reverse("raw_qual")).otherwise(F.col("raw_qual")),
        }
    )
    x = x.withColumns({"trim_lo": F.col("window.lo"), "trim_hi": F.col("window.hi")})
    size = F.col("trim_hi") - F.col("trim_lo")
    x = x.withColumns({"seq": F.substring("whole", F.col("trim_lo") + 1, size), "qual": F.slice("whole_q", F.col("trim_lo") + 1, size)})
    return x.withColumn("used_bp", F.length("seq")).drop("whole", "whole_q", "window")


def located(x: DataFrame, cfg: QcConfig) -> DataFrame:
    """Counts of exact sites and positions of all sites; each of NotI, linker, AscI is sought after the one before it."""
    seq = F.col("seq")
    motifs = {"notI": (NOTI, None), "link": (QC2, "notI"), "ascI": (ASCI, "link"), "stuffer": (STUFFER, None), "pelB": (PELB_ATG, None)}
    x = x.withColumns({f"n_{k}": S.count_motif(seq, m) for k, m in (("notI", NOTI), ("ascI", ASCI), ("link", QC2))})
    x = x.withColumn("hit", S.find_sites(seq, F.col("qual"), motifs, cfg["pos_max_mismatch"], cfg["pos_miscall_q"]))
    x = x.withColumns({f"pos_{k}": F.col(f"hit.{k}.pos") for k in ("notI", "link", "ascI")} | {"stuffer": F.col("hit.stuffer.pos") >= 0, "orf_start": F.col("hit.pelB.pos")})
    approx = F.create_map(*[v for k in SITES for v in (F.lit(k), F.struct(F.col(f"hit.{k}.mm").alias("mm"), F.col(f"hit.{k}.q").alias("q")))])
    return x.withColumn("pos_approx", approx).drop("hit")


def judged_landmark(name: str, covered: Column, cfg: QcConfig, near: Column, exact: Column, qual: Column) -> Column:
    """The state of one landmark: exact, or by its best placement `near`; NA where the read doesn't cover it."""
    size, sub, gap = len(LANDMARKS[name]), near["sub"], near["gap"]
    make = lambda s, g, p, status, level: F.struct(s.cast("int").alias("sub"), g.cast("int").alias("gap"), p.cast("int").alias("pos"), status.alias("status"), level.alias("level"))
    zero, ok, fail = F.lit(0), F.lit("OK"), F.lit("FAIL")
    state = (
        F.when(~covered, make(zero, zero, F.lit(-1), F.lit("NA"), F.lit("NA")))
        .when(exact >= 0, make(zero, zero, exact, ok, ok))
        .when(near["pos"] < 0, make(F.lit(size), zero, F.lit(-1), F.lit("ABSENT"), fail))
        .when(~near["aligned"], make(sub, zero, near["pos"], ok, ok))
        .when(gap >= cfg["lm_gap_fail"], make(sub, gap, near["pos"], F.concat(F.lit("GAP"), gap.cast("string")), fail))
        .when(sub + gap > cfg["lm_max_sub"] + cfg["lm_gap_fail"], make(sub, gap, near["pos"], F.lit("ABSENT"), fail))
        .when((gap >= cfg["lm_gap_warn"]) | (sub > cfg["lm_max_sub"]), make(sub, gap, near["pos"], F.concat(F.lit("S"), sub.cast("string"), F.lit("G"), gap.cast("string")), F.lit("WARN")))
        .otherwise(make(sub, gap, near["pos"], ok, ok))
    )
    minq = F.when((exact < 0) & covered & (near["pos"] >= 0) & (F.size(qual) > 0), F.array_min(F.slice(qual, near["pos"] + 1, F.lit(size))))
    fields = lambda s: F.struct(s["sub"].alias("sub"), s["gap"].alias("gap"), s["pos"].alias("pos"), minq.cast("int").alias("minq"), s["status"].alias("status"), s["level"].alias("level"))
    return F.get(F.transform(F.array(state), fields), 0).cast(LANDMARK)


def with_landmarks(x: DataFrame, cfg: QcConfig) -> DataFrame:
    """qc: the four landmarks, each over the whole read; only reads without the exact landmark reach the Arrow UDF."""
    n = F.length("seq")
    after = F.col("pos_ascI") + len(QC3)
    covered = {
        "QC1": (F.col("pos_notI") >= 0) & (F.col("pos_notI") >= QC1.find(NOTI)),
        "QC2": F.lit(True),
        "QC3": (F.col("pos_ascI") >= 0) & (after <= n),
        "QC4": (F.col("pos_ascI") >= 0) & (after + len(QC4) <= n),
    }
    x = x.withColumns({f"cov_{k}": v for k, v in covered.items()} | {f"exact_{k}": S.find(F.col("seq"), m) for k, m in LANDMARKS.items()})
    x = x.withColumns({f"near_{k}": S.near_landmarks(k, cfg["lm_max_sub"])(F.when(F.col(f"cov_{k}") & (F.col(f"exact_{k}") < 0), F.col("seq"))) for k in LANDMARKS})
    qc = F.struct(*[judged_landmark(k, F.col(f"cov_{k}"), cfg, F.col(f"near_{k}"), F.col(f"exact_{k}"), F.col("qual")).alias(k) for k in LANDMARKS])
    return x.withColumn("qc", qc).drop(*[f"{p}_{k}" for p in ("cov", "exact", "near") for k in LANDMARKS])


def measured(x: DataFrame, cfg: QcConfig) -> DataFrame:
    """Insert length and distances, protein and stop, tandem repeat, mixed peaks."""
    n, l, a = F.col("pos_notI"), F.col("pos_link"), F.col("pos_ascI")  # noqa: E741
    x = x.withColumns(
        {
            "insert_bp": F.when((n >= 0) & (a > n), a + len(ASCI) - n).cast("int"),
            "d1": F.when((n >= 0) & (l > n), l - n).cast("int"),
            "d2": F.when((l >= 0) & (a > l), a - l - len(QC2)).cast("int"),
            "full": F.when(F.col("orf_start") >= 0, S.translate(F.substring("seq", F.col("orf_start") + 1, F.length("seq")))),
        }
    )
    stop = F.instr("full", "*") - 1
    x = x.withColumn("stop_at", stop)
    reaches = F.col("orf_start") + F.col("stop_at") * 3 >= a
    x = x.withColumns(
        {
            "prot": F.coalesce(F.when(F.col("stop_at") >= 0, F.substring("full", F.lit(1), F.col("stop_at"))).otherwise(F.col("full")), F.lit("")),
            "stop_ok": F.when(F.col("full").isNotNull() & (F.col("stop_at") < 0), True).when((F.col("stop_at") >= 0) & (a >= 0), reaches),
        }
    )
    x = x.withColumn("aa_len", F.length("prot"))
    between = lambda lo, hi: F.when((lo >= 0) & (hi > lo), F.substring("seq", lo + 1, hi - lo))
    x = x.withColumns({"vh_seq": between(n, l), "vl_seq": between(F.when(l >= 0, l + len(QC2)).otherwise(-1), a)})
    x = x.withColumns({"rep_vh": S.find_tandem(F.col("vh_seq"), cfg["repeat_min_len"]), "rep_vl": S.find_tandem(F.col("vl_seq"), cfg["repeat_min_len"])})
    named = lambda c, region: F.when(c.isNotNull(), F.struct(c["pos"].alias("pos"), c["period"].alias("period"), c["unit"].alias("unit"), F.lit(region).alias("region")))
    x = x.withColumn("repeat", F.coalesce(named(F.col("rep_vh"), "VH"), named(F.col("rep_vl"), "VL")))
    back, size = F.col("direction") == "R", F.length("raw_seq")
    lo, hi = F.when(back, size - F.col("trim_hi")).otherwise(F.col("trim_lo")), F.when(back, size - F.col("trim_lo")).otherwise(F.col("trim_hi"))
    if {"trace", "ploc"} <= set(x.columns):
        keys = F.sort_array(F.map_keys("trace"))
        channels = [F.try_element_at("trace", F.get(keys, i)) for i in range(4)]
        x = x.withColumn("mix", F.when(F.size(keys) == 4, S.trace_purity(channels, F.col("ploc"), lo, hi, cfg["mix_ratio"])))
    else:
        x = x.withColumn("mix", F.lit(None).cast("struct<pct:double,n:int>"))
    x = x.withColumns({"mix_pct": F.col("mix.pct"), "mix_n": F.col("mix.n")})
    return x.drop("full", "stop_at", "vh_seq", "vl_seq", "rep_vh", "rep_vl", "mix")


def flagged(x: DataFrame, cfg: QcConfig) -> DataFrame:
    """flags and notes in the order of the checks, severity and verdict."""
    n, l, a, ins = F.col("pos_notI"), F.col("pos_link"), F.col("pos_ascI"), F.col("insert_bp")  # noqa: E741
    note = lambda key, *args: F.format_string(NOTES[key], *args)
    plain = lambda key: F.lit(NOTES[key])
    found: list[tuple[Column, Column | None, Column | None]] = [
        (F.greatest("n_notI", "n_ascI", "n_link") > 1, F.lit("CONCATEMER"), note("concatemer", "n_notI", "n_ascI", "n_link")),
        (F.col("stuffer"), F.lit("PARENTAL"), plain("parental")),
    ]
    for k in LANDMARKS:
        q = F.col(f"qc.{k}")
        absent = q["status"] == "ABSENT"
        flag = F.when(absent, "NO_LINKER").otherwise("LINKER_DEL") if k == "QC2" else F.when(absent, "QC_ABSENT").otherwise("QC_DEL")
        tail = F.coalesce(F.format_string(NOTES["landmark_q"], q["minq"]), F.lit(""))
        tail = F.when(q["minq"].isNull(), "").otherwise(tail)
        text = note("landmark", F.lit(k), q["status"], q["sub"], q["gap"], tail)
        found += [
            (q["level"] == "FAIL", flag, text),
            (q["level"] == "WARN", F.lit("QC_WARN"), F.concat(text, plain("landmark_warn"))),
            (q["level"] == "NA", F.lit("LOW_COVERAGE"), F.concat(F.lit(k), plain("landmark_na"))),
        ]
    read_on = (l >= 0) & (F.length("seq") - l - len(QC2) >= cfg["d2_max"])
    linker_gone = (F.col("qc.QC2.level") == "FAIL") & (F.col("qc.QC2.status") == "ABSENT")
    has = ins.isNotNull()
    found += [
        (n < 0, F.lit("NO_NOTI"), plain("no_noti")),
        ((a < 0) & read_on, F.lit("NO_ASCI"), plain("no_asci")),
        ((a < 0) & ~read_on, F.lit("LONG_INSERT?"), plain("long_insert")),
        ((l < 0) & ~linker_gone, F.lit("NO_LINKER"), plain("no_linker")),
        (has & (ins < cfg["insert_min"]), F.lit("TOO_SHORT"), note("too_short", ins, F.lit(cfg["insert_min"]))),
        (has & (ins > cfg["insert_max"]), F.lit("TOO_LONG"), note("too_long", ins, F.lit(cfg["insert_max"]))),
        (has & (ins % 3 != FRAME_MOD), F.lit("FRAMESHIFT"), note("frameshift", ins, ins % 3, F.lit(FRAME_MOD))),
        (has & ~F.col("stuffer") & (ins == STUFFER_INSERT_BP), F.lit("PARENTAL?"), note("parental_length", F.lit(STUFFER_INSERT_BP))),
        (~F.col("d1").between(cfg["d1_min"], cfg["d1_max"]), F.lit("ABERRANT_D1"), note("d1", "d1", F.lit(cfg["d1_min"]), F.lit(cfg["d1_max"]))),
        (~F.col("d2").between(cfg["d2_min"], cfg["d2_max"]), F.lit("ABERRANT_D2"), note("d2", "d2", F.lit(cfg["d2_min"]), F.lit(cfg["d2_max"]))),
        (~F.col("stop_ok"), F.lit("INTERNAL_STOP"), note("stop", "aa_len")),
        (F.col("repeat").isNotNull(), F.lit("TANDEM_REPEAT"), note("tandem", "repeat.region", "repeat.period", "repeat.unit")),
        (F.col("mix_pct") > cfg["mix_pct"], F.lit("MIXED"), note("mixed", F.lit(float(cfg["mix_ratio"])), "mix_pct", F.lit(float(cfg["mix_pct"])))),
    ]
    x = x.withColumns(
        {
            "flags": F.array_distinct(F.array_compact(F.array(*[F.when(c, f) for c, f, _ in found]))),
            "notes": F.array_compact(F.array(*[F.when(c, t) for c, _, t in found])),
        }
    )
    level = F.create_map(*[F.lit(v) for kv in FLAG_SEVERITY.items() for v in kv])
    severity = lambda f: F.coalesce(F.try_element_at(level, f), F.lit(0))
    x = x.withColumn("severity", F.coalesce(F.array_max(F.transform("flags", severity)), F.lit(0)))
    first = F.get(F.filter("flags", lambda f: severity(f) == F.col("severity")), 0)
    na = F.lit(False)
    for k in LANDMARKS:
        na = na | (F.col(f"qc.{k}.level") == "NA")
    verdict = F.when(F.col("severity") >= 2, first).when(F.col("severity") == 1, "WARN").when(na, "PASS*").otherwise("PASS")
    return x.withColumn("verdict", verdict)


def structural_qc(reads: DataFrame, cfg: QcConfig) -> DataFrame:
    """reads (id, raw_seq, raw_qual, optional trace and ploc, ...) with every structural result; one row for each read.

    An empty or null raw_qual means no trimming, and that any mismatch counts as misread when sites are located.
    """
    return flagged(measured(with_landmarks(located(oriented(reads, cfg), cfg), cfg), cfg), cfg)


def insert_sequence() -> Column:
    """NotI to AscI of a QC row; empty unless AscI follows NotI."""
    n, a = F.col("pos_notI"), F.col("pos_ascI")
    return F.when((n >= 0) & (a > n), F.substring("seq", n + 1, a + len(ASCI) - n)).otherwise("")


def insert_md5() -> Column:
    return F.when(F.length(insert_sequence()) > 0, F.md5(insert_sequence())).otherwise("")


def landmark_quality() -> Column:
    """struct(anomalies, worst_minq, worst_lm, all_minq) of a QC row; the first landmark wins a tie."""
    every = F.array(*[F.struct(F.lit(k).alias("lm"), F.lit(i).alias("ord"), F.col(f"qc.{k}.status").alias("status"), F.col(f"qc.{k}.sub").alias("sub"), F.col(f"qc.{k}.gap").alias("gap"), F.col(f"qc.{k}.minq").alias("minq")) for i, k in enumerate(LANDMARKS)])
    odd = F.filter(every, lambda x: ~x["status"].isin("OK", "NA"))
    worst = F.array_min(F.transform(F.filter(odd, lambda x: x["minq"].isNotNull()), lambda x: F.struct(x["minq"].alias("minq"), x["ord"].alias("ord"), x["lm"].alias("lm"))))
    return F.struct(odd.alias("anomalies"), worst["minq"].alias("worst_minq"), worst["lm"].alias("worst_lm"), F.array_min(F.transform(every, lambda x: x["minq"])).alias("all_minq"))
