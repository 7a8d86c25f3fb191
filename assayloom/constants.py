"""Fixed values of the assay: sequences, rules, thresholds and the texts of reports."""

from __future__ import annotations

# --- fixed values: sequences of the cassette -------------------------------------------------
NOTI = "GCGGCCGC"
ASCI = "GGCGCGCC"
PELB_ATG = "ATGAAATACCTATTGCCTACG"
QC1 = "GCTCAACCCGCAATGGCGGCCGCA"
QC2 = "GGTGGCGGAGGGTCTGGAGGTGGGGGCTCAGGGGGCGGTGGATCC"
QC3 = "GGCGCGCCTGCGCACCATCACCATCACCATGGC"
QC4 = "GATTACAAAGACCATGACGGAGACTACAAGGACCATGATATCGACTATAAGGATGATGATGACAAATAG"
STUFFER = "GGCTTTAATATCAAAGACACGTACATTCATTGG"
STUFFER_INSERT_BP = 386
TAG_F1_FOR = "CGCAATGGCGGCCGC"
TAG_F2_REV = "GGATCCACCGCCCCC"
TAG_F3_FOR = "TCAGGGGGCGGTGGATCC"
TAG_F3_REV = "GTGCGCAGGCGCGCC"
MOTIF_F1_REV = "ACAGTAATA"
MOTIF_F2_FOR = "TATTACTGT"
FR4_MOTIF = "WG.G"
FRAME_MOD = 2
LANDMARKS = {"QC1": QC1, "QC2": QC2, "QC3": QC3, "QC4": QC4}
#: Sequences whose presence tells the reading direction.
ANCHORS = (PELB_ATG, QC1, NOTI, QC2, ASCI, QC3)

# --- fixed values: rules ---------------------------------------------------------------------
ALIGN_MATCH, ALIGN_MISMATCH, ALIGN_GAP, ALIGN_FLANK = 1, -1, -2, 12
REPEAT_MAX_PERIOD = 60
EXO_TRIM = 3
OVERLONG_ZONE = 5
LANDMARK_LOW_Q = 20
COVERAGE_ALPHA = 0.05
FLAG_SEVERITY = {
    "CONCATEMER": 3, "PARENTAL": 3, "NO_NOTI": 3, "NO_ASCI": 3, "NO_LINKER": 3, "TOO_SHORT": 3, "TOO_LONG": 3,
    "FRAMESHIFT": 3, "INTERNAL_STOP": 3, "LINKER_DEL": 3, "QC_DEL": 3, "QC_ABSENT": 3, "ABERRANT_D1": 3,
    "ABERRANT_D2": 3, "TANDEM_REPEAT": 3, "MIXED": 3,
    "LONG_INSERT?": 2, "LOW_COVERAGE": 2, "PARENTAL?": 2, "AMBIG_FAMILY?": 2, "AMBIG_CALL?": 2,
    "QC_WARN": 1,
}

# --- fixed values: thresholds and design, with defaults ---------------------------------------
THRESHOLDS = {
    "trim_q": 20, "trim_win": 20, "insert_min": 685, "insert_max": 840, "d1_min": 340, "d1_max": 440,
    "d2_min": 295, "d2_max": 345, "lm_max_sub": 2, "lm_gap_warn": 1, "lm_gap_fail": 2, "mix_ratio": 0.35,
    "mix_pct": 8.0, "repeat_min_len": 15, "primer_max_mismatch": 2, "primer_margin_min": 0,
    "pos_max_mismatch": 2, "pos_miscall_q": 20,
}
NOT_SPECIFIED = "(지정 안 함)"
SEPARATE = "분리"
ASSIGNED, LIBRARY, NEGCTRL = "assigned", "library", "negctrl"
DESIGN = {
    "analysis_mode": ASSIGNED, "f1_for_mode": SEPARATE, "f1_rev_mode": SEPARATE, "f2_for_mode": SEPARATE,
    "f2_rev_mode": "pool", "f3_for_mode": SEPARATE, "f3_rev_mode": "pool", "f3_product_pooled": True,
    "batch_vh_family": NOT_SPECIFIED, "batch_chain": NOT_SPECIFIED, "cdna_frag1": "oligo(dT)",
    "cdna_frag2": "oligo(dT)", "cdna_frag3": "oligo(dT)", "rna_frag1": "Bone marrow",
    "rna_frag2": "Bone marrow", "rna_frag3": "Bone marrow",
}
#: Design keys that decide verdicts; they alone enter the design fingerprint.
JUDGED_DESIGN = ("analysis_mode", "batch_vh_family", "batch_chain", "f1_for_mode", "f2_for_mode")
CONFIG_ERRORS = {
    "insert": "인서트 길이 하한 >= 상한",
    "d1": "d1 하한 >= 상한",
    "d2": "d2 하한 >= 상한",
    "gap": "랜드마크 갭 WARN > FAIL",
    "window": "트리밍 창 크기가 1 미만",
}

# --- fixed values: alphabets -----------------------------------------------------------------
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
COMPLEMENT = ("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")
#: The standard code; first, second and third base each run through TCAG.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Amino acids of a degenerate codon that has exactly these two readings.
AMBIGUOUS_AMINO_ACIDS = {"DN": "B", "EQ": "Z", "IL": "J"}

# --- fixed values: primer groups -------------------------------------------------------------
ANALYSIS_GROUPS = ("F1_For", "F1_Rev", "F2_For", "F2_Rev", "F3_For", "F3_Rev")
SCORED_GROUPS = ("F1_For", "F2_Rev", "F3_For", "F3_Rev")
#: Calls of a clone: key, primer group, label in reports.
CALLED_GROUPS = (("vh", "F1_For", "VH family"), ("jh", "F2_Rev", "JH"), ("vl", "F3_For", "VL V-gene"), ("vj", "F3_Rev", "VL J-gene"))

# --- fixed values: negative controls ----------------------------------------------------------
CONTROL_LEVELS = {
    "CONCATEMER": "check", "MIXED": "check", "EMPTY_VECTOR": "none", "PARENTAL": "check", "PARENTAL?": "check",
    "CONTAMINATED": "fail", "CONTAMINATED?": "fail", "PARTIAL_INSERT": "check", "CARRYOVER": "check", "CHECK": "check",
}

# --- fixed values: headers of reports ---------------------------------------------------------
SUMMARY_HEADERS = [
    "clone", "batch", "date", "primer", "dir", "최종판정", "구조QC", "프라이머플래그", "사용길이(bp)", "인서트(bp)",
    "프레임(%3)", "d1(bp)", "d2(bp)", "QC1", "QC2", "QC3", "QC4", "내부종결", "스터퍼", "탠덤반복", "혼합(%)",
    "VH family", "JH", "경쇄", "VL-V family", "VL-J", "CDR3-H3", "CDR3-H3(aa)", "CDR3경계", "param_hash",
    "이상 랜드마크 최저Q", "최저Q 랜드마크",
]
STRUCTURE_HEADERS = [
    "clone", "구조QC", "플래그", "원본길이(bp)", "트리밍구간", "사용길이(bp)", "NotI위치", "NotI개수", "링커위치",
    "링커개수", "AscI위치", "AscI개수", "인서트(bp)", "프레임(%3)", "d1(bp)", "d2(bp)",
    *[q + x for q in ("QC1", "QC2", "QC3", "QC4") for x in ("상태", "치환", "갭", "최저Q")],
    "번역길이(aa)", "내부종결", "스터퍼", "탠덤반복구간", "탠덤반복주기(nt)", "탠덤반복단위", "혼합(%)", "검사위치수",
    "위치탐색", "비고",
]
CALL_HEADERS = [
    "clone", "그룹", "대상", "판정 family", "후보 프라이머", "후보수", "미스매치", "Δ(차순위간격)", "판별구간(nt)",
    "불일치위치(1-based)", "read상 시작위치", "허용 미스매치", "통과", "모호성",
]
SECTION_HEADERS = ["구분", "항목", "값", "비고"]
SEQUENCE_HEADERS = ["clone", "최종판정", "인서트 길이(bp)", "인서트 염기서열 (NotI~AscI)", "scFv 길이(aa)", "scFv 아미노산 서열", "CDR3-H3"]
CONTROL_HEADERS = ["clone", "판정", "근거", "인서트(bp)", "인서트 md5", "NotI위치", "링커위치", "AscI위치", "스터퍼", "프레임(%3)"]
CONTROL_SEQUENCE_HEADERS = ["clone", "판정", "인서트 길이(bp)", "인서트 염기서열 (NotI~AscI)", "인서트 md5"]
CONFIG_HEADERS = ["구분", "항목", "값", "기본값", "기본값과 동일", "설명"]
GLOSSARY_HEADERS = ["분류", "용어", "뜻"]
SHEETS = ["01_판정요약", "02_구조QC상세", "03_프라이머판별", "04_배치조성", "05_실행설정", "06_용어설명", "07_서열"]
CONTROL_SHEETS = ["01_대조군판정", "02_구조QC상세", "03_대조군요약", "04_실행설정", "05_용어설명", "06_서열"]
