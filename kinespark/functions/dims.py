"""Literal dimension tables.

All names, orders and candidate lists below are FIXED VALUES: results must use
exactly these strings, so they are stated plainly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[object]]) -> DataFrame:
    """A table of constants written in the code. Its size is known to the
    optimizer, which then picks the join strategy by that size."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


# The 20 body joints, in order.
BODY20 = [
    "neck", "mid_hip",
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
    "left_heel", "right_heel", "left_small_toe", "right_small_toe", "left_big_toe", "right_big_toe",
]

# Basic joints and their marker candidates, best first.
BASIC_ALIASES = {
    "left_hip": ["L_HJC", "L_HJC_reg"],
    "right_hip": ["R_HJC", "R_HJC_reg"],
    "left_knee": ["L_knee"],
    "right_knee": ["r_knee"],
    "left_ankle": ["L_ankle"],
    "right_ankle": ["r_ankle"],
    "left_heel": ["L_calc"],
    "right_heel": ["r_calc"],
    "left_big_toe": ["L_toe"],
    "right_big_toe": ["r_toe"],
}

# Basic joints of the short-label mocap set.
SHORT_LABEL_ALIASES = {
    "left_hip": ["left_hip", "LASI"],
    "right_hip": ["right_hip", "RASI"],
    "left_knee": ["left_knee", "LKNE"],
    "right_knee": ["right_knee", "RKNE"],
    "left_ankle": ["left_ankle", "LANK"],
    "right_ankle": ["right_ankle", "RANK"],
    "left_heel": ["left_heel", "LHEE"],
    "right_heel": ["right_heel", "RHEE"],
    "left_big_toe": ["left_big_toe", "LTOE"],
    "right_big_toe": ["right_big_toe", "RTOE"],
}

# Anatomical targets and their candidates in the enhanced set.
ENHANCED_ALIASES = {
    "r_knee": ["r_knee_study", "r_knee"],
    "r_ankle": ["r_ankle_study", "r_ankle"],
    "r_calc": ["r_calc_study", "r_calc"],
    "r_5meta": ["r_5meta_study", "r_5meta"],
    "r_toe": ["r_toe_study", "r_toe"],
    "L_knee": ["L_knee_study", "L_knee"],
    "L_shank_antsup": ["L_sh1_study", "L_shank_antsup"],
    "L_ankle": ["L_ankle_study", "L_ankle"],
    "L_calc": ["L_calc_study", "L_calc"],
    "L_5meta": ["L_5meta_study", "L_5meta"],
    "L_toe": ["L_toe_study", "L_toe"],
    "r_sh2": ["r_sh2_study", "r_sh2"],
    "r_sh3": ["r_sh3_study", "r_sh3"],
    "L_sh2": ["L_sh2_study", "L_sh2"],
    "L_sh3": ["L_sh3_study", "L_sh3"],
    "r_thigh1": ["r_thigh1_study", "r_thigh1"],
    "r_thigh2": ["r_thigh2_study", "r_thigh2"],
    "r_thigh3": ["r_thigh3_study", "r_thigh3"],
    "L_thigh1": ["L_thigh1_study", "L_thigh1"],
    "L_thigh2": ["L_thigh2_study", "L_thigh2"],
    "L_thigh3": ["L_thigh3_study", "L_thigh3"],
    "r.ASIS": ["r.ASIS_study", "r.ASIS"],
    "r.PSIS": ["r.PSIS_study", "r.PSIS"],
    "L.ASIS": ["L.ASIS_study", "L.ASIS"],
    "L.PSIS": ["L.PSIS_study", "L.PSIS"],
    "C7": ["C7_study", "C7"],
    "R_Shoulder": ["r_shoulder_study", "R_Shoulder"],
    "L_Shoulder": ["L_shoulder_study", "L_Shoulder"],
    "R_elbow_med": ["r_melbow_study", "R_elbow_med"],
    "R_elbow_lat": ["r_lelbow_study", "R_elbow_lat"],
    "R_wrist_radius": ["r_lwrist_study", "R_wrist_radius"],
    "R_wrist_ulna": ["r_mwrist_study", "R_wrist_ulna"],
    "L_elbow_med": ["L_melbow_study", "L_elbow_med"],
    "L_elbow_lat": ["L_lelbow_study", "L_elbow_lat"],
    "L_wrist_radius": ["L_lwrist_study", "L_wrist_radius"],
    "L_wrist_ulna": ["L_mwrist_study", "L_wrist_ulna"],
    "R_HJC": ["RHJC_study", "R_HJC"],
    "L_HJC": ["LHJC_study", "L_HJC"],
}

# Medial and lateral candidates of the joint centres.
MEDIAL_LATERAL = {
    "left_knee": (
        ["L_knee_med", "L_KneeMed", "L_knee_m", "L_MFC", "L_FemCon_Med"],
        ["L_knee_lat", "L_KneeLat", "L_knee_l", "L_LFC", "L_FemCon_Lat"],
    ),
    "right_knee": (
        ["R_knee_med", "r_knee_med", "R_KneeMed", "R_MFC", "R_FemCon_Med"],
        ["R_knee_lat", "r_knee_lat", "R_KneeLat", "R_LFC", "R_FemCon_Lat"],
    ),
    "left_ankle": (
        ["L_ankle_med", "L_AnkleMed", "L_MedMalleolus", "L_med_malleolus", "L_med_mall", "L_MedMall"],
        ["L_ankle_lat", "L_AnkleLat", "L_LatMalleolus", "L_lat_malleolus", "L_lat_mall", "L_LatMall"],
    ),
    "right_ankle": (
        ["R_ankle_med", "r_ankle_med", "R_AnkleMed", "R_MedMalleolus", "R_med_malleolus", "R_med_mall", "R_MedMall"],
        ["R_ankle_lat", "r_ankle_lat", "R_AnkleLat", "R_LatMalleolus", "R_lat_malleolus", "R_lat_mall", "R_LatMall"],
    ),
}

# Single-marker candidates of the 20-joint body set (mocap side).
BODY20_SINGLE = {
    "left_shoulder": ["L_Shoulder", "L_Shoulder_Acromion"],
    "right_shoulder": ["R_Shoulder", "R_Shoulder_Acromion"],
    "left_elbow": ["L_elbow", "L_elbow_lat", "L_elbow_med"],
    "right_elbow": ["R_elbow", "R_elbow_lat", "R_elbow_med"],
    "left_wrist": ["L_wrist"],
    "right_wrist": ["R_wrist"],
    "left_hip": ["L_HJC", "L_HJC_reg", "L_HJCL"],
    "right_hip": ["R_HJC", "R_HJC_reg", "R_HJCR"],
    "left_knee": ["L_knee"],
    "right_knee": ["R_knee"],
    "left_ankle": ["L_ankle"],
    "right_ankle": ["R_ankle"],
    "left_heel": ["L_calc", "L_heel"],
    "right_heel": ["R_calc", "R_heel"],
    "left_small_toe": ["L_5meta", "L_small_toe", "L_5th_met"],
    "right_small_toe": ["R_5meta", "R_small_toe", "R_5th_met"],
    "left_big_toe": ["L_toe", "L_big_toe", "L_1st_met"],
    "right_big_toe": ["R_toe", "R_big_toe", "R_1st_met"],
}

# Joints taken as the midpoint of two markers when both exist.
BODY20_PAIRS = {
    "left_elbow": (["L_elbow_med"], ["L_elbow_lat"]),
    "right_elbow": (["R_elbow_med"], ["R_elbow_lat"]),
    "left_wrist": (["L_wrist_radius"], ["L_wrist_ulna"]),
    "right_wrist": (["R_wrist_radius"], ["R_wrist_ulna"]),
}

# Candidates of the 20-joint set on the enhanced-marker side.
ENHANCED20_SINGLE = {
    "left_shoulder": ["L_Shoulder", "Lsho", "L_SHO"],
    "right_shoulder": ["R_Shoulder", "Rsho", "R_SHO"],
    "left_elbow": ["L_elbow"],
    "right_elbow": ["R_elbow"],
    "left_wrist": ["L_wrist"],
    "right_wrist": ["R_wrist"],
    "left_hip": ["L_HJC", "L_HJC_reg", "Lhip", "Left_Hip_JC"],
    "right_hip": ["R_HJC", "R_HJC_reg", "Rhip", "Right_Hip_JC"],
    "left_knee": ["L_knee"],
    "right_knee": ["R_knee"],
    "left_ankle": ["L_ankle", "L_ANK"],
    "right_ankle": ["R_ankle", "R_ANK"],
    "left_heel": ["L_calc", "L_HEE", "L_heel"],
    "right_heel": ["R_calc", "R_HEE", "R_heel"],
    "left_small_toe": ["L_5meta", "L_5th_met"],
    "right_small_toe": ["R_5meta", "R_5th_met"],
    "left_big_toe": ["L_toe", "L_1st_met", "L_big_toe"],
    "right_big_toe": ["R_toe", "R_1st_met", "R_big_toe"],
}
ENHANCED20_PAIRS = {
    "left_elbow": (["L_elbow_med", "L_EPI_med", "L_ELMed", "L_EL_med"], ["L_elbow_lat", "L_EPI_lat", "L_ELLat", "L_EL_lat"]),
    "right_elbow": (["R_elbow_med", "R_EPI_med", "R_ELMed", "R_EL_med"], ["R_elbow_lat", "R_EPI_lat", "R_ELLat", "R_EL_lat"]),
    "left_wrist": (["L_wrist_radius", "L_WRA", "L_WR_rad"], ["L_wrist_ulna", "L_WRB", "L_WR_uln"]),
    "right_wrist": (["R_wrist_radius", "R_WRA", "R_WR_rad"], ["R_wrist_ulna", "R_WRB", "R_WR_uln"]),
    "left_knee": (["L_knee_med", "L_KNE_med", "L_KNE_M"], ["L_knee_lat", "L_KNE_lat", "L_KNE_L"]),
    "right_knee": (["R_knee_med", "R_KNE_med", "R_KNE_M"], ["R_knee_lat", "R_KNE_lat", "R_KNE_L"]),
}

# Normalised enhanced name -> accepted normalised mocap names.
NATIVE_SYNONYMS = {
    "rhjc": ["rhjc", "rhjcreg", "rhipjc"],
    "lhjc": ["lhjc", "lhjcreg", "lhipjc"],
    "rasis": ["rasis", "r_asis"],
    "lasis": ["lasis", "l_asis"],
    "rpsis": ["rpsis", "r_psis"],
    "lpsis": ["lpsis", "l_psis"],
    "rshoulder": ["rshoulder", "rshoulderacromion"],
    "lshoulder": ["lshoulder", "lshoulderacromion"],
    "relbow": ["relbowlat", "relbow"],
    "rmelbow": ["relbowmed", "rmelbow"],
    "lelbow": ["lelbowlat", "lelbow"],
    "lmelbow": ["lelbowmed", "lmelbow"],
    "rwrist": ["rwristradius", "rwrist"],
    "rmwrist": ["rwristulna", "rmwrist"],
    "lwrist": ["lwristradius", "lwrist"],
    "lmwrist": ["lwristulna", "lmwrist"],
    "rknee": ["rkneelat", "rknee"],
    "rmknee": ["rkneemed", "rmknee"],
    "lknee": ["lkneelat", "lknee"],
    "lmknee": ["lkneemed", "lmknee"],
    "rankle": ["rankle", "ranklelat", "ranklemed"],
    "rmankle": ["ranklemed", "rankle"],
    "lankle": ["lankle", "lanklelat", "lanklemed"],
    "lmankle": ["lanklemed", "lankle"],
    "rtoe": ["r1stmet", "rbigtoe", "rtoe"],
    "ltoe": ["l1stmet", "lbigtoe", "ltoe"],
    "r5meta": ["r5meta", "r5thmet"],
    "l5meta": ["l5meta", "l5thmet"],
    "rcalc": ["rcalc", "rheel", "rcalcaneus"],
    "lcalc": ["lcalc", "lheel", "lcalcaneus"],
    "c7": ["c7"],
}

# Skeleton edges.
EDGES = [
    ("left_hip", "right_hip"),
    ("left_hip", "left_knee"), ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"), ("right_knee", "right_ankle"),
    ("left_ankle", "left_heel"), ("left_ankle", "left_big_toe"), ("left_ankle", "left_small_toe"),
    ("right_ankle", "right_heel"), ("right_ankle", "right_big_toe"), ("right_ankle", "right_small_toe"),
    ("left_hip", "left_shoulder"), ("right_hip", "right_shoulder"),
    ("left_shoulder", "right_shoulder"),
    ("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist"),
    ("neck", "left_shoulder"), ("neck", "right_shoulder"),
    ("mid_hip", "left_hip"), ("mid_hip", "right_hip"),
]

# Model inputs and outputs by generation and body part.
FEATURES_OLD_LOWER = [
    "Neck", "RShoulder", "LShoulder", "RHip", "LHip", "RKnee", "LKnee", "RAnkle", "LAnkle",
    "RHeel", "LHeel", "RSmallToe", "LSmallToe", "RBigToe", "LBigToe",
]
RESPONSES_OLD_LOWER = [
    "C7_study", "r_shoulder_study", "L_shoulder_study", "r.ASIS_study", "L.ASIS_study",
    "r.PSIS_study", "L.PSIS_study", "r_knee_study", "L_knee_study", "r_mknee_study",
    "L_mknee_study", "r_ankle_study", "L_ankle_study", "r_mankle_study", "L_mankle_study",
    "r_calc_study", "L_calc_study", "r_toe_study", "L_toe_study", "r_5meta_study",
    "L_5meta_study", "r_thigh1_study", "r_thigh2_study", "r_thigh3_study", "L_thigh1_study",
    "L_thigh2_study", "L_thigh3_study", "r_sh1_study", "r_sh2_study", "r_sh3_study",
    "L_sh1_study", "L_sh2_study", "L_sh3_study", "RHJC_study", "LHJC_study",
]
FEATURES_OLD_UPPER = ["Neck", "RShoulder", "LShoulder", "RElbow", "LElbow", "RWrist", "LWrist"]
RESPONSES_OLD_UPPER = [
    "r_lelbow_study", "L_lelbow_study", "r_melbow_study", "L_melbow_study",
    "r_lwrist_study", "L_lwrist_study", "r_mwrist_study", "L_mwrist_study",
]
FEATURES_NEW_LOWER = [
    "neck", "right_shoulder", "left_shoulder", "right_hip", "left_hip", "right_knee", "left_knee",
    "right_ankle", "left_ankle", "right_heel", "left_heel", "right_small_toe", "left_small_toe",
    "right_big_toe", "left_big_toe",
]
RESPONSES_NEW_LOWER = [
    "r.ASIS_study", "L.ASIS_study", "r.PSIS_study", "L.PSIS_study", "r_knee_study",
    "r_mknee_study", "r_ankle_study", "r_mankle_study", "r_toe_study", "r_5meta_study",
    "r_calc_study", "L_knee_study", "L_mknee_study", "L_ankle_study", "L_mankle_study",
    "L_toe_study", "L_calc_study", "L_5meta_study", "r_shoulder_study", "L_shoulder_study",
    "C7_study", "r_thigh1_study", "r_thigh2_study", "r_thigh3_study", "L_thigh1_study",
    "L_thigh2_study", "L_thigh3_study", "r_sh1_study", "r_sh2_study", "r_sh3_study",
    "L_sh1_study", "L_sh2_study", "L_sh3_study", "RHJC_study", "LHJC_study",
]
FEATURES_NEW_UPPER = [
    "neck", "right_shoulder", "left_shoulder", "right_elbow", "left_elbow", "right_wrist", "left_wrist",
]
RESPONSES_NEW_UPPER = [
    "r_lelbow_study", "r_melbow_study", "r_lwrist_study", "r_mwrist_study",
    "L_lelbow_study", "L_melbow_study", "L_lwrist_study", "L_mwrist_study",
]

# Replacements from study marker names to mocap names, in order.
STUDY_TO_MOCAP = [
    ("_study", ""),
    ("r_shoulder", "R_Shoulder"),
    ("L_shoulder", "L_Shoulder"),
    ("RHJC", "R_HJC"),
    ("LHJC", "L_HJC"),
    ("r_lelbow", "R_elbow_lat"),
    ("L_lelbow", "L_elbow_lat"),
    ("r_melbow", "R_elbow_med"),
    ("L_melbow", "L_elbow_med"),
    ("r_lwrist", "R_wrist_radius"),
    ("L_lwrist", "L_wrist_radius"),
    ("r_mwrist", "R_wrist_ulna"),
    ("L_mwrist", "L_wrist_ulna"),
]

# Mocap labels kept by the downsampling job.
# Markers that must be still in a static phase, those of the arms, and the keypoint form.
STILL_MARKERS = [
    "C7_study", "r_shoulder_study", "L_shoulder_study", "r.ASIS_study", "L.ASIS_study", "r.PSIS_study", "L.PSIS_study",
    "r_knee_study", "L_knee_study", "r_mknee_study", "L_mknee_study", "r_ankle_study", "L_ankle_study", "r_mankle_study",
    "L_mankle_study", "r_calc_study", "L_calc_study", "r_toe_study", "L_toe_study", "r_5meta_study", "L_5meta_study",
    "RHJC_study", "LHJC_study",
]
STILL_ARM_MARKERS = [
    "r_lelbow_study", "L_lelbow_study", "r_melbow_study", "L_melbow_study", "r_lwrist_study", "L_lwrist_study",
    "r_mwrist_study", "L_mwrist_study",
]
STILL_KEYPOINTS = [
    "neck", "right_shoulder", "left_shoulder", "right_hip", "left_hip", "right_knee", "left_knee", "right_ankle", "left_ankle",
    "right_heel", "left_heel", "right_small_toe", "left_small_toe", "right_elbow", "left_elbow", "right_wrist", "left_wrist",
]

# Places of shoulders and hips in whole-body layouts, for data without names.
BODY_LAYOUT_INDEX = {"left_shoulder": 5, "right_shoulder": 6, "left_hip": 11, "right_hip": 12}

MOCAP_KEEP = [
    "RSHO", "LSHO", "RASI", "LASI", "RKNE", "LKNE", "RANK", "LANK",
    "RHEE", "LHEE", "RTOE", "LTOE", "RELB", "LELB", "RWRB", "LWRB",
]

# Shoulders, hips, knees and ankles in the 133-keypoint layout.
PLACEMENT_JOINTS = [5, 6, 11, 12, 13, 14, 15, 16]


def feature_rows() -> list[tuple[str, str, str, int, str]]:
    """(version, part, kind, ord, marker) for every model generation."""
    old = {("lower", "feature"): FEATURES_OLD_LOWER, ("lower", "response"): RESPONSES_OLD_LOWER,
           ("upper", "feature"): FEATURES_OLD_UPPER, ("upper", "response"): RESPONSES_OLD_UPPER}
    new = {("lower", "feature"): FEATURES_NEW_LOWER, ("lower", "response"): RESPONSES_NEW_LOWER,
           ("upper", "feature"): FEATURES_NEW_UPPER, ("upper", "response"): RESPONSES_NEW_UPPER}
    out = []
    for version in ("0.1", "0.2", "0.3"):
        for (part, kind), names in (new if version == "0.3" else old).items():
            out += [(version, part, kind, i, m) for i, m in enumerate(names)]
    return out


def alias_rows(aliases: dict[str, list[str]]) -> list[tuple[str, str, int]]:
    """(target, candidate, priority)."""
    return [(t, c, i) for t, cands in aliases.items() for i, c in enumerate(cands)]
