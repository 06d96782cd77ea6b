"""Queries: selection, persons, names, text and boxes."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.functions import dims as D
from kinespark.functions import text
from kinespark.functions.dims import alias_rows, literal_table, sql_literal
from kinespark.operators import names, select, series, tracking
from kinespark.plans import fixtures as X
from kinespark.plans.registry import query, r6
from kinespark.sources import manifest as M


def values(rows, name, cols):
    body = ", ".join("(" + ", ".join(sql_literal(v).replace("\\'", "''") for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {name}({', '.join(cols)})"


# ------------------------------------------------------------ named markers
# Two naming schemes by trial parity; elbows and knees are split in two markers.
MARKER_SCHEMES = []
for _k, _j in enumerate(D.BODY20):
    _side, _, _part = _j.partition("_")
    if _j in ("neck", "mid_hip"):
        continue
    _S, _s = ("L", "L") if _side == "left" else ("R", "r")
    _name = {"shoulder": f"{_S}_Shoulder", "hip": f"{_S}_HJC", "heel": f"{_s}_calc",
             "small_toe": f"{_s}_5meta", "big_toe": f"{_s}_toe"}.get(_part, f"{_s}_{_part}")
    if _part in ("elbow", "knee"):
        if _part == "knee":
            MARKER_SCHEMES.append((_k, 0, _name, 0.0))
        MARKER_SCHEMES += [(_k, 0, f"{_S}_{_part}_med", 5.0), (_k, 0, f"{_S}_{_part}_lat", -7.0)]
        MARKER_SCHEMES.append((_k, 1, _name.upper(), 0.0))
    elif _part == "wrist":
        MARKER_SCHEMES += [(_k, 0, f"{_S}_wrist_radius", 3.0), (_k, 0, f"{_S}_wrist_ulna", -4.0)]
        MARKER_SCHEMES.append((_k, 1, f"{_s}_wrist", 0.0))
    elif _part == "hip":
        MARKER_SCHEMES += [(_k, 0, _name, 0.0), (_k, 0, _name + "_reg", 2.0), (_k, 1, _name + "_reg", 2.0)]
    elif _part == "small_toe":
        MARKER_SCHEMES.append((_k, 0, _name, 0.0))
    else:
        MARKER_SCHEMES += [(_k, 0, _name, 0.0), (_k, 1, _name.lower(), 0.0)]
_SCHEME = ["k", "variant", "marker", "dx"]
X.VIEWS["f1m"] = (
    ["f1"],
    "SELECT trial, frame, t, marker, f1.k, x + dx::DOUBLE AS x, y, z FROM f1 JOIN "
    + values(MARKER_SCHEMES, "s", _SCHEME) + " ON f1.k = s.k AND f1.trial % 2 = s.variant",
)


def named_markers(spark, sf):
    s = literal_table(spark, _SCHEME, MARKER_SCHEMES)
    d = X.pose_long(spark, sf).withColumn("variant", (F.col("trial") % 2).cast("int"))
    return d.join(s, ["k", "variant"]).select(
        "trial", "frame", "t", "marker", "k", (F.col("x") + F.col("dx")).alias("x"), "y", "z")


def alias_values(aliases):
    return values(alias_rows(aliases), "a", ["target", "candidate", "priority"])


def sql_resolve(aliases, name):
    """CTE text: (trial, target, marker) by first candidate present."""
    return (
        f"{name} AS (SELECT trial, target, marker FROM (SELECT trial, target, marker, row_number() OVER "
        f"(PARTITION BY trial, target ORDER BY priority, marker DESC) r FROM (SELECT DISTINCT trial, marker FROM f1m) p "
        f"JOIN {alias_values(aliases)} ON lower(candidate)=lower(marker)) WHERE r=1)"
    )


# ---------------------------------------------------------------- trials (F10)
_TRIALS = ("SELECT subject_id, subset, id, row_number() OVER (PARTITION BY subject_id, subset ORDER BY n_nationkey) - 1 "
           "AS trial_pos FROM f10")


def trials(spark, sf):
    return M.trial_catalogue(X.manifest(spark, sf))


@query("flt_1_pick_trials", ["f10"],
       "SELECT subject_id, subset, id FROM f10 WHERE subset='healthy' AND id IN ('FRANCE','CHINA','KENYA','NATION_2','NATION_4','NATION_10') "
       "UNION ALL SELECT subject_id, subset, id FROM f10 WHERE subset='pathological'")
def _(spark, sf):
    t = trials(spark, sf)
    a = select.pick_trials(t, "healthy", ["FRANCE", "CHINA", "KENYA", "NATION_2", "NATION_4", "NATION_10"])
    return a.unionByName(select.pick_trials(t, "pathological")).select("subject_id", "subset", "id")


@query("flt_1_pick_trials_fallback", ["f10"],
       "SELECT subject_id, subset, id FROM f10 f WHERE subset='healthy' OR NOT EXISTS (SELECT 1 FROM f10 g WHERE "
       "g.subject_id=f.subject_id AND g.subset='healthy')")
def _(spark, sf):
    return select.pick_trials(trials(spark, sf), "healthy", unknown="all").select("subject_id", "subset", "id")


@query("flt_2_find_trial", ["f10"],
       "SELECT subject_id, subset, id FROM f10 WHERE id = (SELECT min(n_name) FROM nation)")
def _(spark, sf):
    first = X.table(spark, sf, "nation").agg(F.min("n_name").alias("id"))
    t = trials(spark, sf).join(first, "id", "left_semi")
    w = W.partitionBy("subject_id").orderBy("subset_pos", "trial_pos")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("subject_id", "subset", "id")


@query("set_1_union_subsets", ["f10"], "SELECT DISTINCT subject_id, subset, id FROM f10")
def _(spark, sf):
    t = trials(spark, sf)
    d = t.where("subset = 'healthy'").unionByName(t.where("subset = 'pathological'")).unionByName(t)
    return d.dropDuplicates(["subject_id", "subset", "id"]).select("subject_id", "subset", "id")


# ---------------------------------------------------------------- frames
@query("flt_3_stride", ["f1"], "SELECT trial, frame, joint, round(x,6) x FROM f1 WHERE frame % 5 = 0")
def _(spark, sf):
    return X.pose_frames(spark, sf).where(select.every_nth("frame", 5)).select(
        "trial", "frame", F.inline("kp")).select("trial", "frame", "joint", r6("x"))


@query("flt_4_timestamp", None,
       "SELECT event_id, round(coalesce(CASE WHEN value > 5 THEN value/1000.0 END, event_id/60.0),9) t FROM events")
def _(spark, sf):
    d = X.table(spark, sf, "events")
    ms = F.when(F.col("value") > 5, F.col("value").cast("double")).otherwise(F.lit(0.0))
    return d.select("event_id", F.round(select.timestamp(ms, F.col("event_id"), F.lit(60.0)), 9).alias("t"))


@query("flt_5_frame_rate", None,
       "SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN 59.94::DOUBLE WHEN c_acctbal > 0 THEN c_acctbal ELSE 60.0::DOUBLE END,6) fps FROM customer")
def _(spark, sf):
    d = X.table(spark, sf, "customer")
    named = F.when(F.col("c_custkey") % 3 == 0, "59.94").otherwise("auto")
    file = F.when(F.col("c_custkey") % 7 == 0, F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))).otherwise(F.col("c_acctbal"))
    return d.select("c_custkey", r6(select.frame_rate(named, file), "fps"))


@query("flt_6_person_score", ["f4"],
       "SELECT trial::VARCHAR trial_id, frame frame_index, count(*) FILTER (mean_score >= 0.5) n_persons FROM f4 GROUP BY trial, frame")
def _(spark, sf):
    return X.persons(spark, sf).select("trial_id", "frame_index",
                                       F.size(select.at_least(F.col("persons"), 0.5)).cast("long").alias("n_persons"))


@query("flt_7_detection_filter", ["f11"],
       "SELECT trial, frame, det, round(score,6) score FROM f11 WHERE label=0 AND score>=0.4 AND frame % 4 = 0")
def _(spark, sf):
    return tracking.usable_detections(X.detections(spark, sf), 0.4, 4).select("trial", "frame", "det", r6("score"))


@query("flt_22_detector_schedule", ["f11"], "SELECT trial, count(*) n FROM f11 WHERE frame % 8 = 0 GROUP BY trial")
def _(spark, sf):
    return X.detections(spark, sf).where(select.every_nth("frame", 8)).groupBy("trial").agg(F.count(F.lit(1)).alias("n"))


def ragged(spark, sf):
    """F4 with some persons cut to 17 points or given a two-value point."""
    return X.persons(spark, sf).select(
        "trial_id", "frame_index",
        F.explode("persons").alias("p"),
    ).select("trial_id", "frame_index", "p",
             F.when(F.col("frame_index") % 5 == 0, F.slice("p.keypoints_xyz", 1, 17))
             .when(F.col("frame_index") % 5 == 1, F.transform("p.keypoints_xyz", lambda q: F.slice(q, 1, 2)))
             .otherwise(F.col("p.keypoints_xyz")).alias("kp"))


@query("flt_8_shape_gate", ["f4"],
       "SELECT trial::VARCHAR trial_id, count(*) FILTER (frame%5>1) ok20, count(*) FILTER (frame%5<>1) ok_any FROM f4 GROUP BY trial")
def _(spark, sf):
    return ragged(spark, sf).groupBy("trial_id").agg(
        F.count_if(select.well_formed(F.col("kp"), 20)).alias("ok20"),
        F.count_if(select.well_formed(F.col("kp"))).alias("ok_any"))


_SRC = "CASE WHEN vec_id%4=0 THEN 'keypoints_xyz_mm' WHEN vec_id%4=1 THEN 'keypoints_xyz (units=mm)' {raw} END"


def source_persons(spark, sf):
    kp = F.expr("transform(sequence(0,19), k -> array(e[3*k], e[3*k+1], e[3*k+2]))")
    d = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    m = F.col("vec_id") % 4
    return d.select("vec_id", F.struct(
        F.when(m != 3, kp).alias("keypoints_xyz"),
        F.when(m == 0, F.transform(kp, lambda p: F.transform(p, lambda c: c * 1000.0))).alias("keypoints_xyz_mm"),
        F.when(m == 1, "MM").alias("keypoints_xyz_units")).alias("p"))


@query("flt_9_source_priority", None,
       "SELECT vec_id, CASE vec_id%4 WHEN 0 THEN 'keypoints_xyz_mm' WHEN 1 THEN 'keypoints_xyz (units=mm)' END AS strict, "
       "CASE vec_id%4 WHEN 0 THEN 'keypoints_xyz_mm' WHEN 1 THEN 'keypoints_xyz (units=mm)' WHEN 2 THEN 'keypoints_xyz (RAW units)' END AS allowed, "
       "CASE vec_id%4 WHEN 0 THEN 'keypoints_xyz (RAW units)' WHEN 1 THEN 'keypoints_xyz (units=mm)' WHEN 2 THEN 'keypoints_xyz (RAW units)' END AS forced, "
       "round(CASE vec_id%4 WHEN 0 THEN 1000.0::DOUBLE*embedding[1]::DOUBLE WHEN 1 THEN embedding[1]::DOUBLE END,6) x0 FROM embeddings")
def _(spark, sf):
    d, p = source_persons(spark, sf), F.col("p")
    d = d.select("vec_id", select.pick_source(p).alias("a"), select.pick_source(p, allow_raw=True).alias("b"),
                 select.pick_source(p, allow_raw=True, prefer_raw=True).alias("c"))
    return d.select("vec_id", F.col("a.source").alias("strict"), F.col("b.source").alias("allowed"),
                    F.col("c.source").alias("forced"), r6(F.col("a.kp")[0][0], "x0"))


@query("flt_10_joint_subset", ["f1"], "SELECT trial, frame, k, round(x,6) x FROM f1 WHERE k IN (5,6,11,12,13,14,15,16)")
def _(spark, sf):
    dim = literal_table(spark, ["k"], [(k,) for k in D.PLACEMENT_JOINTS])
    return X.pose_long(spark, sf).join(dim, "k", "left_semi").select("trial", "frame", "k", r6("x"))


@query("flt_11_joint_visibility", ["vec"],
       "SELECT trial, vec_id, round((e[41]+e[42])/2+0.5,6) m FROM vec WHERE (e[41]+e[42])/2+0.5::DOUBLE >= 0.5")
def _(spark, sf):
    sc = F.array(F.col("e")[40] + 0.5, F.lit(float("nan")), F.col("e")[41] + 0.5, F.lit(None).cast("double"))
    d = X.vectors(spark, sf).withColumn("m", select.mean_scores(sc))
    return d.where("m >= 0.5").select("trial", "vec_id", r6("m"))


@query("flt_12_support_gate", ["f6"],
       "SELECT trial, marker, count(x) n_valid, CASE WHEN count(x)>=10 THEN 'ok' ELSE 'failed' END status, "
       "CASE WHEN count(x)<10 THEN 'too few valid samples' END reason FROM f6 GROUP BY trial, marker")
def _(spark, sf):
    return select.support_gate(X.irregular(spark, sf), ["trial", "marker"], F.col("x").isNotNull(), 10, "too few valid samples")


@query("flt_13_name_patterns", ["f1"],
       "SELECT trial, joint, count(*) n FROM f1 WHERE regexp_matches(joint,'(?i)LEFT|neck') AND NOT regexp_matches(joint,'(?i)TOE$') GROUP BY ALL")
def _(spark, sf):
    return X.pose_long(spark, sf).where(select.by_pattern("joint", "LEFT|neck", "TOE$")).groupBy("trial", "joint").agg(
        F.count(F.lit(1)).alias("n"))


@query("flt_14_suffix", ["f1m"],
       "SELECT trial, marker, count(*) n FROM f1m WHERE marker LIKE '%\\_med' ESCAPE '\\' OR trial NOT IN "
       "(SELECT trial FROM f1m WHERE marker LIKE '%\\_med' ESCAPE '\\') GROUP BY ALL")
def _(spark, sf):
    return select.by_suffix(named_markers(spark, sf), ["trial"], "marker", "_med").groupBy("trial", "marker").agg(
        F.count(F.lit(1)).alias("n"))


@query("flt_16_zero_as_missing", ["f8"],
       "SELECT trial, marker, count(*) FILTER (z<>0) n_cell, count(*) FILTER (NOT (z=0 AND x<5)) n_triplet FROM f8 GROUP BY ALL")
def _(spark, sf):
    d = X.markers_big(spark, sf)
    cell = select.zero_as_missing(d, ["z"], "cell").groupBy("trial", "marker").agg(F.count("z").alias("n_cell"))
    low = F.when(F.col("x") < 5, 0.0).otherwise(F.col("x"))
    trip = d.select("trial", "marker", low.alias("x"), F.lit(0.0).alias("y"), "z")
    trip = select.zero_as_missing(trip).groupBy("trial", "marker").agg(F.count("x").alias("n_triplet"))
    return cell.join(trip, ["trial", "marker"])


@query("flt_17_trim_trailing", ["f3"],
       "SELECT trial, max(frame) last_frame, count(*) n FROM f3 WHERE rx IS NOT NULL GROUP BY trial")
def _(spark, sf):
    d = X.reference_near(spark, sf).select("trial", "frame", *[F.col(f"r{c}").alias(c) for c in "xyz"])
    return select.trim_trailing_missing(d, ["trial"], "frame").groupBy("trial").agg(
        F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n"))


@query("flt_18_person_index", ["f4i"],
       "SELECT trial::VARCHAR trial_id, frame frame_index, round(mean_score,6) s FROM f4i WHERE idx = least(1, n_persons-1)")
def _(spark, sf):
    return X.persons(spark, sf).select("trial_id", "frame_index",
                                       r6(select.choose_person(F.col("persons"), 1)["mean_score"], "s"))


@query("flt_19_in_frame", ["f5"],
       "SELECT trial, count(*) FILTER (u>=0 AND u<960 AND v>=0 AND v<540) n_in, bool_or(u < -1 OR u > 961 OR v < -1 OR v > 541) any_out, "
       "count(*) n FROM (SELECT trial, u*1.5::DOUBLE AS u, v*1.5::DOUBLE AS v FROM f5) GROUP BY trial")
def _(spark, sf):
    from kinespark.operators.overlay import in_frame
    d = X.pixels(spark, sf).select("trial", (F.col("u") * 1.5).alias("u"), (F.col("v") * 1.5).alias("v"))
    u, v = F.col("u"), F.col("v")
    out = (u < -1) | (u > 961) | (v < -1) | (v > 541)
    return d.groupBy("trial").agg(F.count_if(in_frame(u, v, 960, 540)).alias("n_in"),
                                  F.bool_or(out).alias("any_out"), F.count(F.lit(1)).alias("n"))


@query("flt_20_marker_exists", ["f1m"],
       "SELECT DISTINCT trial FROM f1m WHERE marker='L_HJC'")
def _(spark, sf):
    t = X.vectors(spark, sf).select("trial").distinct()
    return t.join(named_markers(spark, sf).where("marker = 'L_HJC'"), "trial", "left_semi")


@query("flt_21_overlap", ["f6"],
       "WITH r AS (SELECT trial, min(t) t0, max(t) t1 FROM f6 WHERE event_id % 2 = 0 GROUP BY trial) "
       "SELECT trial, event_id, round(t,6) t FROM f6 JOIN r USING (trial) WHERE event_id % 2 = 1 AND t BETWEEN t0 AND t1")
def _(spark, sf):
    d = X.irregular(spark, sf)
    return select.overlap(d.where("event_id % 2 = 1"), d.where("event_id % 2 = 0"), ["trial"]).select(
        "trial", "event_id", r6("t"))


@query("flt_23_keypoint_names", None,
       "SELECT n_regionkey, string_agg(lower(n_name), ',' ORDER BY n_nationkey) names FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    n = X.table(spark, sf, "nation").select("n_regionkey", F.struct(
        F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name")).alias("e"))
    g = n.groupBy("n_regionkey").agg(F.reverse(F.array_sort(F.collect_list("e"))).alias("es"))
    r = F.col("n_regionkey") % 3
    as_map = F.when(r == 0, F.map_from_entries(F.transform("es", lambda e: F.struct(e["name"].alias("k"), e.alias("v")))))
    as_list = F.when(r == 1, F.col("es"))
    id2name = F.when(r == 2, F.transform(F.array_sort("es"), lambda e: e["name"]))
    kn = select.keypoint_names(as_map, as_list, id2name, F.lit(None).cast("array<string>"))
    return g.select("n_regionkey", F.array_join(kn, ",").alias("names"))


@query("flt_24_one_marker", ["f8"], "SELECT trial, frame, round(x,6) x FROM f8 WHERE marker IN (3, 5)")
def _(spark, sf):
    return X.markers_big(spark, sf).where(F.col("marker").isin(3, 5)).select("trial", "frame", r6("x"))


# ---------------------------------------------------------------- persons
@query("agg_1_mean_score", ["f4"],
       "SELECT trial, vec_mean.frame, person, round(m,6) mean_score FROM (SELECT trial, frame, person, "
       "list_avg(list_transform(range(20), lambda k: 0.5::DOUBLE + e[41+k])) m FROM f4) vec_mean")
def _(spark, sf):
    d = X.person_rows(spark, sf)
    m = select.mean_scores(F.expr("transform(sequence(0,19), k -> 0.5 + e[40+k])"))
    return d.select("trial", "frame", "person", r6(F.coalesce(m, F.lit(1.0)), "mean_score"))


_BEST = ("SELECT trial::VARCHAR trial_id, frame frame_index, idx::INTEGER best, round(mean_score,1) s FROM (SELECT *, row_number() OVER "
         "(PARTITION BY trial, frame ORDER BY round(mean_score,1) DESC, idx) r FROM f4i) WHERE r=1")


@query("agg_2_best_person", ["f4i"], _BEST)
def _(spark, sf):
    d = X.persons(spark, sf).withColumn("persons", F.transform(
        "persons", lambda p: p.withField("mean_score", F.round(p["mean_score"], 1))))
    return d.select("trial_id", "frame_index", select.best_index(F.col("persons")).alias("best"),
                    select.choose_person(F.col("persons"))["mean_score"].alias("s"))


@query("top_1_best_person_rows", ["f4i"],
       "SELECT trial, frame, person, round(mean_score,6) s FROM (SELECT *, row_number() OVER (PARTITION BY trial, frame "
       "ORDER BY mean_score DESC, person) r FROM f4i) WHERE r=1")
def _(spark, sf):
    w = W.partitionBy("trial", "frame").orderBy(F.col("mean_score").desc(), "person")
    return X.person_rows(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select(
        "trial", "frame", "person", r6("mean_score", "s"))


@query("agg_3_keypoint_box", ["f5"],
       "SELECT trial, frame, round(greatest(0, u0-px),6) x1, round(greatest(0, v0-py),6) y1, round(least(959, u1+px),6) x2, "
       "round(least(539, v1+py),6) y2 FROM (SELECT *, greatest(0.2::DOUBLE*(u1-u0), (128-(u1-u0))/2) px, greatest(0.2::DOUBLE*(v1-v0), (128-(v1-v0))/2) py "
       "FROM (SELECT trial, frame, min(u) u0, max(u) u1, min(v) v0, max(v) v1 FROM f5 WHERE k % 3 <> 2 GROUP BY trial, frame))")
def _(spark, sf):
    d = X.pixels(spark, sf).withColumn("v", F.when(F.col("k") % 3 != 2, F.col("v")))
    return tracking.keypoint_boxes(d, ["trial", "frame"], 960, 540).select(
        "trial", "frame", *[r6(c) for c in tracking.BOX])


@query("agg_30_support_counters", ["f3"],
       "SELECT trial, count(DISTINCT frame) frames_in, count(DISTINCT frame) FILTER (rx IS NOT NULL) frames_out, "
       "count(rx) valid_points, count(DISTINCT joint) joints FROM f3 GROUP BY trial")
def _(spark, sf):
    return select.support_counts(X.reference_near(spark, sf), ["trial"], "frame", "joint", F.col("rx").isNotNull())


@query("agg_32_pad_to_k", ["f4"],
       "SELECT trial, frame, person, kmax, kk AS k, CASE WHEN kk < n THEN round(1000*e[3*kk+1],6) END x FROM (SELECT *, "
       "max(n) OVER (PARTITION BY trial) kmax FROM (SELECT *, 12 + vec_n % 7 AS n FROM (SELECT *, (frame*3+person) vec_n FROM f4))), "
       "range(20) r(kk) WHERE kk < kmax")
def _(spark, sf):
    d = X.person_rows(spark, sf)
    d = d.withColumn("kp", F.slice(F.expr("transform(sequence(0,19), k -> 1000*e[3*k])"), F.lit(1),
                                   (12 + (F.col("frame") * 3 + F.col("person")) % 7).cast("int")))
    d = select.pad_to_longest(d, ["trial"], "kp", "kmax").select("trial", "frame", "person", "kmax", F.posexplode("kp").alias("k", "x"))
    return d.select("trial", "frame", "person", "kmax", F.col("k").cast("long").alias("k"), r6("x"))


# ---------------------------------------------------------------- names
_DICT = "d AS (SELECT DISTINCT trial, k, joint FROM f1 WHERE (trial + k) % 4 <> 0)"
_REQ = ["nose", "left_heel", "right_heel", "left_big_toe", "neck"]


def dictionary(spark, sf):
    return X.pose_long(spark, sf).where("(trial + k) % 4 <> 0").select(
        "trial", F.col("k").alias("idx"), F.col("joint").alias("name")).distinct()


def requested(spark, sf):
    want = F.posexplode(F.array(*[F.lit(n) for n in _REQ])).alias("ord", "name")
    return X.vectors(spark, sf).select("trial").distinct().select("trial", want)


@query("jon_1_joint_index", ["f1"],
       f"WITH {_DICT}, q AS (SELECT * FROM (SELECT DISTINCT trial FROM f1), {values(list(enumerate(_REQ)), 'r', ['ord', 'name'])}) "
       "SELECT q.trial, q.ord, q.name, d.k AS idx FROM q LEFT JOIN d ON q.trial=d.trial AND q.name=d.joint")
def _(spark, sf):
    found, missing = names.joint_indices(dictionary(spark, sf), requested(spark, sf))
    cols = ["trial", "ord", "name", "idx"]
    return found.select(cols).unionByName(missing.withColumn("idx", F.lit(None).cast("int")).select(cols))


@query("set_4_missing_markers", ["f1"],
       f"WITH {_DICT} SELECT trial, name FROM (SELECT DISTINCT trial FROM f1), {values([(n,) for n in _REQ], 'r', ['name'])} "
       "WHERE (trial, name) NOT IN (SELECT (trial, joint) FROM d)")
def _(spark, sf):
    return names.joint_indices(dictionary(spark, sf), requested(spark, sf))[1].select("trial", "name")


@query("jon_2_alias_first", ["f1m"],
       f"WITH {sql_resolve(D.BASIC_ALIASES, 'r')} SELECT trial, frame, target AS joint, round(x,6) x, round(z,6) z "
       "FROM f1m JOIN r USING (trial, marker)")
def _(spark, sf):
    return names.basic_joints(named_markers(spark, sf), D.BASIC_ALIASES).select("trial", "frame", "joint", r6("x"), r6("z"))


@query("agg_7_alias_mean", ["f1m"],
       f"SELECT trial, frame, target AS joint, round(avg(x),6) x, round(avg(y),6) y FROM f1m JOIN {alias_values(D.BASIC_ALIASES)} "
       "ON lower(candidate)=lower(marker) GROUP BY trial, frame, target")
def _(spark, sf):
    al = literal_table(spark, ["target", "candidate", "priority"], alias_rows(D.BASIC_ALIASES))
    return names.mean_targets(named_markers(spark, sf), al).select("trial", "frame", "joint", r6("x"), r6("y"))


_MED = {t: p[0] for t, p in D.MEDIAL_LATERAL.items()}
_LAT = {t: p[1] for t, p in D.MEDIAL_LATERAL.items()}


@query("jon_3_joint_centers", ["f1m"],
       f"WITH {sql_resolve(D.BASIC_ALIASES, 'r')}, {sql_resolve(_MED, 'm')}, {sql_resolve(_LAT, 'l')}, "
       "c AS (SELECT a.trial, a.frame, m.target, 0.5*(a.x+b.x) x, 0.5*(a.y+b.y) y FROM f1m a JOIN m USING (trial, marker) JOIN l ON l.trial=a.trial "
       "AND l.target=m.target JOIN f1m b ON b.trial=a.trial AND b.frame=a.frame AND b.marker=l.marker) "
       "SELECT trial, frame, target AS joint, round(x,6) x, round(y,6) y FROM c UNION ALL "
       "SELECT f.trial, f.frame, r.target, round(f.x,6), round(f.y,6) FROM f1m f JOIN r USING (trial, marker) "
       "WHERE (f.trial, r.target) NOT IN (SELECT (trial, target) FROM c)")
def _(spark, sf):
    return names.basic_joints(named_markers(spark, sf), D.BASIC_ALIASES, D.MEDIAL_LATERAL).select(
        "trial", "frame", "joint", r6("x"), r6("y"))


_P1 = {t: p[0] for t, p in D.BODY20_PAIRS.items()}
_P2 = {t: p[1] for t, p in D.BODY20_PAIRS.items()}
_ASSEMBLE = (
    f"WITH {sql_resolve(D.BODY20_SINGLE, 'r')}, {sql_resolve(_P1, 'm')}, {sql_resolve(_P2, 'l')}, "
    "c AS (SELECT a.trial, a.frame, m.target, 0.5*(a.x+b.x) x, 0.5*(a.y+b.y) y FROM f1m a JOIN m USING (trial, marker) JOIN l ON l.trial=a.trial "
    "AND l.target=m.target JOIN f1m b ON b.trial=a.trial AND b.frame=a.frame AND b.marker=l.marker), "
    "u AS (SELECT trial, frame, target AS joint, x, y FROM c UNION ALL SELECT f.trial, f.frame, r.target, f.x, f.y FROM f1m f JOIN r USING (trial, marker) "
    "WHERE (f.trial, r.target) NOT IN (SELECT (trial, target) FROM c)), "
    "s AS (SELECT trial, frame, CASE WHEN joint LIKE '%hip' THEN 'mid_hip' ELSE 'neck' END joint, sum(x)*0.5 x, sum(y)*0.5 y FROM u "
    "WHERE joint IN ('left_hip','right_hip','left_shoulder','right_shoulder') GROUP BY ALL), b AS (SELECT * FROM u UNION ALL SELECT * FROM s) ")


@query("jon_4_body20_from_mocap", ["f1m"],
       _ASSEMBLE + "SELECT trial, frame, joint, round(x,6) x, round(y,6) y FROM b WHERE trial IN "
       "(SELECT trial FROM b GROUP BY trial HAVING count(DISTINCT joint)=20)")
def _(spark, sf):
    return names.assemble_body20(named_markers(spark, sf), D.BODY20_SINGLE, D.BODY20_PAIRS).select(
        "trial", "frame", "joint", r6("x"), r6("y"))


@query("jon_5_body20_from_predictions", ["f1"],
       "WITH p AS (SELECT * FROM f1 WHERE k >= 2 AND NOT (trial=3 AND joint='left_heel')), s AS (SELECT trial, frame, "
       "CASE WHEN joint LIKE '%hip' THEN 'mid_hip' ELSE 'neck' END joint, sum(x)*0.5 x FROM p WHERE joint IN "
       "('left_hip','right_hip','left_shoulder','right_shoulder') GROUP BY ALL) "
       "SELECT trial, frame, joint, round(x,6) x FROM (SELECT trial, frame, joint, x FROM p UNION ALL SELECT * FROM s) WHERE trial <> 3")
def _(spark, sf):
    d = X.pose_long(spark, sf).where("k >= 2 AND NOT (trial = 3 AND joint = 'left_heel')")
    return names.body20_from_keypoints(d).select("trial", "frame", "joint", r6("x"))


_E1 = {t: p[0] for t, p in D.ENHANCED20_PAIRS.items()}
_E2 = {t: p[1] for t, p in D.ENHANCED20_PAIRS.items()}


@query("jon_6_body20_from_enhanced", ["f1m", "joints20"],
       _ASSEMBLE.replace(alias_values(D.BODY20_SINGLE), alias_values(D.ENHANCED20_SINGLE))
       .replace(alias_values(_P1), alias_values(_E1)).replace(alias_values(_P2), alias_values(_E2))
       + "SELECT f.trial, f.frame, j.joint, round(b.x,6) x, round(b.y,6) y FROM (SELECT DISTINCT trial, frame FROM f1m) f, joints20 j "
       "LEFT JOIN b ON b.trial=f.trial AND b.frame=f.frame AND b.joint=j.joint")
def _(spark, sf):
    return names.assemble_body20(named_markers(spark, sf), D.ENHANCED20_SINGLE, D.ENHANCED20_PAIRS, complete=False).select(
        "trial", "frame", "joint", r6("x"), r6("y"))


def left_right_names(spark, sf):
    d = named_markers(spark, sf).groupBy("trial", "marker").agg(F.min("k").alias("k"))
    w = W.partitionBy("trial").orderBy("k", "marker")
    base = d.select("trial", (F.row_number().over(w) - 1).alias("pos"), "marker")
    left = base.select("trial", "pos", F.concat(F.regexp_replace("marker", "_(med|lat)$", ""),
                                                F.when(F.col("pos") % 2 == 0, "_augmenter").otherwise("")).alias("marker"))
    return left, base


_NATIVE = f"""WITH base AS (SELECT trial, marker, row_number() OVER (PARTITION BY trial ORDER BY k, marker) - 1 pos FROM
 (SELECT trial, marker, min(k) k FROM f1m GROUP BY ALL)),
 l AS (SELECT trial, pos, m AS marker, regexp_replace(regexp_replace(lower(m), '_augmenter$', ''), '[^a-z0-9]', '', 'g') n FROM
  (SELECT trial, pos, concat(regexp_replace(marker, '_(med|lat)$', ''), CASE WHEN pos%2=0 THEN '_augmenter' ELSE '' END) m FROM base)),
 r AS (SELECT trial, n, min_by(marker, pos) marker FROM (SELECT *, regexp_replace(lower(marker), '[^a-z0-9]', '', 'g') n FROM base) GROUP BY trial, n),
 cand AS (SELECT l.*, l.n AS rn, 0 AS pr FROM l UNION ALL SELECT l.*, rn, pr FROM l JOIN
  {values([(a, b, i + 1) for a, bs in D.NATIVE_SYNONYMS.items() for i, b in enumerate(bs)], 's', ['ln', 'rn', 'pr'])} ON l.n=s.ln),
 best AS (SELECT c.trial, c.pos, min_by(c.marker, pr) AS lm, min_by(r.marker, pr) rm FROM cand c JOIN r ON r.trial=c.trial AND r.n=c.rn GROUP BY c.trial, c.pos)
"""


@query("jon_7_native_match", ["f1m"],
       _NATIVE + 'SELECT trial, min(pos) left_pos, min_by(lm, pos) AS "left", rm AS "right" FROM best GROUP BY trial, rm')
def _(spark, sf):
    d = names.native_pairs(*left_right_names(spark, sf))
    return d.select("trial", F.col("left_pos").cast("long").alias("left_pos"), "left", "right")


@query("top_3_first_matches", ["f1m"],
       _NATIVE + 'SELECT trial, "left" FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY p) n FROM (SELECT trial, min(pos) p, '
       'min_by(lm, pos) AS "left", rm FROM best GROUP BY trial, rm)) WHERE n <= 20')
def _(spark, sf):
    # the name table holds one row per marker of a trial
    w = W.partitionBy("trial").orderBy("left_pos")
    d = names.native_pairs(*left_right_names(spark, sf))
    return d.withColumn("n", F.row_number().over(w)).where("n <= 20").select("trial", "left")


@query("set_3_common_names", ["f1m"],
       "SELECT DISTINCT lower(marker) \"name\" FROM f1m WHERE trial%2=0 INTERSECT SELECT DISTINCT lower(marker) FROM f1m WHERE trial%2=1")
def _(spark, sf):
    d = named_markers(spark, sf).select("trial", F.lower("marker").alias("name"))
    return d.where("trial % 2 = 0").select("name").intersect(d.where("trial % 2 = 1").select("name"))


@query("set_5_keep_first_label", ["f1m"],
       "SELECT trial, pos, marker FROM (SELECT *, row_number() OVER (PARTITION BY trial, upper(trim(marker)) ORDER BY pos) r FROM "
       "(SELECT trial, min(frame)*0 + row_number() OVER (PARTITION BY trial ORDER BY marker) pos, CASE WHEN marker LIKE '%\\_reg' ESCAPE '\\' "
       "THEN concat(' ', lower(replace(marker,'_reg',''))) ELSE marker END marker FROM f1m GROUP BY trial, marker)) WHERE r=1")
def _(spark, sf):
    d = named_markers(spark, sf).select("trial", "marker").distinct()
    w = W.partitionBy("trial").orderBy("marker")
    d = d.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("marker", F.when(
        F.col("marker").endswith("_reg"), F.concat(F.lit(" "), F.lower(F.replace("marker", F.lit("_reg"), F.lit("")))))
        .otherwise(F.col("marker")))
    return names.keep_first_label(d, ["trial"], "marker", "pos").select("trial", "pos", "marker")


@query("jon_12_exact_frame", ["f1"],
       "SELECT trial, frame, joint, round(x,6) x FROM f1 WHERE (trial, frame) IN (SELECT (user_id % 10, event_id % 60) FROM events)")
def _(spark, sf):
    want = X.table(spark, sf, "events").select((F.col("user_id") % 10).alias("trial"), (F.col("event_id") % 60).alias("frame")).distinct()
    return X.pose_long(spark, sf).join(want, ["trial", "frame"], "left_semi").select("trial", "frame", "joint", r6("x"))


@query("jon_17_lookup_by_priority", None,
       "SELECT c_custkey, round(CASE WHEN c_custkey%5=0 THEN c_custkey*1.0 WHEN c_custkey%2=0 THEN c_acctbal ELSE NULL END,6) v FROM customer")
def _(spark, sf):
    c = X.table(spark, sf, "customer")
    override = c.where("c_custkey % 5 = 0").select("c_custkey", F.col("c_custkey").cast("double").alias("v"))
    listed = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("v"))
    return names.by_priority(c.select("c_custkey"), "c_custkey", "v", override, listed).select("c_custkey", r6("v"))


@query("jon_18_reorder", ["f1"],
       "SELECT trial, frame, 19 - k AS ord, joint, round(x,6) x FROM f1")
def _(spark, sf):
    order = X.pose_long(spark, sf).select("trial", "joint", (19 - F.col("k")).alias("ord")).distinct()
    return names.reorder(X.pose_long(spark, sf), order).select("trial", "frame", "ord", "joint", r6("x"))


@query("jon_19_stack_parts", ["f1"],
       "SELECT trial, joint, count(*) n FROM f1 WHERE trial % 3 <> 0 AND k < 14 GROUP BY ALL")
def _(spark, sf):
    d = X.pose_long(spark, sf).select("trial", "frame", "k", "joint", "x")
    body = d.where("k < 8 AND (trial % 3 <> 0 OR frame > 2)")
    return names.stack_parts(body, d.where("k BETWEEN 8 AND 13")).groupBy("trial", "joint").agg(F.count(F.lit(1)).alias("n"))


def _sql_chain(col):
    for a, b in D.STUDY_TO_MOCAP:
        col = f"replace({col}, '{a}', '{b}')"
    return col


_RESP = D.RESPONSES_NEW_LOWER + D.RESPONSES_NEW_UPPER


@query("jon_20_rename_scheme", ["f8"],
       f"SELECT DISTINCT trial, {_sql_chain('m')} AS marker FROM f8 JOIN {values(list(enumerate(_RESP)), 's', ['i', 'm'])} ON i = (trial + marker) % 43")
def _(spark, sf):
    dim = literal_table(spark, ["i", "m"], list(enumerate(_RESP)))
    d = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("trial"),
                                              ((F.col("l_suppkey") + F.col("l_linenumber")) % 43).alias("i")).distinct()
    return d.join(dim, "i").select("trial", names.study_to_mocap(F.col("m")).alias("marker")).distinct()


@query("top_2_first_frames", ["f4"],
       "SELECT trial, count(*) n, max(frame) last_frame FROM f4 WHERE (trial, frame) IN (SELECT (trial, frame) FROM (SELECT trial, frame, "
       "row_number() OVER (PARTITION BY trial ORDER BY frame) r FROM (SELECT DISTINCT trial, frame FROM f4)) WHERE r <= 20) GROUP BY trial")
def _(spark, sf):
    return select.first_frames(X.person_rows(spark, sf), ["trial"], "frame", 20).groupBy("trial").agg(
        F.count(F.lit(1)).alias("n"), F.max("frame").alias("last_frame"))


@query("top_5_middle_frame", ["f1"],
       "SELECT trial, frame, joint, round(x,6) x FROM f1 JOIN (SELECT trial, count(DISTINCT frame)//2 AS frame FROM f1 GROUP BY trial) USING (trial, frame)")
def _(spark, sf):
    return select.middle_frame(X.pose_frames(spark, sf), ["trial"], "frame").select(
        "trial", "frame", F.inline("kp")).select("trial", "frame", "joint", r6("x"))


# ---------------------------------------------------------------- text
@query("sca_1_number_with_unit", ["f9"],
       "SELECT subject, try_cast(nullif(regexp_extract(lower(trim(height_raw)),'^([-+]?\\d*\\.?\\d+)\\s*([a-z%]*)',1),'') AS DOUBLE) v, "
       "nullif(regexp_extract(lower(trim(height_raw)),'^([-+]?\\d*\\.?\\d+)\\s*([a-z%]*)',2),'') u FROM f9")
def _(spark, sf):
    h = F.col("height_raw")
    return X.subjects_raw(spark, sf).select("subject", text.number_of(h).alias("v"), text.unit_of(h).alias("u"))


@query("sca_2_sex", ["f9"],
       "SELECT subject, CASE WHEN lower(trim(sex_raw)) IN ('m','male','man') THEN 'male' WHEN lower(trim(sex_raw)) IN ('f','female','woman') "
       "THEN 'female' ELSE sex_raw END sex FROM f9")
def _(spark, sf):
    return X.subjects_raw(spark, sf).select("subject", text.sex_of(F.col("sex_raw")).alias("sex"))


@query("sca_3_height_m", ["f9"],
       "SELECT subject, round(CASE subject%4 WHEN 0 THEN concat('1.', 50+subject%50)::DOUBLE WHEN 2 THEN (150+subject%50)*10/1000.0 ELSE (150+subject%50)/100.0 END,6) h FROM f9")
def _(spark, sf):
    return X.subjects_raw(spark, sf).select("subject", r6(text.height_m(F.col("height_raw")), "h"))


@query("sca_4_mass_kg", ["f9"], "SELECT subject, (50 + subject % 60)::DOUBLE m FROM f9")
def _(spark, sf):
    return X.subjects_raw(spark, sf).select("subject", text.mass_kg(F.col("mass_raw")).alias("m"))


@query("sca_5_nested_lookup", ["f9"], "SELECT subject, height_raw, mass_raw, sex_raw FROM f9")
def _(spark, sf):
    f, n = F.col("meta"), F.col("nested")
    return X.session_metadata(spark, sf).select(
        "subject", text.lookup(f, n, text.HEIGHT_KEYS).alias("height_raw"),
        text.lookup(f, n, text.MASS_KEYS).alias("mass_raw"), text.lookup(f, n, text.SEX_KEYS).alias("sex_raw"))


@query("sca_6_name_rules", None,
       "SELECT event_id, regexp_replace(lower(s),'[^a-z0-9]','','g') AS key_n, regexp_replace(lower(trim(s)),'[^a-z0-9_.]+','','g') AS clean_n, "
       "replace(replace(replace(lower(s),' ','_'),'-','_'),'.','') AS canon_n, regexp_replace(regexp_replace(lower(s),'_openpose$',''),'[^a-z0-9]','','g') AS native_n, "
       "upper(trim(s)) AS label_n FROM (SELECT event_id, concat(' R.', event_type, '-', user_id, CASE WHEN event_id%2=0 THEN '_openpose' ELSE ' ' END) s FROM events)")
def _(spark, sf):
    s = F.concat(F.lit(" R."), F.col("event_type"), F.lit("-"), F.col("user_id"),
                 F.when(F.col("event_id") % 2 == 0, "_openpose").otherwise(" "))
    return X.table(spark, sf, "events").select(
        "event_id", text.key_name(s).alias("key_n"), text.clean_name(s).alias("clean_n"), text.canon_name(s).alias("canon_n"),
        text.native_name(s).alias("native_n"), text.label_name(s).alias("label_n"))


@query("sca_7_index_guess", ["f1"],
       "SELECT trial, CASE WHEN trial % 3 = 0 THEN max(k) FILTER (joint='right_hip') WHEN trial % 3 = 1 THEN 12 END AS idx, trial % 3 = 1 AS guessed FROM f1 GROUP BY trial")
def _(spark, sf):
    # names in every third trial; of the others, every second layout is too short for a guess
    d = X.pose_long(spark, sf)
    named = d.where("trial % 3 = 0").select("trial", F.col("k").alias("idx"), F.col("joint").alias("name")).distinct()
    layouts = d.groupBy("trial").agg(F.max("k").alias("k")).select("trial", F.when(F.col("trial") % 3 == 2, 16).otherwise(F.col("k") + 1).alias("n_points"))
    return names.side_index_or_guess(layouts, named, "right", "hip")


@query("sca_7_side_index", ["f1"],
       "SELECT trial, min(k) FILTER (joint='left_hip') AS idx FROM f1 GROUP BY trial")
def _(spark, sf):
    odd = F.col("trial") % 2 == 1
    d = X.pose_long(spark, sf).select("trial", F.col("k").alias("idx"), F.when(
        odd, F.initcap(F.replace("joint", F.lit("_"), F.lit("-")))).otherwise(F.col("joint")).alias("name")).distinct()
    return names.side_index(d, "left", "hip").select("trial", "idx")


@query("sca_28_flat_points", ["vec"],
       "SELECT trial, vec_id, k, round(e[3*k+1],6) x, round(e[3*k+3],6) z FROM vec, range(21) r(k) WHERE vec_id % 2 = 1")
def _(spark, sf):
    d = X.vectors(spark, sf).withColumn("flat", F.when(F.col("vec_id") % 2 == 1, F.slice("e", 1, 63)).otherwise(F.col("e")))
    d = d.select("trial", "vec_id", F.posexplode(text.reshape3(F.col("flat"))).alias("k", "p"))
    return d.select("trial", "vec_id", F.col("k").cast("long").alias("k"), r6(F.col("p")[0], "x"), r6(F.col("p")[2], "z"))


@query("sca_29_split_list", None,
       "SELECT event_id, list_filter(list_transform(string_split(concat(event_type,', ,',user_id,' ,nose,'),','), lambda s: trim(s)), lambda s: s <> '') AS items FROM events")
def _(spark, sf):
    s = F.concat("event_type", F.lit(", ,"), "user_id", F.lit(" ,nose,"))
    return X.table(spark, sf, "events").select("event_id", text.split_list(s).alias("items"))


@query("sca_30_fixed_point", ["f6"],
       "SELECT event_id, CASE WHEN x IS NULL THEN '' ELSE printf('%.5f', x) END AS s FROM f6")
def _(spark, sf):
    return X.irregular(spark, sf).select("event_id", text.fixed(F.col("x")).alias("s"))


# ---------------------------------------------------------------- boxes
@query("sca_25_center_crop", None,
       "SELECT c_custkey, greatest(0, cx - side//2)::DOUBLE x1, greatest(0, cy - floor(side*0.6))::DOUBLE y1, "
       "least(w-1, greatest(0, cx - side//2)+side)::DOUBLE x2, least(h-1, greatest(0, cy - floor(side*0.6))+floor(side*1.2))::DOUBLE y2 FROM "
       "(SELECT *, floor(0.9*least(h,w))::BIGINT side, w//2 cx, floor(h*0.55)::BIGINT cy FROM (SELECT c_custkey, 480+c_custkey%701 w, 360+c_custkey%503 h FROM customer))")
def _(spark, sf):
    d = X.table(spark, sf, "customer").select("c_custkey", (480 + F.col("c_custkey") % 701).alias("w"), (360 + F.col("c_custkey") % 503).alias("h"))
    box = tracking.center_crop(F.col("h"), F.col("w"))
    return d.select("c_custkey", *[c.cast("double").alias(n) for c, n in zip(box, tracking.BOX)])


X.VIEWS["f5b"] = (
    ["f4"],
    "SELECT trial, frame, person, mean_score, greatest(0, u0-px) x1, greatest(0, v0-py) y1, least(959, u1+px) x2, least(539, v1+py) y2 FROM "
    "(SELECT *, greatest(0.2::DOUBLE*(u1-u0), (128-(u1-u0))/2) px, greatest(0.2::DOUBLE*(v1-v0), (128-(v1-v0))/2) py FROM (SELECT *, list_min(us) u0, list_max(us) u1, "
    "list_min(vs) v0, list_max(vs) v1 FROM (SELECT *, list_transform(range(20), lambda k: 480+400*e[3*k+1]) us, "
    "list_transform(range(20), lambda k: 270+400*e[3*k+2]) vs FROM f4)))",
)
X.VIEWS["f5best"] = (["f5b"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial, frame ORDER BY mean_score DESC, person) r FROM f5b "
                              "WHERE mean_score >= 0.4) WHERE r = 1")
X.VIEWS["frames4"] = (["f4"], "SELECT DISTINCT trial, frame FROM f4")
X.VIEWS["f5prev"] = (
    ["f5best", "frames4"],
    "SELECT trial, frame, last_value(b.x1 IGNORE NULLS) OVER w x1, last_value(b.y1 IGNORE NULLS) OVER w y1, last_value(b.x2 IGNORE NULLS) OVER w x2, "
    "last_value(b.y2 IGNORE NULLS) OVER w y2 FROM frames4 LEFT JOIN f5best b USING (trial, frame) "
    "WINDOW w AS (PARTITION BY trial ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)


def person_boxes(spark, sf, min_score=0.4):
    """Box of the best sufficiently scored person of every frame (NULL without one)."""
    d = X.person_rows(spark, sf)
    us, vs = F.expr("transform(sequence(0,19), k -> 480+400*e[3*k])"), F.expr("transform(sequence(0,19), k -> 270+400*e[3*k+1])")
    box = tracking.box_from_range(F.array_min(us), F.array_min(vs), F.array_max(us), F.array_max(vs), 960, 540)
    ok = F.col("mean_score") >= min_score
    box = F.struct(*[c.alias(n) for c, n in zip(box, tracking.BOX)])
    return d.groupBy("trial", "frame").agg(
        F.max_by(box, F.when(ok, F.struct("mean_score", -F.col("person")))).alias("box"))


@query("win_20_tracked_box", ["f5prev"],
       "SELECT trial, frame, round(x1,6) x1, round(y1,6) y1, round(x2,6) x2, round(y2,6) y2 FROM f5prev")
def _(spark, sf):
    d = tracking.previous_box(person_boxes(spark, sf), ["trial"], "frame", "box")
    return d.select("trial", "frame", *[r6(F.col(f"prev.{c}"), c) for c in tracking.BOX])


_PICK = ("SELECT d.trial, d.frame, d.det, d.x1, d.y1, d.x2, d.y2, row_number() OVER (PARTITION BY d.trial, d.frame ORDER BY CASE WHEN p.x1 IS NULL "
         "THEN -(d.x2-d.x1)*(d.y2-d.y1) ELSE pow((d.x1+d.x2)*0.5-(p.x1+p.x2)*0.5,2)+pow((d.y1+d.y2)*0.5-(p.y1+p.y2)*0.5,2) END, d.det) r "
         "FROM f11 d JOIN f5prev p USING (trial, frame)")


@query("win_21_pick_detection", ["f11", "f5prev"],
       f"SELECT trial, frame, det, round(x1,6) x1 FROM ({_PICK}) WHERE r = 1")
def _(spark, sf):
    prev = tracking.previous_box(person_boxes(spark, sf), ["trial"], "frame", "box").select("trial", "frame", "prev")
    return tracking.pick_detection(X.detections(spark, sf), prev, ["trial", "frame"]).select("trial", "frame", "det", r6("x1"))


@query("win_22_frame_numbers", ["f6"],
       "SELECT event_id, n, round((n-1)/60.0,9) t FROM (SELECT event_id, row_number() OVER (PARTITION BY trial ORDER BY t, event_id) n FROM f6)")
def _(spark, sf):
    d = series.add_running_index(X.irregular(spark, sf), ["trial"], ["t", "event_id"], series.block_of("t", X.DAY), "i")
    return d.select("event_id", (F.col("i") + 1).alias("n"), F.round(F.col("i") / 60.0, 9).alias("t"))


@query("win_23_time_steps", ["f6"],
       "SELECT event_id, round(t - lag(t) OVER (PARTITION BY trial ORDER BY t),6) dt FROM f6")
def _(spark, sf):
    d = series.carry(X.irregular(spark, sf), ["trial"], [F.col("t")], series.block_of("t", X.DAY), F.col("t"), "p", inclusive=False)
    return d.select("event_id", r6(F.col("t") - F.col("p"), "dt"))
