"""Queries: features, enhancement, still phases, readiness and overlay geometry."""

import numpy as np
from pyspark.sql import functions as F

from kinespark.functions import dims as D
from kinespark.functions.dims import literal_table
from kinespark.operators import align, features, frames, overlay, quality
from kinespark.plans import fixtures as X
from kinespark.plans.q_select import values
from kinespark.plans.registry import place, query, r6, sql_place

KEY = ["trial", "frame"]
FEAT = D.FEATURES_NEW_LOWER
_FV = values(list(enumerate(FEAT)), "o", ["ord", "joint"])


def markers(spark, sf):
    """F1 as markers, with the mid hip under the reference marker's name."""
    name = F.when(F.col("joint") == "mid_hip", "midHip").otherwise(F.col("joint"))
    return X.pose_long(spark, sf).select("trial", "frame", name.alias("marker"), "x", "y", "z")


def subjects(spark, sf):
    k = F.col("trial")
    return X.vectors(spark, sf).select("trial").distinct().select("trial", (1.5 + 0.05 * k).alias("height_m"), (60.0 + k).alias("mass_kg"))


def matrix(spark, sf):
    order = literal_table(spark, ["ord", "marker"], list(enumerate(FEAT)))
    d = frames.center_on_marker(markers(spark, sf).withColumnRenamed("marker", "joint"), KEY, "midHip").withColumnRenamed("joint", "marker")
    return features.wide_matrix(d, KEY, order).join(subjects(spark, sf), "trial")


X.VIEWS["feat"] = (["f1"], f"SELECT f.trial, f.frame, o.ord, f.x-m.x x, f.y-m.y y, f.z-m.z z, 1.5::DOUBLE+0.05*f.trial h, 60.0::DOUBLE+f.trial mass FROM f1 f JOIN {_FV} USING (joint) "
                   "JOIN f1 m ON m.trial=f.trial AND m.frame=f.frame AND m.joint='mid_hip'")


@query("fea_1_wide_matrix", ["feat"], "SELECT trial, frame, 45 AS n, round(max(x) FILTER (ord=3),6) x3, round(max(z) FILTER (ord=14),6) z14 FROM feat GROUP BY trial, frame")
def _(spark, sf):
    return matrix(spark, sf).select("trial", "frame", F.size("f").alias("n"), r6(F.col("f")[9], "x3"), r6(F.col("f")[44], "z14"))


_SETS = values([tuple(r) for r in D.feature_rows()], "s", ["version", "part", "kind", "ord", "marker"])


@query("fea_2_marker_sets", None,
       "WITH mm AS (SELECT DISTINCT l_suppkey AS model, marker FROM lineitem JOIN " + values(list(enumerate(D.RESPONSES_NEW_LOWER)), "d", ["i", "marker"]) + " ON i = l_partkey % 41), "
       f"n AS (SELECT version, part, kind, count(*) AS markers FROM {_SETS} GROUP BY ALL) "
       f"SELECT model, version, part, kind, any_value(markers) AS markers, count(*) AS present, min(ord) AS first FROM mm JOIN {_SETS} USING (marker) JOIN n USING (version, part, kind) GROUP BY ALL")
def _(spark, sf):
    # how much of each marker set every model has
    dim = literal_table(spark, ["version", "part", "kind", "ord", "marker"], D.feature_rows())
    n = dim.groupBy("version", "part", "kind").agg(F.count(F.lit(1)).alias("markers"))
    d = model_markers(spark, sf).join(dim, "marker").join(n, ["version", "part", "kind"])
    return d.groupBy("model", "version", "part", "kind").agg(F.max("markers").alias("markers"), F.count(F.lit(1)).alias("present"), F.min("ord").alias("first"))


@query("fea_3_reference_centering", ["feat"], "SELECT trial, frame, ord, round(x,6) x, round(y,6) y FROM feat")
def _(spark, sf):
    d = matrix(spark, sf).select("trial", "frame", F.posexplode(F.expr("transform(sequence(0,14), i -> array(f[3*i], f[3*i+1]))")).alias("ord", "p"))
    return d.select("trial", "frame", "ord", r6(F.col("p")[0], "x"), r6(F.col("p")[1], "y"))


@query("fea_4_height_normalised", ["feat"], "SELECT trial, frame, round(sum(x/(h*1000)),9) s FROM feat GROUP BY trial, frame")
def _(spark, sf):
    h = features.height_in_units(F.col("height_m"), F.lit("mm"))
    d = matrix(spark, sf).withColumn("g", features.normalise_by_height(F.col("f"), h))
    return d.select("trial", "frame", (F.round(F.expr("aggregate(sequence(0,14), 0D, (a,i) -> a + g[3*i])"), 9) + 0.0).alias("s"))


@query("fea_5_append_subject", ["feat"],
       "SELECT trial, frame, 45 n0, 46 n1, 47 n2, round(max(h),6) h, round(max(mass),6) m FROM feat GROUP BY trial, frame")
def _(spark, sf):
    a = lambda n: features.append_subject(F.col("f"), F.col("height_m"), F.col("mass_kg"), n)
    d = matrix(spark, sf).select("trial", "frame", a(45).alias("a"), a(46).alias("b"), a(47).alias("c"))
    return d.select("trial", "frame", F.size("a").alias("n0"), F.size("b").alias("n1"), F.size("c").alias("n2"), r6(F.col("b")[45], "h"), r6(F.col("c")[46], "m"))


@query("fea_6_standardise", ["feat"], "SELECT trial, frame, round((max(x) FILTER (ord=1) - 1.5)/4.0,6) a, round((max(y) FILTER (ord=1) - 2.0)/4.5,6) b FROM feat GROUP BY trial, frame")
def _(spark, sf):
    d = matrix(spark, sf).withColumn("g", features.standardise(F.col("f"), [0.5 * i for i in range(45)], [2.5 + 0.5 * i for i in range(45)]))
    return d.select("trial", "frame", r6(F.col("g")[3], "a"), r6(F.col("g")[4], "b"))


def _mix() -> np.ndarray:
    m = np.zeros((45, 6))
    for j in range(6):
        m[j, j], m[j + 6, j] = 2.0, -0.5
    return m


_LIN = "SELECT trial, frame, round(2*max(x) FILTER (ord=0) - 0.5*max(x) FILTER (ord=2),6) y0, round(2*max(z) FILTER (ord=1) - 0.5*max(z) FILTER (ord=3),6) y5 FROM feat GROUP BY trial, frame"


@query("fea_7_score_frames", ["feat"], _LIN)
def _(spark, sf):
    y = features.score_frames(matrix(spark, sf).select(*KEY, "f"), features.linear_model(_mix()))
    return y.select(*KEY, r6(F.col("y")[0], "y0"), r6(F.col("y")[5], "y5"))


@query("udf_3_score_sequences", ["feat"],
       "SELECT trial, frame, round(avg(v) OVER (PARTITION BY trial ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) y0 FROM (SELECT trial, frame, max(x) FILTER (ord=0) v FROM feat GROUP BY trial, frame)")
def _(spark, sf):
    def smooth5(x: np.ndarray) -> np.ndarray:
        one = np.convolve(np.ones(len(x)), np.ones(5), mode="full")[2:-2]
        return np.stack([np.convolve(x[:, 0], np.ones(5), mode="full")[2:-2] / one], axis=1)

    y = features.score_sequences(matrix(spark, sf).select(*KEY, "f"), smooth5, ["trial"], "frame", 2, width=16)
    return y.select(*KEY, r6(F.col("y")[0], "y0"))


@query("fea_8_attach_markers", ["feat"],
       "SELECT trial, frame, 100 + ord::BIGINT AS marker, round(x,6)+0.0 x, round(z,6)+0.0 z FROM feat UNION ALL SELECT trial, frame, k + 1, round(x,6)+0.0, round(z,6)+0.0 FROM f1")
def _(spark, sf):
    new = features.attach_markers(matrix(spark, sf), KEY, [f"m{i}" for i in range(15)], "f")
    made = F.when(F.col("marker").rlike("^m[0-9]"), 100 + F.substring("marker", 2, 9).try_cast("long"))
    names = _NAMES[-20:]
    return new.unionByName(markers(spark, sf)).select("trial", "frame", F.coalesce(made, place(names, F.col("marker"))).alias("marker"), r6("x"), r6("z"))


@query("set_2_union_outputs", ["f1"], "SELECT trial, joint AS marker, count(*) n FROM f1 WHERE k < 8 GROUP BY ALL UNION ALL SELECT trial, joint, count(*) FROM f1 WHERE k >= 6 GROUP BY ALL")
def _(spark, sf):
    d = X.pose_long(spark, sf).groupBy("trial", "k", F.col("joint").alias("marker")).agg(F.count(F.lit(1)).alias("n"))
    return d.where("k < 8").unionByName(d.where("k >= 6")).drop("k")


_ENH = ("WITH r AS (SELECT f.trial, f.frame, m.marker, f.x*0.5 AS dx, f.y*0.5 AS dy, f.z*0.5 AS dz FROM feat f JOIN "
        + values([(i, m) for i, m in enumerate(D.RESPONSES_NEW_LOWER[:15])], "m", ["ord", "marker"]) + " USING (ord)), "
        "a AS (SELECT r.trial, r.frame, marker, r.dx+m.x x, r.dy+m.y y, r.dz+m.z z FROM r JOIN f1 m ON m.trial=r.trial AND m.frame=r.frame AND m.joint='mid_hip'), "
        "pad AS (SELECT f1.trial, frame, p.marker, x, y, z FROM f1, " + values([(m,) for m in D.RESPONSES_NEW_LOWER[15:]], "p", ["marker"]) + " WHERE joint='mid_hip'), "
        "resp AS (SELECT * FROM a UNION ALL SELECT * FROM pad), low AS (SELECT trial, min(y) lo FROM resp GROUP BY trial), "
        "al AS (SELECT * FROM resp UNION ALL SELECT trial, frame, CASE joint WHEN 'mid_hip' THEN 'midHip' ELSE joint END, x, y, z FROM f1) ")


_NAMES = list(D.RESPONSES_NEW_LOWER) + ["midHip" if j == "mid_hip" else j for j in D.BODY20]


def half_model():
    """Fifteen responses halfway to the features, the others on the reference."""
    m = np.zeros((47, 105))
    m[:45, :45] = 0.5 * np.eye(45)
    return {"lower": features.linear_model(m)}


@query("fea_9_enhancement", ["feat", "f1"],
       _ENH + f"SELECT trial, frame, {sql_place(_NAMES, 'marker')} marker, round(x,5)+0.0 x, round(y-(lo-10),5)+0.0 y, round(z,5)+0.0 z FROM al JOIN low USING (trial)")
def _(spark, sf):
    d = features.enhance(markers(spark, sf), subjects(spark, sf), half_model(), expected={"lower": 47}, gap=10.0)
    return d.select("trial", "frame", place(_NAMES, F.col("marker")).alias("marker"), *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query("agg_22_floor_offset", ["f8"], "SELECT trial, marker, frame, round(y-(min(y) FILTER (marker IN (2,4)) OVER (PARTITION BY trial)-0.01),6) y FROM f8 WHERE trial IN (SELECT trial FROM f8 WHERE marker IN (2,4))")
def _(spark, sf):
    d = X.markers_big(spark, sf)
    return features.drop_to_floor(d, d.where("marker IN (2, 4)"), ["trial"]).select("trial", "marker", "frame", r6("y"))


@query("agg_23_distribution", ["feat"], "SELECT trial, round(avg(v),6) mean, round(stddev_pop(v),6) std FROM (SELECT trial, unnest([x,y,z]) v FROM feat) GROUP BY trial")
def _(spark, sf):
    return features.distribution(matrix(spark, sf), ["trial"]).select("trial", r6("mean"), r6("std"))


@query("agg_24_axis_spread", ["f1"], "SELECT trial, frame, round(max(x)-min(x),6) spread_x, round(max(y)-min(y),6) spread_y, round(max(z)-min(z),6) spread_z FROM f1 GROUP BY trial, frame")
def _(spark, sf):
    return features.axis_spread(X.pose_long(spark, sf), KEY).select("trial", "frame", *[r6(f"spread_{c}") for c in "xyz"])


# ------------------------------------------------------------- still phases
_L = [13, 10, 7, 4]


X.VIEWS["st0"] = (["f12"], "SELECT f12.*, nm FROM f12 JOIN (SELECT trial, count(DISTINCT marker) nm FROM f12 GROUP BY trial) USING (trial)")


def _ranges_view(src):
    parts = []
    for n in _L:
        w = f"(PARTITION BY trial, marker ORDER BY frame ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        span = ", ".join(f"max({c}) OVER {w} - min({c}) OVER {w}" for c in "xyz")
        parts.append(f"SELECT trial, nm, marker, frame AS start, {n} AS n, greatest({span}) r, count(*) OVER {w} c FROM {src}")
    return f"SELECT trial, start, n, max(r) needed FROM ({' UNION ALL '.join(parts)}) WHERE c = n GROUP BY trial, start, n, nm HAVING count(*) = nm"


X.VIEWS["rng"] = (["st0"], _ranges_view("st0"))


def sql_relaxed(sizes, threshold, step, maximum, src="f12", only="TRUE"):
    """(trial, fs, start, n, steps): ``sizes`` maps a rate to its window lengths, ``src`` has a column fs."""
    parts = []
    for fs, lengths in sizes.items():
        for n in lengths:
            w = f"(PARTITION BY trial, marker ORDER BY frame ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
            span = ", ".join(f"max({c}) OVER {w} - min({c}) OVER {w}" for c in "xyz")
            parts.append(f"SELECT trial, fs, nm, frame AS start, {n} AS n, greatest({span}) r, count(*) OVER {w} c FROM q WHERE fs = {fs}")
    return (f"q AS (SELECT *, (SELECT count(DISTINCT b.marker) FROM {src} b WHERE b.trial = a.trial AND {only}) nm FROM {src} a WHERE {only}), "
            f"rg AS (SELECT trial, fs, start, n, max(r) needed FROM ({' UNION ALL '.join(parts)}) WHERE c = n GROUP BY trial, fs, start, n, nm HAVING count(*) = nm), "
            f"st AS (SELECT *, CASE WHEN needed < {threshold} THEN 0 ELSE floor((needed-{threshold})/{step}+1e-9)::BIGINT+1 END steps FROM rg), "
            f"bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY steps, n DESC, start) r FROM st WHERE {threshold}+steps*{step} <= {maximum}) WHERE r=1)")


def ranges(spark, sf):
    return quality.motion_ranges(X.markers_still(spark, sf), _L)


@query("win_17_rate_per_trial", ["f12"],
       "WITH v AS (SELECT *, [20.0::DOUBLE, 30.0::DOUBLE, 40.0::DOUBLE][trial % 3 + 1] fs FROM f12), "
       + sql_relaxed({r: quality.window_lengths(r, 0.1) for r in (20.0, 30.0, 40.0)}, 0.02, 0.003, 0.06, "v")
       + " SELECT t.trial, start, n, steps, CASE WHEN n IS NULL THEN 'not found' ELSE 'ok' END status FROM (SELECT DISTINCT trial FROM f12) t LEFT JOIN bs USING (trial)")
def _(spark, sf):
    d = X.markers_still(spark, sf).withColumn("fs", F.element_at(F.array(F.lit(20.0), F.lit(30.0), F.lit(40.0)), (F.col("trial") % 3 + 1).cast("int")))
    r = quality.motion_ranges(d, quality.window_lengths_of(F.col("fs"), 0.1), of=["fs"])
    return quality.relaxed_still(r, d, 0.02, 0.003, 0.06).select("trial", "start", "n", "steps", "status")


@query("win_16_still_ranges", ["rng"], "SELECT trial, start, n, round(needed,6) needed FROM rng")
def _(spark, sf):
    return ranges(spark, sf).select("trial", "start", "n", r6("needed"))


@query("win_16_first_still", ["rng"],
       "SELECT trial, start, n, round(needed,6) needed FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY n DESC, start) r FROM rng WHERE needed < 0.2) WHERE r=1")
def _(spark, sf):
    return quality.first_still(ranges(spark, sf), 0.2).select("trial", "start", "n", r6("needed"))


@query("win_17_relaxed_still", ["rng", "f12"],
       "WITH s AS (SELECT *, CASE WHEN needed < 0.02 THEN 0 ELSE floor((needed-0.02)/0.003+1e-9)::BIGINT+1 END steps FROM rng), b AS (SELECT trial, start, n, steps FROM (SELECT *, row_number() OVER "
       "(PARTITION BY trial ORDER BY steps, n DESC, start) r FROM s WHERE 0.02+steps*0.003 <= 0.06) WHERE r=1) "
       "SELECT trial, start, n, steps, CASE WHEN n IS NULL THEN 'not found' ELSE 'ok' END status FROM (SELECT DISTINCT trial FROM f12) LEFT JOIN b USING (trial)")
def _(spark, sf):
    d = quality.relaxed_still(ranges(spark, sf), X.markers_still(spark, sf), 0.02, 0.003, 0.06)
    return d.select("trial", "start", "n", "steps", "status")


@query("win_18_prepare_still", ["f8"],
       "WITH r AS (SELECT trial, frame, any_value(x) x, any_value(y) y, any_value(z) z FROM f8 WHERE marker=1 GROUP BY ALL), h AS (SELECT DISTINCT trial FROM r), "
       "m AS (SELECT b.trial, b.marker, b.frame, CASE WHEN h.trial IS NULL THEN b.x ELSE b.x-r.x END x, CASE WHEN h.trial IS NULL THEN b.y ELSE b.y-r.y END y, "
       "CASE WHEN h.trial IS NULL THEN b.z ELSE b.z-r.z END z FROM f8 b LEFT JOIN h USING (trial) LEFT JOIN r ON r.trial=b.trial AND r.frame=b.frame), "
       "g AS (SELECT trial, max(greatest(x,y,z)) mx FROM m GROUP BY trial) SELECT trial, marker, frame, round(CASE WHEN mx>10 THEN y/1000 ELSE y END,9)+0.0 y FROM m JOIN g USING (trial)")
def _(spark, sf):
    d = X.markers_big(spark, sf).withColumn("marker", F.col("marker").cast("string"))
    return quality.prepare_still(d, "1").select("trial", F.col("marker").cast("int").alias("marker"), "frame", (F.round("y", 9) + 0.0).alias("y"))


# ------------------------------------------------------------- readiness
def model_markers(spark, sf):
    dim = literal_table(spark, ["i", "marker"], list(enumerate(D.RESPONSES_NEW_LOWER)))
    d = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model"), (F.col("l_partkey") % 41).cast("int").alias("i")).distinct()
    return d.join(dim, "i").select("model", "marker")


_MM = "SELECT DISTINCT l_suppkey AS model, marker FROM lineitem JOIN " + values(list(enumerate(D.RESPONSES_NEW_LOWER)), "d", ["i", "marker"]) + " ON i = l_partkey % 41"
_TASKS = ["C7_study", "r_knee_study", "L_knee_study", "RHJC_study", "nowhere"]
_PAIRS = [("thigh", "RHJC_study", "r_knee_study"), ("thigh", "LHJC_study", "L_knee_study"), ("torso", "C7_study", "r.PSIS_study"), ("none", "C7_study", "nowhere")]


@query("jon_16_prune_tasks", None,
       f"WITH mm AS ({_MM}) SELECT s_suppkey AS model, t.marker, mm.marker IS NOT NULL AS \"apply\" FROM supplier CROSS JOIN {values([(t,) for t in _TASKS], 't', ['marker'])} LEFT JOIN mm ON mm.model=s_suppkey AND mm.marker=t.marker")
def _(spark, sf):
    t = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("model"), F.explode(F.array(*[F.lit(v) for v in _TASKS])).alias("marker"))
    return quality.prune_tasks(t.withColumn("apply", F.lit(True)), model_markers(spark, sf)).select("model", "marker", "apply")


@query("jon_16_prune_measurements", None,
       f"WITH mm AS ({_MM}) SELECT s_suppkey AS model, meas AS measurement, count(*) pairs, count(*) FILTER (a IN (SELECT marker FROM mm WHERE mm.model=s_suppkey) AND b IN (SELECT marker FROM mm WHERE mm.model=s_suppkey)) complete, "
       f"count(*) FILTER (a IN (SELECT marker FROM mm WHERE mm.model=s_suppkey) AND b IN (SELECT marker FROM mm WHERE mm.model=s_suppkey)) > 0 AS \"apply\" FROM supplier, {values(_PAIRS, 'p', ['meas', 'a', 'b'])} GROUP BY ALL")
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(m).alias("measurement"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in _PAIRS])
    p = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("model"), F.inline(rows))
    return quality.prune_measurements(p, model_markers(spark, sf)).select("model", "measurement", "pairs", "complete", "apply")


@query("agg_31_segment_sanity", None,
       "SELECT l_suppkey AS trial, round(greatest(max(l_discount*12)-min(l_discount*12), max(l_tax*9)-min(l_tax*9), max(l_quantity/50)-min(l_quantity/50)),6) spread, "
       "greatest(max(l_discount*12)-min(l_discount*12), max(l_tax*9)-min(l_tax*9), max(l_quantity/50)-min(l_quantity/50)) <= 1.1 plausible FROM lineitem GROUP BY 1")
def _(spark, sf):
    d = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("trial"), (F.col("l_discount") * 12).alias("sx"), (F.col("l_tax") * 9).alias("sy"), (F.col("l_quantity") / 50).alias("sz"))
    return quality.segment_sanity(d, ["trial"], 1.1).select("trial", r6("spread"), "plausible")


# ------------------------------------------------------------- overlay
_EDGES = values([(D.BODY20.index(a) + 1, D.BODY20.index(b) + 1) for a, b in D.EDGES], "e", ["a", "b"])


def sql_segments(right, bottom, digits):
    """Lengths of the edges whose ends aren't both outside; joints by their place from 1, frames as lists."""
    inside = lambda k: f"(round(us[{k}]) BETWEEN 0 AND {right} AND round(vs[{k}]) BETWEEN 0 AND {bottom})"
    return ("WITH fr AS (SELECT trial, frame, list(u ORDER BY k) us, list(v ORDER BY k) vs FROM f5 GROUP BY ALL) "
            f"SELECT trial, frame, a::BIGINT a, b::BIGINT b, round(sqrt(pow(us[a]-us[b],2)+pow(vs[a]-vs[b],2)),{digits}) length FROM fr, {_EDGES} WHERE {inside('a')} OR {inside('b')}")


@query("jon_14_skeleton_segments", ["f5"],
       sql_segments(499, 279, 6))
def _(spark, sf):
    e = literal_table(spark, ["a", "b"], D.EDGES)
    return overlay.segments(X.pixels(spark, sf), e, KEY, 500, 280).select("trial", "frame", place(D.BODY20, F.col("a")).alias("a"), place(D.BODY20, F.col("b")).alias("b"), r6("length"))


X.VIEWS["pd"] = (["f1"], "SELECT a.trial, a.frame, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d FROM f1 a JOIN f1 b ON a.trial=b.trial AND a.frame=b.frame AND a.k < b.k")


@query("jon_15_pair_distances", ["pd"],
       "SELECT trial, frame, count(*) n_pairs, round(sum(d),6) total, round(min(d),6) shortest, round(max(d),6) longest FROM pd GROUP BY trial, frame")
def _(spark, sf):
    return overlay.pair_summary(X.pose_long(spark, sf), KEY).select("trial", "frame", "n_pairs", r6("total"), r6("shortest"), r6("longest"))


@query("agg_21_median_pair_distance", ["pd"], "SELECT trial, frame, round(median(d),6) med, round(200/(median(d)+1e-6),6) scale FROM pd GROUP BY trial, frame")
def _(spark, sf):
    d = overlay.pair_summary(X.pose_long(spark, sf), KEY)
    return d.select("trial", "frame", r6("median", "med"), r6(200 / (F.col("median") + 1e-6), "scale"))


@query("sca_26_place_orthographic", ["pd", "f1"],
       "WITH m AS (SELECT trial, frame, 189/(median(d)+1e-6) s FROM pd GROUP BY trial, frame) SELECT f1.trial, f1.frame, joint, round((x-avg(x) OVER w)*s+480,6) pu, round((y-avg(y) OVER w)*s+297,6) pv "
       "FROM f1 JOIN m USING (trial, frame) WINDOW w AS (PARTITION BY f1.trial, f1.frame)")
def _(spark, sf):
    d = overlay.place_orthographic(X.pose_long(spark, sf), KEY, 0.35 * 540, (960 * 0.5, 540 * 0.55))
    return d.select("trial", "frame", "joint", r6("pu"), r6("pv"))


@query("sca_27_fit_to_canvas", ["f5"],
       """WITH a AS (SELECT trial, frame, avg(u) mu, avg(v) mv, greatest(max(u)-min(u), max(v)-min(v)) span, 0.5::DOUBLE*atan2(2*covar_pop(u,v), var_pop(u)-var_pop(v)) p FROM f5 GROUP BY trial, frame),
       b AS (SELECT *, -atan2(cos(p), sin(p)) th, CASE WHEN span>0 AND span<200 THEN 0.65::DOUBLE*540/span ELSE 1 END g FROM a)
       SELECT f5.trial, f5.frame, joint, round(cos(th)*((u-mu)*g)-sin(th)*((v-mv)*g)+384,6) pu, round(sin(th)*((u-mu)*g)+cos(th)*((v-mv)*g)+324,6) pv FROM f5 JOIN b USING (trial, frame)""")
def _(spark, sf):
    d = overlay.fit_to_canvas(X.pixels(spark, sf), KEY, 960, 540, small_span=200.0)
    return d.select("trial", "frame", "joint", r6("pu"), r6("pv"))


@query("agg_19_affine_applied", ["f5"], "SELECT trial, frame, joint, round(u,4) pu, round(v,4) pv FROM f5")
def _(spark, sf):
    d = X.pixels(spark, sf)
    p = align.apply_affine(d, align.affine_3d_to_2d(d, KEY), KEY)
    return p.select("trial", "frame", "joint", F.round("pu", 4).alias("pu"), F.round("pv", 4).alias("pv"))
