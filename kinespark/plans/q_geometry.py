"""Queries: scale, body frame, rotations and cameras."""

from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators import camera, frames, scale
from kinespark.plans import fixtures as X
from kinespark.plans.registry import query, r6

HEADS, FEET = [0], list(range(12, 20))
SIDES = {"left_shoulder": 2, "right_shoulder": 3, "left_hip": 8, "right_hip": 9}


# ------------------------------------------------------------- height and scale
_HF = ("SELECT trial, frame, max(sqrt(pow(h.x-f.x,2)+pow(h.y-f.y,2)+pow(h.z-f.z,2))) d FROM f1 h JOIN f1 f USING (trial, frame) "
       "WHERE h.k = 0 AND f.k >= 12 GROUP BY trial, frame")
X.VIEWS["hf"] = (["f1"], _HF)
X.VIEWS["sc"] = (["hf"], "SELECT trial, count(*) n, quantile_cont(d,0.95) h95, median(d) med, avg(d) mean, (1500+10*trial)/quantile_cont(d,0.95) s FROM hf GROUP BY trial")


def distances(spark, sf):
    return X.pose_frames(spark, sf).select("trial", "frame", scale.head_foot_distance("kp", HEADS, FEET).alias("d"))


def heights(spark, sf):
    """Subject height per trial, in millimetres."""
    return X.vectors(spark, sf).select("trial").distinct().select("trial", (1500 + 10 * F.col("trial")).cast("double").alias("height_mm"))


def scales(spark, sf):
    return scale.height_scale(scale.model_height(distances(spark, sf), ["trial"]), heights(spark, sf), ["trial"])


@query("jon_13_head_foot_pairs", ["hf"], "SELECT trial, frame, round(d,6) d FROM hf")
def _(spark, sf):
    return distances(spark, sf).select("trial", "frame", r6("d"))


@query("agg_4_max_head_foot", ["hf"], "SELECT trial, round(max(d),6) d FROM hf GROUP BY trial")
def _(spark, sf):
    return distances(spark, sf).groupBy("trial").agg(r6(F.max("d"), "d"))


@query("agg_5_height_scale", ["sc"],
       "SELECT trial, n, round(h95,6) height_units, round(med,6) median_units, round(mean,6) mean_units, round(s,6) scale, 'ok' status FROM sc")
def _(spark, sf):
    return scales(spark, sf).select("trial", "n", r6("height_units"), r6("median_units"), r6("mean_units"), r6("scale"), "status")


@query("sca_23_apply_scale", ["f4", "sc"],
       "SELECT f4.trial, frame, person, round(s*(1000*e[1]),6) x0, round(s*(1000*e[60]),6) z19 FROM f4 JOIN sc USING (trial)")
def _(spark, sf):
    d = X.persons(spark, sf).select(F.col("trial_id").cast("long").alias("trial"), F.col("frame_index").alias("frame"),
                                    F.posexplode("persons").alias("pos", "p"))
    d = d.join(scales(spark, sf).select("trial", "scale"), "trial")
    d = d.select("trial", "frame", "pos", scale.scale_points(F.col("p.keypoints_xyz"), F.col("scale")).alias("mm"))
    # position in the list is the rank of the person number
    who = X.person_rows(spark, sf).groupBy("trial", "frame").agg(F.array_sort(F.collect_list("person")).alias("ids"))
    return d.join(who, ["trial", "frame"]).select("trial", "frame", F.col("ids")[F.col("pos")].alias("person"),
                                                  r6(F.col("mm")[0][0], "x0"), r6(F.col("mm")[19][2], "z19"))


@query("agg_6_synthetic_joints", ["f1"],
       "SELECT trial, frame, CASE WHEN joint LIKE '%hip' THEN 'mid_hip' ELSE 'neck' END joint, CASE WHEN bool_or(frame%7=0 AND joint='left_hip') THEN NULL "
       "ELSE round(sum(x)*0.5,6) END x FROM f1 WHERE k IN (2,3,8,9) GROUP BY ALL")
def _(spark, sf):
    d = X.pose_long(spark, sf).withColumn("z", F.when(~((F.col("frame") % 7 == 0) & (F.col("joint") == "left_hip")), F.col("z")))
    fk = ["trial", "frame"]
    a = frames.synthetic_joint(d, fk, "neck", "left_shoulder", "right_shoulder")
    b = frames.synthetic_joint(d, fk, "mid_hip", "left_hip", "right_hip")
    return a.unionByName(b).select("trial", "frame", "joint", r6("x"))


# ------------------------------------------------------------- body frame
def _cross(a, b):
    return [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]


def _unit(v, names):
    n = f"sqrt({v[0]}*{v[0]}+{v[1]}*{v[1]}+{v[2]}*{v[2]})"
    return ", ".join(f"{c}/{n} AS {o}" for c, o in zip(v, names))


_pt = lambda k: [f"(1000*e[{3 * k + i + 1}])" for i in range(3)]
_mid = lambda a, b: [f"(({p}+{q})*0.5)" for p, q in zip(_pt(a), _pt(b))]
_minus = lambda a, b: [f"({p}-{q})" for p, q in zip(a, b)]
X.VIEWS["bf1"] = (["vec"], "SELECT *, " + ", ".join(f"{c} AS {n}" for c, n in zip(_mid(8, 9), ("m0", "m1", "m2"))) + ", "
                  + _unit(_minus(_mid(2, 3), _mid(8, 9)), ("u0", "u1", "u2")) + ", " + _unit(_minus(_pt(9), _pt(8)), ("q0", "q1", "q2")) + " FROM vec")
X.VIEWS["bf2"] = (["bf1"], "SELECT *, " + _unit(_cross(("u0", "u1", "u2"), ("q0", "q1", "q2")), ("f0", "f1", "f2")) + " FROM bf1")
X.VIEWS["bf"] = (["bf2"], "SELECT *, " + _unit(_cross(("f0", "f1", "f2"), ("u0", "u1", "u2")), ("r0", "r1", "r2")) + " FROM bf2")


def body(spark, sf):
    return frames.add_body_frame(X.pose_frames(spark, sf), "kp", SIDES)


@query("sca_10_body_axes", ["bf"],
       "SELECT trial, frame, " + ", ".join(f"round({c},6) {c}" for c in ("f0", "f1", "f2", "u0", "u1", "u2", "r0", "r1", "r2", "m0")) + " FROM bf")
def _(spark, sf):
    names = ("f0", "f1", "f2", "u0", "u1", "u2", "r0", "r1", "r2")
    return body(spark, sf).select("trial", "frame", *[r6(F.col("axes")[i], n) for i, n in enumerate(names)], r6(F.col("center")[0], "m0"))


_CAN = ("SELECT f1.trial, f1.frame, joint, round(x-b.m0,6)+0.0 cx, " + ", ".join(
    f"round(a.{a}0*(x-b.m0)+a.{a}1*(y-b.m1)+a.{a}2*(z-b.m2),6)+0.0 \"b{c}\"" for a, c in zip("fur", "xyz"))
    + " FROM f1 JOIN bf b ON b.trial=f1.trial AND b.frame=f1.frame JOIN bf a ON a.trial=f1.trial AND a.frame={af}")


@query("sca_11_canonical_per_frame", ["f1", "bf"], _CAN.format(af="f1.frame"))
def _(spark, sf):
    return frames.canonical_points(body(spark, sf)).select("trial", "frame", "joint", r6("cx"), r6("bx"), r6("by"), r6("bz"))


@query("win_19_first_rotation", ["f1", "bf"], _CAN.format(af="0"))
def _(spark, sf):
    d = frames.first_valid(body(spark, sf), ["trial"], "frame", "axes")
    return frames.canonical_points(d).select("trial", "frame", "joint", r6("cx"), r6("bx"), r6("by"), r6("bz"))


@query("sca_8_distance", ["f8"], "SELECT trial, marker, frame, round(sqrt((x-y)*(x-y)+(y-z)*(y-z)+(z-x)*(z-x)),6) d FROM f8")
def _(spark, sf):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return X.markers_big(spark, sf).select("trial", "marker", "frame", r6(G.distance([x, y, z], [y, z, x]), "d"))


@query("sca_9_safe_normalise", None,
       "SELECT event_id, round(CASE WHEN v=0 THEN 0 ELSE v/sqrt(v*v+4*v*v) END,6) ux FROM (SELECT event_id, CASE WHEN event_id%3=0 THEN 0.0 ELSE value::DOUBLE END v FROM events)")
def _(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value").cast("double"))
    return X.table(spark, sf, "events").select("event_id", r6(G.normalize([v, -2 * v, v * 0.0])[0], "ux"))


# ------------------------------------------------------------- rotations
_XYZ = ["c2*c1", "c2*s1*s0-s2*c0", "c2*s1*c0+s2*s0", "s2*c1", "s2*s1*s0+c2*c0", "s2*s1*c0-c2*s0", "-s1", "c1*s0", "c1*c0"]
_ZYX = ["c1*c2", "-c1*s2", "s1", "s0*s1*c2+c0*s2", "-s0*s1*s2+c0*c2", "-s0*c1", "-c0*s1*c2+s0*s2", "c0*s1*s2+s0*c2", "c0*c1"]
_ANG = ("SELECT c_custkey, " + ", ".join(f"{f}(a{i}) {f[0]}{i}" for i in range(3) for f in ("sin", "cos")) + ", a0, a1, a2 FROM (SELECT c_custkey, "
        "(c_custkey%17)*0.1::DOUBLE a0, (c_custkey%23)*0.05::DOUBLE a1, (c_custkey%29)*0.07::DOUBLE a2 FROM customer)")


def angles(spark, sf):
    k = F.col("c_custkey")
    return X.table(spark, sf, "customer").select("c_custkey", ((k % 17) * 0.1).alias("a0"), ((k % 23) * 0.05).alias("a1"), ((k % 29) * 0.07).alias("a2"))


for _order, _els in (("xyz", _XYZ), ("zyx", _ZYX)):
    def _make(order, els):
        @query(f"sca_15_euler_{order}", None, "SELECT c_custkey, " + ", ".join(f"round({e},6)+0.0 m{i}" for i, e in enumerate(els)) + f" FROM ({_ANG})")
        def _(spark, sf):
            m = G.euler_matrix(F.col("a0"), F.col("a1"), F.col("a2"), order)
            return angles(spark, sf).select("c_custkey", *[r6(c, f"m{i}") for i, c in enumerate(m)])
    _make(_order, _els)


def _rod(i, j):
    skew = {(0, 1): "-k2", (0, 2): "k1", (1, 0): "k2", (1, 2): "-k0", (2, 0): "-k1", (2, 1): "k0"}
    e = f"(1-cos(th))*k{i}*k{j}" + ("+cos(th)" if i == j else f"+sin(th)*({skew[(i, j)]})")
    return f"round({e},6)+0.0 m{3 * i + j}"


@query("sca_15_rodrigues", None,
       "SELECT c_custkey, " + ", ".join(_rod(i, j) for i in range(3) for j in range(3)) + " FROM (SELECT c_custkey, th, " + ", ".join(
           f"CASE WHEN th<1e-12 THEN 0 ELSE a{i}/th END k{i}" for i in range(3)) + f" FROM (SELECT *, sqrt(a0*a0+a1*a1+a2*a2) th FROM ({_ANG})))")
def _(spark, sf):
    m = G.rodrigues(F.col("a0"), F.col("a1"), F.col("a2"))
    return angles(spark, sf).select("c_custkey", *[r6(c, f"m{i}") for i, c in enumerate(m)])


@query("sca_24_rotation_validity", None,
       "SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN 'ok' WHEN 1 THEN 'flipped' ELSE 'rejected' END kind FROM customer")
def _(spark, sf):
    m = G.euler_matrix(F.col("a0"), F.col("a1"), F.col("a2"))
    which = F.col("c_custkey") % 3
    d = angles(spark, sf).select("c_custkey", F.array(*[
        F.when(which == 1, -c if i % 3 == 2 else c).when(which == 2, c * 1.01).otherwise(c) for i, c in enumerate(m)]).alias("m"))
    d = d.withColumn("v", G.valid_rotation(F.col("m")))
    kind = F.when(F.col("v").isNull(), "rejected").when(G.det(G.elements(F.col("m"))) > 0, "ok").otherwise("flipped")
    return d.select("c_custkey", kind.alias("kind"))


@query("sca_19_axis_remap", ["f8"], "SELECT trial, marker, frame, round(-y,6) a, round(x,6) b, round(z,6) c, round(z,6) d FROM f8")
def _(spark, sf):
    v = [F.col(c) for c in "xyz"]
    p, q = G.remap_axes(v, "forward_left_up"), G.remap_axes(v, "+z, -x, y")
    return X.markers_big(spark, sf).select("trial", "marker", "frame", r6(p[0], "a"), r6(p[1], "b"), r6(p[2], "c"), r6(q[0], "d"))


@query("sca_20_trajectory_transforms", ["f8"],
       "SELECT trial, marker, frame, round(2*(cos(radians(30))*x+sin(radians(30))*z),6) x, round(3*(y+1.5),6) y, round(0.5*(-sin(radians(30))*x+cos(radians(30))*z),6) z FROM f8")
def _(spark, sf):
    from kinespark.operators import trajectory as T
    d = T.scale(T.offset(T.rotate(X.markers_big(spark, sf), "y", 30.0), "y", 1.5), (2.0, 3.0, 0.5))
    return d.select("trial", "marker", "frame", r6("x"), r6("y"), r6("z"))


@query("sca_21_noise")
def _(spark, sf):
    from kinespark.operators import trajectory as T
    d = T.add_noise(X.markers_big(spark, sf), 0.5, seed=7)
    return d.groupBy("marker").agg(F.count("x").alias("n"), F.round(F.avg("x"), 1).alias("mean_x"))


@query("sca_22_unit_conversion", ["f8"],
       "WITH m AS (SELECT trial, max(greatest(x,y,z)) mx FROM f8 GROUP BY trial) SELECT trial, marker, frame, "
       "round(CASE WHEN trial%3=0 THEN y*0.001 WHEN trial%3=1 THEN y WHEN mx>10 THEN y/1000 ELSE y END,9) y FROM f8 JOIN m USING (trial)")
def _(spark, sf):
    from kinespark.operators import trajectory as T
    k = F.col("trial") % 3
    d = X.markers_big(spark, sf).withColumn("units", F.when(k == 0, "mm").when(k == 1, "m"))
    return T.to_metres(d, ["trial"], "units").select("trial", "marker", "frame", F.round("y", 9).alias("y"))


# ------------------------------------------------------------- cameras
X.VIEWS["cal0"] = (["vec"], "SELECT trial, 900.0::DOUBLE+10*trial fx, 880.0::DOUBLE+5*trial fy, 480.0::DOUBLE cx0, 270.0::DOUBLE cy0, -0.1::DOUBLE+0.01*trial k1, 0.02::DOUBLE k2, "
                   "0.001::DOUBLE p1, -0.002::DOUBLE p2, 0.003::DOUBLE k3, 0.1::DOUBLE*trial a0, 0.05::DOUBLE a1, 0.02::DOUBLE*trial a2, 10.0::DOUBLE*trial t0, -20.0::DOUBLE t1, 3000.0::DOUBLE+trial t2 "
                   "FROM (SELECT DISTINCT trial FROM vec)")
X.VIEWS["cal"] = (["cal0"], "SELECT *, " + ", ".join(f"{e} AS r{i}" for i, e in enumerate(_XYZ)) + " FROM (SELECT *, " + ", ".join(
    f"{f}(a{i}) {f[0]}{i}" for i in range(3) for f in ("sin", "cos")) + " FROM cal0)")
X.VIEWS["cam"] = (["f1", "cal"], "SELECT f1.trial, frame, k, joint, x, y, z, " + ", ".join(
    f"r{3 * i}*x+r{3 * i + 1}*y+r{3 * i + 2}*z+t{i} AS c{c}" for i, c in enumerate("xyz")) + " FROM f1 JOIN cal USING (trial)")


def calibrations(spark, sf):
    t = X.vectors(spark, sf).select("trial").distinct()
    k, z, one = F.col("trial"), F.lit(0.0), F.lit(1.0)
    r = G.euler_matrix(0.1 * k, F.lit(0.05), 0.02 * k)
    return t.select(
        "trial", F.array(900.0 + 10 * k, z, F.lit(480.0), z, 880.0 + 5 * k, F.lit(270.0), z, z, one).alias("K"),
        F.array(-0.1 + 0.01 * k, F.lit(0.02), F.lit(0.001), F.lit(-0.002), F.lit(0.003)).alias("dist"),
        F.array(*r).alias("R"), F.array(10.0 * k, F.lit(-20.0), 3000.0 + k).alias("t"),
        F.lit(960).alias("width"), F.lit(540).alias("height"))


_PROJ = ("SELECT m.trial, frame, k, joint, x, y, z, cz, fx*(a*(1+rr*(k1+rr*(k2+rr*k3)))+2*p1*a*b+p2*(rr+2*a*a))+cx0 pu, "
         "fy*(b*(1+rr*(k1+rr*(k2+rr*k3)))+p1*(rr+2*b*b)+2*p2*a*b)+cy0 pv FROM (SELECT *, a*a+b*b rr FROM (SELECT *, cx/cz a, cy/cz b FROM cam)) m JOIN cal USING (trial)")
X.VIEWS["prj"] = (["cam", "cal"], _PROJ)


def in_camera(spark, sf):
    return camera.to_camera(X.pose_long(spark, sf), calibrations(spark, sf))


@query("sca_14_camera_points", ["cam"], "SELECT trial, frame, joint, round(cx,6) cx, round(cy,6) cy, round(cz,6) cz FROM cam")
def _(spark, sf):
    return in_camera(spark, sf).select("trial", "frame", "joint", r6("cx"), r6("cy"), r6("cz"))


@query("sca_13_invert_extrinsics", ["f1"], "SELECT trial, frame, joint, round(x,5) x, round(y,5) y, round(z,5) z FROM f1")
def _(spark, sf):
    c = in_camera(spark, sf).select("trial", "frame", "joint", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    w = camera.to_world(c, calibrations(spark, sf))
    return w.select("trial", "frame", "joint", *[(F.round(f"w{n}", 5) + 0.0).alias(n) for n in "xyz"])


@query("sca_16_project", ["prj"], "SELECT trial, frame, joint, round(pu,6) pu, round(pv,6) pv FROM prj")
def _(spark, sf):
    return camera.project(in_camera(spark, sf), calibrations(spark, sf)).select("trial", "frame", "joint", r6("pu"), r6("pv"))


@query("sca_16_project_identity", ["f1", "cal"],
       "SELECT trial, frame, joint, round(fx*(x/(z+5000))+cx0,6) pu, round(fy*(y/(z+5000))+cy0,6) pv FROM f1 JOIN cal USING (trial)")
def _(spark, sf):
    d = X.pose_long(spark, sf).withColumn("z", F.col("z") + 5000)
    d = camera.project(d, calibrations(spark, sf), coords=("x", "y", "z"), distortion=False)
    return d.select("trial", "frame", "joint", r6("pu"), r6("pv"))


X.VIEWS["und0"] = (["f5", "cal"], "SELECT trial, frame, joint, u, v, fx, fy, cx0, cy0, k1, k2, k3, p1, p2, (u-cx0)/fx ua, (v-cy0)/fy ub, (u-cx0)/fx a, (v-cy0)/fy b FROM f5 JOIN cal USING (trial)")
for _i in range(5):
    X.VIEWS[f"und{_i + 1}"] = ([f"und{_i}"], "SELECT * EXCLUDE (a, b, rr), (ua-(2*p1*a*b+p2*(rr+2*a*a)))/(1+rr*(k1+rr*(k2+rr*k3))) a, "
                               f"(ub-(p1*(rr+2*b*b)+2*p2*a*b))/(1+rr*(k1+rr*(k2+rr*k3))) b FROM (SELECT *, a*a+b*b rr FROM und{_i})")
X.VIEWS["und"] = (["und5"], "SELECT trial, frame, joint, u, v, fx*a+cx0 uu, fy*b+cy0 uv FROM und5")


@query("sca_17_undistort", ["und"], "SELECT trial, frame, joint, round(uu,6) uu, round(uv,6) uv FROM und")
def _(spark, sf):
    return camera.undistort(X.pixels(spark, sf), calibrations(spark, sf)).select("trial", "frame", "joint", r6("uu"), r6("uv"))


@query("agg_27_undistort_decision", ["und"],
       "SELECT trial, round(median(sqrt(pow(uu-u,2)+pow(uv-v,2))),6) median_shift, median(sqrt(pow(uu-u,2)+pow(uv-v,2))) >= 0.1 AS \"undistort\" FROM und GROUP BY trial")
def _(spark, sf):
    d = camera.undistort_decision(X.pixels(spark, sf), calibrations(spark, sf))
    return d.select("trial", r6("median_shift"), "undistort")


@query("agg_26_reprojection_rmse", ["prj", "f5"],
       "SELECT trial, frame, round(sqrt(avg(pow(pu-u,2)+pow(pv-v,2))),6) rmse_px FROM prj JOIN f5 USING (trial, frame, joint) GROUP BY trial, frame")
def _(spark, sf):
    p = camera.project(in_camera(spark, sf), calibrations(spark, sf)).select("trial", "frame", "joint", "pu", "pv")
    d = p.join(X.pixels(spark, sf).select("trial", "frame", "joint", "u", "v"), ["trial", "frame", "joint"])
    return camera.reprojection_rmse(d, ["trial", "frame"]).select("trial", "frame", r6("rmse_px"))


@query("agg_28_depth_report", ["prj"],
       "SELECT trial, round(median(cz-3000),6) median_z, round(avg((cz-3000<=0)::INT),6) behind, round(min(pu),6) min_pu, round(max(pu),6) max_pu, round(min(pv),6) min_pv, round(max(pv),6) max_pv FROM prj GROUP BY trial")
def _(spark, sf):
    d = camera.project(in_camera(spark, sf), calibrations(spark, sf)).withColumn("cz", F.col("cz") - 3000)
    return camera.depth_report(d, ["trial"]).select("trial", *[r6(c) for c in ("median_z", "behind", "min_pu", "max_pu", "min_pv", "max_pv")])


@query("sca_31_place_with_rotation", ["f1", "cal"],
       "SELECT trial, frame, count(*) n, round(t0,4) tx, round(t1,4) ty, round(t2,4) tz FROM f1 JOIN cal USING (trial) GROUP BY ALL")
def _(spark, sf):
    cal = calibrations(spark, sf)
    d = camera.project(in_camera(spark, sf), cal, distortion=False).withColumnsRenamed({"pu": "u", "pv": "v"})
    p = camera.place_with_rotation(d, cal, ["trial", "frame"])
    return p.select("trial", "frame", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("tx", "ty", "tz")])


def image_sizes(spark, sf):
    k = F.col("c_custkey")
    w0, h0 = 640 + 10 * (k % 50), 480 + 5 * (k % 40)
    return X.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 2 == 0, F.array(w0, h0)).otherwise(F.array(h0, w0)).cast("array<double>").alias("size"),
        F.array(*[F.lit(v) for v in (900.0, 0.0, 320.0, 0.0, 880.0, 240.0, 0.0, 0.0, 1.0)]).alias("K"),
        (w0 * 1.5).alias("w"), (h0 * 1.5).alias("h"))


_SIZE = "SELECT c_custkey, 640.0::DOUBLE+10*(c_custkey%50) w0, 480.0::DOUBLE+5*(c_custkey%40) h0 FROM customer"


@query("sca_18_rescale_intrinsics", None,
       f"SELECT c_custkey, 900*1.5::DOUBLE fx, 320*1.5::DOUBLE cx, 880*1.5::DOUBLE fy, 240*1.5::DOUBLE cy, w0*0.75 ccx, greatest(w0, h0)*1.5 sf FROM ({_SIZE})")
def _(spark, sf):
    d = image_sizes(spark, sf)
    d = d.withColumn("N", camera.rescale_intrinsics(F.col("K"), F.col("size"), F.col("w"), F.col("h")))
    c = camera.centered_principal_point(F.col("N"), F.col("w"), F.col("h"))
    s = camera.synthetic_intrinsics(F.col("w"), F.col("h"))
    n = F.col("N")
    return d.select("c_custkey", r6(n[0], "fx"), r6(n[2], "cx"), r6(n[4], "fy"), r6(n[5], "cy"), r6(c[2], "ccx"), r6(s[0], "sf"))


@query("top_6_best_candidate", ["f1"],
       "SELECT trial, min_by(joint, row(round(d,6), joint)) joint FROM (SELECT trial, joint, abs(avg(x)) d FROM f1 GROUP BY ALL) GROUP BY trial")
def _(spark, sf):
    d = X.pose_long(spark, sf).groupBy("trial", "joint").agg(F.round(F.abs(F.avg("x")), 6).alias("d"))
    return camera.axis_candidates(d, ["trial"], "d", "joint")


