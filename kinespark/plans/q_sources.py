"""Queries: files written to the shared scratch folder and read back."""

from pyspark.sql import functions as F

from kinespark.functions import dims as D
from kinespark.functions import geometry as G
from kinespark.operators import errors
from kinespark.plans import fixtures as X
from kinespark.plans import q_errors as E
from kinespark.plans.registry import query, r6
from kinespark.session import scratch_path
from kinespark.sources import calibration, jsonl, manifest, tables, trc


@query("src_1_trial_catalogue", ["f10"],
       "SELECT subject_id, session, camera, fps_video, subset, id, row_number() OVER (PARTITION BY subject_id, subset ORDER BY n_nationkey) - 1 AS trial_pos FROM f10")
def _(spark, sf):
    return manifest.trial_catalogue(X.manifest(spark, sf)).select("subject_id", "session", "camera", "fps_video", "subset", "id",
                                                                  F.col("trial_pos").cast("long").alias("trial_pos"))


@query("src_2_resolve_placeholders", ["f10"],
       "SELECT id, concat(root, '/mocap/', id, '.trc') mocap_trc, concat(root, '/video/', lower(id), '.avi') video_sync, "
       "CASE WHEN r_regionkey%2=0 THEN concat(root,'/output') END output_dir, 1 AS n_bad FROM f10")
def _(spark, sf):
    d = manifest.trial_catalogue(X.manifest(spark, sf)).withColumn("bad", F.lit("${nowhere.x}/a"))
    d = manifest.resolve_columns(d, X.manifest_vars(spark, sf), ["mocap_trc", "video_sync", "output_dir", "bad"], root="root")
    return d.select("id", "mocap_trc", "video_sync", "output_dir", F.size("unresolved").alias("n_bad"))


@query("src_17_output_layout", ["f10"],
       "SELECT id, concat(CASE WHEN r_regionkey%2=0 THEN '${paths.root}/output' ELSE concat('/out/', subject_id, '/Session1/', camera) END, '/', id) path FROM f10")
def _(spark, sf):
    d = manifest.trial_catalogue(X.manifest(spark, sf))
    return d.select("id", manifest.output_dir("/out").alias("path"))


def frames_file(spark, sf):
    path = scratch_path(spark, "frames")
    jsonl.write_frames(X.persons(spark, sf), path)
    return path


@query("src_3_scan_frames", ["f4i"],
       "SELECT trial::VARCHAR trial_id, frame frame_index, round(frame/60.0,6) time_sec, count(*) persons, round(sum(mean_score),6) s, round(sum(1000*e[4]),6) x1 FROM f4i GROUP BY trial, frame")
def _(spark, sf):
    d = jsonl.read_frames(spark, frames_file(spark, sf))
    total = lambda f: F.aggregate(F.transform("persons", f), F.lit(0.0), lambda a, v: a + v)
    return d.select("trial_id", "frame_index", r6("time_sec"), F.size("persons").cast("long").alias("persons"),
                    r6(total(lambda p: p["mean_score"]), "s"), r6(total(lambda p: p["keypoints_xyz"][1][0]), "x1"))


@query("src_5_write_frames", ["f4"], "SELECT trial::VARCHAR trial_id, count(DISTINCT frame) n FROM f4 GROUP BY trial")
def _(spark, sf):
    return jsonl.read_frames(spark, frames_file(spark, sf)).groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))


def variant_lines(spark, sf):
    """F4 rendered under different field names, and one broken line per file."""
    d = X.persons(spark, sf).where(F.size("persons") > 0)
    m = F.col("frame_index") % 4
    px = F.transform("persons", lambda p: p["keypoints_px"])
    base = [F.col("trial_id"), F.col("frame_index"), F.col("time_sec")]
    flat = lambda p: F.flatten(p["keypoints_xyz"])
    a = F.to_json(F.struct(*base, F.transform("persons", lambda p: F.struct(
        p["keypoints_px"].alias("keypoints_px"), p["keypoints_xyz"].alias("keypoints_xyz_mm"), p["mean_score"].alias("mean_score"))).alias("persons")))
    b = F.to_json(F.struct(*base, F.transform("persons", lambda p: F.struct(
        F.struct(F.transform(p["keypoints_px"], lambda q: q[0]).alias("x"), F.transform(p["keypoints_px"], lambda q: q[1]).alias("y")).alias("kps2d"),
        flat(p).alias("xyz_mm"), p["mean_score"].alias("confidence"))).alias("people")))
    c = F.to_json(F.struct(*base, F.transform("persons", lambda p: F.struct(
        p["keypoints_px"].alias("pose_2d"), flat(p).alias("pose3d_mm"))).alias("predictions")))
    e = F.to_json(F.struct(*base, F.struct(px[0].alias("keypoints"), F.col("persons")[0]["mean_score"].cast("string").alias("score")).alias("person")))
    line = F.when(m == 0, a).when(m == 1, b).when(m == 2, c).otherwise(e)
    return d.select(F.explode(F.array(line, F.when(F.col("frame_index") == 0, F.lit('{"trial_id": "0", "frame_')))).alias("value")).where("value is not null")


@query("src_4_alias_scan", ["f4i"],
       "SELECT trial::VARCHAR trial_id, frame frame_index, idx::INTEGER person, round(480+400*e[4],6) u1, round(270+400*e[5],6) v1, CASE WHEN frame%4<3 THEN round(1000*e[60],6) END z19, "
       "CASE WHEN frame%4=2 THEN 1.0::DOUBLE ELSE round(mean_score,6) END s FROM f4i WHERE frame%4<3 OR idx=0")
def _(spark, sf):
    path = scratch_path(spark, "variants")
    variant_lines(spark, sf).write.text(path)
    d = jsonl.read_any_frames(spark, path)
    return d.select("trial_id", "frame_index", "person", r6(F.col("xy")[1][0], "u1"), r6(F.col("xy")[1][1], "v1"),
                    r6(F.col("xyz")[19][2], "z19"), r6("mean_score", "s"))


@query("sca_28_point_forms", ["f4i"],
       "SELECT trial, frame AS frame_index, idx::INTEGER person, k, round(480+400*e[3*k+1],6) u, round(270+400*e[3*k+2],6) v, CASE WHEN frame%4<3 THEN round(1000*e[3*k+1],6)+0.0 END x, "
       "CASE WHEN frame%4<3 THEN round(1000*e[3*k+3],6)+0.0 END z FROM f4i, range(20) r(k) WHERE frame%4<3 OR idx=0")
def _(spark, sf):
    path = scratch_path(spark, "variants")
    variant_lines(spark, sf).write.text(path)
    # pairs and triples, objects of lists, flat lists, and frames with 2D points only
    d = jsonl.read_any_frames(spark, path)
    d = d.select(F.col("trial_id").cast("long").alias("trial"), "frame_index", "person", F.posexplode(F.arrays_zip("xy", F.coalesce("xyz", F.array().cast("array<array<double>>")).alias("xyz"))).alias("k", "p"))
    return d.select("trial", "frame_index", "person", F.col("k").cast("long").alias("k"), r6(F.col("p.xy")[0], "u"), r6(F.col("p.xy")[1], "v"),
                    r6(F.col("p.xyz")[0], "x"), r6(F.col("p.xyz")[2], "z"))


def trc_rows(spark, sf):
    gap = (F.col("frame") % 10 == 3) & (F.col("k") == 4)
    return X.pose_long(spark, sf).select("trial", "frame", F.col("joint").alias("marker"),
                                         *[F.when(~gap, F.col(c)).alias(c) for c in "xyz"])


def trc_folder(spark, sf):
    path = scratch_path(spark, "trc")
    trc.write_trc(trc_rows(spark, sf), path, 60.0, D.BODY20)
    return path


_GAP = "NOT (frame%10=3 AND k=4)"


@query("src_6_trc_strict", ["f1"],
       f"SELECT trial::VARCHAR trial, frame, round(t,6) t, joint marker, CASE WHEN {_GAP} THEN round(x,5) END x, CASE WHEN {_GAP} THEN round(z,5) END z FROM f1")
def _(spark, sf):
    _, rows, _ = trc.read_trc(spark, trc_folder(spark, sf))
    return rows.select("trial", "frame", r6("t"), "marker", (F.col("x") + 0.0).alias("x"), (F.col("z") + 0.0).alias("z"))


@query("src_6_trc_errors", ["f1"], "SELECT trial::VARCHAR trial, count(DISTINCT frame) FILTER (frame%7=2) n_bad FROM f1 GROUP BY trial")
def _(spark, sf):
    path = scratch_path(spark, "trc")
    lines = trc.trc_lines(trc_rows(spark, sf), 60.0, D.BODY20)
    cut = (F.col("pos") >= 6) & ((F.col("pos") - 6) % 7 == 2)
    lines = lines.withColumn("value", F.when(cut, F.regexp_replace("line", "\t[^\t]*$", "")).otherwise(F.col("line")))
    lines.repartitionByRange("trial", "pos").sortWithinPartitions("trial", "pos").select("trial", "value").write.partitionBy("trial").text(path)
    _, _, bad = trc.read_trc(spark, path)
    return bad.groupBy("trial").agg(F.count(F.lit(1)).alias("n_bad"))


@query("src_7_trc_tolerant", ["f1"],
       f"SELECT trial::VARCHAR trial, frame+1 AS frame, joint marker, CASE WHEN {_GAP} THEN round(round(y,5)/1000,9) END y FROM f1")
def _(spark, sf):
    _, rows = trc.read_any_trc(spark, trc_folder(spark, sf))
    return rows.select("trial", "frame", "marker", (F.round("y", 9) + 0.0).alias("y"))


@query("src_8_header_check", ["f1"],
       "SELECT trial::VARCHAR trial, count(DISTINCT frame) frames, 20 markers, false frames_differ, false markers_differ FROM f1 GROUP BY trial")
def _(spark, sf):
    header, rows, _ = trc.read_trc(spark, trc_folder(spark, sf))
    return trc.check_header(header, rows)


@query("src_9_trc_lines", ["f1"],
       "WITH n AS (SELECT trial, (max(frame)+1)::VARCHAR f FROM f1 GROUP BY trial), h AS (SELECT trial, unnest(range(6)) pos, unnest([concat('PathFileType', chr(9), '4', chr(9), '(X/Y/Z)', chr(9), trial, '.trc'), "
       "'" + "\t".join(trc.HEADER_FIELDS) + "', concat('60.0', chr(9), '60.0', chr(9), f, chr(9), '20', chr(9), 'mm', chr(9), '60.0', chr(9), '1', chr(9), f), "
       "'Frame#\tTime\t" + "\t\t\t".join(D.BODY20) + "\t\t\t', '\t" + "\t".join(f"{c}{i}" for i in range(1, 21) for c in "XYZ") + "', '']) line FROM n) "
       "SELECT trial, pos, line FROM h UNION ALL SELECT trial, frame + 6 pos, concat(frame+1, chr(9), printf('%.8f', frame/60.0), chr(9), string_agg(CASE WHEN " + _GAP +
       " THEN concat(printf('%.5f',x), chr(9), printf('%.5f',y), chr(9), printf('%.5f',z)) ELSE concat(chr(9), chr(9)) END, chr(9) ORDER BY k)) line FROM f1 GROUP BY trial, frame")
def _(spark, sf):
    return trc.trc_lines(trc_rows(spark, sf), 60.0, D.BODY20)


def meta_rows(spark, sf):
    c = X.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("string").alias("trial"), F.lit("body").alias("dataset_name"), F.array(*[F.lit(j) for j in D.BODY20]).alias("keypoint_names"),
        F.struct(k.cast("string").alias("id"), F.when(k % 2 == 0, "male").otherwise("female").alias("sex"),
                 F.when(k % 7 != 0, 1.5 + (k % 50) / 100.0).alias("height_m"), F.when(k % 5 != 0, 50.0 + k % 40).otherwise(F.lit(0.0)).alias("mass_kg")).alias("subject"),
        F.concat(F.lit("cam"), k % 3).alias("calibration"), F.lit(60.0).alias("fps"))


@query("src_10_meta", None,
       "SELECT c_custkey::VARCHAR trial, CASE WHEN c_custkey%7<>0 THEN round(1.5+(c_custkey%50)/100.0,6) END height_m, (c_custkey%7=0)::INT + (c_custkey%5=0)::INT n_missing FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "meta")
    meta_rows(spark, sf).write.json(path)
    # many records per file here; single-document files use read_meta
    d = tables.check_meta(spark.read.schema(tables.META_SCHEMA).json(path))
    return d.select("trial", r6("subject.height_m", "height_m"), F.size("missing").alias("n_missing"))


@query("src_10_meta_documents", None,
       "SELECT n_nationkey::VARCHAR trial, CASE WHEN n_nationkey%7<>0 THEN round(1.5+n_nationkey/100.0,6) END height_m, CASE WHEN n_nationkey%7=0 THEN 'height_m,mass_kg' ELSE 'mass_kg' END missing FROM nation")
def _(spark, sf):
    # one indented document per file
    k = F.col("n_nationkey")
    doc = F.struct(k.cast("string").alias("trial"), F.array("n_name").alias("keypoint_names"), F.struct(
        k.cast("string").alias("id"), F.when(k % 7 != 0, 1.5 + k / 100.0).alias("height_m"), F.lit(-1.0).alias("mass_kg")).alias("subject"))
    path = scratch_path(spark, "documents")
    X.table(spark, sf, "nation").select(k, F.to_json(doc, {"pretty": "true"}).alias("value")).write.partitionBy("n_nationkey").text(path)
    d = tables.check_meta(tables.read_meta(spark, path))
    return d.select("trial", r6("subject.height_m", "height_m"), F.array_join("missing", ",").alias("missing"))


@query("src_18_meta_once", None, "SELECT concat('cam', c_custkey%3) calibration, 1::BIGINT n FROM customer GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "meta")
    tables.write_meta_once(meta_rows(spark, sf), ["calibration"], path)
    return spark.read.schema(tables.META_SCHEMA).json(path).groupBy("calibration").agg(F.count(F.lit(1)).alias("n"))


def write_documents(d, key, element, path):
    """XML documents of at most a thousand keys each."""
    docs = d.select(F.floor(F.col(key) / 1000).alias("part"), element.alias("e")).groupBy("part").agg(
        F.concat(F.lit("<Set>"), F.concat_ws("", F.collect_list("e")), F.lit("</Set>")).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(path)


@query("src_11_camera_xml", None,
       "SELECT s_suppkey, round((800.0+s_suppkey)*1.25::DOUBLE,6) fx, (800.0+s_suppkey)::DOUBLE fy, round(0.01::DOUBLE*(s_suppkey%5),6) k1, 640+s_suppkey%9 AS width, round(cos(0.01*s_suppkey),6) r00, round(-sin(0.01*s_suppkey),6)+0.0 r01, (10.0*s_suppkey)::DOUBLE tx FROM supplier")
def _(spark, sf):
    s = X.table(spark, sf, "supplier")
    path = scratch_path(spark, "xml")
    xml = F.format_string(
        '<Camera><Id>%d</Id><Geometry width="%d" height="480"/><Intrinsic focal="%d.0" sx="1.25" cx="320" cy="240" kappa1="%s"/>'
        '<Extrinsic tx="%d" ty="0" tz="3000" rx="0" ry="0" rz="%s"/></Camera>',
        F.col("s_suppkey"), 640 + F.col("s_suppkey") % 9, 800 + F.col("s_suppkey"), (0.01 * (F.col("s_suppkey") % 5)).cast("string"),
        10 * F.col("s_suppkey"), (0.01 * F.col("s_suppkey")).cast("string"))
    write_documents(s, "s_suppkey", xml, path)
    d = spark.read.format("xml").option("rowTag", "Camera").schema("Id long, " + calibration.CAMERA_XML).load(path)
    d = calibration.camera_rows(d, "rodrigues")
    return d.select(F.col("Id").alias("s_suppkey"), r6(F.col("K")[0], "fx"), r6(F.col("K")[4], "fy"), r6(F.col("dist")[0], "k1"), "width",
                    r6(F.col("R")[0], "r00"), r6(F.col("R")[1], "r01"), r6(F.col("t")[0], "tx"))


@query("src_12_extrinsics", None,
       "SELECT c_custkey, CASE WHEN c_custkey%4<>3 THEN round(cos(0.1*(c_custkey%17)),6) END r00, CASE c_custkey%4 WHEN 0 THEN 1500.0::DOUBLE WHEN 1 THEN 1500.0 WHEN 2 THEN 1.5 ELSE 1500.0 END t0 FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    m = G.axis_rotation("z", 0.1 * (k % 17))
    flat = F.array(*m)
    rows = F.array(*[F.array(*m[3 * i:3 * i + 3]) for i in range(3)])
    big = F.array(*[F.array(*m[3 * i:3 * i + 3], F.lit(9.0)) for i in range(3)], F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))
    bad = F.array(*[c * 1.1 for c in m])
    t = lambda v: F.array(F.lit(v), F.lit(0.0), F.lit(0.0))
    js = F.when(k % 4 == 0, F.to_json(F.struct(rows.alias("R"), t(1.5).alias("t")))).when(
        k % 4 == 1, F.to_json(F.struct(big.alias("matrix"), t(1.5).alias("translation"), F.lit("m").alias("unit")))).when(
        k % 4 == 2, F.to_json(F.struct(flat.alias("rotation"), t(1.5).alias("t_fromMocap_toVideo"), F.lit("mm").alias("unit")))).otherwise(
        F.to_json(F.struct(bad.alias("R"), t(1500.0).alias("C_w"))))
    d = calibration.normalise_extrinsics(X.table(spark, sf, "customer").select("c_custkey", js.alias("json")))
    return d.select("c_custkey", r6(F.col("R")[0], "r00"), r6(F.col("t_mm")[0], "t0"))


@query("src_13_model_xml", None,
       "SELECT concat('m', p_partkey) marker, (p_partkey%7)::DOUBLE x, (p_partkey%2=0) fixed, (1+p_partkey%30)::DOUBLE weight FROM part")
def _(spark, sf):
    path = scratch_path(spark, "model")
    k = F.col("p_partkey")
    xml = F.format_string(
        '<Marker name="m%d"><socket_parent_frame>/b/pelvis</socket_parent_frame><location> %d 0.5 1 </location><fixed>%s</fixed></Marker>'
        '<IKMarkerTask name="m%d"><apply>true</apply><weight>%d</weight></IKMarkerTask>', k, k % 7, (k % 2 == 0).cast("string"), k, 1 + k % 30)
    write_documents(X.table(spark, sf, "part"), "p_partkey", xml, path)
    m = calibration.read_model_markers(spark, path).select("marker", F.col("location")[0].alias("x"), "fixed")
    return m.join(calibration.read_tracking_tasks(spark, path).select("marker", "weight"), "marker")


@query("src_14_report", ["f3d"],
       "SELECT trial, round(avg(d),6) mpjpe, count(DISTINCT joint) joints, round(avg(d) FILTER (joint='neck'),6) neck FROM f3d GROUP BY trial")
def _(spark, sf):
    d = E.scored(spark, sf)
    rec = tables.report_records(errors.per_joint(d, ["trial"]).select("trial", "joint", "mpjpe"), errors.overall_micro(d, ["trial"]))
    path = scratch_path(spark, "report")
    tables.write_report(rec, path)
    back = spark.read.schema("trial long, mpjpe double, per_joint_mpjpe map<string,double>").json(path)
    return back.select("trial", r6("mpjpe"), F.size("per_joint_mpjpe").cast("long").alias("joints"), r6(F.col("per_joint_mpjpe")["neck"], "neck"))


@query("src_15_series", ["f3c"], "SELECT trial, v AS variant, count(*) n, round(sum(CASE WHEN v='reference' THEN rx ELSE x END),6) sx FROM f3c, (VALUES ('reference'), ('prediction')) s(v) GROUP BY ALL")
def _(spark, sf):
    d = E.centered(spark, sf)
    side = lambda n, p: d.select("trial", F.lit(n).alias("variant"), "frame", "t", "joint", *[F.col(p + c).alias(c) for c in "xyz"])
    path = scratch_path(spark, "series")
    tables.write_series(side("prediction", "").unionByName(side("reference", "r")), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("trial").cast("long").alias("trial"), "variant").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x"), "sx"))


@query("src_16_bundles", ["f1"], "SELECT trial, frame AS i, round(CASE WHEN trial%2=0 THEN frame/50.0 ELSE frame/60.0 END,6) t, joint marker, round(x,6) x FROM f1")
def _(spark, sf):
    # bundles are bounded pieces: one frame range of a trial per row
    d = X.pose_frames(spark, sf).withColumn("row", F.transform("kp", lambda p: F.array(p["x"], p["y"], p["z"])))
    piece = d.groupBy("trial", F.floor(F.col("frame") / 256).alias("piece")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("frame", "row"))), lambda s: s["row"]).alias("pred"),
        F.transform(F.array_sort(F.collect_list("frame")), lambda f: f / 50.0).alias("tt"))
    b = piece.select("trial", "piece", "pred", F.array(*[F.lit(j) for j in D.BODY20]).alias("names"), F.when(F.col("trial") % 2 == 0, F.col("tt")).alias("time"))
    path = scratch_path(spark, "bundles")
    b.write.parquet(path)
    r = tables.read_bundles(spark.read.parquet(path), ["trial", "piece"])
    t = F.when(F.col("trial") % 2 == 0, F.col("t")).otherwise(F.col("t") + F.col("piece") * 256 / 60.0)
    return r.select("trial", (F.col("i") + F.col("piece") * 256).alias("i"), r6(t, "t"), "marker", r6("x"))
