"""The clip chain over nested columns: video facts, scenes, clips, marks, rows.

All of it is expressions on arrays of structs; only decoding is left to
providers. One polarity holds throughout: filtered is true for a clip that
passes, and once false it stays false. The cutter keeps the passing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .base import operator

PROBE = "struct<num_frames:int,height:int,width:int,fps:double>"
SCENE = "struct<start:string,end:string,start_frame:int,end_frame:int,duration_sec:double>"


def video_info(probe: Column) -> Column:
    """The eight facts of a probed video (a struct of num_frames, height, width
    and fps); a null probe is one that failed."""
    n, h, w, fps = (probe[k] for k in ("num_frames", "height", "width", "fps"))
    return F.struct(
        probe.isNotNull().alias("success"),
        n.alias("num_frames"),
        h.alias("height"),
        w.alias("width"),
        F.when((w > 0) & (h > 0), w / h).alias("aspect_ratio"),
        (w * h).alias("resolution"),
        fps.alias("fps"),
        F.when(fps > 0, n / fps).alias("duration_sec"),
    )


@operator("VideoInfoFilter", "generate")
def video_info_filter(df: DataFrame, probe: str = "probe", output: str = "video_info", exists: str | None = None, sort: bool = True) -> DataFrame:
    """df with video facts, in ascending order of frames, unknown ones last.
    exists names a Boolean column; rows where it isn't true are dropped first.
    sort=False leaves out the global sort, which a distributed consumer rarely
    needs."""
    c.require_columns(df, probe, exists)
    rows = df.where(F.coalesce(c.col(exists), F.lit(False))) if exists else df
    rows = rows.withColumn(output, video_info(c.col(probe)))
    return rows.orderBy(F.asc_nulls_last(F.col(f"`{output}`.num_frames"))) if sort else rows


def _trimmed(pairs: Column, start_remove: float, end_remove: float) -> Column:
    """Scenes (structs of s and e) without their ends; those too short go."""
    total = max(0.0, start_remove) + max(0.0, end_remove)
    good = F.filter(pairs, lambda p: (p["e"] > p["s"]) & (p["e"] - p["s"] >= total))
    cut = F.transform(good, lambda p: F.struct((p["s"] + start_remove).alias("s"), (p["e"] - end_remove).alias("e")))
    return F.filter(cut, lambda p: p["e"] > p["s"])


def _numbers(count: Column) -> Column:
    """0..count-1; empty for a count under 1."""
    return F.when(count >= 1, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def split_scenes(pairs: Column, start_remove: float = 0.0, end_remove: float = 0.0, least: float = 2.0, most: float = 15.0) -> Column:
    """Trimmed scenes in pieces of most seconds; a rest, or a short scene, stays
    if it has at least least seconds."""
    least, most = max(0.0, least), max(max(0.0, least), most)

    def split(p: Column) -> Column:
        length = p["e"] - p["s"]
        whole = F.floor(length / most)
        chunks = F.transform(_numbers(whole), lambda k: F.struct((p["s"] + k * most).alias("s"), (p["s"] + (k + 1) * most).alias("e")))
        rest = F.struct((p["s"] + whole * most).alias("s"), p["e"].alias("e"))
        # A scene of exactly most seconds is one piece without a rest.
        after = (length > most) & (rest["e"] - rest["s"] >= least) | (length < most) & (length >= least)
        chunks = F.when(length < most, F.slice(chunks, 1, 0)).otherwise(chunks)
        return F.when(after & ((rest["e"] > rest["s"]) | (length > most)), F.array_append(chunks, rest)).otherwise(chunks)

    return F.flatten(F.transform(_trimmed(pairs, start_remove, end_remove), split))


def split_overlap(pairs: Column, start_remove: float = 0.0, end_remove: float = 0.0, least: float = 2.0, most: float = 15.0, clamp: bool = False) -> Column:
    """Like split_scenes, but a long scene is cut every int(most) seconds into
    pieces of most seconds, the last of which may reach beyond the scene unless
    clamp is set."""
    least, most = max(0.0, least), max(max(0.0, least), most)
    step = max(1, int(most))

    def split(p: Column) -> Column:
        length = p["e"] - p["s"]
        many = F.ceil(F.floor(length) / step)

        def piece(k: Column) -> Column:
            end = p["s"] + k * step + most
            return F.struct((p["s"] + k * step).alias("s"), (F.least(end, p["e"]) if clamp else end).alias("e"))

        chunks = F.transform(_numbers(many), piece)
        return F.when(length > most, chunks).when(length >= least, F.array(F.struct(p["s"].alias("s"), p["e"].alias("e")))).otherwise(F.slice(chunks, 1, 0))

    return F.flatten(F.transform(_trimmed(pairs, start_remove, end_remove), split))


def split_fixed(duration: Column, clip: float, start_remove: float = 0.0, end_remove: float = 0.0) -> Column:
    """A video in pieces of clip seconds; the last one ends with the video."""
    start, end = F.lit(max(0.0, start_remove)), F.greatest(F.lit(0.0), duration - end_remove)
    return F.transform(
        _numbers(F.ceil((end - start) / clip)),
        lambda k: F.struct((start + k * clip).alias("s"), F.least(start + (k + 1) * clip, end).alias("e")),
    )


@operator("VideoSceneFilter", "generate")
def scene_filter(
    df: DataFrame,
    pairs: str = "scene_pairs",
    info: str = "video_info",
    output: str = "video_scene",
    start_remove_sec: float = 0.0,
    end_remove_sec: float = 0.0,
    min_seconds: float = 2.0,
    max_seconds: float = 15.0,
    overlap: bool = False,
    use_fixed_interval: bool = False,
) -> DataFrame:
    """df with scenes. pairs holds what a scene detector found: an array of
    structs of s and e in seconds, null where it failed."""
    c.require_columns(df, None if use_fixed_interval else pairs, info)
    fps, length = c.col(info)["fps"], c.col(info)["duration_sec"]
    if use_fixed_interval:
        raw = split_fixed(length, max_seconds, start_remove_sec, end_remove_sec)
    else:
        raw = (split_overlap if overlap else split_scenes)(c.col(pairs), start_remove_sec, end_remove_sec, min_seconds, max_seconds)
    scenes = F.transform(
        raw,
        lambda p: F.struct(
            c.timecode(p["s"]).alias("start"),
            c.timecode(p["e"]).alias("end"),
            c.frame_index(p["s"], fps).alias("start_frame"),
            c.frame_index(p["e"], fps).alias("end_frame"),
            F.round(p["e"] - p["s"], 6).alias("duration_sec"),
        ),
    )
    failed = F.col("_scenes").isNull()
    made = F.struct(
        (~failed).alias("success"),
        F.when(failed, "no scenes could be found").alias("error"),
        fps.alias("fps"),
        F.coalesce("_scenes", F.array().cast(f"array<{SCENE}>")).alias("scenes"),
    )
    # What is used more than once is a column of its own, and so computed once.
    return df.withColumn("_scenes", c.once(scenes)).withColumn(output, made).drop("_scenes")


@operator("VideoClipFilter", "generate")
def clip_filter(
    df: DataFrame,
    video: str = "video",
    info: str = "video_info",
    scene: str = "video_scene",
    output: str = "video_clip",
    drop_invalid_timestamps: bool = False,
    frames_min: int | None = None,
    frames_max: int | None = None,
    fps_min: float | None = None,
    fps_max: float | None = None,
    resolution_max: int | None = None,
) -> DataFrame:
    """df with one clip for each scene within the bounds; an unknown measure
    passes. A clip's id is the file's stem and the scene's place, so that places
    of dropped clips stay free."""
    c.require_columns(df, video, info, scene)
    path = c.first_item(video) if df.schema[video].dataType.typeName() == "array" else c.col(video)
    v, fps = c.col(info), c.col(info)["fps"]
    stem = F.col("_stem")

    def make(s: Column, k: Column) -> Column:
        first, last = F.floor(c.seconds(s["start"])).cast("double"), F.floor(c.seconds(s["end"])).cast("double")
        known = s["start_frame"].isNotNull() & s["end_frame"].isNotNull()
        a = F.when(known, s["start_frame"]).otherwise(c.frame_index(first, fps))
        b = F.when(known, s["end_frame"]).otherwise(c.frame_index(last, fps))
        spare = F.when((fps > 0) & (s["duration_sec"] > 0), F.floor(s["duration_sec"] * fps).cast("int"))
        return F.struct(
            path.alias("video_path"),
            F.concat(stem, F.lit("_"), k.cast("string")).alias("id"),
            F.when(b >= a, b - a).otherwise(spare).alias("num_frames"),
            v["height"].alias("height"),
            v["width"].alias("width"),
            v["aspect_ratio"].alias("aspect_ratio"),
            fps.alias("fps"),
            F.concat(v["width"].cast("string"), F.lit("x"), v["height"].cast("string")).alias("resolution"),
            first.alias("timestamp_start"),
            last.alias("timestamp_end"),
            a.alias("frame_start"),
            b.alias("frame_end"),
            s["duration_sec"].alias("duration_sec"),
            path.alias("id_ori"),
        )

    def bounded(value: Column, low, high) -> Column:
        test = F.lit(True)
        if low is not None:
            test &= F.coalesce(value >= low, F.lit(True))
        if high is not None:
            test &= F.coalesce(value <= high, F.lit(True))
        return test

    def inside(x: Column) -> Column:
        return bounded(x["num_frames"], frames_min, frames_max) & bounded(x["fps"], fps_min, fps_max) & bounded(x["height"] * x["width"], None, resolution_max)

    made = F.col("_made")
    missing = F.coalesce(path == "", F.lit(True))
    # Once a row, not once a scene.
    named = df.withColumn("_stem", c.once(F.regexp_extract(path, r"([^/]+?)(?:(?<=[^/])\.[^./]*)?$", 1)))
    rows = named.withColumn("_made", c.once(F.filter(F.transform(c.col(scene)["scenes"], make), inside))).withColumn(
        output,
        F.struct(
            (~missing & made.isNotNull()).alias("success"),
            F.when(missing, "missing_video_path").when(made.isNull(), "no scenes").alias("error"),
            F.when(missing | made.isNull(), F.slice(made, 1, 0)).otherwise(made).alias("clips"),
        ),
    )
    rows = rows.drop("_made", "_stem")
    return rows.where(F.size(F.col(f"`{output}`.clips")) > 0) if drop_invalid_timestamps else rows


def frame_plan(num_frames: Column, fps: Column, interval: float | None = None) -> Column:
    """Frames of a clip to save: every interval seconds, or the first, the middle
    and the last."""
    three = F.array_sort(F.array_distinct(F.array(F.lit(0), F.floor(num_frames / 2).cast("int"), (num_frames - 1).cast("int"))))
    none = F.array().cast("array<int>")
    if interval is None:
        return F.when(num_frames > 0, three).otherwise(none)
    # bround rounds halves to even.
    stride = F.greatest(F.lit(1), F.bround(fps * interval).cast("int"))
    strided = F.sequence(F.lit(0), num_frames.cast("int") - 1, stride)
    return F.when(F.coalesce(num_frames <= 0, F.lit(True)), none).when(fps > 0, strided).otherwise(three)


@operator("VideoFrameFilter", "generate")
def frame_filter(df: DataFrame, clips: str = "video_clip", output: str = "video_frame", interval_sec: float | None = None) -> DataFrame:
    """df with the frames to save of every clip, counted from the video's start,
    and how many there are; rows without clips have the error no_jobs."""
    c.require_columns(df, clips)

    def plan(x: Column) -> Column:
        local = frame_plan(x["num_frames"], x["fps"], interval_sec)
        return F.struct(x["id"].alias("id"), F.transform(local, lambda k: k + x["frame_start"]).alias("frames"))

    made = F.col("_made")
    total = F.aggregate(made, F.lit(0), lambda s, x: s + F.size(x["frames"]))
    some = F.coalesce(F.size(made) > 0, F.lit(False))
    summary = F.struct(
        some.alias("success"), F.when(~some, "no_jobs").alias("error"), made.alias("clips"), F.coalesce(total, F.lit(0)).alias("total_saved"), F.greatest(F.size(made), F.lit(0)).alias("total_clips")
    )
    return df.withColumn("_made", c.once(F.transform(c.col(clips)["clips"], plan))).withColumn(output, summary).drop("_made")


def _fields(df: DataFrame, clips: str) -> list[str]:
    return df.schema[clips].dataType["clips"].dataType.elementType.names


def _with(x: Column, names: list[str], **values: Column) -> Column:
    """A clip with fields set. The struct is built anew: a chain of withField
    makes plans that grow with every step."""
    return F.struct(*[x[n].alias(n) for n in names if n not in values], *[v.alias(k) for k, v in values.items()])


def _rebuilt(df: DataFrame, clips: str, new: Column) -> Column:
    """The column of clips with another array of clips; null stays null."""
    whole = c.col(clips)
    others = [whole[n].alias(n) for n in df.schema[clips].dataType.names if n != "clips"]
    return F.when(whole.isNotNull(), F.struct(*others, new.alias("clips")))


def mark_clips(df: DataFrame, clips: str, bounds: dict[str, tuple[float | None, float | None]], strict: bool = False) -> DataFrame:
    """Marks each clip by bounds on its fields. A null or NaN score with a bound
    fails, as does a field that the schema lacks (an error if strict)."""
    c.require_columns(df, clips)
    have = _fields(df, clips)
    bounds = {k: b for k, b in bounds.items() if b != (None, None)}
    need = {k: {"height", "width"} if k == "resolution" else {k} for k in bounds}
    missing = sorted(k for k in bounds if not need[k] <= set(have))
    if missing and strict:
        raise ValueError(f"clips lack the fields: {', '.join(missing)}")

    def mark(x: Column) -> Column:
        passes = F.coalesce(x["filtered"], F.lit(True)) if "filtered" in have else F.lit(True)
        for k, (low, high) in bounds.items():
            if k in missing:
                passes &= F.lit(False)
            else:
                passes &= c.within(x["height"] * x["width"] if k == "resolution" else x[k], low, high)
        return _with(x, have, filtered=passes)

    return df.withColumn(clips, _rebuilt(df, clips, F.transform(c.col(clips)["clips"], mark)))


@operator("VideoLuminanceFilter", "filter")
def luminance_mark(df: DataFrame, clips: str = "video_clip", lum_min: float | None = None, lum_max: float | None = None) -> DataFrame:
    return mark_clips(df, clips, {"luminance_mean": (lum_min, lum_max)})


@operator("VideoAestheticFilter", "filter")
def aesthetic_mark(df: DataFrame, clips: str = "video_clip", aes_min: float | None = None) -> DataFrame:
    return mark_clips(df, clips, {"aesthetic_score": (aes_min, None)})


@operator("VideoOCRFilter", "filter")
def ocr_mark(df: DataFrame, clips: str = "video_clip", ocr_min: float | None = None, ocr_max: float | None = None) -> DataFrame:
    return mark_clips(df, clips, {"ocr_score": (ocr_min, ocr_max)})


@operator("VideoScoreFilter", "filter")
def video_score_mark(
    df: DataFrame,
    clips: str = "video_clip",
    frames: tuple = (None, None),
    fps: tuple = (None, None),
    resolution_max: int | None = None,
    aes_min: float | None = 4,
    ocr: tuple = (None, 0.3),
    lum: tuple = (20, 140),
    motion: tuple = (2, 14),
    flow: tuple = (None, None),
    blur_max: float | None = None,
    strict_mode: bool = False,
) -> DataFrame:
    """Marks clips by all their scores at once; the pairs are (least, most)."""
    names = ("num_frames", "fps", "resolution", "aesthetic_score", "ocr_score", "luminance_mean", "motion_score", "flow_score", "blur_score")
    bounds = (frames, fps, (None, resolution_max), (aes_min, None), ocr, lum, motion, flow, (None, blur_max))
    return mark_clips(df, clips, dict(zip(names, bounds)), strict_mode)


def _write_scores(df: DataFrame, clips: str, scores: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Clip scores, one row for each clip, written into the nested clips."""
    flat = scores.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*fields)))).alias("_scores"))
    joined = df.join(flat, key, "left")

    have = _fields(df, clips)

    def put(x: Column) -> Column:
        found = F.try_element_at(F.col("_scores"), x["id"])
        return _with(x, have, **{f: found[f] for f in fields})

    return joined.withColumn(clips, _rebuilt(df, clips, F.transform(c.col(clips)["clips"], put))).drop("_scores")


def _luminance() -> dict[str, Column]:
    return {"luminance_mean": F.avg("luma"), "luminance_min": F.min("luma"), "luminance_max": F.max("luma")}


def _aesthetic() -> dict[str, Column]:
    return {"aesthetic_score": F.avg("aesthetic")}


def _ocr(width: int, height: int) -> dict[str, Column]:
    area = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + F.abs((b[2] - b[0]) * (b[3] - b[1])))
    return {"ocr_score": F.max(area / (width * height))}


def _scored(df: DataFrame, frames: DataFrame, key: str, clips: str, scores: dict[str, Column]) -> DataFrame:
    return _write_scores(df, clips, frames.groupBy(key, "id").agg(*[v.alias(k) for k, v in scores.items()]), key, list(scores))


@operator("VideoLuminanceEvaluator", "eval")
def luminance_eval(df: DataFrame, frames: DataFrame, key: str, clips: str = "video_clip") -> DataFrame:
    """df whose clips have the mean, least and greatest luma of their frames.
    frames: key, id (of the clip), luma; one row for each decoded frame."""
    return _scored(df, frames, key, clips, _luminance())


@operator("VideoAestheticEvaluator", "eval")
def aesthetic_eval(df: DataFrame, frames: DataFrame, key: str, clips: str = "video_clip") -> DataFrame:
    """df whose clips have the mean aesthetic of their frames (key, id, aesthetic)."""
    return _scored(df, frames, key, clips, _aesthetic())


@operator("VideoOCREvaluator", "eval")
def ocr_eval(df: DataFrame, frames: DataFrame, key: str, clips: str = "video_clip", width: int = 720, height: int = 1280) -> DataFrame:
    """df whose clips have the greatest share of a frame that text boxes cover.
    frames: key, id, boxes (arrays of x1, y1, x2, y2)."""
    return _scored(df, frames, key, clips, _ocr(width, height))


@operator("VideoFrameEvaluator", "eval")
def frame_eval(df: DataFrame, frames: DataFrame, key: str, clips: str = "video_clip", width: int = 720, height: int = 1280) -> DataFrame:
    """The scores of luminance_eval, aesthetic_eval and ocr_eval at once, for
    frames that have all their columns: one aggregation and one join."""
    return _scored(df, frames, key, clips, _luminance() | _aesthetic() | _ocr(width, height))


@operator("VideoClipGenerator", "expand")
def clip_rows(df: DataFrame, clips: str = "video_clip", cut: str | None = None) -> DataFrame:
    """One row for each clip of a successful row that passes, with the clip's
    fields; video is its file. cut names a folder in which a cutting provider
    puts the files, {id}.mp4; original_video_path stays the source."""
    c.require_columns(df, clips)
    others = [x for x in df.columns if x != clips]
    flat = df.where(F.coalesce(c.col(clips)["success"], F.lit(False))).select(*[c.col(x) for x in others], F.explode(c.col(clips)["clips"]).alias("_clip"))
    names = flat.schema["_clip"].dataType.names
    if "filtered" in names:
        flat = flat.where(F.coalesce(F.col("_clip.filtered"), F.lit(True)))
    path = F.concat(F.lit(f"{cut}/"), F.col("_clip.id"), F.lit(".mp4")) if cut else F.col("_clip.video_path")
    keep = [c.col(x) for x in others if x not in names and x not in ("video", "original_video_path")]
    return flat.select(*keep, *[F.col(f"_clip.{n}") for n in names if n not in ("video_path", "filtered")], F.array(path).alias("video"), F.col("_clip.video_path").alias("original_video_path"))


@operator("VideoMergedCaptionGenerator", "expand")
def merged_captions(
    df: DataFrame, caption: str = "caption", clip_id: str = "id", start: str = "timestamp_start", end: str | None = "timestamp_end", duration: str | None = None, order: str | None = None
) -> DataFrame:
    """One row for each video: its clips' captions in the order of their start,
    "From s to e, caption" a line. The video is the clip's id without the number
    at its end. Clips without a start, an end or duration, or a caption don't
    count. order breaks ties of start; without it the caption does."""
    c.require_columns(df, caption, clip_id, start, end, duration, order)

    def number(x: str) -> Column:
        value = F.coalesce(c.seconds(c.col(x).cast("string")), c.col(x).try_cast("double"))
        return F.when(~F.isnan(value), value)

    begin = number(start)
    stop = F.coalesce(*[x for x in (number(end) if end else None, begin + F.nullif(number(duration), F.lit(0.0)) if duration else None) if x is not None])
    text = c.strip(F.replace(F.coalesce(c.col(caption), F.lit("")), F.lit("\n"), F.lit(" ")))
    line = F.format_string("From %d to %d, %s", begin.cast("long"), stop.cast("long"), F.concat(F.lower(F.left(text, F.lit(1))), F.substring(text, 2, 2**31 - 1)))
    rows = df.where(begin.isNotNull() & stop.isNotNull() & (text != "")).select(
        F.regexp_replace(F.coalesce(c.col(clip_id).cast("string"), F.lit("")), r"_\d+$", "").alias("id"),
        F.struct(begin.alias("begin"), (c.col(order) if order else text).alias("tie"), line.alias("line")).alias("item"),
    )
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["line"]), "\n").alias("captions"), F.count("*").cast("int").alias("num_clips"))
