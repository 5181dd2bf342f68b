"""Queries of the clip, audio, scoring, similarity and provider operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import metrics
from ..operators import audio, clips, generate, images, prompts, scoring, similar, trees
from ..providers import Stub
from ..session import table
from .text_queries import WS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# The clip chain. Events stand for videos: value is a length in seconds.

_TC = "printf('%02d:%02d:%02d.%03d', (ms // 3600000)::int, ((ms // 60000) % 60)::int, ((ms // 1000) % 60)::int, (ms % 1000)::int)"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.expr("if(event_id % 10 = 0, null, named_struct('num_frames', cast(floor(value * 25) as int), 'height', 720, 'width', cast(1280 as int), 'fps', 25.0D))")
    videos = table(spark, sf_dir, "events").select("event_id", "value", F.concat(F.lit("/in/v."), F.col("event_id").cast("string"), F.lit(".mp4")).alias("video"), probe.alias("probe"))
    return clips.video_info_filter(videos, sort=False).withColumn("scene_pairs", F.expr("array(named_struct('s', 0.0D, 'e', value / 3), named_struct('s', value / 3, 'e', cast(value as double)))"))


@query(
    """select event_id, event_id % 10 <> 0 as success, case when event_id % 10 <> 0 then floor(value * 25)::int end as num_frames,
case when event_id % 10 <> 0 then 1280 / 720::double end as aspect_ratio, case when event_id % 10 <> 0 then 921600 end as resolution,
case when event_id % 10 <> 0 then floor(value * 25)::int / 25::double end as duration_sec from events"""
)
def video_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("video_info")
    return _videos(spark, sf_dir).select("event_id", *[v[k].alias(k) for k in ("success", "num_frames", "aspect_ratio", "resolution", "duration_sec")])


_PAIRS = """with pairs as (select event_id, 0 as p, 0.0::double as s, value / 3 as e from events union all select event_id, 1, value / 3, value::double from events),
cut as (select event_id, p, s + 0.5 as s, e - 0.25 as e from pairs where e > s and e - s >= 0.75 and e - 0.25 > s + 0.5)
"""


def _split(spark: SparkSession, sf_dir: str, split) -> DataFrame:
    made = _videos(spark, sf_dir).select("event_id", F.explode(split).alias("x"))
    return made.select("event_id", F.round("x.s", 6).alias("s"), F.round("x.e", 6).alias("e"))


@query(
    _PAIRS
    + """, n as (select *, e - s as d, floor((e - s) / 15) as k from cut),
whole as (select event_id, s + i * 15 as s, s + (i + 1) * 15 as e from (select *, unnest(range(0, k::bigint)) as i from n where d >= 15)),
rest as (select event_id, s + k * 15 as s, e from n where (d > 15 and e - (s + k * 15) >= 2) or (d < 15 and d >= 2))
select event_id, round(s, 6) as s, round(e, 6) as e from whole union all select event_id, round(s, 6), round(e, 6) from rest"""
)
def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, clips.split_scenes(F.col("scene_pairs"), 0.5, 0.25))


@query(
    _PAIRS
    + """select event_id, round(s + i * 15, 6) as s, round(s + i * 15 + 15, 6) as e from (select *, unnest(range(0, ceil(floor(e - s) / 15)::bigint)) as i from cut where e - s > 15)
union all select event_id, round(s, 6), round(e, 6) from cut where e - s between 2 and 15"""
)
def scene_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, clips.split_overlap(F.col("scene_pairs"), 0.5, 0.25))


@query(
    """with v as (select event_id, 0.5::double as s, greatest(0, value - 0.25) as e from events)
select event_id, round(s + i * 15, 6) as s, round(least(s + (i + 1) * 15, e), 6) as e from (select *, unnest(range(0, ceil((e - s) / 15)::bigint)) as i from v where e > s)"""
)
def scene_split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, clips.split_fixed(F.col("value").cast("double"), 15.0, 0.5, 0.25))


_SCENES = """with pairs as (select event_id, value, 0 as p, 0.0::double as s, value / 3 as e from events union all select event_id, value, 1, value / 3, value::double from events),
scenes as (select event_id, row_number() over (partition by event_id order by p, k) - 1 as idx, s + k * 15 as s, least(e, s + (k + 1) * 15) as e from
  (select *, unnest(range(0, greatest(1, ceil((e - s) / 15))::bigint)) as k from pairs where e > s)
  where least(e, s + (k + 1) * 15) - (s + k * 15) >= 2),
clips as (select event_id, idx, s, e, 'v.' || event_id || '_' || idx as id, (case when event_id % 10 <> 0 then floor(e * 25) - floor(s * 25) else 0 end)::int as num_frames,
  floor(floor(s * 1000 + 0.5) / 1000)::double as timestamp_start from scenes)
"""


@query(_SCENES + f"select event_id, idx, {_TC} as start from (select event_id, idx, floor(s * 1000 + 0.5)::bigint as ms from scenes)")
def video_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clips.scene_filter(_videos(spark, sf_dir))
    return made.select("event_id", F.posexplode("video_scene.scenes").alias("idx", "x")).select("event_id", F.col("idx").cast("long"), "x.start")


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.clip_filter(clips.scene_filter(_videos(spark, sf_dir)), frames_min=100)


@query(_SCENES + "select event_id, id, num_frames, timestamp_start, '1280x720' as resolution from clips where num_frames >= 100")
def video_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _clips(spark, sf_dir).select("event_id", F.explode("video_clip.clips").alias("x"))
    return x.select("event_id", *[F.col(f"x.{k}") for k in ("id", "num_frames", "timestamp_start", "resolution")])


@query(
    _SCENES
    + "select id, unnest(list_distinct([0, num_frames // 2, num_frames - 1])) + floor(s * 25)::int as frame from clips where num_frames >= 100"
)
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = clips.frame_filter(_clips(spark, sf_dir)).select(F.explode("video_frame.clips").alias("x"))
    return made.select("x.id", F.explode("x.frames").alias("frame"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clips(spark, sf_dir)
    frames = rows.select("event_id", F.explode("video_clip.clips").alias("x")).select(
        "event_id", "x.id", (F.col("x.num_frames") % 200).cast("double").alias("luma"), (F.col("x.num_frames") % 7).cast("double").alias("aesthetic"),
        F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(720.0), (F.col("x.num_frames") % 1000).cast("double"))).alias("boxes"),
    )
    frames = frames.withColumn("luma", F.explode(F.array("luma", F.col("luma") + 10)))
    return clips.frame_eval(rows, frames, "event_id")


@query(
    _SCENES
    + "select id, num_frames % 200 + 5.0::double as luminance_mean, (num_frames % 7)::double as aesthetic_score, round((num_frames % 1000) / 1280::double, 9) as ocr_score, "
    "num_frames % 200 + 5 between 20 and 140 and num_frames % 7 >= 4 and (num_frames % 1000) / 1280::double <= 0.3 as filtered from clips where num_frames >= 100"
)
def video_score_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = clips.video_score_mark(_scored(spark, sf_dir), motion=(None, None)).select(F.explode("video_clip.clips").alias("x"))
    return marked.select("x.id", "x.luminance_mean", "x.aesthetic_score", F.round("x.ocr_score", 9).alias("ocr_score"), "x.filtered")


@query(
    _SCENES
    + "select id, num_frames % 200 + 5 <= 120 and num_frames % 7 >= 2 and (num_frames % 1000) / 1280::double between 0.05 and 0.6 as filtered from clips where num_frames >= 100"
)
def video_marks_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = clips.luminance_mark(_scored(spark, sf_dir), lum_max=120)
    marked = clips.ocr_mark(clips.aesthetic_mark(marked, aes_min=2), ocr_min=0.05, ocr_max=0.6)
    return marked.select(F.explode("video_clip.clips").alias("x")).select("x.id", "x.filtered")


@query(
    _SCENES
    + "select event_id, id, 'cut/' || id || '.mp4' as video, '/in/v.' || event_id || '.mp4' as original_video_path from clips where num_frames >= 100 and num_frames % 200 + 5 <= 120"
)
def video_clip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = clips.luminance_mark(_scored(spark, sf_dir), lum_max=120).select("event_id", "video_clip")
    return clips.clip_rows(marked, cut="cut").select("event_id", "id", F.col("video")[0].alias("video"), "original_video_path")


@query(
    """with e as (select user_id, event_id, event_type, epoch(ts) - 1.6e9 as s, value, lower(left(event_type, 1)) || substr(event_type, 2) || ' ' || event_id as cap from events)
select 'u' || user_id as id, string_agg('From ' || trunc(s)::bigint || ' to ' || trunc(s + value)::bigint || ', ' || cap, chr(10) order by s, event_type || ' ' || event_id) as captions, count(*)::int as num_clips from e group by user_id"""
)
def merged_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1.6e9
    made = table(spark, sf_dir, "events").select(
        F.expr("concat('u', user_id, '_', event_id)").alias("id"), start.alias("timestamp_start"), (start + F.col("value")).alias("timestamp_end"), F.expr("concat(event_type, ' ', event_id)").alias("caption")
    )
    return clips.merged_captions(made)


# Scoring.

_ANSWERS = """with a as (select p_partkey, p_size, p_name, p_type, ['multiple choice', 'numerical', 'regression', 'other'][(p_partkey % 4 + 1)::int] as k,
case when p_size % 3 = 0 then '1,' || (p_size + 100) || '.5' else (p_size + 100)::varchar end as o, case when p_size % 2 = 0 then (p_size + 1100) || '.50' else (p_size + 100)::varchar end as g from part),
n as (select *, replace(o, ',', '')::double as x, replace(g, ',', '')::double as y from a)
select p_partkey, round(case k when 'multiple choice' then (o = g)::int::double
when 'numerical' then (regexp_matches(o, '[.,]') = regexp_matches(g, '[.,]') and round(x, 2) = round(y, 2))::int::double
when 'regression' then 1 - least(1, (abs(x - y) + 1e-9) / (abs(y) + 1e-9)) else 0 end, 6) as reward from n"""


@query(_ANSWERS)
def answer_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.expr("element_at(array('multiple choice', 'numerical', 'regression', 'other'), cast(p_partkey % 4 + 1 as int))").alias("problem_type"),
        F.expr("concat('<answer> ', if(p_size % 3 = 0, concat('1,', p_size + 100, '.5'), cast(p_size + 100 as string)), ' </answer>')").alias("model_output"),
        F.expr("concat('<think>x</think><answer>', if(p_size % 2 = 0, concat(p_size + 1100, '.50'), cast(p_size + 100 as string)), '</answer>')").alias("solution"),
    )
    return scoring.answer_reward(made).select("p_partkey", F.round("reward", 6).alias("reward"))


@query()
def answer_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    pairs = b.toDF("a", "x").join(b.toDF("b", "y"), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", *[F.round(metrics.metric(f, F.col("x"), F.col("y")), 6).alias(f.__name__) for f in (metrics.error_rate, metrics.rouge, metrics.bleu)])


@query(
    """with v as (select vec_id, embedding::double[] as e from embeddings)
select a.vec_id, round((list_cosine_similarity(a.e, b.e) + 1) / 2, 6) as clip_score from v a join v b on b.vec_id = a.vec_id + 1"""
)
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("image_vector")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("text_vector")), "vec_id")
    return scoring.match_score(pairs).select("vec_id", F.round("clip_score", 6).alias("clip_score"))


@query("select event_id, round(exp(-value / 100) / (exp(-value / 100) + exp(-(user_id % 5)) + 1e-8), 6) as vqa_score from events")
def yes_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("yes_loss"), (F.col("user_id") % 5).cast("double").alias("no_loss"))
    return scoring.yes_score(rows).select("event_id", F.round("vqa_score", 6).alias("vqa_score"))


@query(
    """with r as (select (rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0)::double as a,
(rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0)::double as b,
(rank() over (order by p_partkey % 7) + (count(*) over (partition by p_partkey % 7) - 1) / 2.0)::double as c from part)
select round((corr(a, b) + corr(a, c)) / 2, 6) as spearman from r"""
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_size", "p_retailprice", (F.col("p_partkey") % 7).alias("third"))
    return scoring.spearman(part, "p_size", ["p_retailprice", "third"]).select(F.round("spearman", 6).alias("spearman"))


@query(
    """with p as (select p_size as x, p_partkey % 7 as y, count(*)::double as n from part group by all),
s as (select sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) as s, sum((a.x <> b.x)::int * a.n * b.n) as u, sum((a.y <> b.y)::int * a.n * b.n) as v from p a, p b)
select round(s / sqrt(u * v), 6) as kendall from s"""
)
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_size", (F.col("p_partkey") % 7).alias("third"))
    return scoring.kendall(part, "p_size", ["third"]).select(F.round("kendall", 6).alias("kendall"))


@query(
    f"""with w as (select distinct doc_id, unnest(list_filter(string_split_regex(lower(text), '{WS}+'), lambda x: x <> '')) as item from documents)
select item, round(ln(((select count(*) from documents) + 1) / (count(*) + 1)::double), 6) as idf from w group by item"""
)
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", c.words(F.lower("text")).alias("words"))
    return scoring.idf(docs, "doc_id", "words").select("item", F.round("idf", 6).alias("idf"))


# Similarity.

_V = "with v as (select vec_id, label, embedding::double[] as e from embeddings), "


@query(
    _V
    + """p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.4),
m as (select id, max(s) as m from (select a as id, s from p union all select b, s from p) group by id)
select vec_id, round(coalesce(m, 0), 6) as max_similarity from v left join m on id = vec_id where vec_id not in (select b from p)"""
)
def vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return similar.vector_dedup(v, "vec_id", "embedding", 0.4).select("vec_id", F.round("max_similarity", 6).alias("max_similarity"))


@query(
    _V
    + """n as (select a.vec_id, list_cosine_similarity(a.e, b.e) as s, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.e, b.e), 12) desc, b.vec_id) as k from v a join v b on a.vec_id <> b.vec_id),
m as (select vec_id, avg(s) as s from n where k <= 5 group by vec_id)
select vec_id, round(s, 6) as score from m where s <= (select quantile_cont(s, 0.5::double) from m)"""
)
def knn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return similar.knn_filter(v, "vec_id", "embedding", output="score").select("vec_id", F.round("score", 6).alias("score"))


@query("select min(doc_id) as doc_id, text from documents group by text")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.first_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query(
    _V
    + """w as (select vec_id, label, e, vec_id % 13 + 1.0::double as w from v),
t as (select label, sum(w) as t from w group by label),
u as (select a.vec_id, sum(case when a.vec_id = b.vec_id then 0 else sqrt(greatest(0, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) end * b.w / t.t) as uni
  from w a join w b on a.label = b.label join t on t.label = a.label group by a.vec_id),
cd as (select label, d, avg(x) as x from (select label, unnest(e) as x, unnest(range(64)) as d from w) group by label, d),
c as (select label, list(x order by d) as e from cd group by label),
n as (select a.label, sum(exp(case when a.label = b.label then 0 else list_cosine_similarity(a.e, b.e) end)) / (count(*) - 1) as tau from c a, c b group by a.label),
s as (select w.vec_id, w.w, u.uni, n.tau * w.w / t.t as rep from w join u using (vec_id) join n on n.label = w.label join t on t.label = w.label),
r as (select vec_id, ((row_number() over (order by round(w, 9), vec_id) - 1) / count(*) over ()) / 3 + ((row_number() over (order by round(uni, 9), vec_id) - 1) / count(*) over () + (row_number() over (order by round(rep, 9), vec_id) - 1) / count(*) over ()) / 3 as score, count(*) over () as n from s)
select vec_id, round(score, 6) as score from r qualify row_number() over (order by round(score, 9) desc, vec_id desc) <= greatest(1, floor(n * 0.8))"""
)
def tailor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("info", F.col("vec_id") % 13 + 1.0)
    return similar.tailor(v, "vec_id", "embedding", "info", "label", output="score").select("vec_id", F.round("score", 6).alias("score"))


@query()
def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return similar.cluster(v, "vec_id", "embedding").select("vec_id", "cluster")


@query()
def text_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar.text_diversity(docs, "text", "doc_id").select("doc_id")


@query()
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("phash"))
    return similar.diversity(docs, "text", "phash", "doc_id", distance=20).select("doc_id")


@query(
    """with o as (select o_orderkey as k, [[o_custkey % 50, 10, 20, 20], [o_custkey % 40, 12, 22, 20], [200, 200, 5, 5]]::double[][] as b from orders)
select k, case when 12 > 10 and greatest(0, least(b[1][1] + 20, b[2][1] + 22) - greatest(b[1][1], b[2][1])) * 18 > 0.3 * 400 then 2 else 3 end::int as n from o"""
)
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.expr("array(array(o_custkey % 50, 10, 20, 20), array(o_custkey % 40, 12, 22, 20), array(200, 200, 5, 5))")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), boxes.alias("b")).select("k", F.size(images.suppressed("b")).alias("n"))


@query(
    """select o_orderkey as k, round((o_custkey % 50) / 640::double, 3) as x1, round((o_custkey % 50 + 100) / 640::double, 3) as x2, 1 as num_boxes from orders"""
)
def box_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("array(array(o_custkey % 50, 10, 100, 20))").alias("bbox"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    made = images.box_prompts(rows)
    return made.select("k", F.col("normalized_bbox")[0][0].alias("x1"), F.col("normalized_bbox")[0][2].alias("x2"), "num_boxes")


@query(
    r"""select p_partkey, left(regexp_replace(regexp_replace(p_name || '; ' || p_type, '[^0-9a-zA-Z]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) || '_0.png' as name from part"""
)
def image_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", images.file_name(F.concat("p_name", F.lit("; "), "p_type")).alias("name"))


# Audio.


@query()
def voice_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.least(x["value"] / 100, F.lit(1.0)))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(probs.alias("speech_probs"), (F.count("*") * 512).alias("num_samples"))
    made = audio.voice_activity(rows, voice=audio.Voice(min_speech=0.03, min_silence=0.06))
    return made.select("user_id", F.explode("timestamps").alias("t")).select("user_id", "t.start", "t.end")


@query(
    """with m as (select user_id, event_id, value >= 35 as up, row_number() over w as k, sum((value >= 35)::int) over w as u from events window w as (partition by user_id order by event_id))
select user_id, min(event_id) as start, max(event_id) as "end", count(*) as n from m where up group by user_id, k - u"""
)
def voice_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 35.0)


@query(
    """with m as (select user_id, event_id, event_type, coalesce(event_type <> lag(event_type) over w, true) as fresh from events window w as (partition by user_id order by event_id)),
r as (select *, sum(fresh::int) over (partition by user_id order by event_id) as run from m)
select user_id, min(event_id) as start, max(event_id) as "end", min(event_type) as value from r group by user_id, run"""
)
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.run_lengths(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.struct((F.col("event_id") * 1.0).alias("start"), (F.col("event_id") + F.least(F.floor("value"), F.lit(40))).cast("double").alias("end"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(span)).alias("timestamps"), (F.max("event_id") + 5).cast("double").alias("duration_sec"))
    return rows.withColumn("audio", F.array(F.expr("concat('/in/a', user_id, '.wav')")))


_CUT = """with t as (select user_id, max(event_id) + 5 as total from events group by user_id),
s as (select user_id, event_id::double as s, least(event_id + least(floor(value), 40), total)::double as e from events join t using (user_id)),
g as (select user_id, s, e, e - s as d, row_number() over (partition by user_id order by s, e) as k from s where s < e)
"""


@query(_CUT + "select user_id, k::int as sequence_num, 'chunks/a' || user_id || '_' || k || '.wav' as audio, d as duration from g")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.chunk_rows(_spans(spark, sf_dir))
    return made.select(F.regexp_extract("original_audio_path", r"a(\d+)", 1).cast("long").alias("user_id"), "sequence_num", F.col("audio")[0].alias("audio"), "duration")


@query(
    _CUT.replace("with t", "with recursive t")
    + """, f as (select user_id, k, d as total, 1 as seq from g where k = 1
union all select g.user_id, g.k, case when f.total + g.d > 120 then g.d else f.total + g.d end, case when f.total + g.d > 120 then f.seq + 1 else f.seq end from f join g on g.user_id = f.user_id and g.k = f.k + 1)
select user_id, seq as sequence_num, count(*)::int as n, max(total) as duration from f group by user_id, seq"""
)
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.chunk_rows(_spans(spark, sf_dir), mode="merge", max_audio_duration=120.0)
    return made.select(F.regexp_extract("original_audio_path", r"a(\d+)", 1).cast("long").alias("user_id"), "sequence_num", F.size("segments").alias("n"), "duration")


@query(
    """with e as (select user_id, event_id, event_type, row_number() over w as k, lead(event_id) over w as nx, lag(event_id) over w as pv from events window w as (partition by user_id order by event_id))
select user_id, event_type as text, round((case when pv is null then event_id else (pv + 1 + event_id) / 2.0::double end) * 0.02, 6) as start,
round((case when nx is null then event_id + 1 else (event_id + 1 + nx) / 2.0::double end) * 0.02, 6) as "end", round((exp(-0.5::double) + exp(-1.5::double)) / 2, 6) as score from e"""
)
def alignment_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.struct(F.col("event_id").alias("first"), F.col("event_id").alias("last"), F.col("event_type").alias("text"), F.array(F.lit(-0.5), F.lit(-1.5)).alias("log_probs"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(token)).alias("frames"))
    made = audio.alignment_eval(rows).select("user_id", F.explode("forced_alignment_results.alignment").alias("a"))
    return made.select("user_id", "a.text", *[F.round(F.col("a")[k], 6).alias(k) for k in ("start", "end", "score")])


# Providers. The stub's answer is the MD5 of the prompt, which SQL has as well.


def _md5() -> Stub:
    import hashlib

    return Stub(lambda r: hashlib.md5(r["prompt"].encode()).hexdigest())


def _yes() -> Stub:
    return Stub(lambda r: "Yes, it is." if len(r["prompt"]) % 3 else "No.")


@query("select p_partkey, md5('Tell of ' || p_name) as answer from part")
def templated_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return generate.templated_qa(part, _md5, "Tell of {name}", name="p_name").select("p_partkey", "answer")


@query("select p_partkey, md5(p_name) as answer from part")
def prompted_vqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("prompt"), F.array(F.lit("a.png")).alias("image"))
    return generate.prompted_vqa(part, _md5, None, "prompt").select("p_partkey", "answer")


@query("select p_partkey, md5('What is it?') as answer from part")
def fixed_vqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("a.png")).alias("image"), F.lit(None).cast("array<string>").alias("video"))
    return generate.fixed_vqa(part, _md5, "What is it?", "image", "video").select("p_partkey", "answer")


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as k, md5(text) as answer from conversations where role <> 'system'")
def batch_vqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations"))
    rows = turns.withColumn("prompts", F.transform("conversation", lambda t: t["value"])).withColumn("image", F.lit("a.png"))
    made = generate.batch_vqa(rows, _md5, "conv_id").select("conv_id", F.posexplode("answers").alias("k", "answer"))
    return made.select("conv_id", F.col("k").cast("long"), "answer")


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as k, text from (select conv_id, turn, text from conversations where role <> 'system' and length('Is it so? ' || text) % 3 <> 0)")
def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations"))
    rows = turns.withColumn("items", F.transform("conversation", lambda t: t["value"])).withColumn("image", F.lit("a.png"))
    made = generate.grounded(rows, _yes, "conv_id", template="Is it so? {text}").select("conv_id", F.posexplode("grounded").alias("k", "text"))
    return made.select("conv_id", F.col("k").cast("long"), "text")


def _boxes() -> Stub:
    return Stub(lambda r: "not found" if len(r["prompt"]) % 2 else "at (0.1, 0.25), (500, 1.0) and (1, 0), (0, 1)")


@query("select p_partkey, w as keyword, '[0.000, 0.000, 0.500, 0.001]' as first_box, 2 as n from (select p_partkey, unnest(list_distinct(string_split(p_name, ' '))) as w from part) where length('Find ' || w) % 2 = 0")
def keyword_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("keywords"), F.lit("a.png").alias("image"))
    made = generate.keyword_boxes(part, _boxes, "p_partkey", template="Find {keyword}").select("p_partkey", F.explode("bbox_map").alias("keyword", "b"))
    return made.select("p_partkey", "keyword", F.col("b")[0].alias("first_box"), F.size("b").alias("n"))


def _knows() -> Stub:
    """Finds the option "right" if it sees an image, else says A."""

    def say(r: dict) -> str:
        line = next((x for x in r["prompt"].split("\n") if x.endswith(") right")), "") if "image" in r else ""
        return f"It is {line.strip(' -')[0]}." if line else "A?"

    return Stub(say)


@query()
def visually_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("named_struct('question_title', p_name, 'options', map('A', p_type, 'B', 'right', 'C', p_brand, 'D', 'none'), 'answer', if(p_size % 2 = 0, 'B', 'A'))")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(q).alias("mcqs"), F.lit("a.png").alias("image"))
    made = generate.visually_dependent(rows, _knows, "p_partkey", pass_textual_max=0.5)
    return made.select("p_partkey", F.size("kept").alias("n"), F.round(F.get("kept", F.lit(0))["stats"]["t_acc"], 6).alias("t_acc"))


def _judge() -> Stub:
    return Stub(lambda r: "boxed{A}" if len(r["prompt"]) % 2 else "Final Judgment: (B)")


@query("select p_partkey, md5(p_name) as failrate_answer from part where length(p_name || '|' || p_type || '|' || md5(p_name)) % 2 = 0")
def failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.lit("a.png").alias("image"))
    return generate.failing(rows, _md5, _judge, template="{question}|{answer}|{tried}").select("p_partkey", "failrate_answer")


@query("select p_partkey, case when p_size % 2 = 0 then 'old' else md5(p_name) end as chain from part")
def visual_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("old"))).alias("reasoning_chains"))
    return generate.visual_reasoning(rows, _md5, image=None).select("p_partkey", F.explode("final_reasoning").alias("chain"))


@query("select conv_id, 'images/sample' || conv_id || '_condition' || k as path from (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as k from conversations where role <> 'system')")
def image_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations")).withColumn("conversations", prompts.as_roles("conversation"))
    made = generate.image_generator(turns.select("conv_id", "conversations"), lambda: Stub(lambda r: r["name"]), "conv_id")
    return made.select("conv_id", F.explode("images").alias("path"))


@query()
def math_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "simple").otherwise("complex").alias("mode"))
    return generate.math_questions(rows, "p_partkey")


@query(
    """select p_partkey, unnest(['<think>' || chr(10) || 'bad' || chr(10) || 'Wait.' || chr(10) || 'see ' || p_name || chr(10) || '</think>' || chr(10) || '<answer> ' || p_type || ' </answer>',
'<think>' || chr(10) || 'see ' || p_name || chr(10) || '</think>' || chr(10) || '<answer> ' || p_type || ' </answer>']) as chain from part"""
)
def tree_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = json.dumps({"rollouts": [], "children": [{"is_terminal": True, "children": [{"rollouts": []}], "rollouts": [{"reward": 0, "ephemeral_texts": ["<image>", "<think>bad", "x"]}, {"reward": 1, "ephemeral_texts": ["see NAME", "<answer>TYPE</answer>"]}]}]})
    made = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.replace(F.lit(tree), F.lit("NAME"), F.col("p_name")), F.lit("TYPE"), F.col("p_type")).alias("tree"))
    return trees.tree_chains(made, turn_back="Wait.").select("p_partkey", F.explode("reasoning_chains").alias("chain"))
