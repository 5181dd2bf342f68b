import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import audio, clips, images, marks, scoring, similar
from millrace.plans import catalog
from millrace.sources import media


def spans(spark, column):
    return [(round(r[0], 6), round(r[1], 6)) for r in spark.range(1).select(column.alias("x")).collect()[0]["x"]]


def pairs(*values):
    return F.array(*[F.struct(F.lit(float(a)).alias("s"), F.lit(float(b)).alias("e")) for a, b in values])


@pytest.mark.parametrize(
    "scene,want",
    [((5, 5), []), ((6, 5), []), ((0, 1.9), []), ((0, 2), [(0, 2)]), ((0, 15), [(0, 15)]), ((0, 15.5), [(0, 15)]), ((0, 17), [(0, 15), (15, 17)]), ((0, 30), [(0, 15), (15, 30)]), ((1, 33.5), [(1, 16), (16, 31), (31, 33.5)])],
)
def test_scene_splits(spark, scene, want):
    assert spans(spark, clips.split_scenes(pairs(scene))) == want


def test_other_splits(spark):
    assert spans(spark, clips.split_scenes(pairs((0, 1)), 0.6, 0.6)) == []
    assert spans(spark, clips.split_overlap(pairs((0, 31), (40, 50)))) == [(0, 15), (15, 30), (30, 45), (40, 50)]
    assert spans(spark, clips.split_overlap(pairs((0, 31)), clamp=True))[-1] == (30, 31)
    assert spans(spark, clips.split_fixed(F.lit(10.0), 4.0, 1.0, 0.5)) == [(1, 5), (5, 9), (9, 9.5)]
    assert spans(spark, clips.split_fixed(F.lit(1.0), 4.0, 1.0)) == []


CLIP = "struct<id:string,num_frames:int,fps:double,height:int,width:int,luminance_mean:double,filtered:boolean>"


def test_marks_are_sticky_and_null_scores_fail(spark):
    rows = [(1, ([("a", 1, 1.0, 2, 2, 50.0, None), ("b", 1, 1.0, 2, 2, 50.0, False), ("c", 1, 1.0, 2, 2, None, True), ("d", 1, 1.0, 2, 2, float("nan"), True), ("e", 1, 1.0, 2, 2, 20.0, True)],)), (2, None), (3, ([],))]
    df = spark.createDataFrame(rows, f"k int, video_clip struct<clips:array<{CLIP}>>")

    def flags(d):
        return {r["k"]: r["video_clip"] and [c["filtered"] for c in r["video_clip"]["clips"]] for r in d.collect()}

    assert flags(clips.luminance_mark(df, lum_min=20, lum_max=140)) == {1: [True, False, False, False, True], 2: None, 3: []}
    assert flags(clips.luminance_mark(df))[1] == [True, False, True, True, True]
    assert flags(clips.video_score_mark(df, aes_min=4, ocr=(None, None), lum=(None, None), motion=(None, None)))[1] == [False] * 5
    with pytest.raises(ValueError, match="aesthetic_score"):
        clips.video_score_mark(df, strict_mode=True, ocr=(None, None), motion=(None, None))
    assert flags(clips.mark_clips(df, "video_clip", {"resolution": (None, 3)}))[1] == [False] * 5


def test_merged_captions(spark):
    rows = [("v_1", "Second", 5.0, None, 2.0), ("v_0", "First\nline ", 0.4, 3.9, None), ("v_2", "", 9.0, 9.5, None), ("v_3", "No start", None, 1.0, 1.0), ("w", "X", float("nan"), 1.0, 1.0), ("w_x", "Y", 1.0, None, 0.0), ("u", "Z", 1.0, 2.0, None), ("v_4", "Another", 5.0, 6.0, None)]
    df = spark.createDataFrame(rows, "id string, caption string, timestamp_start double, timestamp_end double, duration_sec double")
    got = {r["id"]: (r["captions"], r["num_clips"]) for r in clips.merged_captions(df, duration="duration_sec").collect()}
    assert got == {"v": ("From 0 to 3, first line\nFrom 5 to 6, another\nFrom 5 to 7, second", 3), "u": ("From 1 to 2, z", 1)}


def test_frame_plan(spark):
    def plan(n, fps=25.0, interval=None):
        return spark.range(1).select(clips.frame_plan(F.lit(n).cast("int"), F.lit(fps).cast("double"), interval).alias("x")).collect()[0]["x"]

    assert plan(0) == [] and plan(1) == [0] and plan(2) == [0, 1] and plan(9) == [0, 4, 8]
    assert plan(100, 25.0, 2.0) == [0, 50]
    assert plan(9, None, 2.0) == [0, 4, 8]
    assert plan(5, 1.0, 0.1) == [0, 1, 2, 3, 4]


def test_speech_intervals():
    v = audio.Voice(rate=1000, hop=100, min_speech=0.15, min_silence=0.2, pad=0.0)
    assert audio.speech([0, 0.9, 0.9, 0.9, 0, 0, 0, 0], 800, v) == [(100, 400)]
    # Between the thresholds nothing ends.
    assert audio.speech([0.9, 0.9, 0.4, 0.4, 0.4, 0.9, 0, 0, 0], 900, v) == [(0, 600)]
    # Open at the end of the stream; too short ones go.
    assert audio.speech([0, 0.9, 0.9], 300, v) == [(100, 300)]
    assert audio.speech([0, 0, 0.9], 300, v) == []
    # A short pause is bridged.
    assert audio.speech([0.9, 0.9, 0, 0.9, 0.9, 0, 0, 0], 800, v) == [(0, 500)]
    padded = audio.Voice(rate=1000, hop=100, min_speech=0.05, min_silence=0.1, pad=0.15)
    assert audio.speech([0, 0.9, 0.9, 0, 0, 0.9, 0.9, 0, 0], 900, padded) == [(0, 400), (400, 850)]
    long = audio.Voice(rate=1000, hop=100, min_speech=0.05, min_silence=5.0, pad=0.0, max_speech=0.6)
    assert audio.speech([0.9] * 8, 800, long)[0] == (0, 600)
    assert audio.speech([], 0, v) == []


def test_chunks(spark):
    ts = [(0.0, 2.0), (3.0, 3.0), (4.0, 9.0), (9.0, 20.0)]
    df = spark.createDataFrame([(["/a/x.y.wav"], ts, 10.0), (["b.wav"], ts, None), (None, ts, 1.0)], "audio array<string>, timestamps array<struct<start:double,end:double>>, duration_sec double")
    got = audio.chunk_rows(df).collect()
    assert [(r["audio"][0], r["sequence_num"], r["duration"]) for r in got] == [("chunks/x.y_1.wav", 1, 2.0), ("chunks/x.y_2.wav", 2, 5.0), ("chunks/x.y_3.wav", 3, 1.0)]
    merged = audio.chunk_rows(df, mode="merge", max_audio_duration=7.0).collect()
    assert [(len(r["segments"]), r["duration"]) for r in merged] == [(2, 7.0), (1, 1.0)]
    with pytest.raises(ValueError):
        audio.chunk_rows(df, mode="other")


def test_alignment_filter(spark):
    rows = [(1, ([(0.9,), (0.7,)], None)), (2, ([(0.9,), (0.8,)], None)), (3, ([], None)), (4, ([(0.9,)], "bad")), (5, ([(None,)], None))]
    df = spark.createDataFrame(rows, "k int, forced_alignment_results struct<alignment:array<struct<score:double>>,error:string>")
    assert {r["k"] for r in marks.alignment_filter(df).collect()} == {2}
    assert {r["k"] for r in marks.alignment_filter(df, threshold_mode="mean").collect()} == {1, 2}


def vectors(n=60, d=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.3, size=(n - n // 2, d))
    return x


@pytest.mark.parametrize("block", [4096, 7])
def test_vector_operators_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -1)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= 0.9}
    assert {(r["a"], r["b"]) for r in similar.similar_pairs(df, "id", "vector", 0.9).collect()} == want
    kept = {r["id"]: r["max_similarity"] for r in similar.vector_dedup(df, "id", threshold=0.9).collect()}
    assert set(kept) == set(range(60)) - {j for _, j in want}
    assert all(abs(m - (sims[i].max() if sims[i].max() >= 0.9 else 0)) < 1e-9 for i, m in kept.items())
    score = np.sort(sims, axis=1)[:, -5:].mean(axis=1)
    got = {r["id"]: r["knn_similarity_score"] for r in similar.knn_filter(df, "id").collect()}
    assert set(got) == set(np.flatnonzero(score <= np.percentile(score, 50) + 1e-12))


def test_duplicates_chain(spark):
    # b resembles a, c resembles b but not a: both go, though b goes itself.
    angles = np.deg2rad([0, 20, 40])
    df = spark.createDataFrame([(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angles)], "id long, vector array<double>")
    assert [r["id"] for r in similar.vector_dedup(df, "id", threshold=0.9).collect()] == [0]


def test_average_linkage_against_a_plain_loop():
    x = vectors(30)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - unit @ unit.T
    groups = [{i} for i in range(30)]
    while len(groups) > 5:
        _, a, b = min((np.mean([dist[i, j] for i in groups[p] for j in groups[q]]), p, q) for p in range(len(groups)) for q in range(p + 1, len(groups)))
        groups[a] |= groups.pop(b)
    labels = similar.average_linkage(x, 5)
    assert {frozenset(np.flatnonzero(labels == k)) for k in set(labels)} == {frozenset(g) for g in groups}


def test_text_corpus_against_a_dense_refit():
    import re
    from collections import Counter

    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{w}" for w in rng.choice(12, 6)) for _ in range(60)] + ["ab", None, "  "]
    kept, want = [], []
    for t in texts:
        if t is None or len(t.strip()) < 3:
            want.append(False)
            continue
        rows = [Counter(re.findall(r"\w\w+", s)) for s in [*kept, t]]
        terms = sorted(set().union(*rows))
        counts = np.array([[r[w] for w in terms] for r in rows], float)
        idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
        m = counts * idf
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        good = not kept or (m[:-1] @ m[-1]).max() < 0.8
        want.append(bool(good))
        if good:
            kept.append(t)
    corpus = similar.TextCorpus(0.8)
    assert [corpus.check(t) for t in texts] == want
    assert not all(want[:60])


def test_hash_corpus():
    h = similar.HashCorpus(2)
    assert [h.check(v) for v in (0, 3, 7, -1, None, 4)] == [True, False, True, True, False, False]


def png(rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    noisy = rng.integers(0, 256, (64, 48, 3))
    for name, x in {"noisy": noisy, "again": noisy, "black": np.zeros((20, 20, 3)), "white": np.full((20, 20, 3), 255)}.items():
        (tmp_path / f"{name}.png").write_bytes(png(np.asarray(x)))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG no image")
    df = media.images(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    stats = {r["name"]: r["s"] for r in df.select("name", images.statistics("image").alias("s")).collect()}
    assert stats["black"]["black"] == 1 and stats["white"]["white"] == 1 and stats["broken"]["mean"] is None
    assert abs(stats["noisy"]["luma"] - (noisy @ [0.2126, 0.7152, 0.0722]).mean()) < 1e-6
    assert {r["name"] for r in images.aesthetic_filter(df).collect()} == {"noisy", "again"}
    hashes = {r["name"]: r["h"] for r in df.select("name", images.phash("image").alias("h")).collect()}
    assert hashes["noisy"] == hashes["again"] and hashes["broken"] is None
    head = media.files(spark, str(tmp_path), "noisy.png").select(images.sniffed_format(F.col("content")).alias("f")).collect()
    assert head[0]["f"] == "PNG"


def test_waves(spark, tmp_path):
    x = np.sin(np.arange(1600) / 10) / 2
    (tmp_path / "a.wav").write_bytes(media.encode_wave(x, 16000))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    back, rate = media.decode_wave((tmp_path / "a.wav").read_bytes())
    assert rate == 16000 and np.abs(back - x).max() < 1e-4
    rows = {r["path"][-5:]: r["w"] for r in media.files(spark, str(tmp_path), "*.wav").select("path", media.wave_info(F.col("content")).alias("w")).collect()}
    assert rows["a.wav"]["duration_sec"] == 0.1 and rows["b.wav"]["error"]
    assert media.from_data_uri("data:audio/wav;base64,QUI=") == b"AB"


def test_boxes(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 50.0, 100.0], [1.0, 1.0, 10.0, 10.0]], 100, 200), (None, 10, 10)], "bbox array<array<double>>, width int, height int")
    rows = images.box_prompts(df, most=3).collect()
    assert rows[0]["normalized_bbox"] == [[0, 0, 0.5, 0.5], [0.01, 0.005, 0.11, 0.055], [0, 0, 0, 0]] and rows[0]["num_boxes"] == 2
    assert rows[1]["num_boxes"] == 0 and len(rows[1]["normalized_bbox"]) == 3
    assert spark.range(1).select(images.suppressed(F.expr("array(array(0,0,10,10), array(0,0,20,20), array(30,30,5,5))")).alias("x")).collect()[0]["x"] == [[0, 0, 20, 20], [30, 30, 5, 5]]


def test_diversity_queries_compare_all_sources(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 12)), f"s{i % 3}") for i in range(30)]
    # Copies of earlier texts in another source and in the same one, and odd texts.
    rows += [(30, rows[4][1], "s2"), (31, rows[5][1], "s0"), (32, rows[6][1], "s0"), (33, rows[7][1] + " " + rows[7][1], "s0"), (34, None, "s1"), (35, "a", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    hashes = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.xxhash64("text").alias("h")).collect()}

    def novel(text, kept):
        texts = [t.split() for t in [*kept, text]]
        names = sorted({w for t in texts for w in t})
        x = np.array([[t.count(w) for w in names] for t in texts], float)
        x *= np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return not kept or (x[:-1] @ x[-1]).max() < 0.8

    kept, seen, by_text, by_both = [], [], [], []
    for i, text, _ in rows:
        new = text is not None and len(text) >= 3 and novel(text, kept)
        other = all(((h ^ hashes[i]) & (1 << 64) - 1).bit_count() > 20 for h in seen)
        if new:
            kept.append(text)
            by_text.append(i)
        if other:
            seen.append(hashes[i])
        if new and other:
            by_both.append(i)
    assert not {30, 31, 32, 33} & set(by_text) and len(by_text) > 20
    for name, want in (("text_diversity", by_text), ("diversity", by_both)):
        assert sorted(r["doc_id"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_agreement_equals_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60):
        points, count = np.unique(np.stack([rng.integers(0, 9, n), rng.integers(0, 7, n)]).astype(float), axis=1, return_counts=True)
        (x, y), w = points, count.astype(float)
        want = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) * w[i] * w[j] for i in range(len(w)) for j in range(i))
        assert scoring.agreement(x, y, w) == want


def test_places_among_ties_go_by_rank():
    s = np.array([[3.0, 1, 3, 3, 0], [1, 1, 1, 1, 1]])
    i, j = similar._top(s, np.array([4, 0, 1, 2, 3]), 2)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 2), (0, 3), (1, 1), (1, 2)]


def test_average_linkage_holds_no_matrix_of_distances():
    """Equal and zero vectors too; and more rows than a matrix would fit for."""
    import tracemalloc

    x = vectors(60)
    x[7], x[8], x[9] = x[3], x[3], 0
    labels = similar.average_linkage(x, 6)
    assert len(set(labels)) == 6 and labels[7] == labels[8] == labels[3]
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 4))
    tracemalloc.start()
    assert len(set(similar.average_linkage(x, 600))) == 600
    assert tracemalloc.get_traced_memory()[1] < 6000 * 6000 * 8
    tracemalloc.stop()


def test_tailor_works_in_tiles(spark, monkeypatch):
    rows = [(i, v.tolist(), float(i % 5), i % 2) for i, v in enumerate(vectors(40))]
    df = spark.createDataFrame(rows, "id long, vector array<double>, informativeness double, cluster int")
    want = sorted((r["id"], round(r["s"], 9)) for r in similar.tailor(df, "id", output="s").collect())
    monkeypatch.setattr(similar, "TILE", 7)
    assert sorted((r["id"], round(r["s"], 9)) for r in similar.tailor(df, "id", output="s").collect()) == want
