import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import operators
from millrace.operators import generate
from millrace.plans import pipelines
from millrace.providers import Stub
from millrace.sources import files
from millrace.streaming import live


def test_registry():
    assert len(operators.REGISTRY) >= 70
    assert operators.get("ScoreFilter").kind == "filter"
    with pytest.raises(KeyError):
        operators.get("scorefilter")
    with pytest.raises(ValueError):
        operators.operator("ScoreFilter", "filter")(lambda df: df)


def test_pipeline_resumes(spark, tmp_path):
    calls = []

    def stage(df):
        calls.append(1)
        return df.where("id > 2")

    chain = operators.Pipeline().then("big", stage).then("mark", "ScoreFilter", score="id", max_score=3)
    df = spark.range(5)
    assert chain.run(df).where("select").count() == 1
    assert chain.run(df, str(tmp_path)).count() == 2
    assert chain.run(df, str(tmp_path)).count() == 2
    assert len(calls) == 2


def test_jsonl_drops_bad_lines(spark, tmp_path):
    at = tmp_path / "x.jsonl"
    at.write_text('{"a": 1}\n\n{"a": \n{"b": "x"}\n')
    rows = files.read(spark, str(at)).collect()
    assert sorted((r["a"], r["b"]) for r in rows if r["a"] is not None) == [(1, None)] and len(rows) == 2
    assert [r["line"] for r in files.bad_lines(spark, str(at)).collect()] == ['{"a": ']
    at.write_text("\nno json\n")
    with pytest.raises(ValueError, match="no valid record"):
        files.read(spark, str(at))
    with pytest.raises(ValueError, match="unknown format"):
        files.read(spark, "x.pickle")


def test_steps_need_a_step(spark, tmp_path):
    steps = files.Steps(spark, str(tmp_path / "entry.json"), str(tmp_path))
    with pytest.raises(ValueError):
        steps.read()
    (tmp_path / "entry.json").write_text('[{"a": 1}, {"a": 2}]')
    steps.write(steps.step().read().where("a = 2"))
    assert [r["a"] for r in steps.step().read().collect()] == [2]


def test_hub_names(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "owner/set/train"))
    spark.range(2).write.parquet(str(tmp_path / "owner/set/en/test"))
    assert files.hub(spark, "hf:owner/set", str(tmp_path)).count() == 3
    assert files.hub(spark, "hf:owner/set:en:test", str(tmp_path)).count() == 2
    assert files.hub(spark, "ms:owner/set:train", str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        files.hub(spark, "owner/set", str(tmp_path))


def rough():
    def say(r):
        if "boom" in r["prompt"]:
            raise RuntimeError("boom")
        return r["prompt"].upper()

    return Stub(say)


def test_provider_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "id int, prompt string")
    rows = {r["id"]: (r["answer"], r["answer_error"]) for r in generate.prompted_qa(df, rough).collect()}
    assert rows == {1: ("A", None), 2: (None, "RuntimeError: boom"), 3: ("", None)}


def test_items_keep_order_and_empty_lists_stay(spark):
    df = spark.createDataFrame([(1, ["b", "boom", "a"]), (2, []), (3, None)], "id int, prompts array<string>")
    got = {r["id"]: r["answers"] for r in generate.batch_vqa(df, rough, "id", image=None).collect()}
    assert got == {1: ["B", None, "A"], 2: [], 3: []}


def test_grounding_ignores_error_texts(spark):
    df = spark.createDataFrame([(1, ["yes boom", "yes"], "i.png"), (2, ["yes"], None)], "id int, items array<string>, image string")
    got = {r["id"]: r["grounded"] for r in generate.grounded(df, rough, "id", template="{text}").collect()}
    assert got == {1: ["yes"], 2: []}


def test_one_kind_of_media(spark):
    df = spark.createDataFrame([("a", None), (None, "b")], "image string, video string")
    with pytest.raises(Exception, match="both hold data"):
        generate.fixed_vqa(df, rough, "x", "image", "video").collect()


def test_math_questions_do_not_depend_on_partitions(spark):
    df = spark.range(40).withColumn("mode", F.when(F.col("id") % 2 == 0, "simple").otherwise("complex"))
    a, b = ({r["id"]: (r["question"], r["answer"]) for r in generate.math_questions(d, "id").collect()} for d in (df.repartition(1), df.repartition(7)))
    assert a == b and len({q for q, _ in a.values()}) > 20


def test_reasoning_pipelines_run(spark):
    def model():
        def say(r):
            p = r.get("prompt") or r["messages"][0]["content"]
            if "Keywords:" in p:
                return "I see a red ball.\nKeywords: red, ball"
            return "(0.1, 0.2), (0.3, 0.4)" if p.startswith("Where") else "Yes. It is."

        return Stub(say)

    df = spark.createDataFrame([(1, "What?", "i.png")], "id int, question string, image string")
    r = pipelines.grounded_reasoning(model).run(df).collect()[0]
    assert r["grounded_cot"] == "I see a red ball [0.100, 0.200, 0.300, 0.400]."
    out = pipelines.scale_caption(model).run(df).collect()[0]
    assert out["sentences_true"] == ["Yes.", "It is."] and out["questions"] == []
    clip = spark.createDataFrame([(["v_0.mp4"], "v_0", 0.0, 4.0), (["v_1.mp4"], "v_1", 4.0, 9.0)], "video array<string>, id string, timestamp_start double, timestamp_end double")

    def reason():
        return Stub(lambda r: "QUESTION: Why?\nA. x\nB. y\nANSWER: B\n##### From [0 to 9]:\n- the captions say so\n")

    got = pipelines.long_video_reasoning(model, reason, rough).run(clip).collect()
    assert [g["process"] for g in got] == ["Q: WHY?\nA: B\nWHY: THE VIDEO SAY SO"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, "k", dt.datetime(2024, 1, 1, 0, i % 30), float(v)) for i, v in enumerate([1, 9, 9, 1, 9, 1])]
    spark.createDataFrame(rows, "id long, key string, ts timestamp, v double").write.parquet(str(source))
    stream = spark.readStream.schema("id long, key string, ts timestamp, v double").parquet(str(source))
    out = live.windowed_counts(stream, "ts", "key", "v", "10 minutes")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [(r["n"], r["mean"]) for r in spark.table("counts").collect()] == [(6, 5.0)]
    q = live.speech_intervals(stream, "key", "ts", "v", 5.0).writeStream.outputMode("append").format("memory").queryName("runs").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted((r["start"].minute, r["end"].minute, r["n"]) for r in spark.table("runs").collect()) == [(1, 2, 2), (4, 4, 1)]
    at = str(tmp_path / "once")
    live.to_table(live.first_seen(stream, "v", "ts"), at, at + "-c").awaitTermination()
    assert spark.read.parquet(at).count() == 2
