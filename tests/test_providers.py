import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from millrace import providers
from millrace.operators import generate


class Counted:
    """A provider that counts its requests in an accumulator."""

    def __init__(self, seen, answer):
        self.seen, self.answer = seen, answer

    def generate(self, requests):
        self.seen.add(len(requests))
        return [self.answer(r) for r in requests]


@pytest.fixture()
def counted(spark):
    def make(answer):
        seen = spark.sparkContext.accumulator(0)
        return seen, (lambda: Counted(seen, answer))

    return make


def rows(spark, n=100):
    return spark.range(n, numPartitions=3).select("id", F.concat(F.lit("q"), "id").alias("question"), F.lit("a").alias("answer"), F.lit("i.png").alias("image"), F.lit("p").alias("prompt"))


@pytest.mark.parametrize("name", ["failing", "vision_dependent"])
def test_judged_rows_ask_once(spark, counted, name):
    (tries, model), (verdicts, judge) = counted(lambda r: "x"), counted(lambda r: "Final Judgment: B")
    assert getattr(generate, name)(rows(spark), model, judge).count() == 100
    assert (tries.value, verdicts.value) == (100, 100)


def test_a_filter_on_answers_asks_once_and_rows_left_out_are_not_asked(spark, counted):
    seen, model = counted(lambda r: r["prompt"])
    got = generate.answered(rows(spark), model, "said", when=F.col("id") % 4 == 0, prompt=F.col("question"))
    assert got.where("said is not null and said <> 'q0'").count() == 24
    assert seen.value == 25


def test_earlier_answers_are_not_asked_again(spark, counted):
    (first, model), (second, other) = counted(lambda r: "no answer"), counted(lambda r: "<answer>A</answer>")
    made = generate.prompted_qa(rows(spark), model, "prompt", "first")
    assert len(generate.answered(made, other, "second", when=F.col("first") == "no answer", prompt=F.col("first")).collect()) == 100
    assert (first.value, second.value) == (100, 100)


def test_keyword_boxes_ask_once_an_item(spark, counted):
    seen, model = counted(lambda r: "[[1, 2, 3, 4]]")
    base = rows(spark, 50).withColumn("keywords", F.array(F.lit("x"), F.lit("y")))
    got = generate.batch_vqa(base, model, "id", "keywords")
    assert len(got.select("id", "answers").collect()) == 50
    assert seen.value == 100


@pytest.fixture()
def server():
    """A chat endpoint that fails now and then and keeps what it was sent."""
    sent = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            sent.append((self.path, body, self.headers.get("Authorization")))
            if len(sent) == 1:
                self.send_response(503)
                self.end_headers()
                return
            if self.path == "/embed":
                reply = {"data": [{"embedding": [1, len(body["input"][0])]}]}
            elif "bad" in json.dumps(body["messages"]):
                self.send_response(400)
                self.end_headers()
                return
            else:
                reply = {"choices": [{"message": {"content": f"{len(body['messages'])} messages"}}]}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}", sent
    held.shutdown()


def test_the_server_sees_the_media(spark, server, tmp_path):
    url, sent = server
    data = b"\x89PNG\r\n\x1a\nbytes of an image"
    (tmp_path / "i.png").write_bytes(data)
    df = spark.createDataFrame([(1, "what?", [str(tmp_path / "i.png"), "https://a.b/c.jpg"]), (2, "bad", None)], "id int, prompt string, image array<string>").coalesce(1)
    got = {r["id"]: r for r in generate.prompted_vqa(df, lambda: providers.Http(url + "/chat", "m", "secret", workers=1, most_pause=0.01), None, "prompt", video=None, system_prompt="short").collect()}
    assert got[1]["answer"] == "2 messages" and got[2]["answer"] is None and "400" in got[2]["answer_error"]
    path, body, key = sent[1]
    assert (path, body["model"], key) == ("/chat", "m", "Bearer secret")
    assert body["messages"][0] == {"role": "system", "content": "short"}
    first, second, text = body["messages"][1]["content"]
    assert base64.b64decode(first["image_url"]["url"].removeprefix("data:image/png;base64,")) == data
    assert second["image_url"]["url"] == "https://a.b/c.jpg" and text == {"type": "text", "text": "what?"}


def test_conversations_and_sound_reach_the_server(spark, server, tmp_path):
    url, sent = server
    (tmp_path / "a.wav").write_bytes(b"RIFFsound")
    df = spark.createDataFrame([(1, [("human", "listen"), ("gpt", "ok"), ("human", "and?")], str(tmp_path / "a.wav"))], "id int, conversation array<struct<`from`:string,value:string>>, audio string")
    got = generate.prompted_aqa(df, lambda: providers.Http(url + "/chat", "m", workers=1, most_pause=0.01)).collect()[0]
    assert got["answer"] == "3 messages"
    turn = sent[-1][1]["messages"][0]
    assert turn["role"] == "user" and turn["content"][1]["text"] == "listen"
    assert base64.b64decode(turn["content"][0]["input_audio"]["data"]) == b"RIFFsound" and "wav" in turn["content"][0]["input_audio"]["format"]


def test_embeddings(spark, server):
    url, _ = server
    df = spark.createDataFrame([(1, "four"), (2, None)], "id int, text string").coalesce(1)
    got = {r["id"]: r["vector"] for r in generate.embed(df, lambda: providers.HttpEmbeddings(url + "/embed", "m", workers=1, most_pause=0.01)).collect()}
    assert got == {1: [1.0, 4.0], 2: None}


def test_media_of_every_form():
    assert providers.media_uri(b"GIF8x", "image").startswith("data:image/gif;base64,")
    assert providers.media_uri("data:x", "image") == "data:x"
    assert providers.media_parts({"image": None, "video": ["http://v"], "audio": [None]}) == [{"type": "video_url", "video_url": {"url": "http://v"}}]
