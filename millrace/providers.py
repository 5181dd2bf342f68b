"""Models behind one small interface, so that operators don't know them.

A provider turns a batch of requests into as many answers. It is made once in
each Python worker, from a factory that is sent to the cluster. A request that
fails gives a null answer and the error's text; it never fails the job, and an
error's text is never taken for an answer. Providers must bear that a task is
run twice: they name files by row, and write before they rename.
"""

from __future__ import annotations

import base64
import json
import mimetypes
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Provider(Protocol):
    def generate(self, requests: list[dict]) -> list: ...


@dataclass
class Stub:
    """Answers by a function of the request; for tests."""

    answer: Callable[[dict], object]

    def generate(self, requests: list[dict]) -> list:
        return [self.answer(r) for r in requests]


_MAGIC = ((b"\x89PNG", "image/png"), (b"\xff\xd8", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"RIFF", "audio/wav"), (b"ID3", "audio/mpeg"))
_USUAL = {"image": "image/png", "video": "video/mp4", "audio": "audio/wav"}


def media_uri(value: object, kind: str) -> str:
    """A medium as a chat endpoint takes it: a web address or a data URI as it is,
    a file or bytes as a data URI."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        data, name = bytes(value), None
        name = next((m for head, m in _MAGIC if data.startswith(head)), _USUAL[kind])
    else:
        text = str(value)
        if text.startswith(("http://", "https://", "data:")):
            return text
        path = text.removeprefix("file://")
        with open(path, "rb") as f:
            data = f.read()
        name = mimetypes.guess_type(path)[0] or _USUAL[kind]
    return f"data:{name};base64,{base64.b64encode(data).decode()}"


def media_parts(request: dict) -> list[dict]:
    """The content parts of a request's media, in the order image, video, audio."""
    out = []
    for kind in ("image", "video", "audio"):
        held = request.get(kind)
        if held is None:
            continue
        for value in [held] if isinstance(held, (str, bytes, bytearray, memoryview)) else list(held):
            if value is None:
                continue
            uri = media_uri(value, kind)
            if kind == "audio" and uri.startswith("data:"):
                head, _, body = uri.partition(",")
                form = head[5:].split(";")[0].split("/")[-1].removeprefix("x-")
                out.append({"type": "input_audio", "input_audio": {"data": body, "format": {"mpeg": "mp3"}.get(form, form)}})
            else:
                out.append({"type": f"{kind}_url", f"{kind}_url": {"url": uri}})
    return out


def chat_messages(request: dict) -> list[dict]:
    """The messages of a request, whose media are parts of the first turn of the
    user. A system prompt stands before messages that have none."""
    given = request.get("messages")
    if given is not None and len(given):
        messages = [{"role": m["role"], "content": m["content"]} for m in given]
    else:
        messages = [{"role": "user", "content": request.get("prompt") or ""}]
    if request.get("system") and messages[0]["role"] != "system":
        messages.insert(0, {"role": "system", "content": request["system"]})
    parts = media_parts(request)
    if parts:
        turn = next((m for m in messages if m["role"] == "user"), None)
        if turn is None:
            messages.append(turn := {"role": "user", "content": ""})
        turn["content"] = [*parts, {"type": "text", "text": turn["content"] or ""}]
    return messages


@dataclass
class Http:
    """A chat endpoint in the common JSON form, called by a pool of threads.

    A request may hold prompt, system, messages, and image, video and audio: one
    or several paths, addresses or bytes, which are sent as typed parts. Rate
    limits, time-outs and server errors are tried again with growing pauses."""

    url: str
    model: str
    key: str = ""
    workers: int = 10
    tries: int = 3
    timeout: float = 1800.0
    most_pause: float = 10.0
    options: dict = field(default_factory=dict)

    def _one(self, request: dict) -> str:
        said = self._post({"model": self.model, "messages": chat_messages(request), **self.options})["choices"][0]["message"]
        thought = said.get("reasoning_content")
        return f"<think>{thought}</think>\n<answer>{said['content']}</answer>" if thought else said["content"]

    def _post(self, content: dict) -> dict:
        body = json.dumps(content).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if k + 1 == self.tries or not (e.code == 429 or e.code >= 500):
                    raise
            except (urllib.error.URLError, TimeoutError):
                if k + 1 == self.tries:
                    raise
            time.sleep(min(2.0**k, self.most_pause))
        raise RuntimeError("no tries left")

    def generate(self, requests: list[dict]) -> list:
        def safe(r: dict):
            try:
                return self._one(r)
            except Exception as e:
                return e

        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(safe, requests))


@dataclass
class HttpEmbeddings(Http):
    """An embeddings endpoint in the common JSON form; the answer to a request is
    the vector of its prompt."""

    def _one(self, request: dict) -> list[float]:
        found = self._post({"model": self.model, "input": [request.get("prompt") or ""], **self.options})
        return [float(x) for x in found["data"][0]["embedding"]]


def _answers(provider: Provider, requests: list[dict]) -> list[tuple[object, str | None]]:
    """(answer, error) of each request; a failing batch is asked one by one."""
    if not requests:
        return []
    try:
        found = provider.generate(requests)
        if len(found) != len(requests):
            raise ValueError(f"{len(found)} answers for {len(requests)} requests")
    except Exception as e:
        if len(requests) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [_answers(provider, [r])[0] for r in requests]
    return [(None, f"{type(a).__name__}: {a}") if isinstance(a, Exception) else (a, None) for a in found]


def ask(factory: Callable[[], Provider], kind: str = "string", when: Column | None = None, **inputs: Column) -> Column:
    """struct(answer, error): what a provider answers to requests that hold the
    inputs. kind is the answer's type. Only the inputs reach Python. Rows where
    when isn't true are not asked, and get nulls.

    The column counts as nondeterministic, as models are: the optimiser then
    neither copies the call into filters nor asks twice for one row."""
    names = list(inputs)
    schema = f"struct<answer:{kind},error:string>"

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for todo, *batch in batches:
            requests = [dict(zip(names, row)) for row in zip(*(s.tolist() for s in batch))]
            asked = todo.fillna(False).astype(bool).tolist()
            got = iter(_answers(provider, [r for r, x in zip(requests, asked) if x]))
            found = [next(got) if x else (None, None) for x in asked]
            yield pd.DataFrame({"answer": pd.Series([a for a, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    test = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    return F.pandas_udf(run, schema).asNondeterministic()(test, *inputs.values())
