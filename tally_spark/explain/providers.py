"""Model providers over HTTP. Each is an address, headers, a body and where its answer has text and counts; the rest is shared."""

from __future__ import annotations

import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, replace
from functools import cached_property

from .finding import Usage
from .loop import ProviderError, QuotaExhausted

ATTEMPTS, LONGEST_WAIT, IN_A_ROW = 6, 60.0, 3
Answer = tuple[int, dict[str, str], str]
Send = Callable[[str, dict, bytes, float], Answer]


def send_http(url: str, headers: dict, body: bytes, timeout: float) -> Answer:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, {k.lower(): v for k, v in error.headers.items()}, error.read().decode(errors="replace")


@dataclass(frozen=True)
class Api:
    url: Callable[[str], str]
    headers: Callable[[str], dict]
    body: Callable[[str, str, list[dict]], dict]
    text: Callable[[dict], str | None]
    usage: Callable[[dict], Usage]
    key: str | None
    timeout: float = 60.0


def _chat(system: str, turns: list[dict]) -> list[dict]:
    return [{"role": "system", "content": system}, *turns]


def _dig(x, *path):
    for p in path:
        try:
            x = x[p]
        except (KeyError, IndexError, TypeError):
            return None
    return x


APIS = {
    "gemini": Api(
        lambda m: f"https://generativelanguage.googleapis.com/v1beta/models/{m}:generateContent",
        lambda k: {"x-goog-api-key": k},
        lambda m, s, t: {"system_instruction": {"parts": [{"text": s}]}, "contents": [{"role": "model" if x["role"] == "assistant" else "user", "parts": [{"text": x["content"]}]} for x in t], "generationConfig": {"temperature": 0, "responseMimeType": "application/json"}},
        lambda p: _dig(p, "candidates", 0, "content", "parts", 0, "text"),
        lambda p: Usage(0, *(int(_dig(p, "usageMetadata", k) or 0) for k in ("promptTokenCount", "candidatesTokenCount", "thoughtsTokenCount"))),
        "GEMINI_API_KEY",
    ),
    "anthropic": Api(
        lambda m: "https://api.anthropic.com/v1/messages",
        lambda k: {"x-api-key": k, "anthropic-version": "2023-06-01"},
        lambda m, s, t: {"model": m, "max_tokens": 1024, "temperature": 0, "system": s, "messages": t},
        lambda p: "".join(b.get("text") or "" for b in p.get("content") or []),
        lambda p: Usage(0, *(int(_dig(p, "usage", k) or 0) for k in ("input_tokens", "output_tokens"))),
        "ANTHROPIC_API_KEY",
    ),
    "openai": Api(
        lambda m: "https://api.openai.com/v1/chat/completions",
        lambda k: {"authorization": f"Bearer {k}"},
        lambda m, s, t: {"model": m, "temperature": 0, "response_format": {"type": "json_object"}, "messages": _chat(s, t)},
        lambda p: _dig(p, "choices", 0, "message", "content"),
        lambda p: Usage(0, int(_dig(p, "usage", "prompt_tokens") or 0), int(_dig(p, "usage", "completion_tokens") or 0) - int(_dig(p, "usage", "completion_tokens_details", "reasoning_tokens") or 0), int(_dig(p, "usage", "completion_tokens_details", "reasoning_tokens") or 0)),
        "OPENAI_API_KEY",
    ),
    "ollama": Api(
        lambda m: f"{os.environ.get('OLLAMA_URL', 'http://localhost:11434')}/api/chat",
        lambda k: {},
        lambda m, s, t: {"model": m, "stream": False, "format": "json", "options": {"temperature": 0, "num_ctx": 8192}, "messages": _chat(s, t)},
        lambda p: _dig(p, "message", "content"),
        lambda p: Usage(0, int(p.get("prompt_eval_count") or 0), int(p.get("eval_count") or 0)),
        None,
        300.0,
    ),
}


@dataclass(frozen=True)
class Reply:
    """What came back from one request; status 0 where nothing did and text says why."""

    status: int
    headers: dict[str, str]
    text: str

    @cached_property
    def error(self) -> dict:
        """The error object that all of these services put into a refusal's body."""
        with suppress(ValueError):
            body = json.loads(self.text)
            if isinstance(body, dict) and isinstance(body.get("error"), dict):
                return body["error"]
        return {}

    @property
    def notes(self) -> list[dict]:
        return [x for x in self.error.get("details") or () if isinstance(x, dict)]

    @property
    def exhausted(self) -> str:
        """Which allowance is gone for longer than a run lasts; empty if none is."""
        if self.status != 429:
            return ""
        if self.error.get("code") == "insufficient_quota":
            return "no credit left on the account"
        gone = [str(v.get("quotaId")) for x in self.notes for v in x.get("violations") or () if "PerDay" in str(v.get("quotaId"))]
        return f"allowance of the day spent: {', '.join(gone)}" if gone else ""

    @property
    def passing(self) -> bool:
        """Whether the same request may succeed later."""
        return self.status == 0 or self.status == 429 or self.status >= 500

    @property
    def asked_for(self) -> float | None:
        """Seconds that the server wants to be left alone, from the header or a note ("1.5s")."""
        wishes = [self.headers.get("retry-after"), *(x.get("retryDelay") for x in self.notes)]
        numbers = [re.fullmatch(r"([0-9]+(?:[.][0-9]+)?)s?", str(w)) for w in wishes if w]
        return next((float(n[1]) for n in numbers if n), None)

    def __str__(self) -> str:
        said = " ".join(str(self.error.get("message") or self.text).split())[:300]
        return f"status {self.status}, {said}" if self.status else said


class Breaker:
    """Lets calls through until one finds the allowance spent, or IN_A_ROW have failed without a success between."""

    def __init__(self) -> None:
        self.opened, self.failed = "", 0

    @contextmanager
    def call(self, name: str) -> Iterator[None]:
        if self.opened:
            raise ProviderError(f"{name}: skipped, since {self.opened}")
        try:
            yield
        except QuotaExhausted as error:
            self.opened = f"an earlier call said: {error}"
            raise
        except ProviderError:
            self.failed += 1
            self.opened = f"the last {IN_A_ROW} calls all failed" if self.failed == IN_A_ROW else ""
            raise
        self.failed = 0


class HttpProvider:
    """One model behind one of the APIS."""

    def __init__(self, name: str, model: str, key: str | None, send: Send = send_http, sleep: Callable[[float], None] = time.sleep) -> None:
        self.name, self.model, self.usage, self.breaker = name, model, Usage(), Breaker()
        self.api, self.send, self.sleep = APIS[name], send, sleep
        self.headers = {"content-type": "application/json"} | self.api.headers(key or "")

    def complete(self, system: str, transcript: list[dict[str, str]]) -> str:
        with self.breaker.call(self.name):
            return self._read(*self._persist(json.dumps(self.api.body(self.model, system, transcript)).encode()))

    def _once(self, body: bytes) -> Reply:
        try:
            return Reply(*self.send(self.api.url(self.model), self.headers, body, self.api.timeout))
        except OSError as error:
            return Reply(0, {}, f"{type(error).__name__}: {error}")

    def _persist(self, body: bytes) -> tuple[str, float, float]:
        """The text of the first good reply, seconds since the first request, and how many of these were pauses between requests."""
        began, paused = time.monotonic(), 0.0
        for left in reversed(range(ATTEMPTS)):
            reply = self._once(body)
            if 200 <= reply.status < 300:
                return reply.text, time.monotonic() - began, paused
            if reply.exhausted:
                raise QuotaExhausted(f"{self.name}: {reply.exhausted} ({reply})")
            if not (left and reply.passing):
                break
            own = 2.0 ** (ATTEMPTS - left) * random.uniform(0.5, 1)
            pause = min(reply.asked_for or own, LONGEST_WAIT)
            self.sleep(pause)
            paused += pause
        raise ProviderError(f"{self.name}: {reply}")

    def _read(self, raw: str, took: float, paused: float) -> str:
        try:
            payload = json.loads(raw)
        except ValueError as error:
            raise ProviderError(f"{self.name}: a reply that isn't JSON: {error}") from error
        self.usage += replace(self.api.usage(payload), calls=1, latency_ms=round(took * 1000), wait_ms=round(paused * 1000))
        if text := self.api.text(payload):
            return text
        raise ProviderError(f"{self.name}: a reply without text")


def build(name: str, model: str | None, send: Send = send_http, sleep: Callable[[float], None] = time.sleep) -> HttpProvider:
    if name not in APIS:
        raise ProviderError(f"unknown provider {name!r}; there are offline, {', '.join(APIS)}")
    key_name = APIS[name].key
    key = os.environ.get(key_name) if key_name else None
    if key_name and not key:
        raise ProviderError(f"{key_name} isn't set; set it, or use the offline provider")
    if not model:
        raise ProviderError(f"provider {name} needs a model's name")
    return HttpProvider(name, model, key, send, sleep)
