"""Model calls in plain Python: providers, retries and rate limits, used inside the call stage."""

from __future__ import annotations

import base64
import json
import math
import os
import subprocess
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from promptmatrix.errors import ProviderError

#: Media kinds that each provider takes.
TAKES = {
    "mock": {"image", "file", "audio", "video"},
    "command": {"image", "file", "audio", "video"},
    "anthropic": {"image", "file"},
    "openai": {"image", "file", "audio"},
    "openai-compatible": {"image", "file", "audio"},
}
#: HTTP statuses that may pass on another attempt, besides those from 500 up.
RETRYABLE = frozenset({408, 409, 429})

Messages = list[dict[str, Any]]
Transport = Callable[[str, dict[str, str], dict[str, Any], float], tuple[int, dict[str, str], str]]


def usage(value: Any, whole: bool = True) -> float | int | None:
    """A number that a provider reports: not negative, finite, and whole where asked; None stays None."""
    if value is None:
        return None
    try:
        number = float(value) if not isinstance(value, bool) else math.nan
    except (TypeError, ValueError):
        number = math.nan
    if not math.isfinite(number) or number < 0 or whole and number != int(number):
        raise ProviderError(f"provider reported unusable usage {value!r}")
    return int(number) if whole else number


@dataclass
class Completion:
    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    cost_usd: float | None = None
    raw: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.input_tokens, self.output_tokens, self.cost_usd = usage(self.input_tokens), usage(self.output_tokens), usage(self.cost_usd, whole=False)


def text_of(message: dict[str, Any]) -> str:
    return "".join(p["text"] or "" for p in message["parts"] if p["type"] == "text")


def _post(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float) -> tuple[int, dict[str, str], str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, dict(answer.headers), answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), e.read().decode("utf-8", "replace")
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise ProviderError(f"request failed: {type(e).__name__}", retryable=True) from e


class Provider:
    """``complete(messages)`` for one model."""

    def __init__(self, spec: dict[str, Any], base: str = ".", env: dict[str, str] | None = None, transport: Transport = _post):
        self.spec, self.params, self.base = spec, dict(spec.get("params") or {}), base
        self.env, self.transport = os.environ if env is None else env, transport

    def complete(self, messages: Messages) -> Completion:
        raise NotImplementedError

    @property
    def model(self) -> str:
        return str(self.params.get("model", self.spec["id"]))

    def extra(self, *known: str) -> dict[str, Any]:
        """Parameters that go into the request as they are."""
        return {k: v for k, v in self.params.items() if k not in {"model", "pricing", "cost", *known}}

    def key(self, default: str) -> str:
        name = self.spec.get("api_key_env") or default
        if not self.env.get(name):
            raise ProviderError(f"environment variable {name} is not set")
        return self.env[name]

    def post(self, url: str, headers: dict[str, str], body: dict[str, Any], secret: str) -> dict[str, Any]:
        status, got, text = self.transport(url, {"content-type": "application/json", **headers}, body, self.spec.get("timeout_s") or 120.0)
        if status >= 400:
            after = next((v for k, v in got.items() if k.lower() == "retry-after"), None)
            said = text[:300].replace(secret, "[redacted]") if len(secret) >= 8 else text[:300]
            raise ProviderError(f"HTTP {status}: {said}", retryable=status in RETRYABLE or status >= 500, retry_after=float(after) if after and after.replace(".", "", 1).isdigit() else None)
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise ProviderError(f"HTTP {status}: answer is not JSON") from e


class Mock(Provider):
    """Fixed or echoing answers, and failures on demand."""

    calls = 0

    def complete(self, messages: Messages) -> Completion:
        self.calls += 1
        if self.params.get("error") == "fatal":
            raise ProviderError("mock fatal error")
        if self.calls <= int(self.params.get("fail_times", 0)):
            raise ProviderError(f"mock transient failure #{self.calls}", retryable=True)
        if "response" in self.params:
            text = str(self.params["response"])
        else:
            users = [m for m in messages if m["role"] == "user"]
            said = [p["text"] if p["type"] == "text" else f"[{p['type']}:{p['sha256'][:8]}]" for p in users[-1]["parts"]] if users else ["mock response"]
            text = " ".join(s for s in said if s)
        chars = sum(len(text_of(m)) for m in messages)
        return Completion(text, chars // 4, len(text) // 4, float(self.params.get("cost", 0.0)), {"mock_calls": self.calls})


class Command(Provider):
    """A program that reads a JSON request and writes text, or an object with ``text`` and usage."""

    def complete(self, messages: Messages) -> Completion:
        sent = json.dumps({"model": self.model, "params": self.params, "messages": [{"role": m["role"], "text": text_of(m), "parts": m["parts"]} for m in messages]})
        try:
            done = subprocess.run(self.spec["command"], shell=True, input=sent, capture_output=True, text=True, cwd=self.base, timeout=self.spec.get("timeout_s") or 300)
        except subprocess.TimeoutExpired:
            raise ProviderError("command timed out", retryable=True) from None
        if done.returncode:
            raise ProviderError(f"command exited with {done.returncode}: {done.stderr.strip()[:300]}", retryable=True)
        try:
            answer = json.loads(done.stdout)
        except json.JSONDecodeError:
            answer = None
        if isinstance(answer, dict) and isinstance(answer.get("text"), str):
            return Completion(answer["text"], answer.get("input_tokens"), answer.get("output_tokens"), answer.get("cost_usd"), answer)
        return Completion(done.stdout.rstrip("\n"))


def _data(part: dict[str, Any]) -> str:
    return base64.b64encode(Path(part["source"]).read_bytes()).decode()


class MessagesApi(Provider):
    """System text apart from the turns; content blocks with base64 sources."""

    URL = "https://api.anthropic.com/v1/messages"

    def payload(self, messages: Messages) -> dict[str, Any]:
        block = {"image": "image", "file": "document"}
        turns = [
            {"role": m["role"], "content": [{"type": "text", "text": p["text"]} if p["type"] == "text" else {"type": block[p["type"]], "source": {"type": "base64", "media_type": p["media_type"], "data": _data(p)}} for p in m["parts"]]}
            for m in messages
            if m["role"] != "system"
        ]
        system = "\n\n".join(text_of(m) for m in messages if m["role"] == "system")
        return {"model": self.model, "max_tokens": self.params.get("max_tokens", 4096), "messages": turns, **({"system": system} if system else {}), **self.extra("max_tokens")}

    def complete(self, messages: Messages) -> Completion:
        key = self.key("ANTHROPIC_API_KEY")
        got = self.post(self.spec.get("base_url") or self.URL, {"x-api-key": key, "anthropic-version": "2023-06-01"}, self.payload(messages), key)
        if got.get("stop_reason") == "refusal":
            raise ProviderError("the model refused")
        text = "".join(b.get("text", "") for b in got.get("content", []) if b.get("type") == "text")
        used = got.get("usage") or {}
        return Completion(text, used.get("input_tokens"), used.get("output_tokens"), None, got)


class ChatApi(Provider):
    """Turns with plain text, or parts with data URLs where there is media."""

    URL = "https://api.openai.com/v1"

    def payload(self, messages: Messages) -> dict[str, Any]:
        def part(p: dict[str, Any]) -> dict[str, Any]:
            if p["type"] == "text":
                return {"type": "text", "text": p["text"]}
            if p["type"] == "audio":
                codec = {"audio/mpeg": "mp3", "audio/wav": "wav"}.get(p["media_type"], p["media_type"].split("/")[1])
                return {"type": "input_audio", "input_audio": {"data": _data(p), "format": codec}}
            url = f"data:{p['media_type']};base64,{_data(p)}"
            return {"type": "image_url", "image_url": {"url": url}} if p["type"] == "image" else {"type": "file", "file": {"filename": Path(p["source"]).name, "file_data": url}}

        plain = lambda m: all(p["type"] == "text" for p in m["parts"])
        return {"model": self.model, "messages": [{"role": m["role"], "content": text_of(m) if plain(m) else [part(p) for p in m["parts"]]} for m in messages], **self.extra()}

    def complete(self, messages: Messages) -> Completion:
        own = self.spec["provider"] == "openai-compatible" and not self.spec.get("api_key_env")
        key = self.env.get("OPENAI_API_KEY", "") if own else self.key("OPENAI_API_KEY")
        url = f"{(self.spec.get('base_url') or self.URL).rstrip('/')}/chat/completions"
        got = self.post(url, {"authorization": f"Bearer {key}"} if key else {}, self.payload(messages), key)
        try:
            text = got["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("answer has no choices") from e
        used = got.get("usage") or {}
        return Completion(text, used.get("prompt_tokens"), used.get("completion_tokens"), None, got)


KINDS: dict[str, type[Provider]] = {"mock": Mock, "command": Command, "anthropic": MessagesApi, "openai": ChatApi, "openai-compatible": ChatApi}


def provider(spec: dict[str, Any], base: str = ".", **more: Any) -> Provider:
    return KINDS[spec["provider"]](spec, base, **more)


def delay(attempt: int, retry_after: float | None = None) -> float:
    """Seconds before the next attempt (from 1): doubling from a half to eight, or what the server asks, a minute at most."""
    return min(retry_after, 60.0) if retry_after is not None else min(0.5 * 2 ** (attempt - 1), 8.0)


def with_retries(call: Callable[[], Any], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> Any:
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except ProviderError as e:
            if not e.retryable or attempt == attempts:
                raise
            sleep(delay(attempt, e.retry_after))


def slots(per_minute: int | None, recent: list[float]) -> list[float]:
    """When each of a model's calls a minute was used last: the latest of the times given, 0 for those not used; none without a rate."""
    if not per_minute:
        return []
    late = sorted(recent)[-per_minute:]
    return [0.0] * (per_minute - len(late)) + late


class RateLimit:
    """Slots that may each start one call in any trailing minute, for any number of threads.  ``used`` says when each was used last."""

    def __init__(self, used: list[float], clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.used, self.clock, self.sleep, self.lock = deque(sorted(used)), clock, sleep, threading.Lock()

    def wait(self) -> None:
        while True:
            with self.lock:
                now = self.clock()
                rest = 60 - (now - self.used[0])  # slots stand in the order of their last use
                if rest <= 0:
                    self.used.popleft()
                    self.used.append(now)
                    return
            self.sleep(rest)


@dataclass(frozen=True)
class Share:
    """How the calls of a model are spread: tasks, calls in flight in each, and calls a minute of all of them."""

    tasks: int
    in_flight: int
    per_minute: int | None


def share(spec: dict[str, Any], concurrency: int, models: int, cores: int) -> Share:
    """The share of one of ``models`` called models in a run that has ``concurrency`` calls in flight at most."""
    most = max(1, min(int(spec.get("max_concurrency") or concurrency), concurrency // max(1, models) or 1))
    rate = spec.get("requests_per_minute")
    tasks = max(1, min(most, cores, int(rate) if rate else most))
    return Share(tasks, max(1, most // tasks), int(rate) if rate else None)
