"""Chat and embedding providers behind one interface, applied in batches.

Only the driver resolves settings.  Offline providers are deterministic, so
everything around a provider can be tested without a network.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ("", "changeme", "your-api-key", "your_api_key_here")
UNAVAILABLE = ("model_disabled", "model not found", "404", "not_found")
RATE_LIMITED = ("429", "rate limit", "quota", "resource_exhausted")
TRANSIENT = (*RATE_LIMITED, "timeout", "timed out", "503", "unavailable")


class Chat(Protocol):
    def __call__(self, prompt: str, system: str = "", json_mode: bool = False) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str], task: str) -> list[list[float]]: ...


class ProviderError(RuntimeError):
    """A normalised failure; the message is short and free of the request."""


def setting(name: str, explicit: str | None = None, secrets: dict | None = None, default: str | None = None) -> str | None:
    """Argument, environment, secrets, default, in this order; placeholders count as absent."""
    for value in (explicit, os.environ.get(name), (secrets or {}).get(name)):
        if value and value.strip().lower() not in PLACEHOLDERS:
            return value.strip()
    return default


def chat_text(data: dict) -> str:
    """Text of the first choice: a string, or a list of parts; empty without choices."""
    choices = data.get("choices") or []
    content = (choices[0].get("message") or {}).get("content") if choices else ""
    if isinstance(content, list):
        return "".join(p if isinstance(p, str) else p.get("text") or "" for p in content)
    return content or ""


def compact(body: str, limit: int = 700) -> str:
    return " ".join(body.split())[:limit]


@dataclass
class HttpChat:
    """A chat endpoint with bearer authentication and a chain of fallback models."""

    base_url: str
    api_key: str
    models: tuple[str, ...]
    timeout: float = 120.0
    post: Callable[[str, dict, dict, float], dict] | None = None
    working: str | None = None

    def __call__(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        chain = [self.working] if self.working else []
        chain += [m for m in self.models if m not in chain]
        last: ProviderError | None = None
        for model in chain:
            payload = {"model": model, "temperature": 0, "messages": [{"role": r, "content": c} for r, c in (("system", system), ("user", prompt)) if c]}
            if json_mode:
                payload["response_format"] = {"type": "json_object"}
            try:
                text = chat_text((self.post or post_json)(f"{self.base_url.rstrip('/')}/chat/completions", payload, {"Authorization": f"Bearer {self.api_key}"}, self.timeout))
                self.working = model
                return text
            except ProviderError as e:
                last = e
                if not any(m in str(e).lower() for m in UNAVAILABLE):
                    raise
        raise last or ProviderError("no model is configured")


def post_json(url: str, payload: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            data = json.loads(reply.read().decode())
    except urllib.error.HTTPError as e:
        raise ProviderError(f"HTTP {e.code}: {compact(e.read().decode(errors='replace'))}") from None
    except urllib.error.URLError as e:
        raise ProviderError(f"connection failed: {compact(str(e.reason))}") from None
    except ValueError:
        raise ProviderError("the reply is not JSON") from None
    if isinstance(data, dict) and data.get("error"):
        raise ProviderError(compact(json.dumps(data["error"])))
    return data


def with_retry(call: Callable[[], str], attempts: int = 3, pause: float = 1.5, marks: tuple[str, ...] = TRANSIENT, sleep: Callable[[float], None] = time.sleep) -> str:
    """Transient failures are tried again after a growing pause; others are not."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except ProviderError as e:
            if n == attempts or not any(m in str(e).lower() for m in marks):
                raise
            sleep(pause * n)
    raise AssertionError


@dataclass
class HashEmbedder:
    """Deterministic vectors of hashed words, for tests without a network."""

    dimension: int = 64

    def __call__(self, texts: list[str], task: str = "document") -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


def embed(df: DataFrame, text: str, provider: Embedder, task: str = "document", batch: int = 10, pause: float = 0.0, attempts: int = 5) -> DataFrame:
    """``df`` with ``embedding``; distinct texts are embedded once, in batches.

    A failure that outlasts its retries fails the job, so no row goes without
    a vector.
    """

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for i in range(0, len(s), batch):
                texts = s.iloc[i : i + batch].tolist()
                for n in range(attempts):
                    try:
                        out += provider(texts, task)
                        break
                    except ProviderError as e:
                        if n + 1 == attempts or not any(m in str(e).lower() for m in RATE_LIMITED):
                            raise
                        time.sleep(2.0**n)
                if pause:
                    time.sleep(pause)
            yield pd.Series(out)

    distinct = df.select(text).distinct()
    return df.join(distinct.withColumn("embedding", vectors(F.col(text))), text, "left")


def complete(df: DataFrame, prompt: str, provider: Chat, system: str = "", json_mode: bool = False) -> DataFrame:
    """``df`` with ``reply`` and ``reply_error``; an error never poses as an answer."""

    @F.pandas_udf("struct<text:string,error:string>")
    def replies(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            out = []
            for p in s:
                try:
                    out.append((with_retry(lambda p=p: provider(p, system, json_mode)), None))
                except ProviderError as e:
                    out.append((None, compact(str(e))))
            yield pd.DataFrame(out, columns=["text", "error"])

    done = df.withColumn("__reply", replies(F.col(prompt)))
    return done.withColumn("reply", F.col("__reply.text")).withColumn("reply_error", F.col("__reply.error")).drop("__reply")


def health(provider: Chat, token: str = "foliospark-probe-91c4") -> bool:
    """Whether a provider follows a prompt: its reply must hold a token that only the prompt names."""
    try:
        return token in provider(f"Balas tepat dengan token {token}, tanpa kata lain.")
    except Exception:  # a probe reports, it does not raise
        return False


# ---- Deterministic providers for runs without a network ---------------------
#
# Each reads the prompt it is given and nothing else, so a run exercises prompt
# assembly and reply parsing.  Some replies are unusable on purpose, by the
# number of words of the question, so every branch behind a provider is taken.


def _words(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class OfflineRewriter:
    """Puts the last thing the user said before the question."""

    def __call__(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        past, _, question = prompt.rpartition("\n\nPertanyaan terakhir: ")
        said = [line.removeprefix("Pengguna: ") for line in past.split("\n") if line.startswith("Pengguna: ")]
        return f"{said[-1] if said else ''} {question}"


@dataclass
class OfflineReranker:
    """Ten times the share of the question's words that a snippet holds; a question of 11, 22, … words gets no scores."""

    def __call__(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        question, _, listed = prompt.removeprefix("Pertanyaan: ").partition("\n\nKandidat:\n")
        asked = set(_words(question))
        if len(_words(question)) % 11 == 0:
            return "maaf"
        rows = []
        for line in listed.split("\n\n"):
            number, _, snippet = line.removeprefix("[").partition("] ")
            held = len(asked & set(_words(snippet)))
            rows.append({"id": int(number), "score": 1000 * held // max(1, len(asked)) / 100})
        return json.dumps(rows)


@dataclass
class OfflineAnswerer:
    """Quotes the first words of the first context and cites its page.

    By the number of words of the question the call fails (13, 26, …), the
    citation is missing (5, 10, …) or lies outside the contexts (7, 14, …).
    """

    def __call__(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        body, _, rest = prompt.removeprefix("Konteks:\n").rpartition("\n\nPertanyaan: ")
        n = len(_words(rest.rpartition("\n\nSitasi yang boleh dipakai:\n")[0]))
        head, _, text = body.partition("]\n")
        page = int(head.partition("Halaman ")[2].partition(",")[0].partition("-")[0])
        if n % 13 == 0:
            raise ProviderError("HTTP 500: upstream")
        quote = " ".join(text.partition("\n\n---\n\n")[0].partition("\n\nRiwayat percakapan terkini:\n")[0].split()[:8])
        if n % 5 == 0:
            return quote
        return f"{quote} (Halaman {page + 5000 if n % 7 == 0 else page}).\nSumber: Halaman {page}"


@dataclass
class OfflineJudge:
    """Ten times the share of the answer's words that the sources hold; an answer of 6, 12, … words gets no verdict."""

    def __call__(self, prompt: str, system: str = "", json_mode: bool = False) -> str:
        head, _, tail = prompt.rpartition("\n\nJawaban yang dinilai:\n")
        answer = _words(tail.removesuffix("\n\nBalas hanya dengan JSON."))
        if len(answer) % 6 == 0:
            return "rusak"
        sources = set(_words(head.partition("\n\nSumber:\n")[2]))
        missing = [w for w in dict.fromkeys(answer) if w not in sources]
        n = len(set(answer))
        return json.dumps({"score": 10 * (n - len(missing)) // max(1, n), "unsupported_claims": missing[:1]})
