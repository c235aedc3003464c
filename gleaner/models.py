"""Pluggable models, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import importlib
import json
import math
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.columns import PASSING_KINDS, PASSING_STATUS, embedding_text


class Transient(Exception):
    """A call that failed for now, whatever the reason."""


def failure(e: BaseException) -> tuple[int | None, str]:
    """The status and the kind of a failed call.

    Clients of many libraries are understood: a status may be an attribute of
    the error or of its response, and kinds are told by the error's types.
    """
    for holder in (e, getattr(e, "response", None)):
        for name in ("status", "status_code", "code"):
            if isinstance(status := getattr(holder, name, None), int):
                return status, "status"
    names = " ".join(t.__name__.lower() for t in type(e).__mro__[:-1])
    if isinstance(e, TimeoutError) or "timeout" in names:
        return None, "timeout"
    if isinstance(e, ConnectionResetError) or "readerror" in names:
        return None, "read"
    if isinstance(e, (ConnectionError, Transient)) or "connecterror" in names:
        return None, "connect"
    reason = getattr(e, "reason", None)  # what a wrapped error was
    return failure(reason) if isinstance(reason, BaseException) else (None, "other")


def passing(e: BaseException) -> bool:
    """Whether a failed call is worth another try."""
    status, kind = failure(e)
    return status in PASSING_STATUS or kind in PASSING_KINDS


def tried(call: Callable, attempts: int = 3, wait: float = 1.0):
    """call(), again after 1, 2, 4 ... times ``wait`` seconds if it fails for
    now; the last failure is raised, as are those that stay."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1 or not passing(e):
                raise
            time.sleep(wait * 2**n)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Paced:
    """An embedder that is asked for ``size`` texts at a time, with a pause
    between, and again as long as it fails for now."""

    def __init__(self, embedder: Embedder, size: int = 20, pause: float = 1.0, attempts: int = 6):
        self.embedder, self.size, self.pause, self.attempts = embedder, size, pause, attempts

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.size):
            if k:
                time.sleep(self.pause)
            part = texts[k : k + self.size]
            out += tried(lambda: self.embedder.embed(part), self.attempts, self.pause)
        return out


class BulkEmbedder(Protocol):
    """A service that embeds a file of requests by and by (see sources.bulk)."""

    def submit(self, requests: str) -> str: ...

    def state(self, job: str) -> str: ...

    def results(self, job: str) -> str: ...


class Completer(Protocol):
    def complete(self, system: str, user: str) -> str: ...


def json_from(completer: Completer, system: str, user: str) -> str:
    """An answer that should be JSON: from complete_json, if the client has that
    mode, or as usual where the mode is refused."""
    strict = getattr(completer, "complete_json", None)
    if strict:
        try:
            return strict(system, user)
        except Exception as e:
            if passing(e):
                raise
    return completer.complete(system, user)


def made_by(name: str):
    """What the factory module:function returns; None for no name."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


class HashEmbedder:
    """Unit vectors of hashed words; words that repeat count less and less."""

    def __init__(self, size: int = 768):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.size
        counts: dict[str, int] = {}
        for word in re.findall(r"\w+", text.lower()):
            counts[word] = counts.get(word, 0) + 1
        for word, n in counts.items():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.size] += (1 if h >> 63 else -1) * (1 + math.log(n)) * min(len(word), 8)
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class Scripted:
    """A completer that answers by a function of its prompts."""

    def __init__(self, answer):
        self.answer = answer

    def complete(self, system: str, user: str) -> str:
        return self.answer(system, user)


def embedding(text: Column, embedder: Embedder) -> Column:
    """The vectors of a text column; blank texts are embedded as a space."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(list(texts)))

    return embed(embedding_text(text))


def parsed(text: str):
    """The JSON in a model's answer: all of it, a fenced block, or the widest
    object or array; None if there is none."""
    tried = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S), *re.findall(r"\{.*\}", text, re.S), *re.findall(r"\[.*\]", text, re.S)]
    for part in tried:
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


# What a referee scores.
SCORES = ("novelty", "relevance", "actionability")


def scores_in(text: str, keys: tuple[str, ...] = SCORES) -> dict[str, float]:
    """Scores from a referee's answer, clamped; 0.5 for those it leaves out."""
    data = parsed(text)
    found = data if isinstance(data, dict) else {k: m[1] for k in keys if (m := re.search(rf'"{k}"\s*:\s*([\d.]+)', text))}
    out = {}
    for k in keys:
        try:
            out[k] = max(0.0, min(1.0, float(found.get(k, 0.5))))
        except (TypeError, ValueError):
            out[k] = 0.5
    return out


class Referee(ABC):
    @abstractmethod
    def evaluate(self, question: str, answer: str, evidence: list[str]) -> float: ...


class OverlapReferee(Referee):
    """The share of an answer's words that the evidence holds."""

    def evaluate(self, question: str, answer: str, evidence: list[str]) -> float:
        words = set(re.findall(r"\w+", answer.lower()))
        held = set(re.findall(r"\w+", " ".join(evidence).lower()))
        return len(words & held) / len(words) if words else 0.0


class DebateReferee(Referee):
    """For, against, and a verdict: the mean of three scores."""

    def __init__(self, completer: Completer):
        self.completer = completer

    def evaluate(self, question: str, answer: str, evidence: list[str]) -> float:
        case = f"Question: {question}\nClaim: {answer}\nEvidence:\n" + "\n--\n".join(evidence)
        pro = self.completer.complete("Argue why this claim is new, relevant and useful.", case)
        con = self.completer.complete("Argue against this claim.", case)
        verdict = self.completer.complete('Judge both sides. Answer with JSON: {"novelty", "relevance", "actionability"}, each 0 to 1.', f"{case}\nFor: {pro}\nAgainst: {con}")
        return sum(scores_in(verdict).values()) / 3


class FallbackReferee(Referee):
    """The first referee, or the second where the first fails."""

    def __init__(self, first: Referee, second: Referee):
        self.first, self.second = first, second

    def evaluate(self, question: str, answer: str, evidence: list[str]) -> float:
        try:
            return self.first.evaluate(question, answer, evidence)
        except (NotImplementedError, ValueError, OSError):
            return self.second.evaluate(question, answer, evidence)
