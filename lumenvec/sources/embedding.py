"""Where vectors of texts come from."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Sequence
from typing import Protocol

from ..functions.hashing import text_vector


class EmbeddingError(RuntimeError):
    pass


class Embedder(Protocol):
    def embed(self, text: str) -> Sequence[float]: ...


class NoEmbedder:
    def embed(self, text: str) -> Sequence[float]:
        raise EmbeddingError("no embedding service is configured; use VECTOR(...)")


class HashEmbedder:
    """Deterministic vectors for tests: no meaning, but equal texts have equal ones."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def embed(self, text: str) -> Sequence[float]:
        return text_vector(text, self.dim)


class HttpEmbedder:
    """A service with the widespread embeddings interface: POST {model, input}, answer data[0].embedding. Tries again after 429 and 5xx, with doubling pauses."""

    def __init__(self, url: str, key: str, model: str, retries: int = 3, pause_s: float = 0.5, timeout_s: float = 30.0) -> None:
        self.url, self.key, self.model, self.retries, self.pause_s, self.timeout_s = url, key, model, retries, pause_s, timeout_s

    def embed(self, text: str) -> Sequence[float]:
        body = json.dumps({"model": self.model, "input": text}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                    return [float(x) for x in json.load(answer)["data"][0]["embedding"]]
            except urllib.error.HTTPError as e:
                if attempt == self.retries or not (e.code == 429 or e.code >= 500):
                    raise EmbeddingError(f"embedding service: HTTP {e.code}") from e
            except (urllib.error.URLError, KeyError, IndexError, ValueError) as e:
                if attempt == self.retries:
                    raise EmbeddingError(f"embedding service: {e}") from e
            time.sleep(self.pause_s * 2**attempt)
        raise AssertionError
