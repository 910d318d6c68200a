"""A language model behind an HTTP server that speaks the common chat-completions protocol."""

from __future__ import annotations

import json
import urllib.error
import urllib.request


def discover(url: str, timeout: float = 30) -> str:
    """The name of the first model that a server offers."""
    with urllib.request.urlopen(f"{url.rstrip('/')}/models", timeout=timeout) as answer:
        return json.load(answer)["data"][0]["id"]


class HttpGenerator:
    """Asks for JSON; a server that refuses the response format is asked once more without it.

    Separate reasoning comes in front of the answer between ``<think>`` marks, which the lenient reader drops.
    """

    def __init__(self, url: str, model: str | None = None, schema: dict | None = None, max_tokens: int = 10_000, timeout: float = 1800) -> None:
        self.url, self.timeout = url.rstrip("/"), timeout
        self.model = model or discover(url)
        self.options: dict = {"temperature": 0.2, "top_p": 0.95, "max_tokens": max_tokens}
        self.format = {"guided_json": schema} if schema else {"response_format": {"type": "json_object"}}

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def generate(self, prompt: str, **context: object) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.options}
        try:
            found = self._post(body | self.format)
        except urllib.error.HTTPError as refused:
            if refused.code != 400:
                raise
            found = self._post(body)
        message = found["choices"][0]["message"]
        content, reasoning = ((message.get(k) or "").strip() for k in ("content", "reasoning_content"))
        return f"<think>\n{reasoning}\n</think>\n{content}" if reasoning else content
