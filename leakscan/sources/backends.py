"""Text sources over HTTP for answers.remote: chat completions of OpenAI-compatible servers and of a router.

A backend is built on the driver and sent to the executors, so it holds plain values only. Keys come from the driver's environment.
"""

from __future__ import annotations

import dataclasses
import inspect
import json
import os
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable

from leakscan import dims as D

# Where the services are, and the environment's names for their addresses and keys.
COMPATIBLE, ROUTER = "https://dashscope-intl.aliyuncs.com/compatible-mode/v1", "https://router.huggingface.co/v1"
BASE_VARIABLE = "LEAKSCAN_BASE_URL"
COMPATIBLE_KEYS, ROUTER_KEYS = ("DASHSCOPE_API_KEY", "OPENAI_API_KEY"), ("HF_TOKEN", "HUGGINGFACE_API_KEY")


@dataclasses.dataclass
class Chat:
    """One POST a probe: greedy, with retries after growing pauses. retry: HTTP states after which to try again; None: after all."""

    model: str
    base_url: str
    api_key: str
    max_tokens: int = 64
    retries: int = 3
    sleep: float = 2.0
    timeout: float = 60.0
    more: dict = dataclasses.field(default_factory=dict)
    retry: tuple[int, ...] | None = (429, 500, 502, 503)

    def ask(self, messages: list[dict]) -> str:
        body = {"model": self.model, "messages": messages, "temperature": 0, "max_tokens": self.max_tokens, **self.more}
        call = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        said = "no attempt"
        for i in range(self.retries):
            try:
                with urllib.request.urlopen(call, timeout=self.timeout) as r:
                    return json.load(r)["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                said = f"HTTP {e.code}: {e.read()[:200].decode(errors='ignore')}"
                if self.retry is not None and e.code not in self.retry:
                    break
            except Exception as e:  # a broken connection or answer: try again
                said = str(e)
            time.sleep(self.sleep * (i + 1))
        raise RuntimeError(f"request failed: {said}")

    def __call__(self, rows: list[dict]) -> list[str]:
        return [self.ask([dict(m) if isinstance(m, dict) else m.asDict() for m in r["messages"]]) for r in rows]


def _key(given: str | None, names: tuple[str, ...]) -> str:
    found = given or next((os.environ[n] for n in names if os.environ.get(n)), None)
    if not found:
        raise RuntimeError(f"no key: set {' or '.join(names)}")
    return found


def openai_compatible(model: str, base_url: str | None = None, api_key: str | None = None, api_key_env: str = COMPATIBLE_KEYS[0], max_tokens: int = 64, retries: int = 3, sleep: float = 2.0) -> Chat:
    """Tries again after the states of busy servers and broken connections only."""
    return Chat(model, base_url or os.environ.get(BASE_VARIABLE) or COMPATIBLE, _key(api_key, (api_key_env, *COMPATIBLE_KEYS[1:])), max_tokens, retries, sleep, more={"top_p": 1, "seed": D.SEED})


def router(model: str, api_key: str | None = None, api_key_env: str = ROUTER_KEYS[0], base_url: str = ROUTER, max_tokens: int = 64, retries: int = 3, sleep: float = 3.0) -> Chat:
    """Tries again after any failure."""
    return Chat(model, base_url, _key(api_key, (api_key_env, *ROUTER_KEYS[1:])), max_tokens, retries, sleep, retry=None)


MADE: dict[str, Callable[..., Chat]] = {"openai_compat": openai_compatible, "dashscope": openai_compatible, "hf_api": router, "hf": router}


def backend(name: str, model: str, **options) -> Chat:
    """A backend by name; options that it doesn't take are named in a warning."""
    if name.lower() not in MADE:
        raise ValueError(f"unknown backend {name}; there are {', '.join(MADE)}, and 'demo' is answers.simulate")
    make = MADE[name.lower()]
    takes = set(inspect.signature(make).parameters) - {"model"}
    if ignored := sorted(set(options) - takes):
        warnings.warn(f"{name} takes no {', '.join(ignored)}", stacklevel=2)
    return make(model, **{k: v for k, v in options.items() if k in takes})
