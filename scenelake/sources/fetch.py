"""Calls of an outside metadata service, over a transport that the caller gives."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

#: What a transport gives back: status, headers, body.
Answer = tuple[int, dict[str, str], str]


def get_json(url: str, params: dict, transport: Callable[[str, dict], Answer], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON of an answer. A transport that fails is tried again after 1, 2, 4 seconds, a limited rate after the time it names (5 s by default).

    Any other status of 400 and above is an error at once; RuntimeError when no attempt is left.
    """
    for attempt in range(attempts):
        try:
            status, headers, body = transport(url, params)
        except OSError:
            sleep(2**attempt)
            continue
        if status == 429:
            sleep(float(headers.get("Retry-After", 5)))
        elif status >= 400:
            raise ValueError(f"{url}: status {status}")
        else:
            return json.loads(body)
    raise RuntimeError(f"{url}: no answer in {attempts} attempts")
