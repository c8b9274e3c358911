"""Policies around a function that gets one address: retries with backoff, https fallback, status labels, charsets.

The function itself is the caller's (``get(url) -> (body, final_url, status)``), and so is the way to wait; all of
it runs inside the tasks of ``readers.fetch``.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
from collections.abc import Callable

from tarrafa.functions.retry import DNS_MARKERS
from tarrafa.functions.url import LOGIN_MARKERS
from tarrafa.sources.readers import decompressed

Get = Callable[[str], tuple[bytes, str, int]]
MAX_BODY = 2_000_000


class HttpStatus(Exception):
    def __init__(self, code: int):
        super().__init__(f"http_{code}")
        self.code = code


def is_dns_error(error: BaseException) -> bool:
    return any(m in str(error).lower() for m in DNS_MARKERS)


def retrying(get: Get, attempts: int = 6, base: float = 2.0, most: float = 90.0, jitter: float = 1.5, final: tuple[int, ...] = (), sleep: Callable[[float], None] = time.sleep, rand: Callable[[], float] = random.random, delay_of: Callable[[int], float] | None = None) -> Get:
    """``get`` tried again after an error, except for statuses in ``final``; name resolution errors wait 5 seconds at least.

    ``delay_of`` (say ``crawler_delay``) gives the wait after an attempt instead of the backoff with even jitter.
    """

    def run(url: str):
        for n in range(1, attempts + 1):
            try:
                return get(url)
            except Exception as e:
                if n == attempts or isinstance(e, HttpStatus) and e.code in final:
                    raise
                delay = min(most, base * 2 ** (n - 1)) + jitter * rand() if delay_of is None else delay_of(n)
                sleep(max(5.0, delay) if is_dns_error(e) else delay)
        raise AssertionError("unreachable")

    return run


def crawler_delay(attempt: int, base: float = 2.0, most: float = 60.0, rand: Callable[[], float] = lambda: random.gauss(0.0, 1.0)) -> float:
    """Seconds that a crawler waits after an attempt: the backoff with normal jitter, one second at least."""
    return max(1.0, min(most, base * 2 ** (attempt - 1)) + rand())


def http_get(url: str, timeout: float = 30.0) -> tuple[bytes, str, int]:
    """One plain request by the standard library: (body, final address, status); HttpStatus for an error status."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (compatible; tarrafa)", "Accept-Encoding": "gzip, deflate"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read(), r.geturl(), r.status
    except urllib.error.HTTPError as e:
        raise HttpStatus(e.code) from e


def mirrored(folder: str) -> Get:
    """``get`` from a folder in which each page lies under the SHA-1 of its address; 404 for others. The workers must see it."""

    def get(url: str) -> tuple[bytes, str, int]:
        try:
            with open(os.path.join(folder, hashlib.sha1(url.encode()).hexdigest()), "rb") as f:
                return f.read(), url, 200
        except FileNotFoundError:
            raise HttpStatus(404) from None

    return get


def charset(content_type: str | None) -> str:
    m = re.search(r"charset=[\"']?([\w.-]+)", content_type or "", re.I)
    return m.group(1) if m else "utf-8"


def decoded(body: bytes, content_type: str | None = None) -> str:
    """Bytes as text in the header's charset, else UTF-8; what can't be read is replaced."""
    try:
        return body.decode(charset(content_type), errors="replace")
    except LookupError:
        return body.decode("utf-8", errors="replace")


def label(code: int, raised: bool = False) -> str | None:
    """The label of a status; None for 200."""
    named = {404: "not_found", 410: "gone", 403: "forbidden", 429: "rate_limited"}
    if code in named:
        return named[code]
    if code >= 500:
        return "download_failed" if raised else "server_error"
    return None if code == 200 else "download_failed"


def page(get: Get, url: str) -> tuple[str | None, str | None, str, str | None]:
    """(html, final_url, status, error): the address, then its https form if it is plain http; bodies are cut at 2 MB.

    A status that ends the matter (404, 410, 403, 429) is not tried in another form.
    """
    tried = list(dict.fromkeys([url, "https://" + url[7:]] if url.startswith("http://") else [url]))
    error: str | None = None
    for address in tried:
        try:
            body, final, code = get(address)
        except HttpStatus as e:
            if e.code in (403, 404, 410, 429):
                return None, address, label(e.code) or "download_failed", str(e)
            error = str(e)
            continue
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            continue
        if (named := label(code)) is not None:
            return None, final, named, f"http_{code}"
        if any(m in (final or "").lower() for m in LOGIN_MARKERS):
            return None, final, "login_required", None
        return decoded(decompressed(body)[:MAX_BODY]), final, "ok", None
    return None, None, "download_failed", error
