"""Board lists and a data source that fetches their payloads over HTTP."""

from __future__ import annotations

import email.utils
import json
import random
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.sources.files import SourceError

_TOKEN = re.compile(r"[A-Za-z0-9_-]+")
_FIELDS = {"token", "company_name", "industry", "industry_source"}


@dataclass(frozen=True)
class Board:
    token: str
    company_name: str
    industry: str | None = None
    industry_source: str | None = None


def parse_boards(text: str) -> list[Board]:
    """A checked board list: known keys, required ones, valid tokens that differ in more than case."""
    data = yaml.safe_load(text)
    rows = data.get("boards") if isinstance(data, dict) else None
    if not isinstance(rows, list) or not rows:
        raise SourceError("a list of boards is needed")
    found, seen = [], set()
    for n, row in enumerate(rows):
        if not isinstance(row, dict) or row.keys() - _FIELDS or not row.get("token") or not row.get("company_name"):
            raise SourceError(f"board {n}: token and company_name are needed, {sorted(_FIELDS)} allowed")
        if not _TOKEN.fullmatch(row["token"]) or row["token"].lower() in seen:
            raise SourceError(f"board {n}: the token is malformed or repeated")
        if row.get("industry") and not row.get("industry_source"):
            raise SourceError(f"board {n}: an industry needs its source")
        seen.add(row["token"].lower())
        found.append(Board(**row))
    return found


def board_table(spark, boards: list[Board]):
    rows = [(b.token, n, b.company_name, b.industry, b.industry_source) for n, b in enumerate(boards)]
    return spark.createDataFrame(rows, "board_token string, board_order int, company_name string, industry string, industry_source string")


def retry_after(value: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for, from seconds or a date; never negative; None if unreadable."""
    if not value:
        return None
    try:
        return max(float(value), 0.0)
    except ValueError:
        pass
    try:
        return max((email.utils.parsedate_to_datetime(value) - now).total_seconds(), 0.0)
    except (TypeError, ValueError):
        return None


def fetch(url: str, timeout: float = 30, retries: int = 3, budget: float = 60, get=None, sleep=time.sleep, now=lambda: datetime.now(UTC)) -> tuple[bytes, int]:
    """Body and status of a URL. Busy answers (429, 5xx) and broken connections are tried again, after Retry-After or growing pauses, within a budget of seconds."""
    get = get or _get
    spent = 0.0
    for attempt in range(retries + 1):
        status, body, wait = 0, b"", None
        try:
            status, body, headers = get(url, timeout)
            wait = retry_after(headers.get("Retry-After"), now())
        except OSError:
            pass
        if status and status != 429 and status < 500:
            return body, status
        pause = wait if wait is not None else 2**attempt + random.random()
        if attempt == retries or spent + pause > budget:
            break
        sleep(pause)
        spent += pause
    raise SourceError(f"{url}: no answer after {attempt + 1} tries, last status {status or 'none'}")


def _get(url: str, timeout: float) -> tuple[int, bytes, dict]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, r.read(), dict(r.headers)
    except urllib.error.HTTPError as e:
        return e.code, e.read(), dict(e.headers)


def payload_jobs(body: bytes) -> int:
    """How many jobs a payload holds; an error unless it is an object with a list of jobs."""
    try:
        data = json.loads(body)
    except ValueError as e:
        raise SourceError("the payload is no JSON") from e
    if not isinstance(data, dict) or not isinstance(data.get("jobs"), list):
        raise SourceError("the payload has no list of jobs")
    return len(data["jobs"])


@dataclass
class _Board(InputPartition):
    token: str


class BoardSource(DataSource):
    """``spark.read.format("boards").option("tokens", "a,b").option("url", "https://host/{token}").load()``: a partition for each board."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "board_token string, http_status int, job_count int, body string, error string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.tokens, self.url = options["tokens"].split(","), options["url"]

    def partitions(self):
        return [_Board(t) for t in self.tokens]

    def read(self, partition):
        try:
            body, status = fetch(self.url.format(token=partition.token))
            yield (partition.token, status, payload_jobs(body), body.decode("utf-8"), None)
        except SourceError as e:
            yield (partition.token, None, None, None, str(e))


def fetch_plan(boards, verified, refresh: bool = False):
    """``(board_token, action)``: ``would_use_cache`` for boards with a verified file, else ``would_fetch``."""
    from pyspark.sql import functions as F

    known = verified.select("board_token", F.lit(True).alias("_known")).distinct()
    return boards.join(known, "board_token", "left").select("board_token", F.when(F.col("_known") & F.lit(not refresh), "would_use_cache").otherwise("would_fetch").alias("action"))


def load_boards(path: str | Path) -> list[Board]:
    return parse_boards(Path(path).read_text(encoding="utf-8"))
