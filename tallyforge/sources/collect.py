"""External collection: a queue DataFrame sent through a caller-supplied fetcher in partitions.

``fetch`` gets one request (a dict) and returns a dict or raises; results are rows of an
append log, keyed so that a retried task cannot count twice once the log is deduplicated.
No network client ships with the engine.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "key string, status string, payload string, error string, attempt int"


def pending(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Queue rows whose key has no successful record yet."""
    return queue.where(F.trim(F.col(key).cast("string")) != "").join(done.where("status = 'success'").select(key), key, "left_anti")


def collect_from(queue: DataFrame, key: str, fetch: Callable[[dict], dict] | Sequence[Callable[[dict], dict]], retries: int = 3, per_second: float = 0.0, pause: float = 0.0) -> DataFrame:
    """Calls the fetchers in order for every row until one succeeds; linear back-off between tries, a rate limit per partition."""
    fetchers = [fetch] if callable(fetch) else list(fetch)

    def one(row: dict) -> dict:
        import json

        error = ""
        for attempt in range(1, retries + 1):
            for f in fetchers:
                try:
                    return {"key": str(row[key]), "status": "success", "payload": json.dumps(f(row)), "error": None, "attempt": attempt}
                except Exception as e:  # the fetcher's failure is data
                    error = f"{type(e).__name__}: {e}"
            time.sleep(pause * attempt)
        return {"key": str(row[key]), "status": "failed", "payload": None, "error": error, "attempt": retries}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if per_second:
                    time.sleep(1 / per_second)
                out.append(one(row))
            yield pd.DataFrame(out, columns=["key", "status", "payload", "error", "attempt"])

    return queue.mapInPandas(run, RESULT)


def collect_batches(queue: DataFrame, key: str, fetch: Callable[[list[str]], dict[str, dict]], size: int = 100, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """One request for up to ``size`` keys.  ``fetch`` returns {key: payload} with an ``error`` entry for keys that failed.

    Keys that an answer leaves out are ``not_returned``; a request that raises fails all its keys
    after the last try.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            for at in range(0, len(pdf), size):
                keys = [str(k) for k in pdf[key].iloc[at : at + size]]
                answer, error, attempt = None, "", 0
                while answer is None and attempt < retries:
                    attempt += 1
                    try:
                        answer = fetch(keys)
                    except Exception as e:  # the fetcher's failure is data
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * attempt)
                rows = []
                for k in keys:
                    if answer is None:
                        rows.append((k, "failed", None, error, attempt))
                    elif k not in answer:
                        rows.append((k, "failed", None, "not_returned", attempt))
                    elif answer[k].get("error"):
                        rows.append((k, "failed", None, str(answer[k]["error"]), attempt))
                    else:
                        rows.append((k, "success", json.dumps(answer[k]), None, attempt))
                yield pd.DataFrame(rows, columns=["key", "status", "payload", "error", "attempt"])

    return queue.mapInPandas(run, RESULT)


class Stop(Exception):
    """Raised by a fetcher when no further request can succeed (no permission, no credit left)."""


def collect_limited(queue: DataFrame, key: str, fetch: Callable[[dict], dict], per_second: float, senders: int = 4, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """As ``collect_from`` with one limit for the whole job: ``senders`` tasks share ``per_second`` equally.

    The queue is dealt to exactly that many tasks, so their rates add up to the limit however
    large the cluster is.  A fetcher that raises ``Stop`` ends its task's requests; the keys left
    are recorded as stopped and stay pending.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        gap, due, stopped = senders / per_second, time.monotonic(), ""
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                error, attempt, payload = stopped, 0, None
                while not stopped and payload is None and attempt < retries:
                    attempt += 1
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + gap
                    try:
                        payload = json.dumps(fetch(row))
                    except Stop as e:
                        stopped = error = f"stopped: {e}"
                    except Exception as e:  # the fetcher's failure is data
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * attempt)
                out.append((str(row[key]), "failed" if payload is None else "success", payload, None if payload is not None else error, attempt))
            yield pd.DataFrame(out, columns=["key", "status", "payload", "error", "attempt"])

    return queue.repartition(senders).mapInPandas(run, RESULT)


def parsed_replies(log: DataFrame) -> DataFrame:
    """Votes from the payloads of a reply log ({"content": text}): key, rating, score, agree, confidence; the latest success of a key.

    Replies whose rating cannot be read are kept as UNKNOWN, so that they can be asked again.
    """
    from tallyforge.functions import parsing as p

    done = log.where("status = 'success'").groupBy("key").agg(F.max_by("payload", "attempt").alias("payload"))
    raw = F.get_json_object("payload", "$.content")
    f = F.from_json(p.json_blob(raw), "helpfulnessLevel string, agree string, confidence string")
    rows = done.select("key", raw.alias("raw"), f.alias("f"))
    rows = rows.select("key", p.rating(F.col("f.helpfulnessLevel"), F.col("raw"), three_way=True).alias("rating"), "f")
    return rows.select("key", "rating", p.rating_score(F.col("rating")).alias("score"), p.yes_no(F.col("f.agree")).alias("agree"), p.score_100(F.col("f.confidence")).alias("confidence"))


def preflight(queue: DataFrame, key: str, fetch: Callable[[dict], dict], n: int = 5) -> bool:
    """Whether any of the first ``n`` requests (by key) succeeds."""
    return not collect_from(queue.orderBy(key).limit(n), key, fetch, retries=1).where("status = 'success'").isEmpty()
