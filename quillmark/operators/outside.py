"""An outside judge: a client that answers one request at a time, asked from Spark's tasks.

Requests are distinct by key and dealt into buckets by a hash of the key; a bucket belongs to one task, which asks in the order of
the keys and records answers in the bucket's folder of a shared store, ``every`` answers to a file. A task that runs again, after
a lost executor or in a later run, reads the bucket's answers first and asks for the others only, and what they have cost counts
against its budget. Recorded are the redacted text and all attempts, so a run can be audited and judged again without the client.
Speculative execution should be off while a client is asked: two copies of a task do not know of each other.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strict_json
from ..functions.rules import pin
from .integrity import transient
from .pairs import SCORES, Judge

#: (HTTP status or None, body or None, kind of fault or None) of one request; faults that are worth another attempt: transient().
Answer = tuple[int | None, str | None, str | None]
Client = Callable[[str], Answer]

RECORD = "key string, http int, body string, error string, attempts int"
#: Names of what integrity.transient() takes for a passing fault.
PASSING = ("timeout", "connection", "url")


def _passing(http: int | None, error: str | None) -> bool:
    return http in (408, 429) or http is not None and http >= 500 or error in PASSING


class Book:
    """The answers of one bucket: compressed JSON lines in files that are written once. Plain files are read too."""

    def __init__(self, uri: str, bucket: int, every: int):
        self.store, top = fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", uri), safe="/:"))
        self.folder, self.every, self.new = f"{top}/bucket={bucket}", every, []
        self.held: dict[str, dict] = {}
        for f in self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if f.base_name.endswith((".json", ".json.gz")):
                with self.store.open_input_stream(f.path) as s:  # its name tells whether it is compressed
                    self.held |= {r["key"]: r for r in map(json.loads, s.read().decode().splitlines())}
        self.spent = sum(r["attempts"] for r in self.held.values())

    def add(self, answer: dict) -> None:
        self.held[answer["key"]] = answer
        self.spent += answer["attempts"]
        self.new.append(answer)
        if len(self.new) >= self.every:
            self.write()

    def write(self) -> None:
        """A file appears whole: it is moved to its name when it has been written."""
        if self.new:
            self.store.create_dir(self.folder)
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.store.open_output_stream(f"{name}.tmp") as s:
                s.write(gzip.compress("".join(json.dumps(r) + "\n" for r in self.new).encode(), 1))
            self.store.move(f"{name}.tmp", f"{name}.json.gz")
            self.new = []


def ask(key: str, payload: str, client: Client, attempts: int, left: int | None, most_bytes: int, secret: str) -> dict:
    """One request with at most ``attempts`` attempts, of which there are ``left`` in the budget."""
    out = {"key": key, "http": None, "body": None, "error": None, "attempts": 0}
    if len(payload.encode()) > most_bytes:
        return out | {"error": "input budget exceeded"}
    while out["attempts"] < attempts:
        if left is not None and out["attempts"] >= left:
            # The last fault stays, so that the record says why another attempt was wanted.
            return out | {"error": "budget exhausted" if not out["attempts"] else f"budget exhausted after {out['error'] or out['http']}"}
        http, body, error = client(payload)
        hide = lambda text: text.replace(secret, "[redacted]") if text and secret else text
        out |= {"http": http, "body": hide(body), "error": hide(error), "attempts": out["attempts"] + 1}
        if not _passing(http, error):
            break
    return out


def answers(pending: DataFrame, payload: Column, client: Client, record: str, buckets: int = 1024, every: int = 1, attempts: int = 3, budget: int | None = None, most_bytes: int = 1 << 20, secret: str = "") -> DataFrame:
    """(key, http, body, error, attempts) of each distinct key of ``pending``. ``budget`` is what a bucket may spend in all its runs; a record
    folder keeps its number of ``buckets``. At most a bucket's answers are held by a task: choose buckets accordingly."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows = pending.select("key", payload.alias("payload")).dropDuplicates(["key"]).select(bucket.alias("bucket"), "key", "payload")
    names = ["key", "http", "body", "error", "attempts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, now = None, None
        try:
            for b in batches:
                found = []
                for at, key, payload in zip(*(c.to_pylist() for c in b.columns)):
                    if at != now:
                        if book:
                            book.write()
                        book, now = Book(record, at, every), at
                    if key not in book.held:
                        left = None if budget is None else budget - book.spent
                        told = ask(key, payload, client, attempts, left, most_bytes, secret)
                        if told["attempts"]:  # what was never asked may be asked by a run with more budget
                            book.add(told)
                        found.append(told)
                    else:
                        found.append(book.held[key])
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("key", pa.string()), ("http", pa.int32()), ("body", pa.string()), ("error", pa.string()), ("attempts", pa.int32())])).select(names)
        finally:
            if book:
                book.write()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(work, RECORD)


def recorded(spark: SparkSession, record: str) -> DataFrame:
    """All recorded answers."""
    return spark.read.schema(f"{RECORD}, bucket int").option("pathGlobFilter", "*.{json,json.gz}").json(record).drop("bucket")


def outside_judge(payload: Column, allowed: Column, client: Client, record: str, text: Callable[[Column], Column] = strict_json.provider_text, **limits) -> Judge:
    """A judge whose calls are a client's answers, strictly parsed. ``payload`` and ``allowed`` (citation ids) are expressions on pending
    requests; ``text`` finds the response in a body; ``limits`` are those of answers()."""

    def judge(pending: DataFrame) -> DataFrame:
        got = answers(pending, payload, client, record, **limits)
        # Each step is computed once, whatever names it later.
        j = pin(pending.join(got, "key"), raw=text(F.col("body")))
        j = pin(j, fault=strict_json.pair_error(F.col("raw"), allowed))
        failed = F.coalesce((F.col("http") >= 400), F.lit(True)) | F.col("error").isNotNull()
        j = pin(j, status=strict_json.envelope(F.col("raw"), failed, F.lit(False), F.col("fault")))
        j = pin(j, s=F.when(F.col("status") == "ok", strict_json.pair_scores(F.col("raw"))))
        score = lambda c: F.col(f"s.{c.upper()}").cast("int").alias(c)
        return j.select("batch", "rank", "key", "status", F.col("s.winner").alias("winner"), *(score(c) for c in SCORES), "attempts", F.coalesce("error", "fault").alias("error"), transient(F.col("http"), F.col("error")).alias("transient"))

    return judge
