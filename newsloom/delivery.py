"""Deliveries and mirrors as Spark writers with receipts, and mirrors as a stream of pages (survey K13, K14, K17, K17b, K17c, S26, S27).

``card_outbox`` and ``page_mirror`` are Python data sources that tasks write to. What leaves a task cannot be taken back, so each
message or page has a key of its own and a receipt in the state folder: a task that is run again, or a run that was killed
and is repeated, finds the receipt and does not send again. Between sending and its receipt only the receiver's own
idempotency key, which goes with each message, can help. A committed write leaves one file of outcomes for its run; the run
stores them as events, and repeating that replaces them.

``mirror_pages`` reads a paged listing as a stream whose offset is the page cursor, so a restart goes on where it was.

Transports are named ``module:factory``; the factory gets the destination and returns an object. For messages it has
``send(key, text) -> id``; for mirrors ``find(key) -> id or None``, ``create(key, properties) -> id``, ``update(id, properties)``,
``archive(id)``; for listings ``page(cursor) -> (rows, next cursor or None)``.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage

from newsloom.functions import render

#: Characters of a message, attempts and seconds to wait between them.
MESSAGE = 4096
ATTEMPTS, FIRST_WAIT, LAST_WAIT = 3, 2.0, 10.0
OUTCOME = "alert_key string, status string, seq long, external_id string, error_message string"
ACTIONS = "key string, action string, page_id string, error_message string"
PAGE = "page_id string, key string, properties string, archived boolean"


def transport(name: str, destination: str):
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(destination)


class Receipts:
    """Small files in the state folder, one a key, that appear whole or not at all."""

    def __init__(self, root: str):
        from pyarrow import fs

        if "://" in root or root.startswith("file:"):
            self.fs, self.root = fs.FileSystem.from_uri(root)
        else:
            self.fs, self.root = fs.LocalFileSystem(), root
        self.missing = fs.FileType.NotFound

    def _path(self, key: str) -> str:
        name = hashlib.sha256(key.encode()).hexdigest()
        return f"{self.root}/{name[:2]}/{name}"

    def get(self, key: str) -> str | None:
        path = self._path(key)
        if self.fs.get_file_info(path).type == self.missing:
            return None
        with self.fs.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, key: str, value: str) -> None:
        path = self._path(key)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(value.encode())
        self.fs.move(part, path)


def split_message(text: str, limit: int = MESSAGE) -> list[str]:
    """A text as messages of at most ``limit`` characters, cut at a blank line, a line or a blank where there is one."""
    out = []
    while len(text) > limit:
        cut = next((k for mark in ("\n\n", "\n", " ") if (k := text.rfind(mark, 1, limit + 1)) > 0), limit)
        out.append(text[:cut].rstrip())
        text = text[cut:].lstrip()
    return [*out, text] if text or not out else out


def with_attempts(call, *args, sleep=time.sleep):
    """Up to three attempts where the way there fails, waiting twice as long each time."""
    for n in range(ATTEMPTS):
        try:
            return call(*args)
        except OSError:
            if n + 1 == ATTEMPTS:
                raise
            sleep(min(LAST_WAIT, FIRST_WAIT * 2**n))


@dataclass
class Outcomes(WriterCommitMessage):
    rows: list[dict]


class _Writer(DataSourceWriter):
    """Writes rows one by one; a failure of one is an outcome and stops nothing."""

    def __init__(self, options, names: list[str]):
        self.names, self.run, self.root = names, options["run"], options["path"].rstrip("/")
        self.transport, self.destination = options["transport"], options.get("destination", "")
        self.wait = float(options.get("wait", FIRST_WAIT))

    def write(self, iterator):
        to, receipts = transport(self.transport, self.destination), Receipts(f"{self.root}/receipts")
        return Outcomes([self.one(to, receipts, dict(zip(self.names, row))) for row in iterator])

    def attempt(self, call, *args):
        return with_attempts(call, *args, sleep=lambda s: time.sleep(s * self.wait / FIRST_WAIT))

    def commit(self, messages):
        rows = [r for m in messages if m for r in m.rows]
        receipts = Receipts(self.root)
        path = f"{receipts.root}/outcomes/run={self.run}"
        receipts.fs.create_dir(path, recursive=True)
        part = f"{path}/.{uuid.uuid4().hex}"
        with receipts.fs.open_output_stream(part) as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        receipts.fs.move(part, f"{path}/outcomes.json")

    def abort(self, messages):
        """What was sent has its receipt; the next attempt goes on from there."""


class CardWriter(_Writer):
    def one(self, to, receipts, row):
        ids = []
        try:
            for n, text in enumerate(split_message(row["text"])):
                key = f"{self.destination}\n{row['alert_key']}\n{n}"
                ref = receipts.get(key)
                if ref is None:
                    ref = str(self.attempt(to.send, hashlib.sha256(key.encode()).hexdigest(), text) or "")
                    receipts.put(key, ref)
                ids.append(ref)
            return {"alert_key": row["alert_key"], "status": "delivered", "seq": row["seq"], "external_id": ",".join(ids), "error_message": ""}
        except Exception as e:  # an error is data
            return {"alert_key": row["alert_key"], "status": "failed", "seq": row["seq"], "external_id": ",".join(ids), "error_message": f"{type(e).__name__}: {e}"}


class PageWriter(_Writer):
    """Creates, updates or archives a page; a page is known by the stored id, else by the receipt of its creation, else by asking the mirror."""

    def one(self, to, receipts, row):
        key, properties = row["key"], json.loads(row["properties"] or "{}")
        receipt = f"{self.destination}\npage\n{key}"
        page, done = row["page_id"], "failed"
        try:
            page = page or receipts.get(receipt) or self.attempt(to.find, key)
            if row["archive"]:
                done = "archived" if page else "skipped"
                if page:
                    self.attempt(to.archive, page)
            elif page:
                self.attempt(to.update, page, properties)
                done = "updated"
            else:
                page = str(self.attempt(to.create, key, properties))
                done = "created"
            if done in ("created", "updated"):
                receipts.put(receipt, page)
            return {"key": key, "action": done, "page_id": page, "error_message": ""}
        except Exception as e:
            return {"key": key, "action": "failed", "page_id": page, "error_message": f"{type(e).__name__}: {e}"}


class CardOutbox(DataSource):
    @classmethod
    def name(cls):
        return "card_outbox"

    def writer(self, schema, overwrite):
        return CardWriter(self.options, schema.names)


class PageMirror(DataSource):
    @classmethod
    def name(cls):
        return "page_mirror"

    def writer(self, schema, overwrite):
        return PageWriter(self.options, schema.names)


class _Listing(SimpleDataSourceStreamReader):
    """Offset: the cursor of the page to read next, and how many of its rows were read when it was the last one."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"cursor": "", "seen": 0}

    def _page(self, cursor):
        to = transport(self.options["transport"], self.options.get("destination", ""))
        return with_attempts(to.page, cursor or None)

    def read(self, start):
        rows, after = self._page(start["cursor"])
        new = rows[start["seen"]:]
        return iter([_page_row(r) for r in new]), {"cursor": after, "seen": 0} if after else {"cursor": start["cursor"], "seen": len(rows)}

    def readBetweenOffsets(self, start, end):
        """The rows between two offsets of an earlier attempt."""
        at = dict(start)
        while at != end:
            rows, after = self._page(at["cursor"])
            last = at["cursor"] == end["cursor"]
            yield from (_page_row(r) for r in rows[at["seen"]:end["seen"] if last else None])
            if last or not after:
                return
            at = {"cursor": after, "seen": 0}

    def commit(self, end):
        pass


def _page_row(r: dict) -> tuple:
    return r.get("page_id"), r.get("key"), json.dumps(r.get("properties") or {}, sort_keys=True, ensure_ascii=False), bool(r.get("archived"))


class MirrorPages(DataSource):
    @classmethod
    def name(cls):
        return "mirror_pages"

    def schema(self):
        return PAGE

    def simpleStreamReader(self, schema):
        return _Listing(self.options)


class Folder:
    """A destination that is a folder: each message a file named by its key, so that sending twice changes nothing."""

    def __init__(self, destination: str):
        self.store = Receipts(destination)

    def send(self, key: str, text: str) -> str:
        self.store.fs.create_dir(self.store.root, recursive=True)
        path = f"{self.store.root}/{key[:32]}.txt"
        with self.store.fs.open_output_stream(path) as f:
            f.write(text.encode())
        return path


def _written(df: DataFrame, kind: type[DataSource], root: str, run: str, to: str, destination: str, schema: str, wait: float) -> DataFrame:
    spark = df.sparkSession
    spark.dataSource.register(kind)
    df.write.format(kind.name()).mode("append").options(path=root, run=run, transport=to, destination=destination, wait=str(wait)).save()
    return spark.read.schema(schema).json(f"{root}/outcomes/run={run}")


def deliver(alerts: DataFrame, root: str, run: str, to: str, destination: str, channel: str, as_of: str, dry_run: bool = False, locale: str = "en", wait: float = FIRST_WAIT) -> DataFrame:
    """Sends the cards of a digest, those of a region in order, and returns the delivery events of the run (K13). A dry run only logs.

    ``root`` is a folder that tasks and driver share; a second call for the same run sends only what has no receipt.
    """
    cards = alerts.select(F.col("digest_key").alias("alert_key"), render.card(locale).alias("text"), (F.coalesce("region_ord", F.lit(0)).cast("long") * 1_000_000 + F.col("rank")).alias("seq"), "region")
    if dry_run:
        out = cards.select("alert_key", F.lit("dry_run").alias("status"), "seq", F.lit("").alias("external_id"), F.lit("").alias("error_message"))
    else:
        in_order = cards.repartition("region").sortWithinPartitions("seq").select("alert_key", "text", "seq")
        out = _written(in_order, CardOutbox, f"{root}/{channel}", run, to, destination, OUTCOME, wait)
    return out.withColumns({"channel": F.lit(channel), "destination": F.lit(destination), "event_ts": F.lit(as_of).cast("timestamp")})


def mirrored(alerts: DataFrame, root: str, run: str, to: str, destination: str, pages: DataFrame | None = None, gone: DataFrame | None = None, dry_run: bool = False, wait: float = FIRST_WAIT) -> DataFrame:
    """Creates or updates a page per alert and archives the pages of ``gone`` (key); returns key, action, page_id, error_message.

    ``pages`` has key and page_id of pages known before. A dry run says would_create, would_update and would_archive.
    """
    spark = alerts.sparkSession
    known = pages.select("key", "page_id") if pages is not None else spark.createDataFrame([], "key string, page_id string")
    rows = alerts.select(F.col("digest_key").alias("key"), F.to_json(render.mirror_properties()).alias("properties"), F.lit(False).alias("archive"))
    if gone is not None:
        rows = rows.unionByName(gone.select("key", F.lit(None).cast("string").alias("properties"), F.lit(True).alias("archive")))
    rows = rows.join(known.groupBy("key").agg(F.min("page_id").alias("page_id")), "key", "left")
    if dry_run:
        action = F.when(F.col("archive"), "would_archive").when(F.col("page_id").isNull(), "would_create").otherwise("would_update")
        return rows.select("key", action.alias("action"), "page_id", F.lit("").alias("error_message"))
    # one row a key, so that no two tasks make the same page
    one = rows.groupBy("key").agg(F.max_by(F.struct("properties", "archive", "page_id"), F.struct(~F.col("archive"), "properties")).alias("r")).select("key", "r.*")
    return _written(one, PageMirror, f"{root}/mirror", run, to, destination, ACTIONS, wait)


def mirror_destination(env: dict[str, str], primary: str = "MIRROR_DATABASE_ID", fallback: str = "DATABASE_ID", token: str = "MIRROR_TOKEN") -> tuple[str | None, list[str]]:
    """(destination, warnings): the mirror's own id, else the shared one with a warning; None if the mirror is not configured."""
    found = env.get(primary, "").strip()
    warnings = []
    if not found and env.get(fallback, "").strip():
        found = env[fallback].strip()
        warnings.append(f"{primary} is not set; {fallback} is used, which other writers may share")
    if not found or not env.get(token, "").strip():
        return None, [*warnings, "the mirror is not configured and is left out"]
    return found, warnings


def pages(spark: SparkSession, to: str, destination: str = "") -> DataFrame:
    """A mirror's pages as a stream."""
    spark.dataSource.register(MirrorPages)
    return spark.readStream.format("mirror_pages").options(transport=to, destination=destination).load()
