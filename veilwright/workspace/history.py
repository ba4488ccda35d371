"""Operations, conversations and versions of a workspace's tables."""

from __future__ import annotations

import json
import secrets as _secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PrivacyError

OPERATION_SCHEMA = "operation_id string, kind string, at_ms long, revision decimal(20,0), entities long, texts long, outcome string"
MAX_OPERATIONS, RESERVED = 100_000, 256
MAX_TIME = 253_402_300_799_999
INTENT_SCHEMA = "conversation_id string, intent_id string, status string, marker string, seq long"
CONVERSATION_SCHEMA = "conversation_id string, surface string, site_id string"


def append_operations(log: DataFrame, rows: DataFrame, recovery: bool = False) -> DataFrame:
    """The log with new rows; the last RESERVED of its MAX_OPERATIONS rows are for recovery only."""
    if rows.where(~F.col("at_ms").between(0, MAX_TIME)).limit(1).count():
        raise PrivacyError("invalid_configuration", "out_of_bounds", "/operations/at_ms")
    if log.count() + rows.count() > MAX_OPERATIONS - (0 if recovery else RESERVED):
        raise PrivacyError("internal_error", "limit_exceeded", "/operations")
    return log.unionByName(rows)


def operations_page(log: DataFrame, offset: int, limit: int) -> DataFrame:
    return log.orderBy("at_ms", "operation_id").offset(offset).limit(limit)


def operation_counts(log: DataFrame) -> DataFrame:
    """(kind, operations, entities, texts, failures) by kind."""
    return log.groupBy("kind").agg(
        F.count("*").alias("operations"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.count_if(F.col("outcome") != "ok").alias("failures")
    )


def intent_status(intents: DataFrame) -> DataFrame:
    """(conversation_id, intent_id, status): the last event of each send: pending, observed_sent or definitely_not_sent."""
    return intents.groupBy("conversation_id", "intent_id").agg(F.max_by("status", "seq").alias("status"))


def memberships(intents: DataFrame) -> DataFrame:
    """(conversation_id, marker): markers of sends that were observed; nothing else counts as issued."""
    sent = intent_status(intents).where("status = 'observed_sent'")
    return intents.where("marker is not null").join(sent, ["conversation_id", "intent_id"], "left_semi").select("conversation_id", "marker").distinct()


def blocked_conversations(intents: DataFrame) -> DataFrame:
    """Conversations with a pending send, in which nothing may be restored yet."""
    return intent_status(intents).where("status = 'pending'").select("conversation_id").distinct()


def conversation_states(conversations: DataFrame, intents: DataFrame) -> DataFrame:
    """(conversation_id, surface, site_id, pending_intents, issued_markers): one row for each row of ``conversations``."""
    pending = intent_status(intents).where("status = 'pending'").groupBy("conversation_id").agg(F.count("*").alias("pending_intents"))
    issued = memberships(intents).groupBy("conversation_id").agg(F.count("*").alias("issued_markers"))
    return conversations.select("conversation_id", "surface", "site_id").join(pending, "conversation_id", "left").join(issued, "conversation_id", "left").fillna(0, ["pending_intents", "issued_markers"])


def conversations_for_sites(wanted: DataFrame, conversations: DataFrame) -> DataFrame:
    """``wanted`` (surface, site_id, ...) with conversation_id and error; names are compared exactly as they are.

    A null or empty name is ``invalid_conversation``; one that no conversation has is
    ``conversation_unknown``. Of several conversations with one name the smallest id is taken.
    """
    names = conversations.where("surface <> '' and site_id <> ''").groupBy("surface", "site_id").agg(F.min("conversation_id").alias("conversation_id"))
    odd = F.coalesce((F.col("surface") == "") | (F.col("site_id") == ""), F.lit(True))
    error = F.when(odd, "invalid_conversation").when(F.col("conversation_id").isNull(), "conversation_unknown")
    return wanted.join(names, ["surface", "site_id"], "left").withColumn("error", error)


def send_statuses(wanted: DataFrame, intents: DataFrame) -> DataFrame:
    """``wanted`` (conversation_id, intent_id, ...) with status and error, which is ``invalid_send_intent`` for sends never prepared."""
    rows = wanted.join(intent_status(intents), ["conversation_id", "intent_id"], "left")
    return rows.withColumn("error", F.when(F.col("status").isNull(), "invalid_send_intent"))


def open_conversation(conversations: DataFrame, intents: DataFrame, conversation_id: str) -> DataFrame:
    """The markers of a conversation in which values may be restored, as ``restore_report`` takes them.

    Raises ``conversation_unknown`` if it does not exist or its site is not known yet, and
    ``conversation_pending`` while a send in it is not resolved.
    """
    own = F.col("conversation_id") == conversation_id
    state = conversation_states(conversations.where(own), intents.where(own)).orderBy(F.col("site_id").isNull(), F.col("site_id")).first()
    if state is not None and state["pending_intents"]:
        raise PrivacyError("conversation_pending")
    if state is None or state["site_id"] is None:
        raise PrivacyError("conversation_unknown")
    return memberships(intents.where(own))


class Versions:
    """Tables saved as numbered versions; a version is committed by creating its manifest, once.

    Two writers that start from the same head cannot both commit: creating a file that exists
    fails. The folder must be on a file system whose create is exclusive.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def head(self) -> dict | None:
        """{revision, commit_id, folder} of the newest version."""
        folder, fs = self._fs(f"{self.root}/manifests")
        if not fs.exists(folder):
            return None
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), key=int)
        if not names:
            return None
        stream = fs.open(self._fs(f"{self.root}/manifests/{names[-1]}")[0])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, schema: str, head: dict | None = None) -> DataFrame:
        head = head or self.head()
        if head is None or name not in head["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{head['folder']}/{name}")

    def commit(self, tables: dict[str, DataFrame], parent: dict | None) -> dict:
        """Writes ``tables`` and makes them the head, unless another version followed ``parent`` meanwhile."""
        revision = (parent["revision"] if parent else 0) + 1
        commit_id = _secrets.token_hex(16)
        folder = f"data/{revision}-{commit_id}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        head = {"revision": revision, "commit_id": commit_id, "folder": folder, "tables": sorted(tables)}
        # the manifest appears whole or not at all: written aside, then renamed if none is there
        written, fs = self._fs(f"{self.root}/{folder}/manifest")
        stream = fs.create(written, False)
        try:
            stream.write(bytearray(json.dumps(head).encode()))
        finally:
            stream.close()
        target, _ = self._fs(f"{self.root}/manifests/{revision}")
        sc = self.spark.sparkContext
        fs.mkdirs(target.getParent())
        never = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        never[0] = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(written.toUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(written), fs.makeQualified(target), never)
        except Exception as error:
            raise PrivacyError("review_conflict", "duplicate_value", "/head", "another version was committed first") from error
        return head
