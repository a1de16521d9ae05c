"""Version histories: turns of a conversation are versions; documents are loaded twice."""

from pyspark.sql import functions as F

from catalogue import query
from millrace import (append_if_changed, at_version, changed_versions, latest, latest_per_key,
                      version_history)
from millrace.functions.workspace import stage

_TURNS = "SELECT conv_id, CAST(turn + 1 AS INTEGER) AS version, role, text FROM conversations"


def turns(t):
    return t.conversations.select("conv_id", (F.col("turn") + 1).cast("int").alias("version"), "role", "text")


@query("versions_latest", f"""
    SELECT conv_id, version, role, text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY version DESC) AS rn FROM ({_TURNS}))
    WHERE rn = 1""")
def versions_latest(t):
    return latest(turns(t), "conv_id")


@query("versions_at", f"SELECT * FROM ({_TURNS}) WHERE version = 3")
def versions_at(t):
    return at_version(turns(t), 3)


@query("versions_history", _TURNS)
def versions_history(t):
    return version_history(turns(t), "conv_id")


# The second load: toxic documents are marked as such; the rest only gain blanks around the text. Pages
# are new. Unchanged up to blanks means no new version.
_SECOND = """
    SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '[toxic] ' || d.text
                          ELSE chr(9) || ' ' || d.text || chr(160) || chr(10) END AS text
    FROM documents d LEFT JOIN labels l USING (doc_id)
    UNION ALL SELECT -1 - page_id, html FROM pages"""
# The characters str.strip() removes, that occur in these tables or are added above.
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"
_ADDED = f"""
    SELECT n.doc_id, n.text, CAST(CASE WHEN d.doc_id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS version
    FROM ({_SECOND}) n LEFT JOIN documents d USING (doc_id)
    WHERE d.doc_id IS NULL OR trim(n.text, {_BLANK}) <> trim(d.text, {_BLANK})"""


def documents_twice(t):
    history = t.documents.select("doc_id", "text", F.lit(1).alias("version"))
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\xa0\n"))
    again = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat(F.lit("[toxic] "), "text")).otherwise(padded).alias("text"))
    web = t.pages.select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return history, again.unionByName(web)


@query("versions_append_if_changed", f"""
    SELECT doc_id, text, CAST(1 AS INTEGER) AS version FROM documents UNION ALL {_ADDED}""")
def versions_append(t):
    history, incoming = documents_twice(t)
    return append_if_changed(history, incoming, "doc_id", "text")


@query("versions_changed_only", _ADDED)
def versions_changed(t):
    history, incoming = documents_twice(t)
    return changed_versions(history, incoming, "doc_id", "text")


@query("versions_append_digest", f"""
    SELECT doc_id, text, CAST(1 AS INTEGER) AS version FROM documents UNION ALL {_ADDED}""")
def versions_append_digest(t):
    """The same with a history that keeps the fingerprint of each text: its scan for the comparison reads no text."""
    history, incoming = documents_twice(t)
    kept = append_if_changed(history.limit(0).withColumn("print", F.lit(None).cast("string")), history.drop("version"), "doc_id", "text", digest="print")
    kept = stage(kept, "history").frame
    return append_if_changed(kept, incoming, "doc_id", "text", digest="print").drop("print")


@query("latest_per_key", """
    SELECT user_id, event_id, ts, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1""")
def newest_event(t):
    return latest_per_key(t.events.select("user_id", "event_id", "ts", "event_type", "value"),
                          "user_id", ["ts", "event_id"])
