"""Registered queries of sessions, messages, state merges and event streams, with their SQL.

Payloads are JSON that Spark makes from the event and document tables, in the several forms the readers must understand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import text as fx
from codequarry.operators import index, sessions
from codequarry.session import spread, table
from codequarry.streaming import operators as streams

HALF = "2024-01-15"


def _messages(spark, d):
    """A message for each event: session, position, and a payload in one of four forms."""
    e = spread(table(spark, d, "events"))
    role = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in (("view", "user"), ("click", "assistant"), ("error", "tool"), ("purchase", "system"))], F.lit("guest"))
    said = F.when(F.col("event_id") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  event  "), F.col("event_id").cast("string"), F.lit(" of "), F.col("event_type"), F.lit(" ")))
    part = lambda t, **kw: F.struct(F.lit(t).alias("type"), *[v.alias(k) for k, v in kw.items()])
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("string")
    p0 = F.struct(role.alias("role"), said.alias("content"), F.floor(ms / 1000).alias("createdAt"))
    p1 = F.struct(F.struct(F.upper(role).alias("role"), F.struct(ms.alias("created")).alias("time")).alias("info"), F.array(part("text", text=said, value=none), part("tool", text=F.lit("x"), value=none), part("TEXT", text=none, value=F.lit("end"))).alias("parts"))
    p2 = F.struct(role.alias("type"), F.struct(said.alias("content")).alias("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    p3 = F.struct(F.struct(role.alias("role")).alias("author"), F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"), F.col("event_id").alias("id"))
    form = F.col("event_id") % 4
    payload = F.when(form == 0, F.to_json(p0)).when(form == 1, F.to_json(p1)).when(form == 2, F.to_json(p2)).otherwise(F.to_json(p3))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), "ts", payload.alias("payload"))


def _fields(spark, d):
    return sessions.with_message_fields(_messages(spark, d)).drop("payload")


def message_roles(spark, d):
    return _fields(spark, d).select("pos", "role")


def extract_reply(spark, d):
    return _fields(spark, d).select("pos", "reply")


def message_times(spark, d):
    return _fields(spark, d).select("pos", "created_ms")


def message_keys(spark, d):
    return _fields(spark, d).select("pos", "message_key")


def latest_reply(spark, d):
    return sessions.latest_reply(_fields(spark, d), "session")


def last_n_messages(spark, d):
    return sessions.last_messages(_messages(spark, d).select("session", "pos"), "session", "pos", 5)


def fresh_messages(spark, d):
    """Messages of the second half whose session and text weren't seen in the first."""
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "ts", "event_id")
    new = sessions.fresh_messages(e.where(F.col("ts") >= HALF), e.where(F.col("ts") < HALF), ["user_id", "event_type", "k"])
    return new.select("event_id")


def message_delta(spark, d):
    """How many messages each session has after those of the first half."""
    m = table(spark, d, "events")
    seen = m.where(F.col("ts") < HALF).groupBy("user_id").agg(F.max("event_id").alias("seen"))
    later = m.join(seen, "user_id", "left").where(F.col("event_id") > F.coalesce("seen", F.lit(-1)))
    return later.groupBy("user_id").agg(F.count("*").alias("n_new"))


def _session_payloads(spark, d):
    """A session for each project: times, state, flags and paths in nested places."""
    docs = table(spark, d, "documents").where(F.col("project_path").isNotNull())
    s = docs.groupBy("project_path").agg(F.max("created_at").alias("hi"), F.min("created_at").alias("lo"), F.count("*").alias("n"))
    hi, lo = F.unix_millis(F.col("hi").cast("timestamp")), F.unix_millis(F.col("lo").cast("timestamp"))
    time = F.struct(F.when(F.col("n") % 2 == 0, hi * 1000).alias("updated"), F.when(F.col("n") % 3 != 0, F.date_format("lo", "yyyy-MM-dd'T'HH:mm:ss")).alias("created"))
    state = F.when(F.col("n") % 5 == 0, " Running ").otherwise("idle")
    payload = F.to_json(F.struct(time.alias("time"), F.struct(F.concat("project_path", F.lit("//")).alias("cwd"), state.alias("state")).alias("meta"), F.floor(lo / 1000).alias("startedAt")))
    return s.select("project_path", "n", payload.alias("payload"))


def session_activity(spark, d):
    return sessions.with_session_fields(_session_payloads(spark, d)).select("project_path", "updated_ms", "created_ms", "activity_ms", "state", "is_current", "project")


def pick_session(spark, d):
    """The chosen graph file of each project: one that is exported, else the one already chosen, else the first."""
    n = table(spark, d, "graph_nodes").groupBy("project_path", F.col("file_path").alias("id")).agg((F.sum(F.when(F.col("is_exported"), 1).otherwise(0)) >= 8).alias("flag"), F.min("indexed_at").alias("first_at"))
    held = table(spark, d, "code_chunks").groupBy("project_path").agg(F.min("file_path").alias("held"))
    return sessions.pick_session(n.join(held, "project_path", "left"), "project_path", "flag", "held", ["first_at"])


def resolve_selector(spark, d):
    """Names that references use, resolved among the classes."""
    c = table(spark, d, "graph_nodes").where(F.col("kind") == "class").select(F.col("qualified_name").alias("slug"), "id", F.col("name").alias("title")).distinct()
    names = fx.strip(F.regexp_replace("reference_name", r"\(\)$", ""))
    return sessions.resolve_selector(c, table(spark, d, "unresolved_refs").select(names.alias("selector")))


def root_match(spark, d):
    """The configured project above each chunk's file."""
    paths = table(spark, d, "code_chunks").select(F.regexp_replace("file_path", r"\\", "/").alias("path")).distinct()
    roots = table(spark, d, "chunk_config").select(F.col("project_path").alias("root"), F.regexp_extract("project_path", "([^/]+)$", 1).alias("scope"))
    return sessions.root_of(paths, "path", roots)


def belongs_to_project(spark, d):
    """Files of each project that lie below its path."""
    c = table(spark, d, "graph_nodes").select("project_path", "file_path").distinct()
    return c.groupBy("project_path").agg(F.count(F.when(sessions.belongs_to("file_path", "project_path"), 1)).alias("n_inside"), F.count("*").alias("n_files"))


def slugify_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.slug("text").alias("slug"))


def unique_slugs(spark, d):
    n = table(spark, d, "graph_nodes").select(F.col("id").alias("key"), fx.slug("name").alias("base")).distinct().groupBy("key").agg(F.min("base").alias("base"))
    return index.unique_slugs(n, "key", "base", "key")


def parse_timestamps(spark, d):
    """Each event's time, written in five units and forms and read back."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    form = F.col("event_id") % 6
    text = F.when(form == 0, F.floor(ms / 1000).cast("string")).when(form == 1, ms.cast("string")).when(form == 2, (ms * 1000).cast("string")).when(form == 3, (ms * 1000000).cast("string")).when(form == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("at "), ms.cast("string")))
    return table(spark, d, "events").select("event_id", fx.epoch_ms(text).alias("ms"))


def ulid_timestamp(spark, d):
    """Times written as ULIDs and read back."""
    ms = F.unix_millis(F.col("created_at").cast("timestamp"))
    head = F.translate(F.lpad(F.conv(ms.cast("string"), 10, 32), 10, "0"), "ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHJKMNPQRSTVWXYZ")
    ulid = F.concat(F.when(F.col("doc_id") % 2 == 0, "ses_").otherwise(""), head, F.lit("0123456789ABCDEF"))
    return table(spark, d, "documents").select("doc_id", fx.ulid_ms(ulid).alias("ms"))


def normalize_paths(spark, d):
    return table(spark, d, "dependency_graph").select(fx.normal_path(F.concat(F.lit(" "), F.col("target_file"), F.lit("/// "))).alias("path")).distinct()


def path_hash_id(spark, d):
    return table(spark, d, "graph_nodes").select("file_path", fx.path_id("file_path").alias("hash_id")).distinct()


def parse_retry_wait(spark, d):
    """Waits that messages made from the orders ask for."""
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Please try again in "), F.col("o_custkey").cast("string"), F.lit("ms."))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("limit; Try again in "), (F.col("o_custkey") % 60).cast("string"), F.lit(".25s"))).otherwise(F.lit("busy"))
    return o.select("o_orderkey", fx.retry_wait_ms(text).alias("wait_ms"))


def parse_commands(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" /Show-"), F.col("event_type"), F.lit("@helper  "), F.col("user_id").cast("string"))).otherwise(F.col("event_type"))
    return e.select("event_id", fx.command(text).alias("command"), F.when(fx.command(text).isNotNull(), fx.command_arguments(text)).alias("arguments"))


def format_results(spark, d):
    """Snippets and percentages of a result list."""
    c = table(spark, d, "documents").select("doc_id", fx.truncated("text", 300).alias("snippet"), (F.col("n_chars") / 12345.0).alias("score"))
    return c.select("doc_id", "snippet", F.round(F.col("score") * 100).cast("int").alias("percent"), F.round("score", 3).alias("score"))


def html_sniff(spark, d):
    """Documents that hold an HTML page."""
    return table(spark, d, "documents").where(fx.holds_html("text")).select("doc_id")


def json_key_search(spark, d):
    """Entries of the chunks' metadata whose name speaks of tokens or of an index, at any depth down to 3."""
    c = table(spark, d, "code_chunks").select("id", "metadata").distinct()
    return sessions.key_search(c, "id", "metadata", "(?i)token|index")


def best_message_array(spark, d):
    """Of the event types of each user, the one with most filled messages, then most messages."""
    m = sessions.with_message_fields(_messages(spark, d)).join(table(spark, d, "events").select(F.col("event_id").alias("pos"), "event_type"), "pos")
    filled = (F.col("reply") != "").cast("int") + (F.coalesce("role", F.lit("")) == "assistant").cast("int")
    return sessions.best_group(m, "session", "event_type", filled)


def _users(spark, d, second: bool):
    e = table(spark, d, "events").where(F.col("ts") >= HALF if second else F.col("ts") < HALF)
    last = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("l")
    u = e.groupBy("user_id").agg(F.min("ts").alias("started_at"), last)
    return u.select("user_id", "started_at", F.col("l.ts").alias("updated_at"), F.col("l.event_type").alias("status"), F.when(F.col("l.event_type") != "error", F.col("l.value")).alias("value"))


def state_merge(spark, d):
    """An upsert of each user's second half into the first: start times stay, missing values are filled from before."""
    return index.merge_by_key(_users(spark, d, False), _users(spark, d, True), ["user_id"], keep=["started_at"], fill=["value"])


def listed_projects(spark, d):
    """The configured projects, and after them those that only have documents."""
    label = F.regexp_extract("project_path", "([^/]*)$", 1).alias("label")
    roots = table(spark, d, "chunk_config").select("project_path", label)
    return sessions.with_unlisted(roots, table(spark, d, "documents").select("project_path", label).distinct(), "project_path")


def first_free_number(spark, d):
    """The smallest line number that no node of a file starts at."""
    return sessions.first_free(table(spark, d, "graph_nodes"), "file_path", "start_line")


def instance_status(spark, d):
    """Configured projects with their chunks and their last activity, if any."""
    c = table(spark, d, "chunk_config").select("project_path", "max_chunk_size")
    a = table(spark, d, "documents").groupBy("project_path").agg(F.max("created_at").alias("last_active"))
    n = table(spark, d, "code_chunks").groupBy("project_path").agg(F.countDistinct("id").alias("n_chunks"))
    return c.join(a, "project_path", "left").join(n, "project_path", "left")


def ranked_kinds(spark, d):
    """Node kinds of each language: classes first, then functions, then the others by name."""
    n = table(spark, d, "graph_nodes").groupBy("language", "kind").agg(F.count("*").alias("n"))
    return sessions.ranked(n, "language", "kind", ("class", "function"))


def fallback_filter(spark, d):
    """Documents of each project in Korean; all of a project's where it has none."""
    docs = table(spark, d, "documents").where(F.col("project_path").isNotNull())
    return sessions.fallback_rows(docs, "project_path", F.col("lang") == "ko").select("doc_id", "project_path")


def priority_union(spark, d):
    """Names of nodes first, then names only references use: the first source of each name wins."""
    refs = table(spark, d, "unresolved_refs").select(F.col("reference_name").alias("name"))
    return sessions.first_source([table(spark, d, "graph_nodes"), refs], "name")


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def debounce_batch(spark, d):
    out = streams.debounced(_events(spark, d), "user_id", "ts", "event_id", "1 hour")
    return out.select("user_id", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "n_events", F.col("value").alias("last_event"))


def window_counts(spark, d):
    return streams.windowed_counts(_events(spark, d), "ts", "event_type", "1 hour").select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


def sliding_counts(spark, d):
    return streams.windowed_counts(_events(spark, d), "ts", "event_type", "2 hours", "1 hour").select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


def dedupe_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return streams.deduplicated(e, ["user_id", "event_type"], "ts").select("user_id", "event_type")


def session_idle_batch(spark, d):
    """How each user's wait ends: a purchase is idle, an error an error, after two hours it is over."""
    kind = F.when(F.col("event_type") == "purchase", "session.idle").when(F.col("event_type") == "error", "session.error").otherwise("message")
    e = _events(spark, d).select("user_id", "ts", kind.alias("kind"))
    out = streams.until_terminal(e, "user_id", "ts", "kind", 2 * 3600 * 1000)
    return out.select("user_id", "outcome", F.unix_millis("ended").alias("ended_ms"))


def sse_frames(spark, d):
    """Event payloads written as frames, cut into pieces at odd places, and read back."""
    e = table(spark, d, "events").where(F.col("props").isNotNull())
    frame = F.concat(F.when(F.col("event_id") % 50 == 0, F.lit("data: [DONE]\r\n\r\n")).otherwise(F.lit("")), F.lit("event: x\ndata: "), F.col("props"), F.lit("\n\n"))
    cut = (F.col("event_id") % 17 + 3).cast("int")
    pieces = e.select(F.col("user_id").alias("connection"), (F.col("event_id") * 2).alias("ts"), F.substring(frame, F.lit(1), cut).alias("text"))
    pieces = pieces.unionByName(e.select(F.col("user_id").alias("connection"), (F.col("event_id") * 2 + 1).alias("ts"), F.substring(frame, cut + 1, F.length(frame)).alias("text")))
    return streams.sse_payloads(pieces)


def poll_deltas(spark, d):
    """A poll of each user's page by hour, with the number of events so far."""
    from pyspark.sql import Window as W

    e = _events(spark, d)
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    polls = e.select(F.col("user_id").alias("session"), "ts", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w).alias("count"))
    out = streams.poll_deltas(polls, "session", "ts", "count", 5)
    return out.groupBy("session").agg(F.sum("added").alias("added"), F.count("*").alias("polls"), F.max("done").alias("done"))


def watched_changes(spark, d):
    """Files added, changed or removed between the index of the cutoff day and the last one."""
    c = table(spark, d, "code_chunks")
    old = index.latest_hash(c.where(F.col("indexed_at") < "2025-10-01"), ["file_path"], "file_hash", "indexed_at")
    new = index.latest_hash(c.where(F.col("indexed_at") >= "2025-06-01"), ["file_path"], "file_hash", "indexed_at")
    return streams.watched_changes(old, new)


QUERIES = {f.__name__: f for f in (
    message_roles, extract_reply, message_times, message_keys, latest_reply, last_n_messages, fresh_messages, message_delta,
    session_activity, pick_session, resolve_selector, root_match, belongs_to_project, slugify_titles, unique_slugs,
    parse_timestamps, ulid_timestamp, normalize_paths, path_hash_id, parse_retry_wait, parse_commands, format_results, html_sniff,
    json_key_search, best_message_array, state_merge, listed_projects, first_free_number, instance_status, ranked_kinds, fallback_filter,
    priority_union, debounce_batch, window_counts, sliding_counts, dedupe_events, session_idle_batch, sse_frames, poll_deltas,
    watched_changes,
)}

_M = """m AS (SELECT user_id AS session, event_id AS pos, event_id % 4 AS form,
      CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'system' END AS role,
      CASE WHEN event_id % 10 = 0 THEN '' ELSE 'event  ' || event_id || ' of ' || event_type END AS said, (epoch_us(ts) // 1000) AS ms, event_type FROM events),
    f AS (SELECT *, CASE WHEN form <> 1 THEN said WHEN said = '' THEN 'end' ELSE said || ' ' || chr(10) || 'end' END AS reply,
      CASE form WHEN 3 THEN 0 WHEN 1 THEN ms ELSE ms // 1000 * 1000 END AS created_ms FROM m)"""
_FLAT = r"regexp_replace(reply, '\s+', ' ', 'g')"
_WHOLE = f"coalesce(role, 'unknown') || '|' || {_FLAT} || '|'"
_H = f"ts {{}} TIMESTAMP '{HALF}'"


def _half(op: str) -> str:
    last = "max_by({}, (ts, event_id, event_type, value))"
    return f"""SELECT user_id, min(ts) AS started_at, max(ts) AS updated_at, {last.format('event_type')} AS status,
      {last.format("CASE WHEN event_type <> 'error' THEN value END")} AS v0, {last.format('value')} AS v FROM events WHERE {_H.format(op)} GROUP BY 1"""


_SLUG = r"trim(left(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), {}), '-')"
_LASTHASH = "SELECT file_path, max_by(file_hash, (indexed_at, file_hash)) AS h FROM code_chunks WHERE file_hash IS NOT NULL AND {} GROUP BY 1"

ORACLE = {
    "message_roles": f"WITH {_M} SELECT pos, role FROM f",
    "extract_reply": f"WITH {_M} SELECT pos, reply FROM f",
    "message_times": f"WITH {_M} SELECT pos, CAST(created_ms AS BIGINT) AS created_ms FROM f",
    "message_keys": f"""WITH {_M} SELECT pos, CASE WHEN form = 3 THEN 'id:' || pos || ':' || length({_WHOLE}) || ':' || left({_WHOLE}, 240)
      WHEN reply <> '' THEN 'content:' || coalesce(role, 'unknown') || ':' || created_ms || ':' || length({_FLAT}) || ':' || left({_FLAT}, 400)
      ELSE 'fallback:' || pos END AS message_key FROM f""",
    "latest_reply": f"WITH {_M} SELECT session, max_by(reply, (coalesce(role, '') = 'assistant', pos)) AS reply FROM f WHERE reply <> '' GROUP BY 1",
    "last_n_messages": "SELECT user_id AS session, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "fresh_messages": f"""WITH e AS (SELECT *, props->>'$.k' AS k FROM events) SELECT event_id FROM e WHERE {_H.format('>=')}
      AND NOT EXISTS (SELECT 1 FROM e o WHERE o.{_H.format('<')} AND o.user_id = e.user_id AND o.event_type = e.event_type AND o.k = e.k)""",
    "message_delta": f"""WITH s AS (SELECT user_id, max(event_id) AS seen FROM events WHERE {_H.format('<')} GROUP BY 1)
      SELECT user_id, count(*) AS n_new FROM events LEFT JOIN s USING (user_id) WHERE event_id > coalesce(seen, -1) GROUP BY 1""",
    "session_activity": """WITH s AS (SELECT project_path, max((epoch_us(created_at) // 1000)) AS hi, min((epoch_us(created_at) // 1000)) AS lo, count(*) AS n FROM documents WHERE project_path IS NOT NULL GROUP BY 1)
      SELECT project_path, CASE WHEN n % 2 = 0 THEN hi ELSE 0 END AS updated_ms, lo // 1000 * 1000 AS created_ms, CASE WHEN n % 2 = 0 THEN hi ELSE lo // 1000 * 1000 END AS activity_ms,
        CASE WHEN n % 5 = 0 THEN 'running' ELSE 'idle' END AS state, n % 5 = 0 AS is_current, project_path AS project FROM s""",
    "pick_session": """WITH n AS (SELECT project_path, file_path AS id, count(*) FILTER (is_exported) >= 8 AS flag, min(indexed_at) AS first_at FROM graph_nodes GROUP BY 1, 2),
      h AS (SELECT project_path, min(file_path) AS held FROM code_chunks GROUP BY 1)
      SELECT project_path, id AS session FROM n LEFT JOIN h USING (project_path)
      QUALIFY row_number() OVER (PARTITION BY project_path ORDER BY CASE WHEN flag THEN 0 WHEN id = held THEN 1 ELSE 2 END, first_at, id) = 1""",
    "resolve_selector": r"""WITH c AS (SELECT DISTINCT qualified_name AS slug, id, name AS title FROM graph_nodes WHERE kind = 'class'),
      a AS (SELECT DISTINCT trim(regexp_replace(reference_name, '\(\)$', ''), ' ' || chr(9) || chr(10) || chr(13)) AS selector FROM unresolved_refs),
      q AS (SELECT selector, lower(selector) AS low FROM a WHERE selector <> ''),
      k AS (SELECT id, lower(slug) AS k, 0 AS tier FROM c UNION ALL SELECT id, lower(id), 1 FROM c UNION ALL SELECT id, lower(title), 2 FROM c),
      e AS (SELECT selector, arg_min(id, (tier, id)) AS id, CAST(1 AS BIGINT) AS n_matches FROM q JOIN k ON k.k = q.low GROUP BY 1),
      p AS (SELECT selector, count(DISTINCT id) AS n_matches, min(id) AS id FROM (SELECT * FROM q WHERE selector NOT IN (SELECT selector FROM e)) LEFT JOIN c ON contains(lower(slug), low) OR contains(lower(title), low) GROUP BY 1)
      SELECT * FROM e UNION ALL SELECT selector, CASE WHEN n_matches = 1 THEN id END, n_matches FROM p""",
    "root_match": r"""WITH p AS (SELECT DISTINCT replace(file_path, '\', '/') AS path FROM code_chunks)
      SELECT path, coalesce((SELECT max_by(regexp_extract(project_path, '([^/]+)$', 1), length(project_path)) FROM chunk_config
        WHERE path = project_path OR starts_with(path, project_path || '/')), 'custom') AS scope FROM p""",
    "belongs_to_project": """SELECT project_path, count(*) FILTER (file_path = project_path OR starts_with(file_path, project_path || '/')) AS n_inside, count(*) AS n_files
      FROM (SELECT DISTINCT project_path, file_path FROM graph_nodes) GROUP BY 1""",
    "slugify_titles": f"SELECT doc_id, coalesce(nullif({_SLUG.format('text', 48)}, ''), 'untitled') AS slug FROM documents",
    "unique_slugs": rf"""WITH b AS (SELECT id AS key, min(coalesce(nullif({_SLUG.format('name', 48)}, ''), 'untitled')) AS base FROM graph_nodes GROUP BY 1),
      n AS (SELECT key, base, row_number() OVER (PARTITION BY base ORDER BY key) AS n FROM b),
      t AS (SELECT stem, no, row_number() OVER (PARTITION BY stem ORDER BY no) AS i FROM (SELECT DISTINCT regexp_extract(base, '^(.*)-(\d{{1,9}})$', 1) AS stem,
        CAST(nullif(regexp_extract(base, '^(.*)-(\d{{1,9}})$', 2), '') AS INTEGER) AS no FROM b) WHERE stem <> '' AND no >= 2)
      SELECT key, CASE WHEN n = 1 THEN base ELSE base || '-' || (n + (SELECT count(*) FROM t WHERE t.stem = base AND t.no - t.i + 1 <= n)) END AS slug FROM n""",
    "json_key_search": """WITH c AS (SELECT DISTINCT id, metadata FROM code_chunks WHERE json_valid(metadata))
      SELECT c.id, t.fullkey AS path, CAST(t.value AS VARCHAR) AS value FROM c, json_tree(c.metadata) t WHERE regexp_matches(t.key, '(?i)token|index')""",
    "parse_timestamps": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN (epoch_us(ts) // 1000) // 1000 * 1000 WHEN 4 THEN (epoch_us(ts) // 1000) // 1000 * 1000 WHEN 5 THEN 0 ELSE (epoch_us(ts) // 1000) END AS ms FROM events",
    "ulid_timestamp": "SELECT doc_id, (epoch_us(created_at) // 1000) AS ms FROM documents",
    "normalize_paths": "SELECT DISTINCT CASE WHEN target_file = '' THEN '/' ELSE target_file END AS path FROM dependency_graph",
    "path_hash_id": "SELECT DISTINCT file_path, left(sha256(lower(file_path)), 16) AS hash_id FROM graph_nodes",
    "parse_retry_wait": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey % 60 * 1000 + 250 END AS wait_ms FROM orders",
    "parse_commands": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'show_' || event_type END AS command, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS arguments FROM events",
    "format_results": "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS snippet, CAST(round(n_chars / 12345.0 * 100) AS INTEGER) AS percent, round(n_chars / 12345.0, 3) AS score FROM documents",
    "html_sniff": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)<!doctype html>')",
    "best_message_array": f"""WITH {_M}, s AS (SELECT session, event_type, sum(CAST(reply <> '' AS INTEGER) + CAST(coalesce(role, '') = 'assistant' AS INTEGER)) AS score, count(*) AS n FROM f GROUP BY 1, 2)
      SELECT session, event_type, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, n DESC, event_type DESC) = 1""",
    "state_merge": f"""WITH a AS ({_half('<')}), b AS ({_half('>=')})
      SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.started_at, b.started_at) AS started_at, coalesce(b.updated_at, a.updated_at) AS updated_at,
        coalesce(b.status, a.status) AS status, coalesce(CASE WHEN b.status <> 'error' THEN b.v END, CASE WHEN a.status <> 'error' THEN a.v END) AS value
      FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "listed_projects": r"""WITH p AS (SELECT DISTINCT project_path FROM documents WHERE project_path IS NOT NULL)
      SELECT 'root' AS type, project_path, regexp_extract(project_path, '([^/]*)$', 1) AS label FROM chunk_config
      UNION ALL SELECT 'instance', project_path, regexp_extract(project_path, '([^/]*)$', 1) FROM p WHERE project_path NOT IN (SELECT project_path FROM chunk_config)""",
    "first_free_number": """WITH n AS (SELECT DISTINCT file_path, CAST(start_line AS BIGINT) AS n FROM graph_nodes WHERE start_line >= 1)
      SELECT file_path, min(n) AS free FROM (SELECT file_path, n + 1 AS n FROM n UNION SELECT file_path, 1 FROM n) c
      WHERE NOT EXISTS (SELECT 1 FROM n u WHERE u.file_path = c.file_path AND u.n = c.n) GROUP BY 1""",
    "instance_status": """SELECT project_path, max_chunk_size, last_active, n_chunks FROM chunk_config
      LEFT JOIN (SELECT project_path, max(created_at) AS last_active FROM documents GROUP BY 1) USING (project_path)
      LEFT JOIN (SELECT project_path, count(DISTINCT id) AS n_chunks FROM code_chunks GROUP BY 1) USING (project_path)""",
    "ranked_kinds": """SELECT language, kind, count(*) AS n, CAST(row_number() OVER (PARTITION BY language ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 ELSE 10 END, kind) AS INTEGER) AS place
      FROM graph_nodes GROUP BY 1, 2""",
    "fallback_filter": """WITH x AS (SELECT doc_id, project_path, coalesce(lang, '') = 'ko' AS hit FROM documents WHERE project_path IS NOT NULL)
      SELECT doc_id, project_path FROM (SELECT *, max(hit) OVER (PARTITION BY project_path) AS found FROM x) WHERE hit OR NOT found""",
    "priority_union": """SELECT name, CAST(min(p) AS INTEGER) AS source FROM (SELECT name, 0 AS p FROM graph_nodes UNION ALL SELECT reference_name, 1 FROM unresolved_refs)
      WHERE name IS NOT NULL GROUP BY 1""",
    "debounce_batch": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
      SELECT user_id, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms, count(*) AS n_events, max_by(event_id, (ts, event_id)) AS last_event FROM r GROUP BY user_id, run""",
    "window_counts": "SELECT (epoch_us(date_trunc('hour', ts)) // 1000) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_counts": """SELECT start_ms, event_type, count(*) AS n FROM (SELECT (epoch_us(date_trunc('hour', ts)) // 1000) AS start_ms, event_type FROM events
      UNION ALL SELECT (epoch_us(date_trunc('hour', ts)) // 1000) - 3600000, event_type FROM events) GROUP BY 1, 2""",
    "dedupe_events": "SELECT DISTINCT user_id, event_type FROM events",
    "session_idle_batch": """WITH f AS (SELECT user_id, min(ts) AS began FROM events GROUP BY 1),
      t AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'idle' ELSE 'error' END AS k FROM events WHERE event_type IN ('purchase', 'error')),
      e AS (SELECT f.user_id, began, (epoch_us(began) // 1000) + 7200000 AS lim, arg_min(k, (ts, CASE k WHEN 'idle' THEN 2 ELSE 1 END)) AS k, min(ts) AS hit
        FROM f LEFT JOIN t ON t.user_id = f.user_id AND epoch_us(t.ts) <= ((epoch_us(began) // 1000) + 7200000) * 1000 GROUP BY ALL)
      SELECT CAST(user_id AS VARCHAR) AS user_id, coalesce(k, 'timeout') AS outcome, coalesce((epoch_us(hit) // 1000), lim) AS ended_ms FROM e
      WHERE hit IS NOT NULL OR lim * 1000 <= (SELECT max(epoch_us(ts)) FROM events)""",
    "sse_frames": """SELECT CAST(user_id AS VARCHAR) AS connection, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, props AS payload
      FROM events WHERE props IS NOT NULL""",
    "poll_deltas": """WITH p AS (SELECT user_id, ts, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
      a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, n) AS pos,
        greatest(n - coalesce(max(n) OVER (PARTITION BY user_id ORDER BY ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS added FROM p),
      s AS (SELECT *, max(CASE WHEN added > 0 THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS began FROM a),
      e AS (SELECT user_id, min(pos) FILTER (pos - began >= 5) AS stop FROM s GROUP BY 1)
      SELECT CAST(user_id AS VARCHAR) AS session, CAST(sum(added) AS BIGINT) AS added, count(*) AS polls, max(coalesce(pos = stop, false)) AS done
      FROM s JOIN e USING (user_id) WHERE stop IS NULL OR pos <= stop GROUP BY 1""",
    "watched_changes": f"""WITH b AS ({_LASTHASH.format("indexed_at < '2025-10-01'")}), a AS ({_LASTHASH.format("indexed_at >= '2025-06-01'")})
      SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'add' WHEN a.file_path IS NULL THEN 'unlink' ELSE 'change' END AS change
      FROM a FULL JOIN b ON a.file_path = b.file_path WHERE a.h IS DISTINCT FROM b.h""",
}
